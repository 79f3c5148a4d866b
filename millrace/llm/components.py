"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import durable

MOST_ROUNDS = 60


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def stars(edges: DataFrame, name: str = "stars") -> DataFrame:
    """``(u, v)`` links to ``(u, v)``: every node but the least of its component, with that least node.

    Each round replaces a node's links by links to its least neighbour; rounds
    grow with the logarithm of the longest path.  No group is gathered: a round
    aggregates minima and joins them back, and tables are written between rounds.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), name)
    sign = _sign(now)
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        before, sign = sign, _sign(now)
        if before == sign:
            return now
    raise RuntimeError("components did not settle")
