"""The contract queries: thin uses of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, order_minhash, packing, quality, secrets, sentencepiece_codec, sharding, simhash, substrings, token_store
from millrace.llm._common import prepare
from millrace.workspace import new_path

#: Place of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(secrets.count_kind("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.as_text("base"), 256).alias("base_sha256"),
        secrets.as_text("spans").alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.with_next(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    uri = new_path(spark, "token-store")
    token_store.write_store(docs, uri, tokenizer_file("byte_bpe_50k.json"), end_id=2, shards=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return token_store.read_keys(spark, uri, docs)


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_windows(turns.union(probe), tokenizer_file("byte_bpe_50k.json")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: The others need token ids, fingerprints or fitted verdicts, which SQL doesn't have; tests hold them against brute force.
OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS w FROM places
), firsts AS (
  SELECT w, min(doc_id) AS first FROM windows GROUP BY w
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (w) WHERE first < doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_removed FROM covered GROUP BY doc_id
), left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs) ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_substring_dedup": OP8_SQL}
