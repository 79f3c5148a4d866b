"""Clients of services: a factory for each kind, replaceable (as in tests).

A source client has ``read(partition) -> iterator of dicts``; a sink client has
``write(rows) -> list of (index, error)`` for single rows that failed, or
raises for the whole batch.  Both may have ``close()``.  Factories get the
transform's config, are pickled to the executors, and are called there.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

from millrace.errors import CapabilityError

Factory = Callable[[Any], Any]
_factories: dict[str, Factory] = {}
#: The library that each kind's client needs.
LIBRARIES = {
    "mongodb": "pymongo", "elasticsearch8": "elasticsearch", "elasticsearch6": "elasticsearch", "redis": "redis", "neo4j": "neo4j", "hbase": "happybase", "ftp": "ftplib", "pulsar": "pulsar",
    "rabbitmq": "pika", "sqs": "boto3", "dynamodb": "boto3", "cassandra": "cassandra", "prometheus": "urllib.request", "debezium": "pydbzengine",
}


def use(kind: str, factory: Factory | None) -> None:
    """Sets the factory of a kind; None restores the default."""
    _factories.pop(kind, None) if factory is None else _factories.__setitem__(kind, factory)


def factory(kind: str) -> Factory:
    if kind in _factories:
        return _factories[kind]
    library = LIBRARIES[kind]
    try:
        importlib.import_module(library)
    except ModuleNotFoundError:
        raise CapabilityError(f"{kind} needs the library {library}, or a client factory set with clients.use") from None
    from millrace.sources import drivers

    made = getattr(drivers, kind, None)
    if made is None:
        raise CapabilityError(f"{kind} has no default client here; set one with clients.use")
    return made
