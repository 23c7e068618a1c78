"""Folding of append-only logs: later amendments win field by field."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_log(log: DataFrame, key: str, line: str, fields: list[str]) -> DataFrame:
    """One row per key: of each field the last value that is not null, and the number of lines."""
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(line, f)))[f].alias(f) for f in fields]
    return log.groupBy(key).agg(*last, F.count(F.lit(1)).alias("lines"))


def chain_hash(previous: str, record: dict) -> str:
    """Hash of a record chained to the one before; the chain is sequential and read on the driver."""
    return hashlib.sha256((previous + json.dumps(record, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()


def broken_link(records: list[dict]) -> int | None:
    """Index of the first record whose hash does not follow; None for a sound chain."""
    previous = ""
    for i, r in enumerate(records):
        body = {k: v for k, v in r.items() if k != "hash"}
        if r.get("hash") != (previous := chain_hash(previous, body)):
            return i
    return None
