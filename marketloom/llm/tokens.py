"""Encoding of a corpus with a public byte-level vocabulary."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.vocabulary import DEFAULT_FOLDER, Encoder, PerfectHash, read_ranks

#: Characters a batch may hold before it is encoded in parts.
BATCH_CHARS = 4_000_000
_encoders: dict[str, Encoder] = {}


def load_vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None):
    """Broadcast of (ranks, perfect hash): 50,256 tokens, about 2 MB, whatever the corpus."""
    path = os.path.join(folder or os.environ.get("MARKETLOOM_TOKENIZERS", DEFAULT_FOLDER), f"{name}.tiktoken")
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((ranks, PerfectHash.build(list(ranks), list(ranks.values()))))


def _encoder(key: str, shared) -> Encoder:
    """The worker process's encoder of a vocabulary; it outlives a task."""
    if key not in _encoders:
        _encoders[key] = Encoder(*shared.value)
    return _encoders[key]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Spans of a batch whose texts hold a bounded number of characters (one text may exceed it)."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BATCH_CHARS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def token_ids(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row, without special tokens, whose strings are ordinary text.

    Null and empty texts give an empty list; repeated rows give repeated results. No shuffle.
    """
    shared = load_vocabulary(documents.sparkSession, vocabulary, folder)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(f"{folder}/{vocabulary}", shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _parts(texts):
                ids = pa.array(encoder.encode(texts[lo:hi]), type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens INT) of every row; 0 for null and empty texts. No shuffle, no id lists."""
    shared = load_vocabulary(documents.sparkSession, vocabulary, folder)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(f"{folder}/{vocabulary}", shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _parts(texts):
                n = pa.array(encoder.count(texts[lo:hi]), type=pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), n], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens int")
