"""Exact vector retrieval and its context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import dot, unit

# Results and threshold of a retrieval, and of the fallback's.
TOP, THRESHOLD = 5, 0.3
FALLBACK_TOP, FALLBACK_THRESHOLD = 3, 0.25


def index(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, unit array<double>): the vectors scaled to length 1."""
    return vectors.select(F.col(id).alias("id"), unit(F.col(vector)).alias("unit"))


def search(index_: DataFrame, query: DataFrame, top: int = TOP, positive: bool = True) -> DataFrame:
    """(id, score): the *top* rows by inner product with the one row of *query* (unit); ties by id.

    The query is a single vector, so it is broadcast; each task keeps only its own top rows.
    """
    scored = index_.crossJoin(F.broadcast(query.limit(1).select(F.col("unit").alias("q")))).select("id", dot(F.col("unit"), F.col("q")).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(top)
    return best.where("score > 0") if positive else best


def retrieve(index_: DataFrame, query: DataFrame, top: int = TOP, threshold: float = THRESHOLD) -> DataFrame:
    """The top rows first, of them those that reach the threshold."""
    return search(index_, query, top).where(F.col("score") >= threshold)


def hash_embedding(text: Column, dim: int = 16) -> Column:
    """A unit vector from the text's SHA-256: *dim* numbers of 4 hex digits each, centred."""
    h = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    raw = F.array(*(F.conv(F.substring(h, 1 + 4 * k, 4), 16, 10).cast("double") / 65536.0 - 0.5 for k in range(dim)))
    return unit(raw)


def embed(rows: DataFrame, id: str, text: str, model: Callable[[list[str]], list[list[float] | None]], dim: int) -> DataFrame:
    """(id, unit): a caller's model in batches; texts it gives nothing for get their hash embedding."""
    kind = rows.select(id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                got = model([x or "" for x in b.column(1).to_pylist()])
            except Exception:  # the caller's model: hash vectors stand in for this batch
                got = [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.float64()))], names=["id", "text", "v"])

    out = rows.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, text string, v array<double>")
    return out.select("id", F.coalesce(unit(F.col("v")), hash_embedding(F.col("text"), dim)).alias("unit"))
