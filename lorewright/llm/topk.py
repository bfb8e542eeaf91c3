"""Operator 4: exact top-k search by distributed histogram selection.

Vectors become integers floor(256 x). Queries and candidates are packed into blocks of rows, the
blocks into tiles, and every tile of queries meets every tile of candidates (a stated query set
against all rows, not a join of rows): a candidate travels once per tile of 16,384 queries. A pass
scores a pair of blocks as one matrix product, exact in float64 or, for large components, in wrapping
64-bit integers, and counts scores per query in BINS bins of the current range; sums over all tiles
locate the bin of the kth value. A tile gives a query's highest bins only, as far as they hold k
scores: the kth value of all is never below. Each pass narrows the range BINS-fold, until the kth
value itself is known. A last pass keeps scores from the kth value on, and breaks ties by the
smaller id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.store import small_batches, stored

SCALE = 256
BIN_BITS = 9
BINS = 1 << BIN_BITS
QUERY_BLOCK, BLOCK = 256, 2048
#: Blocks of a tile, at most.
QUERY_TILE, TILE = 64, 64
#: Products are exact in float64 while their sum stays below this.
EXACT = 1 << 52
#: Largest score; one beyond counts as this, and as its negative on the other side. One less stands for no score.
MOST = (1 << 63) - 1
NONE = -MOST - 1
BLOCK_SCHEMA = pa.schema([("ids", pa.binary()), ("parts", pa.list_(pa.struct([("dim", pa.int32()), ("at", pa.binary()), ("values", pa.binary())]))), ("norm", pa.float64())])


def _packed(rows: int):
    """A packer of (id, vector) rows into blocks of about *rows*, by the vectors' length.

    Rows of one id come together; they stay in one block, whatever their lengths. A block is its
    ids, each once, and per length the places of the ids and their vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list]]] = {}
        counts: Counter[int] = Counter()
        group: list = []
        last = None

        def block(members: list[tuple[int, list]]) -> dict:
            by: dict[int, tuple[list, list]] = {}
            for n, (_, vs) in enumerate(members):
                for v in vs:
                    at, some = by.setdefault(len(v), ([], []))
                    at.append(n)
                    some.append(v)
            parts, size = [], 0.0
            for dim, (at, some) in by.items():
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(np.array(some, np.float64).reshape(len(at), dim) * SCALE), -_LARGEST, _LARGEST)
                size = max(size, float(_norms(v).max()))
                parts.append({"dim": dim, "at": np.array(at, "<i4").tobytes(), "values": v.tobytes()})
            return {"ids": np.array([d for d, _ in members], "<i8").tobytes(), "parts": parts, "norm": size}

        def put() -> Iterator[pa.RecordBatch]:
            if group:
                dim = len(group[0])
                held.setdefault(dim, []).append((last, list(group)))
                counts[dim] += len(group)
                group.clear()
                if counts[dim] >= rows:
                    del counts[dim]
                    yield batch(held.pop(dim))

        def batch(members: list[tuple[int, list]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block(members)], schema=BLOCK_SCHEMA)

        for b in batches:
            vec = b.column(1)
            for i, d in enumerate(b.column(0).to_pylist()):
                if d != last:
                    yield from put()
                    last = d
                group.append(vec[i].values.to_numpy(zero_copy_only=False))
        yield from put()
        for members in held.values():
            yield batch(members)

    return run


def _parts(row: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of a block, by length: the places of the ids, rising, and their vectors."""
    out = {}
    for x in row["parts"]:
        at = np.frombuffer(x["at"], "<i4")
        out[x["dim"]] = at, np.frombuffer(x["values"]).reshape(len(at), x["dim"])
    return out


def _best(s: np.ndarray, at: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids' places, each once, and the greatest score of each along *axis*."""
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], s if len(first) == len(at) else np.maximum.reduceat(s, first, axis=axis)


_LARGEST = np.finfo(np.float64).max


def _norms(v: np.ndarray) -> np.ndarray:
    """Lengths of the rows; squares of large components don't overflow."""
    if not v.shape[1]:
        return np.zeros(len(v))
    most = np.maximum(np.abs(v).max(axis=1), 1.0)
    with np.errstate(over="ignore"):
        return most * np.sqrt(np.square(v / most[:, None]).sum(axis=1))


def _wrapped(v: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2**64."""
    v = np.fmod(v, 2.0**64)
    high = np.floor(v / 2.0**32)
    return (high.astype(np.int64).view(np.uint64) << np.uint64(32)) + (v - high * 2.0**32).astype(np.uint64)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size: wrapped where they fit, else one by one, at most MOST."""
    s = (_wrapped(q) @ _wrapped(c).T).view(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.abs(q @ c.T) < 2.0**62
        near &= _norms(q)[:, None] * _norms(c)[None, :] * (q.shape[1] * 2.0**-52) < 2.0**61
    for i, j in zip(*np.nonzero(~near), strict=True):
        s[i, j] = max(-MOST, min(MOST, sum(int(x) * int(y) for x, y in zip(q[i], c[j], strict=True))))
    return s


class _Queries:
    """A block of queries, with the low end of each one's range and its histogram."""

    def __init__(self, row: dict):
        self.ids, self.parts = np.frombuffer(row["ids"], "<i8"), _parts(row)
        self.norm, self.lows = row["norm"], np.array(row["lows"], np.int64)
        self.counts = np.zeros(len(self.ids) * BINS, np.int64)

    def scores(self, ids: np.ndarray, parts: dict[int, tuple[np.ndarray, np.ndarray]], norm: float) -> np.ndarray:
        """Best scores of the ids of a block of candidates; NONE for a query itself."""
        out = None
        for dim in self.parts.keys() & parts.keys():
            (a, q), (b, c) = self.parts[dim], parts[dim]
            b, s = _best((q @ c.T).astype(np.int64) if self.norm * norm < EXACT else _products(q, c), b, 1)
            a, s = _best(s, a, 0)
            if out is None and s.shape == (len(self.ids), len(ids)):
                out = s
                continue
            if out is None:
                out = np.full((len(self.ids), len(ids)), NONE)
            at = np.ix_(a, b)
            out[at] = np.maximum(out[at], s)
        out[self.ids[:, None] == ids[None, :]] = NONE
        return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[_Queries], np.ndarray, dict, float] | list[_Queries]]:
    """Of rows by tile, queries first: (queries, ids, parts, norm) per block of candidates, and the queries at a tile's end."""
    last, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if last != (row["i"], row["j"]):
                if held:
                    yield held
                last, held = (row["i"], row["j"]), []
            if row["kind"] == 0:
                held.append(_Queries(row))
            else:
                parts = _parts(row)
                yield [q for q in held if q.parts.keys() & parts.keys()], np.frombuffer(row["ids"], "<i8"), parts, row["norm"]
    if held:
        yield held


def _counted(bits: int, k: int):
    """Counts per query and bin of 2 ** *bits* scores; of a tile's bins the highest, as far as they hold *k* scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _tiles(batches):
            if isinstance(x, tuple):
                for q in x[0]:
                    s = q.scores(*x[1:])
                    # The difference of two longs fits an unsigned one.
                    bin_ = (s.view(np.uint64) - q.lows.view(np.uint64)[:, None]) >> np.uint64(bits)
                    ok = (s >= q.lows[:, None]) & (s > NONE) & (bin_ < BINS)
                    at = (np.arange(len(q.ids))[:, None] * BINS + np.where(ok, bin_, np.uint64(0)).astype(np.int64))[ok]
                    q.counts += np.bincount(at, minlength=len(q.counts))
            else:
                for q in x:
                    n = q.counts.reshape(-1, BINS)
                    above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
                    i, b = np.nonzero((n > 0) & (above < k))
                    yield pa.record_batch([pa.array(q.ids[i]), pa.array(b.astype(np.int32)), pa.array(n[i, b])], names=["id", "bin", "n"])

    return run


def _taken(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _tiles(batches):
            for q in x[0] if isinstance(x, tuple) else ():
                c = x[1]
                s = q.scores(*x[1:])
                i, j = np.nonzero((s >= q.lows[:, None]) & (s > NONE))
                score = s[i, j]
                order = np.lexsort((c[j], ~score, i))
                i, j, score = i[order], j[order], score[order]
                # Of one block at most k can be among a query's first k.
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.record_batch([pa.array(q.ids[i[keep]]), pa.array(c[j[keep]]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    return run


def usable(vector: str) -> F.Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def search(vectors: DataFrame, queries: F.Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank int, vec_id, score long): each query's k highest scores.

    *queries* is a condition on rows. Candidates are all rows with another id. Vectors that are
    null or hold null or non-finite components take no part, nor do rows with a null id; only
    vectors of one length are compared. Repeated ids count as one candidate and one query, with the
    best score among them; the distinct vectors of one id are held in one block, so they must fit a
    worker. Components may be of any size: scores are exact, and those beyond a long count as its
    largest value (negative ones as minus that); 256 x beyond a double counts as the largest double.
    """
    rows = vectors.where(usable(vector) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    small_batches(vectors.sparkSession)
    shape = "ids binary, parts array<struct<dim:int,at:binary,values:binary>>, norm double"
    # Only the rows of repeated ids are brought together.
    many = vectors.groupBy(F.col(id).cast("long").alias("id")).agg(F.count("*").alias("n")).where("id is not null and n > 1").select("id")
    many = stored(many, "repeated")
    none = many.isEmpty()

    def blocks(part: DataFrame, size: int) -> DataFrame:
        part = part.select("id", "v")
        if none:
            return part.mapInArrow(_packed(size), shape)
        again = part.join(many, "id", "left_semi").distinct().repartition("id").sortWithinPartitions("id")
        return part.join(many, "id", "left_anti").mapInArrow(_packed(size), shape).unionByName(again.mapInArrow(_packed(size), shape))

    c = stored(blocks(rows, BLOCK), "candidates")
    q = stored(blocks(rows.where("is_query"), QUERY_BLOCK), "queries")
    (nc, c_norm), (nq, q_norm) = (x.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0))).first() for x in (c, q))
    widest = min(c_norm * q_norm, float(1 << 62))
    down = max(1, -(-nq // QUERY_TILE))
    across = max(1, -(-nc // TILE), min(nc, 2 * vectors.sparkSession.sparkContext.defaultParallelism))

    def tiled(lows: DataFrame) -> DataFrame:
        """Rows of every tile (i, j): its queries (kind 0) with their lows, then its candidates."""
        mine = q.join(lows, "ids").withColumn("i", F.pmod(F.xxhash64("ids"), F.lit(down)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        other = c.withColumn("j", F.pmod(F.xxhash64("ids"), F.lit(across)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
        columns = ["i", "j", "kind", "ids", "parts", "norm", "lows"]
        both = mine.withColumn("kind", F.lit(0)).select(*columns).unionByName(other.withColumns({"kind": F.lit(1), "lows": F.lit(None).cast("array<bigint>")}).select(*columns))
        return both.repartition(max(1, down * across), "i", "j").sortWithinPartitions("i", "j", "kind")

    # The kth value lies in [low, low + 2 ** (bits + BIN_BITS)); one row per query.
    low = -int(widest) - 1 if widest < 1 << 62 else -MOST
    bits = max(0, (-2 * low).bit_length() - BIN_BITS)
    state = stored(rows.where("is_query").select("id").distinct().select("id", F.lit(low).cast("long").alias("low"), F.lit(k).cast("long").alias("need")), "range")

    while True:
        got = tiled(_per_block(q, state)).mapInArrow(_counted(bits, k), "id long, bin int, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("id").orderBy(F.desc("bin"))
        run = got.withColumn("above", F.sum("n").over(w) - F.col("n"))
        # The kth value's bin, or the lowest one for a query with fewer candidates.
        run = run.join(state, "id").where("above < need").groupBy("id", "low", "need").agg(F.min(F.struct("bin", "above")).alias("x"))
        low = F.col("low").cast("decimal(38,0)") + F.col("x.bin").cast("decimal(10,0)") * F.lit(1 << bits).cast("decimal(20,0)")
        state = stored(run.select("id", low.cast("long").alias("low"), (F.col("need") - F.col("x.above")).alias("need")), "range")
        if not bits:
            break
        bits = max(0, bits - BIN_BITS)

    top = tiled(_per_block(q, state)).mapInArrow(_taken(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


def _per_block(q: DataFrame, state: DataFrame) -> DataFrame:
    """(ids, lows): of each block of queries, the low ends of their ranges in the block's order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                v = np.frombuffer(x, "<i8")
                yield pa.record_batch([pa.array([x] * len(v), pa.binary()), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["ids", "place", "id"])

    rows = q.select("ids").distinct().mapInArrow(each, "ids binary, place int, id long").join(state, "id", "left")
    # A query without candidates has no range: nothing reaches its low end.
    order = F.array_sort(F.collect_list(F.struct("place", F.coalesce("low", F.lit(MOST)).alias("low"))))
    return rows.groupBy("ids").agg(F.transform(order, lambda x: x["low"]).alias("lows"))
