"""Operator 8: embedding near-dedup by E8 lattice hashing.

A unit vector is projected by TABLES random maps onto 8 dimensions, scaled and shifted, and decoded
to the nearest point of the E8 lattice, its cell. Besides its own cell it is entered in PROBES
neighbouring ones: the nearest points found in the lattice's other coset and by changing the two
least certain coordinates. Vectors of one label that share a cell are compared by exact cosine in
double precision.

Identical vectors are first made one row with a count. A cell is split into blocks of bounded size,
and pairs of blocks are compared as matrix products in separate task units; the pairs of all small
cells of a batch are compared at once. A pair that meets in several cells counts in the smallest
only. No pair leaves a task: each unit gives its vectors' numbers of new links and the components
among them. Vectors are scaled by their largest component first, so no norm overflows or vanishes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.components import components, settle
from lorewright.llm.skew import join_keyed
from lorewright.llm.texts import U, constants, mix, whole_groups
from lorewright.store import stored
from lorewright.llm.topk import usable

COSINE = 0.98
TABLES, PROBES = 4, 2
SCALE = 4.0
#: Numbers in a block of vectors of one cell, and vectors at most.
BLOCK_NUMBERS, BLOCK = 1 << 19, 8192
#: Units of at most so many vectors are compared together, so many pairs at a time.
SMALL, PAIRS = 48, 1 << 15
SEED = 20240


def _maps(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """[TABLES, 8, dim] maps with orthogonal rows (as far as dim allows) and [TABLES, 8] shifts."""
    rng = np.random.default_rng(SEED + dim)
    maps = np.empty((TABLES, 8, dim))
    for t in range(TABLES):
        q, _ = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))
        maps[t] = q.T[:, :dim]
    # A map keeps 8 / dim of a difference's square; scaled so that SCALE is the same for any dim.
    return maps * SCALE * np.sqrt(max(dim, 8) / 64), rng.random((TABLES, 8))


def _even(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of D8 (integers with an even sum), and the next ones by two coordinates."""
    near = np.rint(x)
    off = x - near
    order = np.argsort(-np.abs(off), axis=1)
    rows = np.arange(len(x))
    step = np.where(off >= 0, 1.0, -1.0)
    odd = np.mod(near.sum(axis=1), 2) == 1
    first, second = order[:, 0], order[:, 1]
    home = near.copy()
    home[rows[odd], first[odd]] += step[rows[odd], first[odd]]
    # From an even point the two least certain coordinates change; from a corrected one, another is corrected instead.
    other = near.copy()
    other[rows[odd], second[odd]] += step[rows[odd], second[odd]]
    even = ~odd
    for c in (first, second):
        other[rows[even], c[even]] += step[rows[even], c[even]]
    return home, other


def cells(x: np.ndarray) -> np.ndarray:
    """[1 + PROBES, rows, 8]: twice the nearest E8 point of each row, then its neighbours by distance."""
    found = []
    for shift in (0.0, 0.5):
        for p in _even(x - shift):
            found.append(p + shift)
    points = np.stack(found)
    far = ((points - x[None]) ** 2).sum(axis=2)
    order = np.argsort(far, axis=0, kind="stable")[: 1 + PROBES]
    return np.rint(2 * np.take_along_axis(points, order[:, :, None], axis=0)).astype(np.int64)


def units_of(v: np.ndarray) -> np.ndarray:
    """The rows at length 1, in double precision."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cell_keys(v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """[rows, TABLES * (1 + PROBES)] 64-bit keys of label, length, table and cell, in order."""
    maps, shifts = _maps(v.shape[1])
    unit = units_of(v)
    c = constants(8, 61)
    out = []
    for t in range(TABLES):
        for points in cells(unit @ maps[t].T + shifts[t]):
            h = (points.astype(U) * c).sum(axis=1, dtype=U)
            out.append(mix(mix(h + U(t * 1000 + 7)) ^ mix(label.astype(U) * U(0x9E3779B97F4A7C15) + U(v.shape[1]))))
    return np.sort(np.stack(out, axis=1).view(np.int64), axis=1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec, copies, label, v): keys added, the vector as bytes of its own type; by the vectors' length."""
    for b in batches:
        sizes = np.diff(b.column(3).offsets.to_numpy()) if b.num_rows else np.zeros(0)
        for dim in np.unique(sizes).tolist():
            part = b.filter(pa.array(sizes == dim))
            if not dim:
                continue
            v = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            keys = cell_keys(v, part.column(2).to_numpy())
            at = np.arange(len(v) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel())), pa.array([x.tobytes() for x in v], pa.binary())],
                names=["vec", "copies", "keys", "v"],
            )


def _compared(batches: Iterator[pa.RecordBatch], kind: type = np.float64) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, part, vec, copies, keys, v) by unit: (vec, links, root) of vectors with links."""
    for t, at in whole_groups(batches, 3):
        key, i, j, part, vec, copies = (t[n].to_numpy() for n in ("key", "i", "j", "part", "vec", "copies"))
        keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(len(vec), -1)
        links, root = np.zeros(len(vec), np.int64), np.arange(len(vec))
        blob = t["v"].to_pylist()
        size = np.fromiter(map(len, blob), np.int64, len(blob))
        # A unit's vectors have one length; a batch can hold several.
        for dim in np.unique(size).tolist():
            of = np.flatnonzero(size == dim)
            v = units_of(np.frombuffer(b"".join(blob[x] for x in of.tolist()), kind).reshape(len(of), -1))
            place = np.full(len(vec), -1)
            place[of] = np.arange(len(of))
            for a, b in _pairs(at, size, dim, part, i, j):
                x, y = place[a], place[b]
                # A matrix product for the blocks of a large unit, else pair by pair.
                if x.ndim == 2:
                    a, b = a.ravel(), b.ravel()
                    p, q = np.nonzero(v[x[:, 0]] @ v[y[0]].T >= COSINE)
                    a, b = a[p], b[q]
                    ok = (a < b) | (i[a] != j[a])
                else:
                    ok = np.einsum("ij,ij->i", v[x], v[y]) >= COSINE
                a, b = a[ok], b[ok]
                if len(a):
                    settle(root, a, b)
                    new = ~_met_before(keys[a], keys[b], key[a])
                    np.add.at(links, a[new], copies[b[new]])
                    np.add.at(links, b[new], copies[a[new]])
        hit = (links > 0) | (root != np.arange(len(vec)))
        if hit.any():
            yield pa.record_batch([pa.array(vec[hit]), pa.array(links[hit]), pa.array(vec[root[hit]])], names=["vec", "links", "root"])


def _pairs(at: np.ndarray, size: np.ndarray, dim: int, part: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows to compare of the units that begin at *at*: two arrays of rows, or a column and a row of them."""
    n = np.diff(at)
    mine = size[at[:-1]] == dim
    small = mine & (n <= SMALL) & (i[at[:-1]] == j[at[:-1]])
    for m in np.unique(n[small]).tolist():
        a, b = np.triu_indices(m, 1)
        first = at[:-1][small & (n == m)]
        step = max(1, PAIRS // max(1, len(a)))
        for lo in range(0, len(first) if m > 1 else 0, step):
            begin = first[lo : lo + step, None]
            yield (begin + a).ravel(), (begin + b).ravel()
    for u in np.flatnonzero(mine & ~small).tolist():
        rows = np.arange(at[u], at[u + 1])
        left, right = rows[part[rows] == i[at[u]]], rows[part[rows] == j[at[u]]]
        for lo in range(0, len(left), 256):
            if len(right):
                yield left[lo : lo + 256, None], right[None, :]


def _met_before(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether two vectors share a key smaller than their *key*."""
    out = np.zeros(len(a), dtype=bool)
    for x in range(a.shape[1]):
        k = a[:, x]
        some = np.flatnonzero((k < key) & ~out)
        if len(some):
            out[some] = (b[some] == k[some, None]).any(axis=1)
    return out


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: vec_id, n_links long, component_id long, kept boolean.

    Only vectors with equal labels that aren't null, and of one length, link; labels are of any type.
    Vectors that are null, empty or zero, or hold null or non-finite components, have no links and
    are their own component. Repeated rows of one id and vector are one vector; an id with several
    vectors has the links of any of them. A null id takes no part: 0 links, component and kept null.
    An empty table gives an empty result.
    """
    v = F.col(vector)
    good = usable(vector) & F.exists(v, lambda x: x != 0) & F.col(label).isNotNull() & F.col(id).isNotNull()
    norm = F.coalesce(good, F.lit(False))
    # Single precision travels as it is; all arithmetic is in double.
    single = "float" if vectors.select(v).schema[0].dataType.simpleString() == "array<float>" else "double"
    kind = np.float32 if single == "float" else np.float64
    hashed = [F.when(norm, F.xxhash64(F.lit(s), label, vector)).alias(f"h{s}") for s in (1, 2)]
    rows = stored(vectors.select(F.col(id).cast("long").alias("vec"), F.when(norm, F.xxhash64(F.lit(3), label)).alias("label"), F.when(norm, v.cast(f"array<{single}>")).alias("v"), *hashed), "vectors")
    class_ = ["label", "h1", "h2"]
    ids = stored(rows.where("h1 is not null").groupBy("vec", *class_).agg(F.count("*").alias("n")), "ids")
    classes = stored(ids.groupBy(*class_).agg(F.min("vec").alias("rep"), F.count("*").alias("copies"), F.min_by("n", "vec").alias("n")), "classes")
    total = rows.count()
    # Of each class the rows of its smallest id, and of these, which are alike, one.
    first = join_keyed(rows.where("h1 is not null"), classes.withColumnRenamed("rep", "vec"), ["vec", *class_], total, "n")
    first = first.groupBy("vec", "copies", *class_).agg(F.any_value("v").alias("v")).select("vec", "copies", "label", "v")
    table = stored(first.mapInArrow(_keyed, "vec long, copies long, keys array<bigint>, v binary"), "keyed")

    # A cell's vectors have one length, given here by their bytes.
    long_ = F.length("v") / (4 if single == "float" else 8)
    dealt = table.select(F.explode(F.array_distinct("keys")).alias("key"), "vec", F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.lit(BLOCK_NUMBERS) / long_)).alias("block"))
    sizes = stored(dealt.groupBy("key").agg(F.count("*").alias("members"), F.min("block").alias("block")).where("members > 1"), "cells")
    n = sizes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    units = join_keyed(dealt.drop("block"), sizes, ["key"], n, "members").withColumn("cuts", F.ceil(F.col("members") / F.col("block")).cast("int"))
    units = units.withColumn("part", F.pmod(F.xxhash64("vec"), "cuts").cast("int")).withColumn("against", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    units = units.join(table, "vec").select("key", F.least("part", "against").alias("i"), F.greatest("part", "against").alias("j"), "part", "vec", "copies", "keys", "v")
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "vec")
    found = stored(units.mapInArrow(lambda b: _compared(b, kind), "vec long, links long, root long"), "links")

    same = join_keyed(ids.select("vec", *class_), classes.where("copies > 1"), class_, total, "copies").where("vec <> rep").select(F.col("vec").alias("a"), F.col("rep").alias("b"))
    parts = stored(components(same.unionByName(found.select(F.col("vec").alias("a"), F.col("root").alias("b")))), "parts")
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    each = classes.join(links, F.col("rep") == F.col("vec"), "left").select(*class_, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    each = stored(each.withColumnRenamed("n", "of"), "each")
    per = join_keyed(ids.select("vec", *class_), each, class_, total, "copies").groupBy("vec").agg(F.sum("of").alias("n_links"))
    out = rows.select("vec").join(per, "vec", "left").join(parts.withColumnRenamed("node", "vec"), "vec", "left")
    component = F.coalesce("component", "vec")
    return out.select(F.col("vec").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec") == component).alias("kept"))
