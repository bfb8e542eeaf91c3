"""Operator 3: exact n-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles. Two sets of n and m shingles with a
Jaccard index of at least 0.8 differ in at most (n + m) // 9 shingles. A parity sketch toggles
one bit per shingle; a differing shingle changes at most one bit, so the Hamming distance of two
sketches never exceeds the symmetric difference and a larger distance rules a pair out.

Pigeonhole: within a size band the shingles fall into more blocks than may differ, so two linked
documents agree in the parity of a whole block. A block's key is the XOR of 64-bit hashes of its
shingles, that is, a digest of its slice of a parity sketch far too wide to write out. Bands grow
by half; a document also joins the next band if a partner can be there.

1. Documents with the same set are one class (pre-aggregated hash, smallest doc_id stands for it).
2. Block keys of each class are dealt out; a bucket pairs every member with its smallest member.
   Pairs pass the size and Hamming bounds, then exact Jaccard on the whole texts. Links join
   components.
3. A bucket whose members are still in several components is searched again by the Hamming bound,
   and members with a possible partner in another component are verified exactly. Both are done in
   units of two blocks of bounded size; the largest component of a bucket is not held against
   itself. So no link between two components is lost, and a group whose members all link to one of
   them costs one verification per member.

Keys that very many documents have are aggregated before they are dealt; a member with very many
partners meets them in several units.

A block is empty with small probability; a document with too few filled blocks for the pigeonhole
adds prefix keys (its n - ceil(0.8 n) + 1 smallest shingle hashes), which two such documents share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.components import components, settle
from lorewright.llm.skew import join_keyed, split_hot
from lorewright.llm.texts import U, constants, groups, mix, shingle_sets
from lorewright.store import small_batches, stored

#: Members of a bucket in a block, and bits of their sketches; members and shingles in a block of texts.
BLOCK, BLOCK_BITS = 2048, 1 << 28
TEXT_BLOCK, TEXT_SHINGLES = 256, 1 << 22
#: Partners of one document verified in a unit.
PARTNERS = 512
#: At most so many ids (8 bytes each) are broadcast.
BROADCAST_IDS = 2_000_000
_SEED = constants(64, 101)
_BAND_BITS = 6


def _bands() -> list[int]:
    """First size of each band; sizes of 3 or less only link with equal sets."""
    out = [4]
    while len(out) < 60:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


BANDS = _bands()


def band_of(n: int) -> int:
    return int(np.searchsorted(BANDS, n, "right")) - 1


def block_keys(s: np.ndarray, band: int) -> np.ndarray:
    """The keys of a set's filled blocks in a band, and prefix keys where blocks are too few."""
    n, most = len(s), BANDS[band + 1] - 1
    differ = 2 * most // 9
    blocks = (differ + 1) * 106 // 100 + 2
    h = mix(s ^ _SEED[band])
    block = ((h >> U(32)) * U(blocks)) >> U(32)
    order = np.argsort(block, kind="stable")
    block, h = block[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    slices = np.bitwise_xor.reduceat(mix(h), first)
    keys = mix(slices + block[first] * U(0x9E3779B97F4A7C15))
    if len(first) <= min(differ, (n + min(most, n * 5 // 4)) // 9):
        prefix = np.sort(h)[: n - (4 * n + 4) // 5 + 1]
        keys = np.concatenate((keys, mix(prefix ^ U(0x5851F42D4C957F2D))))
    low = U((1 << _BAND_BITS) - 1)
    return (keys & ~low) | U(band)


def sketch(s: np.ndarray, band: int) -> bytes:
    """The parity sketch: one bit per shingle of the band's largest set, in whole 64-bit words."""
    words = (BANDS[band + 1] + 62) // 64
    h = mix(s + _SEED[band])
    bit = ((h >> U(32)) * U(words * 64)) >> U(32)
    odd = np.bincount(bit.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, h1, h2 = [], [], []
        for s in shingle_sets(b.column(1)):
            n.append(len(s))
            h1.append(mix(s).sum(dtype=U) if len(s) else U(0))
            h2.append(np.bitwise_xor.reduce(mix(s + U(77))) if len(s) else U(0))
        yield pa.record_batch(
            [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, U).view(np.int64)), pa.array(np.array(h2, U).view(np.int64))],
            names=["doc_id", "n", "h1", "h2"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, band, size, bits, keys = [], [], [], [], []
        for d, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
            n = len(s)
            if n < BANDS[0]:
                continue
            own = band_of(n)
            for k in (own, own + 1):
                if k > own and n * 5 < BANDS[k] * 4:
                    continue
                doc.append(d)
                band.append(k)
                size.append(n)
                bits.append(sketch(s, k))
                keys.append(block_keys(s, k).view(np.int64))
            if len(doc) >= 500:
                yield _key_batch(doc, band, size, bits, keys)
                doc, band, size, bits, keys = [], [], [], [], []
        if doc:
            yield _key_batch(doc, band, size, bits, keys)


def _key_batch(doc: list, band: list, size: list, bits: list, keys: list) -> pa.RecordBatch:
    at = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
    return pa.record_batch(
        [pa.array(doc, pa.int64()), pa.array(band, pa.int32()), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys)))],
        names=["doc", "band", "n", "bits", "keys"],
    )


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc) by key: those of keys with several documents, with the smallest and their number."""

    def several(key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch | None:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(first, len(key)))
        many = np.repeat(n > 1, n)
        if not many.any():
            return None
        key, doc = key[many], doc[many]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        key, doc = key[fresh], doc[fresh]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(first, len(key)))
        rows = pa.record_batch([pa.array(key), pa.array(doc), pa.array(np.repeat(doc[first], n)), pa.array(np.repeat(n, n))], names=["key", "doc", "low", "members"])
        return rows.filter(pa.array(np.repeat(n > 1, n)))

    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None
    for b in batches:
        key, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(key):
            continue
        # The last key may go on in the next batch.
        cut = int(np.searchsorted(key, key[-1]))
        if cut or last != key[-1]:
            done = [*held, (key[:cut], doc[:cut])]
            held = []
            if out := several(*(np.concatenate(x) for x in zip(*done, strict=True))):
                yield out
        last = key[-1]
        held.append((key[cut:], doc[cut:]))
    if held and (out := several(*(np.concatenate(x) for x in zip(*held, strict=True)))):
        yield out


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 80 * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that pass the Hamming bound of their sketches."""
    for b in batches:
        n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
        keep = np.zeros(len(n), dtype=bool)
        for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
            differ = np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum(dtype=np.int64)
            keep[i] = differ * 9 <= n[i] + m[i]
        yield b.select([0, 1]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (b, s, kind, a, text) by unit (b, s), the texts of b (kind 0) first: the (a, b) of texts that link with one of them."""
    last, held = None, []
    for batch in batches:
        units = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        kinds, keep = batch.column(2).to_pylist(), []
        for unit, kind, x in zip(units, kinds, shingle_sets(batch.column(4)), strict=True):
            if unit != last:
                last, held = unit, []
            if not kind:
                held.append(x)
            keep.append(kind == 1 and any(_linked(x, y) for y in held))
        found = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.record_batch([found.column(3), found.column(0)], names=["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket (key, i, j), members with a possible partner in another component.

    Columns: key, i, j, part, doc, component, n, bits. Rows of part i are held against part j.
    """
    for t in groups(batches, 3):
        part, i, j = t["part"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
        doc, comp, n = t["doc"].to_numpy(), t["component"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(doc), -1)
        mine, other = np.flatnonzero(part == i), np.flatnonzero(part == j)
        other = other[np.argsort(n[other], kind="stable")]
        hit = np.zeros(len(doc), dtype=bool)
        for x in mine.tolist():
            lo, hi = np.searchsorted(n[other], [-(-n[x] * 4 // 5), n[x] * 5 // 4 + 1])
            y = other[lo:hi]
            y = y[comp[y] != comp[x]]
            if len(y):
                far = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
                y = y[far * 9 <= n[y] + n[x]]
                if len(y):
                    hit[x] = True
                    hit[y] = True
        if hit.any():
            yield pa.record_batch([t["key"].combine_chunks().filter(pa.array(hit)), pa.array(doc[hit]), pa.array(comp[hit])], names=["key", "doc", "component"])


def _common(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each of *x* with each of *y* (None: with each other of *x*), as products of incidence matrices."""
    sets = x + (y or [])
    all_, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    _, at, n = np.unique(all_, return_inverse=True, return_counts=True)
    # What stands in one set only is in no intersection.
    column = np.cumsum(n > 1) - 1
    use = n[at] > 1
    own, at = own[use], column[at[use]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    out = np.zeros((len(x), len(y or x)))
    width = max(256, (1 << 21) // len(sets))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, z = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[own[a:z], at[a:z] - lo] = 1
        out += m[: len(x)] @ (m[len(x) :] if y else m).T
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links across components of the units (key, i, j, part, doc, component, text): each linked document with the smallest it leads to."""
    for t in groups(batches, 3):
        part, i, j = t["part"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
        doc, comp = t["doc"].to_numpy(), t["component"].to_numpy()
        order = np.argsort(doc, kind="stable")
        doc, comp, part = doc[order], comp[order], part[order]
        sets = list(shingle_sets(t["text"].combine_chunks()))
        sets = [sets[x] for x in order.tolist()]
        mine, other = np.flatnonzero(part == i), np.flatnonzero(part == j)
        if not len(mine) or not len(other):
            continue
        n = np.array([len(x) for x in sets])
        p, q = n[mine][:, None], n[other][None, :]
        may = (comp[mine][:, None] != comp[other][None, :]) & (5 * np.minimum(p, q) >= 4 * np.maximum(p, q))
        if i == j:
            may = np.triu(may)
        a, b = np.nonzero(may)
        if len(a) > len(doc):
            both = _common([sets[x] for x in mine], [sets[x] for x in other] if i != j else None)[a, b]
            ok = 100 * both >= 80 * (n[mine[a]] + n[other[b]] - both)
        else:
            ok = np.array([_linked(sets[mine[x]], sets[other[y]]) for x, y in zip(a, b, strict=True)], bool)
        a, b, root = mine[a[ok]], other[b[ok]], np.arange(len(doc))
        settle(root, a, b)
        hit = np.flatnonzero(root != np.arange(len(doc)))
        yield pa.record_batch([pa.array(doc[hit]), pa.array(doc[root[hit]])], names=["a", "b"])


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row of *docs*: doc_id, n_shingles long, component_id long.

    *id* is a long column. Null text and text without words have an empty set, link with nothing
    and are their own component. A repeated id is one document with several texts: its links are
    those of any of them. A null id takes no part; its component is null. Other columns of *docs*
    don't matter. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    pair = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sigs = stored(pair.mapInArrow(_signature, "doc_id long, n long, h1 long, h2 long"), "sigs")
    known = sigs.where("n > 0 and doc_id is not null")
    classes = stored(known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    same = join_keyed(known, classes.where("copies > 1"), ["n", "h1", "h2"], sigs.count(), "copies").where("doc_id <> rep")
    same = stored(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "same")
    # Copies go; an id with several texts stays if one of them stands for a class.
    copies = same.select(F.col("a").alias("doc_id")).distinct().join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    copies = stored(copies, "copies")
    few = copies.count() <= BROADCAST_IDS

    texts = pair.where("doc_id is not null").join(copies.hint("broadcast" if few else "shuffle_hash"), "doc_id", "left_anti")
    table = stored(texts.mapInArrow(_keys, "doc long, band int, n int, bits binary, keys array<bigint>"), "keys")
    total = table.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    cold, hot, _ = split_hot(table.select(F.explode("keys").alias("key"), "doc"), "key", total)
    bucket = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets, "key long, doc long, low long, members long")
    if hot is not None:
        hot = hot.distinct()
        low = stored(hot.groupBy("key").agg(F.min("doc").alias("low"), F.count("*").alias("members")).where("members > 1"), "hot")
        bucket = bucket.unionByName(join_keyed(hot, low, ["key"], total, "members"))
    bucket = stored(bucket, "buckets")
    band = F.expr(f"cast(key & {(1 << _BAND_BITS) - 1} as int)")
    stars = bucket.where("doc <> low").select(F.col("doc").alias("a"), F.col("low").alias("b"), band.alias("band")).distinct()
    of = table.select("doc", "band", "n", "bits")
    stars = stars.join(of.toDF("a", "band", "n", "bits"), ["a", "band"]).join(of.toDF("b", "band", "m", "bots"), ["b", "band"])
    stars = stars.where("5 * least(n, m) >= 4 * greatest(n, m)").select("a", "b", "n", "m", "bits", "bots")
    stars = stored(stars.mapInArrow(_possible, "a long, b long").distinct(), "stars")
    first = stored(_exact(stars, pair), "links")

    links = same.unionByName(first)
    parts = stored(components(links), "parts")
    # Buckets of two are settled by their one pair.
    open_ = bucket.where("members > 2").join(parts.toDF("doc", "component"), "doc", "left")
    open_ = stored(open_.select("key", "doc", F.coalesce("component", "doc").alias("component")), "open")
    units = _units(open_, BLOCK, BLOCK_BITS).withColumn("band", band).join(of, ["doc", "band"])
    units = units.select("key", "i", "j", "part", "doc", "component", "n", "bits").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    close = stored(units.mapInArrow(_near, "key long, doc long, component long").distinct(), "close")
    if not close.isEmpty():
        texts = _some(pair, close.select(F.col("doc").alias("doc_id")).distinct()).toDF("doc", "text")
        units = _units(close, TEXT_BLOCK, TEXT_SHINGLES).join(texts, "doc")
        units = units.select("key", "i", "j", "part", "doc", "component", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        second = stored(units.mapInArrow(_joined, "a long, b long").distinct(), "links")
        parts = stored(components(links.unionByName(second)), "parts")

    out = sigs.select("doc_id", F.col("n").alias("n_shingles")).join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _units(rows: DataFrame, block: int, size: int) -> DataFrame:
    """(key, doc, component, part, i, j): *rows* (key, doc, component), written, of keys with several components, in units of two blocks.

    Blocks have about *block* members, or fewer where a band's sets are so large that they would
    hold more than *size* shingles. Part i is to be held against part j; the parts of a key's largest
    component come last and meet the others only. Of keys with the same members one is taken.
    """
    total = rows.count()
    marks = ("mark0", "mark1")
    per = rows.groupBy("key", "component").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(m), "doc")).alias(m) for m in marks))
    most = per.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("members"), F.count("*").alias("components"), *(F.bit_xor(m).alias(m) for m in marks))
    most = most.where("components > 1").groupBy("members", *marks).agg(F.min(F.struct("key", "m")).alias("one"))
    most = most.select("one.key", "members", F.col("one.m.component").alias("major"), F.col("one.m.n").alias("d"))
    rows = join_keyed(rows, stored(most, "mixed"), ["key"], total, "members")
    band = F.expr(f"cast(key & {(1 << _BAND_BITS) - 1} as int)")
    limit = F.element_at(F.array(*(F.lit(max(4, min(block, size // b))) for b in [*BANDS[1:], 4 * BANDS[-1]])), band + 1)
    rb, db = F.ceil((F.col("members") - F.col("d")) / limit).cast("int"), F.ceil(F.col("d") / limit).cast("int")
    rows = rows.withColumns({"rb": rb, "db": db, "is_major": F.col("component") == F.col("major")})
    h = F.xxhash64("doc")
    rows = rows.withColumn("part", F.when(F.col("is_major"), F.col("rb") + F.pmod(h, "db")).otherwise(F.pmod(h, "rb")).cast("int"))
    rows = rows.withColumn("against", F.explode(F.sequence(F.lit(0), F.when(F.col("is_major"), F.col("rb")).otherwise(F.col("rb") + F.col("db")) - 1)))
    return rows.select("key", "doc", "component", "part", F.least("part", "against").alias("i"), F.greatest("part", "against").alias("j"))


def _exact(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, whose texts link. A b with many partners meets them in several units, each with its text once."""
    texts = _some(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    hubs = stored(pairs.groupBy("b").agg(F.count("*").alias("partners")), "hubs").withColumn("cuts", F.ceil(F.col("partners") / PARTNERS).cast("int"))
    members = join_keyed(pairs, hubs, ["b"], pairs.count(), "partners").withColumn("s", F.pmod(F.xxhash64("a"), "cuts").cast("int"))
    members = members.join(texts.toDF("a", "text"), "a").select("b", "s", F.lit(1).alias("kind"), "a", "text")
    hubs = hubs.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).join(texts.toDF("b", "text"), "b")
    rows = members.unionByName(hubs.select("b", "s", F.lit(0).alias("kind"), F.col("b").alias("a"), "text"))
    return rows.repartition("b", "s").sortWithinPartitions("b", "s", "kind").mapInArrow(_verified, "a long, b long").distinct()


def _some(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of *ids*, written. Ids go to every task only if they are few; else both sides are dealt."""
    ids = stored(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    return stored(texts.join(ids.hint("broadcast" if few else "shuffle_hash"), "doc_id", "left_semi"), "texts")
