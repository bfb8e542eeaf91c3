"""Operator 7: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws u in (0, 1) from a hash of its id and has the key u ** (1 / w) for its quality
weight w; larger keys come first. A source takes all its documents for every whole time that its
size goes into its target (complete epochs), and for the rest the documents in key order up to the
budget; the document at the edge gives just the words that are missing.

No source is ever ordered in one task: two histograms over the keys, of 4096 bins each, find the
narrow bin in which the budget runs out, and only that bin's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.store import stored

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
_BITS = 12
#: At most so many sources are broadcast.
BROADCAST_SOURCES = 200_000


def words(text: F.Column) -> F.Column:
    """The number of runs of characters other than space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: F.Column, size: F.Column) -> F.Column:
    """2 for at least 50 words of 3 to 10 characters on average, 0.5 for fewer than 10 words, else 1.

    The limits are those of published rules for web text; a blank per word counts as its own.
    """
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when((size >= 50) & n.between(size * 4, size * 11), 2.0).when(size < 10, 0.5).otherwise(1.0)


def draw(id: F.Column) -> F.Column:
    """A number in (0, 1) with 52 bits from the id's MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) with its weight and target.

    Sources by code point, null last, take *weights* in turn; *share* of all sizes is dealt by
    weight, and what goes beyond *cap* times a source's size is dealt again until none is above:
    the level is the first that the source next in order of size by weight can hold. Two windows
    over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("double"))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    rows = rows.withColumn("most", F.col("source_size") * F.lit(cap))
    rows = rows.withColumn("left", F.sum("source_size").over(every) * F.lit(share) - (F.sum("most").over(by) - F.col("most")))
    rows = rows.withColumn("level", F.col("left") / (F.sum("weight").over(every) - (F.sum("weight").over(by) - F.col("weight"))))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    rows = rows.withColumn("place", F.row_number().over(by))
    level = F.min(F.when(fits, F.struct("place", "level"))).over(every)["level"]
    rows = rows.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most"))))
    return rows.select("source", "source_size", "weight", "target")


def plan(docs: DataFrame, **rule) -> DataFrame:
    """Per source: size, target, whole epochs, words left for the next, and the edge of the selection.

    *docs* has source, size long, k double (1 - key) and id long. The edge is the first
    (k, id, size) that the words left don't hold, and edge_words what it gives; equal rows share it.
    """
    d = stored(docs.select("source", "size", "k", "id", F.floor(F.col("k") * float(1 << 2 * _BITS)).alias("bin")), "mix")
    d = d.withColumn("hi", F.shiftright("bin", _BITS))
    sums = stored(d.groupBy("source", "hi").agg(F.sum("size").alias("n")), "histogram")
    t = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), **rule)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    t = stored(t.withColumn("left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "targets")

    def crossing(hist: DataFrame, key: str, budget: DataFrame) -> DataFrame:
        """The bin of each source in which its budget ends, and what is left there."""
        w = Window.partitionBy("source").orderBy(key)
        run = hist.withColumn("before", F.sum("n").over(w) - F.col("n")).toDF("s", key, "n", "before")
        j = run.join(budget.toDF("b", "due"), F.col("s").eqNullSafe(F.col("b")))
        return j.where("before <= due and due < before + n").select("s", F.col(key).alias("at"), (F.col("due") - F.col("before")).alias("due"))

    hi = crossing(sums.select("source", "hi", "n"), "hi", t.select("source", "left"))
    inner = d.join(hi, F.col("source").eqNullSafe(F.col("s")) & (F.col("hi") == F.col("at")))
    inner = stored(inner.select("source", "size", "k", "id", "bin", "due"), "bin")
    lo = crossing(inner.groupBy("source", "bin").agg(F.sum("size").alias("n")), "bin", inner.groupBy("source").agg(F.first("due").alias("due")))
    last = inner.drop("due").join(lo, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("at")))
    ties = last.groupBy("source", "k", "id", "size", F.col("due").alias("left")).agg(F.count("*").alias("ties"))
    w = Window.partitionBy("source").orderBy("k", "id", "size")
    ties = ties.withColumn("before", F.sum(F.col("size") * F.col("ties")).over(w) - F.col("size") * F.col("ties"))
    edge = ties.where("before <= left and left < before + size * ties")
    edge = edge.select(F.col("source").alias("s"), F.col("k").alias("edge_k"), F.col("id").alias("edge_id"), F.col("size").alias("edge_size"), F.expr("(left - before) div ties").alias("edge_words"))
    return stored(t.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "plan")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", quality: F.Column | None = None, carry: tuple[str, ...] = (), **rule) -> DataFrame:
    """Per row: doc_id, size long, source_size long, target double, taken long, and *carry*.

    *quality* is a positive weight, 1 for null or other values; by default quality_weight of the text. Null text has size 0
    and gives nothing. Null sources are one source, the last. A null id counts as the largest.
    Equal keys are ordered by id, then size; repeated rows share an edge evenly. An empty table
    gives an empty result. taken is at most 2 times the size, and a source's taken words differ
    from its target by less than a word, or by less than the number of rows that share an edge.
    """
    size = words(F.col(text))
    w = None if quality is None else F.when(quality > 0, quality.cast("double")).otherwise(1.0)

    def keyed(*kept: F.Column) -> DataFrame:
        text_or_weight = F.col(text) if quality is None else w
        rows = docs.select(*kept, F.col(source).alias("source"), size.alias("size"), F.col(id).cast("long").alias("own"), text_or_weight.alias("of"))
        weight = quality_weight(F.col("of"), F.col("size")) if quality is None else F.col("of")
        k = (1.0 - F.pow(draw(F.col("own")), 1.0 / weight)).alias("k")
        return rows.select(*(c for c in ["row"] if kept), "source", "size", k, F.coalesce("own", F.lit((1 << 63) - 1)).alias("id"))

    rows = keyed(F.struct(F.col(id).alias("doc_id"), *(F.col(c) for c in carry)).alias("row"))
    # Narrow rows are written, so words are counted once; with carried columns, which can be texts, they are counted again.
    rows = rows if carry else stored(rows, "keyed")
    p = plan(keyed() if carry else rows.drop("row"), **rule).withColumnRenamed("source", "mix_source")
    # One row per source: broadcast, as long as there are few; the texts then stay where they are.
    j = rows.join(F.broadcast(p) if p.count() <= BROADCAST_SOURCES else p, F.col("source").eqNullSafe(F.col("mix_source")))
    at, edge = F.struct("k", "id", "size"), F.struct("edge_k", "edge_id", "edge_size")
    part = F.when(F.col("edge_k").isNull(), 0).when(at < edge, F.col("size")).when(at == edge, F.col("edge_words")).otherwise(0)
    return j.select("row.doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *(f"row.{c}" for c in carry))
