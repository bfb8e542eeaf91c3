"""Rows by a key that a large share of them may have."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.store import stored

#: A key is hot from so many rows on, and from a HOT_SHARE-th of all rows: at most HOT_SHARE keys are hot.
HOT_ROWS, HOT_SHARE = 100_000, 100_000
#: Rows are counted in at most so many bins (2 to this power) to find hot keys.
BIN_BITS = 20


def hot_from(total: int) -> int:
    """The number of rows from which a key is hot, of *total* rows."""
    return max(HOT_ROWS, total // HOT_SHARE)


def join_keyed(rows: DataFrame, table: DataFrame, keys: list[str], total: int, count: str) -> DataFrame:
    """Inner join of *rows* with *table*, which has each key once and in *count* how many rows hold it.

    Rows of hot keys stay where they are and meet a broadcast of the hot keys, at most HOT_SHARE of
    them whatever the input; the other rows are dealt by key, so no task gets more than its share.
    *total* is the sum of *count* or more. Both sides are read twice if there are hot keys, so they
    should be written tables. *table*'s columns should be narrow.
    """
    most = hot_from(total)
    hot = table.where(F.col(count) >= most)
    if hot.isEmpty():
        return rows.join(table, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(count) < most), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def split_hot(rows: DataFrame, key: str, total: int | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """*rows*, of a written table, without those of hot keys, these, written (None if there are none), and the number of all.

    The first bits of a hash of *key* count rows in bins of about HOT_ROWS; a bin with many more may
    hold a hot key and goes as a whole, so no key left has more than that. At most HOT_SHARE bins
    are broadcast.
    """
    total = rows.count() if total is None else total
    bits = min(BIN_BITS, (total // HOT_ROWS).bit_length())
    if not bits:
        return rows, None, total
    bin_ = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    counts = stored(rows.groupBy(bin_.alias("hot_bin")).agg(F.count("*").alias("n")), "bins")
    hot = counts.where(F.col("n") >= 2 * (total >> bits) + hot_from(total)).select("hot_bin")
    if hot.isEmpty():
        return rows, None, total
    marked = rows.withColumn("hot_bin", bin_)
    hot = F.broadcast(hot)
    return marked.join(hot, "hot_bin", "left_anti").drop("hot_bin"), stored(marked.join(hot, "hot_bin", "left_semi").drop("hot_bin"), "hot"), total


def several_places(rows: DataFrame, key: str, place: list[str], later: bool = False) -> DataFrame:
    """The rows of keys that stand at several places; with *later*, those not at the first one, which is ``lo``.

    *rows* is of a written table. Rows of ordinary keys are dealt by key once. Hot keys are
    aggregated before they are dealt, and their places joined back where the rows are.
    """
    cold, hot, total = split_hot(rows, key)
    at = F.struct(*place)
    if later:
        out = cold.withColumn("lo", F.first(at).over(Window.partitionBy(key).orderBy(*place)))
    else:
        w, mark = Window.partitionBy(key), F.xxhash64(*place)
        out = cold.withColumns({"lo": F.min(mark).over(w), "hi": F.max(mark).over(w)}).where("lo <> hi").drop("lo", "hi")
    if hot is not None:
        first = hot.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("rows_of_key"))
        first = stored(first.where("lo <> hi").drop("hi"), "first")
        many = join_keyed(hot, first, [key], total, "rows_of_key").drop("rows_of_key")
        out = out.unionByName(many if later else many.drop("lo"))
    return out.where(at != F.col("lo")) if later else out
