"""Operator 1: URL filter by a blocked Bloom filter and an exact hash join.

A rule is a host and a path prefix; it fits the host and all its subdomains. The rules' canonical
strings (host and path) are hashed into a blocked Bloom filter: one block of 256 bits per string,
chosen by the hash, and eight bits in it. A URL asks for every string a fitting rule could have
(its host's suffixes at dots, with the starts of its path in the lengths that rules have). Strings
the filter lets through go into a hash join with the rules, which removes false positives; the
longest rule left gives the verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.store import stored

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BITS_PER_RULE = 16
LANES = 8
#: A filter of at most so many blocks (of 32 bytes) is broadcast; a larger one is joined by block.
BROADCAST_BLOCKS = 1 << 20
#: URLs that at least HOT_ROWS and one in HOT_URLS rows with a rule have are broadcast with their verdicts: at most HOT_URLS of HOT_CHARS each.
HOT_ROWS, HOT_URLS, HOT_CHARS = 100_000, 10_000, 2048


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_of(url: F.Column) -> F.Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: F.Column, most: int) -> F.Column:
    """The host and its parents at dots, as far as they have at most *most* labels: a.b.c, b.c, c; none for an empty host."""
    labels = F.slice(F.split(host, r"\."), -most, most) if most > 0 else F.array().cast("array<string>")
    labels = F.when(F.size(F.split(host, r"\.")) > most, labels).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(parts)


def _lanes(h: F.Column) -> F.Column:
    """Four 64-bit words, each with the two bits that 6 bits each of a hash choose."""

    def bit(lane: int) -> F.Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * lane).bitwiseAND(F.lit(63)).cast("int"))

    return F.array(*(bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(LANES // 2)))


def bloom(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(block, words) of a blocked Bloom filter over the column ``key``, and its number of blocks."""
    blocks = max(1, -(-count * BITS_PER_RULE // 256))
    h = F.xxhash64("key")
    t = keys.select(F.pmod(F.xxhash64(F.lit(7), F.col("key")), F.lit(blocks)).alias("block"), _lanes(h).alias("w"))
    t = t.groupBy("block").agg(*(F.bit_or(F.col("w")[i]).alias(f"w{i}") for i in range(4)))
    return t.select("block", F.array("w0", "w1", "w2", "w3").alias("words")), blocks


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: *carry*, url, host, path, rule string, verdict string.

    *rules* has verdict, host, path. Of two rules alike in host and path, block wins. A URL without
    a fitting rule is allowed, its rule null; so is every URL without rules. Null URLs, and those
    without ``://``, have an empty host and path. Repeated rows stay; an empty table gives an empty
    result. Each distinct URL is judged once and the verdict joined back; rows of URLs that very many
    rows have stay where they are for that.
    """
    rules = rules.groupBy(F.concat("host", "path").alias("rule"), F.length("path").alias("n")).agg(F.max("verdict").alias("rule_verdict"), F.max(F.size(F.split("host", r"\."))).alias("labels"))
    count, most, labels = rules.agg(F.count("*"), F.sort_array(F.collect_set("n")), F.max("labels")).first()
    base = pages.select(*(F.col(c) for c in carry), F.col(url).alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not count:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    urls = base.where("host <> ''").groupBy("url", "host", "path").agg(F.count("*").alias("rows"))
    lengths = F.filter(F.array(*map(F.lit, most)), lambda n: n <= F.length("path"))
    asked = urls.select("url", "path", "rows", F.explode(suffixes(F.col("host"), labels)).alias("suffix"))
    asked = asked.select("url", "suffix", "path", "rows", F.explode(lengths).alias("n"))
    asked = asked.select("url", "n", "rows", F.concat("suffix", F.expr("substring(path, 1, n)")).alias("key"))

    table, blocks = bloom(rules.select(F.col("rule").alias("key")), count)
    table = F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(7), F.col("key")), F.lit(blocks)))
    want = _lanes(F.xxhash64("key"))
    passed = asked.join(table, "block")
    for i in range(4):
        passed = passed.where(F.col("words")[i].bitwiseAND(want[i]) == want[i])
    fits = passed.join(rules, (F.col("key") == F.col("rule")) & (passed["n"] == rules["n"]))
    verdicts = fits.groupBy("url").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "rule")).alias("best"), F.max("rows").alias("rows"))
    verdicts = stored(verdicts.toDF("judged", "best", "rows"), "verdicts")
    total = verdicts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = verdicts.where((F.col("rows") >= max(HOT_ROWS, total // HOT_URLS)) & (F.length("judged") <= HOT_CHARS))
    same = F.col("url") == F.col("judged")
    if hot.isEmpty():
        out = base.join(verdicts.hint("merge"), same, "left")
    else:
        rest = base.join(F.broadcast(hot.select("judged")), same, "left_anti")
        out = base.join(F.broadcast(hot), same).unionByName(rest.join(verdicts.hint("merge"), same, "left"))
    return out.select(*carry, "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict"))
