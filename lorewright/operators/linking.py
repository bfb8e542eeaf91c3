"""Entity linking: candidates from two sources, scored, disambiguated and merged back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the score, its cap, and the limits of a choice.
EXACT, WITHIN, STYLE, HAO, PERIOD, DYNASTY, PLACE, CAP = 4.0, 2.0, 4.0, 4.0, 2.0, 1.0, 1.0, 10.0
SURE, LEAST, THRESHOLD = 6.0, 3.0, 0.85
# Dynasties in the order in which they are looked for.
DYNASTIES = ("明", "清", "元", "宋", "唐", "漢")
# Words of a dynasty's periods.
PERIODS = {
    "明": ["明代", "明初", "明中期", "明末", "明末清初", "嘉靖", "萬曆", "天啟", "崇禎"],
    "清": ["清代", "清初", "清中期", "清晚期", "康熙", "雍正", "乾隆", "光緒", "道光", "咸豐", "同治", "宣統"],
    "元": ["元代", "元末"],
}


def _held(part: Column, whole: Column) -> Column:
    """Whether a non-empty text is part of another; null counts as no."""
    p = F.trim(part)
    return F.coalesce((part != "") & F.contains(whole, p), F.lit(False))


def score(candidate: Column, name: Column, style: Column, hao: Column, dynasty: Column, place: Column, periods: dict[str, list[str]] = PERIODS, dynasties: tuple[str, ...] = DYNASTIES) -> Column:
    """The weighted agreement of a candidate's name with a person's attributes, at most CAP."""
    c, t = F.trim(candidate), F.trim(name)
    total = F.when(c == t, EXACT).when(F.contains(c, t) | F.contains(t, c), WITHIN).otherwise(0.0)
    total = total + F.when(_held(style, c), STYLE).otherwise(0.0) + F.when(_held(hao, c), HAO).otherwise(0.0)
    for d, words in periods.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        total = total + F.when((dynasty == d) & hit, PERIOD).otherwise(0.0)
    found = F.lit(None).cast("string")
    for d in reversed(dynasties):
        found = F.when(F.contains(c, F.lit(d)), d).otherwise(found)
    total = total + F.when(found == dynasty, DYNASTY).otherwise(0.0)
    total = total + F.when(_held(place, c), PLACE).otherwise(0.0)
    return F.least(total, F.lit(CAP))


def candidates(people: DataFrame, records: DataFrame, keys: str = "keys") -> DataFrame:
    """People joined with external records that share one of their *keys* (arrays of strings), one row per (person, source, external_id).

    Keys are what the score looks at: names, style and hao. An equi-join, so a person never meets
    the whole register; null and empty keys meet nothing.
    """
    a = people.withColumn("__key", F.explode(F.array_distinct(keys))).where("__key <> ''").drop(keys)
    b = records.withColumn("__key", F.explode(F.array_distinct(keys))).where("__key <> ''").drop(keys)
    return a.join(b, "__key").drop("__key").dropDuplicates(["person", "source", "external_id"])


def ranked(scored: DataFrame) -> DataFrame:
    """Adds rank (int) by score within (person, source) and over the person; ties by source and id."""
    order = [F.desc("score"), "source", "external_id"]
    return scored.withColumn("rank_in_source", F.row_number().over(Window.partitionBy("person", "source").orderBy(*order))).withColumn("rank", F.row_number().over(Window.partitionBy("person").orderBy(*order)))


def disambiguate(scored: DataFrame) -> DataFrame:
    """(person, source, external_id, score, linked, auto_linked, needs_review) for every person of *scored*.

    The best candidate is taken if its score is SURE, or at least LEAST; else the person stays
    unlinked. All rules choose the best of all candidates; they differ in what it must reach.
    """
    best = ranked(scored).where("rank = 1")
    linked = F.col("score") >= LEAST
    pick = [F.when(linked, F.col(c)).alias(c) for c in ("source", "external_id")]
    return best.select("person", *pick, F.when(linked, F.col("score")).otherwise(0.0).alias("score"), linked.alias("linked"), (linked & (F.col("score") >= THRESHOLD)).alias("auto_linked"), (~linked | (F.col("score") < THRESHOLD)).alias("needs_review"))


def merged(people: DataFrame, links: DataFrame, details: DataFrame) -> DataFrame:
    """People with their link and what the external record adds: its place first, style and hao where missing.

    details is (source, external_id, ext_style, ext_hao, ext_place, ext_year).
    """
    j = people.join(links, "person", "left").join(details, ["source", "external_id"], "left")
    return j.select(
        "person", F.coalesce("style", "ext_style").alias("style"), F.coalesce("hao", "ext_hao").alias("hao"), F.coalesce("ext_place", "place").alias("place"), F.col("ext_year").alias("birth_year"),
        "source", "external_id", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("auto_linked", F.lit(False)).alias("auto_linked"),
        F.coalesce("needs_review", F.lit(True)).alias("needs_review"), F.coalesce("score", F.lit(0.0)).alias("confidence"),
    )


def backfill(rows: DataFrame) -> DataFrame:
    """The triples that merged rows add."""
    facts = F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in (("birthYear", "birth_year"), ("nativePlace", "place"), ("externalId", "external_id"))))
    return rows.where("linked").select(F.col("person").alias("s"), F.explode(facts).alias("x")).select("s", "x.p", "x.o").where("o is not null")


def summary(rows: DataFrame) -> DataFrame:
    """One row: total, linked, auto-linked, in review, and the mean confidence of the linked (0 if none)."""
    mean = F.round(F.coalesce(F.avg(F.when(F.col("linked"), F.col("confidence"))), F.lit(0.0)), 6)
    return rows.agg(F.count("*").alias("total"), F.count_if("linked").alias("linked"), F.count_if("auto_linked").alias("auto_linked"), F.count_if("needs_review").alias("needs_review"), mean.alias("avg_confidence"))


def search_results(pages: DataFrame, id: str, html: str, wanted: str, base: str = "https://example.org", limit: int = 10) -> DataFrame:
    """(id, name, url, place long): list entries with a link whose title holds *wanted* or any of its characters."""
    pattern = r"(?s)<li[^>]*>.*?<a[^>]*href=[\"']([^\"']+)[\"'][^>]*>([^<]+)</a>.*?</li>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("title"))
    rows = pages.select(F.col(id).alias("id"), F.posexplode(pairs).alias("pos", "x"))
    title, href = F.trim("x.title"), F.trim("x.href")
    hit = F.contains(title, F.lit(wanted))
    for c in dict.fromkeys(wanted):
        hit = hit | F.contains(title, F.lit(c))
    url = F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href)).when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(base + "/"), href))
    rows = rows.where((title != "") & (F.length(title) <= 50) & hit).select("id", title.alias("name"), url.alias("url"), "pos")
    place = F.row_number().over(Window.partitionBy("id").orderBy("pos")).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= limit).drop("pos")


def page_detail(pages: DataFrame, id: str, html: str) -> DataFrame:
    """(id, name, description): the title, and the first 200 characters of the segment's text."""
    seg = F.regexp_extract(html, r"(?s)<div[^>]*class=\"(?:seg|ad)\"[^>]*>(.*?)</div>", 1)
    return pages.select(F.col(id).alias("id"), F.trim(F.regexp_extract(html, "<title>([^<]+)</title>", 1)).alias("name"), F.substring(F.trim(F.regexp_replace(seg, "<[^>]+>", "")), 1, 200).alias("description"))
