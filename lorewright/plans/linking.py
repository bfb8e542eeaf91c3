"""Queries of entity linking: suppliers against customers (register A) and parts (register B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.operators import linking as L
from lorewright.plans.registry import query, table

# A person's name is the number in the supplier's name; a record's name holds a number and perhaps style, dynasty or place.
_PEOPLE = """pe as (select s_name as person, lpad(cast(s_suppkey as varchar), 7, '0') as name, case when s_suppkey % 3 <> 0 then 'st' || (s_suppkey // 3) end as style, case when s_suppkey % 2 = 0 then 'hao' || (s_suppkey // 2) end as hao,
  'D' || (s_suppkey % 5) as dynasty, 'N' || s_nationkey as place from supplier)"""
_RECORDS = """re as (select 'A' as source, 'A' || c_custkey as external_id, lpad(cast(c_custkey // 10 as varchar), 7, '0') || case when c_custkey % 3 = 0 then ' st' || (c_custkey // 40) else '' end || ' D' || (c_custkey % 3) || case when c_custkey % 4 = 0 then ' N' || c_nationkey else '' end as cand from customer
  union all select 'B', 'B' || p_partkey, lpad(cast(p_partkey // 15 as varchar), 7, '0') || case when p_partkey // 15 % 4 = 0 then '' else ' W' end || case when p_partkey % 5 = 0 then ' hao' || (p_partkey // 50) else '' end from part)"""
_SCORED = f"""{_PEOPLE}, {_RECORDS}, sc as (select person, source, external_id, cand, least(10.0,
  case when cand = name then 4.0 when contains(cand, name) or contains(name, cand) then 2.0 else 0.0 end + case when contains(cand, style) then 4.0 else 0.0 end
  + case when hao is not null and contains(cand, hao) then 4.0 else 0.0 end
  + case when (case when contains(cand, 'D0') then 'D0' when contains(cand, 'D1') then 'D1' when contains(cand, 'D2') then 'D2' end) = dynasty then 1.0 else 0.0 end
  + case when contains(cand, place) then 1.0 else 0.0 end) as score
  from pe join re on list_contains(string_split(cand, ' '), name) or list_contains(string_split(cand, ' '), style) or list_contains(string_split(cand, ' '), hao))"""


def people(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("person"), F.lpad(k.cast("string"), 7, "0").alias("name"), F.when(k % 3 != 0, F.concat(F.lit("st"), F.expr("s_suppkey div 3"))).alias("style"), F.when(k % 2 == 0, F.concat(F.lit("hao"), F.expr("s_suppkey div 2"))).alias("hao"),
        F.concat(F.lit("D"), k % 5).alias("dynasty"), F.concat(F.lit("N"), "s_nationkey").alias("place"),
    )
    return rows.withColumn("keys", F.array("name", "style", "hao"))


def records(spark, sf_dir):
    def opt(cond, text, value):
        return F.when(cond, F.concat(F.lit(text), value)).otherwise(F.lit(""))

    def number(expr):
        return F.lpad(F.expr(expr).cast("string"), 7, "0")

    c, p = F.col("c_custkey"), F.col("p_partkey")
    name = F.concat(number("c_custkey div 10"), opt(c % 3 == 0, " st", F.expr("c_custkey div 40")), F.lit(" D"), c % 3, opt(c % 4 == 0, " N", F.col("c_nationkey")))
    a = table(spark, sf_dir, "customer").select(F.lit("A").alias("source"), F.concat(F.lit("A"), c).alias("external_id"), name.alias("cand"))
    b = table(spark, sf_dir, "part").select(F.lit("B").alias("source"), F.concat(F.lit("B"), p).alias("external_id"), F.concat(number("p_partkey div 15"), F.when(F.expr("p_partkey div 15 % 4") == 0, "").otherwise(" W"), opt(p % 5 == 0, " hao", F.expr("p_partkey div 50"))).alias("cand"))
    return a.unionByName(b).withColumn("keys", F.split("cand", " "))


def scored(spark, sf_dir):
    rows = L.candidates(people(spark, sf_dir), records(spark, sf_dir))
    s = L.score(*(F.col(x) for x in ("cand", "name", "style", "hao", "dynasty", "place")), dynasties=("D0", "D1", "D2"))
    return rows.withColumn("score", s)


@query(f"with {_SCORED} select person, source, count(*) as n from sc group by all")
def link_candidates(spark, sf_dir):
    return L.candidates(people(spark, sf_dir), records(spark, sf_dir)).groupBy("person", "source").agg(F.count("*").alias("n"))


@query(f"with {_SCORED} select person, external_id, cast(score as double) as score from sc")
def link_score(spark, sf_dir):
    return scored(spark, sf_dir).select("person", "external_id", "score")


_PERIOD_WORDS = ("明末清初", "康熙年", "元末", "萬曆", "清", "宋", "無", "明代元末", "乾隆御覽")
_PERIOD_CASE = " ".join(f"when dynasty = '{d}' and ({' or '.join(f"contains(cand, '{w}')" for w in words)}) then 2.0" for d, words in L.PERIODS.items())


@query(
    f"""with x as (select c_custkey as id, list_extract({list(_PERIOD_WORDS)!r}, 1 + c_custkey % {len(_PERIOD_WORDS)}) as cand, list_extract(['明', '清', '元', '宋'], 1 + c_custkey // 3 % 4) as dynasty from customer)
select id, cast(case {_PERIOD_CASE} else 0.0 end + case when (case """
    + " ".join(f"when contains(cand, '{d}') then '{d}'" for d in L.DYNASTIES)
    + """ end) = dynasty then 1.0 else 0.0 end as double) as score from x"""
)
def link_score_periods(spark, sf_dir):
    """What periods and dynasties add to a score."""
    c, none = F.col("c_custkey"), F.lit(None).cast("string")
    cand = F.element_at(F.array(*map(F.lit, _PERIOD_WORDS)), (1 + c % len(_PERIOD_WORDS)).cast("int"))
    dynasty = F.element_at(F.array(*map(F.lit, ("明", "清", "元", "宋"))), F.expr("cast(1 + c_custkey div 3 % 4 as int)"))
    return table(spark, sf_dir, "customer").select(c.alias("id"), L.score(cand, F.lit("某"), none, none, dynasty, none).alias("score"))


@query(f"with {_SCORED} select person, source, external_id, rank from (select *, cast(row_number() over (partition by person, source order by score desc, source, external_id) as integer) as rank from sc) where rank <= 3")
def link_ranking(spark, sf_dir):
    return L.ranked(scored(spark, sf_dir)).where("rank_in_source <= 3").select("person", "source", "external_id", F.col("rank_in_source").alias("rank"))


_BEST = """b as (select * from (select *, row_number() over (partition by person order by score desc, source, external_id) as n from sc) where n = 1),
li as (select person, case when score >= 3 then source end as source, case when score >= 3 then external_id end as external_id, cast(case when score >= 3 then score else 0 end as double) as score, score >= 3 as linked, score >= 3 and score >= 0.85 as auto_linked, not (score >= 3 and score >= 0.85) as needs_review from b)"""


@query(f"with {_SCORED}, {_BEST} select * from li")
def link_disambiguate(spark, sf_dir):
    return L.disambiguate(scored(spark, sf_dir))


_DETAILS = """de as (select 'A' as source, 'A' || c_custkey as external_id, 'xs' || c_custkey as ext_style, 'xh' || c_custkey as ext_hao, case when c_custkey % 2 = 0 then 'X' || c_nationkey end as ext_place, cast(1500 + c_custkey % 300 as bigint) as ext_year from customer)"""
_MERGED = f"""{_SCORED}, {_BEST}, {_DETAILS}, me as (select pe.person, coalesce(style, ext_style) as style, coalesce(hao, ext_hao) as hao, coalesce(ext_place, place) as place, ext_year as birth_year, li.source, li.external_id,
  coalesce(linked, false) as linked, coalesce(auto_linked, false) as auto_linked, coalesce(needs_review, true) as needs_review, coalesce(score, 0.0) as confidence
  from pe left join li on pe.person = li.person left join de on de.source = li.source and de.external_id = li.external_id)"""


def merged(spark, sf_dir):
    c = F.col("c_custkey")
    details = table(spark, sf_dir, "customer").select(
        F.lit("A").alias("source"), F.concat(F.lit("A"), c).alias("external_id"), F.concat(F.lit("xs"), c).alias("ext_style"), F.concat(F.lit("xh"), c).alias("ext_hao"),
        F.when(c % 2 == 0, F.concat(F.lit("X"), "c_nationkey")).alias("ext_place"), (1500 + c % 300).alias("ext_year"),
    )
    return L.merged(people(spark, sf_dir).drop("keys"), L.disambiguate(scored(spark, sf_dir)), details)


@query(f"with {_MERGED} select * from me")
def merge_external(spark, sf_dir):
    return merged(spark, sf_dir)


@query(
    f"""with {_MERGED} select person as s, 'birthYear' as p, cast(birth_year as varchar) as o from me where linked and birth_year is not null
union all select person, 'nativePlace', place from me where linked and place is not null union all select person, 'externalId', external_id from me where linked"""
)
def merge_backfill(spark, sf_dir):
    return L.backfill(merged(spark, sf_dir))


@query(
    f"""with {_MERGED} select count(*) as total, count(*) filter (where linked) as linked, count(*) filter (where auto_linked) as auto_linked, count(*) filter (where needs_review) as needs_review,
round(coalesce(avg(case when linked then confidence end), 0.0), 6) as avg_confidence from me"""
)
def merge_summary(spark, sf_dir):
    return L.summary(merged(spark, sf_dir))


@query(f"with {_MERGED} select person, confidence from me where needs_review")
def review_queue(spark, sf_dir):
    return merged(spark, sf_dir).where("needs_review").select("person", "confidence")


@query(
    """with x as (select page_id as id, unnest(regexp_extract_all(html, '<li[^>]*>.*?<a[^>]*href=["'']([^"'']+)["''][^>]*>([^<]+)</a>.*?</li>', 1, 's')) as href,
  unnest(regexp_extract_all(html, '<li[^>]*>.*?<a[^>]*href=["'']([^"'']+)["''][^>]*>([^<]+)</a>.*?</li>', 2, 's')) as title,
  unnest(range(1, len(regexp_extract_all(html, '<li[^>]*>.*?<a[^>]*href=["'']([^"'']+)["''][^>]*>([^<]+)</a>.*?</li>', 1, 's')) + 1)) as pos from pages),
k as (select id, trim(title) as name, case when starts_with(trim(href), '/') then 'https://example.org' || trim(href) when starts_with(trim(href), 'http') then trim(href) else 'https://example.org/' || trim(href) end as url,
  row_number() over (partition by id order by pos) as place from x where trim(title) <> '' and length(trim(title)) <= 50 and (contains(trim(title), 'th') or contains(trim(title), 't') or contains(trim(title), 'h')))
select id, name, url, place from k where place <= 10"""
)
def html_search_parse(spark, sf_dir):
    return L.search_results(table(spark, sf_dir, "pages"), "page_id", "html", "th")


@query(
    """select page_id as id, trim(regexp_extract(html, '<title>([^<]+)</title>', 1)) as name,
  substr(trim(regexp_replace(regexp_extract(html, '<div[^>]*class="(?:seg|ad)"[^>]*>(.*?)</div>', 1, 's'), '<[^>]+>', '', 'g')), 1, 200) as description from pages"""
)
def html_detail_parse(spark, sf_dir):
    return L.page_detail(table(spark, sf_dir, "pages"), "page_id", "html")
