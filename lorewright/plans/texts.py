"""Queries on text: entries, entities, relations, normal forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.operators import build, entries, ner, normalize, relations
from lorewright.operators.knowledge import first_by_key
from lorewright.plans.registry import query, table

_LINES = "ln as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from documents where text is not null)"


@query(
    f"""with {_LINES}, m as (select *, regexp_full_match(line, '\\S+') as ch, regexp_full_match(line, '\\S+ \\S+') as ti from ln),
w as (select *, sum(case when ch or ti then 1 else 0 end) over o as part, last_value(case when ch then line end ignore nulls) over o as c0, last_value(case when not ch and ti then trim(line) end ignore nulls) over o as t0
  from m window o as (partition by doc_id order by pos rows between unbounded preceding and current row)),
g as (select doc_id, part, coalesce(c0, 'front') as chapter, coalesce(t0, 'opening') as title, trim(string_agg(trim(line), '' order by pos)) as content from w where not ch and not ti group by all)
select doc_id as file, cast(row_number() over (partition by doc_id order by part) - 1 as bigint) as section_idx, chapter, title, content from g where content <> ''"""
)
def entry_split(spark, sf_dir):
    """Lines of one word are chapters, lines of two are titles."""
    return entries.split_entries(table(spark, sf_dir, "documents"), "doc_id", "text", r"^(\S+)$", r"^(\S+ \S+)$", ("front", "opening"))


@query("select doc_id, sentence, count(*) as n from (select doc_id, trim(unnest(regexp_extract_all(replace(text, chr(10), ' '), '[^.!?]+[.!?]*|[.!?]+'))) as sentence from documents) where sentence <> '' group by all")
def sentence_split(spark, sf_dir):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    runs = F.filter(F.transform(F.regexp_extract_all(flat, F.lit(r"[^.!?]+[.!?]*|[.!?]+"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(runs).alias("sentence")).groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


@query("select doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) as text from documents")
def whitespace_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query("select doc_id, translate(text, 'äöüßéèê', 'aousEEE') as text from documents")
def variant_translate(spark, sf_dir):
    pairs = dict(zip("äöüßéèê", "aousEEE", strict=True))
    return table(spark, sf_dir, "documents").select("doc_id", T.variants(F.col("text"), pairs).alias("text"))


@query("select page_id, replace(html, '--', '##') as html from pages")
def punctuation_map(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_punctuation(F.replace("html", F.lit("--"), F.lit("──"))).alias("html")).withColumn("html", F.replace("html", F.lit("——"), F.lit("##")))


_PERIODS = ["that", "which", "from", "nicht", "avec", "para", "that"]


@query("select doc_id, array_to_string(list_filter(['that', 'which', 'from', 'nicht', 'avec', 'para'], lambda p: contains(text, p)), ',') as periods from documents")
def period_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.present(F.col("text"), _PERIODS), ",").alias("periods"))


@query("select doc_id, i as start, substr(text, greatest(i - 20, 0) + 1, least(i + 24, length(text)) - greatest(i - 20, 0)) as evidence from (select doc_id, text, strpos(text, 'that') - 1 as i from documents) where i >= 0")
def evidence_window(spark, sf_dir):
    at = F.instr("text", F.lit("that")).cast("long") - 1
    rows = table(spark, sf_dir, "documents").withColumn("start", at).where("start >= 0")
    return rows.select("doc_id", "start", T.window(F.col("text"), F.col("start"), F.col("start") + 4).alias("evidence"))


@query("select doc_id, text from documents where contains(text, 'Released under') order by doc_id limit 1")
def entry_lookup(spark, sf_dir):
    """The first entry that holds a phrase."""
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("Released under"))).select("doc_id", "text").orderBy("doc_id").limit(1)


# Dictionary: the long words of the benchmark texts, with a type by their first letter.
_DICT = """dc as (select word, case when word < 'i' then 'PERSON' when word < 'q' then 'PLACE' else 'SCHOOL' end as etype
  from (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) as word from benchmark))"""


def dictionary(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("word")).distinct()
    return words.withColumn("etype", F.when(F.col("word") < "i", "PERSON").when(F.col("word") < "q", "PLACE").otherwise("SCHOOL"))


_NER = f"""{_DICT}, pat as (select '(' || string_agg(word, '|' order by length(word) desc, word) || ')' as p from dc),
x as (select doc_id, unnest(regexp_extract_all(text, p)) as word from documents, pat)"""


@query(f"with {_NER} select doc_id as id, x.word, etype, count(*) as n from x join dc on dc.word = x.word group by all")
def dict_ner(spark, sf_dir):
    found = ner.dictionary_entities(table(spark, sf_dir, "documents"), "doc_id", "text", dictionary(spark, sf_dir))
    return found.groupBy("id", "word", "etype").agg(F.count("*").alias("n"))


@query(
    f"""with {_NER}, k as (select doc_id as original, substr(x.word, 1, 4) as normalized, etype, min(x.word) as w from x join dc on dc.word = x.word group by all)
select normalized, etype, string_agg(cast(original as varchar), ',' order by original) as originals from k group by all"""
)
def entity_dedup_group(spark, sf_dir):
    """Documents that name an entity of a normal form, in order of their ids."""
    found = ner.dictionary_entities(table(spark, sf_dir, "documents"), "doc_id", "text", dictionary(spark, sf_dir))
    rows = found.select(F.substring("word", 1, 4).alias("normalized"), "etype", F.col("id").cast("string").alias("original"), F.col("id").alias("place"))
    return ner.group_normalized(rows)


_STYLES = {"twice": r"\b(?:the the|of of)\b", "numbers": r"[0-9]+(?:\.[0-9]+)?", "shout": r"[A-Z]{3,}!!"}


@query(
    "select doc_id as id, label, word, count(*) as n from ("
    + " union all ".join(f"select doc_id, '{k}' as label, unnest(regexp_extract_all(text, '{p}')) as word from documents" for k, p in _STYLES.items())
    + ") group by all"
)
def regex_style_ner(spark, sf_dir):
    return ner.pattern_entities(table(spark, sf_dir, "documents"), "doc_id", "text", _STYLES)


_DATED = ("明末清初白文", "康熙庚午，元朱文蒼勁", "乾隆乾隆朱砂文", "近代古拙古拙", "無", None, "清代秦漢印風朱文白文")
_DATED_SQL = f"select c_custkey as id, list_extract([{', '.join('null' if x is None else f"'{x}'" for x in _DATED)}], 1 + c_custkey % {len(_DATED)}) as t from customer"


@query(
    f"with x as ({_DATED_SQL}), p as (select id, unnest({list(ner.PERIODS)!r}) as name, t from x), s as (select id, unnest(regexp_extract_all(t, '{'|'.join(ner.STYLES)}')) as name from x) "
    "select id, 'PERIOD' as etype, name, cast((length(t) - length(replace(t, name, ''))) / length(name) as bigint) as n, cast(0.9 as double) as confidence from p where contains(t, name) "
    "union all select id, 'STYLE', name, count(*), cast(0.9 as double) from s group by id, name"
)
def period_style_ner(spark, sf_dir):
    """Periods and styles in texts of the language, one text per customer."""
    text = F.element_at(F.array(*map(F.lit, _DATED)), (1 + F.col("c_custkey") % len(_DATED)).cast("int"))
    return ner.periods_and_styles(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), text.alias("t")), "k", "t")


_RULES = {"partOf": ("([a-z]+) of ([a-z]+)", 0.93), "comesFrom": ("([a-z]+) from ([a-z]+)", 0.9), "joinedWith": ("([a-z]+) and ([a-z]+)", 0.88)}


@query(
    "select distinct id, subject, predicate, object, confidence from ("
    + " union all ".join(
        f"select doc_id as id, unnest(regexp_extract_all(text, '{p}', 1)) as subject, '{k}' as predicate, unnest(regexp_extract_all(text, '{p}', 2)) as object, cast({c} as double) as confidence from documents" for k, (p, c) in _RULES.items()
    )
    + ") where subject <> object"
)
def relation_rules(spark, sf_dir):
    return relations.pair_relations(table(spark, sf_dir, "documents"), "doc_id", "text", _RULES)


# A sentence per rule, and what it says: predicate, object and confidence of the person {A}, and the inverse predicate.
_SENTENCES = (
    ("{A}繼{B}起。", "studentOf", "{B}", 0.93, "teacherOf"),
    ("{A}，字abc", "styleName", "abc", 0.95, None),
    ("{A}得之{B}。", "studentOf", "{B}", 0.91, "teacherOf"),
    ("{A}從{B}討論。", "studentOf", "{B}", 0.90, "teacherOf"),
    ("自{A}開之，其後浙派", "foundedSchool", "浙派", 0.90, None),
    ("{A}開婁東派。", "foundedSchool", "婁東派", 0.88, None),
    ("{A}為婺源人。", "nativePlace", "婺源人", 0.90, None),
    ("{A}屬莆田派。", "belongsToSchool", "莆田派", 0.88, None),
    ("{A}私淑{B}。", "studentOf", "{B}", 0.90, "teacherOf"),
    ("{A}從{B}學印。", "studentOf", "{B}", 0.90, "teacherOf"),
    ("{A}得{B}之傳。", "studentOf", "{B}", 0.90, "teacherOf"),
    ("嫡傳則獨有{A}父子。", "studentOf", "{T}", 0.92, "teacherOf"),
    ("{A}師{B}。", "studentOf", "{B}", 0.88, "teacherOf"),
    ("{A}受業於{B}。", "studentOf", "{B}", 0.88, "teacherOf"),
    ("{A}仿{B}。", "influencedBy", "{B}", 0.80, None),
    ("{A}與{B}友善。", None, None, None, None),
)
_NAMES = ("何震", "文彭", "蘇宣", "程原", "丁敬", "江高", "陶碧", "趙璧", "吳邁", "胡正")
_S = len(_SENTENCES)


def sentences(spark, sf_dir):
    """One entry per customer: a sentence about two of the names."""
    t = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    a = F.expr(f"(k div {_S}) % 10")
    b = F.expr(f"((k div {_S}) % 10 + 1 + (k div {10 * _S}) % 9) % 10")
    name = lambda i: F.element_at(F.array(*map(F.lit, _NAMES)), (i + 1).cast("int"))
    text = F.element_at(F.array(*(F.lit(x[0]) for x in _SENTENCES)), (F.col("k") % _S + 1).cast("int"))
    return t.select(F.col("c_mktsegment").alias("chapter"), F.col("c_name").alias("title"), F.replace(F.replace(text, F.lit("{A}"), name(a)), F.lit("{B}"), name(b)).alias("content"))


def _says(x: int) -> str:
    """SQL of the statements of a sentence: its own (x 0), or the inverse (x 1)."""
    legs = []
    for n, (text, predicate, object_, confidence, inverse) in enumerate(_SENTENCES):
        if predicate and (not x or inverse):
            o = {"{B}": "b", "{T}": "title"}.get(object_, f"'{object_}'")
            s, p, o = (o, inverse, "a") if x else ("a", predicate, o)
            legs.append(f"select chapter, title, {s} as subject, '{p}' as predicate, {o} as object, cast({confidence} as double) as confidence, replace(replace('{text}', '{{A}}', a), '{{B}}', b) as evidence from k where t = {n}")
    return " union all ".join(legs)


_SAID = f"""k as (select c_mktsegment as chapter, c_name as title, c_custkey % {_S} as t, list_extract({list(_NAMES)!r}, 1 + (c_custkey // {_S}) % 10) as a,
  list_extract({list(_NAMES)!r}, 1 + ((c_custkey // {_S}) % 10 + 1 + (c_custkey // {10 * _S}) % 9) % 10) as b from customer), sa as ({_says(0)} union all {_says(1)})"""


@query(f"with {_SAID} select * from sa")
def relation_rules_cjk(spark, sf_dir):
    """The rule table on sentences of its own language, one per rule and customer."""
    return relations.extract_relations(sentences(spark, sf_dir), list(_NAMES))


def _case(pairs: dict[str, str], column: str) -> str:
    return f"case trim({column}) " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items()) + f" else trim({column}) end"


_RAW = f"select p_partkey as id, list_extract({[*normalize.SCHEMA, 'other']!r}, 1 + p_partkey % {len(normalize.SCHEMA) + 1}) || ' ' as raw from part"


@query(f"with r as ({_RAW}) select id, {_case(normalize.SCHEMA, 'raw')} as schema_name, {_case(normalize.RDF, _case(normalize.SCHEMA, 'raw'))} as property from r")
def predicate_normalize(spark, sf_dir):
    raw = F.concat(F.element_at(F.array(*map(F.lit, [*normalize.SCHEMA, "other"])), (1 + F.col("p_partkey") % (len(normalize.SCHEMA) + 1)).cast("int")), F.lit(" "))
    s = normalize.predicate(raw)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), s.alias("schema_name"), normalize.predicate(s, normalize.RDF).alias("property"))


@query(f"with r as ({_RAW}), x as (select id, {_case(normalize.RDF, _case(normalize.SCHEMA, 'raw'))} as property from r) select id, property, case property " + " ".join(f"when '{k}' then '{v}'" for k, v in normalize.OBJECT_KIND.items()) + " else 'person' end as kind from x")
def object_kind_routing(spark, sf_dir):
    p = predicate_normalize(spark, sf_dir)
    return p.select("id", "property", normalize.object_kind(F.col("property")).alias("kind"))


_ALIASES = "al as (select c_name as alias, 'Supplier#' || lpad(cast(c_custkey % 97 as varchar), 9, '0') as standard, case c_custkey % 3 when 0 then 'PERSON' when 1 then 'PLACE' else 'SCHOOL' end as etype from customer)"


def aliases(spark, sf_dir):
    kind = F.when(F.col("c_custkey") % 3 == 0, "PERSON").when(F.col("c_custkey") % 3 == 1, "PLACE").otherwise("SCHOOL")
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("alias"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 97).cast("string"), 9, "0")).alias("standard"), kind.alias("etype"))


@query(
    f"""with {_ALIASES}, a as (select alias as k, etype, min(standard) as standard from (select alias, standard, etype from al union all select standard, standard, etype from al) group by all),
n as (select o_orderkey as id, 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') || ' ' as name, case o_custkey % 4 when 0 then 'PERSON' when 1 then 'PLACE' when 2 then 'PERIOD' else 'SCHOOL' end as etype from orders)
select id, name, n.etype, coalesce(a.standard, trim(name)) as normalized, case when a.standard is not null or n.etype in ('PERIOD', 'STYLE') then 1.0 else 0.5 end as confidence
from n left join a on trim(name) = a.k and n.etype = a.etype"""
)
def alias_normalize(spark, sf_dir):
    k = F.col("o_custkey") % 4
    kind = F.when(k == 0, "PERSON").when(k == 1, "PLACE").when(k == 2, "PERIOD").otherwise("SCHOOL")
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" ")).alias("name"), kind.alias("etype"))
    return normalize.standard_names(names, aliases(spark, sf_dir))


@query(f"with {_ALIASES} select standard, string_agg(distinct alias, ',' order by alias) as aliases from al group by standard")
def reverse_alias_lookup(spark, sf_dir):
    return normalize.all_aliases(aliases(spark, sf_dir))


# Names as they are written, and the school each goes by (null: none is known).
_WRITTEN = {"浙派": "浙派", "吴门印派": "吳門印派", "吳門派": "吳門印派", "吴门派": "吳門印派", "娄东派": "婁東派", "婁東派": "婁東派", "漳海派": "漳海派", "無名派": None, "娄东": None}
_SCHOOLS = f"sc as (select s_suppkey as id, list_extract({list(_WRITTEN)!r}, 1 + s_suppkey % {len(_WRITTEN)}) as name from supplier)"


def _written(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(F.array(*map(F.lit, _WRITTEN)), (1 + F.col("s_suppkey") % len(_WRITTEN)).cast("int")).alias("name"))


@query(f"with {_SCHOOLS}, k(name, school) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _WRITTEN.items() if b) + ") select id, sc.name, coalesce(school, sc.name) as school, school is not null as known from sc left join k on k.name = sc.name")
def school_canonicalize(spark, sf_dir):
    return _written(spark, sf_dir).select("id", "name", normalize.school(F.col("name")).alias("school"), normalize.is_school(F.col("name")).alias("known"))


_PLACES = ("婺源何震", "錢塘丁敬", "蘇州", "徽州程原", "莆田", "文彭", "漳浦", "婁東", "秦漢", "福州浙人")


@query(
    f"with p as (select p_partkey as id, list_extract({list(_PLACES)!r}, 1 + p_partkey % {len(_PLACES)}) as name from part) select id, name, case "
    + " ".join(f"when {' or '.join(f"strpos(name, '{w}') > 0" for w in words)} then '{k}'" for k, words in normalize.SCHOOL_KEYWORDS.items())
    + " end as school from p"
)
def school_inference(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _PLACES)), (1 + F.col("p_partkey") % len(_PLACES)).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name")).withColumn("school", normalize.infer_school(F.col("name")))


@query("select s_suppkey as id, case when s_suppkey % 5 = 0 then 'http://example.org/kg/unknown' else 'http://example.org/kg/person/' || replace(s_name, '#', '_') end as iri, case when s_suppkey % 5 = 0 then 'unknown' else replace(s_name, '#', '_') end as local from supplier")
def iri_minting(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(" ")))
    iri = T.mint(name, "person")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), iri.alias("iri"), T.local_name(iri).alias("local"))


@query("select o_orderkey as id, o_orderpriority as line from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as n from orders) where n = 1")
def keep_first_per_group(spark, sf_dir):
    rows = first_by_key(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("line"))


_ALIAS = [("江高", "胡正", "PERSON"), ("陶", "陶碧", "PERSON"), ("文彭", "文三橋", "PLACE")]
_MODE = "case predicate " + " ".join(f"when '{k}' then '{v}'" for k, v in normalize.SCHEMA.items()) + " else predicate end"


@query(
    f"""with {_SAID}, m as (select case subject when '江高' then '胡正' else subject end as subject, {_MODE} as predicate, object, confidence from sa),
n as (select subject, predicate, case when object = '江高' and regexp_matches(predicate, '^(education|kinship|social):') then '胡正' else object end as object, confidence from m)
select subject, predicate, object, max(confidence) as confidence from n where subject <> object group by all"""
)
def rule_mode_extraction(spark, sf_dir):
    """Rules, standard names, schema predicates and inverses together."""
    names = spark.createDataFrame(_ALIAS, "alias string, standard string, etype string")
    people = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return build.rule_facts(sentences(spark, sf_dir), people, names).select("subject", "predicate", "object", "confidence")


@query()
def graph_build(spark, sf_dir):
    """The whole chain from corpus files, one per customer, to triples."""
    files = sentences(spark, sf_dir).select(F.col("title").alias("file"), F.concat(F.lit("卷一\n○"), "title", F.lit("\n"), "content").alias("text"))
    people = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    names = spark.createDataFrame(_ALIAS, "alias string, standard string, etype string")
    known = spark.createDataFrame([("文彭", "social:friendOf", "何震", 0.95, "known", "", "")], "subject string, predicate string, object string, confidence double, method string, evidence string, chapter string")
    return build.build(build.preprocess(files), people, names, known)[1]
