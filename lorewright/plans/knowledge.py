"""Queries over the triples: templates, SPARQL, views, facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.operators import knowledge as K
from lorewright.operators import sparql
from lorewright.operators.templates import ATTRIBUTES, NOT_GENERAL, RELATIONS, template
from lorewright.plans.registry import query, table
from lorewright.sources.canonical import PRELUDE, triples

PERSON, OTHER, FRIEND, SCHOOL = "Supplier#000000030", "Supplier#000000010", "Supplier#000000020", "NATION_3"
WITH = f"with {PRELUDE} "


def _asked(kind: str, name: str = PERSON, other: str | None = None):
    def run(spark, sf_dir):
        return sparql.select(triples(spark, sf_dir), template(kind, name, other))

    return run


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


for _kind, _attribute in ATTRIBUTES.items():
    _who = PERSON if _attribute == "masterpiece" else FRIEND
    query(WITH + f"select b.o as \"{_attribute}\" from t a join t b on a.s = b.s where a.p = 'personName' and a.o = '{_who}' and b.p = '{_attribute}'", _kind)(_asked(_kind, _who))

_BOTH = (
    "select n.o as {0}Name, x.rel from (select o as k, p as rel from t where s = '{1}' and p = '{2}' union all select s, p from t where o = '{1}' and p = '{3}') x "
    "join t n on n.s = x.k and n.p = 'personName'"
)
query(WITH + _BOTH.format("teacher", PERSON, "hasTeacher", "hasStudent"), "ask_teacher")(_asked("ask_teacher"))
query(WITH + _BOTH.format("student", OTHER, "hasStudent", "hasTeacher"), "ask_student")(_asked("ask_student", OTHER))
query(
    WITH + f"select distinct n.o as friendName from (select o as k from t where s = '{FRIEND}' and p = 'hasFriend' union all select s from t where o = '{FRIEND}' and p = 'hasFriend') x join t n on n.s = x.k and n.p = 'personName' where n.o <> '{FRIEND}'",
    "ask_friend",
)(_asked("ask_friend", FRIEND))
query(
    WITH + f"select distinct n.o as schoolName from t a join t n on n.s = a.o and n.p = 'schoolName' where a.s = '{PERSON}' and a.p in ('belongsToSchool', 'hasFounder')",
    "ask_school",
)(_asked("ask_school"))
_MEMBERS = WITH + f"select distinct m.o as personName from t a join t n on n.s = a.o and n.p = 'schoolName' join t m on m.s = a.s and m.p = 'personName' where a.p = 'belongsToSchool' and n.o = '{SCHOOL}'"
query(_MEMBERS, "ask_school_members")(_asked("ask_school_members", SCHOOL))
query(
    WITH
    + f"select a.p as rel, n.o as targetName from t a join t n on n.s = a.o and n.p = 'personName' where a.s = '{PERSON}' and a.p in {_in(RELATIONS)} "
    + f"union all select a.p, n.o from t a join t n on n.s = a.s and n.p = 'personName' where a.o = '{PERSON}' and a.p in {_in(RELATIONS)}",
    "ask_relation",
)(_asked("ask_relation"))
query(
    WITH + f"select a.p as rel, n.o as targetName from t a join t n on n.s = a.o and n.p = 'personName' where a.s = '{PERSON}' and a.p in ('hasTeacher', 'hasStudent', 'hasFriend', 'hasFather', 'hasSon')",
    "ask_path_direct",
)(_asked("ask_path"))
query(
    WITH + "select n.o as founderName from t a join t c on c.s = a.o and c.p = 'schoolName' join t n on n.s = a.s and n.p = 'personName' where a.p = 'hasFounder' and contains(c.o, 'ATION_1')",
    "ask_founder",
)(_asked("ask_founder", "ATION_1"))
query(WITH + f"select p, o from t where s = '{PERSON}' and p not in {_in(NOT_GENERAL)}", "ask_general")(_asked("general"))
query(
    WITH
    + f"select p as rel, o as targetName from t where s = '{PERSON}' and o = '{OTHER}' and p in ('hasTeacher', 'hasStudent', 'hasFriend') "
    + f"union all select 'reverse:' || p, o from t where s = '{OTHER}' and o = '{PERSON}' and p in ('hasTeacher', 'hasStudent', 'hasFriend')",
    "two_person_relation",
)(_asked("two_person_relation", PERSON, OTHER))


@query(
    WITH
    + """select n.o as name, x.o as place from t n join t x on x.s = n.s and x.p = 'nativePlace'
    where n.p = 'personName' and x.o in ('NATION_1', 'NATION_2') and n.o <> 'Supplier#000000001'"""
)
def sparql_filter_in(spark, sf_dir):
    text = """PREFIX ex: <http://example.org/kg/>
    SELECT ?name ?place WHERE { ?x ex:personName ?name ; ex:nativePlace ?place . FILTER(?place IN ("NATION_1", "NATION_2")) FILTER(?name != "Supplier#000000001") }"""
    return sparql.select(triples(spark, sf_dir), text)


@query(
    WITH
    + """select distinct n.o as name, 'teaches' as role from t a join t n on n.s = a.o and n.p = 'personName' where a.p = 'hasTeacher'
    union all select distinct n.o, 'founds' from t a join t n on n.s = a.s and n.p = 'personName' where a.p = 'hasFounder'"""
)
def sparql_bgp_union_filter(spark, sf_dir):
    text = """SELECT DISTINCT ?name ?role WHERE { { ?a ex:hasTeacher ?x . BIND("teaches" AS ?role) } UNION { ?x ex:hasFounder ?b . BIND("founds" AS ?role) } ?x ex:personName ?name }"""
    return sparql.select(triples(spark, sf_dir), text)


@query(WITH + "select s, p, o, o_kind from t")
def triples_table(spark, sf_dir):
    return triples(spark, sf_dir)


_ATTRS = ("styleName", "hao", "birthYear", "deathYear", "nativePlace", "dynasty", "biography", "masterpiece")


@query(
    WITH
    + "select s as name, "
    + ", ".join(f"max(case when p = '{a}' then o end) as \"{a}\"" for a in _ATTRS)
    + f""", coalesce(string_agg(distinct case when p = 'belongsToSchool' then o end, ','), '') as schools, count(*) filter (where p in {_in(K.PERSON_TO_PERSON)}) as relations
    from t where s in (select s from t where o = 'HistoricPerson') group by s"""
)
def person_info_pivot(spark, sf_dir):
    return K.person_info(triples(spark, sf_dir))


@query(WITH + "select s as name, p as relation, o as target from t where p in ('hasTeacher', 'hasStudent')")
def person_relations_filtered(spark, sf_dir):
    return K.relations(triples(spark, sf_dir), ("hasTeacher", "hasStudent"))


@query(WITH + "select distinct s as id from t where o = 'HistoricPerson'")
def all_persons(spark, sf_dir):
    return K.of_type(triples(spark, sf_dir), "HistoricPerson")


@query(
    WITH
    + """select s as school, max(case when p = 'schoolName' then o end) as name, max(case when p = 'region' then o end) as region, max(case when p = 'period' then o end) as period
    from t where s in (select s from t where o = 'SealEngravingSchool') group by s"""
)
def all_schools(spark, sf_dir):
    return K.schools(triples(spark, sf_dir))


@query(WITH + "select distinct o as school, s as member from t where p in ('belongsToSchool', 'hasFounder', 'foundedSchool')")
def school_members_all(spark, sf_dir):
    return K.members(triples(spark, sf_dir), True)


@query(WITH + "select distinct o as school, s as member from t where p = 'belongsToSchool'")
def school_members_strict(spark, sf_dir):
    return K.members(triples(spark, sf_dir), False)


EDGES = PRELUDE + """,
e as (select distinct s as src, o as dst, p as relation from t where o_kind = 'iri' and not contains(p, '#') and s <> o
      and p not in ('confidence', 'extractedBy', 'extractionMethod', 'sourceText', 'source', 'dataSource', 'wasDerivedFrom'))"""
WITH_EDGES = f"with {EDGES} "


@query(WITH_EDGES + "select src, dst, relation from e")
def graph_links(spark, sf_dir):
    return K.edges(triples(spark, sf_dir))


_NODES = """nd as (select id, case when starts_with(id, 'school/') then 'school' else 'person' end as node_type, min(r) as school
    from (select src as id, case when contains(relation, 'School') then relation end as r from e union all select dst, null from e) group by id)"""


@query(f"with {EDGES}, {_NODES} select id, node_type, school from nd")
def graph_nodes(spark, sf_dir):
    return K.nodes(K.edges(triples(spark, sf_dir)))


@query(f"with {EDGES}, {_NODES} select src, dst, relation from e where src in (select id from nd where node_type = 'person') and dst in (select id from nd where node_type = 'person')")
def node_filter(spark, sf_dir):
    e = K.edges(triples(spark, sf_dir))
    return K.induced(e, K.nodes(e).where("node_type = 'person'").select("id"))


@query(f"with {EDGES}, {_NODES} select id, node_type from nd where node_type = 'school' or coalesce((select max(o) from t where t.s = nd.id and t.p = 'dynasty'), 'ASIA') = 'ASIA'")
def dynasty_filter(spark, sf_dir):
    """Schools always, persons of one dynasty or of none."""
    t = triples(spark, sf_dir)
    d = t.where("p = 'dynasty'").groupBy(F.col("s").alias("id")).agg(F.max("o").alias("dynasty"))
    rows = K.nodes(K.edges(t)).join(d, "id", "left")
    return rows.where((F.col("node_type") == "school") | (F.coalesce("dynasty", F.lit("ASIA")) == "ASIA")).select("id", "node_type")


@query(f"with {EDGES}, {_NODES} select id from nd where contains(lower(id), 'r#00000000') order by id limit 8")
def node_search(spark, sf_dir):
    return K.nodes(K.edges(triples(spark, sf_dir))).where(F.contains(F.lower("id"), F.lit("r#00000000"))).select("id").orderBy("id").limit(8)


@query(WITH_EDGES + f"select distinct id from (select dst as id from e where src = '{PERSON}' union all select src from e where dst = '{PERSON}')")
def neighbourhood(spark, sf_dir):
    return K.neighbourhood(K.edges(triples(spark, sf_dir)), PERSON)


# Facts from lineitem: a supplier (subject) supplies (predicate by return flag) a part (object).
_FACTS = """f as (select 'Supplier#' || l_suppkey as subject, case l_returnflag when 'A' then 'education:studentOf' when 'N' then 'kinship:fatherOf' else 'social:friendOf' end as predicate,
  'Supplier#' || (l_partkey % 50) as object, l_returnflag as method, l_linestatus as source, 1 - l_discount as confidence, l_orderkey as ord, l_linenumber as line from lineitem)"""


def facts(spark, sf_dir):
    flag = F.col("l_returnflag")
    predicate = F.when(flag == "A", "education:studentOf").when(flag == "N", "kinship:fatherOf").otherwise("social:friendOf")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("Supplier#"), "l_suppkey").alias("subject"), predicate.alias("predicate"), F.concat(F.lit("Supplier#"), F.col("l_partkey") % 50).alias("object"),
        flag.alias("method"), F.col("l_linestatus").alias("source"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
    )


@query(f"with {_FACTS} select subject, predicate, object, ord, line from (select *, row_number() over (partition by subject, predicate, object order by ord, line) as n from f) where n = 1")
def dedup_keep_first(spark, sf_dir):
    return K.first_by_key(facts(spark, sf_dir), ["subject", "predicate", "object"], "ord", "line").select("subject", "predicate", "object", "ord", "line")


@query(
    f"""with {_FACTS}, k as (select distinct subject, predicate, object from f), i as (
  select object as subject, case predicate when 'education:studentOf' then 'education:teacherOf' when 'kinship:fatherOf' then 'kinship:sonOf' end as predicate, subject as object from k)
  select subject, predicate, object from k union select subject, predicate, object from i where predicate is not null"""
)
def inverse_closure(spark, sf_dir):
    return K.with_inverses(facts(spark, sf_dir).select("subject", "predicate", "object").distinct())


@query(
    f"""with {_FACTS}, a as (select distinct subject, predicate, object from f where source = 'F'), b as (select distinct subject, predicate, object from f where source = 'O')
  select subject, predicate, object from a union select subject, predicate, object from b"""
)
def kb_anti_merge(spark, sf_dir):
    f = facts(spark, sf_dir).select("subject", "predicate", "object", "source")
    key = ["subject", "predicate", "object"]
    return K.merge_known(f.where("source = 'F'").select(*key).distinct(), f.where("source = 'O'").select(*key).distinct())


@query(
    f"""with {_FACTS}, g as (select distinct subject, predicate, object, case when method = 'R' then 'known' else method end as method from f)
  select subject, predicate, object, method from g where method = 'known' or (cast(substr(subject, 10) as int) < 25 and (predicate <> 'kinship:fatherOf' or cast(substr(object, 10) as int) < 25))"""
)
def fact_validation(spark, sf_dir):
    g = facts(spark, sf_dir).select("subject", "predicate", "object", F.when(F.col("method") == "R", "known").otherwise(F.col("method")).alias("method")).distinct()
    people = g.select(F.explode(F.array("subject", "object")).alias("name")).where(F.substring("name", 10, 9).cast("int") < 25)
    return K.valid_facts(g, people, ("kinship:fatherOf",))


@query(
    f"""with {_FACTS} select subject, predicate, count(*) as statements, string_agg(distinct method, '|' order by method) as methods, string_agg(distinct source, '|' order by source) as sources,
  round(max(confidence), 6) as confidence from f group by subject, predicate"""
)
def evidence_merge(spark, sf_dir):
    return K.evidence(facts(spark, sf_dir))


@query(f"with {_FACTS} select (select count(*) from f) as facts, (select count(distinct subject) from f) as subjects, (select count(distinct object) from f) as objects, (select count(*) from nation) as schools")
def result_counters(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.agg(F.count("*").alias("facts"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects")).crossJoin(table(spark, sf_dir, "nation").agg(F.count("*").alias("schools")))


@query(f"with {_FACTS} select subject as name from f union select object from f")
def known_persons(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.select(F.col("subject").alias("name")).union(f.select("object")).distinct()


@query(WITH + "select s as id from t where o = 'HistoricPerson' except select s from t where p = 'hasFounder'")
def persons_minus_founders(spark, sf_dir):
    t = triples(spark, sf_dir)
    founders = t.where("p = 'hasFounder'").select(F.col("s").alias("id"))
    return K.of_type(t, "HistoricPerson").join(founders, "id", "left_anti")
