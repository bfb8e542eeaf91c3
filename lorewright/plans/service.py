"""Queries of the writers, of models' answers and of a service's calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.operators import models, rdf, service
from lorewright.plans.graphs import A, B, _path
from lorewright.plans.knowledge import PERSON, WITH, facts
from lorewright.plans.registry import query, table
from lorewright.sources.canonical import triples

_PEOPLE = """rc as (select s_name as name, case when s_suppkey % 3 = 0 then '' else 'st ' || s_suppkey end as style, case when s_suppkey % 2 = 0 then 1500 + s_suppkey end as birth_year, ' ' || n_name || ' ' as place from supplier join nation on s_nationkey = n_nationkey)"""


@query(
    f"""with {_PEOPLE} select name as s, 'rdf-syntax-ns#type' as p, 'HistoricPerson' as o, 'iri' as o_kind, null as o_dtype from rc union select name, 'personName', name, 'literal', null from rc
union select name, 'styleName', style, 'literal', null from rc where style <> '' union select name, 'birthYear', cast(birth_year as varchar), 'literal', 'integer' from rc where birth_year is not null union select name, 'nativePlace', place, 'literal', null from rc"""
)
def rdf_person_writer(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("name"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("st "), k)).alias("style"), F.when(k % 2 == 0, 1500 + k).alias("birth_year"), F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("place"))
    return rdf.records(rows, "person")


@query(
    """select 'school/' || n_name as s, 'rdf-syntax-ns#type' as p, 'SealEngravingSchool' as o, 'iri' as o_kind from nation union select 'school/' || n_name, 'schoolName', n_name, 'literal' from nation
union select 'school/' || n_name, 'region', r_name, 'literal' from nation join region on n_regionkey = r_regionkey union select 'school/' || n_name, 'founder', 'A ' || n_name, 'literal' from nation union select 'A_' || n_name, 'foundedSchool', 'school/' || n_name, 'iri' from nation
union select 'place/' || replace(r_name, ' ', '_'), 'rdf-syntax-ns#type', 'Location', 'iri' from region union select 'place/' || replace(r_name, ' ', '_'), 'placeName', r_name, 'literal' from region
union select 'place/' || replace(r_name, ' ', '_'), 'placeType', 'region', 'literal' from region"""
)
def rdf_school_place_writer(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    schools = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.concat(F.lit("A "), "n_name").alias("founder"))
    places = r.select(F.col("r_name").alias("name"), F.lit("region").alias("place_type"))
    return rdf.graph(rdf.records(schools, "school"), rdf.records(places, "place")).drop("o_dtype")


_PREDICATES = "case predicate when 'education:studentOf' then 'hasTeacher' when 'kinship:fatherOf' then 'hasFather' else 'hasFriend' end"
_RAW = """fa as (select distinct 'Supplier#' || l_suppkey as subject, case l_returnflag when 'A' then 'education:studentOf' when 'N' then 'kinship:fatherOf' else 'social:friendOf' end as predicate, 'Supplier#' || (l_partkey % 50) as object, l_returnflag as method, l_linestatus as chapter from lineitem)"""


@query(f"with {_RAW} select distinct subject as s, {_PREDICATES} as p, object as o, 'iri' as o_kind from fa")
def rdf_statements(spark, sf_dir):
    return rdf.statements(facts(spark, sf_dir)).drop("o_dtype")


@query(
    f"""with {_RAW}, ev as (select *, 'evidence/' || subject || '_' || predicate || '_' || object as s from fa)
select distinct s, 'rdf-syntax-ns#type' as p, 'Evidence' as o, 'iri' as o_kind from ev union select s, 'extractionMethod', method, 'literal' from ev union select s, 'source', chapter, 'literal' from ev union select s, 'extractedBy', subject, 'iri' from ev"""
)
def rdf_evidence(spark, sf_dir):
    f = facts(spark, sf_dir).withColumnsRenamed({"source": "chapter"}).withColumn("evidence", F.lit(""))
    return rdf.evidence(f).where("p <> 'confidence'").drop("o_dtype")


def _values(rows):
    return ", ".join("(" + ", ".join("cast(null as varchar)" if x is None else f"'{x}'" for x in r) + ")" for r in rows)


@query(
    f"""with a as (select unnest(names) as name, up from (values {', '.join(f"('{c}', {list(names)!r})" for c, names in rdf.ATTRIBUTES.items())}) v(up, names)), t as (select * from (values {_values(rdf.TYPED.items())}) v(name, dtype))
select * from (values {_values((c, 'class', up, None) for c, up in rdf.CLASSES.items())}) v(name, kind, domain, "range")
union all select a.name, 'datatype', up, coalesce(dtype, 'string') from a left join t on t.name = a.name
union all select unnest(names), 'object', d, g from (values {', '.join(f"('{d}', '{g}', {list(names)!r})" for (d, g), names in rdf.RELATIONS.items())}) v(d, g, names)"""
)
def ontology_tables(spark, sf_dir):
    return rdf.ontology(spark)


@query(f"with i as (select * from (values {_values(rdf.INVERSE)}) v(p, inv_p)) select p, inv_p from i union all select inv_p, p from i")
def inverse_properties(spark, sf_dir):
    return rdf.inverses(spark)


@query(
    """select doc_id as id, upper(lang) as name, 'PLACE' as etype, 0.85 as confidence from documents where doc_id % 4 <> 3
union all select doc_id, source, 'PERSON', 0.5 from documents where doc_id % 4 <> 3
union all select doc_id, 'by rule', 'STYLE', 0.9 from documents where doc_id % 4 = 3"""
)
def model_entities_with_rules(spark, sf_dir):
    """A stand-in model's noisy JSON; documents with an unreadable answer take the rules' entities."""
    d = table(spark, sf_dir, "documents")
    good = F.concat(
        F.lit('Here: {"entities": [{"name": " '), F.upper("lang"), F.lit('", "type": "place"}, {"name": "'), "source", F.lit('", "type": "PERSON", "confidence": 0.5}, {"name": "'), "source",
        F.lit('", "type": "person", "confidence": 0.1}, {"name": "x", "type": "OTHER"}, {"name": "", "type": "PERSON"}]} done'),
    )
    answers = d.select("doc_id", F.when(F.col("doc_id") % 4 != 3, good).otherwise("{broken").alias("answer"))
    found = models.entities(answers, "doc_id", "answer").drop("evidence")
    rules = d.select(F.col("doc_id").alias("id"), F.lit("by rule").alias("name"), F.lit("STYLE").alias("etype"), F.lit(0.9).alias("confidence"))
    return models.with_rules(found, rules)


@query(
    f"""select item_id, case when p is null then null when length(p) % 7 = 0 then null else regexp_extract(p, '^[^ ]*') || ' ' || length(p) end as answer
from (select item_id, substr(text, 1, {models.MOST_CHARS}) as p from benchmark)"""
)
def model_answers(spark, sf_dir):
    """A caller's model in batches: here one that says a passage's first word and length, or nothing."""
    d = table(spark, sf_dir, "benchmark")

    def model(prompts):
        return [None if p is None or len(p) % 7 == 0 else f"{p.split(' ')[0]} {len(p)}" for p in prompts]

    return models.ask(d.select("item_id", "text"), models.seen(F.col("text")), model).drop("text")


@query(WITH + f"select max(case when p = 'styleName' then o end) as \"styleName\", max(case when p = 'nativePlace' then o end) as \"nativePlace\", s as name from t where s = '{PERSON}' group by s")
def service_person(spark, sf_dir):
    return service.person(triples(spark, sf_dir), PERSON).select("name", "styleName", "nativePlace")


@query(WITH + f"select s as name, p as relation, o as target from t where s = '{PERSON}' and p in ('hasTeacher', 'hasFriend')")
def service_relations(spark, sf_dir):
    return service.person_relations(triples(spark, sf_dir), PERSON, ("studentOf", "hasFriend"))


@query(WITH + "select o as school, string_agg(distinct s, ',' order by s) as members, count(distinct s) as member_count from t where o = 'school/NATION_3' and p in ('belongsToSchool', 'hasFounder') group by o")
def service_school(spark, sf_dir):
    return service.school(triples(spark, sf_dir), "NATION_3")


@query(WITH + "select count(*) as n, kind from (select 'link' as kind from t where o_kind = 'iri' and not contains(p, '#') and s <> o) group by kind")
def service_graph_links(spark, sf_dir):
    return service.graph_json(triples(spark, sf_dir)).where("kind = 'link'").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    _path(False).replace("select cast(hop as integer) as hop, sp.src, sp.dst, relation from hops", "select count(*) > 0 as found, count(*) as length, max('" + A + " → ' || (select array_to_string(path[2:], ' → ') from best)) as path from hops")
)
def service_path(spark, sf_dir):
    t = triples(spark, sf_dir).where("p not in ('belongsToSchool', 'hasFounder')")
    return service.path(t, A, B)
