"""The knowledge graph that the driver's star-schema tables stand for.

Suppliers are persons, nations schools, regions dynasties. ``triples`` is the canonical long table
(s, p, o, o_kind); all graph operators work on it or on the edges taken from it. One scan of
supplier and two broadcast-sized joins make all triples of a person in a single projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "rdf-syntax-ns#type"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id long, name, school, nation, dynasty, acctbal)."""
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("school/"), "n_name").alias("school"), F.col("n_name").alias("nation"), F.col("r_name").alias("dynasty"), F.col("s_acctbal").alias("acctbal"))


def person_name(id: F.Column) -> F.Column:
    return F.concat(F.lit("Supplier#"), F.lpad(id.cast("string"), 9, "0"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o, o_kind): o_kind is 'literal' or 'iri'. Persons are named by their name, schools ``school/NAME``."""
    p = persons(spark, sf_dir)
    n = F.broadcast(_table(spark, sf_dir, "supplier").agg(F.count("*").alias("n")))
    p = p.crossJoin(n)  # one row
    id, total = F.col("id"), F.col("n")

    def made(pred: str, o: F.Column, kind: str, when: F.Column | None = None) -> F.Column:
        x = F.struct(F.lit(pred).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))
        return x if when is None else F.when(when, x)

    def iri(pred: str, other: F.Column, when: F.Column | None = None) -> F.Column:
        return made(pred, person_name(other), "iri", when)

    third = F.floor(id / 3).cast("long")
    heir = F.pmod(id * 7 + 1, total)
    facts = F.array(
        made(TYPE, F.lit("HistoricPerson"), "iri"),
        made("personName", F.col("name"), "literal"),
        made("nativePlace", F.col("nation"), "literal"),
        made("dynasty", F.col("dynasty"), "literal"),
        made("birthYear", F.lit(1500) + id % 400, "literal"),
        made("deathYear", F.lit(1560) + id % 400, "literal", id % 2 == 0),
        made("styleName", F.concat(F.lit("Style"), id), "literal", id % 3 != 0),
        made("hao", F.concat(F.lit("Hao"), id % 7), "literal", id % 5 == 0),
        made("biography", F.concat(F.lit("Life of "), "name"), "literal", id % 4 == 0),
        made("masterpiece", F.concat(F.lit("Work"), id), "literal", id % 6 == 0),
        made("extractionMethod", F.lit("known"), "literal", id % 2 == 0),
        made("belongsToSchool", F.col("school"), "iri"),
        iri("hasTeacher", third, id > 0),
        iri("hasFriend", F.pmod(id * 5 + 2, total), id % 4 == 0),
        iri("inheritedFrom", heir, heir != id),
        iri("hasFather", id - 1, id % 8 == 3),
    )
    own = p.select(F.col("name").alias("s"), F.explode(F.array_compact(facts)).alias("x")).select("s", "x.*")
    taught = p.where("id > 0 and id % 10 = 0").select(person_name(third).alias("s"), F.lit("hasStudent").alias("p"), F.col("name").alias("o"), F.lit("iri").alias("o_kind"))
    first = p.groupBy("school").agg(F.min("id").alias("id"))
    founded = first.select(person_name(F.col("id")).alias("s"), F.lit("hasFounder").alias("p"), F.col("school").alias("o"), F.lit("iri").alias("o_kind"))
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    about = F.array(
        made(TYPE, F.lit("SealEngravingSchool"), "iri"),
        made("schoolName", F.col("n_name"), "literal"),
        made("region", F.col("r_name"), "literal"),
        made("period", F.concat(F.lit("Period"), "n_regionkey"), "literal", F.col("n_nationkey") % 2 == 0),
    )
    schools = nations.select(F.concat(F.lit("school/"), "n_name").alias("s"), F.explode(F.array_compact(about)).alias("x")).select("s", "x.*")
    return own.unionByName(taught).unionByName(founded).unionByName(schools).distinct()


_NAME = "'Supplier#' || lpad(cast({0} as varchar), 9, '0')"

#: The same triples for the oracle: ``with <PRELUDE> select ... from t``.
PRELUDE = f"""
pp as (select s_suppkey as id, s_name as name, 'school/' || n_name as school, n_name as nation, r_name as dynasty, s_acctbal as acctbal, (select count(*) from supplier) as n
       from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
t as (
  select name as s, '{TYPE}' as p, 'HistoricPerson' as o, 'iri' as o_kind from pp
  union select name, 'personName', name, 'literal' from pp
  union select name, 'nativePlace', nation, 'literal' from pp
  union select name, 'dynasty', dynasty, 'literal' from pp
  union select name, 'birthYear', cast(1500 + id % 400 as varchar), 'literal' from pp
  union select name, 'deathYear', cast(1560 + id % 400 as varchar), 'literal' from pp where id % 2 = 0
  union select name, 'styleName', 'Style' || id, 'literal' from pp where id % 3 <> 0
  union select name, 'hao', 'Hao' || (id % 7), 'literal' from pp where id % 5 = 0
  union select name, 'biography', 'Life of ' || name, 'literal' from pp where id % 4 = 0
  union select name, 'masterpiece', 'Work' || id, 'literal' from pp where id % 6 = 0
  union select name, 'extractionMethod', 'known', 'literal' from pp where id % 2 = 0
  union select name, 'belongsToSchool', school, 'iri' from pp
  union select name, 'hasTeacher', {_NAME.format('(id // 3)')}, 'iri' from pp where id > 0
  union select name, 'hasFriend', {_NAME.format('((id * 5 + 2) % n)')}, 'iri' from pp where id % 4 = 0
  union select name, 'inheritedFrom', {_NAME.format('((id * 7 + 1) % n)')}, 'iri' from pp where (id * 7 + 1) % n <> id
  union select name, 'hasFather', {_NAME.format('(id - 1)')}, 'iri' from pp where id % 8 = 3
  union select {_NAME.format('(id // 3)')}, 'hasStudent', name, 'iri' from pp where id > 0 and id % 10 = 0
  union select {_NAME.format('min(id)')}, 'hasFounder', school, 'iri' from pp group by school
  union select 'school/' || n_name, '{TYPE}', 'SealEngravingSchool', 'iri' from nation
  union select 'school/' || n_name, 'schoolName', n_name, 'literal' from nation
  union select 'school/' || n_name, 'region', r_name, 'literal' from nation join region on n_regionkey = r_regionkey
  union select 'school/' || n_name, 'period', 'Period' || n_regionkey, 'literal' from nation where n_nationkey % 2 = 0)"""
