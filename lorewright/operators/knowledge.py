"""Views and set operators over triples(s, p, o, o_kind) and facts(subject, predicate, object, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TYPE = "rdf-syntax-ns#type"
# Predicates that describe a statement and are no edges.
METADATA = ("confidence", "extractedBy", "extractionMethod", "sourceText", "source", "dataSource", "wasDerivedFrom")
# Predicates whose object is a person.
PERSON_TO_PERSON = ("hasTeacher", "hasStudent", "hasFriend", "hasFather", "hasSon", "hasAncestor", "hasDescendant", "influencedBy", "inheritedFrom")
# Inverse pairs of relations.
INVERSES = {"education:studentOf": "education:teacherOf", "education:teacherOf": "education:studentOf", "kinship:fatherOf": "kinship:sonOf", "kinship:sonOf": "kinship:fatherOf"}


def person_info(triples: DataFrame) -> DataFrame:
    """One wide row per person: the largest value of each attribute, its schools and relation count.

    A single conditional aggregation instead of a join per attribute.
    """
    attributes = ("styleName", "hao", "birthYear", "deathYear", "nativePlace", "dynasty", "biography", "masterpiece")
    people = triples.where((F.col("p") == TYPE) & (F.col("o") == "HistoricPerson")).select("s")
    rows = triples.join(people, "s", "left_semi")
    cols = [F.max(F.when(F.col("p") == a, F.col("o"))).alias(a) for a in attributes]
    schools = F.array_join(F.array_sort(F.collect_set(F.when(F.col("p") == "belongsToSchool", F.col("o")))), ",").alias("schools")
    related = F.count_if(F.col("p").isin(*PERSON_TO_PERSON)).alias("relations")
    return rows.groupBy(F.col("s").alias("name")).agg(*cols, schools, related)


def relations(triples: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(name, relation, target) of all persons, or of the given relations."""
    rows = triples.where(F.col("p").isin(*(types or PERSON_TO_PERSON)) & (F.col("o_kind") == "iri"))
    return rows.select(F.col("s").alias("name"), F.col("p").alias("relation"), F.col("o").alias("target"))


def of_type(triples: DataFrame, kind: str) -> DataFrame:
    return triples.where((F.col("p") == TYPE) & (F.col("o") == kind)).select(F.col("s").alias("id")).distinct()


def schools(triples: DataFrame) -> DataFrame:
    """(school, name, region, period): one row per school, null where unknown."""
    rows = triples.join(of_type(triples, "SealEngravingSchool").withColumnRenamed("id", "s"), "s", "left_semi")
    pick = {"schoolName": "name", "region": "region", "period": "period"}
    return rows.groupBy(F.col("s").alias("school")).agg(*(F.max(F.when(F.col("p") == p, F.col("o"))).alias(n) for p, n in pick.items()))


def members(triples: DataFrame, founders: bool) -> DataFrame:
    """(school, member): who belongs to a school, with *founders* also who founded it."""
    kinds = ("belongsToSchool", "hasFounder", "foundedSchool") if founders else ("belongsToSchool",)
    return triples.where(F.col("p").isin(*kinds)).select(F.col("o").alias("school"), F.col("s").alias("member")).distinct()


def edges(triples: DataFrame) -> DataFrame:
    """(src, dst, relation): relations between nodes, without metadata, types and loops."""
    rows = triples.where((F.col("o_kind") == "iri") & ~F.contains(F.col("p"), F.lit("#")) & ~F.col("p").isin(*METADATA) & (F.col("s") != F.col("o")))
    return rows.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("p").alias("relation")).distinct()


def node_type(id: F.Column) -> F.Column:
    kinds = ("school", "place", "style", "era", "work", "evidence")
    out = F.lit("person")
    for k in reversed(kinds):
        out = F.when(F.startswith(id, F.lit(f"{k}/")), k).otherwise(out)
    return out


def nodes(edges_: DataFrame) -> DataFrame:
    """(id, node_type, school): school is the first of a node's relations by name that names a school."""
    ends = edges_.select(F.col("src").alias("id"), F.when(F.contains(F.col("relation"), F.lit("School")), F.col("relation")).alias("r"))
    ends = ends.unionByName(edges_.select(F.col("dst").alias("id"), F.lit(None).cast("string").alias("r")))
    return ends.groupBy("id").agg(F.min("r").alias("school")).select("id", node_type(F.col("id")).alias("node_type"), "school")


def induced(edges_: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among *keep* (id)."""
    return edges_.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "relation")


def neighbourhood(edges_: DataFrame, center: str) -> DataFrame:
    """Distinct neighbours of one node, in either direction."""
    out = edges_.where(F.col("src") == center).select(F.col("dst").alias("id"))
    return out.unionByName(edges_.where(F.col("dst") == center).select(F.col("src").alias("id"))).distinct()


def first_by_key(rows: DataFrame, keys: list[str], *order: F.Column | str) -> DataFrame:
    """The first row of each key by *order*."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_known(facts: DataFrame, known: DataFrame) -> DataFrame:
    """*facts* and the known ones that they lack by (subject, predicate, object)."""
    key = ["subject", "predicate", "object"]
    return facts.unionByName(known.join(facts.select(*key).distinct(), key, "left_anti").select(*facts.columns))


def with_inverses(facts: DataFrame, inverses: dict[str, str] | None = None) -> DataFrame:
    """*facts* and the inverse of each that has one and isn't there yet."""
    pairs = F.create_map(*(F.lit(x) for kv in (inverses or INVERSES).items() for x in kv))
    back = facts.select(F.col("object").alias("subject"), F.try_element_at(pairs, F.col("predicate")).alias("predicate"), F.col("subject").alias("object"), *(c for c in facts.columns if c not in ("subject", "predicate", "object")))
    key = ["subject", "predicate", "object"]
    back = back.where("predicate is not null")
    rest = [F.col(c) for c in facts.columns if c not in key]
    back = first_by_key(back, key, *rest) if rest else back.distinct()
    return facts.unionByName(back.join(facts.select(*key).distinct(), key, "left_anti").select(*facts.columns))


def valid_facts(facts: DataFrame, people: DataFrame, personal: tuple[str, ...] = PERSON_TO_PERSON) -> DataFrame:
    """Facts with both ends, whose subject is a known person and, for personal relations, the object too.

    Facts of method 'known' need no check. *people* is (name).
    """
    k = people.select("name").distinct()
    rows = facts.where("subject is not null and object is not null and subject <> '' and object <> ''")
    rows = rows.join(k.select(F.col("name").alias("subject"), F.lit(True).alias("__s")), "subject", "left").join(k.select(F.col("name").alias("object"), F.lit(True).alias("__o")), "object", "left")
    known = F.col("method") == "known"
    return rows.where(known | (F.col("__s").isNotNull() & (F.col("__o").isNotNull() | ~F.col("predicate").isin(*personal)))).select(*facts.columns)


def evidence(facts: DataFrame) -> DataFrame:
    """Per (subject, predicate): how many statements, and their distinct sources and methods, joined in order."""
    def joined(c: str) -> F.Column:
        return F.array_join(F.array_sort(F.collect_set(c)), "|")

    return facts.groupBy("subject", "predicate").agg(F.count("*").alias("statements"), joined("method").alias("methods"), joined("source").alias("sources"), F.round(F.max("confidence"), 6).alias("confidence"))
