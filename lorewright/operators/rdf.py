"""Writing typed records as triples, with the ontology that declares them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators.normalize import RDF, object_kind, predicate

TYPE = "rdf-syntax-ns#type"
COLUMNS = ("s", "p", "o", "o_kind", "o_dtype")
# Classes and the class each goes by.
CLASSES = {
    "Thing": None, "HistoricPerson": "Thing", "Location": "Thing", "Era": "Thing", "CalligraphyStyle": "Thing", "SealEngravingSchool": "Thing", "SealWork": "Thing",
    "Place": "Location", "TimePeriod": "Era", "Style": "CalligraphyStyle", "Work": "SealWork", "Evidence": "Thing",
}
# Attributes by class; all are strings but those in TYPED.
ATTRIBUTES = {
    "HistoricPerson": "personName hao birthYear deathYear birthYearString deathYearString nativePlace dynasty occupation officialRank appellation biography masterpiece".split(),
    "SealEngravingSchool": "schoolName period region description founder".split(),
    "CalligraphyStyle": "styleName styleDescription".split(),
    "Location": "placeName placeType".split(),
    "Era": "periodName startYear endYear".split(),
    "SealWork": "workTitle creationPeriod material".split(),
    "Evidence": "confidence sourceText extractionMethod".split(),
    "Thing": ["dataSource"],
}
TYPED = {"birthYear": "integer", "deathYear": "integer", "startYear": "integer", "endYear": "integer", "confidence": "float"}
# Relations by domain and range.
RELATIONS = {
    ("HistoricPerson", "HistoricPerson"): "hasFather hasSon hasAncestor hasDescendant fatherOf sonOf hasTeacher hasStudent inheritedFrom teacherOf studentOf hasFriend influencedBy friendOf brotherOf".split(),
    ("SealEngravingSchool", "HistoricPerson"): "hasFounder hasMember".split(),
    ("SealEngravingSchool", "SealEngravingSchool"): ["inheritsFrom"],
    ("HistoricPerson", "SealEngravingSchool"): "foundedSchool belongsToSchool".split(),
    ("HistoricPerson", "Location"): "locatedIn fromPlace".split(),
    ("HistoricPerson", "Era"): "livedInPeriod hasPeriod".split(),
    ("HistoricPerson", "CalligraphyStyle"): "hasStyle hasCalligraphyStyle".split(),
    ("HistoricPerson", "SealWork"): ["createdWork"],
    ("HistoricPerson", "Thing"): "ctextReference cbdbReference".split(),
    ("HistoricPerson", "string"): "ctextId cbdbId".split(),
    ("Evidence", "HistoricPerson"): ["extractedBy"],
    ("Evidence", "Thing"): ["source"],
    ("Thing", "Thing"): ["sameAs"],
}
# Pairs of relations that are each other's inverse.
INVERSE = (("hasFather", "hasSon"), ("hasTeacher", "hasStudent"), ("hasFounder", "hasMember"))
#: Of each kind of record: its class, the attribute of its name, and other columns with their attribute.
RECORDS = {
    "person": ("HistoricPerson", "personName", {"style": "styleName", "hao": "hao", "birth_year": "birthYear", "death_year": "deathYear", "place": "nativePlace", "dynasty": "dynasty", "occupation": "occupation", "rank": "officialRank", "appellation": "appellation", "biography": "biography", "masterpiece": "masterpiece"}),
    "school": ("SealEngravingSchool", "schoolName", {"period": "period", "region": "region", "founder": "founder", "description": "description"}),
    "style": ("CalligraphyStyle", "styleName", {"description": "styleDescription"}),
    "place": ("Location", "placeName", {"place_type": "placeType"}),
    "era": ("Era", "periodName", {"start_year": "startYear", "end_year": "endYear"}),
    "work": ("SealWork", "workTitle", {"creation_period": "creationPeriod", "material": "material"}),
}
#: A record's column that names another node: relation and direction.
LINKS = {"school": ("founder", "foundedSchool"), "work": ("creator", "createdWork")}


def ontology(spark: SparkSession) -> DataFrame:
    """(name, kind, domain, range) of classes, attributes and relations."""
    rows = [(c, "class", up, None) for c, up in CLASSES.items()]
    rows += [(a, "datatype", c, TYPED.get(a, "string")) for c, names in ATTRIBUTES.items() for a in names]
    rows += [(r, "object", d, g) for (d, g), names in RELATIONS.items() for r in names]
    return spark.createDataFrame(rows, "name string, kind string, domain string, range string")


def inverses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*INVERSE, *((b, a) for a, b in INVERSE)], "p string, inv_p string")


def node(kind: str, name: F.Column) -> F.Column:
    """A node's local name: persons by their name, others ``kind/name``; spaces become underscores."""
    t = F.replace(F.trim(name), F.lit(" "), F.lit("_"))
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    named = t if kind == "person" else F.concat(F.lit(f"{kind}/"), t)
    return F.when(blank, "unknown" if kind == "person" else f"unknown_{kind}").otherwise(named)


def _triple(s: F.Column, p: str, o: F.Column, kind: str, dtype: str | None = None) -> F.Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dtype).cast("string").alias("o_dtype"))


def records(rows: DataFrame, kind: str) -> DataFrame:
    """Triples of records of a kind (column name, and any of the kind's columns); null and empty values give none."""
    cls, label, columns = RECORDS[kind]
    s = node(kind, F.col("name"))
    out = [_triple(s, TYPE, F.lit(cls), "iri"), _triple(s, label, F.col("name"), "literal")]
    for c, attribute in columns.items():
        if c in rows.columns:
            value = F.col(c).cast("string")
            out.append(F.when(F.coalesce(value, F.lit("")) != "", _triple(s, attribute, F.col(c), "literal", TYPED.get(attribute))))
    link = LINKS.get(kind)
    if link and link[0] in rows.columns:
        out.append(F.when(F.coalesce(F.col(link[0]), F.lit("")) != "", _triple(node("person", F.col(link[0])), link[1], s, "iri")))
    return rows.select(F.explode(F.array_compact(F.array(*out))).alias("t")).select("t.*").distinct()


def same_as(rows: DataFrame) -> DataFrame:
    """Triples of (name, uri): a person and the same one elsewhere."""
    return rows.where("uri <> ''").select(node("person", F.col("name")).alias("s"), F.lit("sameAs").alias("p"), F.col("uri").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype")).distinct()


def statements(facts: DataFrame) -> DataFrame:
    """Triples of facts (subject, predicate, object): relations point to nodes, attributes hold text."""
    p = predicate(F.col("predicate"), RDF)
    relation_names = [r for names in RELATIONS.values() for r in names]
    kind = object_kind(F.col("predicate"))
    target = reduce(lambda out, k: F.when(kind == k, node(k, F.col("object"))).otherwise(out), ("school", "place", "era", "style", "work"), node("person", F.col("object")))
    is_relation = p.isin(relation_names)
    return facts.select(
        node("person", F.col("subject")).alias("s"), p.alias("p"), F.when(is_relation, target).otherwise(F.col("object")).alias("o"),
        F.when(is_relation, "iri").otherwise("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"),
    ).distinct()


def evidence(facts: DataFrame) -> DataFrame:
    """Triples about the statements: a node per (subject, predicate, object) with source, method and confidence."""
    key = F.concat_ws("_", "subject", "predicate", "object")
    s = node("evidence", key)
    parts = F.array(
        _triple(s, TYPE, F.lit("Evidence"), "iri"),
        F.when(F.coalesce("evidence", F.lit("")) != "", _triple(s, "sourceText", F.col("evidence"), "literal")),
        _triple(s, "confidence", F.col("confidence").cast("float"), "literal", "float"),
        _triple(s, "extractionMethod", F.col("method"), "literal"),
        F.when(F.coalesce("chapter", F.lit("")) != "", _triple(s, "source", F.col("chapter"), "literal")),
        _triple(s, "extractedBy", node("person", F.col("subject")), "iri"),
    )
    return facts.select(F.explode(F.array_compact(parts)).alias("t")).select("t.*").distinct()


def graph(*parts: DataFrame) -> DataFrame:
    """The set of all triples of *parts*."""
    return reduce(lambda a, b: a.unionByName(b), (p.select(*COLUMNS) for p in parts)).distinct()
