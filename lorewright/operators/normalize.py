"""Aliases, predicates and school names brought to one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import cascade

# Free predicates and their schema names.
SCHEMA = {
    "styleName": "attribute:hasStyleName", "hao": "attribute:hasHao", "fatherOf": "kinship:fatherOf", "sonOf": "kinship:sonOf",
    "ancestorOf": "kinship:ancestorOf", "descendantOf": "kinship:descendantOf", "teacherOf": "education:teacherOf", "studentOf": "education:studentOf",
    "friendOf": "social:friendOf", "influencedBy": "social:influencedBy", "foundedSchool": "school:founderOf", "belongsToSchool": "school:belongsTo",
    "nativePlace": "attribute:nativePlace", "fromPlace": "attribute:nativePlace", "dynasty": "attribute:dynasty", "appellation": "attribute:hasAppellation",
    "inheritedFrom": "education:inheritedFrom",
}
# Schema names (and older free ones) and their RDF properties.
RDF = {
    "kinship:fatherOf": "hasFather", "kinship:sonOf": "hasSon", "kinship:ancestorOf": "hasAncestor", "kinship:descendantOf": "hasDescendant",
    "education:teacherOf": "hasStudent", "education:studentOf": "hasTeacher", "education:inheritedFrom": "inheritedFrom", "social:friendOf": "hasFriend",
    "social:influencedBy": "influencedBy", "school:founderOf": "hasFounder", "school:belongsTo": "belongsToSchool", "attribute:hasStyleName": "styleName",
    "attribute:hasHao": "hao", "attribute:hasAppellation": "appellation", "attribute:nativePlace": "nativePlace", "attribute:dynasty": "dynasty",
    "fatherOf": "hasFather", "sonOf": "hasSon", "teacherOf": "hasStudent", "studentOf": "hasTeacher", "friendOf": "hasFriend",
    "influencedBy": "influencedBy", "foundedSchool": "hasFounder", "belongsToSchool": "belongsToSchool", "nativePlace": "nativePlace",
    "fromPlace": "locatedIn", "inheritedFrom": "inheritedFrom",
}
# Kind of a relation's object; persons by default.
OBJECT_KIND = {"hasFounder": "school", "belongsToSchool": "school", "locatedIn": "place", "livedInPeriod": "era", "hasPeriod": "era", "hasStyle": "style", "hasCalligraphyStyle": "style", "createdWork": "work"}
# Names of known schools and the one each goes by.
KNOWN_SCHOOLS = {
    "浙派": "浙派", "皖派": "皖派", "漳海派": "漳海派", "莆田派": "莆田派", "婁東派": "婁東派", "娄东派": "婁東派",
    "吳門印派": "吳門印派", "吴门印派": "吳門印派", "吴门派": "吳門印派", "吳門派": "吳門印派",
}
# Simplified characters of school names and their traditional forms.
TRADITIONAL = {
    "吴": "吳", "门": "門", "娄": "婁", "东": "東", "闽": "閩", "国": "國", "会": "會", "师": "師", "长": "長", "号": "號", "庐": "廬", "庆": "慶", "齐": "齊",
    "苏": "蘇", "兴": "興", "学": "學", "华": "華", "风": "風", "马": "馬", "云": "雲", "凤": "鳳", "显": "顯", "变": "變", "观": "觀", "记": "記",
}
# Words in a name that tell its school, in the order of the search.
SCHOOL_KEYWORDS = {
    "浙派": ("浙", "錢塘", "杭州"), "皖派": ("皖", "婺源", "徽州", "新安", "休寧"), "吳門印派": ("吳門", "蘇州"), "吳門": ("吳門", "蘇州"),
    "漳海派": ("漳海", "漳浦"), "莆田派": ("莆田", "福州"), "婁東派": ("婁東",), "秦漢印風": ("秦漢",),
}


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of a key in a small fixed table, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def predicate(raw: Column, pairs: dict[str, str] = SCHEMA) -> Column:
    """A predicate's normal form; an unknown one trimmed."""
    return F.coalesce(lookup(pairs, F.trim(raw)), F.trim(raw))


def school(name: Column, known: dict[str, str] = KNOWN_SCHOOLS) -> Column:
    """The name that a school goes by; also for simplified characters; others unchanged."""
    return F.coalesce(lookup(known, name), lookup(known, F.translate(name, "".join(TRADITIONAL), "".join(TRADITIONAL.values()))), name)


def is_school(name: Column, known: dict[str, str] = KNOWN_SCHOOLS) -> Column:
    return lookup(known, name).isNotNull() | lookup(known, F.translate(name, "".join(TRADITIONAL), "".join(TRADITIONAL.values()))).isNotNull()


def infer_school(name: Column, keywords: dict[str, tuple[str, ...]] = SCHOOL_KEYWORDS) -> Column:
    """The first school one of whose keywords is in a name; null if none is, or for a null name."""
    return cascade(name, [(words, label) for label, words in keywords.items()], None)


def object_kind(pred: Column) -> Column:
    return F.coalesce(lookup(OBJECT_KIND, predicate(pred, RDF)), F.lit("person"))


def standard_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names(name, etype) with normalized and confidence: 1 for a listed alias or standard name, else 0.5.

    aliases is (alias, standard, etype); types PERIOD and STYLE pass at 1.
    """
    a = aliases.select(F.col("alias").alias("__a"), "standard", F.col("etype").alias("__t")).unionByName(aliases.select(F.col("standard").alias("__a"), "standard", F.col("etype").alias("__t"))).groupBy("__a", "__t").agg(F.min("standard").alias("standard"))
    rows = names.join(a, (F.trim("name") == F.col("__a")) & (F.col("etype") == F.col("__t")), "left")
    sure = F.col("standard").isNotNull() | F.col("etype").isin("PERIOD", "STYLE")
    return rows.select(*names.columns, F.coalesce("standard", F.trim("name")).alias("normalized"), F.when(sure, 1.0).otherwise(0.5).alias("confidence"))


def all_aliases(aliases: DataFrame) -> DataFrame:
    """(standard, aliases): each standard name's aliases by name, joined by commas."""
    return aliases.groupBy("standard").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))
