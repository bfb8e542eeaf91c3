"""From corpus text to a graph: the whole chain as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import normalize_punctuation, normalize_whitespace
from lorewright.operators import knowledge, normalize, rdf
from lorewright.operators.entries import split_entries
from lorewright.operators.relations import RULES, Rule, extract_relations


def preprocess(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Entries of files after their white space and punctuation are normal."""
    clean = normalize_punctuation(normalize_whitespace(F.col(text)))
    return split_entries(files.select(F.col(file), clean.alias(text)), file, text)


def rule_facts(entries: DataFrame, known: list[str] | DataFrame, aliases: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Facts by rules: names by their standard, predicates in schema form, inverses added.

    *aliases* is (alias, standard, etype) of persons. Objects are taken for persons only where the
    predicate relates persons. Columns: subject, predicate, object, confidence, method, evidence, chapter.
    """
    found = extract_relations(entries, known, rules)
    a = aliases.where("etype = 'PERSON'").groupBy("alias").agg(F.min("standard").alias("standard"))
    rows = found.join(a.toDF("subject", "__s"), "subject", "left").withColumn("subject", F.coalesce("__s", "subject"))
    rows = rows.join(a.toDF("object", "__o"), "object", "left")
    p = normalize.predicate(F.col("predicate"))
    personal = F.startswith(p, F.lit("education:")) | F.startswith(p, F.lit("kinship:")) | F.startswith(p, F.lit("social:"))
    rows = rows.select("subject", p.alias("predicate"), F.when(personal, F.coalesce("__o", "object")).otherwise(F.col("object")).alias("object"), "confidence", F.lit("rule").alias("method"), "evidence", "chapter")
    first = knowledge.first_by_key(rows.where("subject <> object"), ["subject", "predicate", "object"], F.desc("confidence"), "chapter", "evidence")
    return knowledge.with_inverses(first)


def build(entries: DataFrame, people: DataFrame, aliases: DataFrame, known_facts: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(facts, triples) of a corpus: rules, known facts that are missing, validation, writing.

    *people* is the dictionary of persons (name), of any size.
    """
    facts = knowledge.merge_known(rule_facts(entries, people, aliases, rules), known_facts)
    ends = known_facts.select(F.explode(F.array("subject", "object")).alias("name"))
    standard = people.unionByName(ends).unionByName(aliases.select(F.col("standard").alias("name"))).distinct()
    personal = tuple(p for p in normalize.RDF if p.startswith(("education:", "kinship:", "social:")))
    facts = knowledge.valid_facts(facts, standard, personal)
    relation = F.col("predicate").isin(*personal)
    persons = facts.select("subject").unionByName(facts.where(relation).select(F.col("object").alias("subject"))).distinct().withColumnRenamed("subject", "name")
    schools = facts.where(normalize.object_kind(F.col("predicate")) == "school").where("object <> ''").select(F.col("object").alias("name")).distinct()
    parts = [rdf.records(persons, "person"), rdf.records(schools, "school"), rdf.statements(facts), rdf.evidence(facts)]
    return facts, rdf.graph(*parts)
