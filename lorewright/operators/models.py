"""Answers of models: a caller's model in Arrow batches, its JSON read with care, rules where it fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import json_span

ENTITY_TYPES = ("PERSON", "PLACE", "PERIOD", "STYLE", "SCHOOL")
# A model sees so many characters of a passage, and what it doesn't say counts so much.
MOST_CHARS, DEFAULT_CONFIDENCE = 1500, 0.85
_ENTITIES = "struct<entities:array<struct<name:string,type:string,confidence:double,evidence:string>>>"
_RELATIONS = "struct<relations:array<struct<subject:string,predicate:string,object:string,confidence:double,evidence:string>>>"


def ask(rows: DataFrame, prompt: Column, model: Callable[[list[str]], list[str | None]], name: str = "answer") -> DataFrame:
    """*rows* with a column of a model's answers to *prompt*; a batch that fails has null answers.

    *model* maps a list of prompts to a list of answers in a Python worker.
    """
    kept = rows.columns
    kinds = [f.dataType.simpleString() for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = b.column(0).to_pylist()
            try:
                got = model(prompts)
            except Exception:  # the caller's model: the rules take over for this batch
                got = [None] * len(prompts)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.string())], names=[f"c{i}" for i in range(len(kept) + 1)])

    asked = rows.select(prompt.alias("p"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(kept)))
    out = asked.mapInArrow(run, ", ".join(f"c{i} {k}" for i, k in enumerate([*kinds, "string"])))
    return out.toDF(*kept, name)


def seen(text: Column) -> Column:
    """What a model is shown of a passage; the rules read all of it."""
    return F.substring(text, 1, MOST_CHARS)


def entities(answers: DataFrame, id: str, answer: str, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """(id, name, etype, confidence, evidence): the first of each (name, type) of an answer that can be read."""
    items = F.from_json(json_span(F.col(answer)), _ENTITIES)["entities"]
    rows = answers.select(F.col(id).alias("id"), F.posexplode(items).alias("pos", "x"))
    rows = rows.select("id", "pos", F.trim("x.name").alias("name"), F.upper(F.trim("x.type")).alias("etype"), F.coalesce("x.confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"), F.coalesce("x.evidence", F.lit("")).alias("evidence"))
    rows = rows.where((F.col("name") != "") & F.col("etype").isin(*types))
    first = rows.groupBy("id", "name", "etype").agg(F.min(F.struct("pos", "confidence", "evidence")).alias("f"))
    return first.select("id", "name", "etype", "f.confidence", "f.evidence")


def relations(answers: DataFrame, id: str, answer: str, known: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, confidence): of answers that can be read, statements about *known* (name)."""
    items = F.from_json(json_span(F.col(answer)), _RELATIONS)["relations"]
    rows = answers.select(F.col(id).alias("id"), F.explode(items).alias("x"))
    rows = rows.select("id", F.trim("x.subject").alias("subject"), F.trim("x.predicate").alias("predicate"), F.trim("x.object").alias("object"), F.coalesce("x.confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"))
    rows = rows.where("subject <> '' and predicate <> '' and object <> ''").join(known.select(F.col("name").alias("subject")).distinct(), "subject", "left_semi")
    return rows.groupBy("id", "subject", "predicate", "object").agg(F.max("confidence").alias("confidence"))


def with_rules(found: DataFrame, by_rules: DataFrame, id: str = "id") -> DataFrame:
    """A model's rows, and the rules' rows of those ids for which the model has none."""
    return found.unionByName(by_rules.join(found.select(id).distinct(), id, "left_anti").select(*found.columns))
