"""A training corpus from ``documents``: language ID, line dedup, near-duplicate join, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm import jaccard, langid, linededup, mixing, packing
from lorewright.store import drop_stored, n_stored, stored

#: A document whose most likely language has a smaller posterior is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or of which no language is likely, go."""
    out = langid.identify(docs, carry=tuple(docs.columns))
    out = out.toDF("id", "held_out", *(f"c{i}" for i in range(len(docs.columns))), "lang_pred", "posterior")
    out = out.where((F.col("lang_pred") != "und") & (F.col("posterior") >= LEAST_SCORE))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that earlier documents have; documents of which nothing is left go."""
    out = linededup.line_dedup(docs, carry=tuple(docs.columns), passages=True)
    out = out.toDF("id", "left_text", "n_lines", "n_removed", "kept_in", *(f"c{i}" for i in range(len(docs.columns))))
    out = out.where((F.col("n_removed") == 0) | (F.trim("left_text") != ""))
    put = {"text": F.col("left_text"), "n_chars": F.length("left_text")}
    return out.select(*(put.get(f.name, F.col(f"c{i}")).cast(f.dataType).alias(f.name) for i, f in enumerate(docs.schema)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates."""
    found = jaccard.near_duplicates(docs)
    gone = stored(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(_hinted(gone), "doc_id", "left_anti").select(*docs.columns)
    many = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    many = stored(many, "repeated")
    if many.isEmpty():
        return kept
    # Of repeated rows of a document that stays, one; they are one per task before they are dealt.
    row = F.struct(*docs.columns)
    once = kept.join(_hinted(many), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), row.alias("row"), F.xxhash64(*docs.columns).alias("mark"))
    once = once.groupBy("id").agg(F.min_by("row", "mark").alias("row")).select("row.*")
    return kept.join(_hinted(many), "doc_id", "left_anti").select(*docs.columns).unionAll(once)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the one at a source's edge whole.

    Documents that the mix takes no word of, which include those without words, go.
    """
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("whole"))
    out = mixing.mix(rows, carry=("whole",)).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return out.select("whole", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("whole.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full sequences."""
    return packing.pack(docs)


def _hinted(ids: DataFrame) -> DataFrame:
    """Written ids, to be broadcast if they are few, else dealt."""
    return ids.hint("broadcast" if ids.count() <= jaccard.BROADCAST_IDS else "shuffle_hash")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language ID, line dedup, the join and packing can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again; all other tables go when the next is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = n_stored()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_stored(spark, first, keep=docs)
    return docs
