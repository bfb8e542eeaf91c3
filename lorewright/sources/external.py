"""Files and staged answers of other systems: corpus text, registers' JSON, analysis output, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions.text import safe_int

PERSON = "struct<BasicInfo:struct<PersonId:string,ChName:string,YearBirth:string,YearDeath:string,Dynasty:string,IndexAddr:string>,PersonAliases:struct<Alias:string>,PersonAddresses:struct<Address:string>,PersonPostings:struct<Posting:string>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """(raw): one staged JSON answer per line."""
    return spark.read.text(path).select(F.col("value").alias("raw"))


def _each(json: str, element: str):
    """The items of a field that holds one object, a list of them, or nothing."""
    raw = F.col(json)
    as_list = F.from_json(raw, f"array<{element}>")
    one = F.from_json(raw, element)
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), as_list).when(raw.isNotNull() & (raw != ""), F.array(one)).otherwise(F.array().cast(f"array<{element}>"))


def register_persons(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """(external_id, name, style, hao, birth_year int, death_year int, place, dynasty, posts).

    Answers that can't be read, and records without id or name, are dropped. Years that aren't
    numbers are null. style and hao are the first aliases of those types.
    """
    p = F.from_json(F.get_json_object(raw, "$.Package.PersonAuthority.PersonInfo.Person"), PERSON)
    rows = answers.select(p.alias("p")).where("p.BasicInfo.PersonId <> '' and p.BasicInfo.ChName <> ''")
    rows = rows.select("p.BasicInfo.*", F.col("p.PersonAliases.Alias").alias("al"), F.col("p.PersonAddresses.Address").alias("ad"), F.col("p.PersonPostings.Posting").alias("po"))
    rows = rows.withColumns({"al": _each("al", "struct<AliasType:string,AliasName:string>"), "ad": _each("ad", "struct<AddrName:string>"), "po": _each("po", "struct<OfficeName:string>")})

    def alias(kind: str):
        return F.try_element_at(F.filter("al", lambda x: x["AliasType"] == kind), F.lit(1))["AliasName"]

    return rows.select(
        F.col("PersonId").alias("external_id"), F.col("ChName").alias("name"), alias("字").alias("style"), alias("號").alias("hao"), safe_int(F.col("YearBirth")).alias("birth_year"),
        safe_int(F.col("YearDeath")).alias("death_year"), F.coalesce(F.try_element_at("ad", F.lit(1))["AddrName"], "IndexAddr").alias("place"), F.col("Dynasty").alias("dynasty"),
        F.array_join(F.transform("po", lambda x: x["OfficeName"]), "、").alias("posts"),
    )


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_index(vectors: DataFrame, path: str, model: str) -> None:
    """Vectors with the name of the model that made them."""
    vectors.withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The vectors that *model* made; another model's aren't comparable and give no rows."""
    return spark.read.parquet(path).where(F.col("model") == model).drop("model")
