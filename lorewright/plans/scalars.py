"""Queries of scalar functions: JSON, numbers, arrays, vectors' arithmetic, streaming counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.plans.registry import query, table


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_safe_parse(spark, sf_dir):
    """The object between the first and last brace of a noisy answer; null where it can't be read."""
    noisy = F.concat(F.lit("answer: "), "props", F.lit(" -- end"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(T.json_span(noisy), "k bigint")["k"].alias("k"))


@query("select event_id, case when event_id % 2 = 0 then cast(json_extract(props, '$.k') as bigint) else event_id end as first_value, 1 + event_id % 2 as n from events")
def json_scalar_or_list(spark, sf_dir):
    """A field that is a single value in some records and a list in others."""
    k = F.get_json_object("props", "$.k")
    listed = F.concat(F.lit('{"Alias": ['), F.col("event_id").cast("string"), F.lit(", "), k, F.lit("]}"))
    doc = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"Alias": '), k, F.lit("}"))).otherwise(listed)
    values = T.as_list(doc, "$.Alias", "bigint")
    return table(spark, sf_dir, "events").select("event_id", values[0].alias("first_value"), F.size(values).cast("long").alias("n"))


@query("select o_orderkey as id, case when o_orderkey % 3 = 0 then null else cast(o_custkey as integer) end as year from orders")
def safe_int_cast(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c."), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.safe_int(raw).alias("year"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 6) as norm from embeddings")
def l2_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(T.norm(F.col("embedding")), 6).alias("norm"))


@query("select p_partkey as id, least(p_size / 4.0, 10.0) as score, upper(p_name) as upper_name, length(p_name) as n, string_split(p_name, ' ')[-1] as last_word, starts_with(p_name, 'red') as red from part")
def scalar_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.least(F.col("p_size") / 4.0, F.lit(10.0)).alias("score"), F.upper("p_name").alias("upper_name"), F.length("p_name").cast("long").alias("n"),
        F.element_at(F.split("p_name", " "), -1).alias("last_word"), F.startswith("p_name", F.lit("red")).alias("red"),
    )


@query("select user_id, event_type, count(*) as n, round(sum(value), 4) as total from (select distinct event_id, user_id, event_type, value from events) group by all")
def event_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").dropDuplicates(["event_id"])
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
