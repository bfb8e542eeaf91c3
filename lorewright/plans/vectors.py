"""Queries of vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.operators import vectors as V
from lorewright.plans.registry import query, table

_UNIT = "u as (select vec_id as id, list_transform(embedding, lambda x: x / (sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * y))) + 1e-10)) as v from embeddings)"
_TOP = f"{_UNIT}, s as (select id, list_dot_product(v, (select v from u where id = 0)) as score from u)"


def _index(spark, sf_dir):
    return V.index(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(f"with {_UNIT} select id, pos, round(x, 6) as x from (select id, unnest(v) as x, unnest(range(0, len(v))) as pos from u)")
def vector_index_build(spark, sf_dir):
    return _index(spark, sf_dir).select("id", F.posexplode("unit").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"with {_TOP} select id, round(score, 6) as score from (select * from s order by score desc, id limit 5) where score > 0")
def vector_topk(spark, sf_dir):
    i = _index(spark, sf_dir)
    return V.search(i, i.where("id = 0")).select("id", F.round("score", 6).alias("score"))


@query(f"with {_TOP} select id, round(score, 6) as score from (select * from s order by score desc, id limit 5) where score >= 0.3")
def vector_topk_threshold(spark, sf_dir):
    i = _index(spark, sf_dir)
    return V.retrieve(i, i.where("id = 0")).select("id", F.round("score", 6).alias("score"))


@query(
    f"""with {_TOP}, b as (select id, score, row_number() over (order by score desc, id) as r from s order by score desc, id limit 3)
select string_agg('[' || r || '] ' || source || ': ' || substr(text, 1, 200), chr(10) order by r) as context from b join documents on doc_id = id where score >= 0.25"""
)
def rag_context(spark, sf_dir):
    """The best entries' first 200 characters as one context text."""
    from pyspark.sql import Window

    i = _index(spark, sf_dir)
    best = V.search(i, i.where("id = 0"), V.FALLBACK_TOP)
    best = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).where(F.col("score") >= V.FALLBACK_THRESHOLD)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    rows = best.join(d, "id").select("r", F.concat(F.lit("["), F.col("r").cast("string"), F.lit("] "), "source", F.lit(": "), F.substring("text", 1, 200)).alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("context"))


_HASH = ", ".join(f"cast('0x' || substr(h, {1 + 4 * k}, 4) as bigint) / 65536.0 - 0.5" for k in range(16))


@query(f"with h as (select s_suppkey as id, sha256(s_name) as h from supplier), r as (select id, [{_HASH}] as v from h) select id, round(v[1] / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-10), 5) as x0, round(v[16] / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-10), 5) as x15 from r")
def hash_embedding(spark, sf_dir):
    v = V.hash_embedding(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.round(v[0], 5).alias("x0"), F.round(v[15], 5).alias("x15"))
