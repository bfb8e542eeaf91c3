"""Splitting a corpus file into entries by marker lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_entries(
    files: DataFrame, file: str, text: str, chapter: str = r"^(卷[一二三四五六七八九十百]+)\s*$", title: str = r"^○(.+)$", first: tuple[str, str] = ("序", "钱陆灿序")
) -> DataFrame:
    """(file, section_idx long, chapter, title, content) of every non-empty entry.

    A line that matches *chapter* or *title* sets what group 1 holds for the lines after it; other
    lines are joined without line ends. Windows run over a file's lines only, and a file's text has
    been one value before.
    """
    lines = files.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    at = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_chapter, is_title = F.col("line").rlike(chapter), F.col("line").rlike(title)
    marks = lines.withColumns(
        {
            "part": F.sum(F.when(is_chapter | is_title, 1).otherwise(0)).over(at),
            "chapter": F.coalesce(F.last(F.when(is_chapter, F.regexp_extract("line", chapter, 1)), ignorenulls=True).over(at), F.lit(first[0])),
            "title": F.coalesce(F.last(F.when(~is_chapter & is_title, F.trim(F.regexp_extract("line", title, 1))), ignorenulls=True).over(at), F.lit(first[1])),
        }
    )
    body = marks.where(~is_chapter & ~is_title).groupBy("file", "part", "chapter", "title")
    entries = body.agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    entries = entries.withColumn("content", F.trim(F.array_join(F.transform("x", lambda r: F.trim(r["line"])), ""))).where("content <> ''")
    n = F.row_number().over(Window.partitionBy("file").orderBy("part")).cast("long") - 1
    return entries.select("file", n.alias("section_idx"), "chapter", "title", "content")
