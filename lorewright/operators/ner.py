"""Dictionary and pattern entity recognition.

Longest match from left to right: at a place the longest dictionary word is taken and the scan goes
on behind it. A dictionary of checked size becomes one automaton per task; a larger one is joined
by n-grams and the matches are folded in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dictionary with at most so many characters goes to every task.
AUTOMATON_CHARS = 8 << 20
_MATCH = "array<struct<start:int,word:string,etype:string>>"


def dictionary_entities(docs: DataFrame, id: str, text: str, words: DataFrame, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """(id, start int, word, etype) for *words* (word, etype); starts count characters from 0.

    Of a word listed with several types the first by name counts.
    """
    d = words.where("word <> ''").groupBy("word").agg(F.min("etype").alias("etype"))
    size = d.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if size > limit:
        return _by_ngrams(rows, d)
    entries = [(r.word, r.etype) for r in d.collect()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w, t in entries:
            machine.add_word(w, (w, t))
        if entries:
            machine.make_automaton()
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                hits = sorted(((e - len(w) + 1, -len(w), w, k) for e, (w, k) in machine.iter(t)), key=lambda x: x[:2]) if entries else []
                out, at = [], 0
                for start, n, w, k in hits:
                    if start >= at:
                        out.append({"start": start, "word": w, "etype": k})
                        at = start - n
                found.append(out)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("word", pa.string()), ("etype", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "m"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, m {_MATCH}").select("id", F.explode("m").alias("m")).select("id", "m.*")


def _by_ngrams(rows: DataFrame, d: DataFrame) -> DataFrame:
    """The same by an equi-join on n-grams and a fold over each text's matches."""
    lengths = [r[0] for r in d.select(F.length("word")).distinct().collect()]
    grams = rows.select("id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("start")).select("id", "start", F.explode(F.array(*(F.expr(f"substring(text, start + 1, {n})") for n in sorted(lengths)))).alias("word"))
    hits = grams.join(d, "word").distinct()
    order = F.array_sort(F.collect_list(F.struct("start", (-F.length("word")).alias("n"), "word", "etype")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_MATCH).alias("m"))
    step = F.aggregate(
        order,
        zero,
        lambda a, x: F.when(
            x["start"] >= a["at"],
            F.struct((x["start"] - x["n"]).alias("at"), F.concat(a["m"], F.array(F.struct(x["start"].alias("start"), x["word"].alias("word"), x["etype"].alias("etype")))).alias("m")),
        ).otherwise(a),
        lambda a: a["m"],
    )
    return hits.groupBy("id").agg(step.alias("m")).select("id", F.explode("m").alias("m")).select("id", "m.*")


# Words of periods, in the order of the search, and of styles; what is found counts PATTERN_CONFIDENCE.
PERIODS = (
    "嘉靖", "萬曆", "天啟", "崇禎", "康熙", "雍正", "乾隆", "光緒", "咸豐", "道光", "宣統", "順治", "同治", "明初", "明末", "清初", "明中期", "明末清初",
    "明代", "清代", "近代", "庚午", "辛未", "壬子", "丁亥", "戊申", "甲申", "辛亥", "丙子", "丁丑", "乙酉", "癸丑",
)
STYLES = (
    "元朱文", "白文", "朱文", "朱砂文", "秦漢印風", "文人篆刻", "猛利", "和平", "離奇", "錯落", "婉秀", "纖弱", "蒼勁", "質樸",
    "剛健", "婀娜", "古拙", "秀逸", "雄渾", "清新", "典雅", "洗鍊",
)
PATTERN_CONFIDENCE = 0.90


def periods_and_styles(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, etype, name, n long, confidence): periods, each by itself so that they may overlap, and styles, which don't.

    Null texts have none.
    """
    patterns = {f"PERIOD {p}": p for p in PERIODS} | {"STYLE": "|".join(STYLES)}
    found = pattern_entities(docs, id, text, patterns)
    return found.select("id", F.substring_index("label", " ", 1).alias("etype"), F.col("word").alias("name"), "n", F.lit(PATTERN_CONFIDENCE).alias("confidence"))


def pattern_entities(docs: DataFrame, id: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(id, label, word, n long): matches of each pattern by itself, so different ones may overlap."""
    found = F.array(*(F.struct(F.lit(k).alias("label"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("words")) for k, p in patterns.items()))
    each = docs.select(F.col(id).alias("id"), F.explode(found).alias("x")).select("id", "x.label", F.explode("x.words").alias("word"))
    return each.groupBy("id", "label", "word").agg(F.count("*").alias("n"))


def group_normalized(entities: DataFrame) -> DataFrame:
    """(normalized, etype, originals): the distinct originals in order of their first place, joined by commas."""
    first = entities.groupBy("normalized", "etype", "original").agg(F.min("place").alias("place"))
    return first.groupBy("normalized", "etype").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "original"))), lambda x: x["original"]), ",").alias("originals"))
