"""Rule-based relation extraction from text, driven by a table of rules.

A rule is a pattern; in each of its matches the known names are found (longest first, without
overlap, then by place), and the rule says what relation they are in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.operators.ner import AUTOMATON_CHARS
from lorewright.store import stored

_N = "[一-龥]"


@dataclass(frozen=True)
class Rule:
    """pair: first name predicate second name; name: first name and a value cut from the match."""

    pattern: str
    predicate: str
    confidence: float
    kind: str = "pair"
    inverse: str | None = None


# The patterns, predicates and confidences of the rules, in their order.
RULES = (
    Rule(f"{_N}{{2,8}}繼{_N}{{2,8}}起", "studentOf", 0.93, "pair", "teacherOf"),
    Rule(f"{_N}{{2,8}}[，,\\s]*(?:字|號|一字|亦稱)[^一-龥\n]{{0,10}}", "styleName", 0.95, "style"),
    Rule(f"{_N}{{2,8}}得之{_N}{{2,8}}", "studentOf", 0.91, "pair", "teacherOf"),
    Rule(f"{_N}{{2,8}}[於從]{_N}{{2,8}}(?:師友間|討論|得凍石)", "studentOf", 0.90, "pair", "teacherOf"),
    Rule(f"自?{_N}{{2,8}}開(?:之|[之派]{_N}{{0,10}}派?)", "foundedSchool", 0.90, "school_after"),
    Rule(f"{_N}{{2,8}}開{_N}{{2,8}}派", "foundedSchool", 0.88, "school"),
    Rule(f"{_N}{{2,8}}[之為是屬]{_N}{{2,6}}人", "nativePlace", 0.90, "place"),
    Rule(f"{_N}{{2,8}}(?:屬|為){_N}{{2,6}}派", "belongsToSchool", 0.88, "school_or_blank"),
    Rule(f"{_N}{{2,8}}(?:之傳|私淑|之弟子){_N}{{2,8}}", "studentOf", 0.90, "pair", "teacherOf"),
    Rule(f"{_N}{{2,8}}從{_N}{{2,8}}(?:學|治|受學)", "studentOf", 0.90, "pair", "teacherOf"),
    Rule(f"{_N}{{2,8}}得{_N}{{2,8}}(?:之)?傳", "studentOf", 0.90, "pair", "teacherOf"),
    Rule(f"嫡傳則獨有{_N}{{2,8}}(?:父子|兄弟|兄弟子)", "studentOf", 0.92, "title", "teacherOf"),
    Rule(f"{_N}{{2,8}}師{_N}{{2,8}}|{_N}{{2,8}}受業於{_N}{{2,8}}", "studentOf", 0.88, "pair", "teacherOf"),
    Rule(f"{_N}{{2,8}}(?:仿|法|摹|摹倣){_N}{{2,8}}", "influencedBy", 0.80, "pair"),
)
# Words that name a school, in the order of the search.
SCHOOL_WORDS = (
    ("吳門印派", "吳門印派"), ("吳門", "吳門印派"), ("浙派", "浙派"), ("浙", "浙派"), ("皖派", "皖派"), ("皖", "皖派"), ("徽派", "皖派"),
    ("漳海派", "漳海派"), ("漳海", "漳海派"), ("婁東派", "婁東派"), ("婁東", "婁東派"), ("莆田派", "莆田派"), ("莆田", "莆田派"),
    ("新安派", "皖派"), ("新安", "皖派"), ("錢塘派", "浙派"), ("錢塘", "浙派"),
)
# What looks like a place in the native-place rule and is none.
NOT_PLACES = ("友人", "同人", "一人", "人人", "世人", "元人", "此人", "其人", "出人", "驚人")


def detect_school(text: str) -> str:
    return next((school for word, school in SCHOOL_WORDS if word in text), "")


class Names:
    """A dictionary of names as an automaton, so a text is searched once whatever their number."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.machine, self.some = ahocorasick.Automaton(), False
        for n in names:
            if n:
                self.machine.add_word(n, n)
                self.some = True
        if self.some:
            self.machine.make_automaton()

    def found(self, text: str) -> list[str]:
        """Names in *text* by place; longer names take their places first, and a taken place isn't used again."""
        taken, found = [False] * len(text), []
        hits = [(-len(n), n, end - len(n) + 1) for end, n in self.machine.iter(text)] if self.some else []
        for size, name, at in sorted(hits):
            if not any(taken[at : at - size]):
                taken[at : at - size] = [True] * -size
                found.append((at, name))
        return [n for _, n in sorted(found)]


def apply_rules(text: str, title: str, names: list[str] | Names, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, str, str, float, str]]:
    """(subject, predicate, object, confidence, evidence); of equal statements the first."""
    names = names if isinstance(names, Names) else Names(names)
    out: dict[tuple, tuple] = {}

    def say(s: str, p: str, o: str, c: float, place: int) -> None:
        out.setdefault((s, p, o), (s, p, o, c, text[max(0, place - 20) : place + 20]))

    for rule in rules:
        for m in re.finditer(rule.pattern, text):
            found = names.found(m[0])
            if not found:
                continue
            subject, value = found[0], None
            rest = m[0].replace(subject, "")
            if rule.kind == "pair":
                value = found[1] if len(found) > 1 else None
            elif rule.kind == "title":
                value = title.strip()
            elif rule.kind == "style":
                value = re.split("[，,]", re.sub("^[，,\\s]+(?:字|號|一字|亦稱)", "", rest).strip("，, \t\n"))[0].strip()
                value = value if 1 <= len(value) <= 8 else None
            elif rule.kind == "place":
                value = rest.strip("之為是屬")
                value = value if len(value) >= 2 and value not in NOT_PLACES else None
            elif rule.kind == "school_after":
                value = detect_school(text[m.end() : m.end() + 30])
            else:
                value = detect_school(m[0])
            if value is None or value == subject or not value and rule.kind != "school_or_blank":
                continue
            say(subject, rule.predicate, value, rule.confidence, m.start())
            if rule.inverse:
                say(value, rule.inverse, subject, rule.confidence, m.start())
    return list(out.values())


def extract_relations(entries: DataFrame, known: list[str] | DataFrame, rules: tuple[Rule, ...] = RULES, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """(chapter, title, subject, predicate, object, confidence, evidence) over entries(chapter, title, content).

    *known* is the dictionary of names, a list or the column ``name`` of a table. Up to *limit*
    characters it goes to every task; a larger table is joined with the entries' n-grams first, and
    an entry goes with the names that are in it.
    """
    rows, every = entries.select("chapter", "title", "content"), None
    if not isinstance(known, DataFrame):
        every = known
    else:
        names = known.select("name").where("name <> ''").distinct()
        if (names.agg(F.sum(F.length("name"))).first()[0] or 0) <= limit:
            every = [r.name for r in names.collect()]
        else:
            rows = stored(rows.withColumn("entry", F.expr("uuid()")), "entries")
            rows = rows.join(names_in_entries(rows, names), "entry", "left").select("chapter", "title", "content", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None if every is None else Names(every)
        for b in batches:
            some = [whole] * b.num_rows if whole else [Names(x or []) for x in b.column(3).to_pylist()]
            rows = [(c, t, *x) for c, t, text, names in zip(*(b.column(i).to_pylist() for i in range(3)), some, strict=True) for x in apply_rules(text or "", t or "", names, rules)]
            if rows:
                kinds = [pa.string()] * 5 + [pa.float64(), pa.string()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chapter", "title", "subject", "predicate", "object", "confidence", "evidence"])

    shape = "chapter string, title string, subject string, predicate string, object string, confidence double, evidence string"
    return rows.mapInArrow(run, shape)


def names_in_entries(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(entry, names): all names that stand anywhere in an entry's content, by an equi-join on n-grams."""
    lengths = [r[0] for r in names.select(F.length("name")).distinct().collect()]
    at = entries.select("entry", "content", F.explode(F.sequence(F.lit(1), F.greatest(F.length("content"), F.lit(1)))).alias("at"))
    grams = at.select("entry", F.explode(F.array(*(F.expr(f"substring(content, at, {n})") for n in sorted(lengths)))).alias("name")).distinct()
    return grams.join(names, "name").groupBy("entry").agg(F.collect_list("name").alias("names"))


def pair_relations(docs: DataFrame, id: str, text: str, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """(id, subject, predicate, object, confidence) of patterns with two groups, all inside the JVM.

    A pattern goes over a text once; the two groups are taken from each match, which fits it from end to end.
    """

    def matches(predicate: str, pattern: str, confidence: float) -> F.Column:
        def pair(x: F.Column) -> F.Column:
            s, o = (F.regexp_extract(x, f"^(?:{pattern})$", n) for n in (1, 2))
            return F.struct(s.alias("subject"), F.lit(predicate).alias("predicate"), o.alias("object"), F.lit(confidence).alias("confidence"))

        # Equal matches say the same; few are left to be split.
        return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), pair)

    found = [matches(k, p, c) for k, (p, c) in rules.items()]
    return docs.select(F.col(id).alias("id"), F.explode(F.concat(*found)).alias("x")).select("id", "x.*").where("subject <> object").distinct()
