"""Column expressions on text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_whitespace(text: Column) -> Column:
    """Spaces and tabs go, three or more line ends become two, ends are trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", ""), "\\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def normalize_punctuation(text: Column) -> Column:
    """The long dash made of two box-drawing lines becomes one of two em dashes."""
    return F.replace(text, F.lit("──"), F.lit("——"))


def variants(text: Column, pairs: dict[str, str]) -> Column:
    """Single characters replaced at once, without chains."""
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def sentences(text: Column, ends: str = "。！？；") -> Column:
    """Pieces that end after one of *ends*, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, f"(?<=[{ends}])"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def window(text: Column, start: Column, end: Column, around: int = 20) -> Column:
    """Text from *around* characters before the 0-based start to *around* after the end, clipped."""
    first = F.greatest(start - around, F.lit(0))
    return F.substring(text, first + 1, F.least(end + around, F.length(text)) - first)


def present(text: Column, patterns: list[str]) -> Column:
    """The distinct patterns that the text holds, in the patterns' order."""
    return F.filter(F.array(*(F.lit(p) for p in dict.fromkeys(patterns))), lambda p: F.contains(text, p))


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds any of the words: one pattern, however many words."""
    return F.rlike(text, F.lit("|".join(f"\\Q{w}\\E" for w in words)))


def cascade(text: Column, rules: list[tuple[tuple[str, ...] | Column, str]], default: str | None) -> Column:
    """The label of the first rule of which the text holds a keyword (or whose condition is true)."""
    out = F.lit(default).cast("string")
    for words, label in reversed(rules):
        out = F.when(holds(text, words) if isinstance(words, tuple) else words, label).otherwise(out)
    return out


NAMESPACE = "http://example.org/kg/"


def mint(name: Column, kind: str, namespace: str = NAMESPACE) -> Column:
    """An IRI of a kind: the trimmed name with underscores, or the kind's unknown for a blank one."""
    blank = F.lit(namespace + ("unknown" if kind == "person" else f"unknown_{kind}"))
    t = F.trim(name)
    return F.when(F.coalesce(t, F.lit("")) == "", blank).otherwise(F.concat(F.lit(f"{namespace}{kind}/"), F.replace(t, F.lit(" "), F.lit("_"))))


def local_name(iri: Column) -> Column:
    return F.element_at(F.split(iri, "[/#]"), -1)


def safe_int(value: Column) -> Column:
    """The whole number that a text holds, or null."""
    return F.try_to_number(F.when(F.trim(value).rlike(r"^[+-]?\d{1,9}$"), F.trim(value)), F.lit("S999999999")).cast("int")


def json_span(text: Column) -> Column:
    """From the first { to the last }, or null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def as_list(json: Column, path: str, element: str) -> Column:
    """The array at a JSON path where a producer writes a list, or a single value for one."""
    raw = F.get_json_object(json, path)
    return F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, f"array<{element}>")).when(raw.isNotNull(), F.array(F.from_json(raw, element) if element.startswith("struct") else raw.cast(element)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-10) -> Column:
    """The vector over its length plus *floor*."""
    return F.transform(a, lambda x: x / (norm(a) + floor))
