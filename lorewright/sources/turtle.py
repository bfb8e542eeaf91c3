"""Turtle files as triples tables, and back.

The subset: prefixes, IRIs, ``a``, ``;`` and ``,`` lists, plain, typed and language-tagged
literals, comments. A file is read whole by one task (a statement may span lines); many files are
read in parallel. Terms are kept as local names or, with full=True, as whole IRIs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "s string, p string, o string, o_kind string, o_dtype string"
_TERM = re.compile(
    r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<long>"""(?:[^\\]|\\.)*?""")|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<tag>@[A-Za-z][\w-]*)|(?P<type>\^\^)|(?P<end>[.;,\[\]](?=[\s#]|$)|[;,])'
    r"|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?=[\s;,.)]))|(?P<name>[^\s;,<>\"()\[\]]*[^\s;,.<>\"()\[\]])",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "'": "'", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


class TurtleError(ValueError):
    """A text outside the subset."""


def parse(text: str, full: bool = False) -> list[tuple[str, str, str, str, str | None]]:
    """The text's (s, p, o, o_kind, o_dtype) rows in order."""
    tokens, at = [], 0
    while at < len(text):
        m = _TERM.match(text, at)
        if not m or m.end() == at:
            raise TurtleError(f"unexpected text at {text[at : at + 30]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes: dict[str, str] = {}

    def name(kind: str, raw: str) -> str:
        if kind == "iri":
            iri = prefixes.get("", "") + raw[1:-1] if full and ":" not in raw else raw[1:-1]
        elif raw == "a":
            iri = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
        elif kind == "name" and ":" in raw:
            prefix, local = raw.split(":", 1)
            if prefix not in prefixes:
                raise TurtleError(f"the prefix {prefix}: isn't declared")
            iri = prefixes[prefix] + local
        else:
            raise TurtleError(f"{raw} isn't an IRI")
        if full:
            return iri
        if iri.endswith("22-rdf-syntax-ns#type"):
            return "rdf-syntax-ns#type"
        spaces = sorted((v for v in prefixes.values() if v and iri.startswith(v)), key=len)
        return iri[len(spaces[0]) :] if spaces else iri

    out, i = [], 0
    while i < len(tokens):
        kind, raw = tokens[i]
        if raw in ("@prefix", "@base") or raw.upper() in ("PREFIX", "BASE"):
            base = raw.lower().endswith("base")
            prefixes["" if base else tokens[i + 1][1][:-1]] = tokens[i + (1 if base else 2)][1][1:-1]
            i += 2 if base else 3
            i += i < len(tokens) and tokens[i][1] == "."
            continue
        s, i = name(kind, raw), i + 1
        while True:
            p, i = name(*tokens[i]), i + 1
            while True:
                if i >= len(tokens):
                    raise TurtleError("the text ends inside a statement")
                kind, raw = tokens[i]
                i += 1
                if kind in ("text", "long"):
                    value, dtype = _unescaped(raw[3:-3] if kind == "long" else raw[1:-1]), None
                    if i < len(tokens) and tokens[i][0] == "type":
                        dtype = re.split("[/#:]", tokens[i + 1][1].strip("<>"))[-1]
                        i += 2
                    elif i < len(tokens) and tokens[i][0] == "tag":
                        dtype = tokens[i][1]
                        i += 1
                    out.append((s, p, value, "literal", dtype))
                elif kind == "number":
                    out.append((s, p, raw, "literal", "integer" if raw.lstrip("+-").isdigit() else "decimal"))
                else:
                    out.append((s, p, name(kind, raw), "iri", None))
                if i >= len(tokens) or tokens[i][1] != ",":
                    break
                i += 1
            if i >= len(tokens) or tokens[i][1] != ";":
                break
            while i < len(tokens) and tokens[i][1] == ";":
                i += 1
            if i >= len(tokens) or tokens[i][1] == ".":
                break
        if i >= len(tokens) or tokens[i][1] != ".":
            raise TurtleError("a statement without an end")
        i += 1
    return out


def read_turtle(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """The distinct triples of all files at *path* (SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                rows = parse(t, full)
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 5, names=["s", "p", "o", "o_kind", "o_dtype"])

    return spark.read.text(path, wholetext=True).select("value").mapInArrow(run, SCHEMA).distinct()


def first_graph(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of *paths* that can be read; an empty table if none can."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path = hadoop(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return read_turtle(spark, p)
    return spark.createDataFrame([], SCHEMA)


def to_turtle(triples: DataFrame, namespace: str) -> DataFrame:
    """(value): one statement per subject, predicates and objects in order."""
    escaped = F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    dtype = F.col("o_dtype") if "o_dtype" in triples.columns else F.lit(None).cast("string")
    typed = F.when(F.startswith(dtype, F.lit("@")), dtype).when(dtype.isNotNull(), F.concat(F.lit("^^<http://www.w3.org/2001/XMLSchema#"), dtype, F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped, F.lit('"'), typed)).otherwise(F.concat(F.lit(f"<{namespace}"), "o", F.lit(">")))
    p = F.when(F.col("p") == "rdf-syntax-ns#type", "a").otherwise(F.concat(F.lit(f"<{namespace}"), "p", F.lit(">")))
    pairs = triples.select("s", F.concat(p, F.lit(" "), o).alias("po")).groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("po")), " ;\n    ").alias("body"))
    return pairs.select(F.concat(F.lit(f"<{namespace}"), "s", F.lit(">\n    "), "body", F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, path: str, namespace: str = "http://example.org/kg/") -> None:
    """Writes a folder of Turtle files, one per partition."""
    to_turtle(triples, namespace).write.mode("overwrite").text(path)
