"""A SPARQL SELECT subset compiled to DataFrame plans over triples(s, p, o, o_kind).

Basic graph patterns are equi-joins on shared variables, UNION keeps duplicates, BIND adds a
constant, FILTER (=, !=, IN, NOT IN, CONTAINS) applies to its whole group, as do joins with what
the group holds. DISTINCT and LIMIT (over all columns in order) end a query. IRIs are the local
names of the default prefix; a constant in a string is a literal and is bound as a value, never
pasted into SQL.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|(\?\w+)|(<[^>]*>)|([A-Za-z_][\w-]*:[^\s{}().,;]*|[A-Za-z_]\w*)|(!=|[{}().,;=*])|(\d+))')


class SparqlError(ValueError):
    """A text outside the subset."""


def quoted(value: str) -> str:
    """A string literal of the language for any value."""
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _unquoted(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], token[1:-1])


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SparqlError(f"unexpected text at {text[at : at + 20]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.t, self.i = tokens(text), 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def next(self, want: str | None = None) -> str:
        x = self.peek()
        if not x or want and x.upper() != want:
            raise SparqlError(f"expected {want or 'more'}, found {x or 'the end'}")
        self.i += 1
        return x

    def select(self) -> dict:
        while self.peek().upper() == "PREFIX":
            self.next()
            if not self.next().endswith(":"):
                raise SparqlError("a prefix name ends in a colon")
            self.next()
        self.next("SELECT")
        distinct = self.peek().upper() == "DISTINCT"
        if distinct:
            self.next()
        names = []
        while self.peek().startswith("?") or self.peek() == "*":
            names.append(self.next().lstrip("?"))
        if self.peek().upper() == "WHERE":
            self.next()
        group = self.group()
        limit = None
        if self.peek().upper() == "LIMIT":
            self.next()
            limit = int(self.next())
        if self.peek():
            raise SparqlError(f"{self.peek()} isn't supported")
        return {"distinct": distinct, "names": names, "group": group, "limit": limit}

    def term(self) -> tuple[str, str]:
        x = self.next()
        if x.startswith("?"):
            return "var", x[1:]
        if x.startswith('"'):
            return "literal", _unquoted(x)
        if x.startswith("<"):
            return "iri", re.split("[/#]", x[1:-1])[-1]
        if x == "a":
            return "iri", "rdf-syntax-ns#type"
        if ":" in x:
            return "iri", x.split(":", 1)[1]
        raise SparqlError(f"{x} isn't a term")

    def group(self) -> list:
        self.next("{")
        out = []
        while (x := self.peek()) != "}":
            if x == "{":
                legs = [self.group()]
                while self.peek().upper() == "UNION":
                    self.next()
                    legs.append(self.group())
                out.append(("union", legs))
            elif x.upper() == "FILTER":
                self.next()
                out.append(("filter", self.filter()))
            elif x.upper() == "BIND":
                self.next()
                self.next("(")
                value = self.term()
                self.next("AS")
                out.append(("bind", value, self.next().lstrip("?")))
                self.next(")")
            elif x == ".":
                self.next()
            elif x.upper() in ("OPTIONAL", "MINUS", "GRAPH", "SERVICE", "VALUES"):
                raise SparqlError(f"{x} isn't supported")
            else:
                s = self.term()
                while True:
                    out.append(("triple", s, self.term(), self.term()))
                    if self.peek() != ";":
                        break
                    self.next()
        self.next("}")
        return out

    def filter(self) -> tuple:
        self.next("(")
        if self.peek().upper() == "CONTAINS":
            self.next()
            self.next("(")
            a = self.term()
            self.next(",")
            b = self.term()
            self.next(")")
            out = ("contains", a, b)
        else:
            a = self.term()
            op = self.next().upper()
            if op in ("=", "!="):
                out = (op, a, self.term())
            else:
                if op == "NOT":
                    self.next("IN")
                elif op != "IN":
                    raise SparqlError(f"{op} isn't supported")
                self.next("(")
                values = [self.term()]
                while self.peek() == ",":
                    self.next()
                    values.append(self.term())
                self.next(")")
                out = ("notin" if op == "NOT" else "in", a, values)
        self.next(")")
        return out


def _value(term: tuple[str, str]) -> F.Column:
    return F.col(f"`{term[1]}`") if term[0] == "var" else F.lit(term[1])


def _match(triples: DataFrame, s: tuple, p: tuple, o: tuple) -> DataFrame:
    rows, names = triples, {}
    for place, term in (("s", s), ("p", p), ("o", o)):
        if term[0] == "var":
            if term[1] in names:
                rows = rows.where(F.col(place) == F.col(names[term[1]]))
            names.setdefault(term[1], place)
        else:
            rows = rows.where(F.col(place) == term[1])
            if place == "o":
                rows = rows.where(F.col("o_kind") == ("literal" if term[0] == "literal" else "iri"))
    return rows.select(*(F.col(c).alias(v) for v, c in names.items()))


def _join(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    if shared:
        return a.join(b, shared)
    # Without a shared variable only a side of at most one row may be combined with the other.
    for one, other in ((a, b), (b, a)):
        few = one.limit(2).collect()
        if len(few) < 2:
            values = [F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(one.schema, few[0], strict=True)] if few else [F.lit(None).cast(f.dataType).alias(f.name) for f in one.schema]
            out = other.select(*other.columns, *values)
            return out if few else out.where(F.lit(False))
    raise SparqlError("two parts of the query share no variable")


def _apply(rows: DataFrame, f: tuple) -> DataFrame:
    kind, a, b = f
    if kind == "contains":
        return rows.where(F.contains(_value(a), _value(b)))
    if kind in ("=", "!="):
        return rows.where(_value(a) == _value(b) if kind == "=" else _value(a) != _value(b))
    held = _value(a).isin([v for _, v in b])
    return rows.where(held if kind == "in" else ~held)


def _group(triples: DataFrame, group: list) -> DataFrame:
    parts, filters, binds = [], [], []
    for x in group:
        if x[0] == "triple":
            parts.append(_match(triples, *x[1:]))
        elif x[0] == "union":
            legs = [_group(triples, g) for g in x[1]]
            parts.append(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), legs))
        elif x[0] == "filter":
            filters.append(x[1])
        else:
            binds.append(x[1:])
    if not parts:
        raise SparqlError("a group without a pattern")
    # Patterns that share variables are joined first, so only unrelated parts make a product.
    rows, rest = parts[0], parts[1:]
    while rest:
        k = next((k for k, x in enumerate(rest) if set(x.columns) & set(rows.columns)), 0)
        rows = _join(rows, rest.pop(k))
    for value, name in binds:
        rows = rows.withColumn(name, _value(value))
    return reduce(_apply, filters, rows)


def select(triples: DataFrame, text: str) -> DataFrame:
    """The query's result: a string column for each selected variable, null where unbound."""
    q = _Parser(text).select()
    rows = _group(triples, q["group"])
    names = rows.columns if q["names"] == ["*"] else q["names"]
    rows = rows.select(*(F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names))
    rows = rows.distinct() if q["distinct"] else rows
    return rows.orderBy(*rows.columns).limit(q["limit"]) if q["limit"] is not None else rows
