"""The calls of a service: graph views, person and school pages, paths, ad-hoc queries, a view cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.operators import graph as G
from lorewright.operators import knowledge as K
from lorewright.operators import sparql
from lorewright.operators.normalize import RDF

SCHEMA_PREDICATES = tuple(sorted(set(RDF.values())))


def person(triples: DataFrame, name: str) -> DataFrame:
    """One row about a person; none if unknown."""
    return K.person_info(triples.where(F.col("s") == name))


def person_relations(triples: DataFrame, name: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """(name, relation, target) of a person; *types* may be given in older names."""
    wanted = tuple(RDF.get(t.strip(), t.strip()) for t in types) if types else None
    return K.relations(triples.where(F.col("s") == name), wanted)


def school(triples: DataFrame, name: str) -> DataFrame:
    """(school, members, member_count): members by name, joined by commas."""
    m = K.members(triples, True).where(F.col("school") == f"school/{name}")
    return m.groupBy("school").agg(F.array_join(F.array_sort(F.collect_set("member")), ",").alias("members"), F.count_distinct("member").alias("member_count"))


def path(triples: DataFrame, a: str, b: str, most: int = 5) -> DataFrame:
    """One row (found, length, path): the shortest directed path along relations."""
    hops = G.shortest_path(K.edges(triples), a, b, most)
    nodes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop", "dst"))), lambda x: x["dst"]), " → ")
    return hops.agg((F.count("*") > 0).alias("found"), F.count("*").alias("length"), F.when(F.count("*") > 0, F.concat(F.lit(a + " → "), nodes)).alias("path"))


def execute(triples: DataFrame, text: str) -> tuple[bool, str, DataFrame | None]:
    """(success, error, rows) of an ad-hoc query."""
    try:
        return True, "", sparql.select(triples, text)
    except sparql.SparqlError as e:
        return False, str(e), None


def graph_json(triples: DataFrame) -> DataFrame:
    """(kind, value): every node and link of the graph view as a JSON line, for a writer of any size."""
    e = K.edges(triples)
    n = K.nodes(e).select(F.lit("node").alias("kind"), F.to_json(F.struct("id", F.regexp_replace("id", "^[a-z]+/", "").alias("name"), F.col("node_type").alias("type"), F.coalesce("school", F.lit("")).alias("school"))).alias("value"))
    links = e.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation")).alias("value"))
    return n.unionByName(links)


class Views:
    """Views computed once and kept until reload()."""

    def __init__(self, load: Callable[[], DataFrame]):
        self._load, self._kept = load, {}

    def triples(self) -> DataFrame:
        return self._get("triples", self._load)

    def graph(self) -> DataFrame:
        return self._get("graph", lambda: graph_json(self.triples()))

    def centrality(self) -> DataFrame:
        return self._get("centrality", lambda: G.degree_centrality(K.edges(self.triples())))

    def communities(self) -> DataFrame:
        return self._get("communities", lambda: G.communities(K.edges(self.triples())))

    def _get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make().persist()
        return self._kept[name]

    def reload(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept = {}
