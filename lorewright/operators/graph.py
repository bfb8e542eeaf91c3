"""Graph analytics on edges(src, dst, relation) as joins and aggregations.

Loops write each round as a table (no lineage grows, and a lost executor costs one round). Driver
code sees counts only, but for the numbered edges of a graph of at most GRAPH_EDGES, which every task
of a search from all nodes is given, and those that find communities.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.store import drop_stored, n_stored, stored


def simple(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst), without loops, with the smallest relation."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.min("relation").alias("relation"))


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _numbered(ids: DataFrame) -> DataFrame:
    """(id, at int): ids in order from 0 on, for graphs that fit a task."""
    return ids.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("at"))


def degree_centrality(edges: DataFrame, top: int | None = 20) -> DataFrame:
    """(rank int, id, degree long, centrality): in- and out-degree over n - 1, ties by id."""
    d = simple(edges).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    n = d.agg(F.count("*").alias("n"))
    rows = d.crossJoin(F.broadcast(n)).select("id", "degree", F.round(F.col("degree") / (F.col("n") - 1), 4).alias("centrality"))
    if top is None:
        return rows
    best = rows.orderBy(F.desc("degree"), "id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density rounded to 4 digits."""
    e = simple(edges)
    n, m = node_ids(e).agg(F.count("*").alias("nodes")), e.agg(F.count("*").alias("edges"))
    return n.crossJoin(m).withColumn("density", F.round(F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), 4))


def group_stats(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Per group of membership(id, grp): members, internal edges, density, its top member by internal degree."""
    inner = simple(edges).join(membership.toDF("src", "ga"), "src").join(membership.toDF("dst", "gb"), "dst").where("ga = gb")
    size = membership.groupBy("grp").agg(F.count("*").alias("members"))
    count = inner.groupBy(F.col("ga").alias("grp")).agg(F.count("*").alias("internal_edges"))
    degree = inner.select(F.col("ga").alias("grp"), F.explode(F.array("src", "dst")).alias("id")).groupBy("grp", "id").count()
    first = degree.groupBy("grp").agg(F.min(F.struct((-F.col("count")).alias("d"), "id")).alias("x")).select("grp", F.col("x.id").alias("top_member"))
    out = size.join(count, "grp", "left").join(first, "grp", "left").na.fill(0, ["internal_edges"])
    pairs = F.col("members") * (F.col("members") - 1)
    return out.withColumn("density", F.round(F.when(pairs > 0, F.col("internal_edges") / pairs).otherwise(0.0), 4))


def relation_histogram(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(grp, relation, n): relations inside each group."""
    inner = edges.join(membership.toDF("src", "ga"), "src").join(membership.toDF("dst", "gb"), "dst").where("ga = gb")
    return inner.groupBy(F.col("ga").alias("grp"), "relation").agg(F.count("*").alias("n"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank): *rounds* rounds of power iteration; what nodes without an out-edge have is dealt to all."""
    e = simple(edges).select("src", "dst")
    e = stored(e.join(e.groupBy("src").agg(F.count("*").alias("out")), "src").withColumnRenamed("src", "id"), "edges")
    ids = stored(e.select(F.explode(F.array("id", "dst")).alias("id")).distinct(), "nodes")
    n = max(ids.count(), 1)
    r = ids.select("id", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        # One aggregation per round: what a node without an out-edge has goes to the key null.
        sent = r.join(e, "id", "left").groupBy("dst").agg(F.sum(F.col("rank") / F.coalesce("out", F.lit(1))).alias("got"))
        sent = stored(sent, "sent")
        loose = sent.where("dst is null").agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("loose"))
        r = ids.join(sent.withColumnRenamed("dst", "id"), "id", "left").crossJoin(F.broadcast(loose))
        r = r.select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
    return r


def levels(edges: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """(start, id, d int, paths double): shortest distances from each of *starts* (id) and how many shortest paths.

    Breadth-first rounds from all starts at once: the frontier joins the edges, and an anti-join
    drops what has been seen.
    """
    e = stored(simple(edges).select("src", "dst"), "edges")
    front = stored(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("paths")), "front")
    seen = front
    d = 0
    while limit is None or d < limit:
        d += 1
        step = front.join(e, front["id"] == e["src"]).groupBy("start", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        step = step.join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(d).alias("d"), "paths")
        front = stored(step, "front")
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front), "seen") if d % 4 == 0 else seen.unionByName(front)
    return stored(seen, "levels")


#: Rows, pairs of a start and a node it reaches, that searches from all nodes may write at once.
SEARCH_ROWS = 1 << 30


def _from_all(ids: DataFrame, n: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """search(starts) of blocks of the *n* ids, one below the other.

    The ids are dealt by hash to as many blocks as SEARCH_ROWS asks for. What a block's search wrote
    goes when its rows are written, so disk holds one block's pairs, however many nodes there are.
    """
    blocks = max(1, -(-n * n // SEARCH_ROWS))
    parts = []
    for k in range(blocks):
        first = n_stored()
        parts.append(stored(search(ids.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)), "block"))
        drop_stored(ids.sparkSession, first, keep=parts[-1])
    return reduce(lambda a, b: a.unionByName(b), parts)


def closeness(edges: DataFrame) -> DataFrame:
    """(id, closeness): by incoming distances, scaled by the share of nodes that reach the node.

    Exact: a search from every node, block by block.
    """
    e = stored(simple(edges), "edges")
    ids = stored(node_ids(e), "nodes")
    n = ids.count()
    rows = _from_all(ids, n, lambda starts: levels(e, starts).groupBy("id").agg(F.count("*").alias("k"), F.sum("d").alias("total")))
    rows = rows.groupBy("id").agg(F.sum("k").alias("k"), F.sum("total").alias("total"))
    value = F.when(F.col("total") > 0, (F.col("k") - 1) / F.col("total") * (F.col("k") - 1) / (n - 1)).otherwise(0.0)
    return rows.select("id", value.alias("closeness"))


#: Edges of a graph that is handed whole to tasks (8 bytes each); larger ones are searched by joins.
GRAPH_EDGES = 1 << 22
#: Nodes and edges, over all starts, that a search in memory holds at once.
HELD = 1 << 21


def betweenness(edges: DataFrame) -> DataFrame:
    """(id, betweenness): exact, directed, normalised by (n - 1)(n - 2).

    Dependencies are summed backwards, level by level, over the edges of shortest-path trees:
    work is the number of (start, edge) pairs, never of triples of nodes. Up to GRAPH_EDGES edges, each task
    searches from its share of the starts in memory; beyond, all is done by joins, block by block of starts.
    """
    e = stored(simple(edges), "edges")
    m = e.count()
    ids = stored(_numbered(node_ids(e)) if m <= GRAPH_EDGES else node_ids(e), "nodes")
    n = ids.count()
    if m <= GRAPH_EDGES:
        rows = ids.join(_dependencies_in_memory(e, ids, n, m), "at").select("id", "b")
    else:
        rows = _from_all(ids, n, lambda starts: _dependencies(e, starts)).groupBy("id").agg(F.sum("b").alias("b"))
    scale = (n - 1) * (n - 2)
    return ids.select("id").join(rows, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) / (scale if scale > 0 else 1)).alias("betweenness"))


def _dependencies_in_memory(e: DataFrame, ids: DataFrame, n: int, m: int) -> DataFrame:
    """(at, b) as _dependencies from all of ids(id, at), numbers from 0: the starts are dealt to pieces, each searched by one task."""
    pairs = e.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select("a", "b").toArrow()
    a, to = (np.asarray(pairs.column(c).to_numpy(), np.int32) for c in ("a", "b"))
    to = to[np.lexsort((to, a))]
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
    work = n * (n + m)
    pieces = max(1, min(work >> 22, 128), work >> 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                owed = _owed(np.arange(piece, n, pieces), first, to)
                at = np.flatnonzero(owed)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(owed[at], pa.float64())], names=["at", "b"])

    rows = e.sparkSession.range(0, pieces, 1, pieces).mapInArrow(run, "at int, b double")
    return stored(rows.groupBy("at").agg(F.sum("b").alias("b")), "dependencies")


def _owed(starts: np.ndarray, first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How much the shortest paths from *starts* depend on each node between their ends; node i links to to[first[i]:first[i + 1]].

    Some starts at a time: slot k * n + i is node i as seen from the kth of them.
    """
    n = len(first) - 1
    out = np.zeros(n)
    some = max(1, HELD // max(1, n + len(to)))
    for block in (starts[i : i + some] for i in range(0, len(starts), some)):
        begin = at = np.arange(len(block)) * n + block
        paths, owed, seen, last = np.zeros(len(block) * n), np.zeros(len(block) * n), np.zeros(len(block) * n, bool), np.empty(len(block) * n, np.int64)
        paths[at], seen[at] = 1.0, True
        rounds = []
        while at.size:
            node = at % n
            many = first[node + 1] - first[node]
            edge = np.arange(many.sum()) + np.repeat(first[node] - np.cumsum(many) + many, many)
            a, b = np.repeat(at, many), np.repeat(at - node, many) + to[edge]
            new = ~seen[b]
            a, b = a[new], b[new]
            np.add.at(paths, b, paths[a])
            turn = np.arange(b.size)
            last[b] = turn
            at = b[last[b] == turn]  # each slot once
            seen[at] = True
            rounds.append((a, b))
        for a, b in reversed(rounds):
            np.add.at(owed, a, paths[a] / paths[b] * (1 + owed[b]))
        owed[begin] = 0.0
        out += owed.reshape(-1, n).sum(axis=0)
    return out


def _dependencies(e: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, b): how much the shortest paths from *starts* depend on each node between their ends."""
    l = levels(e, starts)
    most = l.agg(F.max("d")).first()[0] or 0
    down = l.select("start", F.col("id").alias("src"), F.col("d").alias("ds"), F.col("paths").alias("ps")).join(e.select("src", "dst"), "src")
    down = down.join(l.select("start", F.col("id").alias("dst"), F.col("d").alias("dd"), F.col("paths").alias("pd")), ["start", "dst"]).where("dd = ds + 1")
    down = stored(down, "down")
    owed = l.where(f"d = {most}").select("start", "id", F.lit(0.0).alias("owed"))
    total = owed
    for d in range(most - 1, 0, -1):
        part = down.where(f"ds = {d}").join(owed.withColumnRenamed("id", "dst"), ["start", "dst"]).groupBy("start", F.col("src").alias("id")).agg(F.sum(F.col("ps") / F.col("pd") * (1 + F.col("owed"))).alias("owed"))
        owed = stored(l.where(f"d = {d}").select("start", "id").join(part, ["start", "id"], "left").na.fill(0.0, ["owed"]), "owed")
        total = total.unionByName(owed)
    return total.where("start <> id").groupBy("id").agg(F.sum("owed").alias("b"))


def shortest_path(edges: DataFrame, start: str, end: str, limit: int = 5, directed: bool = True) -> DataFrame:
    """(hop int, src, dst, relation): one shortest path, the smallest by its nodes; no rows if there is none."""
    e = simple(edges)
    if not directed:
        e = simple(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")))
    e = stored(e, "edges")
    front = edges.sparkSession.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = front
    for _ in range(limit):
        step = front.join(e.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti")
        front = stored(step, "front")
        seen = seen.unionByName(front)
        if front.isEmpty() or not front.where(F.col("id") == end).isEmpty():
            break
    found = seen.where((F.col("id") == end) & (F.size("path") > 1))
    hops = found.select(F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("hop", "x"))
    return hops.select("hop", "x.src", "x.dst").join(e, ["src", "dst"]).select("hop", "src", "dst", "relation")


def all_paths(edges: DataFrame, start: str, end: str, most: int = 4) -> DataFrame:
    """(path, length int): every path without a repeated node and at most *most* edges, nodes joined by arrows."""
    e = simple(edges).select("src", "dst")
    front = e.where(F.col("src") == start).select("dst", F.array("src", "dst").alias("path"))
    out = front.where(F.col("dst") == end)
    for _ in range(most - 1):
        front = front.where(F.col("dst") != end).join(e.toDF("dst", "nxt"), "dst").where(~F.array_contains("path", F.col("nxt"))).select(F.col("nxt").alias("dst"), F.concat("path", F.array("nxt")).alias("path"))
        out = out.unionByName(front.where(F.col("dst") == end))
    return out.select(F.array_join("path", " → ").alias("path"), (F.size("path") - 1).alias("length"))


def teaches(edges: DataFrame) -> DataFrame:
    """(teacher, student): hasTeacher turned round, and hasStudent."""
    a = edges.where("relation = 'hasTeacher'").select(F.col("dst").alias("teacher"), F.col("src").alias("student"))
    return a.unionByName(edges.where("relation = 'hasStudent'").select(F.col("src").alias("teacher"), F.col("dst").alias("student"))).distinct()


def lineage(pairs: DataFrame, of: str, up: bool = True, most: int = 7) -> DataFrame:
    """(id, depth int): teachers (or students) of a person at their smallest depth, up to *most*."""
    e = pairs.select(F.col("student" if up else "teacher").alias("src"), F.col("teacher" if up else "student").alias("dst"), F.lit("").alias("relation"))
    start = pairs.sparkSession.createDataFrame([(of,)], "id string")
    return levels(e, start, most).where("d > 0").select("id", F.col("d").alias("depth"))


def generations(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """(id, grp, generation int): the most members of one's own group on any chain of teachers, however long.

    Teachers of other groups are passed through without being counted; a chain never repeats a node.
    Of chains over the same nodes to the same one, one is followed.
    """
    m = stored(membership.select("id", "grp"), "membership")
    up = stored(pairs.select(F.col("student").alias("at"), "teacher").distinct().join(m.toDF("teacher", "tg"), "teacher", "left"), "teachers")
    front = m.select("id", "grp", F.col("id").alias("at"), F.lit(0).alias("g"), F.array("id").alias("path"))
    out = front.select("id", "grp", "g")
    while True:
        step = front.join(up, "at").where(~F.array_contains("path", F.col("teacher")))
        g = (F.col("g") + F.when(F.col("tg") == F.col("grp"), 1).otherwise(0)).alias("g")
        step = step.select("id", "grp", F.col("teacher").alias("at"), g, F.array_sort(F.concat("path", F.array("teacher"))).alias("path"))
        front = stored(step.distinct(), "front")
        if front.isEmpty():
            break
        out = out.unionByName(front.groupBy("id", "grp").agg(F.max("g").alias("g")))
    return out.groupBy("id", "grp").agg(F.max("g").alias("generation"))


def influence(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(grp_a, grp_b, src, dst, relation): edges between members of different groups."""
    return edges.join(membership.toDF("src", "grp_a"), "src").join(membership.toDF("dst", "grp_b"), "dst").where("grp_a <> grp_b").select("grp_a", "grp_b", "src", "dst", "relation")


def modularity(edges: DataFrame, membership: DataFrame) -> float:
    """Of membership(id, grp) on the undirected graph of edges(src, dst)."""
    u = _undirected(edges)
    both = u.join(membership.toDF("a", "ga"), "a").join(membership.toDF("b", "gb"), "b")
    two_m = u.agg(F.sum("w")).first()[0] or 0.0
    if not two_m:
        return 0.0
    inside = both.where("ga = gb").agg(F.sum("w")).first()[0] or 0.0
    squares = both.groupBy("ga").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / two_m - squares / two_m**2


def _undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w) in both directions, one edge per pair."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return e.select("a", "b", F.lit(1.0).alias("w")).unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1.0).alias("w")))


#: Turns without a gain in modularity after which a level is done.
PATIENCE = 3


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, grp): communities by local moves of greatest modularity gain, level by level until modularity stops growing.

    Up to GRAPH_EDGES linked pairs a task moves node after node, in an order of its own up to ORDER_EDGES pairs and in
    all orders beyond; above GRAPH_EDGES, joins move many at a time. Groups are named by their smallest node, so the
    result doesn't depend on partitions or tasks.
    """
    u = stored(_undirected(edges), "graph")
    pairs = u.where("a < b")
    m = pairs.count()
    if m <= GRAPH_EDGES:
        ids = stored(_numbered(u.select(F.col("a").alias("id")).distinct()), "nodes")
        pairs = pairs.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select("x", "y").toArrow()
        x, y = (np.asarray(pairs.column(c).to_numpy(), np.int32) for c in ("x", "y"))
        tasks = ORDERS if m <= ORDER_EDGES else 1
        rows = u.sparkSession.range(0, tasks, 1, tasks).mapInArrow(_grouped(x, y, resolution, tasks), "piece int, worth double, at int, least int")
        found = stored(rows, "groups")
        best = found.agg(F.min(F.struct((-F.col("worth")).alias("k"), "piece"))["piece"]).first()[0]
        found = found.where(F.col("piece") == F.lit(best)).select("at", "least")
        return ids.join(found, "at").select("id", "least").join(ids.toDF("grp", "least"), "least").select("id", "grp")
    names = _moved_by_joins(u, resolution)
    least = names.groupBy("grp").agg(F.min("id").alias("name"))
    return names.join(least, "grp").select("id", F.col("name").alias("grp"))


#: Orders in which the nodes of a graph are tried; the groups of greatest modularity are kept.
ORDERS = 4
#: Pairs of a graph whose orders are tried by a task each; of larger ones an executor may not hold several at once.
ORDER_EDGES = 1 << 20


def _grouped(x: np.ndarray, y: np.ndarray, resolution: float, tasks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over *tasks* pieces, on all linked pairs of numbered nodes: each node with the smallest one of its group, and the groups' worth.

    A piece tries its share of the orders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0).to_pylist() if len(x) else []:
                a, b = (np.concatenate(c).astype(np.int64) for c in ((x, y), (y, x)))
                grp = _louvain(a, b, resolution, range(piece, ORDERS, tasks))
                worth = _worth(a, b, grp, resolution)
                least = np.full(len(grp), len(grp))
                np.minimum.at(least, grp, np.arange(len(grp)))
                for at in (np.arange(i, min(i + HELD, len(grp))) for i in range(0, len(grp), HELD)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), piece), pa.int32()), pa.array(np.full(len(at), worth), pa.float64()), pa.array(at, pa.int32()), pa.array(least[grp[at]], pa.int32())],
                        names=["piece", "worth", "at", "least"],
                    )

    return run


def _worth(a: np.ndarray, b: np.ndarray, grp: np.ndarray, resolution: float) -> float:
    """The modularity of groups, times the weight of the graph squared: a whole number if the resolution is 1."""
    return float(np.sum(grp[a] == grp[b])) * len(a) - resolution * float(np.sum(np.bincount(grp, np.bincount(a)) ** 2))


def _louvain(a: np.ndarray, b: np.ndarray, resolution: float, orders: Iterable[int] | None = None) -> np.ndarray:
    """A group's number for each node from 0 on, the best of *orders* (all); links are given in both directions, in any order.

    Levels go up until no group moves, then the nodes move again between the groups found, until that changes nothing.
    """
    n = int(a.max()) + 1
    links = _links(a, b, np.ones(len(a)), n)
    best, most = np.arange(n), -np.inf
    for order in range(ORDERS) if orders is None else orders:
        names, last = np.arange(n), None
        while last is None or not np.array_equal(names, last):
            last = names
            names = _settled(*links, names, resolution, order)
            while True:
                c = int(names.max()) + 1
                key, at = np.unique(names[links[3]] * c + names[links[1]], return_inverse=True)
                found = _settled(*_links(key // c, key % c, np.bincount(at, links[2]), c), np.arange(c), resolution, order)
                names = found[names]
                if found.max() + 1 == c:
                    break
        value = _worth(a, b, names, resolution)
        if value > most:
            best, most = names, value
    return best


def _links(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links by their node a: where each node's begin, b, w, a, and each node's weight."""
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).tolist(), b, w, a, np.bincount(a, w, n)


def _settled(first: list[int], to: np.ndarray, w: np.ndarray, _: np.ndarray, k: np.ndarray, grp: np.ndarray, resolution: float, order: int = 0) -> np.ndarray:
    """The group of each node, numbered anew, after moves from *grp*, one by one, to the linked group of greatest gain, until none gains.

    Node i, of weight k[i], has the links first[i] up to first[i + 1]. Gains are times half of the weight of the graph
    squared: whole numbers, below 2^53, if the resolution is 1. A node is looked at again when a neighbour has moved.
    """
    n, two_m = len(k), float(k.sum())
    total, grp, k = np.bincount(grp, k, n).tolist(), grp.tolist(), k.tolist()
    waits, queue = [True] * n, deque(np.random.default_rng(order).permutation(n).tolist() if order else range(n))
    while queue:
        i = queue.popleft()
        waits[i] = False
        own, links, near = grp[i], {}, to[first[i] : first[i + 1]].tolist()
        for j, x in zip(near, w[first[i] : first[i + 1]].tolist(), strict=True):
            if j != i:
                links[grp[j]] = links.get(grp[j], 0.0) + x
        total[own] -= k[i]
        share = resolution * k[i]
        best, most = own, links.get(own, 0.0) * two_m - share * total[own] + 0.5  # less is no gain but rounding
        for c, x in links.items():
            gain = x * two_m - share * total[c]
            if c != own and (gain > most or gain == most and best != own and c < best):
                best, most = c, gain
        grp[i] = best
        total[best] += k[i]
        if best != own:
            for j in near:
                if not waits[j] and grp[j] != best:
                    waits[j] = True
                    queue.append(j)
    return np.unique(grp, return_inverse=True)[1]


def _moved_by_joins(g: DataFrame, resolution: float) -> DataFrame:
    """(id, grp) on a graph (a, b, w) with both directions of each edge.

    At a time only nodes on one side of a hash may move, so most neighbours don't swap, and what
    lowers modularity is taken back.
    """
    names = None
    while True:
        found, better = _local_moves(g, resolution)
        names = found if names is None else stored(names.toDF("id", "mid").join(found.toDF("mid", "grp"), "mid").select("id", "grp"), "names")
        if not better:
            return names
        g = stored(g.join(found.toDF("a", "ga"), "a").join(found.toDF("b", "gb"), "b").groupBy(F.col("ga").alias("a"), F.col("gb").alias("b")).agg(F.sum("w").alias("w")), "graph")


def _quality(g: DataFrame, k: DataFrame, now: DataFrame, two_m: float, resolution: float) -> float:
    """The modularity of now(id, grp) on a weighted graph (a, b, w) with node weights k(id, k)."""
    inside = g.join(now.toDF("a", "ga"), "a").join(now.toDF("b", "gb"), "b").where("ga = gb").agg(F.sum("w")).first()[0] or 0.0
    squares = now.join(k, "id").groupBy("grp").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return inside / two_m - resolution * squares / two_m**2


def _local_moves(g: DataFrame, resolution: float) -> tuple[DataFrame, bool]:
    """(id, grp) on a weighted graph (a, b, w) with both directions of each edge, and whether modularity grew.

    The nodes move in turn, each time dealt anew to two sides, until PATIENCE turns in a row give no more.
    """
    k = stored(g.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "weights")
    two_m = k.agg(F.sum("k")).first()[0] or 1.0
    best = now = stored(k.select("id", F.col("id").alias("grp")), "moves")
    first = value = _quality(g, k, now, two_m, resolution)
    turn = idle = 0
    while idle < PATIENCE:
        now = best
        for side in (0, 1):
            now = stored(_moved(g, k, now, two_m, resolution, turn, side), "moves")
        turn += 1
        reached = _quality(g, k, now, two_m, resolution)
        if reached > value + 1e-9:
            best, value, idle = now, reached, 0
        else:
            idle += 1
    return best, value > first


def _moved(g: DataFrame, k: DataFrame, now: DataFrame, two_m: float, resolution: float, turn: int, side: int) -> DataFrame:
    """now(id, grp) after the nodes that a turn deals to one side have moved to the group of their greatest gain."""
    total = now.join(k, "id").groupBy("grp").agg(F.sum("k").alias("total"))
    links = g.where("a <> b").join(now.toDF("b", "grp"), "b").groupBy(F.col("a").alias("id"), "grp").agg(F.sum("w").alias("w"))
    own = now.join(k, "id").select("id", F.col("grp").alias("own"), "k")
    options = links.unionByName(now.select("id", "grp", F.lit(0.0).alias("w"))).groupBy("id", "grp").agg(F.sum("w").alias("w"))
    options = options.join(total, "grp").join(own, "id")
    rest = F.col("total") - F.when(F.col("grp") == F.col("own"), F.col("k")).otherwise(0.0)
    options = options.withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * rest / two_m, 9))
    stay = F.max(F.when(F.col("grp") == F.col("own"), F.col("gain"))).alias("stay")
    best = options.groupBy("id", "own").agg(F.min(F.struct((-F.col("gain")).alias("g"), "grp")).alias("x"), stay)
    mine = F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(2)) == side
    return best.select("id", F.when(mine & (-F.col("x.g") > F.col("stay")), F.col("x.grp")).otherwise(F.col("own")).alias("grp"))
