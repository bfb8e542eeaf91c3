"""Queries of graph analytics on the persons' relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.operators import graph as G
from lorewright.operators import knowledge as K
from lorewright.plans.knowledge import EDGES
from lorewright.plans.registry import query
from lorewright.sources.canonical import triples

A, B = "Supplier#000000007", "Supplier#000000002"
_SIMPLE = f"{EDGES}, g as (select src, dst, min(relation) as relation from e where relation not in ('belongsToSchool', 'hasFounder') group by src, dst), ids as (select src as id from g union select dst from g)"
_MEMBER = "mb as (select s as id, min(o) as grp from t where p = 'belongsToSchool' group by s)"


def people_edges(spark, sf_dir):
    return K.edges(triples(spark, sf_dir)).where("relation not in ('belongsToSchool', 'hasFounder')")


def membership(spark, sf_dir):
    return triples(spark, sf_dir).where("p = 'belongsToSchool'").groupBy(F.col("s").alias("id")).agg(F.min("o").alias("grp"))


_DEGREE = "dg as (select id, count(*) as degree from (select src as id from g union all select dst from g) group by id)"


@query(f"with {_SIMPLE}, {_DEGREE} select cast(row_number() over (order by degree desc, id) as integer) as rank, id, degree, round(degree / (select count(*) - 1 from dg), 4) as centrality from dg order by degree desc, id limit 20")
def degree_centrality(spark, sf_dir):
    return G.degree_centrality(people_edges(spark, sf_dir))


@query(f"with {_SIMPLE} select (select count(*) from ids) as nodes, (select count(*) from g) as edges, round((select count(*) from g) / ((select count(*) from ids) * ((select count(*) from ids) - 1)), 4) as density")
def graph_summary(spark, sf_dir):
    return G.summary(people_edges(spark, sf_dir))


_INNER = "inn as (select a.grp, g.src, g.dst, g.relation from g join mb a on a.id = src join mb b on b.id = dst where a.grp = b.grp)"


@query(
    f"""with {_SIMPLE}, {_MEMBER}, {_INNER}, sz as (select grp, count(*) as members from mb group by grp), ie as (select grp, count(*) as n from inn group by grp),
dd as (select grp, id, count(*) as c from (select grp, src as id from inn union all select grp, dst from inn) group by all), tp as (select grp, id from (select *, row_number() over (partition by grp order by c desc, id) as r from dd) where r = 1)
select sz.grp, members, coalesce(n, 0) as internal_edges, tp.id as top_member, round(case when members > 1 then coalesce(n, 0) / (members * (members - 1)) else 0 end, 4) as density from sz left join ie on sz.grp = ie.grp left join tp on sz.grp = tp.grp"""
)
def school_subgraph_stats(spark, sf_dir):
    return G.group_stats(people_edges(spark, sf_dir), membership(spark, sf_dir))


@query(f"with {_SIMPLE}, {_MEMBER} select a.grp, e.relation, count(*) as n from e join mb a on a.id = src join mb b on b.id = dst where a.grp = b.grp and relation not in ('belongsToSchool', 'hasFounder') group by all")
def community_stats(spark, sf_dir):
    return G.relation_histogram(people_edges(spark, sf_dir), membership(spark, sf_dir))


def _ranks(rounds: int = 20) -> str:
    out = ["n as (select count(*) as n from ids)", "od as (select src, count(*) as o from g group by src)", "r0 as (select id, 1.0 / n.n as rank from ids, n)"]
    for k in range(1, rounds + 1):
        out.append(
            f"r{k} as materialized (select ids.id, 0.15 / n.n + 0.85 * (coalesce(got, 0) + coalesce(loose, 0) / n.n) as rank from ids cross join n left join "
            f"(select dst, sum(rank / o) as got from g join r{k - 1} r on r.id = src join od on od.src = g.src group by dst) x on x.dst = ids.id cross join (select sum(rank) as loose from r{k - 1} where id not in (select src from g)) y)"
        )
    return ", ".join(out)


@query(f"with {_SIMPLE}, {_ranks()} select id, round(rank, 6) as rank from r20")
def pagerank(spark, sf_dir):
    return G.pagerank(people_edges(spark, sf_dir)).select("id", F.round("rank", 6).alias("rank"))


def _bfs(most: int = 12) -> str:
    """Levels l0 .. and bfs(start, id, d, paths) of shortest paths."""
    out = ["l0 as (select id as start, id, 0 as d, 1.0 as paths from ids)", "b0 as (select * from l0)"]
    for k in range(1, most + 1):
        out.append(f"l{k} as materialized (select l.start, g.dst as id, {k} as d, sum(l.paths) as paths from l{k - 1} l join g on g.src = l.id where not exists (select 1 from b{k - 1} b where b.start = l.start and b.id = g.dst) group by l.start, g.dst)")
        out.append(f"b{k} as materialized (select * from b{k - 1} union all select * from l{k})")
    return ", ".join(out) + f", bfs as (select * from b{most})"


@query(f"with {_SIMPLE}, {_bfs()}, k as (select id, count(*) as k, sum(d) as total from bfs group by id) select id, round(case when total > 0 then (k - 1) / total * (k - 1) / ((select count(*) from ids) - 1) else 0 end, 6) as closeness from k")
def closeness(spark, sf_dir):
    return G.closeness(people_edges(spark, sf_dir)).select("id", F.round("closeness", 6).alias("closeness"))


@query(
    f"""with {_SIMPLE}, {_bfs()}, p as (select a.id, sum(a.paths * c.paths / b.paths) as v from bfs a join bfs c on c.start = a.id join bfs b on b.start = a.start and b.id = c.id and b.d = a.d + c.d
  where a.start <> a.id and c.id <> a.id and a.start <> c.id group by a.id)
select ids.id, round(coalesce(v, 0) / (((select count(*) from ids) - 1) * ((select count(*) from ids) - 2)), 5) as betweenness from ids left join p on p.id = ids.id"""
)
def betweenness(spark, sf_dir):
    return G.betweenness(people_edges(spark, sf_dir)).select("id", F.round("betweenness", 5).alias("betweenness"))


_WALK = """wk as (select src, dst, [src, dst] as path from sp where src = '{a}' union all select wk.src, sp.dst, list_append(path, sp.dst) from wk join sp on sp.src = wk.dst where len(path) <= {n} and wk.dst <> '{b}' and not list_contains(path, sp.dst))"""


def _path(both: bool) -> str:
    links = "sp as (select src, dst, relation from g)" if not both else "sp as (select src, dst, min(relation) as relation from (select * from g union all select dst, src, relation from g) group by src, dst)"
    return (
        f"with recursive {_SIMPLE}, {links}, {_WALK.format(a=A, b=B, n=5)}, best as (select path from wk where dst = '{B}' order by len(path), path limit 1), "
        "hops as (select unnest(range(0, len(path) - 1)) as hop, path from best) "
        "select cast(hop as integer) as hop, sp.src, sp.dst, relation from hops join sp on sp.src = path[hop + 1] and sp.dst = path[hop + 2]"
    )


@query(_path(False))
def shortest_path(spark, sf_dir):
    return G.shortest_path(people_edges(spark, sf_dir), A, B)


@query(_path(True))
def shortest_path_undirected(spark, sf_dir):
    return G.shortest_path(people_edges(spark, sf_dir), A, B, directed=False)


@query(f"with recursive {_SIMPLE}, sp as (select src, dst from g), {_WALK.format(a=A, b=B, n=4)} select array_to_string(path, ' → ') as path, cast(len(path) - 1 as integer) as length from wk where dst = '{B}'")
def all_paths(spark, sf_dir):
    return G.all_paths(people_edges(spark, sf_dir), A, B)


_TEACHES = "te as (select dst as teacher, src as student from e where relation = 'hasTeacher' union select src, dst from e where relation = 'hasStudent')"


def _line(up: bool, of: str) -> str:
    a, b = ("student", "teacher") if up else ("teacher", "student")
    return f"with recursive {EDGES}, {_TEACHES}, li as (select {b} as id, 1 as depth from te where {a} = '{of}' union select te.{b}, depth + 1 from li join te on te.{a} = li.id where depth < 7) select id, min(depth) as depth from li where id <> '{of}' group by id"


@query(_line(True, "Supplier#000000080"))
def teacher_lineage(spark, sf_dir):
    return G.lineage(G.teaches(people_edges(spark, sf_dir)), "Supplier#000000080", True)


@query(_line(False, "Supplier#000000001"))
def student_lineage(spark, sf_dir):
    return G.lineage(G.teaches(people_edges(spark, sf_dir)), "Supplier#000000001", False)


@query(
    f"""with recursive {EDGES}, {_TEACHES}, {_MEMBER}, ch as (select id, grp, id as at, 0 as g, [id] as path from mb
  union all select ch.id, ch.grp, te.teacher, ch.g + case when m.grp = ch.grp then 1 else 0 end, list_append(path, te.teacher) from ch join te on te.student = ch.at left join mb m on m.id = te.teacher where not list_contains(path, te.teacher))
select id, grp, max(g) as generation from ch group by id, grp"""
)
def generation_map(spark, sf_dir):
    return G.generations(G.teaches(people_edges(spark, sf_dir)), membership(spark, sf_dir))


_CROSS = f"{EDGES}, {_MEMBER}, cr as (select a.grp as grp_a, b.grp as grp_b, src, dst, relation from e join mb a on a.id = src join mb b on b.id = dst where a.grp <> b.grp and relation not in ('belongsToSchool', 'hasFounder'))"


@query(f"with {_CROSS} select grp_a, grp_b, count(*) as n, string_agg(src || '>' || dst || ':' || relation, ';' order by src, dst, relation) as bridges from cr group by all")
def school_influence(spark, sf_dir):
    rows = G.influence(people_edges(spark, sf_dir), membership(spark, sf_dir))
    one = F.concat("src", F.lit(">"), "dst", F.lit(":"), "relation")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "relation", one.alias("one")))), lambda x: x["one"])
    return rows.groupBy("grp_a", "grp_b").agg(F.count("*").alias("n"), F.array_join(listed, ";").alias("bridges"))


@query(f"with {_CROSS} select src, grp_a, grp_b, dst, relation from (select *, row_number() over (partition by src order by grp_b, dst, relation) as r from cr) where r = 1")
def key_bridges(spark, sf_dir):
    rows = G.influence(people_edges(spark, sf_dir), membership(spark, sf_dir))
    return K.first_by_key(rows, ["src"], "grp_b", "dst", "relation").select("src", "grp_a", "grp_b", "dst", "relation")


@query()
def communities(spark, sf_dir):
    return G.communities(people_edges(spark, sf_dir))


@query()
def community_labels(spark, sf_dir):
    """Each community with its size and the school most of its members are in, by size."""
    c = G.communities(people_edges(spark, sf_dir)).join(membership(spark, sf_dir).withColumnRenamed("grp", "school"), "id", "left")
    n = c.groupBy("grp", "school").agg(F.count("*").alias("n"))
    return n.groupBy("grp").agg(F.sum("n").alias("members"), F.min(F.struct((-F.col("n")).alias("k"), "school"))["school"].alias("label")).orderBy(F.desc("members"), "grp")


@query(
    f"with {_CROSS}, o as (select grp_a as school, string_agg(distinct grp_b, ',' order by grp_b) as influences from cr group by grp_a), i as (select grp_b as school, string_agg(distinct grp_a, ',' order by grp_a) as influenced_by from cr group by grp_b)"
    " select coalesce(o.school, i.school) as school, coalesce(influences, '') as influences, coalesce(influenced_by, '') as influenced_by from o full join i on o.school = i.school"
)
def evolution_tree(spark, sf_dir):
    """Which schools each school influences, and is influenced by."""
    rows = G.influence(people_edges(spark, sf_dir), membership(spark, sf_dir)).select("grp_a", "grp_b").distinct()
    out = rows.groupBy(F.col("grp_a").alias("school")).agg(F.array_join(F.array_sort(F.collect_set("grp_b")), ",").alias("influences"))
    back = rows.groupBy(F.col("grp_b").alias("school")).agg(F.array_join(F.array_sort(F.collect_set("grp_a")), ",").alias("influenced_by"))
    return out.join(back, "school", "full").na.fill("")


@query(
    f"""with recursive {EDGES}, {_TEACHES}, {_MEMBER}, ch as (select id, grp, id as at, 0 as g, [id] as path from mb
  union all select ch.id, ch.grp, te.teacher, ch.g + case when m.grp = ch.grp then 1 else 0 end, list_append(path, te.teacher) from ch join te on te.student = ch.at left join mb m on m.id = te.teacher where not list_contains(path, te.teacher)),
ge as (select id, grp, max(g) as generation from ch group by id, grp) select grp, generation, string_agg(id, ',' order by id) as members from ge group by grp, generation"""
)
def generation_members(spark, sf_dir):
    """Per school and generation its members in order."""
    g = generation_map(spark, sf_dir)
    return g.groupBy("grp", "generation").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))
