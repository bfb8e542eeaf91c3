"""Operators on small cases of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.operators import build, entries, graph, knowledge, models, ner, normalize, questions, rdf, relations, service, sparql, vectors
from lorewright.operators.templates import template
from lorewright.plans import graphs
from lorewright.sources import external, turtle
from lorewright.store import drop_stored, stored
from lorewright.streaming import ingest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, T.normalize_whitespace(F.col("x")), x=" a b\t\n\n\n\nc \n") == "ab\n\nc"
    assert one(spark, T.sentences(F.col("x")), x="甲。乙！ 丙") == ["甲。", "乙！", "丙"]
    assert one(spark, T.normalize_punctuation(F.col("x")), x="a──b") == "a——b"
    assert one(spark, T.mint(F.col("x"), "school"), x=" ") == T.NAMESPACE + "unknown_school"
    assert one(spark, T.mint(F.col("x"), "person"), x=" a b ") == T.NAMESPACE + "person/a_b"
    assert one(spark, T.safe_int(F.col("x")), x=" 1498 ") == 1498
    assert one(spark, T.safe_int(F.col("x")), x="c. 1498") is None
    assert one(spark, T.json_span(F.col("x")), x='so: {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert one(spark, T.window(F.col("x"), F.lit(2), F.lit(3), 1), x="abcdef") == "bcd"


def test_entries_with_default_markers(spark):
    files = spark.createDataFrame([("f", "開頭\n卷一\n○何震\n字 主臣\n婺源人\n○文彭\n\n字壽承\n卷二\n○空\n")], "file string, text string")
    rows = entries.split_entries(files, "file", "text").orderBy("section_idx").collect()
    assert [(r.section_idx, r.chapter, r.title, r.content) for r in rows] == [(0, "序", "钱陆灿序", "開頭"), (1, "卷一", "何震", "字 主臣婺源人"), (2, "卷一", "文彭", "字壽承")]


def test_longest_match_and_both_paths(spark):
    words = spark.createDataFrame([("何震", "PERSON"), ("何", "PERSON"), ("震澤", "PLACE"), ("吳門", "PLACE"), ("吳門印派", "SCHOOL")], "word string, etype string")
    docs = spark.createDataFrame([(1, "何震澤何吳門印派吳門"), (2, None), (3, "")], "id long, text string")
    want = [(1, 0, "何震", "PERSON"), (1, 3, "何", "PERSON"), (1, 4, "吳門印派", "SCHOOL"), (1, 8, "吳門", "PLACE")]
    for limit in (ner.AUTOMATON_CHARS, 0):
        assert sorted(map(tuple, ner.dictionary_entities(docs, "id", "text", words, limit).collect())) == want
    assert ner.dictionary_entities(docs, "id", "text", words.limit(0)).collect() == []


NAMES = ["何震", "文彭", "蘇宣", "梁千秋", "千秋", "程原", "丁敬", "江高臣", "陶石公", "何主臣"]


@pytest.mark.parametrize(
    ("text", "fact"),
    [
        ("千秋繼何主臣起", ("千秋", "studentOf", "何主臣", 0.93)),
        ("蘇宣得之文彭", ("蘇宣", "studentOf", "文彭", 0.91)),
        ("何震於文彭師友間", ("何震", "studentOf", "文彭", 0.9)),
        ("自文彭開之，吳門皆宗之", ("文彭", "foundedSchool", "吳門印派", 0.9)),
        ("丁敬開錢塘一派", ("丁敬", "foundedSchool", "浙派", 0.88)),
        ("何震為婺源人", ("何震", "nativePlace", "婺源人", 0.9)),
        ("丁敬屬錢塘派", ("丁敬", "belongsToSchool", "浙派", 0.88)),
        ("程原私淑文彭", ("程原", "studentOf", "文彭", 0.9)),
        ("陶石公從江高臣學印章", ("陶石公", "studentOf", "江高臣", 0.9)),
        ("程原得文彭之傳", ("程原", "studentOf", "文彭", 0.9)),
        ("嫡傳則獨有程原父子", ("程原", "studentOf", "主人", 0.92)),
        ("蘇宣師文彭", ("蘇宣", "studentOf", "文彭", 0.88)),
        ("梁千秋仿何震", ("梁千秋", "influencedBy", "何震", 0.8)),
    ],
)
def test_rules(text, fact):
    found = {x[:4] for x in relations.apply_rules(text, "主人", NAMES)}
    assert fact in found
    if fact[1] == "studentOf":
        assert (fact[2], "teacherOf", fact[0], fact[3]) in found


def test_names_take_the_longest_first():
    assert relations.Names(NAMES).found("梁千秋與千秋") == ["梁千秋", "千秋"]
    assert relations.Names([]).found("梁千秋") == [] and relations.Names(["ab", "bc", "abc"]).found("abcbc") == ["abc", "bc"]


def test_schools(spark):
    for name, want in (("吴门派", "吳門印派"), ("娄东派", "婁東派"), ("無派", "無派")):
        assert one(spark, normalize.school(F.col("x")), x=name) == want


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", "personName", 'A "q"', "literal"), ("b", "personName", "B", "literal"), ("b", "hasTeacher", "a", "iri"), ("a", "hasStudent", "b", "iri"), ("b", "hasFriend", "b", "iri"), ("b", "hasFriend", "a", "iri")]
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string")


def test_union_keeps_duplicates_and_values_are_bound(small):
    rows = sparql.select(small, template("ask_teacher", "B")).collect()
    assert sorted(map(tuple, rows)) == [('A "q"', "hasStudent"), ('A "q"', "hasTeacher")]
    assert [tuple(r) for r in sparql.select(small, template("ask_friend", 'A "q"')).collect()] == [("B",)]
    assert sparql.select(small, template("ask_style_name", '" . ?x ?y ?z . "')).collect() == []
    assert sparql.select(small, "SELECT * WHERE { ?x ex:hasFriend ?x }").collect()[0].x == "b"
    assert len(sparql.select(small, "SELECT ?x ?n WHERE { ?x ex:personName ?n } LIMIT 1").collect()) == 1


@pytest.mark.parametrize("text", ["", "SELECT ?x WHERE { ?x ex:p ?y", "SELECT ?x WHERE { OPTIONAL { ?x ex:p ?y } }", "ASK { ?x ex:p ?y }", "SELECT ?x WHERE { }", "SELECT ?x WHERE { ?x ex:p ?y . FILTER(?y > 3) }"])
def test_outside_the_subset(small, text):
    with pytest.raises(sparql.SparqlError):
        sparql.select(small, text)


def test_turtle_round_trip(spark, tmp_path):
    text = '''@prefix ex: <http://example.org/kg/> . # note
    @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
    ex:a a ex:Person ; ex:name "甲 \\"x\\"\\n"@zh , "B" ; ex:year "1500"^^xsd:integer ; ex:n 12 ;
      ex:knows <http://example.org/kg/b> , ex:c .
    ex:b ex:name """long
    text""" .'''
    rows = set(turtle.parse(text))
    assert ("a", "name", '甲 "x"\n', "literal", "@zh") in rows and ("a", "year", "1500", "literal", "integer") in rows and ("a", "rdf-syntax-ns#type", "Person", "iri", None) in rows and len(rows) == 8
    df = spark.createDataFrame(list(rows), turtle.SCHEMA)
    turtle.write_turtle(df, str(tmp_path / "out"))
    assert turtle.first_graph(spark, [str(tmp_path / "none"), str(tmp_path / "out")]).count() == len(rows)
    back = turtle.read_turtle(spark, str(tmp_path / "out"), full=True)
    assert back.count() == len(rows)
    assert turtle.first_graph(spark, [str(tmp_path / "none")]).collect() == []
    for bad in ("ex:a ex:b ex:c .", "<a> <b> <c>", '<a> <b> "x'):
        with pytest.raises(turtle.TurtleError):
            turtle.parse(bad)


def test_register(spark, tmp_path):
    one_alias = '{"Package":{"PersonAuthority":{"PersonInfo":{"Person":{"BasicInfo":{"PersonId":"1","ChName":"何震","YearBirth":"1535","YearDeath":"?","Dynasty":"明","IndexAddr":"x"},"PersonAliases":{"Alias":{"AliasType":"字","AliasName":"主臣"}},"PersonAddresses":{"Address":[{"AddrName":"婺源"},{"AddrName":"y"}]},"PersonPostings":""}}}}}'
    nameless = '{"Package":{"PersonAuthority":{"PersonInfo":{"Person":{"BasicInfo":{"PersonId":"2","ChName":""}}}}}}'
    (tmp_path / "r.txt").write_text("\n".join([one_alias, nameless, "not json", ""]))
    rows = external.register_persons(external.read_register(spark, str(tmp_path / "r.txt"))).collect()
    assert [tuple(r) for r in rows] == [("1", "何震", "主臣", None, 1535, None, "婺源", "明", "")]


def test_index_of_another_model(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0])], "id long, unit array<double>")
    external.save_index(v, str(tmp_path / "i"), "m1")
    assert external.load_index(spark, str(tmp_path / "i"), "m1").count() == 1
    assert external.load_index(spark, str(tmp_path / "i"), "m2").count() == 0


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "r") for a, b in pairs], "src string, dst string, relation string")


def test_centralities_by_hand(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "e")])
    close = {r.id: r.closeness for r in graph.closeness(e).collect()}
    assert close["a"] == 0 and close["b"] == pytest.approx(1 / 4) and close["e"] == pytest.approx(4 / (1 + 2 + 2 + 3))
    between = {r.id: r.betweenness for r in graph.betweenness(e).collect()}
    assert between["b"] == pytest.approx(3 / 12) and between["d"] == pytest.approx(3 / 12) and between["c"] == pytest.approx(0)
    ranks = {r.id: r.rank for r in graph.pagerank(e, 60).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == "e"


def test_centralities_by_blocks_of_starts(spark, monkeypatch):
    pairs = [(f"n{i}", f"n{(i * k + 1) % 17}") for i in range(17) for k in (1, 3, 5)] + [("n3", "x"), ("x", "n3"), ("y", "y")]
    e = edges(spark, pairs)
    whole = [{r.id: r[1] for r in f(e).collect()} for f in (graph.closeness, graph.betweenness)]
    monkeypatch.setattr(graph, "SEARCH_ROWS", 64)
    blocks = [{r.id: r[1] for r in f(e).collect()} for f in (graph.closeness, graph.betweenness)]
    for a, b in zip(whole, blocks, strict=True):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    none = edges(spark, [("a", "b")]).limit(0)
    assert graph.closeness(none).count() == graph.betweenness(none).count() == 0


def test_betweenness_searches_in_memory(spark, monkeypatch):
    """Levels cost no jobs where a graph fits a task, and joins say the same of one that doesn't."""
    n = 200
    line = edges(spark, [(f"n{i:03}", f"n{i + 1:03}") for i in range(n - 1)])
    before = graph.n_stored()
    got = {r.id: r.betweenness for r in graph.betweenness(line).collect()}
    assert graph.n_stored() - before <= 4
    assert all(got[f"n{i:03}"] == pytest.approx(i * (n - 1 - i) / ((n - 1) * (n - 2))) for i in range(n))
    e = edges(spark, [(f"n{i}", f"n{(i * k + 1) % 23}") for i in range(23) for k in (1, 3, 5, 7)] + [("n3", "x"), ("x", "n3"), ("y", "y"), ("z", "x")])
    monkeypatch.setattr(graph, "HELD", 300)
    near = {r.id: r.betweenness for r in graph.betweenness(e).collect()}
    monkeypatch.setattr(graph, "GRAPH_EDGES", 0)
    monkeypatch.setattr(graph, "SEARCH_ROWS", 200)
    joined = {r.id: r.betweenness for r in graph.betweenness(e).collect()}
    assert near.keys() == joined.keys() and max(near.values()) > 0 and all(near[k] == pytest.approx(joined[k]) for k in near)


def test_communities(spark):
    blocks = [[f"{c}{i}" for i in range(6)] for c in "abc"]
    pairs = [(x, y) for b in blocks for i, x in enumerate(b) for y in b[:i]] + [("a0", "b0"), ("b1", "c1")]
    e = edges(spark, pairs)
    found = graph.communities(e)
    assert sorted((r.id, r.grp) for r in found.collect()) == sorted((x, b[0]) for b in blocks for x in b)
    alone = graph.node_ids(e).withColumn("grp", F.col("id"))
    assert graph.modularity(e, found) > 0.5 > 0 > graph.modularity(e, alone)


def test_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("d", "a")])
    assert [(r.src, r.dst) for r in graph.shortest_path(e, "a", "d").orderBy("hop").collect()] == [("a", "b"), ("b", "c"), ("c", "d")]
    assert graph.shortest_path(e, "d", "nobody").collect() == []
    assert sorted(r.path for r in graph.all_paths(e, "a", "d").collect()) == ["a → b → c → d", "a → x → c → d"]
    assert {r.id: r.depth for r in graph.lineage(spark.createDataFrame([("t", "s"), ("u", "t"), ("s", "u")], "teacher string, student string"), "s").collect()} == {"t": 1, "u": 2}


def test_questions(spark):
    def spans(q):
        return one(spark, questions.entity_spans(questions.stripped(F.col("q"))), q=q)

    assert spans("请问文彭是谁？") == ["文彭"] and spans("文彭和何震是什么关系？") == ["文彭", "何震"] and spans("何震的弟子有哪些") == ["何震"]
    for q, kind in (("何震的弟子有哪些", "query_student"), ("文彭的老师是谁", "query_relation"), ("浙派有哪些人", "query_school"), ("文彭与何震的关系", "query_path"), ("你觉得文彭好不好", "opinion"), ("文彭的字", "query_attribute"), ("天气", "unknown")):
        assert one(spark, questions.intent(F.col("q")), q=q) == kind


def test_inverses_are_idempotent(spark):
    f = spark.createDataFrame([("a", "education:studentOf", "b"), ("b", "education:teacherOf", "a"), ("c", "kinship:fatherOf", "d")], "subject string, predicate string, object string")
    once = knowledge.with_inverses(f)
    assert sorted(map(tuple, once.collect())) == sorted([*map(tuple, f.collect()), ("d", "kinship:sonOf", "c")])
    assert knowledge.with_inverses(once).count() == once.count()


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(300).write.parquet(str(tmp_path / "in"))
    events.limit(300).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed(ingest.fresh(stream, ["event_id"], "ts"), "ts", "event_type", "value", "1 day", late=None).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").count() > 0 and spark.table("windows").agg(F.sum("n")).first()[0] <= 300
    t = stream.select(F.col("user_id").cast("string").alias("s"), F.lit("did").alias("p"), F.col("event_type").alias("o"))
    for k in range(2):
        ingest.append_triples(t, str(tmp_path / "kg"), str(tmp_path / f"cp{k}")).awaitTermination(120)
    want = events.limit(300).select("user_id", "event_type").distinct().count()
    assert spark.read.parquet(str(tmp_path / "kg")).count() == want


def test_a_failing_model_gives_way_to_rules(spark):
    def model(prompts):
        if "2" in prompts:
            raise RuntimeError("down")
        return ['{"entities": [{"name": "甲", "type": "person"}]}'] * len(prompts)

    rows = spark.createDataFrame([(1,), (2,)], "id long").repartition(2, "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    answers = models.ask(rows, F.col("id").cast("string"), model)
    found = models.entities(answers, "id", "answer")
    rules = rows.select("id", F.lit("乙").alias("name"), F.lit("PERSON").alias("etype"), F.lit(0.5).alias("confidence"), F.lit("").alias("evidence"))
    assert sorted((r.id, r.name) for r in models.with_rules(found, rules).collect()) == [(1, "甲"), (2, "乙")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_records_of_every_kind(spark):
    for kind, (cls, label, _) in rdf.RECORDS.items():
        rows = rdf.records(spark.createDataFrame([("a b", None)], "name string, description string"), kind).collect()
        assert {(r.p, r.o) for r in rows} == {(rdf.TYPE, cls), (label, "a b")}
        assert {r.s for r in rows} == {"a_b" if kind == "person" else f"{kind}/a_b"}
    work = rdf.records(spark.createDataFrame([("w", "x y")], "name string, creator string"), "work").collect()
    assert ("x_y", "createdWork", "work/w") in {(r.s, r.p, r.o) for r in work}


def test_service(small):
    ok, error, rows = service.execute(small, "SELECT ?x WHERE { ?x ex:hasTeacher ?y }")
    assert ok and not error and [r.x for r in rows.collect()] == ["b"]
    assert service.execute(small, "DELETE")[0] is False
    calls = []
    views = service.Views(lambda: calls.append(1) or small)
    assert views.graph().count() == views.graph().count() and len(calls) == 1
    views.reload()
    views.triples()
    assert len(calls) == 2
    assert service.path(small, "b", "a").first().path == "b → a" and service.path(small, "a", "z").first().found is False


def test_corpus_to_graph(spark):
    files = spark.createDataFrame([("f", "卷一\n○主人\n千秋繼 何主臣起。蘇宣得之文彭。丁敬屬錢塘派。\n")], "file string, text string")
    people = spark.createDataFrame([(n,) for n in ("千秋", "何主臣", "蘇宣", "文彭", "丁敬")], "name string")
    aliases = spark.createDataFrame([("何主臣", "何震", "PERSON"), ("千秋", "梁千秋", "PERSON")], "alias string, standard string, etype string")
    known = spark.createDataFrame([("文彭", "social:friendOf", "何震", 0.95, "known", "", "")], "subject string, predicate string, object string, confidence double, method string, evidence string, chapter string")
    facts, triples = build.build(build.preprocess(files), people, aliases, known)
    got = {(r.subject, r.predicate, r.object) for r in facts.collect()}
    assert {("梁千秋", "education:studentOf", "何震"), ("何震", "education:teacherOf", "梁千秋"), ("蘇宣", "education:studentOf", "文彭"), ("丁敬", "school:belongsTo", "浙派"), ("文彭", "social:friendOf", "何震")} <= got
    rows = {(r.s, r.p, r.o) for r in triples.collect()}
    assert {("梁千秋", "hasTeacher", "何震"), ("何震", "hasStudent", "梁千秋"), ("丁敬", "belongsToSchool", "school/浙派"), ("school/浙派", "schoolName", "浙派")} <= rows


def test_embeddings_of_a_model_and_without(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string").coalesce(1)
    out = {r.id: r.unit for r in vectors.embed(rows, "id", "text", lambda texts: [[3.0, 4.0] if t else None for t in texts], 2).collect()}
    assert out[1] == pytest.approx([0.6, 0.8]) and sum(x * x for x in out[2]) == pytest.approx(1)
    failing = vectors.embed(rows, "id", "text", lambda texts: 1 / 0, 4).collect()
    assert all(len(r.unit) == 4 for r in failing)


def test_stored_tables_can_be_dropped(spark):
    import lorewright.store as store

    kept, store._written = store._written, []
    df = stored(spark.range(3).toDF("id"), "t")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2]
    assert drop_stored(spark) == 1 and drop_stored(spark) == 0
    with pytest.raises(Exception, match="(?i)not.exist|PATH|File"):
        df.collect()
    store._written = kept


def test_tails_in_list_order_and_longest_first_agree():
    """Of two ends that fit, the longer one comes first in the list, so both orders cut the same."""
    for i, a in enumerate(questions.TAILS):
        assert not any(b.endswith(a) for b in questions.TAILS[i + 1 :]), a


def test_relations_with_a_large_dictionary(spark):
    """A dictionary beyond the limit is joined by n-grams, with the same result."""
    rows = [("c", "t", "千秋繼何震起。蘇宣得之文彭。"), ("c", "u", "梁千秋仿何震。"), ("c", "v", None), ("c", "w", "")]
    entries = spark.createDataFrame(rows, "chapter string, title string, content string")
    known = spark.createDataFrame([(n,) for n in [*NAMES, *NAMES, None, ""]], "name string")
    small, large = (sorted(relations.extract_relations(entries, known, limit=n).collect()) for n in (10**6, 3))
    assert small == large == sorted(relations.extract_relations(entries, list(NAMES)).collect()) and len(small) >= 5


def test_products_of_query_parts(spark):
    t = spark.createDataFrame([("a", "p", "1", "literal"), ("b", "p", "2", "literal"), ("c", "q", "3", "literal")], "s string, p string, o string, o_kind string")
    x = "http://example.org/inkperson/"
    got = sparql.select(t, f"PREFIX ex: <{x}> SELECT ?a ?v WHERE {{ ?a ex:p ?o . ?b ex:q ?v }}").collect()
    assert sorted((r.a, r.v) for r in got) == [("a", "3"), ("b", "3")]
    with pytest.raises(sparql.SparqlError):
        sparql.select(t, f"PREFIX ex: <{x}> SELECT ?a ?b WHERE {{ ?a ex:p ?o . ?b ex:p ?v }}").collect()


def test_generated_queries(spark):
    t = spark.createDataFrame([("a", "personName", "n", "literal")], "s string, p string, o string, o_kind string")
    rows, error = questions.generated_query(t, "好：PREFIX ex: <http://x/> SELECT ?o WHERE { ?s ex:personName ?o } 完")
    assert [r.o for r in rows.collect()] == ["n"] and error == ""
    assert questions.generated_query(t, None) == questions.generated_query(t, "nothing") == (None, "no query")
    assert questions.generated_query(t, "SELECT ?s WHERE { DROP }")[0] is None


def test_long_chains_of_teachers(spark):
    pairs = spark.createDataFrame([(f"p{i:02}", f"p{i + 1:02}") for i in range(30)] + [("p30", "p00"), ("x", "p05")], "teacher string, student string")
    members = spark.createDataFrame([(f"p{i:02}", "a") for i in range(31)] + [("x", "b")], "id string, grp string")
    got = {r.id: r.generation for r in graph.generations(pairs, members).collect()}
    assert got == {**{f"p{i:02}": 30 for i in range(31)}, "x": 0}


def test_communities_of_a_long_ring(spark):
    """Moves go on until modularity stops growing: groups of a ring come near the best size."""
    n = 60
    e = spark.createDataFrame([(f"n{i:03}", f"n{(i + 1) % n:03}", "r") for i in range(n)], "src string, dst string, relation string")
    found = graph.communities(e)
    assert found.count() == n and graph.modularity(e, found) > 0.68


def test_communities_in_one_task(spark, monkeypatch):
    """Moves cost no jobs where a graph fits a task, and give groups as good as those by joins."""
    n = 40
    cliques = [(f"c{c:02}{x}", f"c{c:02}{y}") for c in range(n) for x in "abcde" for y in "abcde" if x != y]
    e = edges(spark, cliques + [(f"c{c:02}a", f"c{(c + 1) % n:02}e") for c in range(n)] + [("loop", "loop")])
    before = graph.n_stored()
    found = graph.communities(e)
    assert graph.n_stored() - before <= 4
    near = {r.id: r.grp for r in found.collect()}
    assert len(near) == 5 * n and all(near[k] == min(x for x in near if near[x] == near[k]) for k in near)
    assert all(near[f"c{c:02}{x}"] == near[f"c{c:02}a"] for c in range(n) for x in "bcde")
    assert near == {r.id: r.grp for r in graph.communities(e.repartition(7, "dst")).collect()}
    few = edges(spark, cliques[:60] + [("c00a", "c01e"), ("c01a", "c02e")])
    whole = graph.modularity(few, graph.communities(few))
    assert graph.communities(few.limit(0)).count() == 0
    monkeypatch.setattr(graph, "GRAPH_EDGES", 0)
    assert whole >= graph.modularity(few, graph.communities(few)) - 1e-9 > 0.5
    assert graph.communities(few.limit(0)).count() == 0


def test_orders_of_moves_at_once(spark, monkeypatch):
    """Each order in which nodes move is a task of its own, and gives the groups that one task gives that tries them all."""
    draw = np.random.default_rng(1)
    e = edges(spark, [(f"n{x:03}", f"n{y:03}") for x, y in draw.integers(0, 300, (900, 2))])
    kept = {}
    monkeypatch.setattr(graph, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    near = {r.id: r.grp for r in graph.communities(e).collect()}
    assert len(kept["groups"].inputFiles()) == graph.ORDERS
    kept.clear()
    monkeypatch.setattr(graph, "ORDER_EDGES", 0)
    assert near == {r.id: r.grp for r in graph.communities(e).collect()}
    assert len(kept["groups"].inputFiles()) == 1
    assert len(near) > 290 and len(set(near.values())) > 3


def test_moves_gain_modularity():
    """On random graphs: no single move of the last groups gains, and any resolution ends."""
    for seed in range(20):
        draw = np.random.default_rng(seed)
        x, y = np.unique(np.sort(draw.integers(0, 30, (80, 2))), axis=0).T
        x, y = x[x != y], y[x != y]
        names, x = np.unique(np.concatenate([x, y]), return_inverse=True)
        a, b = x, np.concatenate([x[len(y) :], x[: len(y)]])
        k, two_m = np.bincount(a), len(a)

        def value(grp, r):
            return np.mean(grp[a] == grp[b]) - r * np.sum((np.bincount(grp, k) / two_m) ** 2)

        for r in (0.3, 1.0, 2.7):
            grp = graph._louvain(a, b, r)
            assert len(grp) == len(names) and value(grp, r) >= value(np.arange(len(names)), r)
            for i in range(len(names)):
                for c in set(grp[b[a == i]]):
                    moved = grp.copy()
                    moved[i] = c
                    assert value(moved, r) <= value(grp, r) + 2 / two_m**2


def test_community_labels_cost_few_jobs(spark):
    """Labels count every node once, and no round of moves is a job."""
    sf = "/root/testdata/sf0.01"
    before = graph.n_stored()
    rows = graphs.community_labels(spark, sf).collect()
    assert graph.n_stored() - before <= 4
    schools = {r.id: r.grp for r in graphs.membership(spark, sf).collect()}
    groups = {}
    for r in graphs.communities(spark, sf).collect():
        groups.setdefault(r.grp, []).append(schools[r.id])
    assert {r.grp: r.members for r in rows} == {k: len(v) for k, v in groups.items()}
    assert all(r.label == min(groups[r.grp], key=lambda x: (-groups[r.grp].count(x), x)) for r in rows)
