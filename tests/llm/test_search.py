"""URL filter, HTML, top-k, chat and embeddings."""

import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.llm import lattice, urls
from lorewright.llm.chat import render
from lorewright.llm.html import extract, main_text
from lorewright.llm.topk import search

SF = "/root/testdata/sf0.001"


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize(("limit", "hot"), [(urls.BROADCAST_BLOCKS, urls.HOT_ROWS), (0, 2)])
def test_urls(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", limit)
    monkeypatch.setattr(urls, "HOT_ROWS", hot)
    rules = [*urls.RULES, ("block", "a.b", "/x"), ("allow", "a.b", "/xy/z"), *(("block", f"h{i}.org", "/") for i in range(500))]
    given = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "https://x.net/es/1", "http://net/fr/", "http://a.b/xy/z1", "http://q.a.b/xy", "http://a.b", "ftp://h7.org/?", "http://xh7.org/", "http://u:p@com/", "a://b://com/", "http://É.com/", "http://" + "x." * 3000 + "net/es/", "http://a..com/", "http://.com./"]
    given += given[:6] + ["http://example.com/en/"] * 5
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(given)], "page_id long, url string, host string, verdict string")
    out = urls.judge(df, urls.rule_table(spark, rules), carry=("page_id",)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: brute_rule(u, rules) for i, u in enumerate(given)}
    assert urls.judge(df.limit(0), urls.rule_table(spark, rules)).collect() == []
    none = urls.judge(df, urls.rule_table(spark, rules).limit(0), carry=("page_id",)).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == len(given)


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h2>Site</h2><p>slogan</p></header>
    <nav><ul><li><a href="/a">Home</a></ul></nav><div id="cookie-notice"><p>We use cookies to make this long notice look like an article, which it is not.</p></div>
    <div class="layout with-sidebar"><main><article><header><h1>Head &amp; line</h1><p>By X</p></header><p>First <b>bold
     text</b>&nbsp;here.<p>Second &lt;tag&gt;<br>line.<aside><p>Pull</p></aside><div class="ad">Buy</div><ul><li>one<li>two</ul><!-- note --><form><input>Name</form>
    <blockquote>Q</blockquote></article><section class="comments"><h3>Comments</h3><article class="comment"><p>Nice article, I read all of it and want to say a lot about it here.</p></article></section></main>
    <aside>Side</aside></div><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == "Head & line\n\nFirst bold text here.\n\nSecond <tag> line.\n\none\n\ntwo\n\nQ"


def test_main_text_without_an_article():
    text = "A sentence of the article that has quite a number of words in it. " * 3
    page = f"<div><a href='/'>Home</a> <a href='/b'>News</a></div><div><p>{text}</p><p>Short.</p><p>{text}</p></div><div><a href='/x'>Other {text}</a></div><div class='footer'>{text}</div>"
    assert main_text(page).split("\n\n") == [text.strip(), "Short.", text.strip()]
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x</script><!-- y") == ""
    assert main_text("just text") == "just text"


def test_long_and_broken_pages():
    assert len(main_text("<article>" + "<p>word " * 20_000)) == 20_000 * 6 - 2
    assert main_text("<div>" * 3000 + "x" + "</p></b>" * 10) == "x"
    assert main_text('<article><p class="a>b">x</p><p title=\'"\'>y</article>') == "x\n\ny"


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = extract(pages, carry=("page_id", "url")).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) > 0 and "track(" not in r.text and "©" not in r.text for r in rows)
    odd = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in extract(odd, carry=("page_id", "url")).collect()) == [(1, "", 0), (1, "", 0), (2, "x", 1)]


def brute_top(rows, k=5):
    v = {i: np.floor(np.array(x, np.float64) * 256) for i, x in rows}
    out = {}
    for q in sorted(v):
        if q % 50 == 0:
            best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return {q: x for q, x in out.items() if x}


def top(df):
    out = defaultdict(list)
    for r in search(df, F.col("vec_id") % 50 == 0).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_topk(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert top(df) == brute_top([(r.vec_id, r.embedding) for r in df.collect()])


def test_topk_ties_nulls_and_few(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.5, 0.25 * (i % 2)]) for i in range(0, 120)]
    bad = [(200, None), (250, [nan, 1.0]), (300, [1.0, None]), (350, [inf, 0.0])]
    schema = "vec_id long, embedding array<float>, score long, rank int"
    df = spark.createDataFrame([(*r, 1, 1) for r in good + bad + [(None, [1.0, 1.0])]], schema)
    assert top(df) == brute_top(good)
    assert top(spark.createDataFrame([(0, [1.0], 1, 1), (1, [2.0], 1, 1)], schema)) == {0: [(1, 1, 131072)]}
    assert top(df.limit(0)) == {}


def test_topk_repeated_ids(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(4).round(2).tolist()) for i in range(300)]
    rows += rows + [rows[7]] * 20  # every row twice, one often
    rows += [(i, r.standard_normal(4).round(2).tolist()) for i in range(0, 300, 3) for _ in range(i % 4)]  # several vectors of an id
    rows += [(i, r.standard_normal(2).round(2).tolist()) for i in (0, 0, 3, 50, 51, 299)]  # and of another length
    best = defaultdict(lambda: defaultdict(lambda: -np.inf))
    for q, x in rows:
        for i, y in rows:
            if q % 50 == 0 and i != q and len(x) == len(y):
                best[q][i] = max(best[q][i], int(np.floor(np.array(x) * 256) @ np.floor(np.array(y) * 256)))
    want = {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted((-s, i) for i, s in of.items())[:5])] for q, of in best.items()}
    assert top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == want


def test_topk_large_components(spark):
    r = np.random.default_rng(6)
    size = [1.0, 1e6, 3e7, 1e9, 1e15, 1e18, 1e200, 2e307]
    rows = [(i, [float(x) for x in r.standard_normal(5) * size[int(r.integers(1 + i % len(size)))]]) for i in range(200)]
    rows += [(300, [1e25, -1e25, 1.0, 0.0, 0.0]), (350, [1e25, 1e25, 3.0, 0.0, 0.0]), (351, [1e25, 1e25, 4.0, 0.0, 0.0])]
    big = np.finfo(np.float64).max
    v = {i: [int(max(-big, min(big, np.floor(np.float64(y) * 256)))) for y in x] for i, x in rows}
    most = (1 << 63) - 1
    want = {}
    for q in v:
        if q % 50 == 0:
            best = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v[q], x, strict=True)))), i) for i, x in v.items() if i != q)[:5]
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for some in (rows, [(i, [y / abs(y) * 1e6 if y else 0.0 for y in x]) for i, x in rows[:120]]):
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>")
        assert top(df) == (want if some is rows else brute_ints(some))


def brute_ints(rows):
    v = {i: [int(np.floor(y * 256)) for y in x] for i, x in rows}
    return {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v[q], x, strict=True)), i) for i, x in v.items() if i != q)[:5])] for q in v if q % 50 == 0}


def test_chat(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", "more")
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [a, c], 6: [b], 7: [("user", None)], 8: [("user", ""), b]}
    rows = [(k, i, r, t) for k, v in logs.items() for i, (r, t) in enumerate(v)]
    rows += [(3, 0, *a), (None, 0, *a), (9, None, None, "x"), (9, 5, "user", "y" * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    out = {r.conv_id: r for r in render(df).collect()}
    assert set(out) == {3, 5, 6, 8, 9} and out[3].copies == 2 and out[3].n_turns == 3
    assert out[3].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert out[9].text.startswith("<|im_start|>\nx<|im_end|>") and render(df.limit(0)).collect() == []


def test_chat_has_no_python(spark):
    df = render(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))


def near(spark, n=1200, dim=64):
    r = np.random.default_rng(3)
    base = r.standard_normal((n // 6, dim))
    rows = []
    for i in range(n):
        v = base[r.integers(len(base))] if i % 3 else base[0]
        noise = r.standard_normal(dim) * r.choice([0.0, 0.08, 0.14, 0.19, 0.3])
        rows.append((i, (v + noise).astype(np.float32).tolist(), int(i % 2)))
    return rows


def test_lattice_recall_and_precision(spark):
    rows = near(spark)
    out = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links = defaultdict(set)
    for label in (0, 1):
        some = [r for r in rows if r[2] == label]
        v = np.array([r[1] for r in some], np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(v @ v.T >= 0.98), strict=True):
            if a != b:
                links[some[a][0]].add(some[b][0])
    want = sum(map(len, links.values()))
    assert all(r.n_links <= len(links[k]) for k, r in out.items())
    assert sum(r.n_links for r in out.values()) >= 0.97 * want > 1000
    for k, r in out.items():
        assert r.kept == (r.component_id == k) and (r.n_links == 0) == (not links[k] or r.n_links == 0)


def test_lattice_odd_rows(spark):
    nan = float("nan")
    v = [1.0] + [0.0] * 63
    w = [2.0] + [0.0] * 63
    rows = [(5, v, 1), (3, v, 1), (4, v, 2), (6, v, None), (7, None, 1), (8, [0.0] * 64, 1), (9, [nan] * 64, 1), (10, [None, *v[1:]], 1), (11, w, 1), (12, [], 1), (13, [1.0], 1), (14, [3.0], 1), (3, v, 1), (None, v, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, component long")
    out = lattice.near_duplicates(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert got[3] == got[5] == got[11] == (2, 3) and got[13] == got[14] == (1, 13)
    assert all(got[k] == (0, k) for k in (4, 6, 7, 8, 9, 10, 12)) and got[None] == (0, None)
    assert lattice.near_duplicates(df.limit(0)).collect() == []


def test_cells_are_nearest_points():
    r = np.random.default_rng(0)
    x = r.standard_normal((50, 8)) * 2
    near_ = lattice.cells(x)[0] / 2
    far = ((x - near_) ** 2).sum(axis=1)
    assert (far <= 1 + 1e-9).all()  # the covering radius of E8 is 1
    whole = np.isclose(near_, np.rint(near_)).all(axis=1)
    half = np.isclose(near_ - 0.5, np.rint(near_ - 0.5)).all(axis=1)
    assert (whole | half).all() and (np.mod(near_.sum(axis=1), 2) == 0).all()
    for _ in range(200):
        step = np.zeros(8)
        i, j = r.choice(8, 2, replace=False)
        step[i], step[j] = r.choice([-1, 1], 2)
        assert (((x - near_ - step) ** 2).sum(axis=1) >= far - 1e-9).all()


LONG = "A sentence of the article that has quite a number of words in it, and then some more. "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div class='content-with-sidebar'><div id='content'><h1>T</h1><div><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{LONG}</p></div></div><div class='sidebar-content'>{LONG}</div></div></body>", ["T", LONG, "Short.", LONG]),
        (f"<div class='ad-container'>{LONG}</div><div class='post-body'><p>x</p><div class='sponsored-content'>{LONG}</div><p>{LONG}</p></div><ol class='commentlist'><li>{LONG}</ol>", ["x", LONG]),
        (f"<article class='category-social'><div class='entry-header'><h1>H</h1><span>by Z</span></div><p>{LONG}</p></article><article class='teaser'><p>{LONG * 9}</p></article>", ["H", LONG]),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><p>&copy; 2020 us</p>", [LONG, LONG]),
        (f"<div role='navigation'>{LONG}</div><div role='main'><p>{LONG}</p><div class='share'>Share</div></div><div hidden>{LONG}</div><div style='display: none'>{LONG}</div>", [LONG]),
        (f"<table><tr><td><a href=x>a</a><td>{LONG}<p>b</table>", [LONG, "b"]),
        ("<article><p>&#x41;&eacute;&nbsp;&nbsp;&lt;b&gt;&unknown;&amp;amp;</p></article>", ["Aé <b>&unknown;&amp;"]),
    ],
)
def test_shapes_of_pages(page, want):
    assert main_text(page) == "\n\n".join(x.strip() for x in want)


LINKS = "<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a><li><a href=d>Four</a></ul>"
NAMES = ["One", "Two", "Three", "Four"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><p>{LONG * 4}</p>{LINKS}<p>{LONG * 2}</p></div><div>{LINKS}</div>", [LONG * 4, *NAMES, LONG * 2]),
        (f"<body>{LINKS}<div><p>{LONG * 2}</p></div><div>{LINKS}</div><div><p>{LONG * 4}</p></div></body>", [LONG * 2, LONG * 4]),
        (f"<div>{LINKS}<h1>Head</h1><p>By X</p><p>2020</p><p>Short one.</p><p>{LONG * 3}</p></div>", ["Head", "By X", "2020", "Short one.", LONG * 3]),
        (f"<div><h1>Head</h1><p>By X</p><p>2020</p><p>Short.</p><div><p>{LONG * 3}</p></div>{LINKS}<div><p>{LONG * 3}</p></div></div>", ["Head", "By X", "2020", "Short.", LONG * 3, *NAMES, LONG * 3]),
        (f"<div><p>{LONG * 3}</p>{LINKS}<p>The end.</p></div><div>{LINKS}</div>", [LONG * 3, *NAMES, "The end."]),
    ],
)
def test_stretches_of_pages_without_an_article(page, want):
    assert main_text(page) == "\n\n".join(x.strip() for x in want)


def brute_blocks(boxes):
    """Texts kept of a page of boxes of (text, length outside links) lines, by the definition, line by line."""
    rows = [(b, t, n) for b, box in enumerate(boxes) for t, n in box]
    kept = set()
    i = 0
    spans = []
    while i < len(rows):
        if rows[i][2] and sum(r[2] for r in rows[i : i + 3]) > 120:
            j = i + 1
            while j < len(rows) and sum(r[2] for r in rows[j : j + 3]):
                j += 1
            spans.append((i, j))
            i = j
        else:
            i += 1
    if not spans:
        return [t for _, t, n in rows if n]
    for n, (i, j) in enumerate(spans):
        kept |= set(range(i, j))
        k = i - 1
        while k >= (spans[n - 1][1] if n else 0) and rows[k][0] == rows[i][0]:
            if rows[k][2]:
                kept |= set(range(k, i))
            k -= 1
        for b in {rows[x][0] for x in range(i, j)}:
            if sum(rows[x][2] for x in range(i, j) if rows[x][0] == b) > 120:
                own = [x for x, r in enumerate(rows) if r[0] == b and r[2]]
                kept |= set(range(own[0], own[-1] + 1))
    at = sorted(kept)
    for a, z in zip(at, at[1:]):
        if rows[a][0] == rows[z][0]:
            kept |= set(range(a, z))
    return [rows[x][1] for x in sorted(kept)]


def test_line_blocks_against_brute_force():
    r = np.random.default_rng(8)
    cut = 0
    for _ in range(400):
        boxes = []
        for _ in range(r.integers(1, 6)):
            box = []
            for _ in range(r.integers(1, 9)):
                text = "x" * int(r.choice([3, 20, 45, 90, 200]))
                box.append((text, 0 if r.random() < 0.45 else len(text)))
            boxes.append(box)
        page = "<body>" + "".join("<div>" + "".join(f"<p>{t}</p>" if n else f"<p><a href=u>{t}</a></p>" for t, n in box) + "</div>" for box in boxes) + "</body>"
        want = brute_blocks(boxes)
        cut += len(want) < sum(map(len, boxes))
        assert main_text(page) == "\n\n".join(want), boxes
    assert cut > 200


def test_named_boxes_add_weight_only():
    body = "A sentence. " * 30
    assert main_text(f"<div class='content'><p>One.</p></div><p>{body}</p>") == f"One.\n\n{body.strip()}"
    assert main_text(f"<article><p>{body}</p></article><article><p>B {body}</p></article>") == f"{body.strip()}\n\nB {body.strip()}"
    assert main_text(f"<div><p>{body}</p></div><article><p>B {body}</p></article>") == f"B {body.strip()}"
    assert main_text(f"<div class='main'><p>{body}</p></div><div><p>{body * 3}</p></div>").count(body.strip()) == 4


@pytest.mark.parametrize("page", ["<" + "a" * 1_000_000, "<a " * 350_000, "<a x='" * 170_000 + ">", "<div>" * 200_000 + "x", "<script>" + "</script " * 110_000, "<!" * 500_000, "<i><div>" * 100_000 + "</i>" * 90_000, '<a "' * 250_000 + ">"])
def test_broken_markup_takes_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 3


def test_lattice_extreme_norms_and_labels(spark):
    r = np.random.default_rng(9)
    v = r.standard_normal(64)
    far = r.standard_normal(64)
    rows = [(k, (v * s).tolist(), "a") for k, s in enumerate([1e200, 3e200, 1e-200, 1e-290, 1.0, 1e307])] + [(10, (far * 1e200).tolist(), "a"), (11, (far * 1e-200).tolist(), "a"), (20, (v * 2e200).tolist(), "b"), (21, v.tolist(), "")]
    out = {x.vec_id: (x.n_links, x.component_id) for x in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert out == {**{k: (5, 0) for k in range(6)}, 10: (1, 10), 11: (1, 10), 20: (0, 20), 21: (0, 21)}


@pytest.mark.parametrize("block", [8, 8192])
def test_lattice_large_cells(spark, monkeypatch, block):
    """Cells of many vectors, cut into blocks or not, hot ones joined apart or not."""
    from lorewright.llm import skew

    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(lattice, "BLOCK_NUMBERS", 64 * block)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    r = np.random.default_rng(4)
    base = r.standard_normal(64)
    vs = [(base + r.standard_normal(64) * 0.04) for _ in range(150)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*vs, *vs[:40], *[vs[3]] * 60])] + [(7, vs[7].tolist(), 1)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    m = np.array([v for _, v, _ in rows[:250]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = (m @ m.T >= 0.98).sum(axis=1) - 1
    out = {x.vec_id: x for x in lattice.near_duplicates(df).collect()}
    assert all(out[i].component_id == 0 for i in range(250))
    assert [out[i].n_links for i in range(250)] == want.tolist()
