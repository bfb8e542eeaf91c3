"""Each stage on its own input, held against brute force."""

from collections import Counter

import pytest

import corpus_pipeline as P
from lorewright.llm import langid
from lorewright.store import n_stored, stored
from tests.llm.test_documents import brute_passages
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in P.STAGES:
        out.append(stored(f(spark, out[-1], SF), name))
    return out


def test_language(steps):
    pred = {r.doc_id: r for r in langid.identify(steps[0]).collect()}
    assert {r.doc_id for r in steps[1].collect()} == {k for k, r in pred.items() if r.lang_pred != "und" and r.score >= P.LEAST_SCORE}
    assert steps[1].columns == steps[0].columns


def test_lines(steps):
    want = {k: v for k, v in brute_passages([(r.doc_id, r.text) for r in steps[1].collect()]).items() if v}
    got = {r.doc_id: r.text.encode().split() for r in steps[2].collect()}
    assert got == want and steps[2].columns == steps[0].columns
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_duplicates(steps):
    want = {k for k, (_, c) in brute([(r.doc_id, r.text) for r in steps[2].collect()]).items() if k == c}
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(want)


def test_mixing(steps):
    given = {r.doc_id: r for r in steps[3].collect()}
    out = Counter(r.doc_id for r in steps[4].collect())
    assert set(out) <= set(given) and max(out.values()) <= 2
    size, taken = Counter(), Counter()
    for k, r in given.items():
        n = len(r.text.encode().split())
        size[r.source] += n
        taken[r.source] += n * out[k]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    full = set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        free = [s for s in size if s not in full]
        goal = {s: 2 * size[s] if s in full else left * weights[s] / sum(weights[f] for f in free) for s in size}
        if not (over := {s for s in free if goal[s] > 2 * size[s]}):
            break
        full |= over
    longest = Counter()
    for r in given.values():
        longest[r.source] = max(longest[r.source], len(r.text.encode().split()))
    assert all(-1 <= taken[s] - goal[s] <= longest[s] for s in size)
    assert all(r.text == given[r.doc_id].text for r in steps[4].collect())


def test_packing(steps):
    assert Counter(r.doc_id for r in steps[5].where("start = 0").collect()) == Counter(r.doc_id for r in steps[4].collect())


def test_clashing_columns_and_nulls(spark, odd):
    """Columns that have the names of inner ones survive every filtering stage."""
    docs = odd
    for _, f in P.STAGES[:4]:
        docs = stored(f(spark, docs, SF), "odd")
        assert docs.columns == odd.columns
    assert P.STAGES[4][1](spark, docs, SF).count() > 0
    empty = odd.limit(0)
    for _, f in P.STAGES:
        assert f(spark, empty, SF).collect() == []


def test_a_run_leaves_only_its_result(spark):
    first = n_stored()
    out = P.run(spark, SF)
    assert n_stored() == first + 1 and out.count() > 0


def test_repeated_rows_stay_once(spark):
    rows = [(1, "a b c d e f", None)] * 50 + [(2, "other words here", "x"), (2, "other words here", "x"), (None, "no id", "y")]
    out = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, mark string"), SF)
    assert sorted((r.doc_id or 0, r.text, r.mark) for r in out.collect()) == [(0, "no id", "y"), (1, "a b c d e f", None), (2, "other words here", "x")]
