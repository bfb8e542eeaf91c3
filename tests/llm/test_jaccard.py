import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lorewright.llm.components import components
from lorewright.llm.jaccard import BANDS, band_of, block_keys, near_duplicates, sketch
from lorewright.llm.texts import shingle_sets


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    where = defaultdict(list)
    for d, x in sets.items():
        for g in x:
            where[g].append(d)
    common = defaultdict(int)
    for ids in where.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                common[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(x), find(d)) for d, x in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def test_against_brute_force(documents):
    assert got(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_chains_hubs_and_shared_passages(spark):
    """Near copies of which some only link to one another, not to the smallest id, and a passage in all."""
    r = random.Random(5)
    word = [f"w{i}" for i in range(5000)]
    passage = r.choices(word, k=40)
    rows, k = [], 0
    for _ in range(12):
        base = r.choices(word, k=r.choice([9, 14, 30, 60, 130, 300])) + passage
        for _ in range(r.choice([1, 4, 12])):
            text = list(base)
            for _ in range(r.randrange(0, 1 + len(text) // 25)):
                text[r.randrange(len(text))] = r.choice(word)
            rows.append((k, " ".join(text)))
            base = text if r.random() < 0.5 else base
            k += 1
    r.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_short_sets(spark):
    rows = [(i, " ".join("abcdefghijklmnop"[: 1 + i % 16])) for i in range(40)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert [by[k].n_shingles for k in (1, 2, 3, 4, 9, 10)] == [0, 0, 0, 1, 1, 1]
    assert by[5].component_id == 4 and by[7].component_id == 6 and by[None].component_id is None
    assert by[1].component_id == 1 and by[2].component_id == 2


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_bound_the_difference_and_blocks_meet():
    r = np.random.default_rng(1)
    for n in (4, 7, 20, 90, 400, 1500):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(20):
            keep = a[r.permutation(len(a))[: max(1, len(a) - len(a) // 10)]]
            b = np.sort(np.concatenate((keep, r.integers(0, 2**63, len(a) // 10).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            differ = len(a) + len(b) - 2 * both
            for band in {band_of(max(len(a), len(b)))}:
                if min(len(a), len(b)) < BANDS[0]:
                    continue
                x, y = (np.frombuffer(sketch(s, band), np.uint8) for s in (a, b))
                assert np.bitwise_count(x ^ y).sum() <= differ
                if both * 100 >= 80 * (len(a) + len(b) - both):
                    assert set(block_keys(a, band).tolist()) & set(block_keys(b, band).tolist())


def test_words_are_ascii_words():
    texts = ["A\x0bb c\u00a0d", "É é", "a  b\r\nc", "x" * 70]
    for t, s in zip(texts, shingle_sets(pa.array(texts)), strict=True):
        assert len(s) == len(shingles(t))
    a, b = shingle_sets(pa.array(["É", "é"]))
    assert a[0] != b[0]


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 5), (3, None)]])
def test_components(spark, edges):
    root = {}
    for a, b in edges:
        if a != b and b is not None:
            root.setdefault(a, a), root.setdefault(b, b)
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == root


def test_an_id_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = b + " more"
    rows = [(1, a), (2, a), (2, b), (3, near), (4, near), (5, "other words that stand alone here")]
    assert {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_a_template_family_that_does_not_link(spark):
    """2,000 documents of one bucket at a Jaccard index of about 0.78, and two that link across."""
    r = random.Random(3)
    common = [f"c{i}" for i in range(180)]
    rows = [(i, " ".join([*common, *(f"d{i}_{k}" for k in range(25))])) for i in range(2000)]
    rows += [(5000, rows[700][1] + " more"), (5001, rows[1300][1] + " and more words")]
    r.shuffle(rows)
    a, b = (shingles(t) for _, t in rows[:2])
    assert 0.74 < len(a & b) / len(a | b) < 0.8
    start = time.time()
    out = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert time.time() - start < 120
    assert out == {d: (len(shingles(t)), {5000: 700, 5001: 1300}.get(d, d)) for d, t in rows}


@pytest.mark.parametrize("small", [False, True])
def test_blocks_and_hot_keys(spark, monkeypatch, small):
    """Chains, hubs and families in tiny blocks and with hot keys, as in large ones."""
    from lorewright.llm import jaccard, skew

    if small:
        for name, n in (("BLOCK", 7), ("TEXT_BLOCK", 5), ("PARTNERS", 3)):
            monkeypatch.setattr(jaccard, name, n)
        monkeypatch.setattr(skew, "HOT_ROWS", 6)
    r = random.Random(9)
    word = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(6):
        base = r.choices(word, k=r.choice([30, 80, 200]))
        for k in range(45):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(text) // 40, len(text) // 20])):
                text[r.randrange(len(text))] = r.choice(word)
            rows.append((1000 * r.randrange(50) + 60 * f + k, " ".join(text)))
            base = text if r.random() < 0.2 else base
    rows = list(dict(rows).items())
    want = brute(rows)
    assert len({c for _, c in want.values()}) > 20
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_common_counts():
    from lorewright.llm.jaccard import _common

    r = np.random.default_rng(2)
    x, y = ([np.unique(r.integers(0, 3000, n).astype(np.uint64)) for n in r.integers(0, 900, 20)] for _ in range(2))
    assert _common(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
    own = _common(x, None)
    assert all(own[i, j] == len(np.intersect1d(x[i], x[j])) for i in range(20) for j in range(20) if i != j)
