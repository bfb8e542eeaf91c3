"""Language ID, line dedup, mixing and packing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorewright.llm import langid
from lorewright.llm.linededup import line_dedup, strip_runs
from lorewright.llm.queries import op9_line_dedup
from lorewright.llm.mixing import mix, targets
from lorewright.llm.packing import TIERS, Encoder, pack


def test_held_out_accuracy(documents):
    rows = langid.identify(documents, carry=("lang",)).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (langid.crc_fold(r.doc_id) == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_forward_sums_all_segmentations():
    v = langid.vocabulary()
    p = np.random.default_rng(0).random((len(v) + 1, 2))
    words = ["and", "über", "日本", "x" * 30, "straße"]
    out = langid.log_likelihoods(words, langid.Pieces(v), p)
    for i, w in enumerate(words):
        w = "^" + w
        for c in range(2):
            a = [1.0] + [0.0] * len(w)
            for e in range(1, len(w) + 1):
                for s in range(e):
                    if w[s:e] in v:
                        a[e] += a[s] * p[v[w[s:e]], c]
                    elif e - s == 1:
                        a[e] += a[s] * p[-1, c]
            assert out[i, c] == pytest.approx(np.log(a[-1]), abs=1e-9)


def cuts(word, v):
    """All ways to cut a word into pieces of the vocabulary or single characters."""
    if not word:
        return [[]]
    return [[word[:n], *rest] for n in range(1, len(word) + 1) if n == 1 or word[:n] in v for rest in cuts(word[n:], v)]


def test_learning_and_posteriors_against_all_segmentations(spark):
    """Probabilities after EM, and each text's language and posterior, by listing every segmentation."""
    v = langid.vocabulary()
    texts = {"en": ["the cat and the dog", "and then there"], "de": ["der hund und die", "über straße und"]}
    counts = [Counter(w for t in texts[l] for w in t.split()) for l in sorted(texts)]
    p = np.empty((len(v) + 1, 2))
    for c, count in enumerate(counts):
        now = np.full(len(v) + 1, 1 / (len(v) + 1))
        for _ in range(langid.ROUNDS):
            use = np.zeros(len(v) + 1)
            for w, n in count.items():
                ways = [[v.get(x, len(v)) for x in way] for way in cuts("^" + w, v)]
                odds = [np.prod(now[way]) for way in ways]
                for way, o in zip(ways, odds, strict=True):
                    np.add.at(use, way, n * o / sum(odds))
            now = (use + 0.01) / (use.sum() + 0.01 * len(use))
        now[-1] = 1e-7
        p[:, c] = now
    got = langid.learn(counts, langid.Pieces(v))
    assert got == pytest.approx(p)
    rows = [(i, t, l) for l in texts for i, t in enumerate(["the hund", "die und Cat", "über² the", "x", "ö1a"] + texts[l], 100 * (l == "de"))]
    fold = [r for r in rows if langid.crc_fold(r[0])]
    counts = [Counter(w for _, t, x in fold if x == l for w in langid.words_of(t)) for l in sorted(texts)]
    p = langid.learn(counts, langid.Pieces(v))
    for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), carry=("text",)).collect():
        total = [sum(np.log(sum(np.prod([p[v.get(x, len(v)), c] for x in way]) for way in cuts("^" + w, v))) for w in langid.words_of(r.text)) for c in range(2)]
        odds = np.exp(np.array(total) - max(total))
        assert r.score == pytest.approx(odds.max() / odds.sum()) and r.lang_pred == sorted(texts)[int(np.argmax(total))]


def test_letters(spark):
    assert langid.words_of("x²y ½ Ⅷ① naïve i\u0307stan 𝐀b2c_d " + "e" * 40) == ["x", "y", "naïve", "i\u0307stan", "𝐀b", "c", "d", "e" * 32, "e" * 8]
    rows = [(i, "the cat", "en") for i in range(8)] + [(9, "½ ² ①", "en"), (10, "Ⅷ 12 \u0301", "en"), (11, "𝐀", "en")]
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[9] == out[10] == ("und", 0.0) and out[11] == ("en", 1.0)


def test_repeated_rows_are_learned_once(spark, monkeypatch):
    """One row of which there are very many does not fill the sample, nor stand for its language."""
    taken = []
    monkeypatch.setattr(langid, "learn", lambda counts, pieces: taken.append(counts[0]) or np.ones((2, 1)))
    copies = [(1, "same text again and again " * 4, "en")] * 3000
    rows = [(i, f"word{chr(97 + i % 26)} " * 10 + chr(97 + i // 26 % 26) * 5, "en") for i in range(2, 400)]
    shape = "doc_id long, text string, lang string"
    for chars in (3000, 10**6):
        for some in (copies + rows, copies[:1] + rows):
            assert langid.train(spark.createDataFrame(some, shape), chars=chars)[0] == ["en"]
    # Drawn again as often as needed, the sample is the same: the smallest hashes up to its bound.
    assert taken[0] == taken[1] and taken[2] == taken[3]
    assert 3000 <= sum(n * (len(w) + 1) for w, n in taken[0].items()) < 3200 and taken[2]["again"] == 8


def test_language_odd_rows(odd, spark):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 8}
    none = langid.identify(spark.createDataFrame([(1, "ab cd", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def brute_lines(rows):
    """doc -> kept lines, by windows of 50 words from and to every line, compared as text."""
    seen, gone, lines = {}, defaultdict(set), {}
    for k, t in sorted(rows):
        ls = [y.strip() for y in t.split("\n") if y.split()]
        n, spans = [len(y.split()) for y in ls], set()
        lines[k] = ls
        for i in range(len(ls)):
            for way in (1, -1):
                c, j = 0, i
                while 0 <= j < len(ls):
                    c += n[j]
                    if c >= 50:
                        spans.add((min(i, j), max(i, j)))
                        break
                    j += way
        for a, b in sorted(spans):
            key = tuple(ls[a : b + 1])
            if key in seen:
                d, first = seen[key]
                gone[k] |= set(range(max(a, first + b + 1 - a) if d == k else a, b + 1))
            seen.setdefault(key, (k, a))
    return {k: [y for i, y in enumerate(ls) if i not in gone[k]] for k, ls in lines.items()}


def test_lines_against_brute_force(documents):
    want = brute_lines([(r.doc_id, r.text) for r in documents.collect()])
    for r in line_dedup(documents).collect():
        assert [y.strip() for y in r.text.split("\n") if y.split()] == want[r.doc_id]
        assert bool(r.n_removed) == bool(r.kept_in)


def test_passages_go_and_short_runs_stay(spark):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(20)) for i in range(3))
    short = "All rights reserved."
    rows = [(1, f"own start one\n{passage}\n{short}"), (2, f"{short}\nother text\n\n{passage}\nthe end"), (3, f"{passage}"), (4, short)]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == rows[0][1] and out[4].text == short
    assert out[2].text.split() == f"{short} other text the end".split() and out[2].kept_in == [1]
    assert out[3].text == "" and out[3].n_removed == 3


def test_lines_odd_rows(odd, spark):
    rows = line_dedup(odd, carry=("key", "c1")).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[2].text == "" and by[None].text.startswith("text without")
    assert by[6].n_removed == 0 and by[7].n_removed == 0
    assert by[1].key == "x" and by[1].c1 == "q"
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_strip_runs():
    assert strip_runs("a\nb\n\nc\nd", [(1, 2)]) == ("a\nd", 5, 2)
    assert strip_runs("a\n\nb", [(0, 1)])[0] == ""


def check_mix(rows):
    taken, goal = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    for s, t in goal.items():
        assert abs(taken[s] - t) <= 2, (s, taken[s], t)


def test_mix_meets_targets(documents):
    rows = mix(documents, carry=("source",)).collect()
    check_mix(rows)
    assert len(rows) == documents.count()
    again = mix(documents.repartition(5), carry=("source",)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_targets_share_out_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 5, "e": 700, None: 50}
    out = {r.source: r for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [3, 1, 2, 3, 1, 2], strict=True))
    want, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        want = {s: 2 * sizes[s] if s in full else left * weights[s] / sum(weights[f] for f in free) for s in sizes}
        over = {s for s in free if want[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    assert {s: r.target for s, r in out.items()} == pytest.approx(want)


def test_better_documents_come_first(spark):
    rows = [(i, "w " * 10, "b" if i < 4000 else "a") for i in range(4300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(df, quality=F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5), share=0.5).collect()
    even = sum(r.taken for r in out if r.doc_id < 4000 and r.doc_id % 2 == 0)
    odd_ = sum(r.taken for r in out if r.doc_id < 4000 and r.doc_id % 2)
    assert even > 2 * odd_ > 0


def test_mix_odd_rows(odd, spark):
    rows = mix(odd, carry=("source", "key")).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].size == 0 and by[1].taken == 0 and by[3].size == 0 and by[5].size == 3
    check_mix(rows)
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    none = mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken, r.target) for r in none] == [(0, 0, 0.0)]


def round_trip(df):
    rows = pack(df).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.doc_id].append(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
    of, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        whole = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        of[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for k, v in ids.items():
        cover = Counter(i for r in of[k] for i in range(r.start, r.start + r.length))
        want = Counter(i for x in v for i in range(len(x)))
        assert cover == want
    for v in seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == v[0].tier and at & (at - 1) == 0 and at <= TIERS[0]
    return rows


def test_packing_round_trip(documents):
    rows = round_trip(documents)
    groups, mixed = Counter(), defaultdict(Counter)
    for r in rows:
        groups[r.step_group] += r.length
        mixed[r.step_group][r.tier] += r.offset == 0
    full = [g for g, n in groups.items() if n == 16 * 2048]
    # Dealt together, the groups hold as many of the longest windows, but for one, and windows of every tier.
    assert len(full) == 5 and documents.rdd.getNumPartitions() == 1
    assert max(mixed[g][2048] for g in full) <= min(mixed[g][2048] for g in full) + 1
    assert all(sum(n for t, n in mixed[g].items() if t < 2048) >= 2 for g in full)
    assert sum(n != 16 * 2048 for n in groups.values()) <= documents.rdd.getNumPartitions()


def test_packing_odd_rows(odd, spark):
    round_trip(odd.where("doc_id <> 4"))
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [(r.length, r.doc_tokens) for r in pack(odd.where("doc_id = 1")).collect()] == [(1, 1)]


def test_encoder_equals_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = Encoder()
    for x in ("", " ", "Hello  world\n\n\tx", "naïve café — 123,456 ½ 😀👍🏽", "it's they'LL I'd", "\u3000全角\u00a0x\u200b", "a\r\nb\x00c", "<|endoftext|>", "ǅ ß Ⅻ ²"):
        assert e.encode(x, added=True).tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing_gives_added_tokens_their_ids(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  \n<|endoftext|><|endoftext|>  y's", "<|endoftext|", "no <|ENDOFTEXT|>", "é\u3000<|endoftext|>\u0301 12 ", "<|endof<|endoftext|>text|>"]
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 1]
    e = Encoder()
    assert {i: [*e.encode(x, added=True).tolist(), 1] for i, x in enumerate(texts)} == want
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(x) for i, x in want.items()}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def brute_passages(rows):
    """doc -> words left: a word goes if 50 words around it stand earlier, outside of which place it is."""
    seen, left = {}, {}
    for k, t in sorted(rows):
        w = t.encode().split()
        gone = set()
        for i in range(len(w) - 49):
            d, first = seen.setdefault(tuple(w[i : i + 50]), (k, i))
            if (d, first) != (k, i):
                gone.update(range(i if d != k else max(i, first + 50), i + 50))
        left[k] = [x for i, x in enumerate(w) if i not in gone]
    return left


def matched_words(rows):
    """doc -> words left, by extending matches of single words both ways, pair by pair of places, without windows or hashes."""
    docs = [(k, t.encode().split()) for k, t in sorted(rows)]
    left = {}
    for n, (k, w) in enumerate(docs):
        gone = set()
        for m, (_, v) in enumerate(docs[: n + 1]):
            for shift in range(-len(v) + 1, len(w)):
                # Places i of w and i - shift of v; within one document only earlier places.
                if m == n and shift <= 0:
                    continue
                i = max(0, shift)
                while i < len(w) and i - shift < len(v):
                    j = i
                    while j < len(w) and j - shift < len(v) and w[j] == v[j - shift]:
                        j += 1
                    if j - i >= 50:
                        gone.update(range(i if m < n else max(i, i - shift + 50), j))
                    i = j + 1
        left[k] = [x for i, x in enumerate(w) if i not in gone]
    return left


@pytest.mark.parametrize("hot", [1000, 5])
def test_passages_against_extended_matches(spark, monkeypatch, hot):
    from lorewright.llm import skew

    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    r = np.random.default_rng(11)
    word = [f"w{i}" for i in range(300)]
    runs = [[word[i] for i in r.integers(0, 300, n)] for n in (50, 51, 64, 75, 120)]
    rows = []
    for k in range(40):
        w = [word[i] for i in r.integers(0, 300, r.integers(0, 60))]
        for _ in range(r.integers(0, 4)):
            run = runs[r.integers(len(runs))]
            a = int(r.integers(0, 20)) if r.random() < 0.5 else 0
            w += run[a:] + [word[i] for i in r.integers(0, 300, r.integers(0, 30))]
        seps = np.array([" ", "\n", "  \n"])[r.integers(0, 3, len(w))]
        rows.append((k, "".join(a + b for a, b in zip(w, seps, strict=True))))
    rows += [(50, "a b c d e f g h i j\n" * 20), (51, " ".join("xyz"[i % 3] for i in range(170))), (52, rows[3][1])]
    out = {x.doc_id: x.text.encode().split() for x in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), passages=True).collect()}
    assert out == matched_words(rows) == brute_passages(rows)
    assert b"".join(out[50]) == b"abcdefghij" * 5 and len(out[51]) == 50


def test_a_line_that_repeats_keeps_its_first_window(spark):
    rows = [(1, "a b c d e f g h i j\n" * 20)]
    (r,) = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert r.text.split() == [*"abcdefghij"] * 5 and r.n_removed == 15 and r.kept_in == [1]


def test_passages_against_brute_force(documents):
    want = brute_passages([(r.doc_id, r.text) for r in documents.collect()])
    for r in line_dedup(documents, passages=True).collect():
        assert r.text.encode().split() == want[r.doc_id], r.doc_id
        assert bool(r.n_removed) == bool(r.kept_in)


def test_passages_inside_lines(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"own start {passage} own end\nlast"), (2, f"other  text {passage} and more\n\nlast"), (3, f" {passage[:-1]} x"), (4, f"A {passage.replace(' p20 ', chr(10) + 'p20 ')}\nz"), (5, passage.upper()), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert [out[k].text for k in (1, 3, 5, 6)] == [rows[k - 1][1] for k in (1, 3, 5, 6)]
    assert (out[2].text, out[2].n_removed, out[2].kept_in) == ("other  text and more\n\nlast", 1, [1])
    assert (out[4].text, out[4].n_removed, out[4].kept_in) == ("A\nz", 2, [1])


def test_passages_odd_rows(odd, spark):
    rows = line_dedup(odd, carry=("key", "c1"), passages=True).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and by[1].text is None and by[2].text == "" and by[None].text.startswith("text without")
    want = brute_passages([(r.doc_id, r.text) for r in odd.where("doc_id in (6, 7)").collect()])
    assert {k: by[k].text.encode().split() for k in (6, 7)} == want
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string"), passages=True).collect() == []


def test_language_of_long_documents_only(spark):
    a, b = "the cat and the dog ", "der hund und die katze "
    rows = [(i, a * 3, "en") for i in range(40)] + [(i, b * 2000, "de") for i in range(100, 110)] + [(i, b * 3, None) for i in range(200, 205)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in out if r.doc_id < 100} == {"en"} and {r.lang_pred for r in out if r.doc_id >= 100} == {"de"}
