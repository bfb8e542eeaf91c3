"""Operator 10: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a
word is the sum, over all ways to cut it into pieces, of the product of their probabilities; a
forward pass over its characters gives that sum. A text's score is the sum over its words' log
likelihoods, per language.

The probabilities are learned by expectation-maximisation (forward-backward over the same
lattice) from a sample of labelled documents that is bounded by ``TRAIN_CHARS`` per language. Every
text is scored whole; a table of words already seen only saves time and is emptied when full.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.store import small_batches

VOCABULARY = "piece_bpe_32k.model"
#: Bound of the training sample: characters of text per language; longer documents are not sampled.
TRAIN_CHARS, TRAIN_DOC_CHARS = 400_000, 40_000
#: A sample is drawn to hold so many times TRAIN_CHARS, and so many times more if it falls short.
DRAWN, AGAIN = 4, 16
ROUNDS = 2
#: Words longer than this are scored in segments of this length.
SEGMENT = 32
PIECE = 12
KNOWN_WORDS = 150_000
FOLDS = 5
_UNKNOWN = 1e-7


def _letters(last: int) -> re.Pattern:
    """Segments of words up to code point *last*: letters (Unicode L) and the marks (M) that follow them."""

    def ranges(which: str) -> str:
        out, at = [], None
        for c in range(last + 2):
            if c <= last and unicodedata.category(chr(c))[0] in which:
                at = c if at is None else at
            elif at is not None:
                out.append(f"\\U{at:08x}-\\U{c - 1:08x}")
                at = None
        return "".join(out)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]{{0,{SEGMENT - 1}}}")


#: By whether a text has code points beyond 16 bits: the shorter list is faster.
_LETTERS = {last > 0xFFFF: _letters(last) for last in (0xFFFF, 0x3FFFF)}


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Piece to row: the lower-cased pieces of letters of a public sentencepiece vocabulary.

    *path* defaults to ``public_tokenizers.path(VOCABULARY)``. ``^`` marks the start of a word.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i).replace("▁", "^").lower()
        if p.strip("^").isalpha() and "^" not in p[1:] and len(p) <= PIECE:
            out.setdefault(p, len(out))
    return out


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters with their marks, each in segments of at most SEGMENT characters."""
    text = text.lower()
    return _LETTERS[len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)].findall(text)


class Pieces:
    """A vocabulary as an automaton that finds every piece in many words at once."""

    def __init__(self, rows: dict[str, int]):
        import ahocorasick

        self.n = len(rows)
        self.length = np.array([len(p) for p in rows], np.int64)
        self.machine = ahocorasick.Automaton()
        for p, r in rows.items():
            self.machine.add_word(p, r)
        self.machine.make_automaton()


def lattice(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arcs' word, start, end and piece, ordered by end; and each word's length with its mark.

    Every single character has an arc; one outside the vocabulary has the row after the last.
    """
    length = np.array([len(w) + 1 for w in words], np.int64)
    begin = np.cumsum(length + 1) - length - 1
    text = "^" + "\n^".join(words)
    found = list(pieces.machine.iter(text))
    last = np.fromiter((e for e, _ in found), np.int64, len(found))
    piece = np.fromiter((r for _, r in found), np.int64, len(found))
    first = last - pieces.length[piece] + 1
    lone = np.ones(len(text), dtype=bool)
    lone[first[first == last]] = False
    lone[begin[1:] - 1] = False
    more = np.flatnonzero(lone)
    first, last = np.concatenate((first, more)), np.concatenate((last, more))
    piece = np.concatenate((piece, np.full(len(more), pieces.n)))
    word = np.searchsorted(begin, first, "right") - 1
    start, end = first - begin[word], last - begin[word] + 1
    order = np.argsort(end, kind="stable")
    return word[order], start[order], end[order], piece[order], length


def _forward(arcs: tuple, p: np.ndarray, n: int, width: int) -> np.ndarray:
    """Sums over all segmentations of each prefix: [width + 1, n, languages]."""
    word, start, end, piece, _ = arcs
    alpha = np.zeros((width + 1, n, p.shape[1]))
    alpha[0] = 1
    at = np.searchsorted(end, np.arange(1, width + 2))
    for e in range(1, width + 1):
        lo, hi = at[e - 1], at[e]
        if lo < hi:
            v = alpha[start[lo:hi], word[lo:hi]] * p[piece[lo:hi]]
            for c in range(p.shape[1]):
                alpha[e, :, c] = np.bincount(word[lo:hi], v[:, c], n)
    return alpha


def log_likelihoods(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """[words, languages]: the log of the sum over all segmentations."""
    out = np.empty((len(words), p.shape[1]))
    for lo in range(0, len(words), 4096):
        some = words[lo : lo + 4096]
        arcs = lattice(some, pieces)
        alpha = _forward(arcs, p, len(some), int(arcs[4].max()))
        out[lo : lo + 4096] = np.log(alpha[arcs[4], np.arange(len(some))])
    return out


def learn(counts: list[Counter], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """[pieces + 1, languages]: probabilities from each language's word counts by EM.

    The last row stands for a character outside the vocabulary. A piece never used keeps a floor.
    """
    rows = pieces.n + 1
    out = np.empty((rows, len(counts)))
    for c, count in enumerate(counts):
        words = sorted(count)
        weight = np.array([count[w] for w in words], dtype=float)
        p = np.full((rows, 1), 1.0 / rows)
        for _ in range(rounds if words else 0):
            expected = np.zeros(rows)
            for lo in range(0, len(words), 8192):
                some = words[lo : lo + 8192]
                arcs = lattice(some, pieces)
                word, start, end, piece, length = arcs
                n, width = len(some), int(length.max())
                alpha = _forward(arcs, p, n, width)[:, :, 0]
                beta = np.zeros((width + 1, n))
                beta[length, np.arange(n)] = 1
                order = np.argsort(-start, kind="stable")
                ws, ss, es, ps = word[order], start[order], end[order], piece[order]
                at = np.searchsorted(-ss, np.arange(-width, 1))
                for k in range(width):
                    a, b = at[k], at[k + 1] if k + 1 < len(at) else len(ss)
                    if a < b:
                        beta[ss[a]] += np.bincount(ws[a:b], beta[es[a:b], ws[a:b]] * p[ps[a:b], 0], n)
                a, b = at[width], len(ss)
                if a < b:
                    beta[0] += np.bincount(ws[a:b], beta[es[a:b], ws[a:b]] * p[ps[a:b], 0], n)
                total = alpha[length, np.arange(n)]
                use = alpha[start, word] * p[piece, 0] * beta[end, word] / total[word] * weight[lo : lo + 8192][word]
                expected += np.bincount(piece, use, rows)
            p = ((expected + 0.01) / (expected.sum() + 0.01 * rows))[:, None]
        p[-1] = _UNKNOWN
        out[:, c] = p[:, 0]
    return out


def held_out(doc_id: F.Column | str) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by FOLDS."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % FOLDS == 0


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", chars: int = TRAIN_CHARS) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their piece probabilities, from rows outside the held-out fold.

    The sample is bounded: of each language, whole documents of at most TRAIN_DOC_CHARS characters,
    smallest first by a hash of id and text, until they have *chars* characters; repeated rows count
    once. A language that has only longer documents is learned from their first TRAIN_DOC_CHARS
    characters. No labelled rows: no languages.

    What is ordered is bounded too: a share of the hashes that holds DRAWN times *chars* by the
    language's size. Should copies make it fall short, a larger share is drawn. The driver holds one
    row per language; the model has a column for each anyway.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.shiftrightunsigned(F.xxhash64(F.col(id), F.col(text)), 1).alias("h"), held_out(id).alias("out"))
    longer = F.length("t") > TRAIN_DOC_CHARS
    rows = rows.where("t is not null and l is not null and not coalesce(out, false)").withColumn("longer", longer)
    least = F.least(F.length("t"), F.lit(TRAIN_DOC_CHARS))
    sizes = rows.groupBy("l").agg(F.sum(F.when(~longer, least)).alias("short"), F.sum(least).alias("every")).collect()
    if not sizes:
        return [], np.zeros((0, 0))
    most = {r.l: r.every if r.short is None else r.short for r in sizes}
    only = {r.l: r.short is None for r in sizes}
    share = {l: min(1.0, DRAWN * chars / max(n, 1)) for l, n in most.items()}
    got: dict[str, list[str]] = {}
    while open_ := [l for l in most if l not in got]:
        limit = [(l, min((1 << 63) - 1, int(share[l] * (1 << 53)) << 10), only[l]) for l in open_]
        limits = F.broadcast(docs.sparkSession.createDataFrame(limit, "l string, most long, longer boolean"))
        drawn = rows.join(limits, ["l", "longer"]).where("h <= most").groupBy("l", "h").agg(F.min(F.substring("t", 1, TRAIN_DOC_CHARS)).alias("t"))
        before = F.sum(F.length("t")).over(Window.partitionBy("l").orderBy("h")) - F.length("t")
        found: dict[str, list[str]] = {l: [] for l in open_}
        for r in drawn.withColumn("before", before).where(F.col("before") < chars).orderBy("l", "h").select("l", "t").collect():
            found[r.l].append(r.t)
        for l, texts in found.items():
            if share[l] >= 1 or sum(map(len, texts)) >= chars:
                got[l] = texts
            share[l] = min(1.0, share[l] * AGAIN)
    langs = sorted(most)
    counts = [Counter() for _ in langs]
    for c, l in enumerate(langs):
        for t in got[l]:
            counts[c].update(words_of(t))
    return langs, learn(counts, Pieces(vocabulary()))


class Scorer:
    """Predictions for batches of texts; keeps the likelihoods of words it has seen."""

    def __init__(self, langs: list[str], p: np.ndarray):
        self.langs, self.p, self.pieces = langs, p, Pieces(vocabulary())
        self.rows: dict[str, int] = {}
        self.values = np.zeros((0, len(langs)))
        self.used = 0

    def _look_up(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > KNOWN_WORDS:
            self.rows, self.used = {}, 0
        rows = self.rows
        new = list({w for w in words if w not in rows})
        if new:
            v = log_likelihoods(new, self.pieces, self.p)
            need = self.used + len(new)
            if need > len(self.values):
                grown = np.empty((need * 2, len(self.langs)))
                grown[: self.used] = self.values[: self.used]
                self.values = grown
            self.values[self.used : need] = v
            rows.update(zip(new, range(self.used, need), strict=True))
            self.used = need
        return self.values[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        at = 0
        while at < len(texts) and self.langs:
            words: list[str] = []
            begin, which = [], []
            while at < len(texts) and len(words) < 100_000:
                w = words_of(texts[at] or "")
                if w:
                    which.append(at)
                    begin.append(len(words))
                    words += w
                at += 1
            if not which:
                continue
            total = np.add.reduceat(self._look_up(words), begin, axis=0)
            total -= total.max(axis=1, keepdims=True)
            odds = np.exp(total)
            odds /= odds.sum(axis=1, keepdims=True)
            for i, k, s in zip(which, odds.argmax(axis=1).tolist(), odds.max(axis=1).tolist(), strict=True):
                lang[i], score[i] = self.langs[k], s
        return lang, score


_scorers: dict[bytes, Scorer] = {}


def scorer_of(langs: list[str], p: np.ndarray) -> Scorer:
    """The scorer that this worker process has for a model; only the last model's is kept."""
    key = "\0".join(langs).encode() + p.tobytes()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(langs, p)
    return _scorers[key]


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, held_out boolean, lang_pred string, score double (the posterior, 0 to 1).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if no
    labelled row can be learned from. Ties go to the first language by code point. Repeated rows
    stay; a null id is not held out (held_out false) and counts for training. An empty table gives
    an empty result. *carry* names further columns to keep.
    """
    langs, p = train(docs, text, lang, id)

    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(langs, p)
        for b in batches:
            got, odds = scorer.predict(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.string()), pa.array(odds, pa.float64())], names=[f"c{i}" for i in range(b.num_columns + 1)])

    kept = [F.col(id).alias("doc_id"), F.coalesce(held_out(id), F.lit(False)).alias("held_out"), *(F.col(c) for c in carry)]
    rows = docs.select(*(c.alias(f"i{i}") for i, c in enumerate([F.col(text), *kept])))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[1:]] + ["string", "double"]
    out = rows.mapInArrow(score, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return out.toDF("doc_id", "held_out", *carry, "lang_pred", "score")


def crc_fold(doc_id: int) -> int:
    """The fold of an id, as the driver of a brute-force test computes it."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
