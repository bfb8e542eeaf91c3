"""Operator 9: line dedup by winnowing over line hashes.

A document is its lines; blank lines are not counted. For every line, the shortest window of lines
that begins there with at least MIN_WORDS words, and the shortest that ends there, is taken. The
smallest line hash in a window is its fingerprint (winnowing): any run of lines with MIN_WORDS
words that stands in two places holds the same windows in both, so it has a common fingerprint.

Positions are joined by fingerprint; those found once go. What remains is extended both ways: the
windows that reach from a fingerprint forwards and backwards are held against each other by a hash
of all their lines, so a match grows, window by window, to the whole repeated run. The first place
of a window, by (doc_id, line), keeps its lines; in every later place they are deleted, but for
lines that belong to the first place too, where a run repeats within itself. Work is linear in the
number of places: a passage in thousands of documents needs no pairs, and fingerprints and windows
that very many rows share are aggregated before they are dealt.

With *passages* the units are words instead of lines, so runs that begin or end inside a line are
found too. Hashes of GRAM words are winnowed so that any MIN_WORDS words hold a chosen one; where a
chosen one stands twice, every window of MIN_WORDS words around it is held against the others. To
keep that small, a match is first extended from each chosen one over the next: what stands in such a
span that stood earlier goes at once, and only windows that reach out of such spans, to either side,
are left to compare. The first place of a window never lies in a span that stood earlier, so it is among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.skew import several_places
from lorewright.store import small_batches, stored
from lorewright.llm.texts import _P, _PINV, _SPACE, _power, U, buffers, constants, mix, slices, word_hashes

#: A run of lines repeats if it has at least this many words.
MIN_WORDS = 50
#: Words of a fingerprint of passages.
GRAM = 20
#: At most so many runs, or keys of documents (16 bytes each), are broadcast.
BROADCAST_ROWS = 1_000_000


def _lines(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line numbers, hashes and word counts of the lines that aren't blank."""
    at, hashes, words = [], [], []
    for k, line in enumerate(text.split(b"\n")):
        n = len(line.split())
        if n:
            at.append(k)
            hashes.append(xxhash.xxh3_64_intdigest(line.strip()))
            words.append(n)
    return np.array(at, np.int64), np.array(hashes, U), np.array(words, np.int64)


def windows(hashes: np.ndarray, words: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line, fingerprint and content hash of every window, each window once.

    The content hash sums each line's hash times a constant of its place in the window.
    """
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(total, total[:-1] + least) - 1
    begins = np.searchsorted(total, total[1:] - least, "right") - 1
    every = np.arange(n)
    ok, back = ends < n, begins >= 0
    span = np.unique(np.concatenate((every[ok] * (n + 1) + ends[ok], begins[back] * (n + 1) + every[back])))
    first, last = span // (n + 1), span % (n + 1)
    if not len(first):
        return first, last, np.zeros(0, U), np.zeros(0, U)
    width = int((last - first).max()) + 1
    place = constants(width, 53)
    low, content = hashes[first].copy(), np.zeros(len(first), U)
    for j in range(width):
        use = first + j <= last
        h = hashes[first[use] + j]
        low[use] = np.minimum(low[use], h)
        content[use] += h * place[j]
    return first, last, low, mix(content + (last - first).astype(U))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "body", "first", "last", "print", "content"]
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for d, body, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            _, h, w = _lines(t.as_py().encode())
            first, last, low, content = windows(h, w)
            n = len(first)
            if n:
                for k, v in enumerate((np.full(n, d, np.int64), np.full(n, body, np.int64), first.astype(np.int32), last.astype(np.int32), low.view(np.int64), content.view(np.int64))):
                    out[k].append(v)
        if out[0]:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=names)


def strip_runs(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the lines of *runs* (among its lines that aren't blank), its lines before, and those deleted.

    A blank line goes if the lines around it go.
    """
    lines = text.split("\n")
    solid = [k for k, x in enumerate(lines) if x.encode().split()]
    gone = np.zeros(len(solid) + 1, np.int64)
    for a, z in runs:
        gone[a] += 1
        gone[z + 1] -= 1
    out = np.cumsum(gone[:-1]) > 0 if solid else np.zeros(0, bool)
    drop = {k for k, x in zip(solid, out.tolist(), strict=True) if x}
    n = len(drop)
    bounds = [-1, *solid, len(lines)]
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        if (a in drop or a == -1) and (z in drop or z == len(lines)) and (a in drop or z in drop):
            drop.update(range(a + 1, z))
    return "\n".join(x for k, x in enumerate(lines) if k not in drop), len(lines), n


def _rewrite(strip: Callable[[str, list[tuple[int, int]]], tuple[str, int, int]]):
    """(text, runs, id, kept_in, ...): id, text rewritten by *strip*, two counts, kept_in and what follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, before, gone = [], [], []
            at = b.column(1).offsets.to_numpy().tolist()
            first, last = (b.column(1).values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for t, i, j in zip(b.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                if i < j:
                    t, n, k = strip(t, list(zip(first[i:j].tolist(), last[i:j].tolist(), strict=True)))
                else:
                    n, k = (0 if t is None else t.count("\n") + 1), 0
                text.append(t)
                before.append(n)
                gone.append(k)
            arrays = [b.column(2), pa.array(text, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64()), *b.columns[3:]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"o{i}" for i in range(len(arrays))])

    return run


def _slid(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """*f* (minimum or maximum) over every *width* successive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def _sums(words: np.ndarray) -> np.ndarray:
    """Sums of the words' hashes, each times a power by its place, before every place and at the end."""
    return np.concatenate((np.zeros(1, U), np.cumsum(words * _power(_P, len(words))[: len(words)], dtype=U)))


def grams(words: np.ndarray, width: int, sums: np.ndarray | None = None) -> np.ndarray:
    """A hash of every *width* successive words, from differences of sums, whatever the width."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = _sums(words) if sums is None else sums
    return mix((sums[width:] - sums[:-width]) * _power(_PINV, n)[:n])


def chosen(words: np.ndarray, at: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some MIN_WORDS words of one row; rows begin at *at*."""
    g, span = grams(words, GRAM, sums), MIN_WORDS - GRAM + 1
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.int64), g[:0]
    low = _slid(g, span, np.minimum)
    end = np.repeat(at[1:], np.diff(at))
    low[np.arange(len(low)) + MIN_WORDS > end[: len(low)]] = 0
    edge = np.zeros(span - 1, U)
    use = np.flatnonzero(_slid(np.concatenate((edge, low, edge)), span, np.maximum) == g)
    return use, g[use]


def _spans(sums: np.ndarray, at: np.ndarray, use: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and content hash of the span of every chosen place.

    Windows that begin before the next chosen place lie in the span; a row's first span begins with
    the row, and the last ones end with it.
    """
    first = np.ones(len(use), bool)
    first[1:] = row[1:] != row[:-1]
    end = at[row + 1]
    after = end.copy()
    after[:-1] = np.where(first[1:], end[:-1], use[1:])
    k = np.searchsorted(use, after + MIN_WORDS - 1 - GRAM)
    inside = (k < len(use)) & (row[np.minimum(k, len(use) - 1)] == row)
    z = np.where(inside, use[np.minimum(k, len(use) - 1)] + GRAM, end)
    a = np.where(first, at[row], use)
    return a, z, mix((sums[z] - sums[a]) * _power(_PINV, len(sums))[a] + (z - a).astype(U))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "body", "spot", "print", "words", "first", "last", "content"]
    for b in batches:
        offsets, raw = buffers(b.column(2))
        docs, bodies = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        for first, last in slices(offsets):
            words, at = word_hashes(offsets[first : last + 1], raw, exact=True)
            sums = _sums(words)
            use, g = chosen(words, at, sums)
            if len(use):
                row = np.searchsorted(at, use, "right") - 1
                a, z, content = _spans(sums, at, use, row)
                places = [pa.array((x - at[row]).astype(np.int32)) for x in (use, at[row + 1], a, z)]
                span = pa.array(content.view(np.int64), mask=z - a < MIN_WORDS)
                yield pa.record_batch([pa.array(docs[first + row]), pa.array(bodies[first + row]), places[0], _signed(g), *places[1:], span], names=names)


#: How many windows of MIN_WORDS words hold a gram; the first begins so many words less one before it.
HOLD = MIN_WORDS - GRAM + 1


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, body, spots, spans): the spots in a window of MIN_WORDS words that lies in none of the spans.

    Bit k of windows stands for the k-th of the HOLD windows that hold the spot's gram: whether it is in the row and in no span.
    """
    for b in batches:
        spots, spans = b.column(2), b.column(3)
        s, z = np.diff(spots.offsets.to_numpy()), np.diff(spans.offsets.to_numpy())
        spot, print_, words = (spots.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        first, last = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
        row = np.repeat(np.arange(b.num_rows), s)
        n = np.zeros(b.num_rows, np.int64)
        n[row] = words - MIN_WORDS + 1
        at = np.concatenate(([0], np.cumsum(n)))
        of = np.repeat(np.arange(b.num_rows), z)
        use = n[of] > 0
        inside = np.zeros(at[-1] + 1, np.int32)
        np.add.at(inside, (at[of] + first)[use], 1)
        np.add.at(inside, (at[of] + last)[use] - MIN_WORDS + 1, -1)
        free = np.cumsum(inside) == 0
        bits = np.zeros(len(spot), np.int64)
        for k in range(HOLD):
            begin = spot.astype(np.int64) - HOLD + 1 + k
            ok = (begin >= 0) & (begin < n[row])
            bits |= (ok & free[np.where(ok, at[row] + begin, 0)]).astype(np.int64) << k
        keep = bits > 0
        doc, body = (b.column(i).to_numpy(zero_copy_only=False)[row[keep]] for i in (0, 1))
        yield pa.record_batch([pa.array(doc), pa.array(body), pa.array(spot[keep]), pa.array(print_[keep]), pa.array(bits[keep])], names=["doc", "body", "spot", "print", "windows"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, doc, body, spots): the windows of MIN_WORDS words that the spots' bits stand for, each once."""
    for b in batches:
        offsets, raw = buffers(b.column(0))
        docs, bodies = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        of = np.concatenate(([0], np.cumsum(np.diff(b.column(3).offsets.to_numpy()))))
        spot, bits = (b.column(3).flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
        for first, last in slices(offsets):
            words, at = word_hashes(offsets[first : last + 1], raw, exact=True)
            content = grams(words, MIN_WORDS)
            some = slice(of[first], of[last])
            begin = spot[some] - HOLD + 1 + np.repeat(at[:-1], np.diff(of[first : last + 1]))
            use = np.zeros(len(content), bool)
            for k in range(HOLD):
                use[begin[(bits[some] >> k) & 1 > 0] + k] = True
            use = np.flatnonzero(use)
            row = np.searchsorted(at, use, "right") - 1
            yield pa.record_batch([pa.array(docs[first + row]), pa.array(bodies[first + row]), pa.array((use - at[row]).astype(np.int32)), _signed(content[use])], names=["doc", "body", "first", "content"])


def strip_passages(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the words of *runs* (first word, word after the last), its lines before, and those that lost words."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    step = np.diff(solid)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    gone = np.zeros(len(starts) + 1, np.int64)
    spans = np.array(runs, np.int64).reshape(-1, 2)
    np.add.at(gone, spans[:, 0], 1)
    np.add.at(gone, spans[:, 1], -1)
    out = np.cumsum(gone)[:-1] > 0
    before = np.concatenate(([0], np.cumsum(out)))
    edges = np.concatenate(([0], np.flatnonzero(data == 10) + 1, [len(data) + 1]))
    at = np.searchsorted(starts, edges)
    lost, words = before[at[1:]] - before[at[:-1]], np.diff(at)
    whole = (np.cumsum(words > 0) - 1)[(lost > 0) & (lost == words)].tolist()
    part = np.flatnonzero((lost > 0) & (lost < words)).tolist()
    if part:
        lines = raw.split(b"\n")
        for k in part:
            a, z, begin = at[k], at[k + 1], edges[k]
            turn = np.flatnonzero(np.diff(np.concatenate(([True], out[a:z], [True])).astype(np.int8)))
            kept = [[starts[a + i] - begin, ends[a + j - 1] - begin] for i, j in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
            if not out[a]:
                kept[0][0] = 0
            if not out[z - 1]:
                kept[-1][1] = len(lines[k])
            lines[k] = b" ".join(lines[k][i:j] for i, j in kept)
        text = b"\n".join(lines).decode()
    return strip_runs(text, [(k, k) for k in whole])[0] if whole else text, len(words), int((lost > 0).sum())


def line_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", carry: tuple[str, ...] = (), passages: bool = False) -> DataFrame:
    """Per row: doc_id, text (without repeated runs), n_lines long, n_removed long, kept_in array<bigint>.

    kept_in lists the documents that hold the first place of what was deleted; of a run that is found
    as a whole, the first place of the whole run, parts of which may stand still earlier. A run that repeats
    within itself keeps its first window. Null text stays null with 0 lines; empty text has one empty line. Runs of fewer than MIN_WORDS words stay.
    Repeated rows (same id and text) are one document and are rewritten alike. Rows with a null id
    stay as they are. Lines are compared without the white space at their ends. *carry* names
    further columns to keep; an empty table gives an empty result. With *passages*, runs of words
    go wherever they begin and end, whatever the white space between words, and n_removed counts
    the lines that lost words.
    """
    small_batches(docs.sparkSession)
    # A document is an id with a text; the text is known by its hash.
    body = F.xxhash64(text)
    base = docs.select(F.col(id).cast("long").alias("doc"), body.alias("body"), F.col(text).alias("text"))
    base = base.where("doc is not null and text is not null")
    if passages:
        later = _later_passages(base)
    else:
        rows = base.mapInArrow(_windows, "doc long, body long, first int, last int, print long, content long")
        rows = stored(rows, "windows")
        found = several_places(rows, "print", ["doc", "body", "first"]).select("doc", "body", "first", "last", "content").distinct()
        later = _later(stored(found.withColumn("last", F.col("last") + 1), "found"))
        later = later.withColumn("last", F.col("last") - 1)
    runs = later.groupBy("doc", "body").agg(F.collect_set(F.struct("first", "last")).alias("runs"), F.array_sort(F.collect_set("kept")).alias("kept_in"))
    runs = stored(runs.toDF("run_doc", "run_body", "runs", "kept_in"), "runs")

    # Documents that lose nothing stay where they are, and the others too if what they lose can be sent to them.
    named = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate((text, id, *carry))))
    kinds = [f.dataType.simpleString() for f in named.schema]
    rest = [f"c{i}" for i in range(2, len(kinds))]
    same = (F.col("c1").cast("long") == F.col("run_doc")) & (F.xxhash64("c0") == F.col("run_body"))
    n, size = runs.agg(F.count("*"), F.coalesce(F.sum(F.size("runs") + F.size("kept_in")), F.lit(0))).first()
    keys = runs.select("run_doc", "run_body")
    how = "broadcast" if n <= BROADCAST_ROWS else "shuffle_hash"
    lines = F.length("c0") - F.length(F.replace("c0", F.lit("\n"), F.lit(""))) + 1
    whole = named.join(keys.hint(how), same, "left_anti")
    whole = whole.select("c1", "c0", F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<bigint>").alias("kept_in"), *rest)
    if size > BROADCAST_ROWS and how == "broadcast":
        named = named.join(keys.hint(how), same, "left_semi")
    ready = named.join(runs.hint("broadcast" if size <= BROADCAST_ROWS else "shuffle_hash"), same).select("c0", "runs", "c1", "kept_in", *rest)
    shape = [kinds[1], "string", "long", "long", "array<bigint>", *kinds[2:]]
    cut = ready.mapInArrow(_rewrite(strip_passages if passages else strip_runs), ", ".join(f"o{i} {k}" for i, k in enumerate(shape)))
    names = ["doc_id", "text", "n_lines", "n_removed", "kept_in", *carry]
    # By place: carried columns may have these names too.
    return whole.toDF(*(f"o{i}" for i in range(len(names)))).unionAll(cut).toDF(*names)


def _later(rows: DataFrame, part: bool = True) -> DataFrame:
    """(doc, body, first, last, kept): what stands at an earlier place, last excluded, and the document of the first.

    *rows* is a written table of (doc, body, first, last, content). Where a place overlaps the
    first one, only what lies behind that goes; without *part*, such a place is left out.
    """
    out = several_places(rows, "content", ["doc", "body", "first"], later=True)
    own = (F.col("doc") == F.col("lo.doc")) & (F.col("body") == F.col("lo.body"))
    behind = F.col("lo.first") + F.col("last") - F.col("first")
    first = F.when(own, F.greatest("first", behind)).otherwise(F.col("first"))
    if not part:
        out = out.where(~own | (behind <= F.col("first")))
    return out.select("doc", "body", first.alias("first"), "last", F.col("lo.doc").alias("kept"))


def _twice(rows: DataFrame) -> DataFrame:
    """The rows whose print stands at several places."""
    return several_places(rows, "print", ["doc", "body", "spot"])


def _later_passages(base: DataFrame) -> DataFrame:
    """(doc, body, first, last, kept): runs of words, last excluded, that stand at an earlier place."""
    shape = "doc long, body long, spot int, print long, words int, first int, last int, content long"
    rows = stored(base.mapInArrow(_prints, shape), "prints")
    spans = rows.where("content is not null").select("doc", "body", "first", "last", "content")
    # Spans that overlap their first place are left to the windows.
    spans = stored(_later(spans, part=False), "later")
    spots = _twice(rows).select("doc", "body", F.struct("spot", "print", "words").alias("s"), F.lit(None).cast("struct<first:int,last:int>").alias("r"))
    both = spots.unionByName(spans.select("doc", "body", F.lit(None).cast("struct<spot:int,print:bigint,words:int>").alias("s"), F.struct("first", "last").alias("r")))
    both = both.groupBy("doc", "body").agg(F.collect_set("s").alias("spots"), F.collect_set("r").alias("spans"))
    left = stored(both.mapInArrow(_open, "doc long, body long, spot int, print long, windows long"), "open")
    left = stored(_twice(left).groupBy("doc", "body").agg(F.collect_set(F.struct("spot", "windows")).alias("spots")), "spots")
    if left.count() <= BROADCAST_ROWS:
        base = base.join(F.broadcast(left.select("doc", "body")), ["doc", "body"], "left_semi")
    # Repeated rows are one before they are dealt.
    near = base.groupBy("doc", "body").agg(F.any_value("text").alias("text")).join(left.hint("shuffle_hash"), ["doc", "body"])
    found = near.select("text", "doc", "body", "spots").mapInArrow(_passages, "doc long, body long, first int, content long")
    return spans.unionByName(_later(stored(found.withColumn("last", F.col("first") + MIN_WORDS), "found")))
