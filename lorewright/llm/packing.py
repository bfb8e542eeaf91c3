"""Operator 5: hierarchical multi-length packing.

Documents are routed to tiers of context sizes, all powers of two: what fills whole longest windows
is cut off, the rest goes to the smallest tier that holds it. Each tier's documents open windows of
its size, longest tier first; the gap behind a document is filled from shorter tiers, best fit
first, and closed by cutting the next document. The few tokens that a task has left at its end are
cut into powers of two. So no sequence is padded, and most documents stay in one piece.

A task holds at most BUFFER_TOKENS tokens besides one document. Full windows are dealt, largest
first, to the step group that lacks most, so every group of STEP_TOKENS tokens is full and holds
the same mix of tiers.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.store import small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
TIERS = (2048, 1024, 512, 256)
END = 1
BUFFER_TOKENS = 1 << 20
STEP_TOKENS = 16 * 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Encoder:
    """Ids of whole texts, as the ``tokenizers`` file byte_bpe_50k.json gives them.

    The same vocabulary is read as ranks (byte_bpe_50k.tiktoken): its encoder gives the same ids
    four times as fast, which tests hold against ``tokenizers``. The strings of the file's added
    tokens are ordinary text unless *added*: then each gives its own id, as by default there.
    """

    def __init__(self, path: str | None = None):
        import json

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
            self.added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)

    def encode(self, text: str, added: bool = False) -> np.ndarray:
        if added and any(x in text for x in self.added):
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4")
        return np.array(self.encoding.encode_ordinary(text), "<u4")


@lru_cache(maxsize=1)
def encoder_of(path: str | None) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path)


class Packer:
    """Cuts and packs (doc_id, ids) as they come; finished rows are taken by drain()."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS):
        self.task, self.tiers = task, tuple(sorted(tiers, reverse=True))
        self.pool: list[tuple[int, int, int]] = []  # length, document, start; by length
        self.docs: dict[int, tuple[int | None, np.ndarray, int, int]] = {}  # id, ids from a place on, that place, tokens
        self.held = 0
        self.ready: list[tuple[int, list[tuple]]] = []  # tier, pieces
        self.n = self.sequences = self.steps = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, at, k = self.tiers[0], 0, self.n
        self.n += 1
        self.docs[k] = (doc_id, ids, 0, len(ids))
        while len(ids) - at >= top:
            self._close(top, [(k, at, top)])
            at += top
        self.docs[k] = (doc_id, ids[at:].copy(), at, len(ids))
        if at < len(ids):
            insort(self.pool, (len(ids) - at, k, at))
            self.held += len(ids) - at
        if self.held >= BUFFER_TOKENS:
            self.pack()

    def _close(self, tier: int, pieces: list[tuple[int, int, int]]) -> None:
        rows = []
        offset = 0
        for k, start, length in pieces:
            doc_id, ids, base, tokens = self.docs[k]
            rows.append((doc_id, start, length, zlib.crc32(ids[start - base : start - base + length].tobytes()), tokens, offset))
            offset += length
        self.ready.append((tier, rows))

    def _fill(self, size: int) -> list[tuple[int, int, int]]:
        """Takes from the pool a window of *size* tokens; the pool holds as many."""
        pieces, left = [], size
        while left:
            i = bisect_right(self.pool, (left, 1 << 62, 0)) - 1
            length, k, at = self.pool.pop(max(i, 0))
            use = min(length, left)
            pieces.append((k, at, use))
            if use < length:
                insort(self.pool, (length - use, k, at + use))
            left -= use
        self.held -= size
        return pieces

    def pack(self) -> None:
        """Packs the pool but for less than a window of the longest tier."""
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while self.held >= self.tiers[0] and self.pool[-1][0] > below:
                length, k, at = self.pool.pop()
                self.held -= length
                if self.held < tier - length:
                    insort(self.pool, (length, k, at))
                    self.held += length
                    break
                self._close(tier, [(k, at, length), *self._fill(tier - length)])
        left = {k for _, k, _ in self.pool}
        self.docs = {k: v for k, v in self.docs.items() if k in left}

    def finish(self) -> None:
        self.pack()
        size = self.tiers[0]
        while self.held:
            if self.held >= size:
                self._close(size, self._fill(size))
            else:
                size //= 2

    def drain(self, last: bool = False) -> list[tuple]:
        """Rows of full step groups; with *last*, of all. What fills no group is a mix of tiers too.

        Sizes fall, so powers of two fill the groups exactly, in whatever order they take turns.
        """
        self.ready.sort(key=lambda x: -x[0])
        full, rest = divmod(sum(t for t, _ in self.ready), STEP_TOKENS)
        groups = [(0, g) for g in range(full)]  # tokens, group: a heap
        out, kept, left = [], [], rest
        for tier, rows in self.ready:
            if left >= tier and (not full or left * STEP_TOKENS >= (STEP_TOKENS - groups[0][0]) * rest or groups[0][0] == STEP_TOKENS):
                left -= tier
                group = full
                if not last:
                    kept.append((tier, rows))
                    continue
            else:
                held, group = groups[0]
                heapreplace(groups, (held + tier, group))
            s = (self.task << 32) + self.sequences
            out += [(*r[:5], s, r[5], tier, (self.task << 32) + self.steps + group) for r in rows]
            self.sequences += 1
        self.ready = kept
        self.steps += full + (last and rest > 0)
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack(docs: DataFrame, text: str = "text", id: str = "doc_id", path: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    tier is the sequence's size: one of *tiers*, or a smaller power of two at the end of a task.

    Null text counts as empty; an empty text has the one id 1. Repeated rows are packed each for
    itself, and rows with a null id too (their pieces carry null). Any length is packed whole. An
    empty table gives an empty result. sequence_id and step_group hold the number of the scan's
    task above 32 bits of a count, so a task run again gives the same ids.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encoder, packer = encoder_of(path), Packer(context.partitionId() if context else 0, tiers)
        end = np.array([END], "<u4")
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(d, np.concatenate((encoder.encode(t.as_py() or "", added=True), end)))
                if len(packer.ready) >= 512 and (rows := packer.drain()):
                    yield _batch(rows)
        packer.finish()
        if rows := packer.drain(last=True):
            yield _batch(rows)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
