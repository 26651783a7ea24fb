"""Periodic runs of words by online dyadic square catching.

Words are appended to a stream. For every power of two ``b`` there is a row of blocks of ``b`` words, one
starting at each multiple of ``b / 2``. A completed block has a catcher that waits for the block's words to come
again between ``b / 2`` and ``b`` words later (``b`` itself included): then the two lie so close that they form a
square, a stretch repeated at once. For each appended word and each ``b`` exactly one catcher is due, the one whose block
starts between ``b / 2`` and ``b`` words before the window that the word completes, so a word costs one comparison
of hashes per power of two. Words that arrive together are compared together.

A caught square is extended to both sides by comparing suffixes and prefixes of the stream, and merges with the
squares of the same period that it meets into one run. Runs that touch the end of the stream stay open and grow with
the next words. A run of period ``q`` and at least ``4 q`` words holds a block of the power of two in ``[q, 2 q)``
that comes again ``q`` words later, so none of these is missed; squares in shorter runs may be.

Comparisons use hashes; every run is then checked word by word, and a collision starts the stream anew with other hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from devprism.llm.common import BASE, mix, pick, powers

#: The least number of words and of periods of a run.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are appended at once; long texts are appended in several parts.
PART = 1 << 16


class Collision(Exception):
    """Two different stretches had one hash."""


class SquareCatcher:
    """A stream of word numbers and the runs in it."""

    def __init__(self, seed: int = 0):
        self.seed = np.uint64(seed)
        self.words = np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.uint64)
        #: Found stretches, one row ``start, end, period`` each: open ones, and closed ones long enough for a run.
        self.found = np.zeros((0, 3), np.int64)

    def append(self, words: np.ndarray) -> None:
        before = len(self.words)
        self.words = np.concatenate([self.words, words])
        up, _ = powers(len(self.words) + 1)
        codes = mix((words.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE) + self.seed)
        more = self.sums[-1] + np.cumsum(codes * up[before : len(self.words)], dtype=np.uint64)
        self.sums = np.concatenate([self.sums, more])
        is_open = self.found[:, 1] == before
        stretches = [self.found[~is_open], self._grown(self.found[is_open])]
        block = 1
        while block + block // 2 < len(self.words):
            caught = self._caught(block, before)
            if len(caught):
                stretches.append(self._grown(caught))
            block *= 2
        self._keep(np.concatenate(stretches))

    def _hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        _, down = powers(len(self.sums))
        return (self.sums[start + length] - self.sums[start]) * down[start]

    def _caught(self, block: int, before: int) -> np.ndarray:
        """Squares ``start, end, period`` seen by the catchers of one block length in the words from ``before`` on."""
        half, n = block // 2, len(self.words)
        window = np.arange(max(half + 1, before - block + 1), n - block + 1)
        if not len(window):
            return np.zeros((0, 3), np.int64)
        start = window - 1 if block == 1 else (window - half - 1) // half * half
        same = self._hashes(window, block) == self._hashes(start, block)
        start, period = start[same], (window - start)[same]
        order = np.lexsort((start, period))
        start, period = start[order], period[order]
        first = np.ones(len(start), bool)  # blocks that touch and come again at one distance are one stretch
        first[1:] = (period[1:] != period[:-1]) | (start[1:] > start[:-1] + block)
        last = np.append(first[1:], True)[: len(first)]
        return np.stack([start[first], start[last] + block + period[last], period[first]], axis=1)

    def _grown(self, stretches: np.ndarray) -> np.ndarray:
        """The stretches extended as far as their period lasts: halving steps of common suffixes and prefixes."""
        if not len(stretches):
            return stretches
        start, end, period = stretches.T.copy()
        step = 1 << int(max(start.max(), (len(self.words) - end).max())).bit_length()
        while step:
            fits = np.flatnonzero(start >= step)
            at = start[fits] - step
            same = self._hashes(at, step) == self._hashes(at + period[fits], step)
            start[fits[same]] -= step
            fits = np.flatnonzero(end + step <= len(self.words))
            at = end[fits]
            same = self._hashes(at, step) == self._hashes(at - period[fits], step)
            end[fits[same]] += step
            step //= 2
        return np.stack([start, end, period], axis=1)

    def _keep(self, stretches: np.ndarray) -> None:
        if not len(stretches):
            self.found = stretches
            return
        # A stretch that has grown holds the older ones of the same period and start.
        stretches = stretches[np.lexsort((stretches[:, 1], stretches[:, 2], stretches[:, 0]))]
        last = np.append((stretches[1:, 0] != stretches[:-1, 0]) | (stretches[1:, 2] != stretches[:-1, 2]), True)
        stretches = stretches[last]
        self.found = stretches[(stretches[:, 1] == len(self.words)) | _long(stretches)]

    def runs(self) -> np.ndarray:
        """Rows ``start, end, period`` by start and period: all runs of the words so far."""
        runs = self.found[_long(self.found)]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        first = np.ones(len(runs), bool)  # a stretch counts with its smallest period only
        first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        runs = runs[first]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        for start, end, period in runs:
            if not np.array_equal(self.words[start : end - period], self.words[start + period : end]):
                raise Collision
        return runs


def _long(stretches: np.ndarray) -> np.ndarray:
    return stretches[:, 1] - stretches[:, 0] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * stretches[:, 2])


def word_runs(words: np.ndarray, part: int = PART) -> np.ndarray:
    """Rows ``start, end, period`` of all runs in an array of word numbers."""
    seed = 0
    while True:
        stream = SquareCatcher(seed)
        for start in range(0, len(words), part):
            stream.append(words[start : start + part])
        try:
            return stream.runs()
        except Collision:
            seed += 1


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word at each place of a text that is looped by the checksum of its id, else None."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


@dataclass(frozen=True)
class Collapsed:
    """Runs of a text, one row ``start, end, period`` each, and its words without the repeated periods."""

    runs: np.ndarray
    words: list[bytes]


def collapse(words: list[bytes]) -> Collapsed:
    index: dict[bytes, int] = {}
    runs = word_runs(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
    stays = np.ones(len(words), bool)
    for start, end, period in runs:
        stays[start + period : end] = False
    return Collapsed(runs, words if stays.all() else [words[i] for i in np.flatnonzero(stays)])


RESULT = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _row(doc_id: int | None, text: str | None) -> tuple:
    words = [] if text is None else text.encode("utf-8", "surrogatepass").split()
    if (place := looped(doc_id, len(words))) is not None:
        words = [words[i] for i in place]
    found = collapse(words)
    rows = [(int(s), int(e - s), int(q)) for s, e, q in found.runs]
    longest = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    exponent = 1000 * longest[1] // longest[2] if rows else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    return doc_id, len(rows), *longest, exponent, sha256(listed.encode()).hexdigest(), sha256(b" ".join(found.words)).hexdigest()


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in RESULT.split(", ")]
    kinds = [pa.string() if name.endswith("sha256") else pa.int64() for name in names]
    for batch in batches:
        rows = [_row(d.as_py(), t.as_py()) for d, t in zip(*batch.columns)]
        columns = zip(*rows) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def find_runs(docs: DataFrame) -> DataFrame:
    """Runs of every text of ``docs(doc_id, text)``, each row by itself, after looping by the checksum of its id.

    Null and empty texts have no words and no runs; then ``start``, ``length``, ``period`` and ``exponent_milli`` are
    null and the digests those of the empty string. A row without id is not looped. Of runs of equal length the first
    counts, and of those that start together the one with the smallest period. Repeated rows give repeated results, an
    empty table gives none. Other columns are not read. One text is held in memory at a time.
    """
    return pick(docs, doc_id="bigint", text="string").mapInArrow(_find, RESULT)
