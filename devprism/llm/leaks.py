"""Benchmark decontamination: segments of items by hash, exact edit verification.

An item that may have k edits is cut into k + 1 segments of nearly equal length. Whatever words are
edited, one segment at least stays whole, so every place of an item within the distance holds one of
its segments word by word, at most k words off its place. Segments of a length are found by a
rolling hash of all runs of so many words, the pairs of a place and an item are thinned by the words
they share, and the rest is aligned with the whole item by exact edit distance in words. Nothing
within the distance is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devprism.llm.common import Words, pick, prefix_hashes, slice_hashes, text_chunks

HITS = "array<struct<item_id:bigint,start_word:int,end_word:int,distance:int>>"


@dataclass(frozen=True)
class Settings:
    #: Least share of an item's words that stay unedited, as 1 - distance / words.
    similarity: float = 0.8
    #: Items of fewer words identify nothing and are not searched.
    min_words: int = 5
    #: Items per pass over the documents; more items take more passes.
    block: int = 4096


#: Pairs of a place and an item that are looked at together, and words compared at once.
PAIRS, COMPARED = 1 << 18, 1 << 23
#: Items up to so many words are compared with their places all at once, longer ones when aligned.
SHORT = 64


def edits(words: int, similarity: float) -> int:
    """Edits that an item of so many words may have."""
    return int(words * (1 - similarity) + 1e-9)


class Index:
    """Segments of all items of a block; shipped to the tasks."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.settings = settings
        words = Words([t for _, t in items], "punctuation")
        size = np.diff(words.first)
        kept = np.flatnonzero(size >= settings.min_words)
        self.items = [(items[k][0], words.code[words.first[k] : words.first[k + 1]]) for k in kept.tolist()]
        self.size = size[kept]
        self.allowed = np.array([edits(n, settings.similarity) for n in self.size.tolist()], np.int64)
        parts = np.minimum(self.allowed + 1, self.size)
        item = np.repeat(np.arange(len(kept)), parts)
        nth = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end = nth * self.size[item] // parts[item], (nth + 1) * self.size[item] // parts[item]
        first, prefix = words.first[kept][item], prefix_hashes(words.code)
        #: By length of the segments: bits of their hashes, the hashes in order, their items and places.
        self.tables = {}
        for length in np.unique(end - start).tolist():
            mine = np.flatnonzero(end - start == length)
            key = slice_hashes(prefix, first[mine] + start[mine], first[mine] + end[mine])
            order = np.argsort(key, kind="stable")
            sieve = np.zeros(1 << max(16, (8 * len(key)).bit_length()), bool)
            sieve[(key & np.uint64(len(sieve) - 1)).astype(np.int64)] = True
            self.tables[length] = sieve, key[order], item[mine][order], start[mine][order]

    def met(self, words: Words) -> Iterator[np.ndarray]:
        """Rows ``(text, item, place where the item would start)`` of segments that were met, part by part."""
        prefix = prefix_hashes(words.code)
        for length, (sieve, keys, items, offsets) in self.tables.items():
            place = np.arange(len(words.code) - length + 1)
            key = slice_hashes(prefix, place, place + length)
            alive = np.flatnonzero(sieve[(key & np.uint64(len(sieve) - 1)).astype(np.int64)] & (words.doc[place] == words.doc[place + length - 1]))
            left = np.searchsorted(keys, key[alive])
            count = np.searchsorted(keys, key[alive], "right") - left
            total = np.append(0, np.cumsum(count))
            for a in range(0, int(total[-1]), PAIRS):
                pair = np.arange(a, min(a + PAIRS, int(total[-1])))
                at = np.searchsorted(total, pair, "right") - 1
                entry = left[at] + pair - total[at]
                yield np.unique(np.column_stack([words.doc[alive[at]], items[entry], alive[at] - offsets[entry]]), axis=0)

    def shared(self, rows: np.ndarray, words: Words) -> np.ndarray:
        """Those of ``rows`` around whose place all words of the item stand, but for as many as may be edited."""
        keep = self.size[rows[:, 1]] > SHORT
        for size in np.unique(self.size[rows[~keep, 1]]).tolist():
            mine = np.flatnonzero(self.size[rows[:, 1]] == size)
            off = edits(size, self.settings.similarity)
            step = max(1, COMPARED // (size * (size + 2 * off)))
            for some in (mine[i : i + step] for i in range(0, len(mine), step)):
                doc, start = rows[some, 0], rows[some, 2]
                near = start[:, None] + np.arange(-off, size + off)
                inside = (near >= words.first[doc][:, None]) & (near < words.first[doc + 1][:, None])
                near = words.code[np.where(inside, near, 0)]
                item = np.stack([self.items[k][1] for k in rows[some, 1].tolist()])
                keep[some] = ((item[:, :, None] == near[:, None, :]) & inside[:, None, :]).any(axis=2).sum(axis=1) >= size - off
        return rows[keep]

    def candidates(self, words: Words) -> np.ndarray:
        """Rows ``(text, item, place)`` to align, in order; places count over all texts."""
        out = [self.shared(rows, words) for rows in self.met(words)]
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def hits(self, texts: list) -> list[list[dict]]:
        found: list[list[dict]] = [[] for _ in texts]
        if not self.items:
            return found
        for part in text_chunks(texts):
            words = Words(texts[part], "punctuation")
            if not len(words.code):
                continue
            done: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for d, k, start in self.candidates(words).tolist():
                taken = done.setdefault((d, k), [])
                if any(s <= start + 1 and start + self.allowed[k] < e for s, e in taken):  # all it can start at is taken
                    continue
                first, last = int(words.first[d]), int(words.first[d + 1])
                hit = align(self.items[k][1], words.code[first:last], start - first, self.settings.similarity)
                if hit and not any(s < first + hit[1] and first + hit[0] < e for s, e in taken):
                    taken.append((first + hit[0], first + hit[1]))
                    found[part.start + d].append({"item_id": self.items[k][0], "start_word": hit[0], "end_word": hit[1], "distance": hit[2]})
        return [sorted(f, key=lambda h: (h["item_id"], h["start_word"])) for f in found]


def _ends(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edits that turn ``item`` into a part of ``text`` ending at each place."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[:-1] + (text != word), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return row


def align(item: np.ndarray, text: np.ndarray, guess: int, similarity: float) -> tuple[int, int, int] | None:
    """``(start, end, distance)`` of the best alignment near ``guess``, or None if it is too far off."""
    n = len(item)
    allowed = edits(n, similarity)
    if 0 <= guess and guess + n <= len(text) and np.array_equal(item, text[guess : guess + n]):
        return guess, guess + n, 0
    left, right = max(0, guess - 2 * allowed - 1), min(len(text), guess + n + 2 * allowed + 1)
    if right - left < n - allowed:
        return None
    part = text[left:right]
    if sum(map(set(part.tolist()).__contains__, item.tolist())) < n - allowed:  # each word that is missing costs an edit
        return None
    ends = _ends(item, part)
    end = int(np.argmin(ends))
    if ends[end] > allowed:
        return None
    back = _ends(item[::-1], part[:end][::-1])
    start = end - int(np.flatnonzero(back == back.min())[0])
    return left + start, left + end, int(ends[end])


def leak_hits(text: Column, index: Index) -> Column:
    """Items found in a text as ``array<struct<item_id, start_word, end_word, distance>>``, by item and place.

    Words are runs of letters and digits, letters in either case. Null and empty texts have no hits.
    """

    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(index.hits(list(texts)))

    return search(text)


def indexes(benchmark: DataFrame, settings: Settings = Settings()) -> Iterator[Index]:
    """One index per block of about ``settings.block`` items; repeated rows count once, nulls not at all."""
    items = pick(benchmark, item_id="bigint", text="string").dropna().distinct()
    blocks = max(1, -(-items.count() // settings.block))
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Index([(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()], settings)


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, start_word, end_word, distance`` for each benchmark item found in a document.

    One pass over the documents per block of items, no shuffle. Repeated documents each give their
    rows; empty tables give none; other columns are not read.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    found = [rows.select("doc_id", F.explode(leak_hits(F.col("text"), index)).alias("h")).select("doc_id", "h.*") for index in indexes(benchmark, settings)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; all columns stay."""
    for index in indexes(benchmark, settings):
        docs = docs.filter(F.size(leak_hits(F.col("text").cast("string"), index)) == 0)
    return docs
