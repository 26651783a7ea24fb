"""Repeated substrings by a hash-compared suffix sort of sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it starts earlier too, in a document before or
further left in its own. Comparing all suffixes is not needed to find out: the smallest of the hashes of
the grams in a window of ``length`` bytes marks an anchor, and equal windows have equal anchors at equal
places. So only suffixes at anchors whose gram repeats can matter, and of those with equal surroundings
only the first.

What is left is sorted: prefix polynomial hashes and binary search give the common extension of two
suffixes in a logarithmic number of steps, and a merge sort uses it to compare. Neighbors in the order
forwards from the anchors, and in the order backwards, are verified byte by byte. Windows are equal where both
extensions reach far enough, and all but the first of equal windows are removed.

Anchors of a gram that is in very many different surroundings are not sorted in one task: their windows
are grouped by two 64-bit hashes instead, which Spark combines map-side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devprism.llm.common import EMIT_BYTES, as_long, mix, pick, prefix_hashes, seeds, slice_hashes, sliding_argmin, text_chunks
from devprism.runtime import land

LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 32
    #: Surroundings of one gram that are sorted in one task; windows of more are grouped by hash.
    group_rows: int = 2048

    @property
    def reach(self) -> int:
        return self.length - self.gram + 1


_CODES = seeds(257, 31)


def _buffer(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some texts, and where each begins; null is empty."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def anchors_of(texts: list, settings: Settings) -> tuple[np.ndarray, ...]:
    """``doc, gram hash, hash of surroundings, place, left, right`` of the anchors of a list of texts.

    Windows of the anchor at ``place`` start at ``place - left`` to ``place - right``; the surroundings
    are all bytes of those windows.
    """
    data, begin = _buffer(texts)
    size, none = settings.length, np.zeros(0, np.int64)
    if len(data) < size:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    prefix = prefix_hashes(_CODES[data])
    start = np.arange(len(data) - settings.gram + 1)
    gram = slice_hashes(prefix, start, start + settings.gram)
    best = sliding_argmin(gram, settings.reach)
    window = np.arange(len(data) - size + 1)
    doc = np.searchsorted(begin, window, "right") - 1
    inside = window + size <= begin[doc + 1]
    window, doc, best = window[inside], doc[inside], best[window[inside]]
    if not len(window):
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    new = np.ones(len(window), bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    place, low, high, doc = best[first], window[first], window[last], doc[first]
    around = mix(slice_hashes(prefix, low, high + size) + (place - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return doc, gram[place], around, place - begin[doc], place - low, place - high


def merged(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of touching ranges of each owner."""
    if not len(start):
        return start, end, owner
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    reach = end + owner * (int(end.max()) + 1)  # running maxima must not cross owners
    top = np.maximum.accumulate(reach)
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] + owner[1:] * (int(end.max()) + 1) > top[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], top[last] - owner[first] * (int(end.max()) + 1), owner[first]


#: kind 0: an anchor, ``pack`` holds place, left and right; kind 1: bytes ``place`` to ``pack`` are removed.
ANCHOR = "kind int, gram bigint, around bigint, d bigint, th bigint, place bigint, pack bigint"


def _emit_anchors(settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, batch in ((p, b) for b in batches for p in text_chunks(list(b["text"]), EMIT_BYTES)):
            batch = batch.iloc[part]
            texts, ids, hashes = list(batch["text"]), batch["d"].to_numpy(np.int64), batch["th"].to_numpy(np.int64)
            parts = [anchors_of(texts[p], settings) for p in text_chunks(texts)]
            if not parts:
                continue
            offset = np.repeat([p.start for p in text_chunks(texts)], [len(p[0]) for p in parts])
            doc, gram, around, place, left, right = (np.concatenate(x) for x in zip(*parts))
            doc = doc + offset
            d, th = ids[doc], hashes[doc]
            # Of equal anchors in a batch only the first goes on, so a frequent passage sends one row per batch.
            order = np.lexsort((place, th, d, around, gram))
            again = np.zeros(len(order), bool)
            again[1:] = (gram[order][1:] == gram[order][:-1]) & (around[order][1:] == around[order][:-1])
            twice, once = order[again], order[~again]
            yield pd.DataFrame({
                "kind": np.zeros(len(once), np.int32), "gram": as_long(gram[once]), "around": as_long(around[once]), "d": d[once], "th": th[once],
                "place": place[once], "pack": left[once] << 16 | right[once],
            })
            start, end, owner = merged(place[twice] - left[twice], place[twice] - right[twice] + settings.length, doc[twice])
            yield pd.DataFrame({
                "kind": np.ones(len(start), np.int32), "gram": as_long(mix(start.astype(np.uint64) + seeds(1, 3) * (1 + owner.astype(np.uint64)))),
                "around": np.zeros(len(start), np.int64), "d": ids[owner], "th": hashes[owner], "place": start, "pack": end,
            })

    return run


def _group_anchors(settings: Settings):
    """From anchors in order: ranges of those with equal surroundings to an earlier one (kind 1), and the first of
    each surroundings where a gram has several (kind 2). State is one row, however long a group is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = around = None
        pending = None
        for batch in batches:
            done = batch[batch["kind"] == 1]
            if len(done):
                yield done
            rows = batch[batch["kind"] == 0]
            if not len(rows):
                continue
            g, a = rows["gram"].to_numpy(), rows["around"].to_numpy()
            before_g, before_a = np.roll(g, 1), np.roll(a, 1)
            new_gram = g != before_g
            new_around = new_gram | (a != before_a)
            new_gram[0] = gram is None or g[0] != gram
            new_around[0] = new_gram[0] or a[0] != around
            again = rows[~new_around]
            if len(again):
                left, right = again["pack"].to_numpy() >> 16, again["pack"].to_numpy() & 0xFFFF
                yield again.assign(kind=1, place=again["place"] - left, pack=again["place"] - right + settings.length)
            # A gram's first surroundings wait until a second one shows that they matter.
            firsts = rows[new_around]
            starts = new_gram[new_around]
            followed = np.append(~starts[1:], False)
            if len(firsts):
                if pending is not None and not starts[0]:
                    yield pending.assign(kind=2)
                    pending = None
                elif starts[0]:
                    pending = None
                wanted = firsts[~starts | followed]
                if len(wanted):
                    yield wanted.assign(kind=2)
                if starts[-1]:
                    pending = firsts.iloc[-1:]
                elif len(firsts) > 1 or not starts[0]:
                    pending = None
            gram, around = g[-1], a[-1]

    return run


#: kind 0: surroundings to sort; kind 1: a window of a crowded gram, by two hashes.
CONTEXT = "kind int, gram bigint, other bigint, d bigint, th bigint, place bigint, left int, right int, bytes binary"


def _emit_contexts(settings: Settings):
    size = settings.length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, d, th, asked in zip(batch["text"], batch["d"], batch["th"], batch["asked"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                hashes = None
                for r in asked:
                    place, left, right = r["place"], r["pack"] >> 16, r["pack"] & 0xFFFF
                    if not r["crowded"]:
                        out.append((0, r["gram"], 0, d, th, place, left, right, raw[place - left : place - right + size]))
                        continue
                    if hashes is None:
                        data = np.frombuffer(raw, np.uint8)
                        hashes = [prefix_hashes(_CODES[data]), prefix_hashes(mix(_CODES[data]))]
                    start = np.arange(place - left, place - right + 1)
                    one, two = (as_long(slice_hashes(p, start, start + size)) for p in hashes)
                    out += [(1, int(x), int(y), d, th, int(s), 0, 0, None) for s, x, y in zip(start, one, two)]
            yield pd.DataFrame(out, columns=["kind", "gram", "other", "d", "th", "place", "left", "right", "bytes"])

    return run


class Suffixes:
    """Suffixes ``start[i]:end[i]`` of one buffer, each within a group; ordered by a merge sort on hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.data, self.start, self.end, self.group = data, start, end, group
        self.prefix = prefix_hashes(_CODES[data])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes ``a[i]`` and ``b[i]``, by binary search on prefix hashes."""
        sa, sb = self.start[a], self.start[b]
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.end[a] - sa, self.end[b] - sb)
        while (open_rows := np.flatnonzero(low < high)).size:
            middle = (low[open_rows] + high[open_rows] + 1) // 2
            x, y = sa[open_rows], sb[open_rows]
            same = slice_hashes(self.prefix, x, x + middle) == slice_hashes(self.prefix, y, y + middle)
            low[open_rows] = np.where(same, middle, low[open_rows])
            high[open_rows] = np.where(same, high[open_rows], middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix ``a[i]`` comes before ``b[i]``: the byte after their common prefix decides, then the length."""
        common = self.extension(a, b)
        x, y = self.start[a] + common, self.start[b] + common
        ends_a, ends_b = x >= self.end[a], y >= self.end[b]
        last = len(self.data) - 1
        smaller = self.data[np.minimum(x, last)] < self.data[np.minimum(y, last)]
        return np.where(ends_a | ends_b, ends_a & ~ends_b, smaller)

    def order(self) -> np.ndarray:
        """All groups sorted at once; suffixes arrive group by group. Runs of 1, 2, 4, ... are merged in pairs."""
        n = len(self.start)
        perm = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = self.group[1:] != self.group[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        tail = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
        longest = int((tail - head).max()) if n else 0
        width = 1
        while width < longest:
            place = np.arange(n)
            run = (place - head) // width
            partner = np.where(run % 2 == 0, run + 1, run - 1) * width + head  # the run to merge with
            low, high = partner.copy(), np.minimum(partner + width, tail)
            moved = np.flatnonzero(low < high)
            low, high, first = low[moved], high[moved], run[moved] % 2 == 0
            base = low.copy()
            while (open_rows := np.flatnonzero(low < high)).size:
                middle = (low[open_rows] + high[open_rows]) // 2
                mine, theirs = perm[moved[open_rows]], perm[middle]
                # Rows of the first run go before equal rows of the second, so ranks never meet.
                ahead = np.where(first[open_rows], self.before(theirs, mine), ~self.before(mine, theirs))
                low[open_rows] = np.where(ahead, middle + 1, low[open_rows])
                high[open_rows] = np.where(ahead, high[open_rows], middle)
            rank = low - base
            target = place.copy()
            own = moved - np.where(first, base - width, base + width)
            target[moved] = np.where(first, base - width, base) + own + rank
            fresh = perm.copy()
            fresh[target] = perm
            perm, width = fresh, width * 2
        return perm

    def checked(self) -> tuple[np.ndarray, np.ndarray]:
        """Order, and the common prefix of each suffix with the one before it (-1 at the head of a group), verified on
        the bytes. Should hashes have collided, the groups are sorted by their bytes instead."""
        perm = self.order()
        a, b = perm[:-1], perm[1:]
        common = self.extension(a, b)
        if not np.array_equal(common, self._common(a, b)) or not self._ascending(a, b, common):
            raw = self.data.tobytes()
            perm = np.array(sorted(range(len(perm)), key=lambda i: (self.group[i], raw[self.start[i] : self.end[i]])), np.int64)
            a, b = perm[:-1], perm[1:]
            common = self._common(a, b)
        out = np.full(len(perm), -1, np.int64)
        out[1:] = np.where(self.group[a] == self.group[b], common, -1)
        return perm, out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        room = np.minimum(self.end[a] - self.start[a], self.end[b] - self.start[b])
        alive = np.flatnonzero(room > 0)
        while alive.size:
            same = self.data[self.start[a[alive]] + out[alive]] == self.data[self.start[b[alive]] + out[alive]]
            alive = alive[same]
            out[alive] += 1
            alive = alive[out[alive] < room[alive]]
        return out

    def _ascending(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> bool:
        x, y, last = self.start[a] + common, self.start[b] + common, len(self.data) - 1
        ends = x >= self.end[a]
        more = y < self.end[b]
        fine = np.where(ends, True, more & (self.data[np.minimum(x, last)] < self.data[np.minimum(y, last)]))
        return bool((fine | (self.group[a] != self.group[b])).all())


def removed_windows(rows: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """Ranges to remove, from whole groups of surroundings: all but the first of equal windows."""
    rows = rows.sort_values(["gram", "d", "th", "place"], kind="stable")
    group = rows["gram"].to_numpy()
    left, right = rows["left"].to_numpy(np.int64), rows["right"].to_numpy(np.int64)
    raw = [bytes(b) for b in rows["bytes"]]
    n, sizes = len(raw), np.array([len(b) for b in raw])
    begin = np.cumsum(sizes) - sizes
    ahead = Suffixes(np.frombuffer(b"".join(raw), np.uint8), begin + left, begin + sizes, group)
    turned = Suffixes(np.frombuffer(b"".join(b[::-1] for b in raw), np.uint8), begin + sizes - left, begin + sizes, group)
    (order_a, common_a), (order_b, common_b) = ahead.checked(), turned.checked()
    most, least = np.full(n, -1), np.full(n, settings.length)
    for back in range(int(right.min()), int(left.max()) + 1):
        valid = np.flatnonzero((right <= back) & (back <= left))
        if len(valid) < 2:
            continue
        kind_a, kind_b = np.empty(n, np.int64), np.empty(n, np.int64)
        kind_a[order_a] = np.cumsum(common_a < settings.length - back)
        kind_b[order_b] = np.cumsum(common_b < back)
        # Rows stand in document order, so the smallest row number of equal windows is the first.
        key = np.sort((kind_a[valid] * (n + 1) + kind_b[valid]) * n + valid)
        again = key[1:][key[1:] // n == key[:-1] // n] % n
        most[again] = np.maximum(most[again], back)
        least[again] = np.minimum(least[again], back)
    hit = np.flatnonzero(most >= 0)
    place = rows["place"].to_numpy()[hit]
    return pd.DataFrame({
        "d": rows["d"].to_numpy()[hit], "th": rows["th"].to_numpy()[hit],
        "place": place - most[hit], "pack": place - least[hit] + settings.length,
    })


def _sort_groups(settings: Settings):
    """Whole groups of the rows in order; the last one of a batch waits for the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            if not len(rows):
                continue
            open_rows = (rows["gram"] == rows["gram"].iloc[-1]).to_numpy()
            kept, rows = rows[open_rows], rows[~open_rows]
            if len(rows):
                yield removed_windows(rows, settings)
        if kept is not None and len(kept):
            yield removed_windows(kept, settings)

    return run


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, ranges in zip(batch["doc_id"], batch["text"], batch["ranges"]):
            raw = ("" if text is None else text).encode("utf-8", "surrogatepass")
            gone, spans, kept, at = 0, [], sha256(), 0
            for start, end in sorted((r["place"], r["pack"]) for r in (ranges if ranges is not None else ())):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(end, spans[-1][1])
                else:
                    spans.append([start, end])
            for start, end in spans:
                kept.update(raw[at:start])
                gone, at = gone + end - start, end
            kept.update(raw[at:])
            out.append((doc_id, len(raw), gone, len(spans), kept.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_ranges(keyed: DataFrame, settings: Settings) -> DataFrame:
    """``d, th, place, pack``: byte ranges to remove, of documents ``keyed(d, th, text)``."""
    anchors = keyed.mapInPandas(_emit_anchors(settings), ANCHOR)
    inside = anchors.repartition("gram").sortWithinPartitions("gram", "around", "d", "th", "place")
    grouped = land(inside.mapInPandas(_group_anchors(settings), ANCHOR), "anchor_groups")
    asked = grouped.filter("kind = 2")
    sizes = asked.groupBy("gram").agg((F.count("*") > settings.group_rows).alias("crowded"))
    asked = asked.join(sizes, "gram").groupBy("d", "th").agg(F.collect_list(F.struct("gram", "place", "pack", "crowded")).alias("asked"))
    contexts = keyed.join(asked, ["d", "th"]).select("text", "d", "th", "asked").mapInPandas(_emit_contexts(settings), CONTEXT)
    contexts = land(contexts, "contexts")
    small = contexts.filter("kind = 0").repartition("gram").sortWithinPartitions("gram")
    sorted_out = small.mapInPandas(_sort_groups(settings), "d bigint, th bigint, place bigint, pack bigint")
    windows = contexts.filter("kind = 1").select("gram", "other", "d", "th", "place")
    first = windows.groupBy("gram", "other").agg(F.min(F.struct("d", "th", "place")).alias("first"))
    later = windows.join(first, ["gram", "other"]).filter(F.struct("d", "th", "place") > F.col("first"))
    later = later.select("d", "th", "place", (F.col("place") + settings.length).alias("pack"))
    plain = grouped.filter("kind = 1").select("d", "th", "place", "pack")
    return plain.unionByName(sorted_out).unionByName(later)


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for each row of ``docs(doc_id, text)``.

    Null texts are empty. Documents are in order of their id, those without an id last; rows that
    repeat an id with the same text are one document and each get its result, rows with the same id
    and another text are ordered by a hash of it. Other columns are not read; an empty table gives no
    rows. A text is in memory as a whole, with about 60 bytes per byte of it.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit(LAST)))
    repeated = not rows.groupBy("d").count().filter("count > 1").isEmpty()
    keyed = rows.withColumn("th", F.xxhash64("text") if repeated else F.lit(0).cast("bigint"))
    distinct = keyed.select("d", "th", "text")
    if repeated:
        distinct = distinct.groupBy("d", "th").agg(F.first("text").alias("text"))
    ranges = repeated_ranges(distinct, settings)
    ranges = ranges.groupBy("d", "th").agg(F.collect_list(F.struct("place", "pack")).alias("ranges"))
    joined = keyed.join(ranges, ["d", "th"], "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "ranges")
    kinds = "doc_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    # Ids travel as text through pandas, which has no null for whole numbers.
    return joined.mapInPandas(_apply, kinds).withColumn("doc_id", F.col("doc_id").cast("bigint"))
