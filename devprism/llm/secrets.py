"""Secrets in text: fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a long run of token characters. Over each run of one character class a window
slides; the counts of its characters, and with them the entropy, are updated by the one character
that enters and the one that leaves. Windows over the bound of their class make spans, unless the
run is allowed as a whole, the window meets a word that marks samples, or a fixed pattern has already
marked it. A marked sample excuses the windows it is in, not what else stands in its path or key.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devprism.llm.common import pick

# The patterns of the base kinds, in their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Pairs of letters that are usual in words, by the first letter.
PAIRS = {
    first + second
    for part in (
        "abcdgilmnprstuvy baeiloru caehiklortu daeiorsu eacdeilmnpqrstuvx faefioru gaehilnoru haeiort iabcdefglmnorstv jaeou kei ladeilostuy "
        "mabeimopsu nacdefgikostu obcdfgilmnoprstuvw paehiloprstu qu racdeiklmnorstuvy sacehiklmopqstuwy taehilorstuwy uabcdegilmnprst "
        "vaeio waehio xaeipt yeos zaeio"
    ).split()
    for first, second in ((part[0], c) for c in part[1:])
}
KINDS = ("assign", "access", "hex", "entropy")

SPAN = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Entropy:
    """Bounds of the entropy search; ``classes`` are (name, pattern of a run, window, bits)."""

    candidate: str = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
    classes: tuple[tuple[str, str, int, float], ...] = (
        ("hex", r"[0-9a-fA-F]{20,}", 20, 2.9),
        ("alnum", r"[A-Za-z0-9]{20,}", 20, 3.6),
        ("base64", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.7),
    )
    #: Runs that are no secrets: numbers and dates, identifiers in the usual form.
    allow: tuple[str, ...] = (r"[0-9_=+/-]*", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
    #: Nor are code words joined by separators, if their letters are those of words: so large a share of their
    #: pairs is usual, over the run and in each word of so many letters.
    code: str = r"([A-Za-z]*[0-9]{0,4}[-_/=+])*[A-Za-z]*[0-9]{0,4}"
    usual: float = 0.7
    long: int = 12
    #: Windows that meet one of these words, or so many characters in order, are samples.
    marker: str = r"(?i)example|sample|placeholder|x{4,}|dummy"
    in_order: int = 8


def window_entropies(run: str, width: int) -> list[float]:
    """Entropy in bits of each window of ``width`` characters, by incremental counts."""
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    counts: dict[str, int] = {}
    total, out, full = 0.0, [], math.log2(width)
    for i, new in enumerate(run):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += term[c + 1] - term[c]
        if i >= width:
            old = run[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if i >= width - 1:
            out.append(full - total / width)
    return out


class Ranges:
    """Ranges that are asked which of them meet another; each answer is one binary search."""

    def __init__(self, ranges: list[tuple[int, int]]):
        ranges = sorted(ranges)
        self.starts = [s for s, _ in ranges]
        self.ends = list(accumulate((e for _, e in ranges), max))

    def meet(self, start: int, end: int) -> bool:
        """Whether a range begins before ``end`` and one of those that do ends after ``start``."""
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


class Scanner:
    """Finds the spans of one text; built once per task."""

    def __init__(self, settings: Entropy):
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(ACCESS)
        self.hex = re.compile(HEX)
        self.candidate = re.compile(settings.candidate)
        self.classes = [(re.compile(run), width, bits) for _, run, width, bits in settings.classes]
        self.allow = [re.compile(p) for p in settings.allow]
        self.code, self.marker = re.compile(settings.code), re.compile(settings.marker)
        self.usual, self.long, self.in_order = settings.usual, settings.long, settings.in_order

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def allowed(self, run: str) -> bool:
        """Whether a whole run is no secret."""
        if any(p.fullmatch(run) for p in self.allow):
            return True
        if not self.code.fullmatch(run):
            return False
        usual = pairs = 0
        for word in re.findall("[a-z]+", run.lower()):
            mine = sum(word[i : i + 2] in PAIRS for i in range(len(word) - 1))
            if len(word) >= self.long and mine < self.usual * (len(word) - 1):
                return False
            usual, pairs = usual + mine, pairs + len(word) - 1
        return usual >= self.usual * pairs

    def samples(self, candidate: str) -> list[tuple[int, int]]:
        """Ranges of marker words and of characters in order."""
        found, start = [m.span() for m in self.marker.finditer(candidate)], 0
        low = candidate.lower()
        for i in range(1, len(low) + 1):
            if i == len(low) or ord(low[i]) != ord(low[i - 1]) + 1:
                if i - start >= self.in_order:
                    found.append((start, i))
                start = i
        return found

    def dense(self, candidate: str) -> list[tuple[int, int]]:
        """Runs of windows over their bound, as merged ranges."""
        marked, samples = [], Ranges(self.samples(candidate))
        for run, width, bits in self.classes:
            for m in run.finditer(candidate):
                if self.allowed(m[0]):
                    continue
                for i, entropy in enumerate(window_entropies(m[0], width), m.start()):
                    if entropy >= bits and not samples.meet(i, i + width):
                        marked.append((i, i + width))
        merged: list[tuple[int, int]] = []
        for start, end in sorted(marked):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return merged

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(start, kind, end)`` in code points, by start and kind."""
        if not text:
            return []
        base, more = self.base(text), []
        fixed = Ranges([(s, e) for s, _, e in base])
        for m in self.candidate.finditer(text):
            if self.allowed(m[0]):
                continue
            for start, end in self.dense(m[0]):
                start, end = start + m.start(), end + m.start()
                if not fixed.meet(start, end):
                    more.append((start, 3, end))
        return sorted(base + more)


def secret_spans(text: Column, settings: Entropy = Entropy()) -> Column:
    """All secrets of a text as ``array<struct<kind, start, end>>`` by start, then kind.

    Offsets are code points, the end is exclusive. Null and empty texts give an empty array. One
    Arrow batch of texts is in memory at a time.
    """

    @F.pandas_udf(SPAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(settings)
        for texts in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.spans(t)] for t in texts])

    return scan(text)


def masked(text: Column, settings: Entropy = Entropy(), mark: str = "[SECRET]") -> Column:
    """``redacted`` by the spans of ``secret_spans`` in one visit to Python; null where a text has no secrets."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(settings)
        for texts in batches:
            spans = [[(s, e) for s, _, e in scanner.spans(t)] for t in texts]
            yield pd.Series([mask(t, found, mark) if found else None for t, found in zip(texts, spans)], dtype="object")

    return run(text)


def find_secrets(docs: DataFrame, settings: Entropy = Entropy()) -> DataFrame:
    """``doc_id, secrets`` for each row of ``docs(doc_id, text)``; repeated rows stay, other columns are not read."""
    rows = pick(docs, doc_id="bigint", text="string")
    return rows.select("doc_id", secret_spans(F.col("text"), settings).alias("secrets"))


def mask(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with each group of overlapping ranges, given by start, replaced by ``mark``."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each group of overlapping spans replaced by ``mark``; texts without spans, and null, stay as they are."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([mask(t, [(s["start"], s["end"]) for s in f], mark) for t, f in zip(texts, found)], dtype="object")

    hit = F.size(spans) > 0
    # Only texts that change travel to Python a second time.
    return F.when(hit, run(F.when(hit, text).otherwise(""), F.when(hit, spans).otherwise(F.array().cast(SPAN)))).otherwise(text)
