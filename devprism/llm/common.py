"""Helpers shared by the operators: column picking, word codes over UTF-8 bytes, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are coded at once; one longer text is coded alone.
CHUNK_BYTES = 400_000
#: Powers that a worker keeps; longer texts make their own.
KEPT_POWERS = 1 << 22
#: Characters of text whose results leave a task at once.
EMIT_BYTES = 4_000_000


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast; other columns, names that differ by case and repeated names do no harm."""
    place: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        place.setdefault(name, i)
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{place[name]}").cast(kind).alias(name) for name, kind in types.items()])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(salt))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse modulo 2**64 for i < n; kept per worker, dropped after an outsize text."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n * 5 // 4, CHUNK_BYTES)
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if n > KEPT_POWERS:
            return up, down
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


@cache
def _byte_codes(lower: bool) -> np.ndarray:
    codes = seeds(256, 77)
    if lower:
        codes = codes.copy()
        codes[65:91] = codes[97:123]
    return codes


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """``p`` with ``p[i] = sum(values[j] * BASE**j for j < i)`` modulo 2**64."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]``, the same wherever the slice stands."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@cache
def _separators(kind: str) -> np.ndarray:
    table = np.zeros(256, bool)
    if kind == "space":
        table[[0x20, 9, 10, 11, 12, 13]] = True
    else:
        table[:128] = [not chr(i).isalnum() for i in range(128)]
    return table


class Words:
    """Words of a list of texts: ``code`` (64-bit hash), ``doc`` (place in the list), in text order.

    ``first[d]:first[d + 1]`` are the words of text ``d``. Null texts have none.
    """

    def __init__(self, texts: list, kind: str, lower: bool = True):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        inside = np.zeros(len(buffer) + 1, np.int8)
        inside[1:] = ~_separators(kind)[buffer]
        steps = np.diff(inside)
        start = np.flatnonzero(steps == 1)
        end = np.flatnonzero(steps == -1)
        prefix = prefix_hashes(_byte_codes(lower)[buffer])
        self.code = slice_hashes(prefix, start, end)
        borders = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.first = np.searchsorted(start, borders)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))


def text_chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of a list of texts that hold about ``limit`` characters each."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if held and held + n > limit:
            yield slice(start, i)
            start, held = i, 0
        held += n + 1
    if start < len(texts):
        yield slice(start, len(texts))


def as_long(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.int64)


#: Places inside one section of ``sliding_argmin`` take the low bits of a value.
PLACE_BITS = 22


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in each window of ``width`` values; the leftmost of equals.

    Values are compared by their upper 42 bits; the lower ones carry the place, so that a running
    minimum by doubling finds the place itself. Long inputs go section by section.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    section = (1 << PLACE_BITS) - width
    out = []
    for start in range(0, n, section):
        part = values[start : start + min(section, n - start) + width - 1]
        low = np.uint64((1 << PLACE_BITS) - 1)
        best = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            best = np.minimum(best[: len(best) - step], best[step:])
            reach += step
        out.append((best & low).astype(np.int64) + start)
    return np.concatenate(out)
