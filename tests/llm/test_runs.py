"""Runs of words: against all stretches of all periods, word by word, and on odd rows."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from devprism.llm import runs


def plain(words):
    """``(start, end, period)`` of every run, by comparing all words at all distances."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def as_rows(found):
    return [tuple(int(v) for v in r) for r in found]


def texts():
    rng = random.Random(5)
    for size in (0, 1, 5, 6, 7, 8, 9, 24, 100):
        yield [0] * size
    for k in range(300):
        n, letters = rng.randrange(1, 90), rng.randrange(1, 4)
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(k % 4):  # loops within loops
            a, q, times = rng.randrange(n), rng.randrange(1, 14), rng.randrange(2, 9)
            words[a : a + 1] = words[a : a + q] * times
        yield words


def test_against_all_periods():
    for words in texts():
        assert as_rows(runs.word_runs(np.array(words, np.int64))) == plain(words)


@pytest.mark.parametrize("period", range(1, 40))
def test_each_period_at_each_place(period):
    for start in range(0, 20):
        words = [1000 + i for i in range(start)] + list(range(period)) * 4 + list(range(period))[: period // 2] + [7000, 7001]
        assert as_rows(runs.word_runs(np.array(words, np.int64))) == plain(words)


def test_words_one_by_one_give_the_same_at_every_time():
    for words in list(texts())[9:60]:
        stream = runs.SquareCatcher()
        for n, word in enumerate(words, 1):
            stream.append(np.array([word], np.int64))
            assert as_rows(stream.runs()) == plain(words[:n])


def test_parts_of_any_size():
    words = np.array(list(range(37)) * 50 + [5] * 400 + list(range(11)) * 30, np.int64)
    whole = as_rows(runs.word_runs(words))
    assert [as_rows(runs.word_runs(words, part)) for part in (7, 64, 1000)] == [whole] * 3


def test_long_text_with_one_word():
    assert as_rows(runs.word_runs(np.zeros(300_000, np.int64))) == [(0, 300_000, 1)]


def test_collision_starts_anew(monkeypatch):
    kept = runs.SquareCatcher._hashes
    monkeypatch.setattr(runs.SquareCatcher, "_hashes", lambda self, a, n: kept(self, a, n) * np.uint64(bool(self.seed)))
    assert as_rows(runs.word_runs(np.arange(40))) == []


def expected(doc_id, text):
    words = "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *four, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def test_rows(documents):
    rng = random.Random(9)
    vocabulary = ["été", "A", "a", "x y", "né,", "b"]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(None, "a a a a a a"), (None, None), (3, "b b b b b b b"), (3, "b b b b b b b"), (4, None), (5, ""), (6, " \n"), (7, "x y " * 30_000)]
    rows = [r for r in rows if not (r[0] == 7 and len(r[1]) > 1000)] + [(7, "x y " * 300)]
    got = sorted((tuple(r) for r in runs.find_runs(documents(rows)).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)


def test_empty_table(documents):
    assert runs.find_runs(documents([])).collect() == []
