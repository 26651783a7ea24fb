"""Heavy-light join: against all pairs for light, heavy and mixed sizes, and on odd rows."""

import random
from itertools import combinations

import pytest

from devprism.llm import jaccard
from devprism.llm.jaccard import Settings


def shingles(listed, k=3):
    return {tuple(listed[i : i + k]) for i in range(len(listed) - k + 1)} if len(listed) >= k else {tuple(listed)} if listed else set()


def plain(rows, words, percent=90):
    sets = [shingles(words(text)) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[root(j)] = root(i)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc_id)
    return sorted(((d, len(s), min((x for x in ids[root(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(df, **settings):
    return sorted((tuple(r) for r in jaccard.linked_components(df, Settings(**settings)).collect()), key=repr)


def families(seed, sizes, copies, edits):
    """Texts, each with copies in which words near the ends are added, dropped or changed."""
    rng = random.Random(seed)
    for f, size in enumerate(sizes):
        base = [f"{rng.choice('abcdef')}{rng.randrange(900)}" for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                at = rng.choice([0, 1, len(text) - 1, rng.randrange(len(text))])
                text[at : at + rng.randrange(2)] = [f"n{rng.randrange(50)}"] * rng.randrange(2)
                text = text or ["x"]
            yield " ".join(text)


@pytest.mark.parametrize(
    "sizes,settings",
    [
        ([*range(3, 40)], {}),
        ([*range(10, 40)], {"lightest": 1}),
        ([*range(12, 45, 2)], {"lightest": 32, "short": 2}),
        ([60, 100, 118, 120, 125, 127, 128, 130, 135, 140, 150, 300], {}),
        ([60, 100, 118, 120, 125, 127, 128, 130, 135, 140, 150, 300], {"whole": 40, "part": 4, "short": 2, "block_rows": 3}),
    ],
)
def test_against_all_pairs(documents, words, sizes, settings):
    rows = list(enumerate(families(3, sizes, 7, 3)))
    assert found(documents(rows), **settings) == plain(rows, words)


def test_shared_passages_do_not_link(documents, words):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(140)] + passage)) for i in range(60)]
    rows += [(100 + i, " ".join(passage + [f"e{i}"] * (i % 3))) for i in range(30)]
    assert found(documents(rows), short=4) == plain(rows, words)


def test_all_light_sizes_are_listed_by_both_sides():
    s = Settings()
    for m in range(1, 64):
        for k, c in jaccard.partners(m, s):
            assert (m, c) in jaccard.partners(k, s)
            assert 100 * c >= 90 * (m + k - c) and 100 * (c - 1) < 90 * (m + k - c + 1)


def test_boundary_follows_cost():
    s = Settings()
    assert jaccard.boundary({m: 1 for m in range(1, 64)}, s) in range(10, 32)
    assert jaccard.boundary({m: 1 for m in range(30, 64)}, Settings(shared=3)) <= 33
    assert jaccard.boundary({}, s) == 1


def test_odd_rows(documents, words):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "One"), (9, "oNE"), (10, "one two"), (None, "one two"), (None, "alone here now then"), (11, "ONE two three")]
    rows += [(12, "a b c d e f g h i j k l"), (12, "a b c d e f g h i j k l"), (12, "other text under one id"), (4, "a b c d e f g h i j k l m")]
    rows += [(13, "été " * 500), (14, "été été été"), (None, None), (15, " ".join(f"v{i}" for i in range(30_000))), (16, " ".join(f"v{i}" for i in range(29_000)))]
    got = found(documents(rows))
    want = plain([r for r in rows if words(r[1])], words) + [(d, 0, d) for d, t in rows if not words(t)]
    assert got == sorted(want, key=repr)


def test_large_family_of_copies_in_many_blocks(documents, words):
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 30 + i % 3], f"z{i}", *base[31 + i % 3 :]])) for i in range(150)]
    got = found(documents(rows), block_rows=16)
    assert got == plain(rows, words)


def test_empty_table(documents):
    assert found(documents([])) == []
