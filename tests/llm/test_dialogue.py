"""Conversation repair: against all edits, chunk by chunk, and on odd rows."""

import re
from functools import cache
from hashlib import sha256
from zlib import crc32

import pytest

from devprism.llm import dialogue

SPACE = " \t\n\v\f\r"


def damage(rows):
    left = {}
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        harm = crc32(key.encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        mine = left.setdefault(conv, [])
        mine += [(turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return left


def plain(rows):
    """Per conversation the contract's columns, by a search over all edits."""
    out = {}
    for conv, lines in damage(rows).items():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in lines:
            rest = text.rstrip(SPACE)
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in lines if t is not None]
        initials = [role[:1] for _, role, _ in lines]

        @cache
        def best(i, state, room):
            """Least (cost, audit, written lines) from row i on; ``room`` is the number of insertions that may follow."""
            options = []
            if i == len(lines):
                if state in ("", "a"):
                    options.append((0, "", ()))
            else:
                _, role, text = lines[i]
                if (found := best(i + 1, state, 2)) is not None:
                    options.append((found[0] + 2, "D" + found[1], found[2]))
                if faults[i] not in ("blank", "duplicate"):
                    for letter, new in (("K", role), ("R", "user"), ("R", "assistant")):
                        if state + new[:1] in ("s", "u", "su", "ua", "au") and (found := best(i + 1, new[:1], 2)) is not None:
                            cost = found[0] + (letter == "R") + 5 * (faults[i] == "truncated")
                            options.append((cost, letter + found[1], (f"{new}:{text}", *found[2])))
            for new in ("user", "assistant") if room else ():
                if state + new[:1] in ("u", "su", "ua", "au") and (found := best(i, new[:1], room - 1)) is not None:
                    options.append((found[0] + 5, "I" + found[1], (f"{new}:", *found[2])))
            return min(options, default=None)

        cost, audit, written = best(0, "", 2)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, sha256("\n".join(written).encode()).hexdigest())
    return out


def talk(count, turns, seed):
    state = seed
    for conv in range(count):
        for turn in range(turns):
            state = state * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
            pick = state >> 40
            role = ("user", "assistant", "user", "assistant", "system", "tool", "user", "assistant")[pick % 8] if pick % 5 == 0 else ("user", "assistant")[turn % 2]
            yield conv, turn + (pick % 11 == 0), role, ("Yes.", "No? ", f"Word {pick % 7}!", f"cut {pick % 5}", " \t", "Done.\n")[pick // 8 % 6]


ODD = [
    (1, None, "user", "Hi."), (1, None, None, "Hi."), (1, 3, "assistant", None), (1, 3, "assistant", "Good."), (1, 9, "assistant", "Good."),
    (None, 1, "user", "Who?"), (None, None, "assistant", "Me."), (None, 2, "user", "Who?"), (None, 7, "", "x."),
    (2, -5, "system", "S."), (2, -5, "system", "S."), (2, -5, "system", "S."), (2, 4, "user", "été!"), (3, 1, None, None), (4, 2, "user", ""),
]


@pytest.fixture(scope="module")
def conversations(spark):
    def build(rows, parts=3):
        wide = [(*r, "x", 1) for r in rows]
        return spark.createDataFrame(wide, "conv_id bigint, turn bigint, role string, text string, Audit string, cost int").repartition(parts)

    return build


def repaired(df, **settings):
    rows = dialogue.repair_conversations(df, dialogue.Settings(**settings)).collect()
    return {r[0]: tuple(r)[1:] for r in rows}


ZEROS = (0, 0, 0, 0, 0, 0, "", sha256().hexdigest())


@pytest.mark.parametrize("rows,chunk", [(list(talk(40, 9, 1)), 4096), (list(talk(6, 60, 2)), 4), (list(talk(6, 60, 2)), 1), (ODD, 4096), (ODD, 1)])
def test_against_all_edits(conversations, rows, chunk):
    want = dict.fromkeys({r[0] for r in rows}, ZEROS) | plain(rows)
    assert repaired(conversations(rows), rows=chunk) == want


def test_conversation_without_rows_after_damage(conversations):
    gone = next(c for c in range(100) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(conversations([(gone, 0, "user", "Hi.")])) == {gone: ZEROS}


def test_empty_table(conversations):
    assert repaired(conversations([])) == {}


def test_long_conversation_with_long_text(conversations):
    rows = [(7, i, ("user", "assistant")[i % 2], "word. " * (50_000 if i == 3 else 1) + str(i) + ".") for i in range(3000)]
    assert repaired(conversations(rows), rows=500, chars=5_000) == repaired(conversations(rows, 1))


def test_copies_are_counted_not_listed(conversations):
    rows = [(8, 1, "user", "Same.")] * 500 + [(8, 2, "assistant", "Fine.")]
    found = repaired(conversations(rows))
    assert found == plain(rows)


KINDS = "suaosUAxuuaxaSuOauausx"


@pytest.mark.parametrize("end", [(0, 10, 5, 0), (3, 0, 1, 2), (0, 0, 0, 0), (2, 7, 7, 0)])
def test_fix_up_is_a_new_start(end):
    start, total = dialogue.backward(KINDS, dialogue.END)
    assert dialogue.fix_up(KINDS, dialogue.END, start, total, end)[:2] == dialogue.backward(KINDS, end)


def test_fix_up_stops_early():
    kinds = "ua" * 5000
    start, total = dialogue.backward(kinds, dialogue.END)
    assert dialogue.fix_up(kinds, dialogue.END, start, total, (4, 6, 0, 2))[2] < 20
