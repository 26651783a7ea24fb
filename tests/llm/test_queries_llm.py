"""The registered queries against SQL or brute force on the small given tables."""

import hashlib
import re

import pytest
from compare import difference

import __spark_entry__ as contract
from devprism.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, db, name):
    assert difference(queries.QUERIES[name](spark, SF), db, queries.SQL[name]) is None


def test_registered():
    names = contract.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and set(queries.SQL) <= set(contract.oracle_sql())


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


def secret(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text or "", re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]


@pytest.mark.parametrize("name,rule", [("op7_privacy", personal), ("op10_secrets", secret)])
def test_base_spans(spark, texts, name, rule):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = rule(texts[r.doc_id])
        assert r.base_sha256 == digest(base)
        assert set(base) <= set(filter(None, r.spans.split(",")))


def test_language_held_out(spark, db):
    langs = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in queries.QUERIES["op1_language"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op8_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    clean = [r for r in rows if labels[r.doc_id] == 0]
    toxic = [r for r in rows if labels[r.doc_id] == 1]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_leaks_exact(spark, db, texts):
    def plain(t):
        return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))

    items = dict(db.execute("SELECT item_id, text FROM benchmark").fetchall())
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {plain(x)} " in f" {plain(t)} "}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_decontamination"](spark, SF).collect() if r.distance == 0}
    assert got == want


def test_near_duplicates(spark, texts, words):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = sorted((d, len(s), root(d), d == root(d)) for d, s in sets.items())
    assert sorted(map(tuple, queries.QUERIES["op5_superminhash"](spark, SF).collect())) == want


def test_repeats(spark, texts):
    seen, want = set(), {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(raw[p : p + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    rows = queries.QUERIES["op3_repeats"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_passages(spark, texts):
    """Each long run of words that a document shares with another one brings it into the result."""
    runs, shared = {}, set()
    for d, t in texts.items():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for i in range(len(w) - 51):
            first = runs.setdefault(tuple(w[i : i + 52]), d)
            if first != d:
                shared |= {d, first}
    rows = queries.QUERIES["op2_passages"](spark, SF).collect()
    found = {r.doc_id for r in rows} | {r.match_doc_id for r in rows}
    assert shared <= found and all(r.similarity >= 0.8 and r.doc_id != r.match_doc_id for r in rows)
