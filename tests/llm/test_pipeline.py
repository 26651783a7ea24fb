"""Each stage of the pipeline against a plain version on the small tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from devprism.llm import secrets, toxicity
from devprism.runtime import land

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = land(stage(spark, docs, SF), name)
        out.append(docs)
    return [{r.doc_id: r for r in d.collect()} for d in out]


def test_columns(spark, stages):
    for kept in stages[1:-1]:
        assert list(next(iter(kept.values())).asDict()) == list(pipeline.COLUMNS)


def test_toxic_go(spark, stages):
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    assert set(stages[1]) == {d for d, r in stages[0].items() if scorer.score(r.text) < pipeline.TOXIC_FROM}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert len(clean & set(stages[1])) >= 0.98 * len(clean)


def test_one_of_each_group_stays(stages, words):
    sets = {}
    for d, r in stages[1].items():
        w = words(r.text)
        sets[d] = frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for o in {x for g in s for x in holders[g] if x < d}:
            if 100 * len(s & sets[o]) >= 80 * len(s | sets[o]):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    assert set(stages[2]) == {d for d in sets if root(d) == d}


def test_leaks_go(spark, stages):
    def plain(t):
        return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))

    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(stages[3]) == {d for d, r in stages[2].items() if not any(f" {i} " in f" {plain(r.text)} " for i in items)}


def test_secrets_are_masked(stages):
    scanner = secrets.Scanner(secrets.Entropy())
    assert set(stages[4]) == set(stages[3])
    for d, r in stages[4].items():
        before = stages[3][d]
        if not scanner.spans(before.text):
            assert r == before
        else:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)


def test_mix(stages):
    rows = stages[5].values()
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert set(stages[5]) <= set(stages[4])


def test_run(spark, stages):
    rows = pipeline.run(spark, SF)
    assert {r.doc_id: r.taken for r in rows.select("doc_id", F.col("taken")).collect()} == {d: r.taken for d, r in stages[5].items()}
