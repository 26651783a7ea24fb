"""Each stage of the pipeline on nulls, empty texts, copies, rows without ids, clashing columns and empty tables."""

import pytest

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(40))
OTHER = " ".join(f"other{i}" for i in range(40))
KEY = "password=abcdef123456"
ROWS = [
    (1, LONG, "en", "a"), (2, LONG, None, "a"), (1, LONG, "en", "a"), (None, LONG, "en", None),
    (None, OTHER, "en", "b"), (None, OTHER, "en", "b"), (5, None, "en", "a"), (6, "", "en", "a"),
    (None, None, None, None), (None, None, None, None), (7, f"my {KEY} here", "en", "a"),
]
STAGE = dict(pipeline.STAGES)


def through(spark, documents, name, rows=ROWS):
    out = STAGE[name](spark, documents(rows), SF)
    assert out.columns[: len(pipeline.COLUMNS)] == list(pipeline.COLUMNS)
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def texts(rows):
    return sorted(((r[0], r[1]) for r in rows), key=str)


@pytest.mark.parametrize("name", ["toxicity", "decontamination"])
def test_nothing_clean_goes(spark, documents, name):
    assert through(spark, documents, name) == texts(ROWS)


def test_copies_without_ids_stay_once(spark, documents):
    assert through(spark, documents, "near_duplicates") == texts(
        [(1, LONG), (None, OTHER), (5, None), (6, ""), (None, None), (7, f"my {KEY} here")]
    )


def test_only_secrets_change(spark, documents):
    masked = [(r[0], "my [SECRET] here" if r[0] == 7 else r[1]) for r in ROWS]
    assert through(spark, documents, "secrets") == texts(masked)


def test_only_words_are_mixed(spark, documents):
    taken = through(spark, documents, "mixing")
    assert taken and set(taken) <= {r for r in texts(ROWS) if r[1]}


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_table(spark, documents, name):
    assert through(spark, documents, name, []) == []
