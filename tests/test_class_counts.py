"""Terms are counted once for scores, sizes and their mean, and no table of all terms of all documents is written."""

import pytest
from pyspark.sql import functions as F

from devprism.operators import topics
from devprism.registry import QUERIES, text


def test_terms_are_counted_once(spark):
    rows = [(i, i % 3 - 1, ["a", "b", f"c{i % 2}"]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, topic int, terms array<string>")
    scores = topics.class_tfidf(docs, min_df=2)
    plan = scores._jdf.queryExecution().toString()
    assert "Window" not in plan and "inline" not in plan.lower()
    assert {(r.topic, r.term): r.tf for r in scores.filter("term = 'a'").collect()} == {(t, "a"): 4 for t in (-1, 0, 1)}


@pytest.mark.parametrize("name", ["topic_tree", "merged_topics", "reduced_outliers"])
def test_terms_of_documents_are_not_written(spark, monkeypatch, name):
    docs = spark.createDataFrame([(i, i % 4 - 1, ["a", "b", f"c{i % 3}"]) for i in range(60)], "doc_id long, topic int, terms array<string>")
    written = []

    def land(df, label):
        written.append(df.columns)
        return df

    monkeypatch.setattr(text, "land", land)
    monkeypatch.setattr(text, "topic_docs", lambda spark, sf_dir: docs)
    assert QUERIES[name].run(spark, "").agg(F.count("*")).first()[0] > 0
    assert not any("terms" in columns for columns in written)
