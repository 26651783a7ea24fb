"""What the physical plans and the sources must not contain, and what they must."""

import io
import pathlib
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from devprism.operators import features, neighbors, text
from devprism.registry import QUERIES, tables

PACKAGE = pathlib.Path(__file__).parent.parent / "devprism"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("word", ["localCheckpoint", "crossJoin", "applyInPandas", r"\.rdd\b", "toPandas", r"\bpickle\b"])
def test_not_in_the_package(word):
    hits = [p.name for p in PACKAGE.rglob("*.py") if "llm" not in p.parts and re.search(word, p.read_text())]
    assert hits == []


def test_columns_reach_the_scan(spark, sf_dir):
    shown = plan(features.num_proj(tables.commits(spark, sf_dir)))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", shown)
    assert sorted(schemas) == ["l_orderkey:bigint,l_suppkey:bigint", "o_orderkey:bigint,o_custkey:bigint"] or all(
        s.count(":") == 2 for s in schemas
    )
    assert "IsNotNull(l_orderkey)" in shown


@pytest.mark.parametrize("name", ["author_features", "clean_documents", "class_tfidf", "reattributed_comments", "mined_issues"])
def test_no_python_and_no_nested_loops(spark, sf_dir, name):
    shown = plan(QUERIES[name].run(spark, sf_dir))
    assert "Python" not in shown and "Pandas" not in shown
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_cleaning_does_not_shuffle(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    assert "Exchange" not in plan(text.clean_documents(docs, "text").select("doc_id", "clean_text"))


def test_radius_join_is_an_equi_join(spark):
    points = spark.range(50).select("id", F.array(F.rand(1), F.rand(2)).alias("x"), F.lit(1).cast("bigint").alias("w"))
    shown = plan(neighbors.eps_join(points, 0.1, 2))
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown


def test_author_features_shuffle_once_per_side(spark, sf_dir):
    df = features.author_topic_features(tables.issue_topics(spark, sf_dir))
    assert plan(df).count("Exchange\n") <= 4
