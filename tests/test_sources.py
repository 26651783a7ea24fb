"""Project folders, delimited files, stage tables."""

import pytest
from pyspark.sql import functions as F

from devprism.functions import numbers
from devprism.operators import mining
from devprism.sources import files, stages as st


@pytest.fixture
def tree(tmp_path):
    def write(folder, name, text):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(text)

    metrics = "transactionid,ns,la,fix,bug\n"
    write("deep/HBase", "hbase_commitsID.csv", "\ttransactionid\tcommit\n0\t1\taaa\n1\t2\tbbb\n")
    write("deep/HBase", "hbase_input.csv", metrics + "1,2.5,10,True,1\n2,,7,False,0\n")
    write("deep/HBase", "hbase_input_EB.csv", metrics + "1,2.5,10,True,0\n2,,7,False,1\n")
    write("deep/HBase", "hbase_failures.csv", "issue.names\tdate\nHBASE-1\tx\n17\ty\n")
    write("deep/HBase", "hbase_mapping.csv", "a,b\n1,2\n")
    write("Pig", "pig_commitsID.csv", "\ttransactionid\tcommit\n0\t1\tccc\n")
    write("Pig", "pig_input.csv", metrics + "1,1,1,True,1\n")
    return str(tmp_path)


def test_only_complete_projects_are_read(spark, tree):
    found = files.read_project_tree(spark, tree)
    assert {tuple(r) for r in found.commit_ids.select("project", "transactionid", "commit").collect()} == {("HBase", "1", "aaa"), ("HBase", "2", "bbb")}
    rows = {r.transactionid: r for r in found.bug.collect()}
    assert rows["1"].ns == 2.5 and rows["2"].ns is None and rows["1"].bug == 1
    assert {r.bug for r in found.bug_eb.filter("transactionid = '2'").collect()} == {1}
    assert {tuple(r) for r in found.failures.collect()} == {("HBase", "HBASE-1"), ("HBase", "17")}
    assert not [c for c in found.commit_ids.columns if c.startswith("_c")]


def test_projects_differ_in_columns_and_spelling(spark, tmp_path):
    """Columns are matched by name, true and false are numbers, NaN and empty metrics are missing."""

    def project(name, metrics):
        (tmp_path / name).mkdir()
        (tmp_path / name / "commitsID.csv").write_text("transactionid\tcommit\n1\taaa\n2\tbbb\n")
        for kind in ("input.csv", "input_EB.csv"):
            (tmp_path / name / kind).write_text(metrics)
        (tmp_path / name / "failures.csv").write_text("issue.names\nX-1\n")

    project("HBase", "transactionid,ns,nm,fix,bug\n1,10,20,True,1\n2,NaN,,false,0\n")
    project("Pig", "transactionid,nm,ns,bug,fix\n1,20,10,True,0\n2,2,1,False,1\n")
    bug = files.read_project_tree(spark, str(tmp_path)).bug
    rows = {(r.project, r.transactionid): (r.ns, r.nm, r.fix, r.bug) for r in bug.collect()}
    assert rows == {
        ("HBase", "1"): (10.0, 20.0, 1.0, 1), ("HBase", "2"): (None, None, 0.0, 0),
        ("Pig", "1"): (10.0, 20.0, 0.0, 1), ("Pig", "2"): (1.0, 2.0, 1.0, 0),
    }
    sums = bug.groupBy("project").agg(numbers.total(F.col("fix")).alias("fix"), numbers.total(F.col("bug")).alias("bug"))
    assert {tuple(r) for r in sums.collect()} == {("HBase", 1.0, 1.0), ("Pig", 1.0, 1.0)}


def test_quoted_bodies_over_several_lines(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text('ID;Polarity;Text\n1;positive;"line1\n""q"" two; x"\n2;negative;plain\n')
    rows = files.read_scsv(spark, str(path), {"ID": "bigint"}).orderBy("ID").collect()
    assert [(r.ID, r.Polarity, r.Text) for r in rows] == [(1, "positive", 'line1\n"q" two; x'), (2, "negative", "plain")]


def test_projects_are_appended_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, p string")
    b = spark.createDataFrame([("y", 2.0)], "p string, extra double")
    assert sorted(tuple(r) for r in mining.concat_projects([a, b]).select("p", "id", "extra").collect()) == [("x", 1, None), ("y", None, 2.0)]


def test_stages_and_models(spark, tmp_path):
    stages = st.Stages(spark, str(tmp_path / "root"))
    stages.write(spark.range(3), "numbers")
    stages.write(spark.range(5), "numbers")
    assert stages.read("numbers").count() == 5
    st.save_model(stages, "best", assignments=spark.range(2), best_params=spark.range(1))
    loaded = st.load_model(stages, "best", "assignments", "best_params")
    assert loaded["assignments"].count() == 2 and loaded["best_params"].count() == 1
    rows = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("v").alias("variant"), F.array(F.lit(1.5)).alias("embedding"))
    st.write_embeddings(stages, rows)
    assert dict(st.read_embeddings(stages, "v").dtypes)["embedding"] == "array<float>"
