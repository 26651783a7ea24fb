"""What the feature tables send: sums once per author, features once for all who read them."""

import re

from devprism.operators import features
from devprism.registry import QUERIES
from test_plans import plan

METRICS = ", ".join(f"{c} double" for c in features.MEAN_METRICS)
NAMES = [*features.MEAN_METRICS, "fix", "bug"]


def commits(spark, rows):
    schema = f"author string, repo int, commit int, {METRICS}, fix int, bug int"
    return spark.createDataFrame([(a, r, c, *[None if x is None else float(x + i) for i in range(13)], 1, 0) for a, r, c, x in rows], schema)


def test_sums_do_not_travel_by_repo(spark):
    shown = plan(features.commit_table(commits(spark, [("a", 1, 1, 1)]), places=4))
    by_repo = re.findall(r"Input \[(\d+)\]: .*\nArguments: hashpartitioning\([^)]*repo", shown)
    assert by_repo and set(by_repo) == {"2"}


def test_commit_table_of_odd_rows(spark):
    rows = [("a", 1, 1, 1), ("a", 1, 1, 1), ("a", 2, None, 4), ("b", None, 7, None), (None, 3, 8, 5)]
    found = {r.author: r for r in features.commit_table(commits(spark, rows), places=4).collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"].num_proj, found["a"].num_commit, found["a"].ns, found["a"].ns_sum, found["a"].fix_sum) == (2, 2, 2.0, 6.0, 3.0)
    assert (found["b"].num_proj, found["b"].num_commit, found["b"].ns, found["b"].ns_sum) == (0, 1, None, 0.0)


def test_uncorrelated_features_reads_features_once(spark, sf_dir):
    assert "l_orderkey" not in plan(QUERIES["uncorrelated_features"].run(spark, sf_dir))
