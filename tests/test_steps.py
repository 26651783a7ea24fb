"""The topic step: search, and load with documents that were not there at search time."""

from pyspark.sql import functions as F

from devprism.operators import mining, topics
from devprism.plans import steps
from devprism.registry import steps as registered


def test_assignment_below_the_least_cosine_is_an_outlier(spark):
    centroids = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "topic int, centroid array<double>")
    vectors = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, -0.2])], "doc_id int, embedding array<float>")

    def assigned(min_prob):
        return {r.doc_id: r.topic for r in topics.assign_topics(vectors, centroids, min_prob=min_prob).collect()}

    assert assigned(0.9) == {1: 0, 2: -1, 3: -1, 4: -1}
    assert assigned(0.5) == {1: 0, 2: 0, 3: -1, 4: -1}


def test_topics_search_then_load(spark, sf_dir):
    stages = registered.new_stages(spark)
    tree, landed = registered.project_tree(spark, sf_dir), registered.responses(spark, sf_dir)
    issues = stages.write(mining.preprocess_issues(steps.mine_issues(tree, landed)), "issues_preprocessed")
    settings = registered.settings()[0]
    first = steps.topics(stages, settings).select("doc_id", "topic", "topic_prob").collect()
    assert any(r.topic > -1 for r in first)
    assert len({r.topic for r in first if r.topic_prob is not None}) <= settings.nr_topics
    known = issues.filter("issue_body is not null").limit(1).withColumn("issue_names", F.lit("NEW-1"))
    stages.write(issues.unionByName(known), "issues_more")
    later = steps.Stages(spark, stages.root)
    stages.write(later.read("issues_more"), "issues_preprocessed")
    again = steps.topics(later, settings, "load")
    assert again.filter("issue_names = 'NEW-1' and topic_prob is not null").count() == 1
    old = {r.doc_id: r.topic for r in first}
    assert all(old.get(r.doc_id, r.topic) == r.topic for r in again.select("doc_id", "topic").collect())


def test_clusters_are_searched_over_the_whole_grids():
    grids = registered.settings()[1]
    assert len(grids.eps) * len(grids.min_samples) == 126 and len(grids.n_clusters) == 33
    assert set(grids.matrices) == {"all", "commits"}
