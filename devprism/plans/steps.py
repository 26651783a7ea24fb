"""The five steps. Each reads its stage tables, writes its own, and keeps rows keyed throughout."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devprism.operators import (
    correlation, density, features, mining, report, sentiment as sent, silhouette, spectral, text, topicfit, topics as top,
    vectors,
)
from devprism.runtime import land
from devprism.sources.files import ProjectTree
from devprism.sources.stages import Stages, load_model, save_model

ISSUE_KEY = [
    "issue_names", "num_comments", "issue_title", "issue_body", "issue_user", "issue_labels",
    "issue_author_association", "issue_created_at", "issue_updated_at", "issue_closed_at", "is_pull_request",
]


# --- 1. mining -------------------------------------------------------------------------------


def mine_commits(tree: ProjectTree, responses: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """Commits with their metrics, both labels, the fetched record and its author."""
    ids = mining.commit_call(mining.map_repo(mining.qualify_id(tree.commit_ids)))
    bug = mining.qualify_id(tree.bug).drop("project")
    bug_eb = mining.rename_label(mining.qualify_id(tree.bug_eb)).drop("project")
    raw = mining.join_commits(ids.drop("project"), mining.join_labels(bug, bug_eb))
    found = mining.drop_not_found(mining.join_responses(raw, responses, "call"))
    return mining.commit_author(found, drop_unknown)


def mine_issues(tree: ProjectTree, responses: DataFrame) -> DataFrame:
    """One row per issue and comment; every landed page of an issue's comments is used."""
    named = mining.issue_call(mining.map_repo(tree.failures))
    fields = mining.issue_fields(mining.join_responses(named, responses, "issue_call", "issue"))
    asked = fields.select(F.col("comments_call").alias("_asked")).filter("_asked is not null").distinct()
    pages = responses.filter("status = 200").select(
        F.regexp_replace("call", r"\?.*$", "").alias("_asked"), F.col("body").alias("comments")
    )
    comments = land(mining.explode_comments(pages.join(asked, "_asked", "left_semi")), "comments")
    both = mining.join_issue_comments(fields, comments)
    return mining.project_columns(both, mining.ISSUE_TABLE)


def mine(stages: Stages, tree: ProjectTree, responses: DataFrame, keep_unmarked: bool = True) -> dict[str, DataFrame]:
    commits = stages.write(mine_commits(tree, responses), "commits")
    issues = stages.write(mine_issues(tree, responses), "issues")
    clean = stages.write(mining.preprocess_issues(issues, keep_unmarked), "issues_preprocessed")
    return {"commits": commits, "issues": issues, "issues_preprocessed": clean}


# --- 2. topics -------------------------------------------------------------------------------


@dataclass(frozen=True)
class TopicSettings:
    """What the search settles on. ``eps`` and ``min_samples`` belong to the vectors in use."""

    eps: float = 0.25
    min_samples: int = 5
    width: int = 8
    min_cluster_size: int | None = None
    nr_topics: int = 11
    outliers: float = 0.1
    reduce_frequent: bool = True
    bm25: bool = False
    min_df: int = 10
    #: Whether ``min_df`` counts documents or classes.
    scope: str = "documents"
    #: Least cosine to a topic's centroid; a document below it is an outlier.
    min_prob: float = 0.1
    #: Experiments to run before the final fit, by default none of the three rounds.
    rounds: Sequence[str] = ()


def issue_documents(issues: DataFrame, null_token: str = "nan") -> DataFrame:
    """One document per different issue, with its text and its cleaned text.

    The id is a digest of the row, so a later run gives the same issue the same id.
    """
    columns = [c for c in ISSUE_KEY if c in issues.columns]
    different = mining.distinct_rows(issues.filter("issue_names is not null").select(*columns))
    keyed = different.withColumn("doc_id", F.md5(F.to_json(F.struct(*columns)).cast("binary")))
    return text.clean_documents(mining.document_text(keyed, null_token))


def topics(stages: Stages, settings: TopicSettings = TopicSettings(), mode: str = "search") -> DataFrame:
    """``issue_topics``: search fits and saves topics; load takes the saved ones and makes vectors of all documents,
    also of those that are new, with the saved word weights."""
    docs = stages.write(issue_documents(stages.read("issues_preprocessed")), "issue_docs")
    if mode == "search":
        _search_topics(stages, docs, settings)
    elif mode != "load":
        raise ValueError("mode is 'search' or 'load'")
    model = load_model(stages, "topic_model", "centroids", "word_weights")
    weights = model["word_weights"].first().weights
    vecs = topicfit.featurize(docs, "clean_text", "small_clean", topicfit.SMALL_WIDTH, weights=weights).select("doc_id", "embedding")
    assigned = top.assign_topics(vecs, model["centroids"], min_prob=settings.min_prob)
    named = docs.join(assigned, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit(top.OUTLIER)))
    return stages.write(named.drop("tokens"), "issue_topics")


def _search_topics(stages: Stages, docs: DataFrame, s: TopicSettings) -> None:
    vecs = stages.write(topicfit.four_variants(docs), "embeddings", ("variant",))

    def fit(variant: str) -> DataFrame:
        rows = vecs.filter(F.col("variant") == variant).select("doc_id", "embedding")
        return land(topicfit.topic_fit(rows, s.width, s.eps, s.min_samples, s.min_cluster_size, pca=s.width), "fit")

    configs = [c for name in s.rounds for c in topicfit.experiment_rounds()[name]]
    fits = {v: fit(v) for v in {c.variant for c in configs} | {"small_clean"}}
    if configs:
        stages.write(topicfit.topic_experiments(docs, fits, configs, s.min_df), "topic_scores")

    best = topicfit.Config("best", "small_clean", "clean_text", s.outliers, s.reduce_frequent, s.bm25)
    assigned, final = topicfit.describe_topics(docs, fits["small_clean"], best, s.min_df, s.nr_topics, s.scope)
    weights = topicfit.word_weights(docs, "clean_text", topicfit.SMALL_WIDTH)
    small = vecs.filter("variant = 'small_clean'").select("doc_id", "embedding")
    save_model(
        stages, "topic_model",
        assignments=assigned,
        topic_terms=top.topic_top_terms(final),
        topic_similarity=top.topic_similarity(final),
        centroids=top.topic_centroids(small, assigned, topicfit.SMALL_WIDTH),
        word_weights=stages.spark.createDataFrame([(weights,)], "weights array<double>"),
    )


# --- 3. sentiment ----------------------------------------------------------------------------


def sentiment(stages: Stages, gold: DataFrame, baseline: PipelineModel | None = None) -> dict[str, DataFrame]:
    """Train on the gold set, validate, compare with a baseline, and score all real comments.

    ``gold(id, label, text)`` holds polarity names. Without a baseline model a smaller one of our
    own stands in for it.
    """
    coded = sent.encode_polarity(gold).withColumnRenamed("label", "target")
    parts = land(sent.split_train_validation(coded, "id"), "gold")
    train, validation = parts.filter("part = 'train'"), parts.filter("part = 'validation'")
    tuned = sent.train_sentiment(train)
    # Two classes: a neutral comment says nothing about them and is left out of their training.
    binary = sent.train_sentiment(train.filter("target <> 1").withColumn("target", F.expr("cast(target = 2 as int)")))
    if baseline is None:
        baseline = sent.train_sentiment(train, features=1 << 8)
    predictions = {"baseline": sent.validate_sentiment(baseline, validation), "tuned": sent.validate_sentiment(tuned, validation)}
    written = {name: stages.write(df, f"sentiment_predictions_{name}") for name, df in predictions.items()}
    quality = stages.write(sent.compare_models(written), "sentiment_quality")

    raw, clean = stages.read("issues"), stages.read("issues_preprocessed")
    models = {"zero": (baseline, sent.CLASSES), "tuned": (tuned, sent.CLASSES), "binary": (binary, sent.BINARY_CLASSES)}
    runs = sent.sentiment_runs({"raw": raw, "preprocessed": clean}, models)
    runs = stages.write(runs, "sentiment_runs")
    names = [f"{t}_{m}" for t in ("raw", "preprocessed") for m in models]
    spread = stages.write(sent.sentiment_distribution(runs, names), "sentiment_distribution")
    final = runs.filter("run = 'preprocessed_tuned'").dropDuplicates(["comment_id"])
    scored = stages.write(sent.attach_sentiment(clean, final), "comment_sentiment")
    return {"quality": quality, "distribution": spread, "comment_sentiment": scored}


# --- 4. features -----------------------------------------------------------------------------


def author_features(stages: Stages, subset: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The three feature tables and the merged one. ``subset`` narrows which nulls drop a comment."""
    commits = stages.write(features.author_commit_features(stages.read("commits")), "author_commit_features")
    issues = stages.read("issue_topics")
    # The fixed columns, and those of topics a model with more of them has; one row per topic reaches the driver.
    names = sorted({*features.TOPICS, *(r.topic for r in issues.select("topic").distinct().collect())})
    topic = stages.write(features.author_topic_features(issues, topics=names), "author_topic_features")
    comment = stages.read("comment_sentiment")
    stages.write(features.unknown_sentiments(comment), "unknown_sentiments")
    scored = features.require_all(comment, subset)
    comments = stages.write(features.author_sentiment_features(scored), "author_sentiment_features")
    merged = features.fill_missing(features.merge_author_features(commits, comments, topic))
    tables = {"commits": commits, "topics": topic, "sentiment": comments, "all": stages.write(merged, "author_features")}
    for name, table in tables.items():
        cols = table.columns[1:]
        matrix = stages.write(correlation.correlation_matrix(table, cols), f"correlation_{name}")
        kept = correlation.select_uncorrelated(matrix, cols)
        stages.write(stages.spark.createDataFrame([(c,) for c in kept], "feature string"), f"uncorrelated_{name}")
    return tables


# --- 5. clustering ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ClusterSettings:
    eps: Sequence[float] = tuple(density.EPS_VALUES)
    min_samples: Sequence[int] = tuple(density.MIN_SAMPLE_VALUES)
    n_clusters: Sequence[int] = tuple(spectral.N_CLUSTERS)
    k_neighbors: int = 10
    matrices: Sequence[str] = field(default=("all", "commits"))


def _search_clusters(points: DataFrame, width: int, s: ClusterSettings) -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
    """Per algorithm: all scores, the best grid point, and the labels ``(id, cluster)`` at it."""
    model = density.DensityModel(points, width, s.eps, s.min_samples)
    fits = land(model.weighted_clusters(), "density_labels")
    scores = land(silhouette.silhouette_l1(fits), "density_scores")
    best = land(silhouette.best_config(scores, ["fit"]), "density_best")
    chosen = fits.join(F.broadcast(best.select("fit")), "fit", "left_semi").select("x", "cluster")
    dense = (model.named(scores), model.named(best), points.join(chosen, "x").select("id", "cluster"))

    labels = land(spectral.spectral_grid(points, width, s.n_clusters, s.k_neighbors), "spectral_labels")
    scores = land(silhouette.silhouette_l1(labels), "spectral_scores")
    best = land(silhouette.best_config(scores, ["fit"]), "spectral_best")
    chosen = labels.join(F.broadcast(best.select("fit")), "fit", "left_semi").select("id", "cluster")
    k = lambda df: df.withColumnRenamed("fit", "n_clusters")
    return {"density": dense, "spectral": (k(scores), k(best), chosen)}


def cluster_authors(stages: Stages, settings: ClusterSettings = ClusterSettings(), mode: str = "search") -> dict[str, DataFrame]:
    """Labels and cluster profiles of both algorithms on both matrices; load reuses saved labels.

    A grid without any usable fit leaves an empty table for its algorithm and matrix.
    """
    if mode not in ("search", "load"):
        raise ValueError("mode is 'search' or 'load'")
    whole, commit = vectors.load_matrices(stages.read("author_features"), stages.read("author_commit_features"))
    matrices = {n: land(df, f"matrix_{n}") for n, df in (("all", whole), ("commits", commit)) if n in settings.matrices}
    labels, planes = {}, {}
    for name, matrix in matrices.items():
        cols = [c for c in matrix.columns if c != "author"]
        numbers = report.number_rows(matrix, "author")
        points = land(vectors.to_points(matrix.join(numbers, "author"), "id", cols), "points")
        if mode == "search":
            for algorithm, (scores, best, found) in _search_clusters(points, len(cols), settings).items():
                named = found.join(numbers, "id").select("author", F.col("cluster").cast("bigint").alias("cluster"))
                save_model(stages, f"clusters/{algorithm}_{name}", scores=scores, best_params=best, assignments=named)
        for algorithm in ("density", "spectral"):
            labels[algorithm, name] = load_model(stages, f"clusters/{algorithm}_{name}", "assignments")["assignments"]
        planes["projection", name] = vectors.project_2d(points).join(numbers, "id").select("author", "x1", "x2")
    assigned, profiles = report.cluster_report(matrices, labels)
    return {
        "author_clusters": stages.write(assigned, "author_clusters"),
        "cluster_profiles": stages.write(profiles, "cluster_profiles"),
        "projections": stages.write(report.tagged(planes), "projections"),
    }
