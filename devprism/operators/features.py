"""One feature vector per developer from commits, scored comments and topic-labelled issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devprism.functions.numbers import mean, safe_ratio, total

# The metric names, their order in the output and the features left out.
MEAN_METRICS = [
    "ns", "nm", "nf", "entropy", "la", "ld", "lt", "ndev", "pd", "npt", "exp", "rexp", "sexp",
]
SUM_METRICS = ["ns", "nm", "nf", "la", "ld", "lt", "fix", "exp", "bug"]
COMMIT_COLUMNS = [
    "ns", "ns_sum", "nm", "nm_sum", "nf", "nf_sum", "entropy", "la", "la_sum", "ld", "ld_sum",
    "lt", "lt_sum", "fix_sum", "ndev", "pd", "npt", "exp", "exp_sum", "rexp", "sexp", "bug_sum",
    "num_commit", "num_proj",
]
REDUNDANT = ["nf", "nf_sum", "lt_sum", "nm_sum", "ns_sum", "ld_sum", "la_sum", "exp", "entropy"]
SENTIMENT_COLUMNS = [
    "avg_sentiment", "positive_ratio", "comment_count", "avg_comment_length", "sentiment_sum",
]
TOPICS = list(range(-1, 10))
COMMIT_FEATURES = [c for c in COMMIT_COLUMNS if c not in REDUNDANT]
TOPIC_COLUMNS = ["unique_topics", "avg_comments_issue", "total_issues"]
TOPIC_COLUMNS += [f"rel_freq_{t}" for t in TOPICS]


def _grouped(df: DataFrame, key: str):
    """Group without the null key, which stands for rows nobody can be credited with."""
    return df.filter(F.col(key).isNotNull()).groupBy(key)


# --- commits ---------------------------------------------------------------------------------


def _commit_means(places: int | None) -> list[Column]:
    return [mean(F.col(c), places).alias(c) for c in MEAN_METRICS]


def _commit_sums(places: int | None) -> list[Column]:
    return [total(F.col(c), places).alias(f"{c}_sum") for c in SUM_METRICS]


def author_commit_means(commits: DataFrame, key: str = "author", places: int | None = None) -> DataFrame:
    return _grouped(commits, key).agg(*_commit_means(places))


def author_commit_sums(commits: DataFrame, key: str = "author", places: int | None = None) -> DataFrame:
    """Sums of change metrics; the booleans count as 0 and 1 and a group of nulls sums to 0."""
    return _grouped(commits, key).agg(*_commit_sums(places))


def num_proj(commits: DataFrame, key: str = "author") -> DataFrame:
    return _grouped(commits, key).agg(F.count_distinct("repo").alias("num_proj"))


def num_commit(commits: DataFrame, key: str = "author") -> DataFrame:
    return _grouped(commits, key).agg(F.count("commit").alias("num_commit"))


def commit_table(commits: DataFrame, key: str = "author", places: int | None = None) -> DataFrame:
    """All 24 commit features in their fixed order.

    Sums and counts are one ``agg``, combined map-side: an author's commits that lie together leave as one row.
    Projects are counted beside them from ``(author, repo)`` alone, since a distinct count in that ``agg`` would
    send all sums once per author and repo. The two sides meet on the author, one row each. ``commits`` is read twice.
    """
    totals = _grouped(commits, key).agg(*_commit_means(places), *_commit_sums(places), F.count("commit").alias("num_commit"))
    features = totals.join(num_proj(commits, key), key)
    return order_columns(features, key)


def order_columns(features: DataFrame, key: str = "author") -> DataFrame:
    return features.select(key, *COMMIT_COLUMNS)


def drop_redundant(features: DataFrame, names: Sequence[str] = tuple(REDUNDANT)) -> DataFrame:
    return features.drop(*names)


def author_commit_features(commits: DataFrame, key: str = "author", places: int | None = None) -> DataFrame:
    """The 15 commit features that are kept per author."""
    return drop_redundant(commit_table(commits, key, places))


# --- sentiment -------------------------------------------------------------------------------


def signed(sentiment: Column) -> Column:
    """negative -1, neutral 0, positive 1; any other label is null."""
    return F.when(sentiment == "negative", -1).when(sentiment == "neutral", 0).when(sentiment == "positive", 1)


def signed_sentiment(scored: DataFrame) -> DataFrame:
    return scored.withColumn("signed", signed(F.col("sentiment")))


def unknown_sentiments(scored: DataFrame) -> DataFrame:
    """How many rows carry a label outside the three known ones."""
    return scored.agg(
        F.count_if(F.col("sentiment").isNotNull() & signed(F.col("sentiment")).isNull()).alias("unknown")
    )


def comment_length(scored: DataFrame) -> DataFrame:
    """Code points of the comment body."""
    return scored.withColumn("comment_length", F.length("comment_body").cast("bigint"))


def require_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without a null in ``cols`` (every column by default)."""
    return df.dropna("any", subset=list(cols) if cols else None)


def author_sentiment_features(scored: DataFrame, key: str = "user_login") -> DataFrame:
    """Five comment features per login. Labels and lengths are whole numbers, so sums are exact."""
    s = signed(F.col("sentiment"))
    positive, scored_count = F.count_if(s == 1), F.count(s)
    return _grouped(scored, key).agg(
        F.avg(s).alias("avg_sentiment"),
        safe_ratio(positive, scored_count).alias("positive_ratio"),
        scored_count.alias("comment_count"),
        F.avg(F.length("comment_body")).alias("avg_comment_length"),
        F.coalesce(F.sum(s), F.lit(0)).alias("sentiment_sum"),
    )


def sort_by_score(features: DataFrame, column: str = "sentiment_sum") -> DataFrame:
    """Presentation order: the highest score first, the key breaking ties."""
    return features.orderBy(F.desc(column), F.asc(features.columns[0]))


# --- topics ----------------------------------------------------------------------------------


def topic_counts(issues: DataFrame, key: str = "issue_user") -> DataFrame:
    """Issues per (user, topic)."""
    labelled = issues.filter(F.col(key).isNotNull() & F.col("topic").isNotNull())
    return labelled.groupBy(key, "topic").agg(F.count("*").alias("n"))


def topic_pivot(issues: DataFrame, key: str = "issue_user", topics: Sequence[int] = tuple(TOPICS)) -> DataFrame:
    """Issues per user and topic, one column per listed topic, 0 where there is none."""
    counts = [F.count_if(F.col("topic") == t).alias(f"topic_{t}") for t in topics]
    return _grouped(issues, key).agg(*counts)


def topic_table(
    issues: DataFrame,
    key: str = "issue_user",
    topics: Sequence[int] = tuple(TOPICS),
    places: int | None = None,
) -> DataFrame:
    """Counts, shares and the three per-user totals in one aggregation."""
    size = F.count("*")
    counts = {t: F.count_if(F.col("topic") == t) for t in topics}
    return _grouped(issues, key).agg(
        *[n.alias(f"topic_{t}") for t, n in counts.items()],
        F.count_distinct("topic").alias("unique_topics"),
        mean(F.col("num_comments"), places).alias("avg_comments_issue"),
        size.alias("total_issues"),
        *[safe_ratio(n, size).alias(f"rel_freq_{t}") for t, n in counts.items()],
    )


def drop_raw_topic_counts(features: DataFrame) -> DataFrame:
    return features.drop(*[c for c in features.columns if c.startswith("topic_")])


def author_topic_features(
    issues: DataFrame,
    key: str = "issue_user",
    topics: Sequence[int] = tuple(TOPICS),
    places: int | None = None,
) -> DataFrame:
    """The 14 topic features; the raw counts are pruned before the aggregation runs."""
    return drop_raw_topic_counts(topic_table(issues, key, topics, places))


# --- all features ----------------------------------------------------------------------------


def fill_key(df: DataFrame, key: str, other: str) -> DataFrame:
    """Take the key from the other side of an outer join where this side has none."""
    return df.withColumn(key, F.coalesce(key, other)).drop(other)


def fill_missing(df: DataFrame, value: float = 0) -> DataFrame:
    return df.fillna(value)


def merge_author_features(
    commits: DataFrame, sentiment: DataFrame, topics: DataFrame, key: str = "author"
) -> DataFrame:
    """Two full outer joins on the developer; every side has one row per key, so no key is hot."""
    s_key, t_key = sentiment.columns[0], topics.columns[0]
    merged = commits.join(sentiment, commits[key] == sentiment[s_key], "full_outer")
    merged = fill_key(merged, key, s_key)
    merged = merged.join(topics, merged[key] == topics[t_key], "full_outer")
    return fill_key(merged, key, t_key)


def author_features(
    commits: DataFrame,
    scored: DataFrame,
    issues: DataFrame,
    places: int | None = None,
) -> DataFrame:
    """author + 34 features, missing ones 0."""
    merged = merge_author_features(
        author_commit_features(commits, places=places),
        author_sentiment_features(require_all(scored)),
        author_topic_features(issues, places=places),
    )
    return fill_missing(merged)
