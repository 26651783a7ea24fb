"""Queries over the per-developer features."""

from __future__ import annotations

from pyspark.sql import functions as F

from devprism.operators import correlation, features as ops
from devprism.registry.core import query
from devprism.registry.tables import (
    PLACES, comment_sentiment, commits, issue_topics, sql, sql_mean, sql_sum,
)
from devprism.runtime import land

MEANS = ", ".join(f"{sql_mean(c)} AS {c}" for c in ops.MEAN_METRICS)
SUMS = ", ".join(f"{sql_sum(c)} AS {c}_sum" for c in ops.SUM_METRICS)
COUNTS = "count(DISTINCT repo) AS num_proj, count(commit) AS num_commit"
COMMIT_ALL = f"SELECT author, {MEANS}, {SUMS}, {COUNTS} FROM commits WHERE author IS NOT NULL GROUP BY author"
KEPT = ", ".join(ops.COMMIT_FEATURES)
SIGN = "CASE sentiment WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 WHEN 'positive' THEN 1 END"
SCORED = (
    f"SELECT *, {SIGN} AS s FROM comment_sentiment WHERE comment_id IS NOT NULL "
    "AND user_login IS NOT NULL AND comment_body IS NOT NULL AND sentiment IS NOT NULL"
)
SENTIMENT_ALL = """SELECT user_login, CAST(sum(s) AS DOUBLE) / count(s) AS avg_sentiment,
    CAST(count(*) FILTER (s = 1) AS DOUBLE) / count(s) AS positive_ratio, count(s) AS comment_count,
    CAST(sum(length(comment_body)) AS DOUBLE) / count(*) AS avg_comment_length,
    CAST(sum(s) AS BIGINT) AS sentiment_sum FROM scored GROUP BY user_login"""
SHARES = ", ".join(
    f'CAST(count(*) FILTER (topic = {t}) AS DOUBLE) / count(*) AS "rel_freq_{t}"' for t in ops.TOPICS
)
TOTALS = f"count(DISTINCT topic) AS unique_topics, {sql_mean('num_comments')} AS avg_comments_issue, count(*) AS total_issues"
TOPIC_ALL = f"SELECT issue_user, {TOTALS}, {SHARES} FROM issue_topics WHERE issue_user IS NOT NULL GROUP BY issue_user"
QUOTED = [f'"{c}"' for c in ops.TOPIC_COLUMNS]
FILLED = ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in ops.COMMIT_FEATURES + ops.SENTIMENT_COLUMNS + QUOTED
)
AUTHOR_ALL = sql(
    f"""SELECT coalesce(author, user_login, issue_user) AS author, {FILLED}
    FROM (SELECT * FROM c FULL OUTER JOIN s ON c.author = s.user_login) cs
    FULL OUTER JOIN t ON coalesce(cs.author, cs.user_login) = t.issue_user""",
    "commits", "comment_sentiment", "issue_topics",
    scored=SCORED, c=f"SELECT author, {KEPT} FROM ({COMMIT_ALL})", s=SENTIMENT_ALL, t=TOPIC_ALL,
)


@query("author_commit_means", "A1", sql(f"SELECT author, {MEANS} FROM commits GROUP BY author", "commits"))
def author_commit_means(spark, sf_dir):
    return ops.author_commit_means(commits(spark, sf_dir), places=PLACES)


@query("author_commit_sums", "A2", sql(f"SELECT author, {SUMS} FROM commits GROUP BY author", "commits"))
def author_commit_sums(spark, sf_dir):
    return ops.author_commit_sums(commits(spark, sf_dir), places=PLACES)


@query("author_projects", "A3", sql("SELECT author, count(DISTINCT repo) AS num_proj FROM commits GROUP BY author", "commits"))
def author_projects(spark, sf_dir):
    return ops.num_proj(commits(spark, sf_dir))


@query("author_commit_counts", "A4", sql("SELECT author, count(commit) AS num_commit FROM commits GROUP BY author", "commits"))
def author_commit_counts(spark, sf_dir):
    return ops.num_commit(commits(spark, sf_dir))


@query("commit_table", "A1 A2 A3 A4 J6 P22", sql(COMMIT_ALL, "commits"))
def commit_table(spark, sf_dir):
    return ops.commit_table(commits(spark, sf_dir), places=PLACES)


@query("author_commit_features", "F6 A1 A2 A3 A4", sql(f"SELECT author, {KEPT} FROM ({COMMIT_ALL})", "commits"))
def author_commit_features(spark, sf_dir):
    return ops.author_commit_features(commits(spark, sf_dir), places=PLACES)


@query(
    "signed_sentiment", "P16 P17",
    sql(f"SELECT comment_id, {SIGN} AS signed, length(comment_body) AS comment_length FROM comment_sentiment", "comment_sentiment"),
)
def signed_sentiment(spark, sf_dir):
    scored = ops.comment_length(ops.signed_sentiment(comment_sentiment(spark, sf_dir)))
    return scored.select("comment_id", "signed", "comment_length")


@query("scored_comments", "F4", sql("SELECT comment_id, user_login, sentiment FROM scored", "comment_sentiment", scored=SCORED))
def scored_comments(spark, sf_dir):
    return ops.require_all(comment_sentiment(spark, sf_dir)).select("comment_id", "user_login", "sentiment")


@query("author_sentiment_features", "A5 A6 A7 A8 J6 P18", sql(SENTIMENT_ALL, "comment_sentiment", scored=SCORED))
def author_sentiment_features(spark, sf_dir):
    return ops.author_sentiment_features(ops.require_all(comment_sentiment(spark, sf_dir)))


@query(
    "sentiment_ranking", "W1",
    sql(f"SELECT user_login, sentiment_sum FROM ({SENTIMENT_ALL})", "comment_sentiment", scored=SCORED),
)
def sentiment_ranking(spark, sf_dir):
    scored = ops.require_all(comment_sentiment(spark, sf_dir))
    return ops.sort_by_score(ops.author_sentiment_features(scored).select("user_login", "sentiment_sum"))


@query("topic_counts", "A9", sql("SELECT issue_user, topic, count(*) AS n FROM issue_topics GROUP BY ALL", "issue_topics"))
def topic_counts(spark, sf_dir):
    return ops.topic_counts(issue_topics(spark, sf_dir))


PIVOT = ", ".join(f'count(*) FILTER (topic = {t}) AS "topic_{t}"' for t in ops.TOPICS)


@query("topic_pivot", "A10", sql(f"SELECT issue_user, {PIVOT} FROM issue_topics GROUP BY issue_user", "issue_topics"))
def topic_pivot(spark, sf_dir):
    return ops.topic_pivot(issue_topics(spark, sf_dir))


@query("author_topic_features", "A11 A12 F7 P18", sql(TOPIC_ALL, "issue_topics"))
def author_topic_features(spark, sf_dir):
    return ops.author_topic_features(issue_topics(spark, sf_dir), places=PLACES)


@query("author_features", "J5 P19 P20", AUTHOR_ALL)
def author_features(spark, sf_dir):
    return ops.author_features(
        commits(spark, sf_dir), comment_sentiment(spark, sf_dir), issue_topics(spark, sf_dir), places=PLACES
    )


def correlation_sql(source: str, cols: list[str]) -> str:
    """Unpivot, pair the features of one key, and correlate the pairs that are both present."""
    quoted = ", ".join(f'"{c}"' for c in cols)
    rank = "CASE f " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(cols)) + " END"
    casts = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in cols)
    return f"""SELECT p.f AS a, q.f AS b, round(CASE WHEN min(p.x) < max(p.x) AND min(q.x) < max(q.x)
            THEN covar_pop(p.x, q.x) / (stddev_pop(p.x) * stddev_pop(q.x)) END, 6) AS r
        FROM (SELECT *, {rank} AS o FROM (UNPIVOT (SELECT author, {casts} FROM ({source})) ON {quoted} INTO NAME f VALUE x)) p
        JOIN (SELECT *, {rank} AS o FROM (UNPIVOT (SELECT author, {casts} FROM ({source})) ON {quoted} INTO NAME f VALUE x)) q
        ON p.author = q.author AND p.o <= q.o GROUP BY 1, 2"""


def rounded_correlation(df, cols):
    return correlation.correlation_matrix(df, cols).withColumn("r", F.round("r", 6))


@query(
    "commit_correlation", "A15",
    sql(correlation_sql("SELECT * FROM m", ops.COMMIT_FEATURES), "commits", m=f"SELECT author, {KEPT} FROM ({COMMIT_ALL})"),
)
def commit_correlation(spark, sf_dir):
    return rounded_correlation(author_commit_features(spark, sf_dir), ops.COMMIT_FEATURES)


ALL_FEATURES = ops.COMMIT_FEATURES + ops.SENTIMENT_COLUMNS + ops.TOPIC_COLUMNS


@query("feature_correlation", "A15", sql(correlation_sql("SELECT * FROM m", ALL_FEATURES), m=AUTHOR_ALL))
def feature_correlation(spark, sf_dir):
    return rounded_correlation(author_features(spark, sf_dir), ALL_FEATURES)


@query("uncorrelated_features", "F8")
def uncorrelated_features(spark, sf_dir):
    features = land(author_features(spark, sf_dir), "features")
    matrix = correlation.correlation_matrix(features, ALL_FEATURES)
    kept = correlation.select_uncorrelated(matrix, ALL_FEATURES)
    return features.select("author", *kept)
