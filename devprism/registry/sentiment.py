"""Queries over comment sentiment and topic fitting, on the labelled documents."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devprism.operators import sentiment as ops, text as text_ops, topicfit
from devprism.registry.core import query
from devprism.registry.tables import SQL_TABLES, comment_sentiment, sql, table
from devprism.runtime import land, shared_folder, spread
from devprism.sources import stages as st

CODE = "CASE sentiment WHEN 'negative' THEN 0 WHEN 'positive' THEN 2 ELSE 1 END"


@query("polarity_codes", "P15", sql(f"SELECT comment_id, {CODE} AS label FROM comment_sentiment", "comment_sentiment"))
def polarity_codes(spark, sf_dir):
    coded = ops.encode_polarity(comment_sentiment(spark, sf_dir).withColumnRenamed("sentiment", "label"))
    return coded.select("comment_id", "label")


@query(
    "train_validation", "E3",
    """SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.2
        THEN 'validation' ELSE 'train' END AS part FROM labels""",
)
def train_validation(spark, sf_dir):
    return ops.split_train_validation(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "part")


@query("class_counts", "A14", sql("SELECT sentiment, count(*) AS n FROM comment_sentiment WHERE sentiment IS NOT NULL GROUP BY sentiment", "comment_sentiment"))
def class_counts(spark, sf_dir):
    return ops.class_counts(comment_sentiment(spark, sf_dir))


# Three runs over the conversations, each with a rule of its own instead of a model.
RULES = {
    "raw": "CASE WHEN length(text) > 300 THEN 'positive' WHEN length(text) > 150 THEN 'neutral' ELSE 'negative' END",
    "clean": "CASE WHEN turn % 2 = 0 THEN 'positive' ELSE 'neutral' END",
    "tuned": "CASE WHEN role = 'user' THEN 'negative' ELSE 'positive' END",
}


@query(
    "sentiment_distribution", "A13",
    "SELECT sentiment, "
    + ", ".join(f"count(*) FILTER (run = '{r}') AS {r}" for r in RULES)
    + " FROM ("
    + " UNION ALL ".join(f"SELECT '{r}' AS run, {rule} AS sentiment FROM conversations" for r, rule in RULES.items())
    + ") GROUP BY sentiment",
)
def sentiment_distribution(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    runs = None
    for name, rule in RULES.items():
        run = talks.select(F.lit(name).alias("run"), F.expr(rule).alias("sentiment"), F.lit(1.0).alias("sa_score"))
        runs = run if runs is None else runs.unionByName(run)
    return ops.sentiment_distribution(runs, list(RULES))


GUESS = {"by_length": "CAST(n_chars % 3 AS INTEGER)", "by_source": "CAST(length(source) - 4 AS INTEGER)"}
TARGETS = f"SELECT comment_id AS doc_id, {CODE} AS target FROM comment_sentiment WHERE sentiment IS NOT NULL"
METRICS = """SELECT {tag} CAST(count(*) FILTER (target = label) AS DOUBLE) / count(*) AS accuracy FROM {source} {group}"""


def metrics_sql(guess: str) -> str:
    """Per-class ratios from plain counts, weighted by support."""
    return f"""SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(sum(pr * support) / sum(support), 9) AS precision,
        round(sum(re * support) / sum(support), 9) AS recall, round(sum(f * support) / sum(support), 9) AS f1 FROM (
        SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM (
        SELECT class, CAST(tp AS DOUBLE) AS tp, CAST(support AS DOUBLE) AS support,
            CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS pr,
            CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS re FROM (
        SELECT class, (SELECT count(*) FROM p WHERE target = class AND label = class) AS tp,
            (SELECT count(*) FROM p WHERE target = class) AS support, (SELECT count(*) FROM p WHERE label = class) AS predicted
        FROM (SELECT DISTINCT target AS class FROM p UNION SELECT DISTINCT label FROM p))))"""


def predictions_sql(guess: str) -> str:
    return f"SELECT target, {GUESS[guess]} AS label FROM targets JOIN documents USING (doc_id)"


def predictions(spark, sf_dir, guess):
    scored = comment_sentiment(spark, sf_dir).filter("sentiment is not null")
    targets = scored.select(F.col("comment_id").alias("doc_id"), ops.polarity_code(F.col("sentiment")).alias("target"))
    return targets.join(table(spark, sf_dir, "documents"), "doc_id").select("target", F.expr(GUESS[guess]).alias("label"))


def rounded(df, places=9):
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


def with_targets(body: str, **extra: str) -> str:
    return sql(body, "comment_sentiment", targets=TARGETS, **extra)


@query("classification_metrics", "A17", with_targets(metrics_sql("by_length"), p=predictions_sql("by_length")))
def classification_metrics(spark, sf_dir):
    return rounded(ops.classification_metrics(predictions(spark, sf_dir, "by_length")))


@query(
    "model_comparison", "A18",
    with_targets(
        " UNION ALL ".join(
            f"SELECT '{g}' AS model, * FROM (WITH p AS ({predictions_sql(g)}) {metrics_sql(g)})" for g in GUESS
        )
    ),
)
def model_comparison(spark, sf_dir):
    return rounded(ops.compare_models({g: predictions(spark, sf_dir, g) for g in GUESS}))


# --- models ----------------------------------------------------------------------------------


def gold(spark, sf_dir):
    scored = comment_sentiment(spark, sf_dir).filter("sentiment is not null")
    return scored.select(
        F.col("comment_id").alias("id"), F.col("comment_body").alias("text"), ops.polarity_code(F.col("sentiment")).alias("target")
    )


def ternary(spark, sf_dir):
    parts = ops.split_train_validation(gold(spark, sf_dir), "id")
    return ops.train_sentiment(parts.filter("part = 'train'"))


def binary(spark, sf_dir):
    parts = ops.split_train_validation(gold(spark, sf_dir), "id")
    two = parts.filter("part = 'train'").withColumn("target", F.expr("cast(target = 2 as int)"))
    return ops.train_sentiment(two)


@query("scored_sentiment", "E1 E4")
def scored_sentiment(spark, sf_dir):
    comments = comment_sentiment(spark, sf_dir).drop("sentiment")
    return ops.score_sentiment(comments, ternary(spark, sf_dir)).select("comment_id", "sentiment", "sa_score")


def load_length_scorer():
    """A stand-in for a model that is loaded in the Python worker: it scores by word count."""

    def score(texts: pd.Series) -> pd.DataFrame:
        words = texts.str.count(" ") + 1
        label = words.map(lambda n: "positive" if n > 400 else "neutral" if n > 100 else "negative")
        return pd.DataFrame({"sentiment": label, "sa_score": 1.0 / words})

    return score


@query(
    "plugin_sentiment", "E1",
    """SELECT doc_id, CASE WHEN n > 400 THEN 'positive' WHEN n > 100 THEN 'neutral' ELSE 'negative' END AS sentiment,
        round(1.0::DOUBLE / n, 9) AS sa_score
        FROM (SELECT doc_id, length(text) - length(replace(text, ' ', '')) + 1 AS n FROM documents)""",
)
def plugin_sentiment(spark, sf_dir):
    return rounded(ops.score_with(table(spark, sf_dir, "documents"), load_length_scorer, "doc_id", "text"))


@query("validated_sentiment", "E5 A17")
def validated_sentiment(spark, sf_dir):
    parts = ops.split_train_validation(gold(spark, sf_dir), "id")
    model = ops.train_sentiment(parts.filter("part = 'train'"))
    return ops.validate_sentiment(model, parts.filter("part = 'validation'"))


@query(
    "attached_sentiment", "E2",
    """SELECT d.doc_id AS comment_id, lang, CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS sentiment,
        CAST(quality AS DOUBLE) AS sa_score FROM documents d JOIN labels l ON d.doc_id = l.doc_id
        UNION ALL SELECT doc_id, lang, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def attached_sentiment(spark, sf_dir):
    comments = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("comment_id"), "lang", F.lit(1).alias("reactions_plus1")
    )
    scores = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("comment_id"),
        F.expr("case when toxic = 1 then 'negative' else 'positive' end").alias("sentiment"),
        F.col("quality").cast("double").alias("sa_score"),
    )
    return ops.attach_sentiment(comments, scores).drop("reactions_plus1")


@query("sentiment_runs", "E6 A13")
def sentiment_runs(spark, sf_dir):
    raw = comment_sentiment(spark, sf_dir).drop("sentiment")
    clean = text_ops.clean_documents(raw, "comment_body").select("comment_id", F.col("clean_text").alias("comment_body"))
    models = {
        "binary": (binary(spark, sf_dir), ["negative", "positive"]),
        "ternary": (ternary(spark, sf_dir), ops.CLASSES),
    }
    runs = ops.sentiment_runs({"raw": raw, "clean": clean}, models)
    return ops.sentiment_distribution(runs, ["raw_binary", "raw_ternary", "clean_binary", "clean_ternary"])


# --- document vectors and topics -------------------------------------------------------------


def text_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text")), "doc_id")
    return land(text_ops.clean_documents(docs), "text_documents")


@query("document_vectors", "K1 S6")
def document_vectors(spark, sf_dir):
    """The four vector variants, saved and read back one variant at a time."""
    stages = st.Stages(spark, f"{shared_folder(spark)}/devprism/vectors-{uuid.uuid4().hex}")
    st.write_embeddings(stages, topicfit.four_variants(text_documents(spark, sf_dir)))
    names = ["small_clean", "small_raw", "large_clean", "large_raw"]
    read = [st.read_embeddings(stages, n).select("doc_id", F.lit(n).alias("variant"), F.size("embedding").alias("width")) for n in names]
    return reduce(DataFrame.unionByName, read)


@query(
    "saved_vectors", "S6",
    "SELECT vec_id AS doc_id, array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') AS v FROM embeddings",
)
def saved_vectors(spark, sf_dir):
    stages = st.Stages(spark, f"{shared_folder(spark)}/devprism/saved-{uuid.uuid4().hex}")
    given = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("given").alias("variant"), "embedding")
    st.write_embeddings(stages, given)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000000).cast("string"))
    return st.read_embeddings(stages, "given").select("doc_id", F.array_join(whole, ",").alias("v"))


def fitted_topics(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return topicfit.topic_fit(vectors, 64, eps=8.0, min_samples=3, min_cluster_size=5)


@query("fitted_topics", "K2")
def fitted_topics_query(spark, sf_dir):
    return fitted_topics(spark, sf_dir)


@query("hierarchical_topics", "K2")
def hierarchical_topics(spark, sf_dir):
    """Topics of the given vectors by hierarchical density on their first eight components."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return topicfit.hierarchical_topics(vectors, 64, min_cluster_size=10, min_samples=5, pca=8)


@query("topic_experiments", "K11")
def topic_experiments(spark, sf_dir):
    """All three rounds of experiments on topics that are fitted to the documents' own vectors."""
    docs = text_documents(spark, sf_dir)
    vectors = land(topicfit.four_variants(docs), "vectors")
    configs = [c for configs in topicfit.experiment_rounds().values() for c in configs]
    fits = {
        v: land(topicfit.topic_fit(vectors.filter(F.col("variant") == v), 8, eps=0.25, min_samples=5, pca=8), "fit")
        for v in sorted({c.variant for c in configs})
    }
    return topicfit.topic_experiments(docs, fits, configs)
