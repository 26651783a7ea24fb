"""The logical tables, bound to the given Parquet files: once for Spark, once as SQL.

The logins on the three sides are multiples of 2, 3 and 5, so that the outer joins meet authors
that are on every side, on some and on one only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = 4  # every money-like input has at most four decimal places


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    d = lambda text: F.expr(text).cast("double")
    return joined.select(
        F.expr("concat('dev', o_custkey * 2)").alias("author"),
        F.expr("l_suppkey").alias("repo"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("commit"),
        d("l_linenumber").alias("ns"),
        d("l_quantity").alias("nm"),
        d("l_partkey % 7").alias("nf"),
        d("l_discount").alias("entropy"),
        d("l_extendedprice").alias("la"),
        d("l_tax").alias("ld"),
        d("l_quantity * l_tax").alias("lt"),
        F.expr("l_returnflag = 'R'").alias("fix"),
        F.expr("l_linestatus = 'F'").alias("bug"),
        d("l_suppkey % 5").alias("ndev"),
        d("datediff(l_shipdate, o_orderdate)").alias("pd"),
        d("l_partkey % 3").alias("npt"),
        d("l_partkey").alias("exp"),
        d("l_partkey % 11").alias("rexp"),
        d("l_suppkey % 13").alias("sexp"),
    ).withColumns({"fix": F.col("fix").cast("int"), "bug": F.col("bug").cast("int")})


def issue_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("issue"),
        F.expr("concat('dev', user_id * 3)").alias("issue_user"),
        F.col("value").alias("num_comments"),
        F.expr("cast(get_json_object(props, '$.k') as int) % 11 - 1").alias("topic"),
    )


def comment_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("comment_id"),
        F.expr("concat('dev', cast(substr(source, 4) as bigint) * 5)").alias("user_login"),
        F.col("text").alias("comment_body"),
        F.expr(
            "case when toxic = 1 then 'negative' when quality = 1 and toxic = 0 then 'positive' "
            "when quality is not null then 'neutral' end"
        ).alias("sentiment"),
    )


# The same tables for the SQL side.
SQL_TABLES = {
    "commits": """
        SELECT 'dev' || (o_custkey * 2) AS author, l_suppkey AS repo,
               l_orderkey * 10 + l_linenumber AS commit,
               CAST(l_linenumber AS DOUBLE) AS ns, l_quantity AS nm,
               CAST(l_partkey % 7 AS DOUBLE) AS nf, l_discount AS entropy, l_extendedprice AS la,
               l_tax AS ld, l_quantity * l_tax AS lt,
               CAST(l_returnflag = 'R' AS INTEGER) AS fix, CAST(l_linestatus = 'F' AS INTEGER) AS bug,
               CAST(l_suppkey % 5 AS DOUBLE) AS ndev,
               CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) AS pd,
               CAST(l_partkey % 3 AS DOUBLE) AS npt, CAST(l_partkey AS DOUBLE) AS exp,
               CAST(l_partkey % 11 AS DOUBLE) AS rexp, CAST(l_suppkey % 13 AS DOUBLE) AS sexp
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "issue_topics": """
        SELECT event_id AS issue, 'dev' || (user_id * 3) AS issue_user, value AS num_comments,
               CAST(json_extract_string(props, '$.k') AS INTEGER) % 11 - 1 AS topic
        FROM events""",
    "comment_sentiment": """
        SELECT d.doc_id AS comment_id, 'dev' || (CAST(substr(source, 4) AS BIGINT) * 5) AS user_login,
               text AS comment_body,
               CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 AND toxic = 0 THEN 'positive'
                    WHEN quality IS NOT NULL THEN 'neutral' END AS sentiment
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}


def sql(body: str, *names: str, **extra: str) -> str:
    """``body`` behind WITH clauses for the named logical tables and any extra ones."""
    parts = [f"{n} AS ({SQL_TABLES[n]})" for n in names] + [f"{n} AS ({t})" for n, t in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def sql_mean(x: str) -> str:
    units = f"CAST(sum(CAST(round(({x}) * 1e{PLACES}) AS BIGINT)) AS DOUBLE)"
    return f"{units} / (1e{PLACES} * count({x}))"


def sql_sum(x: str) -> str:
    return f"CAST(coalesce(sum(CAST(round(({x}) * 1e{PLACES}) AS BIGINT)), 0) AS DOUBLE) / 1e{PLACES}"
