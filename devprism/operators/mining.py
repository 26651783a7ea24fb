"""From raw project files and landed responses to clean commit and issue tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devprism.functions import migration, records
from devprism.functions.migration import IMPORT_BOT

# Accounts that are no developers.
ISSUE_BOTS = ["dependabot[bot]", "github-actions[bot]", "Apache9"]
COMMENT_BOTS = ["Apache-HBase", "github-actions[bot]"]
COMMENT_COLUMNS = [
    "issue_url", "comment_id", "comment_created_at", "comment_updated_at", "author_association",
    "comment_body", "user_login", "reactions_total_count", "reactions_plus1", "reactions_minus1",
    "reactions_laugh", "reactions_hooray", "reactions_confused", "reactions_heart",
    "reactions_rocket", "reactions_eyes",
]
ISSUE_COLUMNS = [
    "issue_names", "num_comments", "issue_title", "issue_body", "issue_user", "issue_labels",
    "issue_author_association", "issue_created_at", "issue_updated_at", "issue_closed_at",
    "is_pull_request",
]
ISSUE_TABLE = ISSUE_COLUMNS + [c for c in COMMENT_COLUMNS if c != "issue_url"]

# --- keys and calls --------------------------------------------------------------------------


def concat_projects(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def qualify_id(df: DataFrame, project: str = "project", id: str = "transactionid") -> DataFrame:
    return df.withColumn(id, records.qualified_id(F.col(project), F.col(id)))


def map_repo(df: DataFrame, project: str = "project") -> DataFrame:
    return df.withColumn("repo", records.repository(F.col(project)))


def commit_call(df: DataFrame) -> DataFrame:
    return df.withColumn("call", records.commit_call(F.col("repo"), F.col("commit")))


def issue_call(df: DataFrame) -> DataFrame:
    return df.withColumn("issue_call", records.issue_call(F.col("repo"), F.col("issue_names")))


def rename_label(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("bug", "bug_EB")


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are only a saved row number: unnamed in the header or called Unnamed."""
    return df.select(*[f"`{c}`" for c in df.columns if not re.match(r"^(Unnamed.*|_c\d+|)$", c)])


def columns_difference(right: DataFrame, left: DataFrame) -> list[str]:
    return [c for c in right.columns if c not in left.columns]


def project_columns(df: DataFrame, keep: Sequence[str], renames: dict[str, str] | None = None) -> DataFrame:
    return df.select(*keep).withColumnsRenamed(renames or {})


# --- joins -----------------------------------------------------------------------------------


def join_labels(bug: DataFrame, bug_eb: DataFrame, key: str = "transactionid") -> DataFrame:
    """Inner join that brings only the columns the left side lacks."""
    return bug.join(bug_eb.select(key, *columns_difference(bug_eb, bug)), key, "inner")


def join_commits(ids: DataFrame, metrics: DataFrame, key: str = "transactionid") -> DataFrame:
    return distinct_rows(ids.join(metrics, key, "inner"))


def distinct_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def join_responses(df: DataFrame, responses: DataFrame, call_col: str, into: str = "details") -> DataFrame:
    """Attach the landed answer to each call; a call that failed or never ran reads NOT FOUND.

    Only good answers that hold a body reach the join. A call that landed more than once counts once:
    its last answer by ``landed_at`` if the table has that column, else the greatest body. Rows without a call stay null and take no part in the shuffle's hot null key: each gets a
    key of its own that matches nothing.
    """
    own = F.concat(F.lit("no call "), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    left = df.withColumn("_call", F.coalesce(F.col(call_col), own))
    good = responses.filter((F.col("status") == 200) & F.col("call").isNotNull() & F.col("body").isNotNull())
    order = F.struct("landed_at", "body") if "landed_at" in responses.columns else F.col("body")
    right = good.groupBy(F.col("call").alias("_call")).agg(F.max_by("body", order).alias("_body"))
    body = F.coalesce(F.col("_body"), F.lit(records.NOT_FOUND))
    joined = left.join(right, "_call", "left")
    return joined.withColumn(into, F.when(F.col(call_col).isNotNull(), body)).drop("_call", "_body")


def join_issue_comments(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """One row per issue and comment; issues without comments and comments without an issue stay.

    Written as a left join from the comments plus the issues nobody commented on: one issue may
    hold a large part of all comments, and Spark splits such a key in a left join at run time but
    not in a full outer one.
    """
    with_issue = comments.join(issues, issues["issue_call"] == comments["issue_url"], "left")
    commented = comments.select(F.col("issue_url").alias("_url")).distinct()
    silent = issues.join(commented, issues["issue_call"] == F.col("_url"), "left_anti")
    both = with_issue.unionByName(silent, allowMissingColumns=True)
    return both.select(*issues.columns, *comments.columns)


def attach_columns(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Bring computed columns to their rows by key, never by position."""
    return df.join(new.select(key, *columns_difference(new, df)), key, "left")


# --- filters ---------------------------------------------------------------------------------


def drop_not_found(df: DataFrame, col: str = "details") -> DataFrame:
    return df.filter(~F.col(col).eqNullSafe(records.NOT_FOUND))


def drop_accounts(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """Remove the rows of some accounts and keep those without any account."""
    return df.filter(~F.coalesce(F.col(col).isin(*names), F.lit(False)))


def drop_bots(df: DataFrame) -> DataFrame:
    return drop_accounts(drop_accounts(df, "issue_user", ISSUE_BOTS), "user_login", COMMENT_BOTS)


def drop_sentinel_author(df: DataFrame, sentinel: str = "Not Found") -> DataFrame:
    return df.filter(~F.col("author").eqNullSafe(sentinel))


# --- records ---------------------------------------------------------------------------------


def commit_author(df: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """The author's login out of the commit record; ``N`` where the record names none."""
    named = df.withColumn("author", records.commit_author(F.col("details")))
    return drop_sentinel_author(named, records.UNKNOWN_AUTHOR) if drop_unknown else named


def issue_fields(df: DataFrame, body: str = "issue") -> DataFrame:
    """The issue's attributes as columns. The record is parsed once per row."""
    parsed = df.withColumn("_issue", records.parsed_issue(F.col(body)))
    return parsed.withColumns(
        {
            "num_comments": F.col("_issue.comments"),
            "issue_title": F.col("_issue.title"),
            "issue_body": F.col("_issue.body"),
            "issue_user": F.col("_issue.user.login"),
            "issue_labels": F.col("_issue.labels.name"),
            "issue_author_association": F.col("_issue.author_association"),
            "issue_created_at": F.col("_issue.created_at"),
            "issue_updated_at": F.col("_issue.updated_at"),
            "issue_closed_at": F.col("_issue.closed_at"),
            "is_pull_request": records.is_pull_request(F.col(body)),
            "comments_call": records.comments_call(F.col("_issue.comments"), F.col("_issue.comments_url")),
        }
    ).drop("_issue")


def comment_arrays(df: DataFrame, body: str = "comments") -> DataFrame:
    """Four parallel arrays per comment page; empty where there is no page."""
    parsed = df.withColumn("_comments", records.parsed_comments(F.col(body)))
    fields = {
        "comments_ids": ("id", "bigint"),
        "comments_bodies": ("body", "string"),
        "comments_users": ("user.login", "string"),
        "comments_dates": ("updated_at", "timestamp"),
    }
    return parsed.withColumns(
        {
            name: F.coalesce(F.col(f"_comments.{path}"), F.array().cast(f"array<{kind}>"))
            for name, (path, kind) in fields.items()
        }
    ).drop("_comments")


def explode_comments(pages: DataFrame, body: str = "comments") -> DataFrame:
    """One row per comment from every landed page, nested fields flattened and renamed."""
    one = pages.select(F.explode(records.parsed_comments(F.col(body))).alias("c"))
    reactions = [F.col(f"c.reactions.`{r}`") for r in records.REACTIONS]
    flat = [
        F.col("c.issue_url"), F.col("c.id"), F.col("c.created_at"), F.col("c.updated_at"),
        F.col("c.author_association"), F.col("c.body"), F.col("c.user.login"), *reactions,
    ]
    return one.select(*[value.alias(name) for value, name in zip(flat, COMMENT_COLUMNS)])


def document_text(df: DataFrame, null_token: str = "nan") -> DataFrame:
    text = records.document_text(F.col("issue_title"), F.col("issue_body"), null_token)
    return df.withColumn("raw_text", text)


# --- text carried over by the import bot -----------------------------------------------------


def reattribute_issues(df: DataFrame, bot: str = IMPORT_BOT) -> DataFrame:
    """Give the bot's issues back to the author named behind the marker, and cut the text there.

    One conditional projection: the rows of other authors pass through it unchanged.
    """
    body, mine = F.col("issue_body"), F.col("issue_user").eqNullSafe(bot)
    author = migration.extract_login(migration.after_marker(body, migration.ISSUE_MARKER))
    return df.withColumns(
        {
            "issue_user": F.when(mine, author).otherwise(F.col("issue_user")),
            "issue_body": F.when(mine, migration.before_marker(body, migration.ISSUE_MARKER)).otherwise(body),
        }
    )


def reattribute_comments(df: DataFrame, keep_unmarked: bool = True, bot: str = IMPORT_BOT) -> DataFrame:
    """The same for comments: author before the marker, text with its links replaced after it.

    A comment of the bot without the marker keeps its text, or reads ``None`` if asked to.
    """
    body, mine = F.col("comment_body"), F.col("user_login").eqNullSafe(bot)
    author = migration.extract_login(migration.before_marker(body, migration.COMMENT_MARKER))
    after = migration.after_marker(body, migration.COMMENT_MARKER)
    text = F.coalesce(after, body if keep_unmarked else F.lit("None"))
    cleaned = F.when(text.isNotNull(), migration.strip_migration_link(migration.replace_links(text)))
    return df.withColumns(
        {
            "user_login": F.when(mine, F.coalesce(author, F.lit(bot))).otherwise(F.col("user_login")),
            "comment_body": F.when(mine, cleaned).otherwise(body),
        }
    )


def preprocess_issues(df: DataFrame, keep_unmarked: bool = True) -> DataFrame:
    return reattribute_comments(reattribute_issues(drop_bots(df)), keep_unmarked)
