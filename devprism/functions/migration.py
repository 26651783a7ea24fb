"""Text that an import bot carried over from another tracker: split it and find its author."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bot, its markers, the login pattern and the link patterns in their order.
IMPORT_BOT = "asfimport"
ISSUE_MARKER = "\n\n\n\n---\nMigrated from"
COMMENT_MARKER = "([migrated from JIRA]"
LOGIN_PATTERN = r"\(@[A-Za-z0-9]*\)"
LINK_PATTERNS = {
    "ATTACHMENTS": r"https://apache\.github\.io/[A-Za-z]+-jira-archive/attachments/[A-Z0-9-]+",
    "JIRA_ISSUE_COMMENT": r"https://issues\.apache\.org/jira/browse/[A-Z]+-\d+\?focusedCommentId=\d+"
    r"&page=com\.atlassian\.jira\.plugin\.system\.issuetabpanels:comment-tabpanel#comment-\d+\)\)",
    "JIRA_ISSUE": r"https://issues\.apache\.org/jira/browse/[A-Z0-9-]+",
}
COMMENT_LINK_MARKER = "([JIRA_ISSUE_COMMENT_LINK]\n\n"


def before_marker(text: Column, marker: str) -> Column:
    return F.split_part(text, F.lit(marker), F.lit(1))


def after_marker(text: Column, marker: str) -> Column:
    """The piece between the first and the second marker; null if there is no marker."""
    return F.when(F.contains(text, F.lit(marker)), F.split_part(text, F.lit(marker), F.lit(2)))


def extract_login(text: Column, pattern: str = LOGIN_PATTERN) -> Column:
    """The first login in parentheses, null if there is none; a missing text belongs to the bot."""
    found = F.regexp_replace(F.regexp_substr(text, F.lit(pattern)), "[(@)]", "")
    return F.when(text.isNull(), F.lit(IMPORT_BOT)).otherwise(found)


def replace_links(text: Column, patterns: dict[str, str] | None = None) -> Column:
    for category, pattern in (patterns or LINK_PATTERNS).items():
        text = F.regexp_replace(text, pattern, f"[{category}_LINK]")
    return text


def strip_migration_link(text: Column) -> Column:
    """Cut out the link to the migrated comment and join what stood around it."""
    after = F.coalesce(after_marker(text, COMMENT_LINK_MARKER), F.lit(""))
    return F.concat(F.coalesce(before_marker(text, COMMENT_LINK_MARKER), F.lit("")), after)
