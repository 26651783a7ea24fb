"""Columns out of landed JSON records: commits, issues and comment pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Project folder to repository.
REPOSITORIES = {
    "ActiveMQ": "apache/activemq",
    "Ant": "apache/ant",
    "Camel": "apache/camel",
    "Derby": "apache/derby",
    "Geronimo": "apache/geronimo",
    "Hadoop": "apache/hadoop",
    "HBase": "apache/hbase",
    "IVY": "apache/ant-ivy",
    "JCR": "apache/jackrabbit",
    "JMeter": "apache/jmeter",
    "LOG4J2": "apache/logging-log4j2",
    "LUCENE": "apache/lucene",
    "Mahout": "apache/mahout",
    "OpenJPA": "apache/openjpa",
    "Pig": "apache/pig",
    "POI": "apache/poi",
    "VELOCITY": "apache/velocity-engine",
    "XERCESC": "apache/xerces-c",
}
API = "https://api.github.com/repos/"
NOT_FOUND = "NOT FOUND"
UNKNOWN_AUTHOR = "N"
REACTIONS = ["total_count", "+1", "-1", "laugh", "hooray", "confused", "heart", "rocket", "eyes"]

ISSUE_SCHEMA = (
    "comments int, title string, body string, user struct<login string>, "
    "labels array<struct<name string>>, author_association string, created_at timestamp, "
    "updated_at timestamp, closed_at timestamp, comments_url string"
)
COMMENTS_SCHEMA = (
    "array<struct<issue_url string, id bigint, created_at timestamp, updated_at timestamp, "
    "author_association string, body string, user struct<login string>, reactions struct<"
    + ", ".join(f"`{r}` int" for r in REACTIONS)
    + ">>>"
)


def qualified_id(project: Column, transaction: Column) -> Column:
    return F.concat(project, F.lit("_"), transaction.cast("string"))


def repository(project: Column) -> Column:
    """``owner/repo`` of a project folder, null if unknown. The map is a literal: no join."""
    pairs = [F.lit(x) for item in REPOSITORIES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), project)


def commit_call(repo: Column, commit: Column) -> Column:
    return F.concat(F.lit(API), repo, F.lit("/commits/"), commit)


def issue_number(name: Column) -> Column:
    """The part after the first dash, or the whole name if there is none."""
    return F.when(F.contains(name, F.lit("-")), F.split_part(name, F.lit("-"), F.lit(2))).otherwise(name)


def issue_call(repo: Column, name: Column) -> Column:
    return F.concat(F.lit(API), repo, F.lit("/issues/"), issue_number(name))


def parsed_issue(body: Column) -> Column:
    return F.from_json(body, ISSUE_SCHEMA)


def parsed_comments(body: Column) -> Column:
    return F.from_json(body, COMMENTS_SCHEMA)


def is_pull_request(body: Column) -> Column:
    """True if the key is there, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(body), "pull_request"), F.lit(False))


def comments_call(comments: Column, url: Column) -> Column:
    return F.when(F.coalesce(comments, F.lit(0)) > 0, url)


def commit_author(details: Column) -> Column:
    return F.coalesce(F.get_json_object(details, "$.author.login"), F.lit(UNKNOWN_AUTHOR))


def document_text(title: Column, body: Column, null_token: str = "nan") -> Column:
    """Title and body in one text; a missing part reads as ``null_token``."""
    return F.concat_ws(" ", F.coalesce(title, F.lit(null_token)), F.coalesce(body, F.lit(null_token)))
