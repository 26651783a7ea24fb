import re

import pytest


@pytest.fixture(scope="session")
def words():
    def split(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    return split


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents, with an extra column whose name clashes with results."""

    def build(rows, parts=3):
        kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, Score string, size string"
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, "x", "y") for r in rows]
        return spark.createDataFrame(full, kinds).repartition(parts)

    return build
