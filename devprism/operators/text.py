"""Cleaned documents and their vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devprism.functions import tokens as tk
from devprism.runtime import at_most, broadcast_if_small, land

FORM_ROWS = 100_000  # a form with more tokens is split


def lemma_map(lemmas: DataFrame, rows: int = 200_000):
    """A ``(form, lemma)`` table as one map value, if it is small enough to send to every task."""
    if not at_most(lemmas, rows):
        raise ValueError(f"more than {rows} lemmas: use lemmatize_by_join")
    entries = F.collect_list(F.struct("form", "lemma"))
    return lemmas.dropDuplicates(["form"]).agg(F.map_from_entries(entries).alias("m")).scalar()


def split_forms(rows: DataFrame, lemmas: DataFrame, form_rows: int = FORM_ROWS) -> tuple[DataFrame, DataFrame]:
    """Tokens ``rows(form, ...)`` and ``lemmas(form, ...)`` with a ``part`` to join by beside the form.

    A form with more than ``form_rows`` tokens is dealt over parts of about that many, and its lemma has a row for each part,
    so that no task holds all tokens of a frequent form. How many forms are split follows from their counts, which
    are combined map-side; ``rows`` is read twice.
    """
    counts = rows.groupBy("form").agg(F.count("*").alias("n")).filter(F.col("n") > form_rows)
    crowded = land(counts.select("form", F.ceil(F.col("n") / form_rows).cast("int").alias("parts")), "crowded_forms")
    parts, split = broadcast_if_small(crowded), F.coalesce("parts", F.lit(1))
    others = [c for c in rows.columns if c != "form"]
    dealt = rows.join(parts, "form", "left").withColumn("part", F.pmod(F.xxhash64(*others), split).cast("int")).drop("parts")
    copies = lemmas.join(parts, "form", "left").withColumn("part", F.explode(F.sequence(F.lit(0), split - 1))).drop("parts")
    return dealt, copies


def lemmatize_by_join(df: DataFrame, lemmas: DataFrame, id: str = "doc_id", tokens: str = "tokens", form_rows: int = FORM_ROWS) -> DataFrame:
    """The same for a lemma table of any size: one row per token, joined, put back in order."""
    rows = land(df.select(id, tokens), "tokens").select(id, F.posexplode(tokens).alias("pos", "form"))
    dealt, copies = split_forms(rows, lemmas.select("form", "lemma").dropDuplicates(["form"]), form_rows)
    known = dealt.join(copies, ["form", "part"], "left")
    base = F.coalesce("lemma", tk.noun_base(F.col("form")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", base.alias("token"))))
    joined = known.groupBy(id).agg(F.transform(ordered, lambda x: x["token"]).alias("_new"))
    kept = df.join(joined, id, "left")
    return kept.withColumn(tokens, F.coalesce("_new", F.array().cast("array<string>"))).drop("_new")


def clean_documents(
    df: DataFrame,
    text: str = "raw_text",
    stop_words: Sequence[str] | None = None,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """Add ``tokens`` and ``clean_text`` (null for a document that nothing is left of)."""
    words = tk.english_stop_words() if stop_words is None else list(stop_words)
    if lemmas is None:
        cleaned = df.withColumn("tokens", tk.clean_tokens(F.col(text), words))
    else:
        known = df.withColumn("_lemmas", lemma_map(lemmas))
        cleaned = known.withColumn("tokens", tk.clean_tokens(F.col(text), words, F.col("_lemmas"))).drop("_lemmas")
    return cleaned.withColumn("clean_text", tk.min_tokens(F.col("tokens")))


def document_terms(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """Add ``terms``: single words and pairs of neighbors."""
    words = df.withColumn("_words", tk.terms_of(F.col(text)))
    return words.withColumn("terms", tk.ngrams(F.col("_words"))).drop("_words")


def vocabulary(docs: DataFrame, min_df: int = 10, scope: str = "documents") -> DataFrame:
    """Terms that at least ``min_df`` documents (or classes) contain, with that count as ``df``."""
    if scope == "documents":
        rows = docs.select(F.explode(F.array_distinct("terms")).alias("term"))
    elif scope == "classes":
        rows = docs.select("topic", F.explode(F.array_distinct("terms")).alias("term")).distinct()
    else:
        raise ValueError("scope is 'documents' or 'classes'")
    return rows.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
