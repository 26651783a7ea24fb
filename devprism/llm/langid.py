"""Language identification: the family first, then one-versus-one linear SVMs within the family.

A text is a vector of hashed letter trigrams over its whole length. Both levels are sets of pairwise
linear support vector machines; closely related languages meet only each other, on a machine that was
fitted on nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devprism.llm.common import pick, text_chunks
from devprism.runtime import land

# Language families by code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi ur bn mr gu pa ne",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Margins between languages that are in memory at once.
MARGINS = 5_000_000
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    width: int = 2048
    #: About so many rows of each language are learned from, chosen by a hash of the id.
    rows_per_language: int = 800
    iterations: int = 25


@dataclass(frozen=True)
class Pair:
    """A machine that is positive for ``a`` and negative for ``b``."""

    a: str
    b: str
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class Model:
    settings: Settings
    languages: tuple[str, ...] = ()
    families: tuple[Pair, ...] = ()
    within: tuple[Pair, ...] = ()


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.int64)
    table[97:123], table[65:91] = np.arange(97, 123), np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def vectors(texts: list, width: int) -> np.ndarray:
    """Square roots of trigram counts, one row of length 1 per text; letters in either case, other signs as spaces."""
    table = _letters()
    out = np.zeros((len(texts), width), np.float32)
    for part in text_chunks(texts):
        for i in range(part.start, part.stop):
            raw = np.frombuffer((" " + (texts[i] or "") + " ").encode("utf-8", "surrogatepass"), np.uint8)
            code = table[raw]
            code = (code[:-2] * 7919 + code[1:-1] * 104729 + code[2:] * 1299709) % 1000003 % width
            out[i] = np.sqrt(np.bincount(code, minlength=width))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _fit_pair(rows: DataFrame, column: str, a: str, b: str, settings: Settings) -> Pair:
    mine = rows.filter(F.col(column).isin(a, b)).select("x", (F.col(column) == a).cast("double").alias("y"))
    fitted = LinearSVC(featuresCol="x", labelCol="y", maxIter=settings.iterations, regParam=1e-4, standardization=False).fit(mine)
    return Pair(a, b, fitted.coefficients.toArray().astype(np.float32), float(fitted.intercept))


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``docs(doc_id, text, lang)``: rows with a text and a language, about ``rows_per_language`` of each.

    Every language is learned, however rare it is.
    """
    rows = docs.filter("text is not null and lang is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return Model(settings)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, settings.rows_per_language / r["n"]))])
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)

    @F.pandas_udf("array<float>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(vectors(list(texts), settings.width)))

    sample = rows.filter(place < F.try_element_at(share, F.col("lang"))).select("lang", features("text").alias("x"))
    sample = land(sample, "language_sample").withColumn("x", array_to_vector("x"))
    family = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], FAMILY_OF.get(r["lang"], r["lang"]))])
    sample = sample.withColumn("family", family[F.col("lang")]).coalesce(2 * sample.sparkSession.sparkContext.defaultParallelism)
    languages = sorted(r["lang"] for r in sample.groupBy("lang").count().collect())
    groups: dict[str, list[str]] = {}
    for lang in languages:
        groups.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    families = [_fit_pair(sample, "family", a, b, settings) for a, b in combinations(sorted(groups), 2)]
    within = [_fit_pair(sample, "lang", a, b, settings) for group in groups.values() for a, b in combinations(group, 2)]
    return Model(settings, tuple(languages), tuple(families), tuple(within))


def _decide(x: np.ndarray, names: list[str], pairs: list[Pair]) -> tuple[np.ndarray, np.ndarray]:
    """Winner by votes (then by the sum of margins) and its smallest margin, for each row."""
    if len(names) == 1:
        return np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    margin = np.zeros((len(x), len(names), len(names)))
    for p in pairs:
        a, b = names.index(p.a), names.index(p.b)
        margin[:, a, b] = x @ p.weights + p.bias
        margin[:, b, a] = -margin[:, a, b]
    rank = (margin > 0).sum(axis=2) + np.tanh(margin.sum(axis=2)) / 4
    best = rank.argmax(axis=1)
    against = margin[np.arange(len(x)), best]
    against[np.arange(len(x)), best] = np.inf
    return best, against.min(axis=1)


def predict(texts: list, model: Model) -> tuple[list[str], list[float]]:
    said, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return said, scores
    groups: dict[str, list[str]] = {}
    for lang in model.languages:
        groups.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    names = sorted(groups)
    some = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    most = max(len(names), *map(len, groups.values()))
    step = min(500, max(1, MARGINS // most**2))
    for start in range(0, len(some), step):
        mine = some[start : start + step]
        x = vectors([texts[i] for i in mine], model.settings.width)
        family, sure = _decide(x, names, list(model.families))
        for f, name in enumerate(names):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, margin = _decide(x[rows], groups[name], [p for p in model.within if p.a in groups[name]])
                least = np.minimum(margin, sure[rows])
                for r, b, m in zip(rows, best, least):
                    said[mine[r]] = groups[name][b]
                    scores[mine[r]] = float(1 / (1 + np.exp(-2 * min(max(m, -20), 20))))
    return said, scores


def language(text: Column, model: Model) -> Column:
    """``lang_pred, score``; null texts and texts without a letter are ``und`` with score 0."""

    @F.pandas_udf("lang_pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            said, scores = predict(list(texts), model)
            yield pd.DataFrame({"lang_pred": said, "score": scores})

    return identify(text)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs(doc_id, text, lang)``.

    Learns from text and language of rows that are not held out; without any, all are ``und``. Repeated
    rows each get their row; other columns are not read.
    """
    rows = pick(docs, doc_id="bigint", text="string", lang="string")
    model = fit(rows.filter(~held_out(F.col("doc_id"))), settings)
    said = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(F.col("text"), model).alias("l"))
    return said.select("doc_id", "held_out", "l.lang_pred", "l.score")
