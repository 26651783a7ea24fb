"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to symbols by a lexicon whose insults are learned from labels. Small transducers
for negation, reported speech, targets and threats are composed once into one machine that reads a
clause from left to right and weighs each hit by its context. Only clauses with a hit are read. The
sums of clause weights give the features of a logistic score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devprism.llm.common import pick
from devprism.runtime import land

# Closed word classes of the four languages.
TARGETS = "you your you're yourself they them he she du dich dir euch ihr sie tu te toi vous ils elle tú usted ustedes ti ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca ningún jamás".split()
REPORTING = "said says claimed called quoted wrote sagte nannte schrieb dit disait appelé dijo llamó escribió".split()
THREATS = "kill hurt destroy beat burn töten umbringen tuer frapper matar golpear".split()

CLAUSE_END = re.compile(r"[.!?;:,\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITGNRo"


@dataclass(frozen=True)
class Machine:
    """A weighted transducer: ``step(state, symbol) -> (next state, factor, added weight)`` from state 0."""

    arcs: dict

    def compose(self, other: Machine) -> Machine:
        """Run both on the same symbols: factors multiply, added weights add."""
        arcs, todo = {}, [(0, 0)]
        names = {(0, 0): 0}
        for pair in todo:
            for symbol in "ITGNRo":
                a, fa, wa = self.arcs[pair[0], symbol]
                b, fb, wb = other.arcs[pair[1], symbol]
                if (a, b) not in names:
                    names[a, b] = len(names)
                    todo.append((a, b))
                arcs[names[pair], symbol] = (names[a, b], fa * fb, wa + wb)
        return Machine(arcs)


def countdown(trigger: str, reach: int, on: str, near: float, far: float = 1.0) -> Machine:
    """Hits ``on`` within ``reach`` words after ``trigger`` get factor ``near``, others ``far``."""
    arcs = {}
    for state in range(reach + 1):
        for symbol in "ITGNRo":
            after = reach if symbol == trigger else max(state - 1, 0)
            factor = (near if state else far) if symbol in on else 1.0
            arcs[state, symbol] = (after, factor, 0.0)
    return Machine(arcs)


def flag(trigger: str, on: str, factor: float) -> Machine:
    """Hits ``on`` anywhere after ``trigger`` in the clause get ``factor``."""
    return Machine(
        {
            (state, symbol): (1 if symbol == trigger else state, factor if state and symbol in on else 1.0, 0.0)
            for state in (0, 1)
            for symbol in "ITGNRo"
        }
    )


def aftermath(hit: str, reach: int, trigger: str, bonus: float) -> Machine:
    """``trigger`` within ``reach`` words after a ``hit`` adds ``bonus``."""
    return Machine(
        {
            (state, symbol): (reach if symbol in hit else max(state - 1, 0), 1.0, bonus if state and symbol == trigger else 0.0)
            for state in range(reach + 1)
            for symbol in "ITGNRo"
        }
    )


def grammar() -> Machine:
    negation = countdown(NEGATION, 3, INSULT + THREAT, 0.3)
    reported = flag(REPORT, INSULT + THREAT, 0.6)
    target = countdown(TARGET, 4, INSULT, 1.5)
    threatened = countdown(TARGET, 6, THREAT, 1.0, 0.2).compose(aftermath(THREAT, 4, TARGET, 0.8))
    return negation.compose(reported).compose(target).compose(threatened).compose(aftermath(INSULT, 3, TARGET, 0.4))


@dataclass(frozen=True)
class Model:
    """Insults with weights (whole words and stems), and the logistic coefficients."""

    words: dict = field(default_factory=dict)
    stems: dict = field(default_factory=dict)
    weights: tuple = (-4.0, 0.0, 0.0, 0.0, 0.0)


class Scorer:
    """Clause weights of texts; built once per task from a model."""

    def __init__(self, model: Model):
        self.model, self.machine = model, grammar().arcs
        self.fixed = {w: s for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING), (THREAT, THREATS)) for w in ws}
        self.sizes = sorted({len(s) for s in model.stems})
        whole = [re.escape(w) for w in sorted([*model.words, *THREATS])]
        stems = [re.escape(s) for s in sorted(model.stems)]
        self.hit = re.compile(r"(?<![^\W\d_])(?:" + "|".join([rf"(?:{'|'.join(whole)})(?![^\W\d_])", *stems]) + ")")

    def weight(self, word: str) -> float:
        """Weight of an insult, 0 for other words."""
        found = self.model.words.get(word, 0.0)
        for size in self.sizes:
            found = max(found, self.model.stems.get(word[:size], 0.0))
        return found

    def clause(self, text: str) -> float:
        state, total = 0, 0.0
        for word in WORD.findall(text):
            weight = self.weight(word)
            symbol = INSULT if weight else self.fixed.get(word, OTHER)
            state, factor, added = self.machine[state, symbol]
            if symbol == INSULT:
                total += weight * factor
            elif symbol == THREAT:
                total += 2.0 * factor
            total += added
        return total

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Sum, largest and number of clause weights, and the sum against the length of the text."""
        low = (text or "").lower()
        total = most = count = 0.0
        at = 0
        while m := self.hit.search(low, at):
            # The last clause ended at ``at``, so signs before it need no second look.
            start = max(at - 1, *(low.rfind(c, at, m.start()) for c in ".!?;:,\n")) + 1
            stop = CLAUSE_END.search(low, m.end())
            at = stop.end() if stop else len(low)
            weight = self.clause(low[start : stop.start() if stop else len(low)])
            total, most, count = total + weight, max(most, weight), count + (weight > 0)
        return math.log1p(total), most, math.log1p(count), total / (10 + len(low) / 100)

    def score(self, text: str | None) -> float:
        z = self.model.weights[0] + sum(w * x for w, x in zip(self.model.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``text, toxic`` of at most ``max_rows`` labelled rows, chosen by a hash of the id.

    Ids with several labels count as toxic if one says so, as do equal texts; null labels and ids are left out.
    """
    sample = (
        pick(labels, doc_id="bigint", toxic="int").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = pick(docs, doc_id="bigint", text="string").filter("text is not null")
    return rows.join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = [Counter(), Counter()]
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            names = set()
            for word in set(WORD.findall(text.lower())):
                names.add(word)
                names.update(f"{word[:k]}*" for k in range(4, min(8, len(word))))
            seen[toxic > 0].update(names)
    names = [*(seen[0].keys() | seen[1].keys())]
    yield pd.DataFrame({"name": names, "toxic": [seen[1][n] for n in names], "clean": [seen[0][n] for n in names]})


def learn_lexicon(sample: DataFrame, bound: float = 3.0, surprise: float = 12.0, most: int = 2000) -> tuple[dict, dict]:
    """Words and stems that mark label 1: a log ratio of at least ``bound`` that is no accident.

    Counts are documents per class. ``surprise`` is the least log likelihood ratio against the share of
    label 1 in the sample. A stem counts only if it covers clearly more than any one word under it;
    longer stems under a kept one are dropped. ``most`` bounds what reaches the driver.
    """
    n = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}, {}
    toxic, clean, share = F.col("toxic"), F.col("clean"), n1 / (n1 + n0)
    both = toxic + clean
    ratio = F.log((toxic + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1))
    unlikely = toxic * F.log(toxic / (both * share)) + F.when(clean > 0, clean * F.log(clean / (both * (1 - share)))).otherwise(0.0)
    found = (
        sample.mapInPandas(_count_words, "name string, toxic long, clean long")
        .groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(toxic > 0)
        .withColumn("weight", ratio).filter((F.col("weight") >= bound) & (unlikely >= surprise))
        .orderBy(F.desc("toxic"), "name").limit(most).collect()
    )
    words = {r["name"]: r for r in found if not r["name"].endswith("*")}
    stems: dict[str, float] = {}
    for r in sorted((r for r in found if r["name"].endswith("*")), key=lambda r: len(r["name"])):
        stem = r["name"][:-1]
        most_of_one = max((w["toxic"] for name, w in words.items() if name.startswith(stem)), default=0)
        if r["toxic"] >= 1.5 * most_of_one and not any(stem.startswith(s) for s in stems):
            stems[stem] = round(r["weight"], 4)
    return {name: round(r["weight"], 4) for name, r in words.items()}, stems


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Newton steps of a ridge logistic fit; the first coefficient is the intercept and is not shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(shrink + 1e-9), x.T @ (p - y) + shrink * w)
        w = w - np.clip(step, -3, 3)
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Model:
    """Learn from at most ``max_rows`` labelled documents (whole texts); without both classes no text scores high."""
    sample = land(labelled(docs, labels, max_rows), "toxicity_sample")
    words, stems = learn_lexicon(sample)
    if not words and not stems:
        return Model()
    blank = Model(words, stems)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(blank)
        for texts in batches:
            yield texts.map(lambda t: [float(x) for x in scorer.features(t)])

    rows = sample.select(features("text").alias("x"), "toxic").collect()
    x = np.array([r["x"] for r in rows])
    return Model(words, stems, tuple(_logistic(x, np.array([float(r["toxic"] > 0) for r in rows])).tolist()))


def toxicity_score(text: Column, model: Model) -> Column:
    """Score from 0 to 1; null and empty texts get the score of a text without matched clauses."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs(doc_id, text)``.

    Learns from labelled rows that are not held out. Repeated rows each get their row; other columns are not read.
    """
    model = fit(docs, pick(labels, doc_id="bigint", toxic="int").filter(~held_out(F.col("doc_id"))), max_rows)
    rows = pick(docs, doc_id="bigint", text="string")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
