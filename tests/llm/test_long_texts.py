"""Very long texts with many hits: the same answers as a plain look, in time that grows with the length."""

import random
import time

from pyspark.sql import functions as F

from devprism.llm import secrets, toxicity


def plain_dense(scanner, candidate):
    marked, samples = [], scanner.samples(candidate)
    for run, width, bits in scanner.classes:
        for m in run.finditer(candidate):
            if not scanner.allowed(m[0]):
                entropies = enumerate(secrets.window_entropies(m[0], width), m.start())
                marked += [(i, i + width) for i, e in entropies if e >= bits and not any(s < i + width and i < t for s, t in samples)]
    covered = sorted({i for s, e in marked for i in range(s, e)})
    return [(s, next(e for e in range(s, covered[-1] + 2) if e not in set(covered))) for s in covered if s - 1 not in set(covered)]


def seconds(call, *args):
    start = time.process_time()
    call(*args)
    return time.process_time() - start


def test_ranges_against_all():
    draw = random.Random(3)
    for _ in range(300):
        ranges = [(s, s + draw.randint(1, 9)) for s in (draw.randrange(40) for _ in range(draw.randrange(6)))]
        held = secrets.Ranges(ranges)
        for start in range(45):
            end = start + draw.randint(1, 5)
            assert held.meet(start, end) == any(s < end and start < e for s, e in ranges)


def test_windows_beside_many_samples():
    draw, scanner = random.Random(5), secrets.Scanner(secrets.Entropy())
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for _ in range(20):
        parts = [draw.choice(["sample", "xxxx", "/", "".join(draw.choices(letters, k=30))]) for _ in range(12)]
        assert scanner.dense("".join(parts)) == plain_dense(scanner, "".join(parts))


def test_secrets_of_long_texts():
    draw, scanner = random.Random(7), secrets.Scanner(secrets.Entropy())
    key = "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32))
    for text in (f"{key}sample" * 12_000, f"password={key[:8]} {key[::-1]} " * 12_000):
        spans = scanner.spans(text)
        assert len(spans) >= 12_000
        assert seconds(scanner.spans, text) < 30


def test_toxicity_of_long_texts():
    scorer = toxicity.Scorer(toxicity.Model({"fool": 4.0}, {}))
    once = "he said it is a day, you are a fool. "
    few, many = scorer.features(once * 10), scorer.features(once * 60_000)
    assert many[1] == few[1] and many[0] > few[0]
    assert seconds(scorer.features, once * 60_000) < 20


def test_clause_starts_after_the_last_sign():
    scorer = toxicity.Scorer(toxicity.Model({"fool": 4.0}, {}))
    seen = []
    scorer.clause = lambda text: seen.append(text) or 0.0
    scorer.features("a, b fool c! fool;fool")
    assert seen == [" b fool c", " fool", "fool"]


def test_equal_texts_are_toxic_if_one_label_says_so(spark, documents):
    docs = documents([(i, f"text {i % 20}") for i in range(40)])
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(40)], "doc_id bigint, toxic int")
    for parts in (1, 3, 7):
        rows = toxicity.labelled(docs.repartition(parts), labels, 8000).collect()
        assert len(rows) == 20 and {r.toxic for r in rows} == {1}


def test_masked_long_text(spark, documents):
    text = "password=abcdef12 ok " * 20_000
    rows = documents([(1, text), (2, None), (3, ""), (4, "clean")])
    spans = secrets.secret_spans(F.col("text"))
    out = {r.doc_id: r.t for r in rows.withColumn("s", spans).select("doc_id", secrets.redacted(F.col("text"), F.col("s")).alias("t")).collect()}
    assert out == {1: "[SECRET] ok " * 20_000, 2: None, 3: "", 4: "clean"}
