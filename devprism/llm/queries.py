"""Queries ``opN_<name>`` over the whole given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devprism.llm import dialogue, jaccard, langid, leaks, metric, mixing, neardup, passages, privacy, repeats, runs, secrets, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@register
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    return langid.identify_documents(table(spark, sf_dir, "documents"))


@register
def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate passages of 50 words and more, each with its place in two documents."""
    return passages.near_passages(table(spark, sf_dir, "documents"))


@register
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 100-byte strings that start earlier too."""
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("spans")


@register
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with their place and edit distance in words."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates over 2-word shingles at 80 %."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every vector whose id is divisible by 50."""
    return metric.top_scores(table(spark, sf_dir, "embeddings"))


SQL["op6_mtree"] = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
    FROM vectors q JOIN vectors v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@register
def op7_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the fixed patterns, and all spans."""
    found = privacy.find_personal(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, privacy.KINDS), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat("base", "terms")).alias("spans"),
    )


@register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken(F.col("pieces")).alias("taken"))


SQL["op9_mixing"] = """
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][source_rank % 3 + 1] AS weight FROM per
), filled AS (
    SELECT *, sum(source_size) OVER () AS total,
        sum(weight) OVER () - coalesce(sum(weight) OVER filling, 0) AS left_weight,
        coalesce(sum(source_size) OVER filling, 0) AS stopped_size
    FROM weighed
    WINDOW filling AS (ORDER BY 2.0::DOUBLE * source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
    SELECT *, 2.0::DOUBLE * source_size * left_weight <= weight * (1.5::DOUBLE * total - 2.0::DOUBLE * stopped_size) AS stops FROM filled
), targets AS (
    SELECT source, source_size,
        CASE WHEN stops THEN 2.0::DOUBLE * source_size ELSE weight * (
            (1.5::DOUBLE * total - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (stops) OVER (), 0)) / (sum(weight) FILTER (NOT stops) OVER ())
        ) END AS target
    FROM marked
), lined AS (
    SELECT doc_id, size, source_size, target, round(target)::BIGINT AS quota,
        sum(size) OVER (
            PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), doc_id NULLS FIRST
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
        )::BIGINT - size AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
    (greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start)))::BIGINT AS taken
FROM lined
"""


@register
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the fixed patterns, and all spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secrets")).alias("spans"),
    )


@register
def op11_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by checksums of its rows, and its least repair."""
    return dialogue.repair_conversations(table(spark, sf_dir, "conversations"))


# Fixed value: the polynomial of the checksum, bits reversed.
CHECKSUM = """list_reduce(
    list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, byte: xor(crc >> 8, list_reduce(
        range(8)::BIGINT[], lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, xor(crc, byte) & 255)),
    4294967295::BIGINT)"""


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _edit(cost: str, letter: str, written: str, after: str) -> str:
    line = f"{written} || CASE WHEN {after}.repaired = '' THEN '' ELSE chr(10) || {after}.repaired END" if written else f"{after}.repaired"
    return f"{{'cost': ({cost} + {after}.cost)::BIGINT, 'audit': '{letter}' || {after}.audit, 'repaired': {line}}}"


def _before(state: int, kept: dict[str, int], added: tuple[str, int]) -> str:
    """The least edit of a row (``r``) from a state, given those behind it (``w.s0`` to ``w.s3``)."""
    must, unfinished = "r.fault IN ('blank', 'duplicate')", "CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END"
    keep = "CASE " + " ".join(
        f"WHEN NOT {must} AND r.role[1] = '{initial}' THEN {_edit(unfinished, 'K', "r.role || ':' || r.text", f'w.s{after}')}" for initial, after in kept.items()
    ) + " END"
    role, after = added
    change = f"CASE WHEN NOT {must} THEN {_edit(f'1 + {unfinished}', 'R', f"'{role}:' || r.text", f'w.s{after}')} END"
    return _least(_edit("2", "D", "", f"w.s{state}"), keep, change)


def _with_insertion(state: int, role: str, after: int) -> str:
    return _least(f"s{state}", _edit("5", "I", f"'{role}:'", f"s{after}"))


def _end(cost: int, audit: str, repaired: str) -> str:
    return f"{{'cost': {cost}::BIGINT, 'audit': '{audit}', 'repaired': {repaired}}}"


SQL["op11_viterbi"] = f"""
WITH RECURSIVE harmed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor({CHECKSUM.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}, 4294967295) % 20 AS harm
    FROM conversations
), rows_left AS (
    SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
        CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
    FROM harmed WHERE harm <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
    FROM rows_left
), said AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS said FROM placed
), faulty AS (
    SELECT conv_id, turn, role, text, before,
        row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n,
        CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN said > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
    FROM said
), walked AS (
    SELECT DISTINCT conv_id, n, 0::BIGINT AS back, {_end(0, "", "''")} AS s0,
        {_end(10, "II", "'user:' || chr(10) || 'assistant:'")} AS s1, {_end(5, "I", "'assistant:'")} AS s2, {_end(0, "", "''")} AS s3
    FROM faulty
    UNION ALL
    SELECT conv_id, n, back, {_with_insertion(0, "user", 2)}, {_with_insertion(1, "user", 2)}, s2, s3 FROM (
        SELECT conv_id, n, back, s0, s1, {_with_insertion(2, "assistant", 3)} AS s2, {_with_insertion(3, "user", 2)} AS s3 FROM (
            SELECT w.conv_id, w.n, r.back, {_before(0, {"s": 1, "u": 2}, ("user", 2))} AS s0, {_before(1, {"u": 2}, ("user", 2))} AS s1,
                {_before(2, {"a": 3}, ("assistant", 3))} AS s2, {_before(3, {"u": 2}, ("user", 2))} AS s3
            FROM walked w JOIN faulty r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.back = w.back + 1
        )
    )
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.s0.cost, 0)::BIGINT AS cost,
    coalesce(w.s0.audit, '') AS audit, sha256(coalesce(w.s0.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN walked w ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND w.back = w.n
LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@register
def op12_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, some of them looped by the checksum of their id."""
    return runs.find_runs(table(spark, sf_dir, "documents"))


# A run has at least five words that come again a period later, so equal runs of five words tell all of them.
SQL["op12_squares"] = f"""
WITH numbered AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS original,
        xor({CHECKSUM.format("doc_id::VARCHAR")}, 4294967295) AS h
    FROM documents
), aimed AS (
    SELECT *, len(original) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(original) > 0 THEN (h // 10) % len(original) END AS a FROM numbered
), ready AS (
    SELECT r, doc_id, n, CASE WHEN a IS NULL THEN original ELSE list_transform(range(n), lambda i:
        original[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS words
    FROM aimed
), listed AS (
    SELECT r, n, unnest(words) AS word, unnest(range(n)) AS i FROM ready
), grams AS (
    SELECT r, n, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w || ' ' || lead(word, 4) OVER w AS gram
    FROM listed WINDOW w AS (PARTITION BY r ORDER BY i)
), again AS (
    SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.gram = b.gram AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), stretches AS (
    SELECT r, q, min(i) AS start, count(*) + 4 + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM again) GROUP BY r, q, island
), runs AS (
    SELECT r, start, length, min(q) AS q FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length
), per AS (
    SELECT r, count(*) AS n_runs, first(start ORDER BY length DESC, start, q) AS start, max(length) AS length, first(q ORDER BY length DESC, start, q) AS period,
        string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed
    FROM runs GROUP BY r
), kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM listed l
    WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.r = l.r AND l.i >= u.start + u.q AND l.i < u.start + u.length) GROUP BY r
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
    (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM ready d LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""


@register
def op13_heavylight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree at 90 %."""
    return jaccard.linked_components(table(spark, sf_dir, "documents"))


SQL["op13_heavylight"] = """
WITH RECURSIVE worded AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), shingled AS (
    SELECT r, doc_id, list_sort(list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS shingles
    FROM worded
), classes AS (
    SELECT row_number() OVER () AS c, shingles, len(shingles) AS n FROM (SELECT DISTINCT shingles FROM shingled WHERE len(shingles) > 0)
), listed AS (
    SELECT c, n, unnest(shingles) AS shingle FROM classes
), links AS (
    SELECT a.c, b.c AS d FROM listed a JOIN listed b ON a.shingle = b.shingle AND a.c < b.c AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
    GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), sides AS (
    SELECT c, d FROM links UNION ALL SELECT d, c FROM links
), reach AS (
    SELECT c AS root, c AS node FROM classes UNION SELECT root, d FROM reach JOIN sides ON node = sides.c
), firsts AS (
    SELECT root, min(doc_id) AS component_id FROM reach JOIN classes ON node = classes.c JOIN shingled USING (shingles) GROUP BY root
)
SELECT doc_id, len(s.shingles)::BIGINT AS n_shingles, CASE WHEN len(s.shingles) = 0 THEN doc_id ELSE component_id END AS component_id
FROM shingled s LEFT JOIN classes USING (shingles) LEFT JOIN firsts ON root = c
"""
