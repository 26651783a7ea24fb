"""Queries over text cleaning, vocabulary and topic measures, on the given documents."""

from __future__ import annotations

import zipfile
from functools import lru_cache
from pathlib import Path

import pyspark
from pyspark import SparkContext
from pyspark.sql import functions as F

from devprism.functions import tokens as tk
from devprism.operators import coherence, text as text_ops, topics as ops
from devprism.registry.core import query
from devprism.registry.tables import sql, table
from devprism.runtime import land, spread


@lru_cache
def stop_words() -> list[str]:
    """The stop words for the SQL side, also where no session runs yet."""
    if SparkContext._active_spark_context is not None:
        return tk.english_stop_words()
    jar = next(Path(pyspark.__file__).parent.glob("jars/spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as archive:
        return archive.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split("\n")


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")


# --- the cleaning steps ----------------------------------------------------------------------


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_base(t: str) -> str:
    """The noun rules as one CASE."""
    kept = " OR ".join(f"ends_with({t}, '{e}')" for e in tk.NO_PLURALS)
    rules = " ".join(
        f"WHEN ends_with({t}, '{e}') THEN substr({t}, 1, length({t}) - {len(e)}) || '{s}'" for e, s in tk.PLURALS
    )
    return f"CASE WHEN length({t}) <= 3 OR {kept} THEN {t} {rules} ELSE {t} END"


def sql_steps() -> dict[str, str]:
    """Each cleaning step as a table ``(doc_id, lang, t)`` over the one before."""
    words = ", ".join(quoted(w) for w in stop_words() if w)
    step = lambda expr, source: f"SELECT doc_id, lang, {expr} AS t FROM {source}"
    return {
        "tokenized": step(f"regexp_extract_all(lower(text), {quoted(tk.TOKEN_PATTERN)})", "documents"),
        "untagged": step(f"list_filter(t, lambda x: NOT regexp_matches(x, {quoted(tk.TICKET_PATTERN)}))", "tokenized"),
        "linkless": step(f"list_filter(t, lambda x: NOT regexp_matches(x, {quoted(tk.LINK_PATTERN)}))", "untagged"),
        "worded": step(
            f"""list_transform(list_filter(t, lambda x: NOT regexp_matches(x, '^\\p{{Nd}}+$')),
            lambda x: regexp_replace(x, {quoted(tk.PUNCTUATION_PATTERN)}, '', 'g'))""",
            "linkless",
        ),
        "stopped": step(f"list_filter(t, lambda x: x NOT IN ({words}))", "worded"),
        "based": step(f"list_transform(t, lambda x: {sql_base('x')})", "stopped"),
        "sized": step("list_filter(t, lambda x: length(x) BETWEEN 2 AND 30)", "based"),
        "placed": """SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM sized""",
        "frequent": """SELECT doc_id, list(tok ORDER BY pos) AS f FROM (SELECT *,
            count(*) OVER (PARTITION BY doc_id, tok) AS c, count(*) OVER (PARTITION BY doc_id) AS n FROM placed)
            WHERE CAST(c AS DOUBLE) / n >= 0.007 GROUP BY doc_id""",
        "cleaned": """SELECT d.doc_id, d.lang, coalesce(f, []) AS t FROM documents d LEFT JOIN frequent USING (doc_id)""",
    }


def step_sql(name: str, body: str | None = None):
    def build() -> str:
        steps = sql_steps()
        needed = {}
        for key, value in steps.items():
            needed[key] = value
            if key == name:
                break
        return sql(body or f"SELECT doc_id, array_to_string(t, ' ') AS tokens FROM {name}", **needed)

    return build


def joined(df, column):
    return df.select("doc_id", F.array_join(column, " ").alias("tokens"))


@query("tokens", "T7", step_sql("tokenized"))
def tokens(spark, sf_dir):
    return joined(documents(spark, sf_dir), tk.tokenize(F.col("text")))


@query("tokens_without_tickets", "T8", step_sql("untagged"))
def tokens_without_tickets(spark, sf_dir):
    return joined(documents(spark, sf_dir), tk.drop_ticket_ids(tk.tokenize(F.col("text"))))


def linkless():
    return tk.drop_urls(tk.drop_ticket_ids(tk.tokenize(F.col("text"))))


@query("tokens_without_links", "T9", step_sql("linkless"))
def tokens_without_links(spark, sf_dir):
    return joined(documents(spark, sf_dir), linkless())


def worded():
    return tk.strip_punct_drop_digits(linkless())


@query("words_only", "T10", step_sql("worded"))
def words_only(spark, sf_dir):
    return joined(documents(spark, sf_dir), worded())


@query("without_stop_words", "T11", step_sql("stopped"))
def without_stop_words(spark, sf_dir):
    return joined(documents(spark, sf_dir), tk.drop_stopwords(worded(), tk.english_stop_words()))


@query("base_forms", "T12", step_sql("based"))
def base_forms(spark, sf_dir):
    return joined(documents(spark, sf_dir), tk.lemmatize(tk.drop_stopwords(worded(), tk.english_stop_words())))


def lemma_table(spark, sf_dir):
    """A lemma table out of the data: all words of part names and documents, each with its first four letters."""
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("form"))
    regions = table(spark, sf_dir, "documents").select(F.explode(tk.tokenize(F.col("text"))).alias("form"))
    forms = names.union(regions).filter(F.length("form") > 4).distinct()
    return forms.select("form", F.substr("form", F.lit(1), F.lit(4)).alias("lemma"))


@query(
    "base_forms_by_table", "T12",
    step_sql(
        "stopped",
        f"""SELECT doc_id, coalesce(array_to_string(list(coalesce(lemma, {sql_base('form')}) ORDER BY pos), ' '), '') AS tokens
        FROM (SELECT doc_id FROM documents) LEFT JOIN
        (SELECT doc_id, unnest(t) AS form, generate_subscripts(t, 1) AS pos FROM stopped) USING (doc_id)
        LEFT JOIN (SELECT DISTINCT form, substr(form, 1, 4) AS lemma FROM (
            SELECT unnest(string_split(p_name, ' ')) AS form FROM part
            UNION ALL SELECT unnest(t) FROM tokenized) WHERE length(form) > 4) USING (form)
        GROUP BY doc_id""",
    ),
)
def base_forms_by_table(spark, sf_dir):
    stopped = documents(spark, sf_dir).withColumn("tokens", tk.drop_stopwords(worded(), tk.english_stop_words()))
    return joined(text_ops.lemmatize_by_join(stopped, lemma_table(spark, sf_dir)), "tokens")


@query("sized_tokens", "T13", step_sql("sized"))
def sized_tokens(spark, sf_dir):
    based = tk.lemmatize(tk.drop_stopwords(worded(), tk.english_stop_words()))
    return joined(documents(spark, sf_dir), tk.length_filter(based))


def cleaned(spark, sf_dir):
    return text_ops.clean_documents(documents(spark, sf_dir), "text")


@query("frequent_tokens", "T14", step_sql("cleaned"))
def frequent_tokens(spark, sf_dir):
    return joined(cleaned(spark, sf_dir), "tokens")


@query(
    "clean_documents", "T15 T16",
    step_sql("cleaned", "SELECT doc_id, CASE WHEN len(t) > 0 THEN array_to_string(t, ' ') END AS clean_text FROM cleaned"),
)
def clean_documents(spark, sf_dir):
    return cleaned(spark, sf_dir).select("doc_id", "clean_text")


# --- vocabulary ------------------------------------------------------------------------------

TOPIC = "CASE WHEN quality IS NULL THEN -1 ELSE CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END END"
TERMS = {
    "words": f"""SELECT doc_id, {TOPIC} AS topic, regexp_extract_all(lower(text), '[{tk.WORD}]{{2,}}') AS w
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "places": "SELECT doc_id, topic, unnest(w) AS a, generate_subscripts(w, 1) AS pos FROM words",
    "terms": """SELECT doc_id, topic, a AS term, pos FROM places UNION ALL
        SELECT doc_id, topic, a || ' ' || b, pos FROM (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM places)
        WHERE b IS NOT NULL""",
    "vocab": "SELECT term, count(DISTINCT doc_id) AS df FROM terms GROUP BY term HAVING count(DISTINCT doc_id) >= 10",
    "counts": "SELECT topic, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM vocab) GROUP BY ALL",
    "sizes": "SELECT topic, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY topic",
    "weighted": """SELECT topic, term, tf, n, CAST(sum(tf) OVER (PARTITION BY term) AS DOUBLE) AS f,
        (SELECT floor(avg(n)) FROM sizes) AS a FROM counts JOIN sizes USING (topic)""",
    "scores": "SELECT topic, term, tf, ln(1.0::DOUBLE + a / f) AS idf, CAST(tf AS DOUBLE) / n * ln(1.0::DOUBLE + a / f) AS score FROM weighted",
    "top10": """SELECT topic, term, score, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS INTEGER) AS rank
        FROM scores WHERE topic >= 0 QUALIFY rank <= 10""",
    "top3": "SELECT * FROM top10 WHERE rank <= 3",
}


def topic_docs(spark, sf_dir):
    """Documents with a topic by language; those without a label are outliers."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = documents(spark, sf_dir).join(labels, "doc_id", "left").withColumn("topic", F.expr(TOPIC))
    return text_ops.document_terms(docs, "text").select("doc_id", "topic", "terms")


def corpus(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tk.terms_of(F.col("text")).alias("tokens"))


@query("document_ngrams", "T17", sql("SELECT term, count(*) AS n FROM terms GROUP BY term", **TERMS))
def document_ngrams(spark, sf_dir):
    terms = topic_docs(spark, sf_dir).select(F.explode("terms").alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


@query("vocabulary", "T17", sql("SELECT * FROM vocab", **TERMS))
def vocabulary(spark, sf_dir):
    return text_ops.vocabulary(topic_docs(spark, sf_dir))


def class_scores(spark, sf_dir, **options):
    return ops.class_tfidf(topic_docs(spark, sf_dir), **options)


def rounded(df, places=8):
    floats = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places) for c in floats})


@query("class_tfidf", "K3", sql("SELECT topic, term, tf, round(idf, 8) AS idf, round(score, 8) AS score FROM scores", **TERMS))
def class_tfidf(spark, sf_dir):
    return rounded(class_scores(spark, sf_dir))


@query(
    "class_tfidf_bm25", "K3",
    sql(
        """SELECT topic, term, tf, round(i, 8) AS idf, round(sqrt(CAST(tf AS DOUBLE) / n) * i, 8) AS score
        FROM (SELECT *, ln(1.0::DOUBLE + (a - f + 0.5) / (f + 0.5)) AS i FROM weighted)""",
        **TERMS,
    ),
)
def class_tfidf_bm25(spark, sf_dir):
    return rounded(class_scores(spark, sf_dir, bm25=True, reduce_frequent=True))


def top_terms(spark, sf_dir):
    return ops.topic_top_terms(class_scores(spark, sf_dir))


@query("topic_top_terms", "W2", sql("SELECT topic, term, round(score, 8) AS score, rank FROM top10", **TERMS))
def topic_top_terms(spark, sf_dir):
    return rounded(top_terms(spark, sf_dir))


@query("top_three_terms", "W4", sql("SELECT topic, term, rank FROM top3", **TERMS))
def top_three_terms(spark, sf_dir):
    return ops.top_k_terms(top_terms(spark, sf_dir)).select("topic", "term", "rank")


def rough_topics(spark, sf_dir):
    """Top terms as they may come: one emptied, one over two lines, one topic cut to three terms."""
    term = F.expr("case when topic = 0 and rank = 1 then '' when topic = 1 and rank = 2 then concat(term, '\n', 'x') else term end")
    return top_terms(spark, sf_dir).withColumn("term", term).filter("topic <> 2 or rank <= 3")


ROUGH = """SELECT topic, term, rank FROM top10 WHERE NOT (topic = 0 AND rank = 1) AND NOT (topic = 1 AND rank = 2) AND topic <> 2"""


@query("clean_topics", "K12", sql(ROUGH, **TERMS))
def clean_topics(spark, sf_dir):
    return ops.clean_topics(rough_topics(spark, sf_dir)).select("topic", "term", "rank")


@query("topic_count", "A19", sql(f"SELECT count(DISTINCT topic) AS num_topics FROM ({ROUGH})", **TERMS))
def topic_count(spark, sf_dir):
    return ops.topic_count(rough_topics(spark, sf_dir))


@query("topic_diversity", "K8", sql("SELECT CAST(count(DISTINCT term) AS DOUBLE) / count(*) AS td FROM top3", **TERMS))
def topic_diversity(spark, sf_dir):
    return ops.topic_diversity(top_terms(spark, sf_dir))


@query(
    "topic_similarity", "K7",
    sql(
        """SELECT p.topic AS a, q.topic AS b, round(sum(p.score * q.score) / (any_value(p.norm) * any_value(q.norm)), 6) AS cosine
        FROM normed p JOIN normed q ON p.term = q.term AND p.topic < q.topic GROUP BY 1, 2""",
        **TERMS,
        normed="SELECT *, sqrt(sum(score * score) OVER (PARTITION BY topic)) AS norm FROM scores WHERE topic >= 0",
    ),
)
def topic_similarity(spark, sf_dir):
    return rounded(ops.topic_similarity(land(class_scores(spark, sf_dir), "scores")), 6)


@query(
    "reduced_outliers", "K4",
    sql(
        """SELECT DISTINCT w.doc_id, CASE WHEN w.topic = -1 THEN coalesce(best.topic, -1) ELSE w.topic END AS topic
        FROM words w LEFT JOIN best USING (doc_id)""",
        **TERMS,
        idf="SELECT DISTINCT term, idf FROM scores",
        outlying="SELECT doc_id, term, count(*) * any_value(idf) AS x FROM terms JOIN idf USING (term) WHERE topic = -1 GROUP BY ALL",
        lengths="SELECT doc_id, sqrt(sum(x * x)) AS nd FROM outlying GROUP BY doc_id",
        classes="SELECT topic, sqrt(sum(score * score)) AS nt FROM scores WHERE topic >= 0 GROUP BY topic",
        cosines="""SELECT doc_id, s.topic, sum(x * score) / (any_value(nd) * any_value(nt)) AS cosine
            FROM outlying JOIN scores s USING (term) JOIN lengths USING (doc_id) JOIN classes c ON c.topic = s.topic
            GROUP BY 1, 2""",
        best="""SELECT doc_id, topic FROM cosines WHERE cosine >= 0.1
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, topic) = 1""",
    ),
)
def reduced_outliers(spark, sf_dir):
    docs = topic_docs(spark, sf_dir)
    return ops.reduce_outliers(docs, land(ops.class_tfidf(docs), "scores"), threshold=0.1)


def coherence_sql(window: int | None, body: str) -> str:
    """Brute force: every window of every document as rows of the top terms in it."""
    last = f"greatest(len(w) - {window}, 0)" if window else "0"
    low = f"greatest(pos - 1 - {window - 1}, 0)" if window else "0"
    return sql(
        body,
        **TERMS,
        windows=f"SELECT CAST(sum({last} + 1) AS DOUBLE) AS total FROM words",
        spots=f"""SELECT t.doc_id, term, unnest(range({low}, least(pos - 1, {last}) + 1)) AS start
            FROM terms t JOIN words USING (doc_id) WHERE term IN (SELECT term FROM top3)""",
        seen="SELECT DISTINCT doc_id, start, term FROM spots",
        single="SELECT term, CAST(count(*) AS DOUBLE) AS n FROM seen GROUP BY term",
        pairs="""SELECT p.topic, p.rank AS i, q.rank AS j, p.term AS a, q.term AS b FROM top3 p JOIN top3 q
            ON p.topic = q.topic""",
        met="""SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT DISTINCT a, b FROM pairs) JOIN seen x ON x.term = a
            JOIN seen y ON y.term = b AND x.doc_id = y.doc_id AND x.start = y.start GROUP BY 1, 2""",
        measured="""SELECT topic, i, j, coalesce(met.n, 0) / total AS p, x.n / total AS pa, y.n / total AS pb FROM pairs
            JOIN single x ON x.term = pairs.a JOIN single y ON y.term = pairs.b LEFT JOIN met USING (a, b), windows""",
        npmi="""SELECT topic, i, j, CASE WHEN p >= 1 THEN 1.0::DOUBLE
            ELSE ln((p + 1e-12) / (pa * pb)) / -ln(p + 1e-12) END AS v FROM measured""",
    )


NPMI_BODY = "SELECT topic, round(avg(v), 6) AS npmi FROM npmi WHERE i < j GROUP BY topic"


@query("npmi_coherence", "K9", coherence_sql(10, NPMI_BODY))
def npmi_coherence(spark, sf_dir):
    top = land(top_terms(spark, sf_dir), "top_terms")
    return rounded(coherence.npmi_coherence(corpus(spark, sf_dir), top), 6)


@query("npmi_by_document", "K9", coherence_sql(None, NPMI_BODY))
def npmi_by_document(spark, sf_dir):
    top = land(top_terms(spark, sf_dir), "top_terms")
    return rounded(coherence.npmi_coherence(corpus(spark, sf_dir), top, window=None), 6)


@query(
    "cv_coherence", "K10",
    coherence_sql(
        110,
        """SELECT topic, round(avg(cosine), 6) AS cv FROM (
            SELECT n.topic, n.i, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS cosine
            FROM npmi n JOIN (SELECT topic, j, sum(v) AS s FROM npmi GROUP BY topic, j) t USING (topic, j)
            GROUP BY n.topic, n.i) GROUP BY topic""",
    ),
)
def cv_coherence(spark, sf_dir):
    top = land(top_terms(spark, sf_dir), "top_terms")
    return rounded(coherence.cv_coherence(corpus(spark, sf_dir), top), 6)


# --- vectors ---------------------------------------------------------------------------------

WIDTH = 64


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("topic"))


def centroid_table(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return ops.topic_centroids(rows.drop("topic"), rows.select("doc_id", "topic"), WIDTH)


@query(
    "topic_assignment", "K6",
    """WITH long AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
        cents AS (SELECT label AS topic, d, avg(x) AS c FROM long GROUP BY ALL),
        cos AS (SELECT vec_id, topic, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS p FROM long JOIN cents USING (d) GROUP BY ALL)
        SELECT vec_id AS doc_id, topic, round(p, 6) AS topic_prob FROM cos
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, topic) = 1""",
)
def topic_assignment(spark, sf_dir):
    assigned = ops.assign_topics(vectors(spark, sf_dir).drop("topic"), centroid_table(spark, sf_dir))
    return rounded(assigned, 6)


@query("merged_topics", "K5")
def merged_topics(spark, sf_dir):
    docs = topic_docs(spark, sf_dir)
    return ops.merge_topics(docs.select("doc_id", "topic"), land(ops.class_tfidf(docs), "scores"), nr_topics=3)


@query("topic_tree", "K5")
def topic_tree(spark, sf_dir):
    """The order in which all topics merge by average linkage."""
    docs = topic_docs(spark, sf_dir)
    sizes = docs.groupBy("topic").agg(F.count("*").alias("n"))
    return ops.linkage_tree(ops.topic_similarity(ops.class_tfidf(docs)), sizes)
