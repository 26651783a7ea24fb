"""Term weights per topic, topic quality, outliers, similarity, merging and assignment."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devprism.functions.tokens import term_counts
from devprism.runtime import at_most, broadcast_if_small, land, summarised

OUTLIER = -1


def class_counts(docs: DataFrame) -> DataFrame:
    """``(topic, term, tf, docs)`` over ``docs(doc_id, topic, terms)``.

    A document's terms are counted inside its row and combined map-side, so a topic that holds
    most documents costs no more than its number of different terms.
    """
    rows = docs.select("topic", F.inline(term_counts(F.col("terms"))))
    return rows.groupBy("topic", "term").agg(F.sum("n").alias("tf"), F.count("*").alias("docs"))


def _share(tf: Column, n: Column, reduce_frequent: bool) -> Column:
    share = tf.cast("double") / n.cast("double")
    return F.sqrt(share) if reduce_frequent else share


def class_tfidf(
    docs: DataFrame,
    bm25: bool = False,
    reduce_frequent: bool = False,
    min_df: int = 10,
    scope: str = "documents",
) -> DataFrame:
    """``(topic, term, tf, idf, score)``: the share of a term in its topic times its class idf."""
    # A term has at most one row per topic, so this window group is never large. A document has
    # one topic, so adding up over topics gives the document frequency.
    per_term = Window.partitionBy("term")
    spread = {"documents": F.sum("docs").over(per_term), "classes": F.count("*").over(per_term)}
    counts = class_counts(docs).withColumns({"f": F.sum("tf").over(per_term), "df": spread[scope]})
    # The sizes and their mean read the counts again; written, the terms are counted and sorted once.
    counts = land(counts.filter(F.col("df") >= min_df), "class_counts")
    sizes = counts.groupBy("topic").agg(F.sum("tf").alias("n"))
    words_per_class = sizes.agg(F.floor(F.avg("n")).cast("double")).scalar()
    f = F.col("f").cast("double")
    if bm25:
        idf = F.ln(F.lit(1.0) + (words_per_class - f + F.lit(0.5)) / (f + F.lit(0.5)))
    else:
        idf = F.ln(F.lit(1.0) + words_per_class / f)
    weighted = counts.join(sizes, "topic").withColumn("idf", idf)
    score = _share(F.col("tf"), F.col("n"), reduce_frequent) * F.col("idf")
    return weighted.select("topic", "term", "tf", "idf", score.alias("score"))


# --- top terms and their quality -------------------------------------------------------------


def topic_top_terms(scores: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best terms of every real topic; equal scores go by the term."""
    best = Window.partitionBy("topic").orderBy(F.desc("score"), F.asc("term"))
    ranked = scores.filter(F.col("topic") > OUTLIER).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("topic", "term", "score", "rank")


def top_k_terms(top: DataFrame, k: int = 3) -> DataFrame:
    return top.filter(F.col("rank") <= k)


def clean_topics(top: DataFrame, min_terms: int = 3) -> DataFrame:
    """Drop empty terms and terms over several lines, then topics of ``min_terms`` or fewer."""
    usable = top.filter((F.col("term") != "") & ~F.contains("term", F.lit("\n")))
    sizes = usable.groupBy("topic").agg(F.count("*").alias("_n")).filter(F.col("_n") > min_terms)
    return usable.join(sizes, "topic", "left_semi")


def topic_count(top: DataFrame, min_terms: int = 3) -> DataFrame:
    return clean_topics(top, min_terms).agg(F.count_distinct("topic").alias("num_topics"))


def topic_diversity(top: DataFrame, k: int = 3) -> DataFrame:
    """Different terms among all top terms."""
    ratio = F.count_distinct("term") / F.count("term")
    return top_k_terms(top, k).agg(F.when(F.count("term") > 0, ratio).alias("td"))


# --- similarity and outliers -----------------------------------------------------------------


def topic_similarity(scores: DataFrame) -> DataFrame:
    """Cosine of every two topics that share a term, ``(a, b, cosine)`` with ``a < b``."""
    real = scores.filter(F.col("topic") > OUTLIER).select("topic", "term", "score")
    norms = real.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    left = real.select("term", F.col("topic").alias("a"), F.col("score").alias("x"))
    right = real.select("term", F.col("topic").alias("b"), F.col("score").alias("y"))
    dots = left.join(right, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    na = norms.select(F.col("topic").alias("a"), F.col("norm").alias("na"))
    nb = norms.select(F.col("topic").alias("b"), F.col("norm").alias("nb"))
    cosine = F.try_divide(F.col("dot"), F.col("na") * F.col("nb"))
    return dots.join(na, "a").join(nb, "b").select("a", "b", cosine.alias("cosine"))


def outlier_scores(docs: DataFrame, scores: DataFrame, reduce_frequent: bool = False) -> DataFrame:
    """Cosine of each outlier document to each topic it shares a term with.

    A term is one row with its weight and its score in every topic, so the documents' terms meet it in
    one join. The document's own norm is summed beside the topics, under the label of no topic.
    """
    y = F.when(F.col("topic") > OUTLIER, F.col("score"))
    terms = scores.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.when(y.isNotNull(), F.struct("topic", y.alias("y")))).alias("in_topics"))
    counts = docs.filter(F.col("topic") == OUTLIER).select("doc_id", F.inline(term_counts(F.col("terms"))))
    tf = F.col("n").cast("double")
    weight = (F.sqrt(tf) if reduce_frequent else tf) * F.col("idf")
    weighted = counts.join(terms, "term").select("doc_id", weight.alias("x"), "in_topics")
    own = F.array(F.struct(F.lit(None).cast(scores.schema["topic"].dataType).alias("topic"), F.col("x").alias("y")))
    parts = weighted.select("doc_id", "x", F.inline(F.concat(own, "in_topics")))
    dots = parts.groupBy("doc_id", "topic").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    per = dots.groupBy("doc_id").agg(F.sqrt(F.max(F.when(F.col("topic").isNull(), F.col("dot")))).alias("nd"), F.collect_list(F.when(F.col("topic").isNotNull(), F.struct("topic", "dot"))).alias("dots"))
    norms = scores.filter(F.col("topic") > OUTLIER).groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("nt"))
    cosine = F.try_divide(F.col("dot"), F.col("nd") * F.col("nt"))
    return per.select("doc_id", "nd", F.inline("dots")).join(norms, "topic").select("doc_id", "topic", cosine.alias("cosine"))


def reduce_outliers(
    docs: DataFrame, scores: DataFrame, threshold: float = 0.0, reduce_frequent: bool = False
) -> DataFrame:
    """``(doc_id, topic)`` with outliers moved to their nearest topic if it is near enough."""
    near = outlier_scores(docs, scores, reduce_frequent).filter(
        (F.col("cosine") >= threshold) & (F.col("cosine") > 0)
    )
    best = near.groupBy("doc_id").agg(
        F.max_by("topic", F.struct("cosine", -F.col("topic"))).alias("nearest")
    )
    moved = docs.select("doc_id", "topic").join(best, "doc_id", "left")
    topic = F.when(F.col("topic") == OUTLIER, F.coalesce("nearest", "topic")).otherwise(F.col("topic"))
    return moved.select("doc_id", topic.alias("topic"))


# --- merging and assignment ------------------------------------------------------------------


TREE = "merge int, a int, b int, height double, size bigint"


def _linkage(rows: pd.DataFrame) -> pd.DataFrame:
    """Merges in their order, from rows ``(a, b, value)``: cosines, and sizes where ``b`` is missing.

    A heap holds the similarities of current groups; those of merged groups are recognised by their version. A group
    is named by its smallest topic. Groups that share nothing have similarity 0, as have those with a negative one, and
    merge last, the smallest first.
    """
    alone = rows["b"].isna()
    size = {int(t): int(n) for t, n in zip(rows["a"][alone], rows["value"][alone])}
    topics_in = dict.fromkeys(size, 1)
    near: dict[int, dict[int, float]] = {t: {} for t in size}
    for a, b, cosine in zip(rows["a"][~alone], rows["b"][~alone].astype(int), rows["value"][~alone]):
        if a in near and b in near and cosine > 0:
            near[a][b] = near[b][a] = cosine
    heap = [(-s, a, b, 0, 0) for a, to in near.items() for b, s in to.items() if a < b]
    heapify(heap)
    version = dict.fromkeys(size, 0)
    merges: list[tuple[int, int, int, float, int]] = []

    def join(keep: int, gone: int, height: float) -> None:
        na, nb = topics_in[keep], topics_in.pop(gone)
        old, lost = near.pop(keep), near.pop(gone)
        mean = {o: (na * old.get(o, 0.0) + nb * lost.get(o, 0.0)) / (na + nb) for o in old.keys() | lost.keys() if o not in (keep, gone)}
        near[keep], topics_in[keep] = mean, na + nb
        size[keep] += size.pop(gone)
        version[keep] += 1
        del version[gone]
        for o, s in mean.items():
            near[o].pop(gone, None)
            near[o][keep] = s
            a, b = sorted((keep, o))
            heappush(heap, (-s, a, b, version[a], version[b]))
        merges.append((len(merges), keep, gone, height, size[keep]))

    while heap:
        s, a, b, va, vb = heappop(heap)
        if version.get(a) == va and version.get(b) == vb and near[a].get(b) == -s:
            join(a, b, -s)
    rest = sorted(size)
    for other in rest[1:]:
        join(rest[0], other, 0.0)
    return pd.DataFrame(merges, columns=["merge", "a", "b", "height", "size"])


def linkage_tree(similarity: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(merge, a, b, height, size)``: average linkage of all real topics, most similar groups first.

    ``similarity(a, b, cosine)`` holds topics that share a term, ``sizes(topic, n)`` all topics. The tree does not depend on a
    wanted number of topics; each is a cut of it. Only this topic-by-topic summary passes through one task.
    """
    alone = sizes.filter(F.col("topic") > OUTLIER).select(F.col("topic").alias("a"), F.lit(None).cast("int").alias("b"), F.col("n").cast("double").alias("value"))
    rows = similarity.select("a", F.col("b").cast("int").alias("b"), F.col("cosine").alias("value")).unionByName(alone)
    return summarised(rows, _linkage, TREE)


def cut_tree(tree: DataFrame, sizes: DataFrame, nr_topics: int) -> DataFrame:
    """``(topic, merged)`` with ``nr_topics`` labels, the outlier label included; the new ones are numbered by size."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows["merge"].isna()
        groups = {int(t): [int(t)] for t in rows["a"][known]}
        size = {int(t): int(n) for t, n in zip(rows["a"][known], rows["size"][known])}
        merges = rows[~known].sort_values("merge")
        for a, b in list(zip(merges["a"], merges["b"].astype(int)))[: max(len(groups) - max(nr_topics - 1, 1), 0)]:
            groups[int(a)] += groups.pop(int(b))
        ordered = sorted(groups.values(), key=lambda g: (-sum(size[t] for t in g), min(g)))
        return pd.DataFrame([(t, i) for i, g in enumerate(ordered) for t in g], columns=["topic", "merged"])

    alone = sizes.filter(F.col("topic") > OUTLIER).select(F.lit(None).cast("int").alias("merge"), F.col("topic").alias("a"), F.lit(None).cast("int").alias("b"), F.col("n").alias("size"))
    rows = tree.select("merge", "a", "b", "size").unionByName(alone)
    return summarised(rows, cut, "topic int, merged int")


def merge_topics(assigned: DataFrame, scores: DataFrame, nr_topics: int = 11) -> DataFrame:
    """Merge similar topics until ``nr_topics`` labels are left, the outlier label included."""
    sizes = land(assigned.groupBy("topic").agg(F.count("*").alias("n")), "topic_sizes")
    new = land(cut_tree(linkage_tree(topic_similarity(scores), sizes), sizes, nr_topics), "merged_topics")
    named = assigned.join(broadcast_if_small(new), "topic", "left")
    return named.withColumn("topic", F.coalesce("merged", F.lit(OUTLIER))).select(*assigned.columns)


def topic_centroids(vectors: DataFrame, assigned: DataFrame, width: int, id: str = "doc_id") -> DataFrame:
    """Mean vector of every real topic."""
    members = vectors.join(assigned.filter(F.col("topic") > OUTLIER).select(id, "topic"), id)
    means = [F.avg(F.col("embedding")[i].cast("double")) for i in range(width)]
    return members.groupBy("topic").agg(F.array(*means).alias("centroid"))


def assign_topics(
    vectors: DataFrame, centroids: DataFrame, id: str = "doc_id", max_topics: int = 2000, min_prob: float | None = None
) -> DataFrame:
    """``(id, topic, topic_prob)``: the centroid with the highest cosine, the lower topic on a tie.

    A document whose cosine stays below ``min_prob``, or has none, is an outlier and gets -1.
    The centroids travel as one array value (their number is checked), so no join is needed.
    """
    if not at_most(centroids, max_topics):
        raise ValueError(f"more than {max_topics} topics")
    length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
    entry = F.struct("topic", F.col("centroid").alias("c"), length.alias("n"))
    table = centroids.agg(F.collect_list(entry).alias("t")).scalar()

    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    inner = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = F.transform(
        F.col("t"),
        lambda e: F.struct(
            F.try_divide(inner(F.col("v"), e["c"]), F.col("n") * e["n"]).alias("prob"),
            (-e["topic"]).alias("minus"),
        ),
    )
    rows = vectors.select(id, F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumns({"n": norm(F.col("v")), "t": table})
    best = rows.select(id, F.array_max(scored).alias("best"))
    topic = -F.col("best.minus")
    if min_prob is not None:
        topic = F.when(F.col("best.prob") >= min_prob, topic).otherwise(F.lit(OUTLIER))
    return best.select(id, topic.alias("topic"), F.col("best.prob").alias("topic_prob"))
