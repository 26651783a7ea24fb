"""Small hand-made frames for the rules on nulls, text, records and undefined statistics."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from devprism.functions import migration, numbers, records, tokens as tk
from devprism.operators import correlation, features, mining, sentiment, text, topics, vectors


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


# --- null and NaN rules ----------------------------------------------------------------------


def test_bots_go_and_missing_accounts_stay(spark):
    df = spark.createDataFrame(
        [(None, "a"), ("dependabot[bot]", "a"), ("Apache9", "b"), ("dev", None), ("dev", "github-actions[bot]"), ("dev", "x")],
        "issue_user string, user_login string",
    )
    assert set(values(mining.drop_bots(df), "issue_user", "user_login")) == {(None, "a"), ("dev", None), ("dev", "x")}


def commit_rows(spark, rows):
    names = features.MEAN_METRICS
    cols = ["author string", "repo string", "commit string", "fix int", "bug int"] + [f"{c} double" for c in names]
    return spark.createDataFrame([(a, r, c, 1, 0, *[v] * len(names)) for a, r, c, v in rows], ", ".join(cols))


def test_null_author_is_no_group_and_null_sums_are_zero(spark):
    df = commit_rows(spark, [(None, "r", "1", 1.0), ("a", "r", "2", None), ("a", "s", None, None)])
    [row] = features.commit_table(df).collect()
    assert row.author == "a" and row.la is None and row.la_sum == 0.0
    assert row.fix_sum == 2.0 and row.num_proj == 2 and row.num_commit == 1


def test_nan_is_null_after_ingest(spark):
    df = numbers.nan_to_null(commit_rows(spark, [("a", "r", "1", float("nan")), ("a", "r", "2", 4.0)]), features.MEAN_METRICS)
    assert features.author_commit_means(df).first().la == 4.0


def test_fixed_point_means_do_not_depend_on_order(spark):
    data = [("a", "r", str(i), 0.1 * i + 0.0001) for i in range(320)]
    df = commit_rows(spark, data)
    runs = {features.author_commit_means(df.repartition(n), places=4).first().la for n in (1, 16)}
    assert len(runs) == 1


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 4.0)], "id int, a double, b double")
    rows = {(a, b): r for a, b, r in values(correlation.correlation_matrix(df, ["a", "b"]), "a", "b", "r")}
    assert rows[("a", "b")] is None and rows[("a", "a")] is None and rows[("b", "b")] == pytest.approx(1.0)
    assert values(vectors.standardize(df, ["a", "b"]), "a", "b") == [(0.0, -1.0), (0.0, 1.0)]


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 3.0, 1.0), (3.0, 2.0, 5.0), (4.0, None, 9.0)], "a double, b double, c double")
    got = {(a, b): r for a, b, r in values(correlation.correlation_matrix(df, ["a", "b", "c"]), "a", "b", "r")}
    expected = df.toPandas().corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(expected.loc[a, b])


def test_uncorrelated_features(spark):
    matrix = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", -0.95), ("a", "a", 1.0)], "a string, b string, r double")
    assert correlation.select_uncorrelated(matrix, ["a", "b", "c"]) == ["a", "c"]


# --- keys, records, dates --------------------------------------------------------------------


@pytest.mark.parametrize("name,number", [("LUCENE-12", "12"), ("12", "12"), ("A-1-2", "1"), (None, None)])
def test_issue_number(spark, name, number):
    assert one(spark, name, records.issue_number) == number


def test_unknown_project_has_no_call(spark):
    df = spark.createDataFrame([("Unknown", "1", "c"), ("IVY", "1", "c")], "project string, transactionid string, commit string")
    calls = values(mining.commit_call(mining.map_repo(df)), "repo", "call")
    assert calls == [(None, None), ("apache/ant-ivy", "https://api.github.com/repos/apache/ant-ivy/commits/c")]


@pytest.mark.parametrize("body,expected", [('{"pull_request":null}', True), ('{"pull_request":{}}', True), ("{}", False), ("NOT FOUND", False), (None, False)])
def test_pull_request_key(spark, body, expected):
    assert one(spark, body, records.is_pull_request) is expected


@pytest.mark.parametrize("details,author", [('{"author":{"login":"x"}}', "x"), ('{"author":null}', "N"), ("broken", "N"), (None, "N")])
def test_commit_author(spark, details, author):
    assert one(spark, details, records.commit_author) == author


def test_issue_record(spark):
    body = json.dumps({"comments": 2, "title": "t", "body": None, "user": {"login": "u"}, "labels": [{"name": "x"}, {"name": "y"}],
                       "created_at": "2024-01-02T03:04:05Z", "closed_at": None, "comments_url": "c"})
    df = spark.createDataFrame([(body,), ("NOT FOUND",), (None,)], "issue string")
    first, failed, missing = mining.issue_fields(df).collect()
    assert (first.num_comments, first.issue_title, first.issue_user, first.issue_labels) == (2, "t", "u", ["x", "y"])
    assert first.issue_created_at == datetime.datetime(2024, 1, 2, 3, 4, 5) and first.comments_call == "c"
    assert failed.issue_title is None and failed.comments_call is None and missing.is_pull_request is False


def test_comment_arrays_are_empty_without_comments(spark):
    row = mining.comment_arrays(spark.createDataFrame([(None,)], "comments string")).first()
    assert row.comments_ids == [] and row.comments_users == []


def test_responses(spark):
    df = spark.createDataFrame([(1, "u"), (2, "gone"), (3, "never"), (4, None)], "id int, call string")
    landed = spark.createDataFrame([("u", 200, "{}"), ("u", 200, "{}"), ("gone", 404, "x")], "call string, status int, body string")
    joined = mining.join_responses(df, landed, "call")
    assert sorted(values(joined, "id", "details")) == [(1, "{}"), (2, "NOT FOUND"), (3, "NOT FOUND"), (4, None)]
    assert sorted(values(mining.drop_not_found(joined), "id")) == [(1,), (4,)]


def test_outer_join_keeps_both_sides(spark):
    issues = spark.createDataFrame([("a",), ("b",)], "issue_call string")
    comments = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3)], "issue_url string, comment_id int")
    got = values(mining.join_issue_comments(issues, comments), "issue_call", "comment_id")
    assert sorted(got, key=str) == sorted([("a", 1), ("a", 2), ("b", None), (None, 3)], key=str)


def test_missing_text_parts(spark):
    df = spark.createDataFrame([("t", None), (None, "b")], "issue_title string, issue_body string")
    assert values(mining.document_text(df), "raw_text") == [("t nan",), ("nan b",)]


def test_distinct_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert mining.distinct_rows(df).count() == 2


# --- migrated text ---------------------------------------------------------------------------


def test_third_pieces_are_dropped(spark):
    df = spark.createDataFrame([("aSEPbSEPc",), ("a",), (None,)], "v string")
    both = df.select(migration.before_marker(F.col("v"), "SEP"), migration.after_marker(F.col("v"), "SEP"))
    assert [tuple(r) for r in both.collect()] == [("a", "b"), ("a", None), (None, None)]


@pytest.mark.parametrize("value,login", [("by (@ab) (@cd)", "ab"), ("(@a-b)", None), ("(@)", ""), ("none", None), (None, "asfimport")])
def test_login(spark, value, login):
    assert one(spark, value, migration.extract_login) == login


def test_links(spark):
    comment = (
        "x https://issues.apache.org/jira/browse/AB-1?focusedCommentId=5&page=com.atlassian.jira.plugin.system."
        "issuetabpanels:comment-tabpanel#comment-5)) y https://issues.apache.org/jira/browse/AB-12"
    )
    assert one(spark, comment, migration.replace_links) == "x [JIRA_ISSUE_COMMENT_LINK] y [JIRA_ISSUE_LINK]"


def test_comments_of_the_import_bot(spark):
    df = spark.createDataFrame([("asfimport", "plain"), ("dev", "plain"), (None, "p"), ("asfimport", None)], "user_login string, comment_body string")
    assert values(mining.reattribute_comments(df), "user_login", "comment_body") == [
        ("asfimport", "plain"), ("dev", "plain"), (None, "p"), ("asfimport", None)]
    assert values(mining.reattribute_comments(df, keep_unmarked=False), "comment_body") == [("None",), ("plain",), ("p",), ("None",)]


def test_issues_of_the_import_bot(spark):
    marked = "text" + migration.ISSUE_MARKER + " [A-1] by Bob (@bob)"
    hidden = "text" + migration.ISSUE_MARKER + " nobody"
    df = spark.createDataFrame([("asfimport", marked), ("asfimport", hidden), ("asfimport", "x"), ("dev", marked)], "issue_user string, issue_body string")
    assert values(mining.reattribute_issues(df), "issue_user", "issue_body") == [
        ("bob", "text"), (None, "text"), ("asfimport", "x"), ("dev", marked)]


# --- tokens ----------------------------------------------------------------------------------


def array(spark, items, fn):
    return spark.createDataFrame([(items,)], "t array<string>").select(fn(F.col("t")).alias("r")).first().r


def test_tokenize(spark):
    assert one(spark, "Été don't x² http://a.b/c?d=1 re-use, 42!", tk.tokenize) == ["été", "don't", "x²", "http://a.b/c?d=1", "re-use", ",", "42", "!"]


def test_token_filters(spark):
    assert array(spark, ["lucene-12", "lucene-x", "my-lucene-1", "amq-1"], tk.drop_ticket_ids) == ["lucene-x", "my-lucene-1"]
    assert array(spark, ["http", "https", "httpd"], tk.drop_urls) == ["http"]
    assert array(spark, ["12", "1a", "!!", "été", "x²", "it's"], tk.strip_punct_drop_digits) == ["1a", "", "été", "x²", "it's"]
    assert array(spark, ["a", "b", "a"], lambda t: tk.drop_stopwords(t, ["b"])) == ["a", "a"]
    assert array(spark, ["queries", "classes", "boxes", "benches", "dishes", "women", "bugs", "class", "status", "gas"], tk.lemmatize) == [
        "query", "class", "box", "bench", "dish", "woman", "bug", "class", "status", "gas"]
    assert array(spark, ["a", "ab", "x" * 30, "x" * 31], tk.length_filter) == ["ab", "x" * 30]


@pytest.mark.parametrize("count,kept", [(142, 142), (143, 0)])
def test_token_share_boundary(spark, count, kept):
    assert len(array(spark, [f"t{i}" for i in range(count)], tk.frequency_filter)) == kept


@pytest.mark.parametrize("size", [1, 2, 143, 286, 500, 1000, 3000])
def test_token_share_against_counting(spark, size):
    words = [f"w{(i * i) % 97}" for i in range(size)]
    expected = [w for w in words if words.count(w) / size >= 0.007]
    assert array(spark, words, tk.frequency_filter) == expected


def test_empty_document(spark):
    df = spark.createDataFrame([("",), ("the 42 of",)], "raw_text string")
    assert values(text.clean_documents(df), "clean_text") == [(None,), (None,)]


def test_ngrams(spark):
    assert array(spark, ["a", "b", "c"], tk.ngrams) == ["a", "b", "c", "a b", "b c"]
    assert array(spark, ["a"], tk.ngrams) == ["a"] and array(spark, [], tk.ngrams) == []


def test_lemma_table_both_ways(spark):
    lemmas = spark.createDataFrame([("mice", "mouse")], "form string, lemma string")
    docs = spark.createDataFrame([(1, "mice bugs mice"), (2, "")], "doc_id int, raw_text string")
    by_map = text.clean_documents(docs, stop_words=["x"], lemmas=lemmas)
    tokens = docs.withColumn("tokens", tk.tokenize(F.col("raw_text")))
    by_join = text.lemmatize_by_join(tokens, lemmas)
    assert [r.tokens for r in by_map.orderBy("doc_id").collect()] == [["mouse", "bug", "mouse"], []]
    assert [r.tokens for r in by_join.orderBy("doc_id").collect()] == [["mouse", "bug", "mouse"], []]


@pytest.mark.parametrize("fn", [tk.drop_ticket_ids, tk.drop_urls, tk.length_filter])
def test_pure_filters_are_idempotent(spark, fn):
    items = ["http://x", "lucene-1", "a", "word", "x" * 40]
    once = array(spark, items, fn)
    assert array(spark, once, fn) == once


# --- features, sentiment, topics -------------------------------------------------------------


def test_topic_shares(spark):
    df = spark.createDataFrame([("u", -1, 3.0), ("u", 2, None), ("v", -1, 1.0), (None, 1, 1.0)], "issue_user string, topic int, num_comments double")
    rows = {r.issue_user: r for r in features.author_topic_features(df).collect()}
    assert set(rows) == {"u", "v"} and rows["u"]["rel_freq_-1"] == 0.5 and rows["v"]["rel_freq_9"] == 0.0
    assert rows["u"].avg_comments_issue == 3.0 and rows["u"].unique_topics == 2
    for r in rows.values():
        assert sum(r[f"rel_freq_{t}"] for t in features.TOPICS) == pytest.approx(1.0)


def test_lengths_count_code_points(spark):
    df = spark.createDataFrame([("u", "été 😀", "positive")], "user_login string, comment_body string, sentiment string")
    row = features.author_sentiment_features(df).first()
    assert row.avg_comment_length == 5.0 and row.positive_ratio == 1.0 and row.sentiment_sum == 1


def test_merged_keys_are_the_union(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2)], "author string, x int")
    s = spark.createDataFrame([("b", 3), ("c", 4)], "user_login string, y int")
    t = spark.createDataFrame([("c", 5), ("d", 6)], "issue_user string, z int")
    merged = features.fill_missing(features.merge_author_features(c, s, t))
    assert sorted(values(merged, "author", "x", "y", "z")) == [("a", 1, 0, 0), ("b", 2, 3, 0), ("c", 0, 4, 5), ("d", 0, 0, 6)]


def test_unknown_sentiments_are_counted(spark):
    df = spark.createDataFrame([("positive",), ("odd",), (None,)], "sentiment string")
    assert features.unknown_sentiments(df).first().unknown == 1


def test_metrics_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (2, 0)], "target int, label int")
    row = sentiment.classification_metrics(df).first()
    assert row.accuracy == 0.5
    assert row.precision == pytest.approx((1 / 3 + 0 + 2 * 1.0) / 4)
    assert row.recall == pytest.approx((1 + 0 + 2 * 0.5) / 4)
    assert row.f1 == pytest.approx((0.5 + 0 + 2 * (2 / 3)) / 4)


def test_model_input_limits(spark):
    long = " ".join(["word"] * 600)
    cut = one(spark, long, sentiment.truncate_text)
    assert len(cut) == 1024 and one(spark, "a b", sentiment.truncate_text) == "a b"


def test_split_is_stable(spark):
    df = spark.range(1000)
    a = dict(values(sentiment.split_train_validation(df, "id"), "id", "part"))
    b = dict(values(sentiment.split_train_validation(df.repartition(16), "id"), "id", "part"))
    assert a == b and 120 < list(a.values()).count("validation") < 280


def plain_linkage(similarity, sizes):
    """Average linkage by looking at all pairs before every merge; the most similar pair, then the smallest."""
    groups = {t: [t] for t in sizes if t != -1}
    cosine = {frozenset(p[:2]): p[2] for p in similarity}
    link = {frozenset((a, b)): cosine.get(frozenset((a, b)), 0.0) for a in groups for b in groups if a < b}
    merges = []
    while len(groups) > 1:
        pair = max(link, key=lambda p: (link[p], [-t for t in sorted(p)]))
        keep, gone = sorted(pair)
        na, nb = len(groups[keep]), len(groups[gone])
        height = link.pop(pair)
        for o in groups:
            if o not in pair:
                link[frozenset((keep, o))] = (na * link[frozenset((keep, o))] + nb * link.pop(frozenset((gone, o)))) / (na + nb)
        groups[keep] += groups.pop(gone)
        merges.append((len(merges), keep, gone, height, sum(sizes[t] for t in groups[keep])))
    return merges


@pytest.mark.parametrize("seed,n,share", [(1, 12, 0.5), (2, 25, 0.15), (3, 25, 1.0), (4, 1, 1.0), (5, 9, 0.0)])
def test_linkage_tree(spark, seed, n, share):
    rng = random.Random(seed)
    sizes = {-1: 7, **{t * 2: rng.randrange(1, 9) for t in range(n)}}
    similarity = [(a, b, rng.choice([0.25, 0.5, 0.75, rng.random()])) for a in sizes for b in sizes if -1 < a < b and rng.random() < share]
    frames = spark.createDataFrame(similarity, "a int, b int, cosine double"), spark.createDataFrame(list(sizes.items()), "topic int, n bigint")
    tree = topics.linkage_tree(*frames)
    got, want = [tuple(r) for r in tree.orderBy("merge").collect()], plain_linkage(similarity, sizes)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    for wanted in (1, 2, 4, n + 5):
        groups = {t: [t] for t in sizes if t != -1}
        for _, a, b, *_ in want[: max(n - max(wanted - 1, 1), 0)]:
            groups[a] += groups.pop(b)
        ordered = sorted(groups.values(), key=lambda g: (-sum(sizes[t] for t in g), min(g)))
        cut = {r.topic: r.merged for r in topics.cut_tree(tree, frames[1], wanted).collect()}
        assert cut == {t: i for i, g in enumerate(ordered) for t in g}


def test_merged_topics_keep_columns_and_outliers(spark):
    docs = spark.createDataFrame([(1, 0, "x"), (2, 1, "y"), (3, 2, "z"), (4, -1, "w"), (5, 2, "v")], "doc_id int, topic int, terms string")
    scores = spark.createDataFrame([(0, "p", 1.0), (1, "p", 0.5), (2, "q", 1.0), (-1, "p", 1.0)], "topic int, term string, score double")
    got = topics.merge_topics(docs, scores, 3)
    assert got.columns == docs.columns
    assert {r.doc_id: r.topic for r in got.collect()} == {1: 0, 2: 0, 3: 1, 4: -1, 5: 1}
