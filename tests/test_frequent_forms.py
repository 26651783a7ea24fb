"""The lemma join deals the tokens of a frequent form over several parts."""

from pyspark.sql import functions as F

from devprism.operators import text


def test_a_frequent_form_is_split(spark):
    lemmas = spark.createDataFrame([("the", "THE"), ("rare", "RARE"), ("rare", "RARE"), (None, "none")], "form string, lemma string")
    words = [["the"] * 30 + ["rare", f"bug{i}s"] for i in range(40)] + [[], None, ["the", None]]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id int, tokens array<string>")
    rows = docs.select("doc_id", F.posexplode("tokens").alias("pos", "form"))
    dealt, copies = text.split_forms(rows, lemmas.dropDuplicates(["form"]), form_rows=100)
    n = {(r.form, r.part): r["count"] for r in dealt.groupBy("form", "part").count().collect()}
    assert sum(c for (form, _), c in n.items() if form == "the") == 1201
    assert max(n.values()) <= 200 and [part for form, part in n if form == "rare"] == [0]
    assert {r.part for r in copies.filter("form = 'the'").collect()} == set(range(13))

    found = {r.doc_id: r.tokens for r in text.lemmatize_by_join(docs, lemmas, form_rows=100).collect()}
    assert found[3] == ["THE"] * 30 + ["RARE", "bug3"] and found[40] == [] and found[41] == []
    assert len(found) == 43 and found[42] == ["THE", None]
