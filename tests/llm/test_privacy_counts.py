"""Disclosure where a contact stands in every document, and against counts made by hand."""

from math import log

import pytest
from pyspark.sql import functions as F

from devprism.llm import privacy


def test_contact_in_every_document_discloses_nothing(documents):
    rows = [(i, f"Write to desk@example.org about parcel {'abcde'[i]} today.") for i in range(5)]
    found = privacy.find_personal(documents(rows)).collect()
    assert len(found) == 5 and all(len(r.base) == 1 and r.terms == [] for r in found)


def test_disclosure_by_hand(spark, documents):
    rows = [(i, f"Ask Quillfeather at q@example.org now{' ' * i}.") for i in range(4)] + [(10 + i, f"plain words number {i}") for i in range(6)]
    docs = documents(rows).select("text", F.monotonically_increasing_id().alias("rid"))
    mail = F.struct(F.lit("email").alias("kind"), F.expr("instr(text, 'q@')") - 1, F.expr("instr(text, 'q@') + 12"), F.lit("q@example.org").alias("value"))
    base = F.array(mail).cast("array<struct<kind:string,start:int,end:int,value:string>>")
    found = docs.filter("text like '%q@%'").withColumn("base", base)
    settings = privacy.Settings(support=1, generalise=0.0)
    got = {r.term: r.disclosure for r in privacy.disclosing_terms(found, docs, settings).collect()}
    assert got["quillfeather"] == pytest.approx(log(10 * 4 / (4 * 4)) / log(10 / 4))
