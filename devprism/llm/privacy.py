"""Personal data: fixed patterns, and terms that reveal the entities which the patterns find.

Terms near an entity are held against the whole corpus. With ``N`` documents, ``n(e)`` of them with
the entity, ``n(t)`` with the term and ``n(e, t)`` with the term beside the entity, the disclosure is the
pointwise mutual information as a share of the entity's information,

    log(N n(e, t) / (n(e) n(t))) / log(N / n(e)),

1 for a term that stands nowhere without the entity and 0 for one that is independent of it. Terms
over the lower threshold are generalised, over the upper one removed, in all documents that name the
entity. Everything is DataFrame and SQL operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devprism.llm.common import pick
from devprism.runtime import land

# The patterns of the base kinds, in their order. Possessive repeats and the check of the
# character before a run change no match; they keep long runs from being tried at each of their places.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Settings:
    #: Code points on each side of an entity that make its context.
    context: int = 60
    #: Letters of a term, and different texts in which it must stand beside the entity.
    term_letters: int = 3
    support: int = 3
    generalise: float = 0.8
    remove: float = 0.95


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(value: str) -> str:
    d = _digits(value)
    doubled = f"cast(substring({d}, -i, 1) as int) * if(i % 2 = 0, 2, 1)"
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + {doubled} - if({doubled} > 9, 9, 0)) % 10 = 0"


#: Per kind: a look whether the text can hold a match, the pattern, what a match must fulfil, and its value.
RULES = {
    "email": ("contains({t}, '@')", EMAIL, "true", "lower({v})"),
    "ip": (r"{t} rlike '[0-9][.][0-9]+[.][0-9]+[.][0-9]'", IP, "{v} rlike '^BYTE([.]BYTE)(3)$'".replace("BYTE", BYTE).replace("(3)", "{{3}}"), "{v}"),
    "card": (r"{t} rlike '[0-9](?:[ -]?[0-9]){{15}}'", CARD, f"length({_digits('{v}')}) between 16 and 19 and {_luhn('{v}')}", _digits("{v}")),
    "phone": ("contains({t}, '+')", PHONE, f"length({_digits('{v}')}) between 8 and 15", _digits("{v}")),
}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _spans(kind: str, text: str, pattern: str, good: str = "true", value: str = "{v}") -> str:
    """SQL of the leftmost matches of a pattern that are good, with offsets in code points.

    Splitting a text at its matches gives the gaps between them; lengths of gaps and matches give places.
    """
    match = "m.m"
    return (
        f"aggregate(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (g, m) -> named_struct('g', g, 'm', m)), "
        f"named_struct('at', 0, 'out', cast(array() as {SPAN})), "
        f"(a, m) -> named_struct('at', a.at + char_length(m.g) + coalesce(char_length({match}), 0), 'out', "
        f"if({match} is not null and ({good.format(v=match)}), array_append(a.out, named_struct('kind', '{kind}', 'start', a.at + char_length(m.g), "
        f"'end', a.at + char_length(m.g) + char_length({match}), 'value', {value.format(v=match)})), a.out)), a -> a.out)"
    )


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def base_spans(text: str) -> Column:
    """Spans of the fixed patterns, by kind as listed and place; an empty array for null."""
    parts = []
    for kind, (look, pattern, good, value) in RULES.items():
        found = _spans(kind, text, _literal(pattern), good, value)
        parts.append(f"if(coalesce({look.format(t=text)}, false), {found}, cast(array() as {SPAN}))")
    return F.expr(f"concat({', '.join(parts)})")


def disclosing_terms(found: DataFrame, texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``entity, term, disclosure`` over the lower threshold.

    ``found`` has ``rid, text, base`` of the documents with entities, ``texts`` has ``text`` of all documents.
    Counts are of documents; all are combined map-side, so a frequent entity or word is no hot task.
    """
    c, letters = settings.context, r"\\p{L}{%d,}" % settings.term_letters
    left = f"regexp_replace(substring(text, greatest(s.start - {c}, 0) + 1, least(s.start, {c})), '^\\\\p{{L}}+', '')"
    right = f"regexp_replace(substring(text, s.end + 1, {c}), '\\\\p{{L}}+$', '')"
    near = f"regexp_extract_all(lower(concat({left}, ' ', {right})), '{letters}', 0)"
    beside = found.select(
        F.xxhash64("text").alias("copy"),
        F.expr(f"inline(array_distinct(flatten(transform(base, s -> transform({near}, w -> named_struct('entity', concat(s.kind, ':', s.value), 'term', w))))))"),
    )
    pairs = beside.groupBy("entity", "term").agg(F.count("*").alias("both"), F.approx_count_distinct("copy", 0.02).alias("copies"))
    pairs = pairs.filter(F.col("copies") >= settings.support)
    entities = found.select(F.expr("explode(array_distinct(transform(base, s -> concat(s.kind, ':', s.value))))").alias("entity"))
    entities = entities.groupBy("entity").agg(F.count("*").alias("n_entity"))
    words = texts.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(text), '{letters}', 0)"))).alias("term"))
    words = words.groupBy("term").agg(F.count("*").alias("n_term"))
    total = texts.agg(F.count("*").alias("n")).scalar()
    known = pairs.join(entities, "entity").join(words, "term").withColumn("n", total)
    # An entity that every document holds carries no information, so nothing discloses it.
    share = "double({}) / double({})"
    joint = f"{share.format('both', 'n_entity')} * {share.format('n', 'n_term')}"
    disclosure = F.expr(f"coalesce(try_divide(ln({joint}), ln({share.format('n', 'n_entity')})), 0)")
    return known.withColumn("disclosure", disclosure).filter(F.col("disclosure") >= settings.generalise).select("entity", "term", "disclosure")


def find_personal(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, text, base, terms`` for each row of ``docs(doc_id, text)``.

    ``base`` and ``terms`` are arrays of ``(kind, start, end, value)``; the value of a term span is what becomes
    of it, ``generalise`` or ``remove``. Offsets are code points, the end is exclusive. ``text`` is null where a
    document has no span. Null and empty texts have no spans, repeated rows each get theirs, other
    columns are not read, an empty table gives no rows.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    scanned = rows.withColumn("base", base_spans("text"))
    scanned = scanned.select("doc_id", F.when(F.size("base") > 0, F.col("text")).alias("text"), "base", F.monotonically_increasing_id().alias("rid"))
    scanned = land(scanned, "personal_base")
    found = scanned.filter(F.size("base") > 0)
    terms = land(disclosing_terms(found, rows.filter("text is not null").select("text"), settings), "disclosing_terms")
    named = found.select("rid", F.expr("explode(array_distinct(transform(base, s -> concat(s.kind, ':', s.value))))").alias("entity"))
    marked = named.join(terms, "entity").groupBy("rid", "term").agg(F.max("disclosure").alias("disclosure"))
    fate = F.when(F.col("disclosure") >= settings.remove, "remove").otherwise("generalise")
    marked = marked.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", fate))).alias("fates"))
    pattern = r"concat('(?iu)(?<!\\p{L})(?:', array_join(array_sort(map_keys(fates)), '|'), ')(?!\\p{L})')"
    hits = _spans("term", "text", pattern, "true", "fates[lower({v})]")
    clear = "s -> s.value is not null and not exists(base, b -> b.start < s.end and s.start < b.end)"
    terms_of = found.join(marked, "rid").select("rid", F.expr(f"filter({hits}, {clear})").alias("terms"))
    full = found.join(terms_of, "rid", "left")
    rest = scanned.filter(F.size("base") == 0).withColumn("terms", F.lit(None).cast(SPAN))
    out = full.select("doc_id", "text", "base", "terms").unionByName(rest.select("doc_id", "text", "base", "terms"))
    return out.withColumn("terms", F.coalesce("terms", F.array().cast(SPAN)))


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with entities replaced by their kind, terms generalised to ``[TERM]`` or taken out."""
    spans = F.array_sort(F.concat(base, terms), lambda a, b: (a["start"] - b["start"]).cast("int"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, span: Column) -> Column:
        fresh = span["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
        mark = F.when((span["kind"] == "term") & (span["value"] == "remove"), "").otherwise(F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))
        out = F.when(fresh, F.concat(acc["out"], gap, mark)).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))

    rest = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(rest)
