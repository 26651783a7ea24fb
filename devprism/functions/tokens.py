"""Tokens of a text: every function maps an array of tokens to another one inside the row.

Nothing here shuffles. A document is cleaned where it is read, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from devprism.functions.numbers import let

WORD = r"\p{L}\p{M}\p{N}_"
# A link, a word (with inner apostrophes and dashes), a single word character, or other signs.
TOKEN_PATTERN = rf"https?://\S+|[{WORD}][{WORD}'\-]*[{WORD}]|[{WORD}]|[^\s{WORD}]+"
PUNCTUATION_PATTERN = rf"[^{WORD}\s'\-]"
TERM_PATTERN = rf"[{WORD}]{{2,}}"

# The keys a ticket id starts with, and the cleaning limits.
TICKET_KEYS = [
    "camel", "hadoop", "hbase", "ivy", "jcr", "log4j2", "lucene", "mahout", "openjpa", "velocity",
    "xercesc", "amq",
]
TICKET_PATTERN = rf"^({'|'.join(TICKET_KEYS)})-\d{{1,5}}"
LINK_PATTERN = r"^http\S+"
DROPPED_LINES = rf"(?md)^(?:(?:{'|'.join(TICKET_KEYS)})-\d{{1,5}}[^\n]*|http[^\n]+|\p{{Nd}}+)\n"
MIN_LENGTH, MAX_LENGTH, MIN_SHARE, MIN_TOKENS = 2, 30, 0.007, 1

# Published noun suffix rules, the first that fits applies; endings that are no plural stay.
PLURALS = [("ies", "y"), ("ses", "s"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("s", "")]
NO_PLURALS = ["ss", "us", "is"]


def english_stop_words() -> list[str]:
    """Spark's own list, so no copy of it lives here."""
    return list(StopWordsRemover.loadDefaultStopWords("english"))


def tokenize(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def drop_ticket_ids(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.rlike(t, F.lit(TICKET_PATTERN)))


def drop_urls(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.rlike(t, F.lit(LINK_PATTERN)))


def strip_punct_drop_digits(tokens: Column) -> Column:
    """Drop numbers, then remove all signs but apostrophe, dash and underscore."""
    words = F.filter(tokens, lambda t: ~F.rlike(t, F.lit(r"^\p{Nd}+$")))
    return F.transform(words, lambda t: F.regexp_replace(t, PUNCTUATION_PATTERN, ""))


def drop_stopwords(tokens: Column, words: Sequence[str]) -> Column:
    """Repeated tokens stay, which ``array_except`` would merge; the list is probed as a hash set."""
    return F.filter(tokens, lambda t: ~t.isin(*words))


def noun_base(token: Column) -> Column:
    base = F.when(F.length(token) <= 3, token)
    for ending in NO_PLURALS:
        base = base.when(token.endswith(ending), token)
    for ending, singular in PLURALS:
        stem = F.substr(token, F.lit(1), F.length(token) - len(ending))
        base = base.when(token.endswith(ending), F.concat(stem, F.lit(singular)))
    return base.otherwise(token)


def lemmatize(tokens: Column, lemmas: Column | None = None) -> Column:
    """Base forms by rule, or first by a map column from word form to base form."""
    if lemmas is None:
        return F.transform(tokens, noun_base)
    return let(lemmas, lambda m: F.transform(tokens, lambda t: F.coalesce(F.try_element_at(m, t), noun_base(t))))


def length_filter(tokens: Column, shortest: int = MIN_LENGTH, longest: int = MAX_LENGTH) -> Column:
    return F.filter(tokens, lambda t: F.length(t).between(shortest, longest))


def _smallest_count(size: Column, share: float) -> Column:
    """The smallest count of at least one whose share of ``size`` reaches ``share``."""
    low = F.floor(size * F.lit(share)).cast("int")
    reached = F.try_divide(low.cast("double"), size.cast("double")) >= share
    return F.greatest(F.when(reached, low).otherwise(low + 1), F.lit(1))


def frequency_filter(tokens: Column, share: float = MIN_SHARE) -> Column:
    """Keep tokens that make up at least ``share`` of their document.

    In the sorted array a token occurs ``n`` times exactly if it equals the entry ``n - 1`` places
    on, so frequent tokens are found in one pass without counting or exploding. No more than
    ``1 / share`` different tokens can pass, which bounds the lookup.
    """

    def keep(t: Column, ordered: Column, n: Column) -> Column:
        runs = F.filter(ordered, lambda x, i: F.get(ordered, i + n - 1) == x)
        return let(F.array_distinct(runs), lambda often: F.filter(t, lambda x: F.array_contains(often, x)))

    def check(t: Column, n: Column) -> Column:
        """In a short document a single occurrence is enough, so nothing is sorted."""
        return F.when(n <= 1, t).otherwise(let(F.sort_array(t), lambda s: keep(t, s, n)))

    return let(tokens, lambda t: let(_smallest_count(F.size(t), share), lambda n: check(t, n)))


def min_tokens(tokens: Column, fewest: int = MIN_TOKENS) -> Column:
    """The tokens as one text; null if there are too few."""
    return F.when(F.size(tokens) >= fewest, F.array_join(tokens, " "))


def clean_tokens(text: Column, stop_words: Sequence[str], lemmas: Column | None = None) -> Column:
    """All steps in their order; the first three as passes over the whole document.

    Tokens hold no line break, so one token per line lets a single expression drop tickets, links
    and numbers and another one strip signs, instead of a match per token.
    """
    lines = F.concat(F.array_join(tokenize(text), "\n"), F.lit("\n"))
    kept = F.regexp_replace(F.regexp_replace(lines, DROPPED_LINES, ""), PUNCTUATION_PATTERN, "")
    tokens = F.split(kept, "\n")  # the empty piece behind the last line falls to the length filter
    tokens = length_filter(lemmatize(drop_stopwords(tokens, stop_words), lemmas))
    return frequency_filter(tokens)


def terms_of(text: Column) -> Column:
    """Words of two or more characters, as a count vectorizer sees them."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def _pairs(t: Column) -> Column:
    rest = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), rest), F.slice(t, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(tokens: Column) -> Column:
    return let(tokens, _pairs)


def ngrams(tokens: Column) -> Column:
    """Single tokens, then pairs of neighbors."""
    return let(tokens, lambda t: F.concat(t, _pairs(t)))


def term_counts(terms: Column) -> Column:
    """``array<struct<term, n>>`` of a document, counted inside the row; null if it has no terms.

    In the sorted array a term's count is the distance between two starts.
    """

    def runs(s: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(s)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("n")))

    def count(s: Column) -> Column:
        starts = F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i))
        return let(F.filter(starts, lambda i: i.isNotNull()), lambda found: runs(s, found))

    return let(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, count(s)))
