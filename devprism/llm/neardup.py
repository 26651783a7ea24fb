"""Near duplicates by SuperMinHash, banding, verification on full sets, and grouping of links.

Each element of a set walks its own random permutation of the signature's components; at step j it
offers ``j + u`` to one component. Offers only grow, so a document stops at the first step that can
no longer lower any of its components. Compared with independent hashes the components of one element
are spread without repeats, which lowers the variance of the estimate.

Documents with equal sets are one class. Bands of class signatures make buckets, and the buckets with one
first member make its family. Sets of a family meet in blocks of bounded size, where an inverted list
finds all links and union-find keeps those that join groups. Families of several blocks go on: members
outside the family's main group meet all its other members, again block by block. So every
candidate pair that could still join two groups is verified on full sets, and only links of a forest
leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devprism.llm.common import EMIT_BYTES, Words, as_long, mix, pick, seeds, text_chunks
from devprism.operators.components import connected_components
from devprism.runtime import land


@dataclass(frozen=True)
class Settings:
    #: Words per shingle and the least similarity of a link, in percent.
    words: int = 2
    percent: int = 80
    #: Bands and rows per band: a pair at 80 % misses all bands with probability 0.5904**28 < 4e-7.
    bands: int = 28
    rows: int = 4
    #: Members of a family whose sets meet in one task.
    block_rows: int = 512
    #: Elements that are permuted at once.
    chunk: int = 50_000


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit codes of the shingles of each text; fewer words make one shingle."""
    out: list[np.ndarray] = []
    for part in text_chunks(texts):
        coded = Words(texts[part], "space")
        code, n = coded.code, max(0, len(coded.code) - words + 1)
        joined = np.zeros(n, np.uint64)
        for k in range(words):
            joined = mix(joined * np.uint64(3) + code[k : k + n])
        for d in range(len(coded.first) - 1):
            a, b = coded.first[d], coded.first[d + 1]
            if b - a >= words:
                out.append(np.unique(joined[a : b - words + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for c in code[a:b]:
                    short = mix(short * np.uint64(5) + c)
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], size: int, chunk: int = 50_000) -> np.ndarray:
    """SuperMinHash signatures, one row per set; rows of empty sets are infinite."""
    out = np.full((len(sets), size), np.inf)
    lengths = np.array([len(s) for s in sets])
    first = 0
    while first < len(sets):
        last, held = first, 0
        while last < len(sets) and (last == first or held + lengths[last] <= chunk):
            held += lengths[last]
            last += 1
        _fill(np.concatenate(sets[first:last]), np.repeat(np.arange(last - first), lengths[first:last]), out[first:last])
        first = last
    return out


def _fill(element: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    size = out.shape[1]
    flat = out.reshape(-1)
    at = np.arange(len(element))
    perm = np.tile(np.arange(size, dtype=np.int16), (len(element), 1))
    draw, jump = seeds(size, 21), seeds(size, 22)
    for j in range(size):
        if not len(at):
            return
        mine = element[at]
        other = j + (mix(mine ^ jump[j]) % np.uint64(size - j)).astype(np.int64)
        component = perm[at, other]
        perm[at, other] = perm[at, j]
        offer = (mix(mine + draw[j]) >> np.uint64(11)).astype(np.float64) / (1 << 53) + j
        np.minimum.at(flat, owner[at] * size + component, offer)
        open_rows = out.max(axis=1) > j + 1
        at = at[open_rows[owner[at]]]


def _sid(codes: np.ndarray) -> bytes:
    return blake2b(codes.tobytes(), digest_size=16).digest()


def _sign(settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, batch in ((p, b) for b in batches for p in text_chunks(list(b["text"]), EMIT_BYTES)):
            batch = batch.iloc[part]
            sets = shingle_sets(list(batch["text"]), settings.words)
            rows = signatures(sets, settings.bands * settings.rows, settings.chunk).view(np.uint64)
            rows = rows.reshape(len(sets), settings.bands, settings.rows)
            key = np.broadcast_to(seeds(settings.bands, 23), rows.shape[:2])
            for r in range(settings.rows):
                key = mix(key + rows[:, :, r])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy(),
                "n_shingles": [len(s) for s in sets],
                "sid": [_sid(s) if len(s) else None for s in sets],
                "bands": list(as_long(key)),
            })

    return run


def _numbers(settings: Settings):
    """Sets of the wanted classes: rows whose text has another set than the one asked for are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(list(batch["text"]), settings.words)
            right = [i for i, (s, want) in enumerate(zip(sets, batch["sid"])) if len(s) and _sid(s) == bytes(want)]
            yield pd.DataFrame({"sid": [batch["sid"].iloc[i] for i in right], "codes": [as_long(sets[i]) for i in right]})

    return run


def _forest(settings: Settings):
    """Links that join groups, among the sets of one block: rows of side 0 meet all, sides 1 and 2 each other."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        sets = [c.view(np.uint64) for c in block["codes"]]
        side = block["side"].to_numpy()
        sizes = np.array([len(s) for s in sets])
        codes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        labels = pd.factorize(block["label"].map(bytes))[0]
        group = {int(g): int(g) for g in labels}

        def root(g: int) -> int:
            while group[g] != g:
                group[g] = group[group[g]]
                g = group[g]
            return g

        links = []
        for i in np.flatnonzero(side < 2):
            left, right = np.searchsorted(codes, sets[i]), np.searchsorted(codes, sets[i], "right")
            count = right - left
            place = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared = np.bincount(owner[place], minlength=len(sets))
            alike = np.flatnonzero(100 * shared >= settings.percent * (sizes + sizes[i] - shared))
            for j in alike:
                if j != i and (side[i] == 0 or side[j] != side[i]) and (a := root(int(labels[i]))) != (b := root(int(labels[j]))):
                    group[b] = a
                    links.append((block["sid"].iloc[i], block["sid"].iloc[j]))
        return pd.DataFrame(links, columns=["u", "v"])

    return run


def _met(rows: DataFrame, sets: DataFrame, settings: Settings, *key: str) -> DataFrame:
    """Forest links of blocks ``rows(*key, sid, label, side)``."""
    return rows.join(sets, "sid").groupBy(*key).applyInPandas(_forest(settings), "u binary, v binary")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    ASCII letters compare in lower case; words are runs of anything but ASCII white space. Texts
    without words, and null texts, are linked with nothing. Repeated rows have equal sets and so one
    component. A row without an id takes its component from its links and is kept only if no row there
    has an id. Other columns are not read; an empty table gives no rows.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    # Ids travel as text through pandas, which has no null for whole numbers.
    named = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    signed = named.mapInPandas(_sign(settings), "doc_id string, n_shingles bigint, sid binary, bands array<bigint>")
    signed = land(signed.withColumn("doc_id", F.col("doc_id").cast("bigint")), "signatures")
    full = signed.filter("sid is not null")
    classes = land(full.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")), "classes")
    placed = classes.select("sid", F.explode("bands").alias("band"))
    heads = placed.groupBy("band").agg(F.min("sid").alias("head"), F.max("sid").alias("last")).filter("head < last").drop("last")
    members = land(placed.join(heads, "band").select("head", "sid").distinct(), "families")
    wanted = members.select("sid").distinct().join(classes.select("sid", "first_id"), "sid")
    texts = rows.join(wanted.withColumnRenamed("first_id", "doc_id"), "doc_id").select("sid", "text")
    sets = texts.mapInPandas(_numbers(settings), "sid binary, codes array<bigint>")
    unnamed = wanted.filter("first_id is null")  # a class whose rows all lack an id
    loose = rows.filter("doc_id is null").mapInPandas(_sign_only(settings), "sid binary, codes array<bigint>").join(unnamed.select("sid"), "sid", "left_semi")
    sets = land(sets.unionByName(loose).groupBy("sid").agg(F.first("codes").alias("codes")), "sets")
    sizes = members.groupBy("head").agg(F.ceil(F.count("*") / settings.block_rows).alias("blocks"))
    dealt = members.join(sizes, "head").withColumn("block", F.pmod(F.xxhash64("sid"), "blocks")).withColumn("label", F.col("sid"))
    inside = dealt.filter("sid <> head").unionByName(
        sizes.select("head", F.col("head").alias("sid"), "blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("head").alias("label"))
    )  # the head meets every block of its family
    links = land(_met(inside.withColumn("side", F.lit(0)), sets, settings, "head", "block"), "links")
    labels = _labels(links)
    more = land(_met(_across(dealt.filter("blocks > 1").drop("label"), labels, settings), sets, settings, "head", "stray_block", "block"), "cross_links")
    if not more.isEmpty():
        labels = _labels(links.unionByName(more))
    named = classes.select("sid", "first_id").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    component = named.join(smallest, "label").select("sid", "component_id")
    out = full.join(component, "sid").select("doc_id", "n_shingles", "component_id")
    alone = signed.filter("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.unionByName(alone).withColumn("kept", kept)


def _sign_only(settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [s for s in shingle_sets(list(batch["text"]), settings.words) if len(s)]
            yield pd.DataFrame({"sid": [_sid(s) for s in sets], "codes": [as_long(s) for s in sets]})

    return run


def _labels(links: DataFrame) -> DataFrame:
    """``sid, label``: classes grouped by links; the label is the smallest class of the group."""
    edges = links.select(F.lit(0).alias("g"), "u", "v")
    return land(connected_components(edges).select(F.col("id").alias("sid"), "label"), "labels")


def _across(dealt: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Blocks of large families in which members outside the main group (side 1) meet all members (side 2)."""
    named = land(dealt.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "large_families")
    per = named.groupBy("head", "label").agg(F.count("*").alias("n"))
    main = per.groupBy("head").agg(F.max(F.struct("n", "label")).alias("m")).select("head", F.col("m.label").alias("main"))
    strays = named.join(main, "head").filter("label <> main").drop("main", "blocks", "block")
    many = strays.groupBy("head").agg(F.ceil(F.count("*") / settings.block_rows).alias("stray_blocks"))
    strays = strays.join(many, "head").withColumn("stray_block", F.pmod(F.xxhash64("sid", F.lit(1)), "stray_blocks")).drop("stray_blocks")
    blocks = dealt.select("head", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")).distinct()
    ones = strays.join(blocks, "head").withColumn("side", F.lit(1))
    twos = named.drop("blocks").join(many, "head").withColumn("stray_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("stray_blocks") - 1)))
    return ones.unionByName(twos.drop("stray_blocks").withColumn("side", F.lit(2)))


#: Keys of rows without an id start here, so a row with an id stays rather than its copies without.
UNNAMED_FROM = 1 << 62


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and every text without words.

    Rows that repeat id and text stay once. Rows without an id count as one row per text, and stay only if no row
    of their component has an id; rows without id and text are one. An id with several texts stays with all of
    them if one is kept. An empty table gives no rows.
    """
    unnamed = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(UNNAMED_FROM)
    keyed = docs.withColumn("_key", F.coalesce("doc_id", unnamed))
    decided = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), settings)
    kept = decided.filter("kept").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key", "text"]).drop("_key")
