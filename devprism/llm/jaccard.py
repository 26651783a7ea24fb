"""Join of word n-gram sets by Jaccard similarity, size-aware: light sets by subsets, heavy ones by inverted lists.

Two sets of sizes ``m`` and ``k`` link if they share at least ``need(m, k)`` elements. Below a boundary size, every
set lists its subsets of exactly that many elements, once per size its partner may have; sets that list one subset
link. From the boundary on, sets scan inverted lists. All sets take their elements in one order, the rarest
first; of the first ``m - need + 3`` elements in that order linked sets share three, so pairs that meet in fewer short lists
are dropped. An element's frequency decides its place: those in few sets come first and have short lists,
whose pairs are counted; frequent ones come last, so only sets that consist of them nearly alone, such as those of a large family of
copies, ever look at their long lists, which make families that meet in blocks.
The boundary is where the cost of listing subsets and the cost of scanning, summed over the sizes of all sets, is least.

Only a part of the code space takes part in the lists of larger sets; it holds more elements than two linked sets may
differ in. Elements outside it come last of all and stand in for missing ones.

Documents with equal sets are one class. Candidates are confirmed on full sets, block by block, where union-find keeps the
links that join groups. Members outside the main group of a large family then meet all its other members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devprism.llm.common import EMIT_BYTES, as_long, mix, pick, text_chunks
from devprism.llm.neardup import shingle_sets
from devprism.operators.components import connected_components
from devprism.runtime import broadcast_if_small, land


@dataclass(frozen=True)
class Settings:
    #: Words per shingle and the least similarity of a link, in percent.
    words: int = 3
    percent: int = 90
    #: Lists that linked heavy sets share at least, and the length up to which a list is short.
    shared: int = 3
    short: int = 16
    #: Sets from this size on use only one in ``part`` codes for their lists.
    whole: int = 128
    part: int = 5
    #: The largest size that may be light.
    lightest: int = 64
    #: Members of a family whose sets meet in one task.
    block_rows: int = 512

    def need(self, m: int, k: int) -> int:
        """Elements that linked sets of these sizes share at least."""
        return -(-self.percent * (m + k) // (100 + self.percent))

    def least(self, m: int) -> int:
        """The least size of a set that may link with one of size ``m``."""
        return -(-self.percent * m // 100)

    @property
    def limit(self) -> int:
        return (1 << 64) // self.part


# --- light sets --------------------------------------------------------------------------------------


def partners(m: int, settings: Settings) -> list[tuple[int, int]]:
    """``(size, need)`` of the sets that may link with a set of ``m`` elements without being equal to it."""
    sizes = range(settings.least(m), 100 * m // settings.percent + 1)
    found = [(k, settings.need(m, k)) for k in sizes]
    return [(k, c) for k, c in found if c <= min(m, k) and not k == m == c]


def boundary(sizes: dict[int, int], settings: Settings) -> int:
    """The size from which sets are heavy, by the cost of subsets and list entries; ``sizes`` counts sets by size."""

    def listed(m: int) -> int:
        return sum(comb(m, c) for _, c in partners(m, settings))

    def scanned(m: int) -> int:  # each element is counted, those that are listed are moved and paired
        return m + 2 * (m - settings.least(m) + settings.shared)

    def cost(x: int) -> int:
        light = sum(n * listed(m) for m, n in sizes.items() if m < x)
        return light + sum(n * scanned(m) for m, n in sizes.items() if m >= settings.least(x))

    return min(range(1, settings.lightest + 1), key=cost)


SUBSETS = "cid bigint, n int, smaller int, larger int, subset bigint"


def _subsets(settings: Settings):
    """Hashes of the subsets that a light set shares with a linked one; a hash is a sum over the elements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m, same in batch.groupby("n"):
                codes = mix(np.stack(list(same["codes"])).view(np.uint64))
                whole = codes.sum(axis=1, dtype=np.uint64)
                for k, c in partners(int(m), settings):
                    for gone in combinations(range(int(m)), int(m) - c):
                        subset = mix(whole - codes[:, list(gone)].sum(axis=1, dtype=np.uint64))
                        yield pd.DataFrame({"cid": same["cid"].to_numpy(), "n": int(m), "smaller": min(int(m), k), "larger": max(int(m), k), "subset": as_long(subset)})

    return run


def _light(classes: DataFrame, settings: Settings, x: int) -> DataFrame:
    """Families ``head, cid`` of light sets: a subset that both sizes of its pair list makes one."""
    listed = classes.filter(F.col("n") < x).select("cid", F.col("n").cast("int").alias("n"), "codes").mapInPandas(_subsets(settings), SUBSETS)
    keys = ["smaller", "larger", "subset"]
    heads = listed.groupBy(*keys).agg(F.min("cid").alias("head"), F.max("cid").alias("other"), F.min("n").alias("from"), F.max("n").alias("to"))
    heads = heads.filter("head < other and from = smaller and to = larger").select(*keys, "head")
    return listed.join(heads, keys).select("head", "cid").distinct()


# --- heavy sets --------------------------------------------------------------------------------------


def _listed(classes: DataFrame, settings: Settings, x: int) -> DataFrame:
    """``cid, n, scheme, take, codes, rest``: codes that count for the lists, and what fills up too few of them."""
    n = F.col("n")
    rows = classes.filter(n >= settings.least(x)).withColumn("take", n - F.ceil(F.lit(settings.percent) * n / 100) + settings.shared)
    small = rows.filter(n < settings.whole).select("cid", "n", F.lit(0).alias("scheme"), "take", "codes", F.array().cast("array<bigint>").alias("rest"))
    inside = F.size(F.filter("codes", lambda c: (c >= 0) & (c < settings.limit)))
    large = rows.filter(n >= settings.least(settings.whole)).withColumn("inside", inside)
    missing = F.greatest(F.lit(0), F.col("take") - F.col("inside")).cast("int")
    return small.unionByName(large.select(
        "cid", "n", F.lit(1).alias("scheme"), "take",
        F.slice("codes", F.lit(1), F.col("inside")).alias("codes"), F.slice("codes", F.col("inside") + 1, missing).alias("rest"),
    ))


def _pairs(members: Column, settings: Settings) -> Column:
    """Pairs ``a < b`` of the members ``(n, cid)`` of a short list whose sizes allow a link."""
    ordered = F.sort_array(members)

    def later(x: Column, i: Column) -> Column:
        fits = F.filter(F.slice(ordered, i + 2, F.lit(settings.short)), lambda y: 100 * x["n"] >= settings.percent * y["n"])
        return F.transform(fits, lambda y: F.struct(F.least(x["cid"], y["cid"]).alias("a"), F.greatest(x["cid"], y["cid"]).alias("b")))

    return F.flatten(F.transform(ordered, later))


def _heavy(classes: DataFrame, settings: Settings, x: int) -> DataFrame:
    """Families ``head, cid`` of sets that meet in inverted lists."""
    listed = _listed(classes, settings, x)
    entries = listed.select("cid", "scheme", F.explode("codes").alias("code"))
    often = entries.groupBy("scheme", "code").agg(F.count("*").alias("sets")).filter(F.col("sets") > settings.short)
    hot = land(often.select("scheme", "code", F.floor(F.log2("sets")).cast("int").alias("level")), "frequent")
    held = entries.join(broadcast_if_small(hot), ["scheme", "code"]).groupBy("cid", "scheme")
    held = held.agg(F.sort_array(F.collect_list(F.struct("level", "code"))).alias("hot"))
    hot_codes = F.coalesce(F.transform("hot", lambda h: h["code"]), F.array().cast("array<bigint>"))
    placed = listed.join(held, ["cid", "scheme"], "left").withColumn("hot", hot_codes)
    placed = placed.withColumn("rare", F.slice(F.array_except("codes", "hot"), F.lit(1), F.col("take").cast("int")))
    room = (F.col("take") - F.size("rare")).cast("int")
    placed = land(placed.select("cid", "n", "scheme", "rare", F.slice(F.concat("hot", "rest"), F.lit(1), room).alias("often")), "listed")

    rare = placed.select("scheme", F.explode("rare").alias("code"), F.struct("n", "cid").alias("m"))
    short = rare.groupBy("scheme", "code").agg(F.collect_list("m").alias("m")).filter(F.size("m") > 1)  # at most ``short`` rows
    pairs = short.select(F.inline(_pairs(F.col("m"), settings))).groupBy("a", "b").agg(F.count("*").alias("lists"))
    pairs = land(pairs.filter(F.col("lists") >= settings.shared).select("a", "b"), "pairs")
    lowest = pairs.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("head"))
    met = pairs.join(lowest, F.col("a") == F.col("x"), "left").select(F.coalesce("head", "a").alias("head"), F.explode(F.array("a", "b")).alias("cid"))

    often = placed.select("scheme", "cid", F.explode("often").alias("code"))
    heads = often.groupBy("scheme", "code").agg(F.min("cid").alias("head"), F.max("cid").alias("other")).filter("head < other").drop("other")
    return met.unionByName(often.join(heads, ["scheme", "code"]).select("head", "cid")).distinct()


# --- confirmation ------------------------------------------------------------------------------------


def _sid(codes: np.ndarray) -> bytes:
    return blake2b(codes.tobytes(), digest_size=16).digest()


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.binary()), ("codes", pa.list_(pa.int64()))])


def _sign(settings: Settings):
    """Size and digest of each set, with the codes that its lists may need: the smallest, or all of a small set."""

    def kept(codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if n < settings.whole:
            return as_long(codes)
        inside = int(np.searchsorted(codes, np.uint64(settings.limit)))
        return as_long(codes[: max(inside, n - settings.least(n) + settings.shared)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in text_chunks(texts, EMIT_BYTES):
                sets = shingle_sets(texts[part], settings.words)
                columns = [
                    batch.column(0).slice(part.start, part.stop - part.start),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_sid(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([kept(s) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=SIGNED)

    return run


FULL = pa.schema([("sid", pa.binary()), ("codes", pa.list_(pa.int64()))])


def _sets(settings: Settings):
    """All codes of each text, with the digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in text_chunks(texts, EMIT_BYTES):
                sets = [s for s in shingle_sets(texts[part], settings.words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_sid(s) for s in sets], pa.binary()), pa.array([as_long(s) for s in sets], pa.list_(pa.int64()))], schema=FULL)

    return run


def _forest(settings: Settings):
    """Links that join groups among the sets of one block: rows of side 0 meet all, sides 1 and 2 each other."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        cid, side = block["cid"].to_numpy(), block["side"].to_numpy()
        group = {int(g): int(g) for g in block["label"]}
        mine = block["label"].to_list()

        def root(g: int) -> int:
            while group[g] != g:
                group[g] = group[group[g]]
                g = group[g]
            return g

        sets = list(block["codes"])
        sizes = np.array([len(s) for s in sets])
        elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(elements, kind="stable")
        elements, owner = elements[order], owner[order]
        first = np.flatnonzero(np.append(True, elements[1:] != elements[:-1]))
        count = np.diff(np.append(first, len(elements)))
        elements = elements[first]
        links = []
        for i in np.flatnonzero(side < 2):
            at = np.searchsorted(elements, sets[i])
            many = count[at]
            place = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(owner[place], minlength=len(sets))
            alike = 100 * both >= settings.percent * (sizes + sizes[i] - both)
            alike[i] = False
            if side[i]:
                alike &= side != side[i]
            for j in np.flatnonzero(alike):
                if (a := root(mine[i])) != (b := root(mine[j])):
                    group[b] = a
                    links.append((cid[i], cid[j]))
        return pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)

    return run


def _meet(rows: DataFrame, sets: DataFrame, settings: Settings, *key: str) -> DataFrame:
    return rows.join(sets, "cid").groupBy(*key).applyInPandas(_forest(settings), "u bigint, v bigint")


def _numbers(upto: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), upto - 1))


def _strays(dealt: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Blocks in which members outside a large family's main group (side 1) meet all its members (side 2)."""
    named = land(dealt.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "large_families")
    groups = named.groupBy("head", "label").agg(F.count("*").alias("n"))
    main = groups.groupBy("head").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    strays = named.join(main, "head").filter("label <> main").select("head", "cid", "label", "blocks")
    parts = strays.groupBy("head").agg(F.ceil(F.count("*") / settings.block_rows).alias("parts"))
    ones = strays.join(parts, "head").withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), "parts"))
    ones = ones.withColumn("block", _numbers(F.col("blocks"))).select("head", "part", "block", "cid", "label", F.lit(1).alias("side"))
    twos = named.join(parts, "head").withColumn("part", _numbers(F.col("parts"))).select("head", "part", "block", "cid", "label", F.lit(2).alias("side"))
    return ones.unionByName(twos)


def _labels(links: DataFrame) -> DataFrame:
    found = connected_components(links.select(F.lit(0).alias("g"), "u", "v"))
    return land(found.select(F.col("id").alias("cid"), "label"), "labels")


def _confirmed(members: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """``cid, label`` of all sets that link with another one."""
    blocks = members.groupBy("head").agg(F.ceil(F.count("*") / settings.block_rows).alias("blocks"))
    dealt = members.join(blocks, "head").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    heads = blocks.select("head", _numbers(F.col("blocks")).alias("block"), F.col("head").alias("cid"))  # the head meets every block
    inside = dealt.filter("cid <> head").select("head", "block", "cid").unionByName(heads)
    inside = inside.withColumns({"label": F.col("cid"), "side": F.lit(0)})
    links = land(_meet(inside, sets, settings, "head", "block"), "links")
    labels = _labels(links)
    more = land(_meet(_strays(dealt.filter("blocks > 1"), labels, settings), sets, settings, "head", "part", "block"), "cross_links")
    return labels if more.isEmpty() else _labels(links.unionByName(more))


def linked_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``; the id is the smallest reachable.

    ASCII letters compare in lower case; words are runs of anything but ASCII white space. Null texts and texts
    without words have no shingles and link with nothing. Repeated rows, also of one id, have equal sets and so
    one component. A row without an id takes its component from its links, null if no row there has an id. Other
    columns are not read; an empty table gives no rows.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    signed = land(rows.mapInArrow(_sign(settings), "doc_id bigint, n_shingles bigint, sid binary, codes array<bigint>"), "signed")
    full = signed.filter("sid is not null")
    classes = full.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("codes").alias("codes"))
    classes = land(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sizes = classes.filter(F.col("n") < settings.lightest).groupBy("n").count()
    x = boundary(dict(sizes.collect()), settings)
    members = land(_light(classes, settings, x).unionByName(_heavy(classes, settings, x)).distinct(), "members")

    wanted = members.select("cid").unionByName(members.select(F.col("head").alias("cid"))).distinct()
    wanted = wanted.join(classes.select("cid", "sid", "first_id", "n"), "cid")
    small = classes.filter(F.col("n") < settings.whole).select("cid", "codes").join(wanted.select("cid"), "cid", "left_semi")
    large = land(wanted.filter(F.col("n") >= settings.whole).drop("n"), "wanted")
    named = large.filter("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct()
    texts = rows.join(named, "doc_id", "left_semi").unionByName(rows.filter("doc_id is null"))
    found = texts.select("text").mapInArrow(_sets(settings), "sid binary, codes array<bigint>")
    found = found.join(large.select("sid", "cid"), "sid").groupBy("cid").agg(F.first("codes").alias("codes"))
    labels = _confirmed(members, land(found.unionByName(small), "sets"), settings)

    grouped = classes.select("cid", "sid", "first_id").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    component = grouped.join(smallest, "label").select("sid", "component_id")
    out = full.select("doc_id", "n_shingles", "sid").join(component, "sid").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(signed.filter("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
