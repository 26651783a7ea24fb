"""Exact top-k by inner product: M-trees over parts of the vectors, searched best first.

Vectors get one more component, ``sqrt(M - |x|**2)`` with ``M`` the largest squared length of their part, so that
for a query with 0 there the Euclidean distance orders as the inner product. An M-tree keeps for each
node a routing object, a covering radius and the distance to its parent's object; leaves are pages of
entries with their distance to the page's object. By the triangle inequality the stored distances rule
out nodes and entries without computing theirs. A block of queries walks a tree together: each
keeps its own bounds, and a page is compared with all queries that reach it in one matrix product.

Spark deals the vectors to parts around pivots; a part with many vectors is split by a hash, whatever its
vectors are. Each query first searches one part. What it finds there bounds its k-th score, and only
parts that can beat that bound are searched next. A part is copied only as often as the queries that
reach it fill blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from devprism.llm.common import pick
from devprism.runtime import deal, land

FOUND = "rid bigint, query_id bigint, other bigint, vec_id bigint, score bigint"


@dataclass(frozen=True)
class Settings:
    k: int = 5
    page: int = 64
    fanout: int = 16
    #: Vectors of a part (one tree), pivots at most, rows they are chosen from, queries that one copy of a part answers.
    part_rows: int = 16384
    pivots: int = 1024
    pivot_sample: int = 4096
    query_block: int = 4096


class Node:
    """Routing object ``center``, covering ``radius``, distance ``up`` to the parent's object; children or a page of rows."""

    __slots__ = ("center", "radius", "up", "children", "rows", "away", "ups", "radii", "centers")

    def __init__(self, center: int, up: float):
        self.center, self.up, self.radius = center, up, 0.0
        self.children: list[Node] = []
        self.rows = self.away = None


class MTree:
    """An M-tree over integer vectors, bulk-loaded from the top."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rids: np.ndarray, settings: Settings):
        self.x, self.ids, self.rids, self.settings = x, ids, rids, settings
        squares = (x * x).sum(axis=1).astype(np.float64)
        self.most = float(squares.max()) if len(x) else 0.0
        self.lift = np.hstack([x.astype(np.float64), np.sqrt(self.most - squares)[:, None]])
        self.real = x.astype(np.float64)
        #: Rounding of distances stays below this share.
        self.slack = 1e-9 * (1 + np.sqrt(2 * self.most))
        self.root = self._load(np.arange(len(x)), 0, 0.0) if len(x) else None

    def _distances(self, rows: np.ndarray, center: int) -> np.ndarray:
        apart = self.lift[rows] - self.lift[center]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))

    def _load(self, rows: np.ndarray, center: int, up: float) -> Node:
        node = Node(center, up)
        away = self._distances(rows, center)
        node.radius = float(away.max())
        if len(rows) <= self.settings.page:
            node.rows, node.away = rows, away
            return node
        # Centers far from each other, then each row to the nearest; equal vectors are cut into even runs.
        picked, least = [center], away.copy()
        while len(picked) < self.settings.fanout and least.max() > 0:
            picked.append(int(rows[least.argmax()]))
            least = np.minimum(least, self._distances(rows, picked[-1]))
        if len(picked) == 1:
            groups = [(center, part) for part in np.array_split(rows, self.settings.fanout) if len(part)]
        else:
            nearest = np.stack([self._distances(rows, c) for c in picked]).argmin(axis=0)
            groups = [(c, rows[nearest == i]) for i, c in enumerate(picked) if (nearest == i).any()]
        for c, part in groups:
            node.children.append(self._load(part, c, float(self._distances(np.array([c]), center)[0])))
        node.ups = np.array([c.up for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.centers = np.array([c.center for c in node.children])
        return node

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query the best ``k`` scores that reach its bound, ties to the smaller id, and their rows; -1 where there are fewer.

        A node waits with the queries that may need it and their distances to its object, nearest node first.
        """
        score, row = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        if self.root is None or not len(queries):
            return score, row
        real = queries.astype(np.float64)
        length = np.sqrt((real * real).sum(axis=1))
        square, slack = length * length + self.most, self.slack + 1e-12 * length
        # No partial sum of a product exceeds the product of the lengths, so doubles are exact below 2**52.
        exact = np.sqrt(self.most) * length.max() < 2.0**52

        def scores(rows: np.ndarray, who: np.ndarray) -> np.ndarray:
            return real[who] @ self.real[rows].T if exact else (queries[who] @ self.x[rows].T).astype(np.float64)

        def away(rows: np.ndarray, who: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[who, None] - 2.0 * scores(rows, who), 0.0))

        def reach(who: np.ndarray) -> np.ndarray:
            """Distance beyond which nothing can enter."""
            return np.sqrt(np.maximum(square[who] - 2.0 * np.maximum(score[who, -1], bound[who]), 0.0)) + slack[who]

        everyone = np.arange(len(queries))
        queue = [(0.0, 0, everyone, away(np.array([self.root.center]), everyone)[:, 0], self.root)]
        pushed = 1
        while queue:
            _, _, who, here, node = heapq.heappop(queue)
            limit = reach(who)
            still = here - node.radius <= limit
            who, here, limit = who[still], here[still, None], limit[still, None]
            if not len(who):
                continue
            if node.rows is None:
                near = np.abs(here - node.ups) - node.radii <= limit
                some = np.flatnonzero(near.any(axis=0))
                far = away(node.centers[some], who)
                low = np.maximum(far - node.radii[some], 0.0)
                near = near[:, some] & (low <= limit)
                for j in np.flatnonzero(near.any(axis=0)).tolist():
                    mine = near[:, j]
                    heapq.heappush(queue, (float(low[mine, j].mean()), pushed, who[mine], far[mine, j], node.children[some[j]]))
                    pushed += 1
                continue
            near = np.abs(here - node.away) <= limit
            some = np.flatnonzero(near.any(axis=0))
            rows = node.rows[some]
            got = scores(rows, who)
            worst = np.maximum(score[who, -1], bound[who])[:, None]
            fits = near[:, some] & (got >= worst) & (self.rids[rows] != own[who, None])
            better = np.flatnonzero(fits.any(axis=1))
            who, fits = who[better], fits[better]
            both = np.hstack([score[who], np.where(fits, got[better], -np.inf)])
            its = np.hstack([row[who], np.where(fits, rows, -1)])
            ids = np.where(its >= 0, self.ids[its], np.iinfo(np.int64).max)
            order = np.lexsort((ids, -both), axis=-1)[:, :k]
            score[who], row[who] = np.take_along_axis(both, order, 1), np.take_along_axis(its, order, 1)
        return score, row


def _search(settings: Settings):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        columns = ["rid", "query_id", "other", "vec_id", "score"]
        if not len(queries) or not len(vectors):
            return pd.DataFrame([], columns=columns)
        tree = MTree(np.stack(vectors["x"].to_list()), vectors["vec_id"].to_numpy(), vectors["rid"].to_numpy(), settings)
        rid, query_id = queries["rid"].to_numpy(), queries["vec_id"].to_numpy()
        bound = queries["bound"].to_numpy(np.float64, na_value=-np.inf)
        score, row = tree.search(np.stack(queries["x"].to_list()), rid, settings.k, np.where(np.isnan(bound), -np.inf, bound))
        query, place = np.nonzero(row >= 0)
        hit = row[query, place]
        values = rid[query], query_id[query], tree.rids[hit], tree.ids[hit], score[query, place].astype(np.int64)
        return pd.DataFrame(dict(zip(columns, values)))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _pivots(vectors: DataFrame, n: int, settings: Settings) -> np.ndarray:
    """Up to ``settings.pivots`` vectors that lie apart, from a sample of bounded size."""
    sample = vectors.select("rid", "x").orderBy(F.xxhash64("rid"), "rid").limit(settings.pivot_sample).collect()
    x = np.array([r["x"] for r in sample], np.float64)
    chosen, least = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(settings.pivots, -(-n // settings.part_rows)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _of_length(vectors: DataFrame, n: int, settings: Settings) -> DataFrame:
    """Found rows among ``n`` vectors of one length."""
    pivots = _pivots(vectors, n, settings)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_list()).astype(np.float64)
                away = np.stack([((x - p) ** 2).sum(axis=1) for p in pivots])
                yield batch.assign(part=away.argmin(axis=0), away=np.sqrt(away.min(axis=0)))

    dealt = land(vectors.mapInPandas(place, "rid bigint, vec_id bigint, x array<bigint>, part bigint, away double"), "placed_vectors")
    # One row per pivot, 1,024 at most.
    stats = {r["part"]: (r["radius"], max(1, -(-r["n"] // settings.part_rows))) for r in dealt.groupBy("part").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}
    salts = F.create_map(*[F.lit(int(v)) for part, (_, salt) in stats.items() for v in (part, salt)])
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("rid"), salts[F.col("part")]).cast("bigint"))
    queries = land(dealt.filter("vec_id % 50 = 0").select("rid", "vec_id", "x", F.col("part").alias("home"), F.col("salt").alias("home_salt")), "search_queries")

    def searched(asked: DataFrame) -> DataFrame:
        """Found rows of ``asked(rid, part, salt, bound)``; a part meets its queries block by block."""
        tree = ["part", "salt"]
        blocks = land(asked.groupBy(*tree).agg(F.ceil(F.count("*") / settings.query_block).alias("blocks")), "query_blocks")
        copies = dealt.join(blocks, tree).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        wanted = asked.join(blocks, tree).withColumn("block", F.pmod(F.xxhash64("rid", F.lit(3)), "blocks"))
        wanted = wanted.join(queries.select("rid", "vec_id", "x"), "rid")
        sides = [deal(side, *tree, "block").groupBy(*tree, "block") for side in (wanted.drop("blocks"), copies.drop("blocks"))]
        return sides[0].cogroup(sides[1]).applyInPandas(_search(settings), FOUND)

    home = queries.select("rid", F.col("home").alias("part"), F.col("home_salt").alias("salt"), F.lit(None).cast("bigint").alias("bound"))
    first = land(searched(home), "home_found")
    bounds = first.groupBy("rid").agg(F.when(F.count("*") >= settings.k, F.min("score")).alias("bound"))

    @F.pandas_udf("array<struct<part:bigint,salt:bigint>>")
    def worth(x: pd.Series, bound: pd.Series, home: pd.Series, home_salt: pd.Series) -> pd.Series:
        """Parts whose upper bound <q, p> + |q| r reaches the query's k-th score so far."""
        out = []
        for q, b, h, s in zip(x, bound, home, home_salt):
            q = np.asarray(q, np.float64)
            length = float(np.sqrt((q * q).sum()))
            chosen = []
            for part, (radius, salt_count) in stats.items():
                top = float(q @ pivots[part]) + length * radius
                if pd.isna(b) or top * (1 + 1e-9) + 1e-6 * (1 + length) >= b:
                    chosen += [{"part": part, "salt": i} for i in range(salt_count) if (part, i) != (h, s)]
            out.append(chosen)
        return pd.Series(out)

    left = queries.join(bounds, "rid", "left").withColumn("p", F.explode(worth("x", "bound", "home", "home_salt")))
    asked = land(left.select("rid", "p.part", "p.salt", "bound"), "asked_parts")
    return first.unionByName(searched(asked))


def top_scores(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best inner products of each vector whose id is divisible by 50.

    Components are ``floor(256 * x)``, and scores must fit 53 bits. Null and empty vectors and vectors with a null or
    non-finite component take no part, nor do rows without an id; vectors of different length do not meet.
    Repeated rows are vectors of their own: each is a query, and each is a candidate of the others. Other columns are
    not read; an empty table gives no rows.
    """
    rows = pick(embeddings, vec_id="bigint", embedding="array<double>")
    sound = F.size("embedding") > 0
    sound &= ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform("embedding", lambda v: F.floor(F.lit(256.0) * v).cast("bigint"))
    vectors = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    vectors = land(vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", scaled.alias("x")), "vectors")
    lengths = vectors.groupBy(F.size("x").alias("length")).count().collect()
    found = embeddings.sparkSession.createDataFrame([], FOUND)
    for r in lengths:
        found = found.unionByName(_of_length(vectors.filter(F.size("x") == r["length"]), r["count"], settings))
    return _best(found, settings.k).select("query_id", "rank", "vec_id", "score")
