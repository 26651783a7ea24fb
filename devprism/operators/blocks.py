"""Vectors dealt over blocks of near ones, and joins of rows with the blocks that their reach meets.

Signed sums of the coordinates move no further than the distance does, so the box of a block's sums bounds from below how far
a row is from all of its vectors. A task holds one block as a matrix and streams the rows that visit it; distances are
summed coordinate by coordinate. The driver holds the boxes: two numbers per sum and block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devprism.functions.numbers import add_up
from devprism.runtime import broadcast_if_small, deal, land

FEWEST, MOST, MOST_FLAT = 256, 8192, 1024  # vectors of a block, and the most of one in up to three dimensions
STEP = 256  # rows that are compared with a block at once
Held = dict[str, np.ndarray]


def sign_patterns(width: int, limit: int = 8) -> list[tuple[int, ...]]:
    """Different vectors of +1 and -1, mutually as uncorrelated as a Walsh basis."""
    found: list[tuple[int, ...]] = []
    for k in range(64):
        signs = tuple(-1 if (i & k).bit_count() % 2 else 1 for i in range(width))
        if signs not in found:
            found.append(signs)
    return found[:limit]


def widest(rows: DataFrame, column: str, count: int) -> list[int]:
    """Which entries of an array column spread most, from one aggregated row."""
    spread = [F.stddev_pop(F.col(column)[i]).alias(f"d{i}") for i in range(count)]
    row = rows.agg(*spread).first()
    return sorted(range(count), key=lambda i: (-(row[i] or 0.0), i))


@dataclass(frozen=True)
class Blocks:
    """``rows(block, id, x, s, ...)`` with their signed sums, and per block the box ``(low, high)`` of these."""

    rows: DataFrame
    names: np.ndarray
    low: np.ndarray
    high: np.ndarray
    width: int


def dealt(vectors: DataFrame, width: int, euclidean: bool, block_rows: int | None = None) -> Blocks:
    """Blocks of ``vectors(id, x, ...)``, a table that is read several times; those without an id or with missing values are in none.

    Blocks are ranges of the widest sum, cut into ranges of the next. One with many equal sums is split by id.
    """
    patterns = sign_patterns(width)
    scale = width**-0.5 if euclidean else 1.0
    whole = vectors.filter(F.col("id").isNotNull() & (F.size("x") == width) & F.forall("x", lambda v: v.isNotNull()))
    terms = lambda p: add_up([F.col("x")[i] if s > 0 else -F.col("x")[i] for i, s in enumerate(p)])
    sums = whole.withColumn("s", F.array(*[terms(p) * F.lit(scale) for p in patterns]))
    axes = widest(sums, "s", len(patterns))[:2]
    n, cores = sums.count(), vectors.sparkSession.sparkContext.defaultParallelism
    size = block_rows or int(np.clip(-(-n // (4 * cores)), FEWEST, MOST if width > 3 else MOST_FLAT))
    count = max(1, -(-n // size))
    slabs = max(1, round(count**0.5)) if len(axes) > 1 else count
    tiles = max(1, -(-count // slabs))

    def place(bounds: Column, axis: int) -> Column:
        return F.size(F.filter(bounds, lambda b: b < F.col("s")[axis]))

    inner = lambda k: [i / k for i in range(1, k)]
    first = sums.select(F.col("s")[axes[0]].alias("p")).approxQuantile("p", inner(slabs), 0.1 / slabs) if slabs > 1 and n else []
    rows = sums.withColumn("block", place(F.array(*[F.lit(b) for b in first]).cast("array<double>"), axes[0]))
    if tiles > 1 and len(axes) > 1:
        cuts = F.array(*[F.lit(q) for q in inner(tiles)])
        bounds = rows.groupBy("block").agg(F.percentile_approx(F.col("s")[axes[1]], cuts, F.lit(10 * tiles)).alias("cuts"))
        # One row per range of the widest sum.
        rows = rows.join(F.broadcast(land(bounds, "cuts")), "block")
        rows = rows.withColumn("block", F.col("block") * tiles + place(F.col("cuts"), axes[1])).drop("cuts")
    rows = land(rows, "ranges")
    crowded = rows.groupBy("block").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")).filter("parts > 1")
    rows = rows.join(broadcast_if_small(land(crowded, "crowded")), "block", "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    rows = land(rows.withColumn("block", F.col("block") + part * (slabs * tiles)).drop("parts"), "blocks")
    each = range(len(patterns))
    boxes = rows.groupBy("block").agg(F.array(*[F.min(F.col("s")[i]) for i in each]).alias("low"), F.array(*[F.max(F.col("s")[i]) for i in each]).alias("high")).orderBy("block").collect()
    shape = (len(boxes), len(patterns))
    low, high = (np.array([r[c] for r in boxes], float).reshape(shape) for c in ("low", "high"))
    return Blocks(rows, np.array([r["block"] for r in boxes], np.int32), low, high, width)


def arrays(batches: Sequence[pa.RecordBatch]) -> Held:
    """Columns as arrays, lists as rows of a matrix."""
    table = pa.Table.from_batches(batches).combine_chunks()
    out = {}
    for name in table.column_names:
        column = table.column(name).combine_chunks()
        listed = pa.types.is_list(column.type)
        values = (column.flatten() if listed else column).to_numpy(zero_copy_only=False)
        out[name] = values.reshape(len(column), -1) if listed else values
    return out


def visits(queries: DataFrame, blocks: Blocks, reach: str | float, later: bool = False) -> DataFrame:
    """``queries(block, id, x, s, ...)`` once for each block that they may have a vector within ``reach`` in; ``block`` is that one, ``home`` their own.

    ``later`` leaves out the blocks before their own.
    """
    names, low, high = blocks.names, blocks.low, blocks.high
    kinds = {c: t for c, t in queries.dtypes if c not in ("block", "s")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), STEP):
                piece = batch.slice(start, STEP)
                s = piece.column("s").flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1)
                far = np.zeros((len(piece), len(names)))
                for i in range(s.shape[1]):
                    np.maximum(far, np.maximum(low[:, i] - s[:, i : i + 1], s[:, i : i + 1] - high[:, i]), out=far)
                limit = piece.column(reach).to_numpy(zero_copy_only=False)[:, None] if isinstance(reach, str) else reach
                met = far <= limit * (1 + 1e-9) + 1e-9
                home = piece.column("block").to_numpy(zero_copy_only=False)
                if later:
                    met &= names >= home[:, None]
                row, block = np.nonzero(met)
                taken = piece.take(pa.array(row))
                columns = {c: taken.column(c) for c in kinds}
                yield pa.RecordBatch.from_pydict({"block": pa.array(names[block], pa.int32()), "home": pa.array(home[row], pa.int32())} | columns)

    return queries.mapInArrow(run, ", ".join(["block int", "home int", *[f"`{c}` {t}" for c, t in kinds.items()]]))


def met(held: DataFrame, queries: DataFrame, fold: Callable[[Held, Held], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``fold`` makes of the rows ``held(block, ...)`` of a block and of some of ``queries(block, ...)`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            at, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asks"))
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(batch)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if at[s] != key:
                    key, parts, block = at[s], [], None
                if not asks[s]:
                    parts.append(batch.slice(s, e - s).select(holding))
                elif parts:
                    block = arrays(parts) if block is None else block
                    for start in range(s, e, STEP):
                        yield from fold(block, arrays([batch.slice(start, min(STEP, e - start)).select(asking)]))

    holding, asking = held.columns, queries.columns
    rows = held.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    return deal(rows, "block").sortWithinPartitions("block", "asks").mapInArrow(run, schema)


def manhattan(a: np.ndarray, b: np.ndarray, tile: int = 512) -> np.ndarray:
    """All distances between the rows of two matrices, coordinate by coordinate."""
    out = np.empty((len(a), len(b)))
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for s in range(0, len(b), tile):
        total = np.zeros((len(a), min(tile, len(b) - s)))
        step = np.empty_like(total)
        for u, v in zip(at, bt):
            np.subtract(u[:, None], v[None, s : s + tile], out=step)
            np.abs(step, out=step)
            total += step
        out[:, s : s + tile] = total
    return out


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of the same place."""
    total = np.zeros(len(a))
    for u, v in zip(a.T, b.T):
        total += (u - v) * (u - v)
    return np.sqrt(total)


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances between all rows of two matrices, and by how much rounding may move them."""
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    return na[:, None] + nb - 2 * (a @ b.T), 1e-12 * (float(na.max()) + float(nb.max())) + 1e-300


def nearest(vectors: DataFrame, k: int, width: int, block_rows: int | None = None) -> DataFrame:
    """``(v, o, dist)``: the ``k`` nearest of ``vectors(id, x)`` by Euclidean distance, the vector itself included, ties by the lower id.

    The vectors of its own block give each vector an upper bound; it then visits the blocks within that.
    """
    blocks = dealt(vectors, width, True, block_rows)
    kind = dict(vectors.dtypes)["id"]

    def bound(held: Held, rows: Held) -> Iterator[pa.RecordBatch]:
        x = rows["x"]
        reach = np.full(len(x), np.inf)
        if len(held["x"]) >= k:
            far, slack = squares(x, held["x"])
            reach = np.sqrt(np.maximum(np.partition(far, k - 1, axis=1)[:, k - 1] + slack, 0.0)) * (1 + 1e-9)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(rows["block"], pa.int32()), "id": pa.array(rows["id"]), "x": lists(x), "s": lists(rows["s"]), "reach": pa.array(reach),
        })

    def search(held: Held, rows: Held) -> Iterator[pa.RecordBatch]:
        far, slack = squares(rows["x"], held["x"])
        limit = rows["reach"] ** 2
        near = far <= (limit + slack)[:, None]
        if near.sum() > 64 * k * len(far) and len(held["x"]) > k:
            near = far <= (np.minimum(limit, np.partition(far, k - 1, axis=1)[:, k - 1] + slack) + slack)[:, None]
        i, j = np.nonzero(near)
        dist = euclidean(rows["x"][i], held["x"][j])
        v, o = rows["id"][i], held["id"][j]
        order = np.lexsort((o, dist, i))
        rank = np.arange(len(i)) - np.searchsorted(i, i)  # i is in order
        first = order[rank < k]
        yield pa.RecordBatch.from_pydict({"v": pa.array(v[first]), "o": pa.array(o[first]), "dist": pa.array(dist[first])})

    held = blocks.rows.select("block", "id", "x")
    bounded = land(met(held, blocks.rows.select("block", "id", "x", "s"), bound, f"block int, id {kind}, x array<double>, s array<double>, reach double"), "bounded")
    return met(held, visits(bounded, blocks, "reach"), search, f"v {kind}, o {kind}, dist double")


def lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def within(points: DataFrame, eps: float, width: int, block_rows: int | None = None) -> DataFrame:
    """``(a, b, wa, wb, dist)`` with ``a < b`` for all pairs of ``points(id, x, w)`` within a Manhattan distance of ``eps``."""
    points = land(points.select("id", "x", "w"), "points")
    blocks = dealt(points, width, False, block_rows)
    id, w = (dict(points.dtypes)[c] for c in ("id", "w"))

    def pairs(held: Held, rows: Held) -> Iterator[pa.RecordBatch]:
        dist = manhattan(rows["x"], held["x"])
        mine, theirs = rows["id"][:, None], held["id"]
        kept = (dist <= eps) & np.where((rows["home"] == held["block"][0])[:, None], mine < theirs, mine != theirs)
        i, j = np.nonzero(kept)
        first = rows["id"][i] < held["id"][j]
        order = lambda c: (np.where(first, rows[c][i], held[c][j]), np.where(first, held[c][j], rows[c][i]))
        (a, b), (wa, wb) = order("id"), order("w")
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "wa": pa.array(wa), "wb": pa.array(wb), "dist": pa.array(dist[i, j])})

    queries = visits(blocks.rows.select("block", "id", "w", "x", "s"), blocks, float(eps), later=True)
    return met(blocks.rows.select("block", "id", "w", "x"), queries, pairs, f"a {id}, b {id}, wa {w}, wb {w}, dist double")


def reached(dist: np.ndarray, eps: Sequence[float]) -> np.ndarray:
    """Place of the first radius that covers each distance, one past the last if none does."""
    level = np.zeros(dist.shape, np.uint8 if len(eps) < 255 else np.int32)
    for e in eps:
        level += dist > e
    return level


def forest(weight: np.ndarray, never: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``(place, place, weight)`` that connect what a graph between rows and columns does, at every weight below ``never``.

    Columns are numbered behind the rows. A column stands for the row that is nearest to it; what else it is linked
    to is then linked with that row, so a tree over the rows is left to find.
    """
    best = weight.argmin(axis=0)
    least = weight[best, np.arange(weight.shape[1])]
    columns = np.flatnonzero(least < never)
    if not len(columns):
        none = np.zeros(0, np.int64)
        return none, none, none
    order = columns[np.argsort(best[columns], kind="stable")]
    heads, starts = np.unique(best[order], return_index=True)
    rows = np.full((len(weight), len(weight)), never, np.int64)
    rows[:, heads] = np.minimum.reduceat(weight[:, order], starts, axis=1)
    rows = np.minimum(rows, rows.T)
    out = [(columns + len(weight), best[columns], least[columns].astype(np.int64))]
    todo, near, via = np.ones(len(rows), bool), np.full(len(rows), never), np.zeros(len(rows), np.int64)
    ends = []
    while todo.any():
        at = int(np.where(todo, near, never + 1).argmin())
        if near[at] < never:
            ends.append((at, via[at], near[at]))
        todo[at] = False
        closer = todo & (rows[at] < near)
        near[closer], via[closer] = rows[at][closer], at
    if ends:
        out.append(tuple(np.array(c, np.int64) for c in zip(*ends)))
    return tuple(np.concatenate(c) for c in zip(*out))
