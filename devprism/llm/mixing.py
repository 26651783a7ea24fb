"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in a random order, lie on a line that may be read twice. The
source's quota is the first ``target`` words of that line, cut into blocks. A binary tree over the
output shards splits the block quotas of all sources: at each node the left half gets as many
blocks as it has room for, and how many of each source is a multivariate hypergeometric draw. The
leaves say how many blocks of a source a shard gets; which ones is a permutation of the source's
blocks. So each block is in one shard, quotas are exact, and no table of all words is ever drawn.

Everything is DataFrame and SQL operations. Random numbers are hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from devprism.llm.common import pick
from devprism.runtime import land

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeated.
WEIGHTS = (3.0, 1.0, 2.0)


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, source_rank, target`` from rows ``(source, size)``.

    ``share`` times all words are dealt by weight; a target stops at ``most`` times its source and the
    excess goes to the others by weight. Sources in the order of ``most * size / weight`` reach their
    stop one after the other, so one ordered pass finds those that do. The windows run over one row
    per source, the size of the mix's own settings, not of the data.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    ranked = per.withColumn("source_rank", rank).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    )
    total, all_weights = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    filling = Window.orderBy(F.lit(most) * F.col("source_size") / F.col("weight"), "source_rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    stopped_size = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left_weight = all_weights - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    stops = F.lit(most) * F.col("source_size") * left_weight <= F.col("weight") * (F.lit(share) * total - F.lit(most) * stopped_size)
    marked = ranked.withColumn("stops", stops).withColumn("total", total)
    everyone = Window.partitionBy()
    open_weight = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everyone)
    open_words = F.lit(share) * F.col("total") - F.lit(most) * F.coalesce(F.sum(F.when(F.col("stops"), F.col("source_size"))).over(everyone), F.lit(0))
    target = F.when(F.col("stops"), F.lit(most) * F.col("source_size")).otherwise(F.col("weight") * (open_words / open_weight))
    return marked.withColumn("target", target.cast("double")).select("source", "source_size", "source_rank", "target")


def _uniform(*parts: str) -> str:
    return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) / 9007199254740992D)"


def hypergeometric(total: str, marked: str, drawn: str, *seed: str) -> str:
    """SQL of a draw: how many of ``drawn`` items are among the ``marked`` of ``total``.

    One pass over the possible values keeps the logarithm of their probabilities' sum and replaces the
    pick with the share that the new value has in it.
    """
    low, high = f"greatest(0L, {drawn} - ({total} - {marked}))", f"least({marked}, {drawn})"
    weight = f"a.w + ln(({marked} - x + 1D) * ({drawn} - x + 1D) / (x * ({total} - {marked} - {drawn} + x)))"
    whole = "greatest(a.t, {w}) + log1p(exp(-abs(a.t - ({w}))))".format(w=weight)
    return (
        f"aggregate(if({high} > {low}, sequence({low} + 1, {high}), array()), named_struct('w', 0D, 't', 0D, 'pick', {low}), "
        f"(a, x) -> named_struct('w', {weight}, 't', {whole}, 'pick', if({_uniform(*seed, 'x')} < exp({weight} - ({whole})), x, a.pick)), a -> a.pick)"
    )


def split_blocks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``source_rank, block, shard``: every block of ``quotas(source_rank, blocks)`` in one shard."""
    by_rank = F.array_sort(F.collect_list(F.struct("source_rank", "blocks")))
    # One row per source becomes one root row; the tree then works on rows of its nodes.
    node = quotas.agg(by_rank.alias("q")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.expr("transform(q, s -> s.source_rank)").alias("ranks"), F.expr("transform(q, s -> s.blocks)").alias("quota"),
        F.expr("aggregate(q, 0L, (a, s) -> a + s.blocks)").alias("all_blocks"),
    )
    room = "(shiftright(lo + hi, 1) * all_blocks div {n} - lo * all_blocks div {n})".format(n=shards)
    draw = hypergeometric("s.n", "k", "s.l", str(seed), "lo", "hi", "size(s.left)")
    left = (
        f"aggregate(quota, named_struct('n', aggregate(quota, 0L, (b, k) -> b + k), 'l', {room}, 'left', cast(array() as array<bigint>)), "
        f"(s, k) -> transform(array({draw}), d -> named_struct('n', s.n - k, 'l', s.l - d, 'left', array_append(s.left, d)))[0], s -> s.left)"
    )
    for _ in range(max(0, (shards - 1).bit_length())):
        node = node.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.expr(left)).otherwise(F.col("quota"))).select(
            "ranks", "all_blocks",
            F.expr(
                "inline(if(hi - lo > 1, array(named_struct('lo', lo, 'hi', shiftright(lo + hi, 1), 'quota', left), "
                "named_struct('lo', shiftright(lo + hi, 1), 'hi', hi, 'quota', zip_with(quota, left, (q, l) -> q - l))), "
                "array(named_struct('lo', lo, 'hi', hi, 'quota', quota))))"
            ),
        )
    leaves = node.select(F.col("lo").alias("shard"), F.expr("inline(arrays_zip(ranks, quota))")).withColumnRenamed("ranks", "source_rank")
    ahead = Window.partitionBy("source_rank").orderBy("shard")
    dealt = leaves.withColumn("after", F.sum("quota").over(ahead)).filter("quota > 0")
    dealt = dealt.select("source_rank", "shard", F.expr("explode(sequence(after - quota, after - 1))").alias("turn"))
    blocks = quotas.filter("blocks > 0").select("source_rank", F.expr("explode(sequence(0L, blocks - 1))").alias("block"))
    order = Window.partitionBy("source_rank").orderBy(F.xxhash64(F.lit(seed), "source_rank", "block"), "block")
    turns = blocks.withColumn("turn", (F.row_number().over(order) - 1).cast("bigint"))
    return turns.join(dealt, ["source_rank", "turn"]).select("source_rank", "block", "shard")


def mix(
    docs: DataFrame, shards: int = 16, blocks_per_shard: int = 64, seed: int = 9, bucket_rows: int = 4096,
    weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, keep: dict[str, str] | None = None,
) -> DataFrame:
    """``doc_id, text, source`` with ``size, source_size, target, pieces``; a piece is ``(pass, block, shard, from_word, words)``.

    ``keep`` names further columns of ``docs`` to carry, with their types; no others are read, so clashing
    names do no harm. Documents are ordered within their source by md5 of id and size; a hot source is
    split into buckets of about ``bucket_rows`` documents, whose sizes are summed before the one shuffle
    of the documents. Null texts have size 0 and no pieces, a null source is a source of its own,
    repeated rows are separate documents, an empty table gives an empty result. Blocks are bounded by
    ``shards * blocks_per_shard`` and one part block per source. ``most`` may not exceed 2: the line is
    read at most twice.
    """
    docs = pick(docs, doc_id="bigint", text="string", source="string", **(keep or {}))
    buckets = max(1, -(-docs.count() // bucket_rows))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    sized = docs.withColumn("size", size_of(F.col("text"))).withColumn("_key", key).withColumn("_source", named)
    sized = sized.withColumn("_bucket", F.expr(f"cast(conv(substring(_key, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296"))
    line = land(sized.groupBy("source", "_source", "_bucket").agg(F.sum("size").alias("size")), "mix_buckets")
    targets = source_targets(line, weights, share, most)
    block_words = F.greatest(F.lit(1), F.ceil(F.sum("target").over(Window.partitionBy()) / (shards * blocks_per_shard))).cast("bigint")
    plan = targets.withColumn("_quota", F.round("target").cast("bigint")).withColumn("_words", block_words)
    plan = plan.withColumn("blocks", F.ceil(F.col("_quota") / F.col("_words")).cast("bigint"))
    split = split_blocks(plan.select("source_rank", "blocks"), shards, seed)
    shard_of = split.groupBy("source_rank").agg(F.expr("transform(array_sort(collect_list(struct(block, shard))), b -> b.shard)").alias("_shards"))
    plan = plan.join(shard_of, "source_rank", "left").select(
        named.alias("_source"), "source_size", "target", "_quota", "_words", "_shards",
    )
    line = line.select("_source", "_bucket", F.col("size").alias("_sum"))
    line = line.withColumn("_start", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_sum")).join(plan, "_source")
    # A bucket carries the shards of the blocks it touches on either pass, not those of its whole source.
    for p in (0, 1):
        first, last = f"(_start + {p} * source_size) div _words", f"least(_start + _sum + {p} * source_size, _quota) div _words"
        line = line.withColumn(f"_first{p}", F.expr(first)).withColumn(
            f"_shards{p}", F.expr(f"if(_quota > _start + {p} * source_size, slice(_shards, cast({first} + 1 as int), cast({last} - {first} + 1 as int)), cast(array() as array<int>))")
        )
    line = line.drop("_shards", "_sum")
    rows = sized.join(line, ["_source", "_bucket"])
    turn = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_at", F.col("_start") + F.sum("size").over(turn) - F.col("size"))
    pieces = []
    for p in (0, 1):
        start = f"(_at + {p} * source_size)"
        end = f"least({start} + size, _quota)"
        pieces.append(
            f"if({end} > {start}, transform(sequence({start} div _words, ({end} - 1) div _words), b -> named_struct('pass', {p}, 'block', b, "
            f"'shard', _shards{p}[cast(b - _first{p} as int)], 'from_word', greatest(b * _words, {start}) - {start}, "
            f"'words', least((b + 1) * _words, {end}) - greatest(b * _words, {start}))), array())"
        )
    return rows.withColumn("pieces", F.expr(f"concat({pieces[0]}, {pieces[1]})")).select(*docs.columns, "size", "source_size", "target", "pieces")


def taken(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda a, p: a + p["words"])


def shard_rows(mixed: DataFrame, seed: int = 9) -> DataFrame:
    """One row per piece of ``mix``: rows of a shard together, in random order within it."""
    rows = mixed.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")
    return rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "block", "doc_id", "pass"))
