"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.llm.shared import beside, of_row, same, stored, text_of, word_count


def _seeded(seed: int, *parts: Column) -> Column:
    """MD5 of the seed and the parts; null counts as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def apportion(parts: DataFrame, groups: Sequence[str], value: str, seats: str, order: Sequence[Column], out: str) -> DataFrame:
    """Whole seats for the parts of each group by highest quotients v / (2k - 1).

    A part has k seats when its k-th quotient is among the highest. Instead of
    listing the quotients, the lowest quotient that wins is found by halving an
    interval over the list of the group's values, and the few seats left go to
    the next highest quotients, ties by ``order``. One row per part is held,
    never one per seat. Groups without value or seats get none.
    """

    def won(v: Column, least: Column) -> Column:
        return F.floor((v / least + 1) / 2)

    def all_won(values: Column, least: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda n, v: n + won(v, least))

    lists = parts.groupBy(*groups).agg(
        F.collect_list(F.col(value).cast("double")).alias("_values"), F.max(seats).alias("_seats"), F.sum(value).cast("double").alias("_all")
    )
    bounds = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.struct(
            (F.col("_all") / (F.col("_seats") * 2 + F.size("_values"))).alias("low"),
            (F.array_max("_values") * 2).alias("high"),
        ),
        lambda b, _: F.when(
            all_won(F.col("_values"), (b["low"] + b["high"]) / 2) <= F.col("_seats"),
            F.struct(b["low"].alias("low"), ((b["low"] + b["high"]) / 2).alias("high")),
        ).otherwise(F.struct(((b["low"] + b["high"]) / 2).alias("low"), b["high"].alias("high"))),
    )
    least = lists.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.when((F.col("_all") > 0) & (F.col("_seats") > 0), bounds["high"]).alias("_least"),
    )
    on = F.lit(True)
    for i, g in enumerate(groups):
        on = on & same(F.col(g), F.col(f"_g{i}"))
    first = parts.join(least, on).withColumn("_won", F.coalesce(won(F.col(value).cast("double"), F.col("_least")), F.lit(0)))
    whole = W.partitionBy(*groups)
    nexts = W.partitionBy(*groups).orderBy((F.col(value) / (F.col("_won") * 2 + 1)).desc(), *order)
    return (
        first.withColumn("_left", F.when(F.col("_least").isNull(), F.lit(0)).otherwise(F.col(seats) - F.sum("_won").over(whole)))
        .withColumn(out, F.col("_won") + F.when(F.row_number().over(nexts) <= F.col("_left"), 1).otherwise(0))
        .select(*parts.columns, F.col(out).cast("long"))
    )


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Words wanted of each source: ``source, source_size, target``.

    Sources in code-point order (null last) take the weights in turn and share
    the sum of all sizes. No target passes ``cap`` times its source's size; the
    excess is shared again by weight until none is above. The result is the
    level at which weights times level, cut at the caps, add up to the whole.
    One row per source is put in order, however many documents there are.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per.withColumn("_nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_nth") - 1) % len(weights) + 1).cast("int"))
    capped = numbered.withColumn("_w", share).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_level = W.orderBy(F.col("_cap") / F.col("_w"), "_nth")
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = (
        capped.withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_rank", F.row_number().over(by_level))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_fits", F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_rank")))
        .withColumn("_from", F.min("_fits").over(every))
        .withColumn("_at", F.max(F.when(F.col("_rank") == F.col("_from"), F.col("_level"))).over(every))
    )
    target = F.when(F.col("_rank") < F.col("_from"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_at")))
    return levels.select("source", "source_size", target.alias("target"))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    block_words: int = 16,
    shard_words: int = 1_000_000,
    seed: int = 7,
) -> DataFrame:
    """Words that the mix takes of each document.

    The words of each source lie in shards of about ``shard_words`` words, each
    a row of equal blocks in a seeded order of documents. Blocks of the whole
    mix are apportioned to sources, then those of a source to its shards. A
    shard takes whole passes as often as its quota allows and then a seeded,
    evenly spaced choice of blocks. Where a block lies is known from prefix
    sums, so blocks are never listed.

    Returns ``doc_id, source, size, source_size, target, taken`` and ``copies``,
    the number of whole documents that stand for the words taken; equal rows
    give equal results, null texts have size 0, null is a source of its own,
    and an empty table gives no rows. No document is taken beyond ``cap`` times.
    """
    sizes = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(text_of(text_col)).alias("size")
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, cap)
    seats = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    targets = targets.withColumn("_seats", F.round(F.sum("source_size").over(seats) / block_words).cast("long")).withColumn("_one", F.lit(0))
    quotas = stored(
        apportion(targets, ["_one"], "target", "_seats", [F.col("source").asc_nulls_last()], "_quota").select(
            F.col("source").alias("_source"), "source_size", "target", "_quota", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).alias("_shards")
        ),
        "mix-quotas",
    )
    digest = _seeded(seed, F.col("doc_id"))
    placed = (
        sizes.join(quotas, same(F.col("source"), F.col("_source")))
        .withColumn("_order", digest)
        .withColumn("_shard", _number(F.col("_order")) % F.col("_shards"))
    )
    shards = placed.groupBy("_source", "_shard").agg(F.sum("size").alias("_size"), F.max("_quota").alias("_quota"))
    b = F.lit(block_words)
    wanted = F.least(F.col("_blocks") * b, (F.col("_size") * F.lit(float(cap))).cast("long"))
    chosen = (
        apportion(shards, ["_source"], "_size", "_quota", [F.col("_shard")], "_blocks")
        .withColumn("_want", wanted)
        .withColumn("_n", F.greatest(F.ceil(F.col("_size") / b), F.lit(1)))
        .withColumn("_passes", F.when(F.col("_size") > 0, F.floor(F.col("_want") / F.col("_size"))).otherwise(0))
        .withColumn("_rest", F.least(F.round((F.col("_want") - F.col("_passes") * F.col("_size")) / b).cast("long"), F.col("_n")))
        .withColumn("_start", _number(_seeded(seed, F.col("_source"), F.col("_shard"))) % F.col("_n"))
        .select(F.col("_source").alias("_s"), F.col("_shard").alias("_h"), "_n", "_passes", "_rest", "_start")
    )
    along = W.partitionBy("source", "_shard").orderBy("_order", "doc_id", "size")
    offsets = placed.withColumn("_end", F.sum("size").over(along.rowsBetween(W.unboundedPreceding, 0))).join(
        chosen, same(F.col("_source"), F.col("_s")) & (F.col("_shard") == F.col("_h"))
    )

    def blocks_before(j: Column) -> Column:
        return F.floor((j * F.col("_rest") + F.col("_start")) / F.col("_n"))

    def words_before(x: Column) -> Column:
        j = F.floor(x / b)
        return blocks_before(j) * b + (blocks_before(j + 1) - blocks_before(j)) * (x % b)

    taken = F.col("_passes") * F.col("size") + words_before(F.col("_end")) - words_before(F.col("_end") - F.col("size"))
    shared = offsets.withColumn("taken", taken.cast("long")).withColumn("_share", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0)))
    # Shares add up along the shard from a seeded start; a document gets the whole numbers that its own share passes.
    begin = (F.col("_start") % 1024) / F.lit(1024.0)
    before = F.coalesce(F.sum("_share").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    copies = F.floor(begin + before + F.col("_share")) - F.floor(begin + before)
    return shared.select("doc_id", "source", "size", "source_size", "target", "taken", copies.cast("int").alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, **options) -> DataFrame:
    """The mix as whole documents: rows of ``docs``, each as often as the plan takes it.

    Shares taken / size are added up along each shard, and a document is
    repeated by the whole numbers passed between the sum before and after it:
    by the whole part of its share or one more, and each shard by its sum of
    shares within one document. Documents without words are not in the mix.
    Rows of equal id and size are each repeated as often as the one that the
    plan takes most. Columns are those of ``docs``; an empty table stays empty.
    """
    plan = plan_mix(docs, id_col, text_col, seed=seed, **options)
    copies = plan.groupBy(F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_size")).agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = beside(docs, id=F.col(f"`{id_col}`"), size=word_count(text_of(text_col)))
    joined = rows.join(copies, same(F.col("id"), F.col("mix_id")) & (F.col("size") == F.col("mix_size")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*of_row(docs))
