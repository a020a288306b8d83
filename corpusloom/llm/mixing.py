"""Mixing sources to target weights by hash-threshold histograms, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.shared import stash

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
LEVELS = 4
HASH_BITS = LEVEL_BITS * LEVELS


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null; white space is U+0020 and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(key: Column) -> Column:
    """A portable 48-bit hash of a key: the first 12 hexadecimal digits of its MD5."""
    hexed = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(hexed, 1, HASH_BITS // 4), 16, 10).cast("long")


def cycled_weights(cycle: tuple[int, ...]) -> Column:
    """Weight by rank among sources: the values of `cycle`, again and again."""
    at = (F.col("_rank") - 1) % F.lit(len(cycle))
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in cycle]), (at + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """`_source, _source_size` -> the same with `_target`: shares by weight, capped at `most` x size.

    What caps leave over is shared again by weight among the rest.  Sources ordered by
    size / weight reach their cap in that order, so one pass over running sums finds the
    level at which the rest stops; there are as many rows here as sources.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn("_w", cycled_weights(weights))
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("_source_size") / F.col("_w")), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_wanted") - most * F.coalesce(F.sum("_source_size").over(before), F.lit(0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    )
    leveled = ranked.withColumn("_wanted", F.sum("_source_size").over(everything) * F.lit(float(share))).withColumn("_level", level)
    fits = F.col("_level") * F.col("_w") <= most * F.col("_source_size").cast("double")
    stop = F.min(F.when(fits, F.struct(F.col("_source_size") / F.col("_w"), F.col("_rank"), F.col("_level")))).over(everything)
    cap = most * F.col("_source_size").cast("double")
    return leveled.withColumn("_stop", stop["_level"]).select(
        "_source", "_source_size", F.when(F.col("_stop").isNull(), cap).otherwise(F.least(F.col("_stop") * F.col("_w"), cap)).alias("_target")
    )


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix_plan(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """`_source, _size, _hash` of all documents -> `_source, _source_size, _target, _copies, _bound` of each source."""
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    targets = source_targets(sizes, weights, share, most)
    whole = F.when(F.col("_source_size") > 0, F.least(F.floor(F.col("_target") / F.col("_source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("_copies", whole).withColumn("_need", F.col("_target") - F.col("_copies") * F.col("_source_size"))
    plan = stash(plan.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_done", F.lit(0).cast("long")), "mix-plan")
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        bucket = F.shiftright("_hash", shift)
        inside = rows.alias("r").join(plan.select(F.col("_source").alias("_s"), "_prefix"), same("_source", "_s"))
        inside = inside.filter(F.shiftright("_hash", shift + LEVEL_BITS) == F.col("_prefix"))
        counts = inside.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_size").alias("_words"))
        upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = counts.withColumn("_upto", F.sum("_words").over(upto)).withColumnRenamed("_source", "_s")
        # The bucket in which the budget ends: the first whose running sum reaches it, else one past the last.
        left = F.col("_need") - F.col("_done")
        hit = plan.join(sums, same("_source", "_s"), "left").groupBy(*plan.columns).agg(
            F.min(F.when(F.col("_upto") >= left, F.struct("_bucket", "_upto", "_words"))).alias("_hit"), F.max("_upto").alias("_all")
        )
        end = F.shiftleft(F.col("_prefix"), LEVEL_BITS) + F.lit((1 << LEVEL_BITS) - 1)
        plan = hit.select(
            *[c for c in plan.columns if c not in ("_prefix", "_done")],
            F.coalesce(F.col("_hit._bucket"), end).alias("_prefix"),
            (F.col("_done") + F.coalesce(F.col("_hit._upto") - F.col("_hit._words"), F.lit(0))).alias("_done"),
            F.coalesce(F.col("_hit._words"), F.lit(0)).alias("_last"),
        )
        if level < LEVELS:
            plan = plan.drop("_last")
        plan = stash(plan, f"mix-level{level}")
    # One hash value is left: all rows that share it are in or out, whichever comes nearer.
    gap = F.col("_need") - F.col("_done")
    plan = plan.withColumn("_bound", F.when((gap > 0) & (2 * gap >= F.col("_last")), F.col("_prefix") + 1).otherwise(F.col("_prefix")))
    plan = plan.withColumn("_bound", F.when(F.col("_need") > 0, F.col("_bound")).otherwise(F.lit(0)))
    return plan.select("_source", "_source_size", "_target", "_copies", "_bound")


def copies(most: int):
    """Copies of a document in the mix, by its source's plan."""
    return F.col("_copies") + ((F.col("_hash") < F.col("_bound")) & (F.col("_copies") < most)).cast("long")


def sized(docs: DataFrame, key: str, source: str, text: str, *more: str) -> DataFrame:
    return docs.select(
        *more, F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"), mix_hash(F.col(key)).alias("_hash")
    )


def taken_words(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row for each input row: `key`, `size` (words), `source_size`,
    `target` (of its source) and `taken` (words, repeats counted).  A source whose
    target is m times its size and a rest takes each document m times, and once
    more those whose hash lies below a threshold.  The threshold is found without
    sorting: words are summed by source and hash bucket, the bucket in which the
    budget ends is refined in the next level, four levels of 4096 buckets in all.

    Null text has size 0; a null source is a source of its own, last in order; null
    keys and repeated rows share a hash and are taken together, up to the nearer
    side of the budget; texts of any length are counted whole; sources of one name are one
    source; an empty table gives an empty result.  `most` bounds the
    copies of a document.  Other columns of the input don't take part, whatever their names.
    """
    rows = stash(sized(docs, key, source, text), "mix-rows")
    plan = mix_plan(rows, weights, share, most).withColumnRenamed("_source", "_s")
    return rows.join(plan, same("_source", "_s")).select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * copies(most)).alias("taken"),
    )


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """The documents of the mix, once each, with `copies` (1 or more) and `taken` (words); see `taken_words`.

    All columns of `docs` stay; where one has such a name, the new one gets an underscore more.
    """
    rows = stash(sized(docs, key, source, text), "mix-rows")
    plan = mix_plan(rows, weights, share, most).withColumnRenamed("_source", "_s")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(key).alias("_k"), F.col(source).alias("_from"), F.col(text).alias("_t"))
    picks = sized(wide, "_k", "_from", "_t", "_doc").join(plan, same("_source", "_s")).withColumn("_n", copies(most)).filter("_n > 0")
    added = {"copies": F.col("_n"), "taken": F.col("_size") * F.col("_n")}
    names = []
    for name in added:
        while name in docs.columns:
            name += "_"
        names.append(name)
    return picks.select("_doc.*", *[c.alias(n) for n, c in zip(names, added.values(), strict=True)])
