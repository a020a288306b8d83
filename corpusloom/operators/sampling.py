"""Ratios, allocations and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratios(counts: DataFrame) -> DataFrame:
    """`lang, discipline, n` -> share of the language and of the discipline in it, rounded to 4 places."""
    by_lang, all_ = Window.partitionBy("lang"), Window.partitionBy()
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    share = langs.withColumn("lang_ratio", F.bround(F.col("lang_n").cast("double") / F.sum("lang_n").over(all_), 4))
    inner = counts.withColumn("discipline_ratio", F.bround(F.col("n").cast("double") / F.sum("n").over(by_lang), 4))
    return inner.join(share, "lang")


def allocation(table: DataFrame, size: int) -> DataFrame:
    """Sample sizes in proportion: by language, then by discipline with one at least; a missing ratio counts as 0."""
    lang_n = F.bround(F.lit(size) * F.coalesce("lang_ratio", F.lit(0.0))).cast("long")
    return table.withColumn("lang_sample", lang_n).withColumn(
        "sample", F.greatest(F.bround(F.col("lang_sample") * F.coalesce("discipline_ratio", F.lit(0.0))).cast("long"), F.lit(1))
    )


def balanced_quotas(available: dict[str, int], total: int) -> dict[str, int]:
    """Equal shares, capped by what there is; the rest goes one each per turn, fullest first.

    Raises ValueError if there are fewer than `total`.
    """
    if sum(available.values()) < total:
        raise ValueError(f"{total} rows wanted, {sum(available.values())} available")
    quotas = {k: min(total // len(available), n) for k, n in available.items()} if available else {}
    rest = total - sum(quotas.values())
    while rest:
        open_ = [k for k in sorted(available, key=lambda k: quotas[k] - available[k]) if quotas[k] < available[k]][:rest]
        for k in open_:
            quotas[k] += 1
        rest -= len(open_)
    return quotas


def order_key(seed: int, key: Column) -> Column:
    """A portable random order: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), key.cast("string")).cast("binary"))


def balanced_sample(df: DataFrame, stratum: str, strata: list[str], total: int, key: str, seed: int = 42) -> DataFrame:
    """`total` rows spread evenly over the given strata, drawn by `order_key`, with `quota` of their stratum.

    Only the counts by stratum come to the driver.  The limit by rank is pushed below the
    shuffle by the grouped-limit rule, so a stratum of any size sends few rows on.
    """
    counts = {r[0]: r[1] for r in df.filter(F.col(stratum).isin(strata)).groupBy(stratum).count().collect()}
    quotas = balanced_quotas({s: counts.get(s, 0) for s in dict.fromkeys(strata)}, total)
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum))
    order = Window.partitionBy(stratum).orderBy(order_key(seed, F.col(key)), key)
    drawn = df.filter(F.col(stratum).isin(strata)).withColumn("_rank", F.row_number().over(order))
    return drawn.filter(F.col("_rank") <= max([0, *quotas.values()])).withColumn("quota", quota).filter(F.col("_rank") <= F.col("quota")).drop("_rank")


def take_until(df: DataFrame, success: Column, order: list[Column], target: int) -> DataFrame:
    """Successful rows in order until there are `target`; the running count is a limit on sorted successes."""
    return df.filter(success).orderBy(*order).limit(target)


def circuit_breaker(attempts: DataFrame, domain: str, failed: Column, order: list[str], patience: int = 3) -> DataFrame:
    """Attempts with `fails_before` (failures less successes of the domain so far) and whether the attempt is skipped.

    A domain is skipped once its count has reached `patience`; skipped attempts don't count.
    Since nothing counts after that, a domain's attempts after the first time it gets there
    are all skipped, which a running maximum of the running sum tells.
    """
    w = Window.partitionBy(domain).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = attempts.withColumn("_d", F.when(failed, 1).otherwise(-1)).withColumn("_sum", F.coalesce(F.sum("_d").over(w), F.lit(0)))
    here = Window.partitionBy(domain).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = run.withColumn("_peak", F.max("_sum").over(here))
    return peak.select(*attempts.columns, F.least(F.col("_sum"), F.lit(patience)).alias("_f"), (F.col("_peak") >= patience).alias("skipped")).withColumn(
        "fails_before", F.when(F.col("skipped"), patience).otherwise(F.col("_f"))
    ).drop("_f")
