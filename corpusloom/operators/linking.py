"""Joining documents, chunks, links and the outputs of several models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.evaluate import exact_percentile, ratio
from corpusloom.shared import dealt_by, stash


def confident_links(links: DataFrame, limit: float = 0.8) -> DataFrame:
    """Links above `limit` with a document, an entity and a chunk number that is whole and not negative."""
    chunk = F.col("chunk_idx").cast("string").try_cast("int")
    truthy = F.col("linked_entity").isNotNull() & (F.col("linked_entity") != "")
    return links.filter((F.coalesce("confidence", F.lit(0.0)) > limit) & F.col("doc_id").isNotNull() & truthy & (chunk >= 0)).withColumn("chunk_idx", chunk)


def first_chunk(entity: Column, chunks: Column) -> Column:
    """Number of the first chunk that contains the entity's surface, null if none does."""
    return F.nullif(F.array_position(F.transform(chunks, lambda c: F.contains(c, entity)), F.lit(True)), F.lit(0)) - 1


def with_first_chunk(docs: DataFrame, links: DataFrame, doc_key: str = "id", link_key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Links with `chunk_idx`, and those whose surface no chunk of their document contains; both come from one join, which is written."""
    at = docs.select(F.col(doc_key).alias("_id"), F.col("text").alias("_chunks")).join(links, F.col("_id") == F.col(link_key))
    placed = stash(at.withColumn("chunk_idx", first_chunk(F.col("entity_text"), F.col("_chunks")).cast("int")).drop("_id", "_chunks"), "first_chunk")
    return placed.filter("chunk_idx is not null"), placed.filter("chunk_idx is null")


def collected(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Values of each key as one array, in the given order."""
    pairs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))).alias("_l"))
    return pairs.select(*keys, F.transform("_l", lambda p: p["_v"]).alias(name))


def chunks_with_links(chunks: DataFrame, links: DataFrame, order: list[str]) -> DataFrame:
    """Every chunk with the entities linked in it, in input order, an empty array where there is none."""
    lists = collected(links, ["doc_id", "chunk_idx"], order, F.col("linked_entity"), "linked")
    return chunks.join(lists, ["doc_id", "chunk_idx"], "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<string>")))


def last_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last in order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def predictions_with_sources(predictions: DataFrame, sources: DataFrame, order: list[str], key: str = "doc_id") -> DataFrame:
    """Predictions joined to their source document; of sources with one id the last counts."""
    return predictions.join(last_by_key(sources, [key], order), key)


def merged_outputs(left: DataFrame, right: DataFrame, models: list[str], key: str = "doc_id") -> DataFrame:
    """Rows of `left`; those of the given models take all columns of the row of `right` with their id, where there is one."""
    r = right.select(F.col(key).alias("_key"), F.struct(*left.columns).alias("_r"))
    joined = left.select(F.col(key).alias("_own"), F.struct(*left.columns).alias("_l")).join(r, F.col("_own") == F.col("_key"), "left")
    return joined.select(F.when(F.col("_l.model").isin(models) & F.col("_key").isNotNull(), F.col("_r")).otherwise(F.col("_l")).alias("_o")).select("_o.*")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with `idx`, each row's place in the given order, from 0.

    Rows are dealt out by range and written; a row's place is its place in its range plus the
    counts of the ranges before, so no task sees all rows.  Ties of `order` count in any order.
    """
    ranges = stash(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_r")) - F.col("_n"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranges.withColumn("_inside", inside).join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
    return placed.withColumn("idx", (F.col("_before") + F.col("_inside") - 1).cast("long")).drop("_range", "_r", "_n", "_before", "_inside")


def interleaved(left: DataFrame, right: DataFrame, order: list[str]) -> DataFrame:
    """Rows of two tables by position, left first, as far as the shorter goes: `idx, side` and the columns."""
    n = F.least(*[F.lit(df.count()) for df in (left, right)])
    sides = [numbered(df, order).withColumn("side", F.lit(i)) for i, df in enumerate((left, right))]
    return sides[0].unionByName(sides[1]).filter(F.col("idx") < n)


def unfinished(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs whose key has no output yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def linkability(entities: DataFrame, links: DataFrame, models: list[str], dims: list[str] | None = None, share: float = 0.4) -> DataFrame:
    """Share of entities that are linked, at all and at the linker confidence of its top `share`.

    Both tables have `model, rec, chunk, text` (links no model, but `confidence`); an entity
    row without text says that its model saw the chunk and found nothing.  Only chunks that
    all `models` and the links have count: `aligned_chunks` (not by `dims`).  The threshold
    is the model's percentile of its links' confidence.

    One shuffle by chunk, into a number of tasks that grows with the input, brings both tables
    together; windows over it find the common chunks and each surface's best link, and the
    result is written once for threshold and counts, which are dealt out in the same way.
    """
    dims = dims or []
    chunk = ["rec", "chunk"]
    own = entities.filter(F.col("model").isin(models)).select(*chunk, "text", "model", *dims, F.lit(None).cast("double").alias("_c"), F.lit(0).alias("_is_link"))
    found = links.select(*chunk, "text", F.lit(None).cast("string").alias("model"), *[F.lit(None).cast("string").alias(d) for d in dims], F.col("confidence").cast("double").alias("_c"), F.lit(1).alias("_is_link"))
    w = Window.partitionBy(*chunk)
    seen = dealt_by(own.unionByName(found), *chunk).select(
        "*", F.size(F.collect_set("model").over(w)).alias("_models"), F.max("_is_link").over(w).alias("_any"), F.max("_c").over(Window.partitionBy(*chunk, "text")).alias("_conf")
    )
    common = seen.filter((F.col("_is_link") == 0) & (F.col("_models") == len(set(models))) & (F.col("_any") == 1))
    tied = stash(common.select(*chunk, "model", *dims, "text", F.when(F.col("text").isNotNull(), F.col("_conf")).alias("_conf")), "linkability")
    limits = exact_percentile(tied, ["model"], "_conf", 1 - share, "threshold").withColumnRenamed("model", "_model")
    marked = tied.join(F.broadcast(limits), F.col("model") == F.col("_model"), "left")  # a row for each model
    top = F.sum(F.when(F.col("_conf") >= F.col("threshold"), 1).otherwise(0))
    per = dealt_by(marked, *chunk).groupBy("model", *dims, *chunk).agg(F.count("text").alias("n"), F.count("_conf").alias("k"), top.alias("t"), F.max("threshold").alias("threshold"))
    yes = lambda c: F.sum((F.col(c) > 0).cast("long"))
    aligned = [] if dims else [F.count(F.lit(1)).alias("aligned_chunks")]
    out = per.groupBy("model", *dims).agg(
        *aligned, yes("n").alias("chunks_with_entities"), yes("k").alias("chunks_with_any_linked_entity"), F.sum("n").alias("total_entities"), F.sum("k").alias("linked_entities"),
        F.sum("t").alias("linked_entities_top"), F.max("threshold").alias("threshold"),
    )
    return out.withColumns(
        {"linkability_rate": ratio(F.col("linked_entities"), F.col("total_entities")), "linkability_rate_top": ratio(F.col("linked_entities_top"), F.col("total_entities"))}
    )


def mean_of_runs(per_run: DataFrame, group: dict[str, str]) -> DataFrame:
    """Linkability rows of several runs as one row for each name in `group` (run -> name): means of counts and of rates."""
    known = F.create_map(*[F.lit(x) for kv in group.items() for x in kv])
    named = per_run.withColumn("_name", F.coalesce(F.try_element_at(known, F.col("model")), F.col("model")))
    measures = [c for c in per_run.columns if c != "model"]
    return named.groupBy(F.col("_name").alias("model")).agg(*[F.avg(c).alias(c) for c in measures])


def with_pages(docs: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """Documents with the text fetched for their url; documents without one go, a url asked for twice keeps all its rows."""
    clash = [c for c in pages.columns if c in docs.columns and c != key]
    fetched = pages.withColumnsRenamed({c: f"page_{c}" for c in clash})
    return docs.join(fetched, key)


def from_domain(df: DataFrame, pattern: str, column: str = "doc_id") -> DataFrame:
    """Rows whose id holds a match of `pattern`, anywhere in it."""
    return df.filter(F.col(column).cast("string").rlike(pattern))
