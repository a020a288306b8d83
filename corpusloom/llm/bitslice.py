"""Exact top-k inner-product search over a bit-sliced index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.shared import drop_stash, scratch_dir, stash

SHARD_ROWS = 32_768
QUERY_BYTES = 8_000_000  # of query vectors that go over the index at a time
SCALE = 1024
LIMIT = 1 << 63


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null for vectors that take no part; fails beyond the long range."""
    double = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    beyond = F.raise_error(F.lit("embedding component beyond the long range once scaled")).cast("long")
    whole = F.transform(double, lambda x: F.when(F.abs(x * SCALE) < float(LIMIT), F.floor(x * SCALE).cast("long")).otherwise(beyond))
    return F.when(F.coalesce(sound, F.lit(False)), whole)


def words_of_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans (rows x n) as rows of 64-bit words."""
    padded = np.zeros((bits.shape[0], -(-bits.shape[1] // 64) * 64), dtype=np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def positions(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.astype("<u8").view(np.uint8), bitorder="little")[:n])


def checked(score: int) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError(f"inner product {score} beyond the long range")
    return score


class Shard:
    """Bit slices of each attribute of some rows: slice (d, i) has bit i of the rows' attribute d, less its minimum."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray):
        self.ids, self.low, self.slices = ids, low, slices
        self.n = len(ids)
        self.bits = slices.shape[1]

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> Shard:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low = values.min(axis=0)
        rest = (values - low).view(np.uint64).T  # wraps to the true difference
        bits = max(1, int(rest.max(initial=0)).bit_length())
        slices = np.stack([words_of_bits((rest >> np.uint64(i) & np.uint64(1)).astype(np.uint8)) for i in range(bits)], axis=1)
        return cls(ids, low, slices)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the rows' inner products with `query`, lowest bit first, and what to add to them.

        A positive factor adds an attribute's slices once for each of its bits, at that bit's
        place; a negative one adds the slices' complement.  All slices that meet at one place
        are summed by carry-save adders, three at a time.
        """
        factors = query.tolist()
        base = sum(q * x for q, x in zip(factors, self.low.tolist(), strict=True)) + sum(q for q in factors if q < 0) * ((1 << self.bits) - 1)
        flipped = np.where((query < 0)[:, None, None], ~self.slices, self.slices)
        size = np.abs(query)
        at: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            used = flipped[(size >> j & 1).astype(bool)]
            for i in range(self.bits):
                if len(used):
                    at.setdefault(i + j, []).append(used[:, i])
        out: list[np.ndarray] = []
        place = 0
        while at:
            stack = np.concatenate(at.pop(place, [np.zeros((1, self.slices.shape[2]), np.uint64)]))
            carries = []
            while len(stack) > 1:
                if len(stack) == 2:
                    a, b = stack
                    carries.append((a & b)[None])
                    stack = (a ^ b)[None]
                    break
                m = len(stack) // 3
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                both = a ^ b
                carries.append((a & b) | (both & c))
                stack = np.concatenate([both ^ c, stack[3 * m :]])
            out.append(stack[0])
            if carries:
                at.setdefault(place + 1, []).extend(carries)
            place += 1
        return out, base

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own, ties to the smaller id."""
        slices, base = self.scores(query)
        open_ = words_of_bits((self.ids != query_id).astype(np.uint8)[None])[0]
        sure = np.zeros_like(open_)
        if int(np.bitwise_count(open_).sum()) > k:
            for s in reversed(slices):
                more = sure | (open_ & s)
                n = int(np.bitwise_count(more).sum())
                if n > k:
                    open_ = open_ & s
                else:
                    sure, open_ = more, open_ & ~s
                    if n == k:
                        open_ = np.zeros_like(open_)
                        break
        certain = positions(sure, self.n)
        rows = np.concatenate([certain, positions(open_, self.n)[: k - len(certain)]])  # rows are in order of id
        total = [base] * len(rows)  # of any width
        for i, s in enumerate(slices):
            bit = (s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
            for j in np.flatnonzero(bit).tolist():
                total[j] += 1 << i
        return self.ids[rows], np.array([checked(x) for x in total], dtype=np.int64)


def shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_id, _vector` -> one row for each shard of vectors of one length: `_dims, _ids, _low, _slices`."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush(dims: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        s = Shard.build(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays(
            [pa.array([dims], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (s.ids, s.low, s.slices)]], names=["_dims", "_ids", "_low", "_slices"]
        )

    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(), batch.column(1)
        lengths = pc.list_value_length(vectors).to_numpy().astype(np.int64)
        flat = vectors.flatten().to_numpy()
        starts = np.cumsum(lengths) - lengths
        for dims in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dims)
            values = flat[starts[rows][:, None] + np.arange(dims)] if dims else np.zeros((len(rows), 0), np.int64)
            for lo in range(0, len(rows), SHARD_ROWS):
                parts = held.setdefault(dims, [])
                parts.append((ids[rows[lo : lo + SHARD_ROWS]], values[lo : lo + SHARD_ROWS]))
                if sum(len(i) for i, _ in parts) >= SHARD_ROWS:
                    yield flush(dims, held.pop(dims))
    for dims in sorted(held):
        yield flush(dims, held[dims])


def search_batches(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, list[int]]], k: int) -> Iterator[pa.RecordBatch]:
    """Shards -> `query_id, vec_id, score`: the k best rows for each query over all shards of the task."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    by_dims: dict[int, list[tuple[int, np.ndarray]]] = {}
    for q, v in queries:
        by_dims.setdefault(len(v), []).append((q, np.array(v, dtype=np.int64)))
    for batch in batches:
        for dims, ids, low, slices in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row_ids = np.frombuffer(ids, dtype=np.int64)
            words = -(-len(row_ids) // 64)
            packed = np.frombuffer(slices, dtype="<u8")
            shard = Shard(row_ids, np.frombuffer(low, dtype=np.int64), packed.reshape(dims, -1, words) if dims else np.zeros((0, 1, words), np.uint64))
            for q, v in by_dims.get(dims, ()):
                found = shard.top(q, v, k)
                if q in best:
                    found = tuple(np.concatenate(x) for x in zip(best[q], found, strict=True))
                    order = np.lexsort((found[0], -found[1]))[:k]
                    found = found[0][order], found[1][order]
                best[q] = found
    if best:
        counts = [len(i) for i, _ in best.values()]
        ids, scores = (np.concatenate(x) for x in zip(*best.values(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(best), counts).astype(np.int64)), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def top_inner_products(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the highest inner product for each query, exactly.

    Components are quantised to floor(1024 x); queries are the rows whose id `every` divides;
    candidates are all rows but those with the query's id; ties go to the smaller id.  The
    rows become shards of bit slices, written once.  Queries are written, too, in blocks of about
    QUERY_BYTES; each block goes over all shards, each task gives the k best of its shards, a
    grouped limit merges them, and the block's result is added to the written table.  Plans
    and what the driver holds stay the same however many queries there are.

    Returns `query_id, rank, vec_id, score`; fewer rows where there are fewer candidates.
    Vectors that are null or hold null or non-finite components take no part, nor do null
    ids; components and scores of the k best beyond the long range fail the query; only
    vectors of equal length are compared (empty ones score 0), of any length; repeated rows
    are candidates each, but of query rows with one id only the least vector asks; an empty
    table gives an empty result; other columns don't take part, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), quantised(F.col(vector_col)).alias("_vector")).filter("_id is not null and _vector is not null")
    index = stash(rows.mapInArrow(shard_batches, "_dims int, _ids binary, _low binary, _slices binary"), "bit-slices")
    asked = stash(rows.filter(F.col("_id") % every == 0).groupBy("_id").agg(F.min("_vector").alias("_vector")), "bit-queries")
    size = asked.agg(F.sum(8 * F.size("_vector") + 16)).first()[0] or 0
    blocks = 1 + size // QUERY_BYTES
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    result = f"{scratch_dir(spark)}/top-{uuid.uuid4().hex}"
    for b in range(blocks):
        block = [(r["_id"], list(r["_vector"])) for r in asked.filter(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b).toLocalIterator()]
        if b and not block:
            continue
        found = index.mapInArrow(lambda it, block=block: search_batches(it, block, k), "query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(result)
    drop_stash(index)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(result)
