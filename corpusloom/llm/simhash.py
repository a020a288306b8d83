"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.shared import stash

RADIUS = 3
PARTS = ((0, 21), (21, 42), (42, 64))


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def pack(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """64-bit SimHash of a text's n-word shingles, as unsigned.

    A-Z lower-cased, words between white space, repeats counted; fewer than n words are one
    shingle; no word gives 0.  Shingles are hashed by XXH64 with seed 42; a bit is set if
    over half of the hashes have it.
    """
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)
    return pack(bit_votes(hashes) * 2 > len(hashes))


def fingerprint_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.empty(batch.num_rows, dtype=np.uint64)
        for i, text in enumerate(batch.column(1)):
            prints[i] = fingerprint(text.as_py(), n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["_id", "_fp"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: fingerprint_batches(it, n), f"_id {kind}, _fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ball_keys() -> list[tuple[int, int]]:
    """(mask, flip) of each key a fingerprint emits: key = (fingerprint & mask) ^ flip.

    Of the three parts of a fingerprint pair within distance 3, the part that differs most
    can be left out so that the other two differ in at most 2 bits.  Within each pair of
    parts every fingerprint emits all variants within half of that, 1 bit, so both meet in
    a common variant.  The part left out holds a tag, so pairs of parts don't mix.
    """
    keys = []
    for left_out in range(3):
        low, high = PARTS[left_out]
        mask = ((1 << 64) - 1) ^ (((1 << high) - 1) ^ ((1 << low) - 1))
        tag = (left_out + 1) << low
        keys.append((signed(mask), signed(tag)))
        keys += [(signed(mask), signed(tag ^ (1 << b))) for b in range(64) if mask >> b & 1]
    return keys


def forest(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the values that lie within `radius` bits of each other."""
    left = np.ones(len(values), dtype=bool)
    while left.any():
        seed = int(np.argmax(left))
        left[seed] = False
        waiting = [seed]
        while waiting:
            i = waiting.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(values[rest] ^ values[i]) <= radius]
            left[near] = False
            for j in near.tolist():
                yield i, j
            waiting += near.tolist()


def link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """`_key, _fp` in order of key -> verified links `a, b`: a spanning forest of each key's fingerprints."""
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        a, b = [fp[near]], [fp[near + 1]]
        for start, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            pairs = np.array(list(forest(fp[start : start + n], radius)), dtype=np.int64).reshape(-1, 2) + start
            a.append(fp[pairs[:, 0]])
            b.append(fp[pairs[:, 1]])
        a, b = (np.concatenate(x).view(np.int64) for x in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not len(low):
            return None
        both = np.unique(np.stack([low, high], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([held_key, batch.column(0).to_numpy()])
        fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
        whole = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
        found = links(key[:whole], fp[:whole]) if whole else None
        if found is not None:
            yield found
        held_key, held_fp = key[whole:], fp[whole:]
    if len(held_key) and (found := links(held_key, held_fp)) is not None:
        yield found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """Groups documents whose fingerprints chain together by links of at most 3 differing bits.

    Fingerprints are made distinct first, so copies of a text link once; each emits the
    keys of `ball_keys`; colliding fingerprints are verified, and a key's fingerprints give
    a spanning forest of their links, never all pairs.

    Returns one row for each row of `docs`: `id_col, fingerprint` (16 hexadecimal digits),
    `component_id` (smallest id reachable).  Null and empty texts have fingerprint zero and
    link like any other; null ids don't name a component unless it has no other; repeated
    rows get equal results; texts of any length are read whole; an empty table gives an empty
    result; other columns don't take part, whatever their names.
    """
    prints = stash(fingerprints(docs, id_col, text_col, n), "prints")
    distinct = prints.groupBy("_fp").agg(F.min("_id").alias("_least"))
    keys = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(x).alias("x")) for m, x in ball_keys()])
    variants = distinct.select("_fp", F.explode(F.transform(keys, lambda k: F.col("_fp").bitwiseAND(k["m"]).bitwiseXOR(k["x"]))).alias("_key"))
    dealt = variants.select("_key", "_fp").repartition("_key").sortWithinPartitions("_key")
    links = dealt.mapInArrow(lambda it: link_batches(it, RADIUS), "a long, b long")
    groups = components(links)
    named = distinct.join(groups, F.col("_fp") == F.col("node"), "left").select("_fp", "_least", F.coalesce("component", "_fp").alias("_group"))
    named = stash(named, "named")
    least = named.groupBy(F.col("_group").alias("_g")).agg(F.min("_least").alias("component_id"))
    by_print = named.join(least, F.col("_group") == F.col("_g")).select(F.col("_fp").alias("_p"), "component_id")
    return prints.join(by_print, F.col("_fp") == F.col("_p")).select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )
