"""One document of each group of near copies: SimHash by meet-in-the-middle ball hashing in many parts, verified on shingles.

Two texts 0.8 alike in five-word shingles differ in about 10 of 64 SimHash bits, too many
for balls around one fingerprint.  So a text gets 512 bits, cut into 16 parts of 32, and emits
all variants of each part within 1 bit: texts meet in a part in which they differ by 2 bits
or fewer, as half the radius comes from either side.

Colliding texts only have to come into one block; which of them are alike is settled there.
Texts that share a whole part are joined first, so a large family is one block before
the variants are looked at, and these say only what joins different blocks: all pairs of a
small key that are near in all 512 bits, a spanning forest of a larger one.  In a block all
texts are compared by their shingles, whatever their bits, unless verified links join
them already.  A block too large for one task is dealt out in pieces, see `_grouped`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.simhash import forest
from corpusloom.llm.winnow import mix
from corpusloom.shared import drop_stash, stash

SHINGLE, SIMILARITY = 5, 0.8
WORDS = 8  # of 64 bits; each has two parts
NEAR = 24  # bits of the first word in which texts of one key may differ; texts 0.8 alike differ in 10 give or take 3, of five shingles in 12
RADIUS = 130  # bits of all 512 in which linked texts may differ; texts 0.8 alike differ in 78 give or take 8, of five shingles in 96 give or take 9
NEAREST = 4  # texts of one key of which all pairs are looked at; a larger key gives a forest, and its texts a block
TREE = 2048  # texts of a block that are compared at a time, and fingerprints of a key that a shortest tree ties
LONG = 512  # shingles of a text that count as one text more in TREE

_SALTS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the distinct runs of n words; a shorter sequence is one run, none has none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_64_intdigest
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b]) for a, b in spans], dtype=np.uint64))


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of SimHash, each from the hashes mixed with another salt."""
    votes = np.zeros((WORDS, 64), dtype=np.int64)
    for lo in range(0, len(hashes), 2048):
        salted = mix(hashes[None, lo : lo + 2048] ^ _SALTS[:, None]).astype("<u8")
        bits = np.unpackbits(salted.view(np.uint8).reshape(WORDS, -1, 8), axis=2, bitorder="little")
        votes += bits.sum(axis=1, dtype=np.uint16)
    return np.packbits(votes * 2 > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def plain_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_row, _text` -> `_row, _node, _fp`: the hash of a text's words and its fingerprint."""
    for batch in batches:
        nodes = np.empty(batch.num_rows, dtype=np.int64)
        prints = np.empty((batch.num_rows, WORDS), dtype=np.uint64)
        for i, text in enumerate(batch.column(1)):
            words = plain_words(text.as_py())
            nodes[i] = signed(xxhash.xxh3_64_intdigest(b" ".join(words)))
            prints[i] = long_fingerprint(shingle_hashes(words))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * WORDS + 1, WORDS), pa.int32()), pa.array(prints.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), listed], names=["_row", "_node", "_fp"])


def shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_block, _node, _text` -> `_block, _node, _set`."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = [shingle_hashes(plain_words(t.as_py())).view(np.int64) for t in part.column(2)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), listed], names=["_block", "_node", "_set"])


def part_keys(fp: Column) -> Column:
    """Each 32-bit part's value, with the part's number above it."""
    part = lambda p: F.shiftrightunsigned(F.get(fp, (p / 2).cast("int")), 32).bitwiseAND(0xFFFFFFFF)
    low = lambda p: F.get(fp, (p / 2).cast("int")).bitwiseAND(0xFFFFFFFF)
    value = lambda p: F.when(p % 2 == 0, low(p)).otherwise(part(p)) + F.shiftleft(p.cast("long"), 32)
    return F.transform(F.sequence(F.lit(0), F.lit(2 * WORDS - 1)), value)


def ball_keys(fp: Column) -> Column:
    """Of each 32-bit part its value and the values 1 bit off, with the part's number above them."""
    flips = F.array(*[F.lit(x).cast("long") for x in (0, *(1 << b for b in range(32)))])
    return F.flatten(F.transform(part_keys(fp), lambda v: F.transform(flips, lambda f: v.bitwiseXOR(f))))


def tree(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of a shortest spanning forest of the values, of those within `radius` bits."""
    n = len(values)
    nearest = np.bitwise_count(values ^ values[0]).astype(np.int64)
    origin = np.zeros(n, dtype=np.int64)
    nearest[0] = 1000
    done = np.zeros(n, dtype=bool)
    done[0] = True
    for _ in range(n - 1):
        i = int(np.argmin(nearest))
        if nearest[i] <= radius:
            yield int(origin[i]), i
        done[i] = True
        distance = np.bitwise_count(values ^ values[i]).astype(np.int64)
        closer = (distance < nearest) & ~done
        nearest[closer] = distance[closer]
        origin[closer] = i
        nearest[i] = 1000


def tree_batches(batches: Iterator[pa.RecordBatch], radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """`_key, _p, _label` in order of key -> links `a, b`, `_sure` between fingerprints of one key with different labels.

    A key of two or of up to `most` fingerprints gives all its pairs within the radius, yet to be
    checked by all bits.  A larger one gives links that join the labels of all such pairs,
    which are taken as they are.
    """
    held = [np.zeros(0, np.int64)] * 3

    def links(key: np.ndarray, p: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        start, size = cut[:-1], np.diff(cut)
        mixed = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
        i = start[mixed & (size == 2)]
        i = i[np.bitwise_count((p[i] ^ p[i + 1]).view(np.uint64)) <= radius]
        found = [(p[i], p[i + 1], np.zeros(len(i), np.int64))]
        more = mixed & (size > 2)
        for at, n in zip(start[more].tolist(), size[more].tolist(), strict=True):
            own, bits = label[at : at + n], p[at : at + n].view(np.uint64)
            if n <= most:
                i, j = np.triu_indices(n, 1)
                near = (own[i] != own[j]) & (np.bitwise_count(bits[i] ^ bits[j]) <= radius)
                found.append((p[at + i[near]], p[at + j[near]], np.zeros(int(near.sum()), np.int64)))
            else:
                edges = np.array(list((tree if n <= TREE else forest)(bits, radius)), dtype=np.int64).reshape(-1, 2)
                a, b = own[edges[:, 0]], own[edges[:, 1]]
                found.append((a[a != b], b[a != b], np.ones(int((a != b).sum()), np.int64)))
        a, b, sure = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), sure], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2] == 1)], names=["a", "b", "_sure"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        key = rows[0]
        whole = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
        if whole:
            yield links(*(r[:whole] for r in rows))
        held = [r[whole:] for r in rows]
    if len(held[0]):
        yield links(*held)


def set_links(labels: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of labels that join those of all sets so similar; sets of one label count as joined, `hashes` holds all sets end to end.

    From a label on, every set reached is compared with all that are not yet, so nothing is
    compared twice, and joined sets never with each other.
    """
    names, group = np.unique(labels, return_inverse=True)
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    marked = np.zeros(len(vocabulary), dtype=bool)
    ends = np.cumsum(sizes)
    rest, flat = np.arange(len(labels)), ids  # sets not reached and their hashes
    for g in np.argsort(np.bincount(group), kind="stable").tolist():
        waiting: list[int] = []
        joined = np.array([g])
        while True:
            if len(joined):
                moves = np.isin(group[rest], joined)
                waiting += rest[moves].tolist()
                flat, rest = flat[~np.repeat(moves, sizes[rest])], rest[~moves]
                cuts = np.concatenate([[0], np.cumsum(sizes[rest])])
            if not len(rest):
                return
            if not waiting:
                break
            i = waiting.pop()
            own = ids[ends[i] - sizes[i] : ends[i]]
            marked[own] = True
            shared = np.diff(np.concatenate([[0], np.cumsum(marked[flat])])[cuts])
            marked[own] = False
            joined = np.unique(group[rest[shared >= similarity * (sizes[i] + sizes[rest] - shared)]])
            for j in joined.tolist():
                yield int(names[g]), int(names[j])


def set_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """`_block, _piece, _label, _set` in order of both -> links `a, b` between labels of one piece."""
    held: list[tuple[np.ndarray, ...]] = []
    out: list[tuple[int, int]] = []
    last = None

    def flush() -> None:
        if held:
            out.extend(set_links(*(np.concatenate(x) for x in zip(*held, strict=True)), similarity))
            held.clear()

    def links() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["a", "b"])
        out.clear()
        return found

    for batch in batches:
        block, piece, label = (batch.column(i).to_numpy() for i in range(3))
        ends, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
        changes = np.flatnonzero((block[1:] != block[:-1]) | (piece[1:] != piece[:-1])) + 1
        for lo, hi in pairwise([0, *changes.tolist(), len(block)]):
            if lo == hi:
                continue
            if last != (here := (int(block[lo]), int(piece[lo]))):
                flush()
                last = here
            held.append((label[lo:hi], np.diff(ends[lo : hi + 1]).astype(np.int64), values[ends[lo] : ends[hi]]))
        yield links()
    flush()
    yield links()


def row_key(id_col: str, text_col: str) -> Column:
    """Id, null last, and 128 bits of hash of the text: equal only for rows with the same id and text."""
    text = F.col(text_col).cast("binary")
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def picked(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Rows of `docs` (their columns, `more` of `rows`) that have the key `_w` of a row of `rows`."""
    key = row_key(id_col, text_col)
    keyed = docs.select(*[F.col(c) for c in docs.columns], *[key[c].alias(f"_k{c}") for c in ("h", "g")])
    wanted = rows.select(*[F.col(f"_w.{c}").alias(f"_w{c}") for c in ("id", "h", "g")], *more)
    same = F.col(id_col).eqNullSafe(F.col("_wid")) & (F.col("_kh") == F.col("_wh")) & (F.col("_kg") == F.col("_wg"))
    return keyed.join(wanted, same, "inner" if more else "left_semi").drop("_wid", "_wh", "_wg")


def _tied(reps: DataFrame, keys: Column, most: int) -> DataFrame:
    """Links of `tree_batches` between `_p` of one key."""
    near = NEAR
    dealt = reps.select(F.explode(keys).alias("_key"), "_p", "_label").repartition("_key").sortWithinPartitions("_key", "_p")
    return dealt.mapInArrow(lambda it: tree_batches(it, near, most), "a long, b long, _sure boolean").distinct()


def _within(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links of `set_batches` in the pieces of `_block, _piece, _label, _set`."""
    rows = dealt.select("_block", "_piece", "_label", "_set").repartition("_block", "_piece").sortWithinPartitions("_block", "_piece")
    return rows.mapInArrow(lambda it: set_batches(it, similarity), "a long, b long")


def _pieces(rows: DataFrame, name: str) -> DataFrame:
    """`_b`, the number of pieces (`name`) that a block's rows make."""
    load = F.count(F.lit(1)) + F.sum(F.size("_set")) / LONG
    return rows.groupBy(F.col("_block").alias("_b")).agg(F.ceil(load / TREE).cast("long").alias(name))


def _grouped(sets: DataFrame, similarity: float) -> DataFrame:
    """`node, component` of the links between all sets of a block (`_block, _node, _set`) that are so similar.

    A block of one piece is settled at once.  A larger one is dealt out in pieces twice, each
    time otherwise, which joins nearly all of a family.  Its largest group needs no more
    comparisons in itself, so then the block's other texts (pieces of them) meet each piece of
    that group and each other: every pair not yet joined is compared, and where few texts are
    left beside the largest group rows grow with the block.
    """
    counts = stash(_pieces(sets, "_n").filter("_n > 1"), "near-counts")  # a row for each block of many pieces, at most one for TREE texts
    every = sets.join(F.broadcast(counts), F.col("_block") == F.col("_b"), "left").drop("_b").withColumn("_n", F.coalesce("_n", F.lit(1).cast("long")))
    shard = lambda seed, n: F.pmod(F.xxhash64("_node", F.lit(seed)), F.col(n))
    large = every.filter("_n > 1")
    links = _within(every.withColumn("_label", F.col("_node")).withColumn("_piece", shard(1, "_n")), similarity)
    if split := not counts.isEmpty():
        links = links.union(_within(large.withColumn("_label", F.col("_node")).withColumn("_piece", shard(2, "_n")), similarity))
    groups = stash(components(links), "near-groups")
    if split:
        named = large.join(groups, F.col("_node") == F.col("node"), "left").withColumn("_label", F.coalesce("component", "_node")).drop("node", "component")
        kept = stash(named, "near-large")
        sizes = kept.groupBy(F.col("_block").alias("_b"), "_label").agg(F.count(F.lit(1)).alias("_size"))
        largest = sizes.groupBy("_b").agg(F.max(F.struct("_size", "_label")).alias("_most")).select("_b", F.col("_most._label").alias("_most"))
        named = kept.join(F.broadcast(largest), F.col("_block") == F.col("_b")).drop("_b")
        named = named.join(F.broadcast(_pieces(named.filter("_label <> _most"), "_m")), F.col("_block") == F.col("_b")).drop("_b")
        across = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
        i, j, n, m = shard(3, "_n"), shard(4, "_m"), F.col("_n"), F.col("_m")
        with_largest = across("_n", lambda k: k * m + j)
        with_others = F.filter(across("_m", lambda k: F.when(k != j, n * m + F.least(j, k) * m + F.greatest(j, k))), lambda x: x.isNotNull())
        places = F.when(F.col("_label") == F.col("_most"), across("_m", lambda k: i * m + k)).otherwise(F.concat(with_largest, with_others))
        links = _within(named.withColumn("_piece", F.explode(places)), similarity)
        before, groups = groups, stash(components(links.union(groups.toDF("a", "b"))), "near-groups")
        drop_stash(before)
        drop_stash(kept)
    drop_stash(counts)
    return groups


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(`_node, _w` of all texts and the least row of each, `node, component` of texts with links): near copies of texts, told by their words.

    Texts are 0.8 alike if their sets of five-word shingles (words lower-cased) share that
    part of their union.  Texts that meet as the module says come into one block, and all
    links in a block are found, so groups hold no text without such a link; few texts
    alike never meet (recall is measured in the tests).
    """
    plain = docs.select(row_key(id_col, text_col).alias("_row"), F.col(text_col).cast("binary").alias("_text"))
    kind = plain.schema["_row"].dataType.simpleString()
    prints = stash(plain.mapInArrow(print_batches, f"_row {kind}, _node long, _fp array<bigint>"), "near-prints")
    least = F.min(F.struct("_row", "_fp")).alias("_r")
    distinct = stash(prints.groupBy("_node").agg(least).select("_node", F.col("_r._row").alias("_w"), F.col("_r._fp").alias("_fp")), "near-texts")
    # Texts that share their first word share a block; only where they share all others too does one stand for their bits.
    alone = F.min("_fp") == F.max("_fp")
    reps = stash(distinct.groupBy(F.get("_fp", F.lit(0)).alias("_p")).agg(F.min("_fp").alias("_fp"), alone.alias("_alone"), F.min(F.get("_fp", F.lit(0))).alias("_label")), "near-reps")

    same = stash(components(_tied(reps, part_keys(F.col("_fp")), 0).select("a", "b")), "near-same")
    labelled = reps.drop("_label").join(same, F.col("_p") == F.col("node"), "left").withColumn("_label", F.coalesce("component", "_p"))
    links = stash(_tied(labelled, ball_keys(F.col("_fp")), NEAREST), "near-links")
    end = lambda c: reps.select(F.col("_p").alias(f"_p{c}"), F.col("_fp").alias(f"_f{c}"), F.col("_alone").alias(f"_o{c}"))
    both = links.filter("not _sure").join(end("a"), F.col("a") == F.col("_pa")).join(end("b"), F.col("b") == F.col("_pb"))
    bits = F.aggregate(F.zip_with("_fa", "_fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = both.filter((bits <= RADIUS) | ~F.col("_oa") | ~F.col("_ob")).select("a", "b")
    blocks = stash(components(near.union(links.filter("_sure").select("a", "b")).union(same.toDF("a", "b"))), "near-blocks")

    first = distinct.select("_node", "_w", F.get("_fp", F.lit(0)).alias("_p"))
    placed = first.join(blocks, F.col("_p") == F.col("node"), "left").select("_node", "_w", F.coalesce("component", "_p").alias("_block"))
    shared = placed.groupBy(F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    wanted = stash(placed.join(shared, F.col("_block") == F.col("_b")).select("_node", "_w", "_block"), "near-wanted")
    texts = picked(docs.select(id_col, text_col), wanted, id_col, text_col, "_node", "_block").select("_block", "_node", F.col(text_col).cast("binary").alias("_text"))
    sets = texts.mapInArrow(shingle_batches, "_block long, _node long, _set array<bigint>")
    sets = stash(sets.dropDuplicates(["_node"]), "near-sets")
    groups = _grouped(sets, similarity)
    for table in (reps, same, links, blocks, wanted, sets):
        drop_stash(table)
    return distinct, groups


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of `docs` for each group of near copies (see `near_groups`): that with the smallest id, a null one last.

    Texts whose words are the same are copies, null and empty ones among them.  Groups name
    their row by id and text, so null and repeated ids cost no group its row and keep no copy
    of another group's.  Of rows of one group with equal ids the text's hash decides; of rows
    equal in id and text any one stays.  Texts of any length are read whole; an empty table
    gives an empty result; other columns stay as they are, whatever their names.
    """
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # names that clash with no column here
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    key, text = own[id_col], own[text_col]
    distinct, groups = near_groups(plain, key, text, similarity)
    named = distinct.join(groups, F.col("_node") == F.col("node"), "left").groupBy(F.coalesce("component", "_node").alias("_group")).agg(F.min("_w").alias("_w"))
    winners = stash(named, "near-winners")
    kept = picked(plain, winners, key, text)
    once = kept.groupBy(key, "_kh", "_kg").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if not once.isEmpty():
        kept = kept.dropDuplicates([key, "_kh", "_kg"])
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])
