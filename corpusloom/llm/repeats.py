"""Removal of passages that occur earlier in the corpus: the plan that both repeat removers share.

1. Each document becomes anchors (see `winnow`): disjoint ranges of its windows, each with
   the hash of the k-gram they picked and of the context that holds them all.  They are
   written once.
2. K-grams that occur once drop out; their windows are unique.
3. Occurrences with equal contexts have equal windows: all but the first lose them.
4. First occurrences whose k-gram has several contexts remain.  They go to tasks by k-gram,
   where a resolver finds their equal windows.
5. A group of more than `GROUP` contexts is split into sub-shards first: windows that reach
   far to the left of the k-gram go by what lies left of it, the others by what lies right
   of it.  Equal windows reach equally far, so they stay together; each sub-shard has a
   longer k-gram, contexts cut to fewer windows and goes through 3 and 4 again.  After at most
   log2(size) such steps a context is one window; HALVINGS of them come between two rounds
   of grouping.  `GROUP` changes no result, only how much meets in one task.
6. Removed ranges gather by document and are cut out.

No step gathers a k-gram's occurrences in one task: counts and minima are combined before
they are shuffled and written, and joins with written tables can be split where they are skewed.

Equality is that of two hashes of 64 bits together, of the k-gram and of the context; the
resolver compares symbols.  Words are told apart by 64 bits before that; two different words
of one code matter only inside windows that are otherwise equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.winnow import BYTE_CODES, MAX_SYMBOLS, anchors, mix
from corpusloom.shared import drop_stash, stash

GROUP = 500
HALVINGS = 3  # of a context before its parts are grouped again
BATCH_BYTES = 1 << 18
CUT = 1 << 16  # symbols of one call of anchors(), so that its arrays stay in cache
CONTEXT = "_gram long, _key {key}, _at long, _k int, _start long, _last long, _text binary, _shifts array<bigint>"


class Bytes:
    """Texts as byte strings."""

    name = "bytes"

    @staticmethod
    def split(text: bytes) -> np.ndarray:
        return np.frombuffer(text, dtype=np.uint8)

    @staticmethod
    def codes(units: np.ndarray) -> np.ndarray:
        return BYTE_CODES[units]

    @staticmethod
    def slice(units: np.ndarray, start: int, end: int) -> bytes:
        return units[start:end].tobytes()

    @staticmethod
    def apart(piece: bytes) -> bytes:
        """A slice's units, to be sliced again by `again`."""
        return piece

    @staticmethod
    def again(units: bytes, start: int, end: int) -> bytes:
        return units[start:end]


class WordCodes(dict):
    """64-bit codes of words, remembered up to a bound."""

    BOUND = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word, 7)
        return code


class Words:
    """Texts as words between white space."""

    name = "words"
    known = WordCodes()

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        return text.split()

    @classmethod
    def codes(cls, units: list[bytes]) -> np.ndarray:
        return mix(np.fromiter(map(cls.known.__getitem__, units), dtype=np.uint64, count=len(units)))

    @staticmethod
    def slice(units: list[bytes], start: int, end: int) -> bytes:
        return b" ".join(units[start:end])

    @staticmethod
    def apart(piece: bytes) -> list[bytes]:
        return piece.split(b" ")

    again = slice


def document_anchors(codes: np.ndarray, size: int, k: int):
    """Anchors of one document of any length: pieces overlap so that contexts stay whole."""
    n = len(codes)
    step = MAX_SYMBOLS - 4 * size
    if n <= MAX_SYMBOLS:
        return anchors(codes, np.array([n]), size, k)
    parts = []
    for start in range(0, n - size + 1, step):
        left = max(0, start - size)
        a = anchors(codes[left : min(n, start + step + 2 * size)], np.array([min(n, start + step + 2 * size) - left]), size, k)
        a.at, a.first, a.last = a.at + left, np.maximum(a.first + left, start), np.minimum(a.last + left, start + step - 1)
        keep = a.first <= a.last
        parts.append([x[keep] for x in (a.doc, a.at, a.first, a.last, a.key, a.context)])
    doc, at, first, last, key, context = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    a.doc, a.at, a.first, a.key, a.context = doc[new], at[new], first[new], key[new], context[new]
    a.last = last[np.concatenate([new[1:] - 1, [len(at) - 1]])]
    return a


def anchor_batches(batches: Iterator[pa.RecordBatch], units: type, size: int, k: int) -> Iterator[pa.RecordBatch]:
    """`_key, _bytes` -> `_key, _at, _gram, _context`; `_at` packs the k-gram's place and its windows."""
    if size - k > 65535:
        raise ValueError("size may exceed k by 65535 at most")
    for batch in batches:
        held: list[np.ndarray] = []
        rows: list[int] = []

        def flush():
            if len(held) == 1:
                a = document_anchors(held[0], size, k)
            else:
                a = anchors(np.concatenate(held), np.array([len(x) for x in held]), size, k)
            packed = (a.at << 32) | ((a.at - a.first) << 16) | (a.at - a.last)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.array(rows, dtype=np.int64)[a.doc])), pa.array(packed), pa.array(a.key.view(np.int64)), pa.array(a.context.view(np.int64))],
                names=["_key", "_at", "_gram", "_context"],
            )

        total = 0
        for i, text in enumerate(batch.column(1)):
            value = text.as_py()
            if value is None or len(value) < size:
                continue
            codes = units.codes(units.split(value))
            if len(codes) < size:
                continue
            if held and total + len(codes) > CUT:
                yield flush()
                held, rows, total = [], [], 0
            held.append(codes)
            rows.append(i)
            total += len(codes)
        if held:
            yield flush()


def unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = packed >> 32
    return at, at - ((packed >> 16) & 65535), at - (packed & 65535)


def context_columns(batch: pa.RecordBatch, rows: list[int], key_at: int, columns: list[list]) -> list[pa.Array]:
    """Arrays of CONTEXT (`_at` to `_shifts` after the first, `_gram`) with keys taken from `batch`."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    gram, *rest = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
    return [gram, batch.column(key_at).take(pa.array(rows, pa.int64())), *rest]


CONTEXT_NAMES = ["_gram", "_key", "_at", "_k", "_start", "_last", "_text", "_shifts"]


def context_batches(batches: Iterator[pa.RecordBatch], units: type, size: int, k: int, within: bool) -> Iterator[pa.RecordBatch]:
    """Documents with their open anchors, `_key, _bytes, _open` (list of structs `_at, _gram`) -> a row for each context.

    `_at, _k` say where the k-gram lies, `_start, _last` are the first and last window start.
    Unless an earlier start `within` the document counts, texts that it repeats are one row;
    `_shifts` says how far on the others lie.
    """
    for batch in batches:
        rows, columns, weight = [], [[] for _ in range(7)], 0
        for i in range(batch.num_rows):
            listed = batch.column(2)[i].values
            if listed is None or not len(listed):
                continue
            parts = units.split(batch.column(1)[i].as_py())
            packed, gram = (listed.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            known: dict[tuple, tuple[int, list[int]]] = {}
            for at, first, last, g in sorted(zip(*(x.tolist() for x in (*unpacked(packed), gram)), strict=True)):
                text = units.slice(parts, first, last + size)
                base, shifts = (first, []) if within else known.setdefault((g, at - first, text), (first, []))
                if base != first:
                    shifts.append(first - base)
                    continue
                rows.append(i)
                for column, value in zip(columns, (g, at, k, first, last, text, shifts), strict=True):
                    column.append(value)
                weight += len(text)
            if weight > 8 << 20:
                yield pa.RecordBatch.from_arrays(context_columns(batch, rows, 0, columns), names=CONTEXT_NAMES)
                rows, columns, weight = [], [[] for _ in range(7)], 0
        if rows:
            yield pa.RecordBatch.from_arrays(context_columns(batch, rows, 0, columns), names=CONTEXT_NAMES)


def sub_shards(at: int, k: int, start: int, last: int, size: int) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
    """(side, (at, k, start, last)) of the two parts of a context: windows that reach at least `half` symbols left of the k-gram, and the others."""
    room = size - k
    half = (room + 1) // 2
    parts = ((at - half, k + half, start, min(last, at - half)), (at, k + room - half + 1, max(start, at - half + 1), last))
    for side, part in enumerate(parts):
        if part[2] <= part[3]:
            yield side, part


def small_shards(at: int, k: int, start: int, last: int, size: int) -> Iterator[tuple[str, int, int, int, int]]:
    """Parts of a context after HALVINGS steps of `sub_shards`, each with the sides it took."""
    level = [("", at, k, start, last)]
    for _ in range(HALVINGS):
        level = [(side + "lr"[i], *p) for side, *part in level for i, p in (sub_shards(*part, size) if part[1] < size else [(0, part)])]
    yield from level


def split_batches(batches: Iterator[pa.RecordBatch], units: type, size: int) -> Iterator[pa.RecordBatch]:
    """Contexts of large groups -> their parts, with the hash of each part's longer k-gram and `_context`."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            rows, contexts, columns = [], [], [[] for _ in range(7)]
            lists = [part.column(j).to_pylist() for j in (0, 2, 3, 4, 5, 6, 7)]
            for i, (gram, at, k, start, last, text, shifts) in enumerate(zip(*lists, strict=True)):
                if k >= size:
                    continue  # one window: all that are equal are settled
                symbols = units.apart(text)
                for side, at_, k_, a, b in small_shards(at, k, start, last, size):
                    inner = units.again(symbols, at_ - start, at_ - start + k_)
                    cut = units.again(symbols, a - start, b - start + size)
                    rows.append(i)
                    contexts.append(signed(xxhash.xxh3_64_intdigest(b"%d %d " % (at_ - a, b - a) + cut)))
                    for column, value in zip(columns, (signed(xxhash.xxh3_64_intdigest(b"%d %s " % (gram, side.encode()) + inner)), at_, k_, a, b, cut, shifts), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*context_columns(part, rows, 1, columns), pa.array(contexts, pa.int64())], names=[*CONTEXT_NAMES, "_context"])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def resolved_batches(batches: Iterator[pa.RecordBatch], resolve: Callable, size: int) -> Iterator[pa.RecordBatch]:
    """`_gram, _key, _start, _doc, _text, _shifts` in order of k-gram, document and start -> removed ranges `_key, _start, _end, _shifts`.

    `resolve(texts, group, doc)` says for each context which of its windows are repeats.
    """

    def settle(table: pa.Table) -> pa.RecordBatch:
        texts = table["_text"].to_pylist()
        _, group = np.unique(table["_gram"].to_numpy(), return_inverse=True)
        doc = table["_doc"].to_numpy()
        doc = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])]))
        rows, start, end = [], [], []
        base = table["_start"].to_numpy()
        for i, flags in enumerate(resolve(texts, group, doc)):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                rows.append(i)
                start.append(base[i] + a)
                end.append(base[i] + b - 1 + size)
        keys, shifts = (table[c].combine_chunks().take(pa.array(rows, pa.int64())) for c in ("_key", "_shifts"))
        return pa.RecordBatch.from_arrays([keys, pa.array(start, pa.int64()), pa.array(end, pa.int64()), shifts], names=["_key", "_start", "_end", "_shifts"])

    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        gram = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [batch.num_rows]])
        lengths = np.concatenate([[0], np.cumsum([len(x) for x in batch.column(4).to_pylist()])])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if weight > BATCH_BYTES and held and held[-1].column(0)[held[-1].num_rows - 1].as_py() != gram[a]:
                yield settle(pa.Table.from_batches(held))
                held, weight = [], 0
            held.append(batch.slice(a, b - a))
            weight += int(lengths[b] - lengths[a])
    if held:
        yield settle(pa.Table.from_batches(held))


def cut_batches(batches: Iterator[pa.RecordBatch], units: type, characters: bool = False) -> Iterator[pa.RecordBatch]:
    """`_key, _bytes, _cuts, _carry` -> `_key, _carry, _n, _removed, _spans, _kept`.

    With `characters`, what is left of UTF-8 characters that a cut goes through goes as well.
    """
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            counts, removed, spans, kept = [], [], [], []
            for text, cuts in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                parts = units.split(text or b"")
                n = len(parts)
                counts.append(n)
                if cuts.values is None or not len(cuts.values):
                    spans.append([])
                    removed.append(0)
                    kept.append(units.slice(parts, 0, n))
                    continue
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, cuts.values.field(0).to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, cuts.values.field(1).to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(edge[:n]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                removed.append(int(gone.sum()))
                kept.append(parts[~gone].tobytes() if units is Bytes else b" ".join([w for w, g in zip(parts, gone.tolist(), strict=True) if not g]))
            if characters:
                kept = [k.decode("utf-8", "ignore").encode() if r else k for k, r in zip(kept, removed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(3), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                + [pa.array(kept, pa.binary())],
                names=["_key", "_carry", "_n", "_removed", "_spans", "_kept"],
            )


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, bool]:
    """`_key, _bytes, _carry` for each document, and whether ids are unique and not null.

    Where they are not, the key also holds the text's hash, rows equal in both count as one
    document, null ids come last and, of one id, texts are ordered by their hash.
    """
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_bytes"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"))
    odd = plain.select("_id").filter(F.col("_id").isNull()).limit(1).union(plain.groupBy("_id").count().filter("count > 1").select("_id").limit(1))
    if odd.isEmpty():
        return plain.select(F.col("_id").alias("_key"), "_bytes", "_carry"), True
    key = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.xxhash64("_bytes").alias("text"))
    return plain.select(key.alias("_key"), "_bytes", "_carry"), False


def first_of_equals(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits `rows` by `_gram, _context`: (later ones of equals, first ones whose k-gram has several contexts, those k-grams `_g` with `_n` such rows).

    Rows that agree in `order` with the first are first as well.
    """
    place = F.struct(*order)
    firsts = stash(rows.select(F.col("_gram").alias("_g"), F.col("_context").alias("_c"), place.alias("_place")).groupBy("_g", "_c").agg(F.min("_place").alias("_first")), "repeats-firsts")
    told = rows.join(firsts, (F.col("_gram") == F.col("_g")) & (F.col("_context") == F.col("_c")))
    told = stash(told.select(*rows.columns, (place > F.col("_first")).alias("_later")), "repeats-told")
    drop_stash(firsts)
    new = told.filter("not _later").drop("_later")
    kinds = new.groupBy(F.col("_gram").alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.min("_context").alias("_a"), F.max("_context").alias("_b")).filter("_a <> _b")
    kinds = stash(kinds.select("_g", "_n"), "repeats-kinds")
    return told.filter("_later").drop("_later"), new.join(kinds, F.col("_gram") == F.col("_g")).drop("_g", "_context"), kinds


def removed_ranges(rows: DataFrame, units: type, size: int, k: int, resolve: Callable, within: bool) -> DataFrame:
    """Ranges `_key, _start, _end` of units that lie in a window seen earlier.

    `within`: whether an earlier start in the same document counts as earlier.
    """
    key = rows.schema["_key"].dataType.simpleString()
    found = stash(rows.mapInArrow(lambda it: anchor_batches(it, units, size, k), f"_key {key}, _at long, _gram long, _context long"), "repeats-anchors")
    often = stash(found.groupBy("_gram").count().filter("count > 1").select(F.col("_gram").alias("_g")), "repeats-often")
    seen = stash(found.join(often, F.col("_gram") == F.col("_g"), "left_semi"), "repeats-seen")
    drop_stash(found)
    drop_stash(often)
    copies, new, kinds = first_of_equals(seen, ["_key", "_at"] if within else ["_key"])
    drop_stash(seen)

    at = F.shiftright("_at", 32)
    ranges = copies.select("_key", (at - F.shiftright("_at", 16).bitwiseAND(65535)).alias("_start"), (at - F.col("_at").bitwiseAND(65535) + size).alias("_end"))
    open_ = new.groupBy(F.col("_key").alias("_k")).agg(F.collect_list(F.struct("_at", "_gram")).alias("_open"))
    texts = rows.join(open_, F.col("_key") == F.col("_k")).select("_key", "_bytes", "_open")
    contexts = texts.mapInArrow(lambda it: context_batches(it, units, size, k, within), CONTEXT.format(key=key))
    many = kinds.filter(F.col("_n") > GROUP).select("_g")  # at most a GROUPth of the contexts
    contexts = stash(contexts.join(many, F.col("_gram") == F.col("_g"), "left").withColumn("_large", F.col("_g").isNotNull()).drop("_g"), "repeats-contexts")

    shifted = F.explode(F.concat(F.array(F.lit(0).cast("long")), "_shifts")).alias("_by")
    moved = lambda df: df.select("_key", "_start", "_end", shifted).select("_key", (F.col("_start") + F.col("_by")).alias("_start"), (F.col("_end") + F.col("_by")).alias("_end"))
    while True:
        small = contexts.filter("not _large").withColumn("_doc", F.xxhash64("_key"))
        small = small.select("_gram", "_key", "_start", "_doc", "_text", "_shifts").repartition(F.col("_gram")).sortWithinPartitions("_gram", "_key", "_start")
        settled = small.mapInArrow(lambda it: resolved_batches(it, resolve, size), f"_key {key}, _start long, _end long, _shifts array<bigint>")
        ranges = ranges.union(stash(moved(settled), "repeats-settled"))  # so that no round's shuffles meet those of another
        large = contexts.filter("_large").drop("_large")
        if large.isEmpty():
            return ranges
        parts = stash(large.mapInArrow(lambda it: split_batches(it, units, size), CONTEXT.format(key=key) + ", _context long"), "repeats-parts")
        copies, new, _ = first_of_equals(parts, ["_key", "_start"] if within else ["_key"])
        drop_stash(parts)
        ranges = ranges.union(moved(copies.withColumn("_end", F.col("_last") + size)))
        contexts = stash(new.withColumn("_large", F.col("_n") > GROUP).drop("_n"), "repeats-contexts")


def without_repeats(docs: DataFrame, id_col: str, text_col: str, units: type, size: int, k: int, resolve: Callable, within: bool, carry: list[str] | None = None, characters: bool = False) -> DataFrame:
    """One row for each row of `docs`: its id, `_n, _removed, _spans, _kept`, and `_carry` with columns to keep."""
    rows, unique = keyed(docs, id_col, text_col, carry or [])
    every = rows
    if not unique:
        rows = stash(rows.select("_key", "_bytes").dropDuplicates(["_key"]), "repeats-rows")
    ranges = removed_ranges(rows.select("_key", "_bytes"), units, size, k, resolve, within)
    cuts = ranges.groupBy(F.col("_key").alias("_k")).agg(F.collect_list(F.struct("_start", "_end")).alias("_cuts"))
    joined = every.join(cuts, F.col("_key") == F.col("_k"), "left").select("_key", "_bytes", "_cuts", "_carry")
    added = T._parse_datatype_string("_n long, _removed long, _spans array<struct<start:long,end:long>>, _kept binary")
    schema = T.StructType([joined.schema["_key"], joined.schema["_carry"], *added.fields])
    return joined.mapInArrow(lambda it: cut_batches(it, units, characters), schema)


def id_of(result: DataFrame, name: str) -> Column:
    """The document's id of a `without_repeats` result."""
    inner = result.schema["_key"].dataType
    return (F.col("_key.id") if inner.typeName() == "struct" else F.col("_key")).alias(name)
