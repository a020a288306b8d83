"""Benchmark decontamination: SimHash of item-sized windows, block index of all within a radius, exact shingle similarity."""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.repeats import WordCodes
from corpusloom.llm.simhash import bit_votes, pack
from corpusloom.llm.window_prints import window_prints
from corpusloom.llm.winnow import mix
from corpusloom.shared import stash

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 11  # bits of 64; of random fingerprints 1 in ten million lies so near
PARTS = 4  # 16 bits each: of two fingerprints within RADIUS some part differs in RADIUS // PARTS bits at most
STRIDE = 3
BLOCK_BYTES = 16_000_000
BLOCK_ITEMS = 10_000  # bounds an index to some 70 MB
CHUNK = 24_576  # hashes fingerprinted at a time

_STEP = np.uint64(0x9E3779B97F4A7C15)
_REACH = np.array([x for x in range(1 << 16) if x.bit_count() <= RADIUS // PARTS], dtype=np.uint16)


def shingle_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word codes; a shorter sequence is one shingle."""
    n = min(n, len(codes))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for i in range(n):
        total = total * _STEP + codes[i : len(codes) - n + 1 + i]
    return mix(total)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shared weight over joint weight; a shingle weighs as often as it occurs."""
    shared = sum(min(n, b[k]) for k, n in a.items())
    joint = sum(a.values()) + sum(b.values()) - shared
    return shared / joint if joint else 0.0


@dataclass
class Item:
    item_id: object
    words: int
    codes: np.ndarray  # of its shingles
    shingles: Counter
    distinct: np.ndarray  # sorted


class PrintIndex:
    """Fingerprints by their parts: every value within RADIUS // PARTS bits of a part leads to the fingerprint."""

    def __init__(self, prints: list[int], owners: list[int], offsets: list[int]):
        self.prints = np.array(prints, dtype=np.uint64)
        self.owner = np.array(owners, dtype=np.int64)
        self.offset = np.array(offsets, dtype=np.int64)
        self.parts = []
        ids = np.repeat(np.arange(len(prints), dtype=np.int32), len(_REACH))
        for p in range(PARTS):
            value = (self.prints >> np.uint64(16 * p)).astype(np.uint16)
            near = (value[:, None] ^ _REACH[None, :]).ravel()
            first = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=1 << 16))])
            self.parts.append((np.diff(first) > 0, first, ids[np.argsort(near, kind="stable")]))

    def near(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, fingerprint) numbers of all pairs within RADIUS bits, each once."""
        found = []
        for p, (listed_at_all, first, ids) in enumerate(self.parts):
            value = (windows >> np.uint64(16 * p)).astype(np.uint16)
            hit = np.flatnonzero(listed_at_all[value])
            value = value[hit].astype(np.int64)
            low = first[value]
            count = first[value + 1] - low
            window = np.repeat(hit, count)
            listed = ids[np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
            close = np.bitwise_count(windows[window] ^ self.prints[listed]) <= RADIUS
            found.append(window[close] * len(self.prints) + listed[close])
        return np.divmod(np.unique(np.concatenate(found)), len(self.prints))


def window_class(n: int) -> tuple[int, int]:
    """(stride, blocks) of the windows that stand for items of n shingles.

    Short items have windows of their own size, at every place.  Longer ones have windows at
    every STRIDEth place and as many fingerprints, of windows that start one after another in
    the item's middle: whatever the place, one of them is in step.  Sizes go in steps of an
    eighth, so that items of similar length share their windows.
    """
    if n < 3 * STRIDE:
        return 1, n
    most = (n - STRIDE + 1) // STRIDE
    step = 1 << max(0, most.bit_length() - 4)
    return STRIDE, most // step * step


class ItemIndex:
    """Benchmark items with their fingerprints, by shingle length and window class, and of whole items for documents shorter than these."""

    def __init__(self, rows: list[tuple]):
        self.token = uuid.uuid4().hex
        self.items: list[Item] = []
        known = WordCodes()
        for item_id, text in rows:
            words = word_codes(text, known)
            if len(words):
                codes = shingle_codes(words, SHINGLE)
                self.items.append(Item(item_id, len(words), codes, Counter(codes.tolist()), np.unique(codes)))

    def lookup(self) -> dict[int, tuple[dict[tuple[int, int], PrintIndex], PrintIndex, int]]:
        """By shingle length: an index for each window class, one of whole items, and the longest item's shingles."""
        if _lookups.get("token") != self.token:
            _lookups.clear()
            _lookups.update(token=self.token, lookup={n: self._build(n) for n in {min(SHINGLE, i.words) for i in self.items}})
        return _lookups["lookup"]

    def _build(self, n: int):
        own = [(at, i.codes) for at, i in enumerate(self.items) if min(SHINGLE, i.words) == n]
        by_class: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for at, codes in own:
            stride, blocks = window_class(len(codes))
            size = stride * blocks
            first = (len(codes) - size - stride + 1) // 2
            for offset in range(first, first + stride):
                by_class[stride, blocks].append((simhash(codes[offset : offset + size]), at, offset))
        classes = {c: PrintIndex(*map(list, zip(*rows, strict=True))) for c, rows in sorted(by_class.items())}
        return classes, PrintIndex([simhash(c) for _, c in own], [at for at, _ in own], [0] * len(own)), max(len(c) for _, c in own)


_lookups: dict = {}  # of the index used last in this process


def simhash(hashes: np.ndarray) -> int:
    return pack(bit_votes(hashes) * 2 > len(hashes))


def word_codes(text: bytes | None, known: WordCodes) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def candidates(shingles: list[np.ndarray], classes: dict[tuple[int, int], PrintIndex]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, item, where the item would start) of windows within RADIUS bits of an item's fingerprint.

    Documents lie one after another, so that short ones are fingerprinted together; windows
    across their borders don't count.
    """
    joined = np.concatenate(shingles)
    ends = np.cumsum([len(s) for s in shingles])
    for stride in {s for s, _ in classes}:
        sizes = [m for s, m in classes if s == stride]
        widest = stride * max(sizes)
        step = max(CHUNK, 4 * widest) // stride * stride
        for base in range(0, len(joined), step):
            for m, prints in window_prints(joined[base : base + step + widest - stride], stride, sizes):
                index = classes[stride, m]
                window, listed = index.near(prints)
                at = base + window * stride
                doc = np.searchsorted(ends, at, side="right")
                whole = at + stride * m <= ends[doc]
                doc, listed, at = doc[whole], listed[whole], at[whole]
                if len(doc):
                    yield doc, index.owner[listed], at - (ends[doc] - np.array([len(shingles[d]) for d in doc])) - index.offset[listed]


def best_window(shingles: np.ndarray, item: Item, starts: list[int], threshold: float) -> tuple[int, int, float] | None:
    """(start, shingles, similarity) of the most similar window of the item's size near one of `starts`, the first of equals."""
    own = len(item.codes)
    width = min(own, len(shingles))
    slack = own // 4 + STRIDE
    least = threshold * own  # a similar window shares at least so many shingles with the item
    if width < least:
        return None
    best, done = None, -1
    for start in starts:
        low, high = max(done + 1, start - slack, 0), min(start + slack, len(shingles) - width)
        if low > high:
            continue
        done = high
        part = shingles[low : high + width]
        slot = np.minimum(np.searchsorted(item.distinct, part), len(item.distinct) - 1)
        sums = np.concatenate([[0], np.cumsum(item.distinct[slot] == part)])
        for s in np.flatnonzero(sums[width:] - sums[:-width] >= least).tolist():
            similarity = weighted_similarity(Counter(part[s : s + width].tolist()), item.shingles)
            if similarity >= threshold and (best is None or similarity > best[2]):
                best = (low + s, width, similarity)
    return best


def text_matches(texts: list[np.ndarray], index: ItemIndex, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """Best window of each item in each text (as word codes): (text, item, start, words, similarity)."""
    out = []
    for n, (classes, whole, longest) in index.lookup().items():
        rows = [i for i, codes in enumerate(texts) if len(codes) >= n]
        shingles = [shingle_codes(texts[i], n) for i in rows]
        starts: dict[tuple[int, int], set[int]] = defaultdict(set)
        if rows:
            for doc, item, start in candidates(shingles, classes):
                for d, i, s in zip(doc.tolist(), item.tolist(), start.tolist(), strict=True):
                    starts[d, i].add(s)
        short = [d for d, s in enumerate(shingles) if len(s) < longest]
        if short:
            for at, listed in zip(*whole.near(np.array([simhash(shingles[d]) for d in short], dtype=np.uint64)), strict=True):
                starts[short[at], int(whole.owner[listed])].add(0)
        for (d, i), places in sorted(starts.items()):
            best = best_window(shingles[d], index.items[i], sorted(places), threshold)
            if best:
                out.append((rows[d], i, best[0], best[1] + n - 1, best[2]))
    return sorted(out)


def grouped(texts: pa.Array, known: WordCodes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Word codes of a column of texts in groups of a few chunks, with the first one's row."""
    held: list[np.ndarray] = []
    first = total = 0
    for i, text in enumerate(texts):
        held.append(word_codes(text.as_py(), known))
        total += len(held[-1])
        if total > 4 * CHUNK:
            yield first, held
            first, held, total = i + 1, [], 0
    yield first, held


def match_batches(batches: Iterator[pa.RecordBatch], index: ItemIndex, threshold: float, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    known = WordCodes()
    for batch in batches:
        found = [(first + row, *rest) for first, texts in grouped(batch.column(1), known) for row, *rest in text_matches(texts, index, threshold)]
        rows, items, starts, lengths, similar = zip(*found, strict=True) if found else ((),) * 5
        arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([index.items[i].item_id for i in items], item_type)]
        arrays += [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(similar, pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_item", "start_word", "n_words", "similarity"])


def item_indexes(items: DataFrame) -> Iterator[ItemIndex]:
    """An index for each block of at most about BLOCK_BYTES and BLOCK_ITEMS of `_item, _text`; blocks without an item are left out."""
    size, n = items.agg(F.sum(F.octet_length("_text")), F.count(F.lit(1))).first()
    blocks = 1 + max((size or 0) // BLOCK_BYTES, n // BLOCK_ITEMS)
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == b)
        index = ItemIndex(sorted(((r["_item"], bytes(r["_text"])) for r in own.toLocalIterator()), key=lambda r: (str(r[0]), r[1])))
        if index.items:
            yield index


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Documents that hold a window like a benchmark item.

    Item-sized windows slide over every document; all are fingerprinted (see `window_prints`
    and `window_class`).  A block index gives the items with a fingerprint within RADIUS bits,
    none of these is missed, and the exact weighted similarity of five-word shingles (words
    lower-cased, multiplicity as weight) between the item and the windows of its size there
    decides.  A passage that holds an item word for word is always found; RADIUS leaves out few of
    those that are just `threshold` alike (recall is measured in the tests and in the README).

    Items come in blocks of at most BLOCK_BYTES of text and BLOCK_ITEMS, which go to all
    tasks; each block is read against all documents and its matches are written.  Returns one
    row for each document and item matched: `id_col, item_col, start_word, n_words,
    similarity` of the best window, the first of equals.

    Null and empty texts and items match nothing; a document shorter than an item is one
    window; texts of any length are read whole, in overlapping chunks; rows repeated in
    `docs` give repeated rows; items repeated with one id give a row each; null ids stay null;
    an empty table gives an empty result; other columns don't take part, whatever their names.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text).cast("binary").alias("_text")).filter("_text is not null")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    item_type = to_arrow_type(items.schema["_item"].dataType)
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _item {items.schema['_item'].dataType.simpleString()}, start_word long, n_words long, similarity double"
    found = None
    for index in item_indexes(items):  # one block as a rule; the matches of several add up in one written table
        part = rows.mapInArrow(lambda it, index=index: match_batches(it, index, threshold, item_type), schema)
        found = part if found is None else stash(found.union(part), "matches")
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "start_word", "n_words", "similarity")


def clean_batches(batches: Iterator[pa.RecordBatch], index: ItemIndex, threshold: float, text_at: int) -> Iterator[pa.RecordBatch]:
    """The rows whose text matches no item of the index, all their columns as they are."""
    known = WordCodes()
    for batch in batches:
        clean = np.ones(batch.num_rows, dtype=bool)
        for first, texts in grouped(batch.column(text_at).cast(pa.binary()), known):
            clean[[first + m[0] for m in text_matches(texts, index, threshold)]] = False
        yield batch if clean.all() else batch.filter(pa.array(clean))


def without_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that match no benchmark item (see `benchmark_matches`), each judged by its own text; ids don't take part."""
    items = benchmark.select(F.lit(0).alias("_item"), F.col("text").cast("binary").alias("_text")).filter("_text is not null")
    at = docs.columns.index(text_col)
    out = docs
    for number, index in enumerate(item_indexes(items)):
        out = (stash(out, "clean") if number else out).mapInArrow(lambda it, index=index: clean_batches(it, index, THRESHOLD, at), docs.schema)
    return out
