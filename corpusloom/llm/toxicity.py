"""Toxicity severity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.shared import stash

BUCKETS = 1 << 18
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 30_000_000
KNOWN_WORDS = 100_000
MIN_DOCUMENTS = 3
MIN_ODDS = 0.7


def word_features(word: bytes) -> list[int]:
    """Hash buckets of a word, of its beginnings and of its runs of 5 bytes."""
    marked = b"<" + word + b">"
    found = [zlib.crc32(marked), zlib.crc32(marked[:4], 1), zlib.crc32(marked[:6], 1)]
    found += [zlib.crc32(marked[i : i + 5], 2) for i in range(len(marked) - 4)]
    return sorted({f % BUCKETS for f in found})


def words_of(text: bytes | None) -> set[bytes]:
    return set((text or b"").lower().split())


@dataclass
class OrdinalModel:
    """P(grade > j) = logistic(x . weights - thresholds[j]), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """Probabilities of exceeding each grade but the highest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))

    def expected(self, z: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.above(z) @ np.diff(self.grades) if len(self.grades) > 1 else np.full(len(z), float(self.grades[0]))

    def grade(self, z: np.ndarray) -> np.ndarray:
        above = self.above(z)
        edges = np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1)
        return self.grades[np.argmax(edges[:, :-1] - edges[:, 1:], axis=1)]


def document_counts(columns: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for c in columns:
        total[c] += 1
    return total


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 150, decay: float = 1e-3, rate: float = 0.02) -> OrdinalModel:
    """Fits weights shared by all thresholds by Adam on the full batch, in numpy.

    The negative log-likelihood of grade k is -log(P(> k-1) - P(> k)); thresholds stay in
    order because only the first and the logarithms of the gaps are free.
    """
    grades = np.unique(labels)
    if len(grades) < 2:
        return OrdinalModel(np.zeros(BUCKETS, np.float32), np.zeros(0), grades if len(grades) else np.zeros(1))
    y = np.searchsorted(grades, labels)
    known: dict[bytes, bytes] = {}
    columns, scale = [], []
    for text in texts:
        parts = []
        for w in words_of(text):
            if w not in known:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                known[w] = np.array(word_features(w), dtype=np.int32).tobytes()
            parts.append(known[w])
        found, counts = np.unique(np.frombuffer(b"".join(parts), dtype=np.int32), return_counts=True)
        columns.append(found)
        scale.append(counts.astype(np.int32))
    known.clear()
    # Features enter by the log-odds of their documents lying above the lowest grade;
    # those that are rare or say little are left out.
    high = y > 0
    df_high = document_counts([c for c, h in zip(columns, high, strict=True) if h])
    df_low = document_counts([c for c, h in zip(columns, high, strict=True) if not h])
    odds = np.log((df_high + 1) / (high.sum() + 2)) - np.log((df_low + 1) / ((~high).sum() + 2))
    odds[(df_high + df_low < MIN_DOCUMENTS) | (np.abs(odds) < MIN_ODDS)] = 0
    kept = [np.flatnonzero(odds[c]) for c in columns]
    columns = [c[k] for c, k in zip(columns, kept, strict=True)]
    row = np.repeat(np.arange(len(texts)), [len(c) for c in columns])
    used, at = np.unique(np.concatenate(columns), return_inverse=True)
    value = np.concatenate([n[k] for n, k in zip(scale, kept, strict=True)]) * odds[used[at]]
    share = np.array([(y > j).mean() for j in range(len(grades) - 1)])
    first = -np.log(share / (1 - share))
    weights = np.zeros(len(used), dtype=np.float64)
    free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    moment, second = np.zeros(len(used) + len(free)), np.zeros(len(used) + len(free))
    n = len(texts)
    for step in range(1, rounds + 1):
        gaps = np.exp(free[1:])
        cuts = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, weights=value * weights[at], minlength=n)
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -40, 40)))
        edges = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        slope = edges * (1 - edges)
        mass = np.maximum(edges[np.arange(n), y] - edges[np.arange(n), y + 1], 1e-9)
        up, down = slope[np.arange(n), y] / mass, slope[np.arange(n), y + 1] / mass
        by_cut = np.zeros(len(cuts))  # gradient of the loss by threshold
        np.add.at(by_cut, np.maximum(y - 1, 0), np.where(y > 0, up, 0))
        np.add.at(by_cut, np.minimum(y, len(cuts) - 1), -np.where(y < len(cuts), down, 0))
        by_z = down - up
        by_weight = np.bincount(at, weights=value * by_z[row], minlength=len(used)) / n + decay * weights
        by_free = np.concatenate([[by_cut.sum()], gaps * np.cumsum(by_cut[::-1])[::-1][1:]]) / n
        gradient = np.concatenate([by_weight, by_free])
        moment = 0.9 * moment + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights -= move[: len(used)]
        free -= move[len(used) :]
    dense = np.zeros(BUCKETS, dtype=np.float32)
    dense[used] = weights * odds[used]
    return OrdinalModel(dense, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]), grades)


class WordScores(dict):
    """Weight sums of words, remembered up to a bound."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        score = self[word] = float(self.weights[word_features(word)].sum())
        return score


def latent(texts: list[bytes | None], scores: WordScores) -> np.ndarray:
    """x . weights of each text: sums over its distinct words."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        words = words_of(text)
        if words:
            out[i] = sum(map(scores.__getitem__, words))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[bytes], np.ndarray]:
    """At most SAMPLE_ROWS labelled documents and SAMPLE_BYTES of text, by hash of the id, to the driver; of an id's texts the shortest."""
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_label"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("binary").alias("_text")).filter("_text is not null")
    joined = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # at most SAMPLE_ROWS rows
    one = joined.groupBy("_id").agg(F.min(F.struct(F.octet_length("_text").alias("n"), F.col("_text").alias("text"), F.col("_label").alias("label"))).alias("_r"))
    rows = stash(one.select("_id", "_r.*"), "labelled")
    total, kept = 0, set()
    for r in rows.select("_id", "n").orderBy(F.xxhash64("_id"), "_id").collect():  # ids and lengths only
        if total + r["n"] <= SAMPLE_BYTES:  # an overlong text costs only itself
            total += r["n"]
            kept.add(r["_id"])
    got = sorted((r["_id"], bytes(r["text"]), r["label"]) for r in rows.toLocalIterator() if r["_id"] in kept)
    return [t for _, t, _ in got], np.array([g for _, _, g in got])


def grades(texts: pa.Array, model: OrdinalModel, scores: WordScores) -> tuple[np.ndarray, np.ndarray]:
    """Expected and most likely grade of each text."""
    binary = texts.cast(pa.binary())
    z = np.concatenate([latent(binary.slice(i, 256).to_pylist(), scores) for i in range(0, max(1, len(binary)), 256)])
    return model.expected(z), model.grade(z).astype(np.float64)


def grade_batches(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    """`_id, _text` -> `_id, severity, grade`."""
    scores = WordScores(model.weights)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, grades(batch.column(1), model, scores))], names=["_id", "severity", "grade"])


def mild_batches(batches: Iterator[pa.RecordBatch], model: OrdinalModel, text_at: int, reject: float) -> Iterator[pa.RecordBatch]:
    """Rows below the rejection level, all their columns as they are."""
    scores = WordScores(model.weights)
    for batch in batches:
        yield batch.filter(pa.array(grades(batch.column(text_at), model, scores)[0] < reject))


def without_toxic(docs: DataFrame, labels: DataFrame, reject: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of `docs` whose expected severity lies below `reject`, each judged by its own text, see `severity`."""
    model = fit(*training_rows(docs, labels, id_col, text_col, label_col))
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: mild_batches(it, model, at, reject), docs.schema)


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Severity of each document, learned from graded labels.

    The model is fitted on the driver from at most SAMPLE_ROWS labelled rows and
    SAMPLE_BYTES of text; everything else covers all documents.  Returns one row for each
    row of `docs`: `id_col`, `severity` (expected grade) and `grade` (most likely one).

    Null and empty texts get the grade of a text without features; texts of any length are
    read whole; null labels and labels without a document don't take part; of several labels
    the highest counts, of an id's texts the shortest is learned from; of grades that are
    equally likely the lowest is given; repeated rows get equal results; with fewer than two
    grades in the labels all rows get the one there is, or 0; an empty table gives an empty
    result.  Other columns don't take part, whatever their names.
    """
    model = fit(*training_rows(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: grade_batches(it, model), f"_id {kind}, severity double, grade double").withColumnRenamed("_id", id_col)
