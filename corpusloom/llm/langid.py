"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 40_000_000
SAMPLE_STRETCHES = 6_000
LEARNED_BYTES = 96  # of a stretch to learn from
STRETCH, OVERLAP = 256, 24  # bytes of a stretch that are labelled, and bytes read before and after it to warm the states up
LANES = 2048  # stretches that go through the network side by side
HIDDEN = 8
UNDETERMINED = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def live(lengths: np.ndarray, steps: int) -> list[int]:
    """How many lanes, longest first, are at least t + 1 long, for each t."""
    return (len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")).tolist()


def turned(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each lane (steps x lanes) from its end to its start; what lies beyond its length doesn't matter."""
    steps, n = values.shape[:2]
    at = np.maximum(lengths[None, :] - 1 - np.arange(steps)[:, None], 0) * n + np.arange(n)[None, :]
    return values.reshape(steps * n, -1).take(at.ravel(), axis=0).reshape(values.shape)


class Direction:
    """One gated recurrent layer; its input part is a row of a table for each byte."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)  # update, reset, candidate
        self.inner = rng.normal(0, 1 / hidden**0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.hidden = hidden

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, lanes, hidden) for bytes x (steps, lanes) of lanes in order of length, longest first."""
        n = self.hidden
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.zeros((*x.shape, n), np.float32)
        gate, candidate = np.ascontiguousarray(self.inner[:, : 2 * n]) * 0.5, np.ascontiguousarray(self.inner[:, 2 * n :])
        table = self.table * np.repeat(np.array([0.5, 1], np.float32), [2 * n, n])
        for t, m in enumerate(live(lengths, len(x))):
            h = h[:m]
            a = table.take(x[t, :m], axis=0)
            gates = h @ gate
            gates += a[:, : 2 * n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :n], gates[:, n:]
            c = (r * h) @ candidate
            c += a[:, 2 * n :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, c))
            out[t, :m] = h = h + z * (c - h)
        return out

    def backward(self, x: np.ndarray, lengths: np.ndarray, keep: list, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time: gradients of table and inner weights from those of the states."""
        n = self.hidden
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        d_next = np.zeros_like(given[0])
        for t, m in reversed(list(enumerate(live(lengths, len(x))))):
            h, z, r, c = keep[t]
            d = given[t, :m] + d_next[:m]
            d_c = d * z * (1 - c * c)
            d_z = d * (c - h) * z * (1 - z)
            d_rh = d_c @ self.inner[:, 2 * n :].T
            d_r = d_rh * h * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r], axis=1)
            np.add.at(d_table, x[t, :m], np.concatenate([d_gates, d_c], axis=1))
            d_inner[:, : 2 * n] += h.T @ d_gates
            d_inner[:, 2 * n :] += (r * h).T @ d_c
            d_next[:m] = d * (1 - z) + d_rh * r + d_gates @ self.inner[:, : 2 * n].T
        return d_table, d_inner


@dataclass
class Network:
    """Both directions and a softmax over languages at every position."""

    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        k = len(languages)
        return cls(languages, Direction(rng, hidden), Direction(rng, hidden), rng.normal(0, 0.2, (2 * hidden, k)).astype(np.float32), np.zeros(k, np.float32))

    def log_probabilities(self, x: np.ndarray, lengths: np.ndarray, keeps: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(languages, steps, lanes) log-probabilities, and both directions' states, the second as run, from end to start."""
        a, b = keeps or (None, None)
        n = self.ahead.hidden
        ahead, back = self.ahead.forward(x, lengths, a), self.back.forward(turned(x, lengths), lengths, b)
        raw = turned(back @ self.out[n:], lengths)
        raw += ahead @ self.out[:n]
        raw = np.ascontiguousarray(np.moveaxis(raw, 2, 0))
        raw += self.bias[:, None, None]
        raw -= raw.max(axis=0)
        return raw - np.log(np.exp(raw).sum(axis=0)), ahead, back

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.inner, self.back.table, self.back.inner, self.out, self.bias]

    def gradients(self, x: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross-entropy of all positions."""
        keeps: tuple = ([], [])
        log_p, ahead, back = self.log_probabilities(x, lengths, keeps)
        mask = (np.arange(len(x))[:, None] < lengths[None, :]).astype(np.float32)
        picked = log_p[label, :, np.arange(len(label))].T
        d_raw = np.moveaxis(np.exp(log_p), 0, 2).copy()
        d_raw[:, np.arange(len(label)), label] -= 1
        d_raw *= mask[:, :, None] / mask.sum()
        n = self.ahead.hidden
        d_turned = turned(d_raw, lengths) * mask[:, :, None]
        first = self.ahead.backward(x, lengths, keeps[0], d_raw @ self.out[:n].T)
        second = self.back.backward(turned(x, lengths), lengths, keeps[1], d_turned @ self.out[n:].T)
        d_out = np.concatenate([np.tensordot(ahead, d_raw, axes=([0, 1], [0, 1])), np.tensordot(back, d_turned, axes=([0, 1], [0, 1]))])
        return [*first, *second, d_out, d_raw.sum(axis=(0, 1))], float(-(picked * mask).sum() / mask.sum())


def lanes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (steps, lanes) and lengths of pieces, longest first, and their order."""
    lengths = np.array([len(p) for p in pieces])
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max())
    x = np.frombuffer(b"".join(pieces[i].ljust(steps, b"\0") for i in order.tolist()), dtype=np.uint8).reshape(len(pieces), steps)
    return np.ascontiguousarray(x.T), lengths[order], order


def train(rows: list[tuple[bytes, str]], seed: int = 1, rounds: int = 4, batch: int = 128, rate: float = 0.015) -> Network | None:
    """Fits a network to labelled texts: stretches of LEARNED_BYTES in proportion to length, each position labelled by its document's language."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    net = Network.new(languages, seed=seed)
    rng = np.random.default_rng(seed)
    known = [(text, languages.index(lang)) for text, lang in rows if text]
    if len(languages) == 1 or not known:
        return net
    # Every text gives stretches one after another from a random place on, so that starts, middles and ends are seen.
    cuts = [(i, at) for i, (text, _) in enumerate(known) for at in range(-int(rng.integers(0, LEARNED_BYTES)), len(text), LEARNED_BYTES)]
    cuts = [cuts[i] for i in rng.permutation(len(cuts))[:SAMPLE_STRETCHES].tolist()]
    stretches = [(known[i][0][max(0, at) : at + LEARNED_BYTES], known[i][1]) for i, at in cuts]
    moment = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    turns = -(-12 * batch // len(stretches)) if len(stretches) < 12 * batch else 1  # few stretches are seen more often
    step = 0
    for turn in range(rounds * turns):
        order = rng.permutation(len(stretches)).tolist()
        for at in range(0, len(order), batch):
            part = [stretches[i] for i in order[at : at + batch]]
            x, lengths, by_length = lanes([t for t, _ in part])
            grads, _ = net.gradients(x, lengths, np.array([label for _, label in part])[by_length])
            step += 1
            for p, g, m, s in zip(net.parameters(), grads, moment, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= (rate / (1 + turn / turns)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def stretches_of(text: bytes) -> Iterator[tuple[bytes, int, int]]:
    """A text's stretches with their overlaps, and which of their bytes are labelled: each byte of the text in one of them."""
    for at in range(0, len(text), STRETCH):
        left = max(0, at - OVERLAP)
        yield text[left : at + STRETCH + OVERLAP], at - left, min(len(text), at + STRETCH) - left


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """The normalised geometric mean of the probabilities at all positions, for each text (uniform for an empty one)."""
    total = np.zeros((len(texts), len(net.languages)))
    count = np.zeros(len(texts))
    waiting = ((doc, *s) for doc, text in enumerate(texts) for s in stretches_of(text))
    while part := list(islice(waiting, LANES)):
        x, lengths, order = lanes([p[1] for p in part])
        doc, first, last = (np.array([p[j] for p in part])[order] for j in (0, 2, 3))
        log_p = net.log_probabilities(x, lengths)[0]
        steps = np.arange(len(x))[:, None]
        labelled = ((steps >= first[None, :]) & (steps < last[None, :])).astype(np.float32)
        np.add.at(total, doc, np.stack([(p * labelled).sum(axis=0) for p in log_p], axis=1))
        np.add.at(count, doc, labelled.sum(axis=0))
    mean = total / np.maximum(count, 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return text is not None and next(filter(str.isalpha, text), None) is not None


def predict_batches(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() for t in batch.column(1)]
        known = [i for i, t in enumerate(texts) if net and has_letter(t)]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for lo in range(0, len(known), 1024):
            part = known[lo : lo + 1024]
            p = document_probabilities(net, [texts[i].encode("utf-8", "replace") for i in part])
            for i, best, score in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = net.languages[best], score
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["_id", "held_out", "lang_pred", "score"])


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predicts the language of each text from its bytes.

    The network learns on the driver from text and language of at most SAMPLE_ROWS documents
    (by hash of the id, SAMPLE_BYTES in all) whose crc32(id) mod 5 is not 0, from at most
    SAMPLE_STRETCHES stretches of them; prediction covers whole texts of all documents and
    reads nothing but the text.  A text goes through the network in stretches of STRETCH
    bytes, side by side; in both directions the states start OVERLAP bytes before the
    stretch, so that they are warm where labels begin.  White space is a byte like any other.
    Every position gets probabilities; a document's are their normalised geometric mean; of
    languages that are equally probable the first in order is taken.

    Returns one row for each row of `docs`: `id_col, held_out, lang_pred, score` (the
    document's probability of that language).  Null texts and texts without a letter get
    `und` and 0, as all do if nothing can be learned; null languages and null ids are not
    learned from, a null id is not held out; texts of any length are read whole; repeated
    rows get equal results; an empty table gives an empty result; other columns don't take
    part, whatever their names.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col)) != 0))
    sized = known.select(F.xxhash64(id_col).alias("_order"), F.col(id_col).alias("_id"), F.octet_length(text_col).alias("_n"))
    ids, size = [], 0
    for r in sized.orderBy("_order", "_id", "_n").limit(SAMPLE_ROWS).collect():  # ids and lengths only
        if size + r["_n"] <= SAMPLE_BYTES:  # an overlong text costs only itself
            size += r["_n"]
            ids.append(r["_id"])
    texts = known.filter(F.col(id_col).isin(sorted(set(ids)))).groupBy(F.col(id_col).alias("_id"))
    picked = texts.agg(F.min(F.struct(F.octet_length(text_col).alias("n"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"))).alias("_r"))
    sample = [(bytes(r["text"]), r["lang"]) for r in picked.select("_r.*").toLocalIterator()]
    net = train(sorted(sample))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("_held"))
    kind = rows.schema["_id"].dataType.simpleString()
    done = rows.mapInArrow(lambda it: predict_batches(it, net), f"_id {kind}, held_out boolean, lang_pred string, score double")
    return done.select(F.col("_id").alias(id_col), "held_out", "lang_pred", "score")
