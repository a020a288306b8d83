"""Alignment of character spans with tokens; what built-in functions can't say runs in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Thresholds of the alignment, the weight of nearness, and how surfaces are joined.
REALIGN_BELOW, ACCEPT_FROM, NEARNESS = 0.75, 0.70, 0.05
SURFACE_FIXES = ((re.compile(r"\s+([,.;:!?%])"), r"\1"), (re.compile(r"([(\[{])\s+"), r"\1"), (re.compile(r"\s+([)\]}])"), r"\1"), (re.compile(r"\s+'\s+"), "'"))
#: Tokens or spans that an Arrow batch holds before it is handed on.
FULL = 50_000
SPAN = "struct<start_token:int, end_token:int, label:string, text:string, text_tokenized:string, char_start:int, char_end:int, confidence:double, alignment_method:string, alignment_score:double>"

Tokenizer = Callable[[str], "list[tuple[int, int]] | np.ndarray"]  # a text's tokens as (start, end), in order


def by_pattern(pattern: str) -> Tokenizer:
    found = re.compile(pattern).finditer
    return lambda text: [m.span() for m in found(text)]


_regex = by_pattern(r"\w+(?:[-_]\w+)*|\S")
#: 0 for white space, 1 for what a word has, 2 for the rest, of the code points below.
KINDS = np.array([0 if chr(c).isspace() else 1 if chr(c).isalnum() or c == ord("_") else 2 for c in range(0x3000)], dtype=np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def words_and_signs(text: str) -> list[tuple[int, int]] | np.ndarray:
    """Words, hyphens inside included, and single signs: the tokens of `_regex`, by arrays where the code points are in the table."""
    codes = code_points(text)
    if len(codes) < 2 or codes.max() >= len(KINDS):
        return _regex(text)
    kind = KINDS[codes]
    word = kind == 1
    inner = np.zeros(len(text), dtype=bool)
    inner[1:-1] = (codes[1:-1] == ord("-")) & word[:-2] & word[2:]
    word |= inner
    sign = (kind == 2) & ~inner
    first, last = sign | word, sign | word
    first[1:] &= sign[1:] | ~word[:-1]
    last[:-1] &= sign[:-1] | ~word[1:]
    return np.stack((np.flatnonzero(first), np.flatnonzero(last) + 1), axis=1)


_tokenizers: dict[str, Tokenizer] = {"regex": words_and_signs, "whitespace": by_pattern(r"\S+")}


def register_tokenizer(name: str, tokenizer: Tokenizer) -> None:
    """Makes any tokenizer available by name, for example one that a library brings."""
    _tokenizers[name] = tokenizer


def tokenizer(name: str) -> Tokenizer:
    if name not in _tokenizers:
        raise ValueError(f"no tokenizer {name!r}; known are {sorted(_tokenizers)}")
    return _tokenizers[name]


NOT_WORD = re.compile(r"\W+")


def matchable(text: str) -> str:
    return _matchable(text) if len(text) < 100 else NOT_WORD.sub("", text.lower())


@lru_cache(1 << 16)
def _matchable(text: str) -> str:
    return NOT_WORD.sub("", text.lower())


def matched(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; pairs of words come back often and are kept."""
    return _matched(a, b) if len(a) + len(b) < 100 else SequenceMatcher(None, a, b).ratio()


@lru_cache(1 << 16)
def _matched(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of letters and digits; 0 if either has none.  Order matters."""
    a, b = matchable(a), matchable(b)
    return matched(a, b) if a and b else 0.0


@dataclass(frozen=True)
class Place:
    """A run of tokens (ends inclusive), how it was found and how well it fits."""

    first: int
    last: int
    method: str
    score: float


class Tokens:
    """A chunk's tokens with offsets, and the runs of them that resemble a surface."""

    def __init__(self, text: str, cut: Tokenizer):
        self.text = text
        self.spans = np.asarray(cut(text), dtype=np.int64).reshape(-1, 2)
        self._counts: dict[str, np.ndarray] = {}
        self._runs: dict[range, tuple[np.ndarray, ...]] = {}

    @cached_property
    def words(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.starts, self.ends, strict=True)]

    @cached_property
    def starts(self) -> list[int]:
        return self.spans[:, 0].tolist()

    @cached_property
    def ends(self) -> list[int]:
        return self.spans[:, 1].tolist()

    @cached_property
    def letters(self) -> tuple[str, np.ndarray]:
        """What of the tokens can match as one string, and where each token's part starts in it.

        What joins tokens to a surface can't match, so a run's part is that of its surface;
        only the form of a sigma hangs on its neighbours, see `run`.
        """
        whole, codes = matchable(self.text), code_points(self.text)
        if len(codes) and codes.max() < len(KINDS):
            upto = np.concatenate(([0], np.cumsum(KINDS[codes] == 1)))
            at = np.concatenate(([0], np.cumsum(upto[self.spans[:, 1]] - upto[self.spans[:, 0]])))
            if at[-1] == len(whole) and (self.spans[1:, 0] >= self.spans[:-1, 1]).all():  # the tokens leave out nothing that can match
                return whole, at
        parts = [matchable(w) for w in self.words]
        return "".join(parts), np.cumsum([0, *map(len, parts)])

    @cached_property
    def codes(self) -> np.ndarray:
        return code_points(self.letters[0].replace("ς", "σ"))

    def counts(self, letter: str) -> np.ndarray:
        """How often the letter comes before each token's start; both forms of sigma are one."""
        if letter not in self._counts:
            self._counts[letter] = np.concatenate(([0], np.cumsum(self.codes == ord(letter), dtype=np.int32)))[self.letters[1]]
        return self._counts[letter]

    def run(self, first: int, last: int) -> str:
        """What of a run of tokens can match."""
        if "Σ" in self.text:
            return matchable(self.surface(first, last))
        whole, at = self.letters
        return whole[at[first] : at[last + 1]]

    def surface(self, first: int, last: int) -> str:
        text = " ".join([self.text[a:b] for a, b in zip(self.starts[first : last + 1], self.ends[first : last + 1], strict=True)])
        if text.split() == [text]:
            return text
        for pattern, to in SURFACE_FIXES:
            text = pattern.sub(to, text)
        return text.strip()

    def covering(self, start: int, end: int) -> tuple[int, int] | None:
        """First and last token that overlap [start, end)."""
        first, last = bisect_right(self.ends, start), bisect_left(self.starts, end) - 1
        return (first, last) if first <= last else None

    def runs(self, lengths: range) -> tuple[np.ndarray, ...]:
        """All runs of so many tokens that hold a letter or digit: first tokens, ends (exclusive), and how much of each can match."""
        if lengths not in self._runs:
            n, at = len(self.spans), self.letters[1]
            fits = [k for k in lengths if k <= n]
            first = np.concatenate([np.arange(n - k + 1) for k in fits]) if fits else np.zeros(0, dtype=int)
            end = first + np.repeat(fits, [n - k + 1 for k in fits]).astype(int)
            size = at[end] - at[first]
            self._runs[lengths] = first[size > 0], end[size > 0], size[size > 0]
        return self._runs[lengths]

    def lookup(self, surface: str, near: int | None, least: float = 0.0) -> Place | None:
        """The run most like `surface`: greatest ratio plus nearness, then shortest, then leftmost.

        Runs of two words fewer to four words more than the surface has (one to six, if it
        has none) are candidates.  They are tried in order of what the letters that they share
        with the surface allow at best, until none left could win.  Runs that can't reach
        `least`, nearness included, are not tried; where all runs are below, there is no place.
        """
        wanted = matchable(surface)
        n_words = len(re.findall(r"\w+", surface))
        first, end, size = self.runs(range(max(1, n_words - 2), n_words + 5) if n_words else range(1, 7))
        if not wanted or not len(first):
            return None
        within = 2.0 * np.minimum(size, len(wanted)) / (len(wanted) + size) >= least - NEARNESS - 1e-9
        first, end, size = first[within], end[within], size[within]
        folded = wanted.replace("ς", "σ")
        shared = np.zeros(len(first), dtype=np.int32)
        for letter in set(folded):
            upto = self.counts(letter)
            shared += np.minimum(upto[end] - upto[first], folded.count(letter))
        most = 2.0 * shared / (len(wanted) + size)
        if near is not None:
            most = most + NEARNESS * (1.0 - np.minimum(np.abs(first - near) / len(self.spans), 1.0))
        likely = np.flatnonzero(most >= least)
        bonus = lambda first: 0.0 if near is None else NEARNESS * (1.0 - min(abs(first - near) / len(self.spans), 1.0))
        best: tuple | None = None
        for i in likely[np.argsort(-most[likely])]:
            if best and most[i] < best[0]:
                break
            a, b = int(first[i]), int(end[i]) - 1
            ratio = matched(wanted, self.run(a, b))
            rank = (ratio + bonus(a), a - b, -a, ratio)
            best = rank if best is None else max(best, rank)
        return Place(-best[2], -best[2] - best[1], "text_fuzzy", best[3]) if best else None

    def place(self, start: int, end: int, surface: str) -> Place | None:
        """Where an entity lies: at its offsets, unless its surface fits elsewhere and not there."""
        at = self.covering(start, end)
        given = Place(*at, "char_offset", similarity(self.surface(*at), surface)) if at else None
        if not surface or (given and given.score >= REALIGN_BELOW):
            return given
        other = self.lookup(surface, given.first if given else None, ACCEPT_FROM)
        return other if other and other.score >= ACCEPT_FROM else given


def placed(tokens: Tokens, entities: list[tuple]) -> list[tuple]:
    """Entities (start, end, label, text, confidence) on tokens, as tuples of SPAN's fields; see `aligned`."""
    found: dict[tuple[int, int, str], tuple] = {}
    for start, end, label, text, confidence in entities:
        surface = (text or "").strip()
        p = tokens.place(start, end, surface)
        if p is not None and (p.first, p.last, label) not in found:
            at = tokens.starts[p.first], tokens.ends[p.last]
            found[p.first, p.last, label] = (p.first, p.last, label, surface, tokens.surface(p.first, p.last) or surface, *at, confidence, p.method, round(p.score, 4))
    return list(found.values())


ENTITY = ("start", "end", "label", "text", "confidence")
SPAN_FIELDS = [pa.field(*f) for f in (
    ("start_token", pa.int32()), ("end_token", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("text_tokenized", pa.string()), ("char_start", pa.int32()),
    ("char_end", pa.int32()), ("confidence", pa.float64()), ("alignment_method", pa.string()), ("alignment_score", pa.float64()),
)]


def aligned(text: str, entities: list[dict], mode: str | Tokenizer = "regex") -> list[dict]:
    """Entities on tokens (inclusive ends), each span and label once, the first of equals.

    A span whose tokens resemble the surface by less than REALIGN_BELOW, or that covers no
    token, is looked for by surface; a match from ACCEPT_FROM on is taken, else the
    character mapping stays.  Entities without either go.
    """
    tokens = Tokens(text or "", tokenizer(mode) if isinstance(mode, str) else mode)
    rows = placed(tokens, [tuple(e[c] for c in ENTITY) for e in entities or []])
    return [dict(zip([f.name for f in SPAN_FIELDS], r, strict=True)) for r in rows]


def members(column: pa.Array, names: tuple[str, ...]) -> Callable[[int], list[tuple]]:
    """The structs of each row's array as tuples of the named fields; a missing array has none."""
    at, values, there = column.offsets.to_pylist(), column.values, column.is_valid().to_pylist()
    kept = values.slice(at[0], at[-1] - at[0])
    fields = list(zip(*[kept.field(n).to_pylist() for n in names], strict=True))
    return lambda i: fields[at[i] - at[0] : at[i + 1] - at[0]] if there[i] else []


def nested(rows: list[list], build: Callable[[list], pa.Array]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), build([x for row in rows for x in row]))


def spans_array(rows: list[tuple]) -> pa.Array:
    columns = zip(*rows, strict=True) if rows else [()] * len(SPAN_FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SPAN_FIELDS, strict=True)], fields=SPAN_FIELDS)


def align_entities(chunks: DataFrame, keys: list[str], text_col: str = "text", entities_col: str = "entities", mode: str = "regex", with_tokens: bool = True) -> DataFrame:
    """`keys, tokens, entities`: each chunk's tokens and its entities on them; `mode` names a tokenizer.

    Without tokens, chunks that have no entities need not be cut.
    """
    cut = tokenizer(mode)  # looked up here, so that executors need no registration

    def batch_of(batch: pa.RecordBatch, begin: int, words: list[list[str]], found: list[list[tuple]]) -> pa.RecordBatch:
        own = [batch.column(j).slice(begin, len(words)) for j in range(len(keys))]
        tokens = [nested(words, lambda x: pa.array(x, pa.string()))] if with_tokens else []
        return pa.RecordBatch.from_arrays([*own, *tokens, nested(found, spans_array)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, words, found, begin, n = members(batch.column(len(keys) + 1), ENTITY), [], [], 0, 0
            for i, text in enumerate(batch.column(len(keys))):
                own = given(i)
                tokens = Tokens(text.as_py() or "" if own or with_tokens else "", cut)
                words.append(tokens.words if with_tokens else [])
                found.append(placed(tokens, own))
                n += len(words[-1]) + len(found[-1])
                if n > FULL:
                    yield batch_of(batch, begin, words, found)
                    words, found, begin, n = [], [], i + 1, 0
            if words:
                yield batch_of(batch, begin, words, found)

    kinds = {k: chunks.schema[k].dataType.simpleString() for k in keys} | ({"tokens": "array<string>"} if with_tokens else {}) | {"entities": f"array<{SPAN}>"}
    return chunks.select(*keys, text_col, entities_col).mapInArrow(run, ", ".join(f"`{k}` {kind}" for k, kind in kinds.items()))


def spans_on_tokens(df: DataFrame, keys: list[str], text_col: str = "text", spans_col: str = "spans", mode: str = "regex") -> DataFrame:
    """Character spans (structs with `start, end`) -> `keys, start, end, first, last`: each once, with the tokens that overlap it, null if none does.

    Everything happens inside the row, in batches: tokens are cut and searched by bisection, nothing is shuffled.
    """
    cut = tokenizer(mode)

    def batch_of(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        taken = pa.array(rows, pa.int64())
        spans = [pa.array(c, pa.int32()) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(j).take(taken) for j in range(len(keys))], *spans], names=[*keys, "start", "end", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, rows, found = members(batch.column(len(keys) + 1), ("start", "end")), [], []
            for i, text in enumerate(batch.column(len(keys))):
                spans = dict.fromkeys(given(i))
                if spans:
                    tokens = Tokens(text.as_py() or "", cut)
                    rows += [i] * len(spans)
                    found += [(start, end, *(tokens.covering(start, end) or (None, None))) for start, end in spans]
                if len(found) > FULL:
                    yield batch_of(batch, rows, found)
                    rows, found = [], []
            if rows:
                yield batch_of(batch, rows, found)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text_col, spans_col).mapInArrow(run, f"{kinds}, start int, end int, first int, last int")
