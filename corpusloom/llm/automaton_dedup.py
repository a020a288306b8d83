"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.repeats import Words, id_of, without_repeats

KGRAM = 16


class SuffixAutomaton:
    """All substrings of the sequences added so far, over hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, symbol, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:  # another sequence went this way
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, symbol, q)
                continue
            p, new = last, self._state(self.length[last] + 1, 0, {})
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, symbol, q)
            last = new

    def statistics(self, sequence) -> list[int]:
        """For each place, how many symbols up to it, it included, occur in the automaton."""
        out, state, length = [], 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            out.append(length)
        return out


def automaton_repeats(size: int):
    """Resolver: one automaton for each k-gram's shard, of the contexts of earlier documents."""

    def resolve(texts: list[bytes], group: np.ndarray, doc: np.ndarray):
        shard, waiting = SuffixAutomaton(), []
        for i, text in enumerate(texts):
            if i and group[i] != group[i - 1]:
                shard, waiting = SuffixAutomaton(), []
            elif i and doc[i] != doc[i - 1]:
                for words in waiting:
                    shard.add(words)
                waiting = []
            words = text.split(b" ")
            waiting.append(words)
            yield np.array(shard.statistics(words)[size - 1 :]) >= size

    return resolve


def automaton_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, k: int = KGRAM) -> DataFrame:
    """Removes every word covered by a `size`-word window that also starts in an earlier document.

    Words are what lies between white space (U+0020, U+0009 to U+000D); earlier is a smaller
    id; windows are judged on the input.  Reference shards are dealt out by k-gram: each
    document's passages stream only through the automata of the shards that could match
    them, since handing every shard to every task would read the corpus once for each shard.

    Returns one row for each row of `docs`: `id_col, n_words, n_removed, spans` (of words)
    and `kept` (words left, joined by one space).  Null text has no words; null ids come
    after all others, rows equal in id and text count as one document, each with its
    result; of one id, texts are ordered by hash and later ones lose what earlier ones
    have.  Texts of any length are
    read whole, in overlapping pieces; an empty table gives an empty result; other columns don't take part, whatever
    their names.
    """
    done = without_repeats(docs, id_col, text_col, Words, size, k, automaton_repeats(size), within=False)
    return done.select(id_of(done, id_col), F.col("_n").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("spans"), F.col("_kept").alias("kept"))
