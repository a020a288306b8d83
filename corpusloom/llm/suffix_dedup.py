"""Suffix-array dedup: removes bytes of passages that start earlier in the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.repeats import Bytes, id_of, without_repeats
from corpusloom.llm.suffix import equal_windows

KGRAM = 24


def sorted_repeats(size: int, within: bool):
    """Resolver: sorts the suffixes of all contexts by difference cover, compares adjacent prefixes."""

    def resolve(texts: list[bytes], group: np.ndarray, doc: np.ndarray):
        joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lengths = np.array([len(t) for t in texts])
        windows = lengths - size + 1
        begin = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), windows)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        text = joined.astype(np.int64) + 1
        classes = equal_windows(text, begin[owner] + offset, size)
        order = owner if within else doc[owner]
        earliest = np.full(classes.max(initial=0) + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, classes, order)
        repeat = order > earliest[classes]
        return np.split(repeat, np.cumsum(windows)[:-1])

    return resolve


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, k: int = KGRAM) -> DataFrame:
    """Removes every byte that a `size`-byte string covers which also starts earlier.

    Texts are UTF-8 bytes; earlier is a smaller id, or an earlier start in the same
    document (overlaps count).  Strings are judged on the input; matches never cross
    documents.  Returns one row for each row of `docs`: `id_col, n_bytes, n_removed,
    spans` (removed ranges) and `kept` (the bytes left).

    Null text counts as empty; texts under `size` bytes keep all; null ids come after all
    others, rows equal in id and text count as one document, each with its result; of one
    id, texts are ordered by hash.  Texts of any length are
    read whole, in overlapping pieces; an empty table gives an empty result; other columns
    of `docs` don't take part, whatever
    their names.
    """
    done = without_repeats(docs, id_col, text_col, Bytes, size, k, sorted_repeats(size, True), within=True)
    return done.select(id_of(done, id_col), F.col("_n").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("spans"), F.col("_kept").alias("kept"))


def without_repeated_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """`docs` with the text that `suffix_dedup` keeps; characters cut in two go whole, other columns stay."""
    others = [c for c in docs.columns if c != text_col]
    done = without_repeats(docs, id_col, text_col, Bytes, size, KGRAM, sorted_repeats(size, True), within=True, carry=[*others, text_col], characters=True)
    text = F.when(F.col("_removed") == 0, F.col(f"_carry.{text_col}")).otherwise(F.col("_kept").cast("string"))
    return done.select(*[text.alias(c) if c == text_col else F.col(f"_carry.{c}").alias(c) for c in docs.columns])
