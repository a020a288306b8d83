"""Chunking of text by characters: greedy cuts at the best boundary, overlap from the chunk before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE, LEAST, OVERLAP = 512, 20, 50


def chunks(text: Column, size: int = SIZE, least: int = LEAST) -> Column:
    """Pieces of at most `size` characters, cut after the last white space that fits, or hard.

    Pieces are trimmed; those under `least` characters are left out.  One pattern does it:
    as many characters as fit, up to white space or the end, else `size` of them.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\S.{{0,{size - 1}}}(?=\s|\z)|\S.{{0,{size - 1}}}"), 0)
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"\s+\z", "")), lambda p: F.length(p) >= least)


def with_overlap(pieces: Column, overlap: int = OVERLAP) -> Column:
    """Each piece but the first with the last `overlap` characters of the one before in front."""
    return F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.right(F.get(pieces, i - 1), F.lit(overlap)), p)))


def rejoined(blocks: Column, clean=lambda x: x) -> Column:
    """Blocks of a document cleaned and joined by a blank, ready for chunking."""
    return F.array_join(F.transform(blocks, clean), " ")
