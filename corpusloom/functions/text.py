"""Text cleaning and measuring as column expressions; Unicode classes throughout."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scripts that count as real ones in the quality check.
SCRIPTS = (
    "Latin", "Cyrillic", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Devanagari", "Thai", "Greek", "Bengali",
    "Ethiopic", "Myanmar", "Georgian", "Khmer", "Lao", "Tamil", "Telugu", "Gujarati", "Gurmukhi", "Malayalam", "Sinhala",
)

#: Line ends other than \r\n, as Unicode text tools split them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# The patterns of cleaning from here to `clean_page`, their limits and those of `is_good`.
def fix_hyphenation(text: Column) -> Column:
    """Joins words that a hyphen splits over a line end."""
    return F.regexp_replace(text, r"(?U)(\w+)-\n(\w+)", "$1$2")


def collapse_whitespace(text: Column) -> Column:
    """Runs of blanks become one, white space before a line end goes, and blank lines with it."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"(?U)\s+\n", "\n")


def lines(text: Column) -> Column:
    """Lines without their ends; a trailing line end starts no further line, empty text has none."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_gibberish(line: Column) -> Column:
    """Short, symbol-heavy, with odd symbols, or with six consonants in a row."""
    n = F.length(line)
    symbols = n - count(line, r"[\p{L}\p{N}]") - count(line, r"(?U)\s")
    heavy = F.when(n > 0, symbols.cast("double") / n > 0.4).otherwise(F.lit(True))
    return (n < 3) | heavy | line.rlike(r"[\p{So}\p{Cn}\p{Cs}]") | F.lower(line).rlike("[bcdfghjklmnpqrstvwxyz]{6,}")


def normalise(text: Column) -> Column:
    """Default repair of encoding damage: control characters but tab and line end go.  Pass another for more."""
    return F.regexp_replace(text, r"[\x00-\x08\x0e-\x1b\x7f]", "")


def clean_page(text: Column, repair=normalise) -> Column:
    """Repaired, unhyphenated text without gibberish lines and lines of five characters or fewer."""
    kept = F.filter(lines(collapse_whitespace(fix_hyphenation(repair(text)))), lambda x: ~is_gibberish(strip(x)) & (F.length(strip(x)) > 5))
    return F.array_join(kept, "\n")


def with_measures(df: DataFrame, text_col: str) -> DataFrame:
    """Adds what the page-quality rule looks at, of text with white space stripped.

    The text is reduced to its letters once, and those to what isn't Latin; scripts are only
    counted on that rest, which is empty for most texts.  Steps are columns of their own, so
    that no pattern runs twice.
    """
    steps = df.withColumn("_t", strip(F.col(text_col))).withColumn("_letters", F.regexp_replace("_t", r"\P{L}+", ""))
    steps = steps.withColumn("_rest", F.regexp_replace("_letters", rf"\p{{Is{SCRIPTS[0]}}}+", ""))
    counted = F.array(*[count(F.col("_rest"), rf"\p{{Is{s}}}") for s in SCRIPTS[1:]])
    steps = steps.withColumn("_others", F.when(F.col("_rest") != "", counted).otherwise(F.array(F.lit(0))))
    n, rest = F.length("_letters"), F.length("_rest")
    return steps.withColumns(
        {
            "n_chars": F.length("_t"),
            "letters": n,
            "other_letters": rest - F.aggregate("_others", F.lit(0), lambda a, x: a + x),
            "scripts": (n > rest).cast("int") + F.size(F.filter("_others", lambda x: x > 0)),
            "symbols": count(F.col("_t"), r"\p{S}"),
            "words": count(F.col("_t"), r"\p{L}+"),
        }
    ).drop("_t", "_letters", "_rest", "_others")


def is_good(m: dict[str, Column]) -> Column:
    """Enough letters and words, mostly of known scripts and few of them, not mostly symbols."""
    n, letters = m["n_chars"].cast("double"), m["letters"]
    return (letters >= 30) & (letters >= 0.05 * n) & (m["other_letters"] <= 0.85 * letters) & (m["scripts"] <= 4) & (m["symbols"] <= 0.25 * n) & (m["words"] >= 10)


def url_domain(url: Column) -> Column:
    return F.coalesce(F.get(F.split(url, "/"), F.lit(2)), F.lit(""))


def redirect_domain(url: Column, redirects: dict[str, str]) -> Column:
    """The url with its domain replaced where `redirects` says so."""
    if not redirects:
        return url
    parts = F.split(url, "/")
    target = F.try_element_at(F.create_map(*[F.lit(x) for kv in redirects.items() for x in kv]), url_domain(url))
    moved = F.concat_ws("/", F.slice(parts, 1, 2), F.array(target), F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))))
    return F.when(target.isNull(), url).otherwise(moved)


def normalise_surface(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def normalise_for_match(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\W+", "")


REGEX_TOKEN = r"(?U)\w+(?:[-_]\w+)*|\S"
WHITESPACE_TOKEN = r"(?U)\S+"


def tokens(text: Column, pattern: str = REGEX_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def token_offsets(text: Column, pattern: str = REGEX_TOKEN) -> Column:
    """Tokens of a short text as {text, start, end}, in code points, ends exclusive.

    Tokens and the white space between them follow each other, so a token starts where the
    lengths before it add up to.  Arrays grow in a fold here; `token_rows` is for long texts.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)\s+|" + pattern.removeprefix("(?U)")), 0)
    kind = "array<struct<text:string,start:int,end:int>>"
    state = f"struct<at:int, out:{kind}>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")).cast(state)

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        grown = F.array_append(acc["out"], F.struct(piece, acc["at"], end).cast("struct<text:string,start:int,end:int>"))
        return F.struct(end.alias("at"), F.when(piece.rlike(r"(?U)^\s"), acc["out"]).otherwise(grown).alias("out")).cast(state)

    return F.aggregate(pieces, begin, step, lambda acc: acc["out"])


def token_rows(df: DataFrame, keys: list[str], text_col: str, pattern: str = REGEX_TOKEN) -> DataFrame:
    """`keys, idx, token, start, end`: one row for each token of texts of any length.

    Offsets lie within a row, so they come from one scan of the text in an Arrow batch
    function; nothing is shuffled and a batch of tokens is handed on before it grows large.
    """
    found = re.compile(pattern.removeprefix("(?U)")).finditer

    def rows_of(batch: pa.RecordBatch, rows: list, spans: list, tokens: list) -> pa.RecordBatch:
        counts = [len(s) for s in spans]
        at = np.concatenate([np.array(s, dtype=np.int32).reshape(-1, 2) for s in spans])
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
        taken = pa.array(np.repeat(np.array(rows, dtype=np.int64), counts))
        arrays = [*[batch.column(j).take(taken) for j in range(len(keys))], pa.array(place), pa.array(tokens, pa.string()), pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, "idx", "token", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, tokens = [], [], []
            for i, value in enumerate(batch.column(len(keys))):
                text = value.as_py() or ""
                own = [m.span() for m in found(text)]
                if own:
                    rows.append(i)
                    spans.append(own)
                    tokens += [text[a:b] for a, b in own]
                if len(tokens) > 100_000:
                    yield rows_of(batch, rows, spans, tokens)
                    rows, spans, tokens = [], [], []
            if rows:
                yield rows_of(batch, rows, spans, tokens)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text_col).mapInArrow(run, f"{kinds}, idx int, token string, start int, end int")


def char_to_token_span(offsets: Column, start: Column, end: Column) -> Column:
    """{first, last} token that overlaps [start, end), both inclusive; null if none does."""
    overlap = F.filter(F.transform(offsets, lambda t, i: F.when((t["end"] > start) & (t["start"] < end), i)), lambda i: i.isNotNull())
    return F.when(F.size(overlap) > 0, F.struct(F.array_min(overlap).alias("first"), F.array_max(overlap).alias("last")))


def tokens_to_surface(words: Column) -> Column:
    """Tokens joined by blanks, without the blanks that punctuation doesn't want."""
    text = F.array_join(words, " ")
    for pattern, to in ((r"(?U)\s+([,.;:!?%])", "$1"), (r"(?U)([(\[{])\s+", "$1"), (r"(?U)\s+([)\]}])", "$1"), (r"(?U)\s+'\s+", "'")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)
