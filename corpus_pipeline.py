"""The corpus pipeline: five stages from raw documents to a mix without toxic, repeated or leaked text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents; all but the last return the columns of
`documents`.  All stages judge rows by their text, whatever their ids: null and repeated ids,
null, empty and very long texts, repeated rows, empty tables and further columns of any name
are defined for each below and in the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontam import without_matches
from corpusloom.llm.mixing import mixed
from corpusloom.llm.near_copies import one_of_each
from corpusloom.llm.q_toxicity import REJECT
from corpusloom.llm.suffix_dedup import without_repeated_text
from corpusloom.llm.toxicity import without_toxic
from corpusloom.shared import stash


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the rejection level.

    Null and empty texts have the severity of a text without features and stay, repeated rows
    share their fate, and nothing goes where the labels know fewer than two grades.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), REJECT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, 0.8 alike in five-word shingles.

    A null id comes last, of equal ids the text's hash decides, of rows equal in id and text
    one stays; all null and empty texts are one group.
    """
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 100 bytes and more that start earlier in the corpus.

    Null texts stay null, texts under 100 bytes stay whole, characters that a cut goes through
    go; `n_chars` follows the text.
    """
    return without_repeated_text(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts hold none."""
    return without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies and the words taken; a null source is a source of its own, documents without words have none to take."""
    return mixed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
]

#: Sorting suffixes, fingerprints and the fitted model are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
