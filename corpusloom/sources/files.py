"""Reading and writing the engine's files; schemas are given, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators.quality import is_pdf


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^/.]*)*$", 1)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Harvested records (NDJSON, gzip or not) with `discipline`, the file's name up to its first underscore."""
    rows = spark.read.schema(schemas.DUMP).option("pathGlobFilter", "*.gz").json(path)
    return rows.withColumn("discipline", F.element_at(F.split(file_stem(F.input_file_name()), "_"), 1))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array of records each; a file that doesn't parse gives no rows, see `json_files`."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_files(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of files that hold one JSON array each, with their `file`, and a log `file, reason` of files passed over.

    A file goes into the log if it isn't JSON or isn't an array; array entries that aren't
    objects are dropped.  A file is read whole into a row, as JSON arrays can't be split.
    """
    closed = F.col("value").rlike(r"(?s)^\s*(\[.*\]|\{.*\})\s*$")  # the parser reads one value and ignores what follows
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.when(closed, F.try_parse_json("value")).alias("v"))
    listed = F.try_variant_get("v", "$", "array<variant>")
    reason = F.when(F.col("v").isNull(), "not JSON").when(listed.isNull(), "not an array")
    log = whole.select("file", reason.alias("reason")).filter("reason is not null")
    items = whole.select("file", F.explode(F.filter(listed, lambda e: F.schema_of_variant(e).startswith("OBJECT"))).alias("e"))
    return items.select("file", F.from_json(F.to_json("e"), schema).alias("o")).select("file", "o.*"), log


def paired(predictions: DataFrame, sources: DataFrame, key: str = "doc_id", source_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Predictions with their document from the source file of the same name, and a log `file, reason` of files without one.

    Both tables have `file`; of documents with one id in a file any one counts, once.
    """
    stem = lambda c: file_stem(F.col(c))
    docs = sources.select(stem("file").alias("_file"), F.col(source_key).alias("_id"), F.struct(*[c for c in sources.columns if c != "file"]).alias("document"))
    docs = docs.dropDuplicates(["_file", "_id"])
    names = docs.select(F.col("_file").alias("_name")).distinct()
    stemmed = predictions.withColumn("_stem", stem("file"))
    missing = stemmed.join(names, F.col("_stem") == F.col("_name"), "left_anti").select("file", F.lit("no source file").alias("reason")).distinct()
    found = stemmed.join(docs, (F.col("_stem") == F.col("_file")) & (F.col(key) == F.col("_id"))).drop("_stem", "_file", "_id")
    return found, missing


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are passed over and broken lines give no rows, see `ndjson_with_log`."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ndjson_with_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of NDJSON, and the lines that don't parse as `file, line`; blank lines are in neither."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    marked = lines.withColumn("_v", F.when(F.col("line").rlike(r"^\s*\{.*\}\s*$"), F.try_parse_json("line")))
    sound = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    return marked.filter(sound).select(F.from_json("line", schema).alias("o")).select("o.*"), marked.filter(~sound).select("file", "line")


def read_renamed(spark: SparkSession, path: str, columns: dict[str, str], schema: str) -> DataFrame:
    """Chosen columns of NDJSON under other names."""
    return read_ndjson(spark, path, schema).select(*[F.col(a).alias(b) for a, b in columns.items()])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Search-engine statistics -> `lang, lang_n, discipline, n`."""
    buckets = read_json_array(spark, path, schemas.STATS).select(F.inline("buckets"))
    return buckets.select(F.col("key").alias("lang"), F.col("doc_count").alias("lang_n"), F.inline("by_discipline.buckets")).select("lang", "lang_n", F.col("key").alias("discipline"), F.col("doc_count").alias("n"))


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Binary files that carry a PDF signature: `path, content`.  Text comes from a page reader, see `pdf_pages`."""
    return spark.read.format("binaryFile").load(path).select("path", "content").filter(is_pdf(F.col("content")))


def pdf_pages(files: DataFrame, pages_of, least: int = 5) -> DataFrame:
    """`path, pages` of PDFs with more than `least` pages; `pages_of(bytes) -> list[str]` is any PDF library's reader."""

    def run(batches):
        for pdf in batches:
            yield pdf[["path"]].assign(pages=[pages_of(bytes(c)) for c in pdf["content"]])

    return files.mapInPandas(run, "path string, pages array<string>").filter(F.size("pages") > least)


def repaired_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of pretty-printed objects set one after another: split where a line starts with a brace, broken ones go."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.explode(F.split("value", r"(?m)^\{")).alias("p"))
    text = parts.select(F.concat(F.lit("{"), "p").alias("t")).filter(F.trim("t") != "{")
    closed = F.regexp_replace("t", r"[\s,\]]+$", "")
    return text.select(closed.alias("t")).filter(F.try_parse_json("t").isNotNull()).select(F.from_json("t", schema).alias("o")).select("o.*")


def prediction_files(paths: list[str]) -> list[str]:
    """JSON files in order, but those of timings."""
    name = lambda p: p.rstrip("/").rpartition("/")[2].lower()
    return sorted(p for p in paths if name(p).endswith(".json") and "time" not in name(p))


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_ndjson(df: DataFrame, path: str, fresh: bool = False) -> None:
    """Adds rows to what is there; with `fresh`, as the first of a series, it goes first."""
    df.write.mode("overwrite" if fresh else "append").json(path)


def write_parquet(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_array(df: DataFrame, most: int = 100_000) -> str:
    """A small result as one JSON array; raises where there are more than `most` rows."""
    rows = [r[0] for r in df.select(F.to_json(F.struct("*"))).take(most + 1)]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write_ndjson is for those")
    return "[" + ",\n".join(rows) + "]"


def summed_counts(tables: list[DataFrame], key: str, n: str = "n") -> DataFrame:
    """Counts of several files added up by key."""
    return reduce(DataFrame.unionByName, [t.select(key, n) for t in tables]).groupBy(key).agg(F.sum(n).alias(n))
