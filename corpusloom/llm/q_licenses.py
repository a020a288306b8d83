"""Query op6: licenses of all documents.

Documents have no path, so one is made: source, then two levels of doc_id.  Documents that
speak of a licence stand for licence files.
"""

from pyspark.sql import functions as F

from corpusloom.llm.licenses import scan_licenses


def as_files(docs):
    name = F.when(F.col("text").rlike("(?i)licen[cs]e"), F.format_string("LICENSE.%d", "doc_id")).otherwise(F.format_string("%d.txt", "doc_id"))
    level = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", F.coalesce("source", F.lit("unknown")), level(2000), level(100), name))
    return docs.select("doc_id", path.alias("path"), "text")


def op6_license_scan(spark, sf_dir):
    return scan_licenses(as_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op6_license_scan": op6_license_scan}
