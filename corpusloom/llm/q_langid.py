"""Query op5: the language of all documents."""

from corpusloom.llm.langid import identify


def op5_langid_bigru(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_langid_bigru": op5_langid_bigru}
