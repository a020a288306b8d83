"""Query op8: near-duplicate groups of all documents."""

from corpusloom.llm.simhash import near_duplicates


def op8_simhash_ball(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_simhash_ball": op8_simhash_ball}
