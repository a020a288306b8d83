"""Query op10: documents that hold benchmark passages."""

from corpusloom.llm.decontam import benchmark_matches


def op10_decontam_simhash(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return benchmark_matches(read("documents"), read("benchmark"))


QUERIES = {"op10_decontam_simhash": op10_decontam_simhash}
