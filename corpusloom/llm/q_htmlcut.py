"""Query op7: main text of all pages."""

from corpusloom.llm.htmlcut import extract_text


def op7_html_mincut(spark, sf_dir):
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_html_mincut": op7_html_mincut}
