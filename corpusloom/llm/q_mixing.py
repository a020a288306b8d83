"""Query op4: the mix of all documents at production parameters."""

from corpusloom.llm.mixing import taken_words


def op4_source_mix(spark, sf_dir):
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_source_mix": op4_source_mix}

ORACLE_SQL = {
    "op4_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - 3 * coalesce(sum(source_size) OVER b, 0))
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS lev,
         row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / w, rk) AS o
  FROM w WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least((SELECT arg_min(lev, o) FROM l WHERE lev * w <= 3.0::DOUBLE * source_size) * w, 3.0::DOUBLE * source_size) AS target
  FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS m FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (
  SELECT g.source, g.h, g.words, sum(g.words) OVER (PARTITION BY g.source ORDER BY g.h) - g.words AS before_words FROM g),
k AS (
  SELECT c.source, c.h,
         p.m < 3 AND p.target - p.m * p.source_size > 0
         AND p.target - p.m * p.source_size - c.before_words > 0
         AND (p.target - p.m * p.source_size >= c.before_words + c.words
              OR 2 * (p.target - p.m * p.source_size - c.before_words) >= c.words) AS extra
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.m + CASE WHEN k.extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
}
