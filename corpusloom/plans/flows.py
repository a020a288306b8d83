"""Queries on sources, sinks, filters and whole flows: what is written is read again, what is joined is counted."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import chunking, entities as en, text as tx
from corpusloom.operators import align, annotators, linking, relations as rel, silver
from corpusloom.plans.adapters import SQL_MENTIONS, table
from corpusloom.plans.annotations import ORACLE_SQL as ANNOTATION_SQL, SQL_LINKS, given, lines_with_entities, link_rows, relation_entities, relation_rows
from corpusloom.plans.documents import SQL_CHUNKS, turns_as_records
from corpusloom.shared import scratch_dir
from corpusloom.sources import files
from corpusloom.streaming.incremental import resumable


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def folder(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ndjson_round_trip(spark, sf_dir):
    path = folder(spark, "ndjson")
    files.write_ndjson(documents(spark, sf_dir), path)
    return files.read_ndjson(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


def parquet_round_trip(spark, sf_dir):
    path = folder(spark, "parquet")
    files.write_parquet(table(spark, sf_dir, "labels").withColumn("part", F.col("doc_id") % 3), path, "part")
    return files.read_parquet(spark, path).select("doc_id", "quality", "toxic")


def csv_round_trip(spark, sf_dir):
    path = folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), path)
    return spark.read.schema("event_id long, user_id long, event_type string").option("header", True).csv(path)


def append_round_trip(spark, sf_dir):
    """Rows of two runs in one place; what lay there before the first is gone."""
    path = folder(spark, "append")
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    for fresh in (False, True, False):
        files.append_ndjson(rows.filter("doc_id % 2 = 0" if fresh else "doc_id % 2 = 1"), path, fresh)
    return files.read_ndjson(spark, path, "doc_id long, toxic int")


def json_array_round_trip(spark, sf_dir):
    path = folder(spark, "array")
    spark.createDataFrame([(files.json_array(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")),)], "value string").write.text(path)
    return files.read_json_array(spark, path, "n_nationkey int, n_name string")


def dump_scan(spark, sf_dir):
    """Harvested records, gzipped, read with the discipline that their file is named after."""
    path = folder(spark, "dump")
    records = turns_as_records(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.array(F.lit("u")).alias("url"), "in_language", "abstract", "headline")
    records.write.option("compression", "gzip").json(path)
    return files.read_dump(spark, path).select("id", F.get("in_language", F.lit(0)).alias("lang"), F.size("abstract").cast("long").alias("n"))


def renamed_scan(spark, sf_dir):
    path = folder(spark, "renamed")
    files.write_ndjson(documents(spark, sf_dir).select("doc_id", "lang", "n_chars"), path)
    return files.read_renamed(spark, path, {"doc_id": "id", "lang": "in_language"}, "doc_id long, lang string")


def repaired_scan(spark, sf_dir):
    """Objects printed one after another, every seventh cut short."""
    path = folder(spark, "objects")
    rows = table(spark, sf_dir, "labels")
    body = F.concat(F.lit('{\n "doc_id": '), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit(',\n "toxic": '), F.col("toxic").cast("string"))).otherwise(F.lit(",\n")), F.lit("\n}"))
    rows.groupBy((F.col("doc_id") % 5).alias("f")).agg(F.array_join(F.array_sort(F.collect_list(body)), "\n").alias("value")).select("value").repartition(5).write.text(path)
    return files.repaired_objects(spark, path, "doc_id long, toxic int")


def broken_lines(spark, sf_dir):
    """Lines of NDJSON that don't parse, by kind, beside how many do."""
    path = folder(spark, "broken")
    line = F.when(F.col("doc_id") % 5 == 0, "{").when(F.col("doc_id") % 5 == 1, F.lit("[1]")).when(F.col("doc_id") % 5 == 2, F.lit(" ")).otherwise(F.to_json(F.struct("doc_id", "lang")))
    documents(spark, sf_dir).select(line.alias("value")).write.text(path)
    good, log = files.ndjson_with_log(spark, path, "doc_id long, lang string")
    return log.groupBy("line").agg(F.count(F.lit(1)).alias("n")).union(good.agg(F.lit("good"), F.count(F.lit(1))))


def paired_files(spark, sf_dir):
    """Predictions of files by language; one language's source file is missing, another's isn't JSON."""
    path = folder(spark, "paired")
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "lang")
    langs = sorted(r[0] for r in docs.select("lang").filter("lang is not null").distinct().collect())
    for i, lang in enumerate(langs):
        own = docs.filter(F.col("lang") == lang)
        listed = lambda rows: rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ","), F.lit("]")).alias("value"))
        for kind, rows in (("predictions", own.select(F.col("id").alias("doc_id"))), ("sources", own)):
            if kind == "predictions" or i != 0:
                text = listed(rows) if kind == "predictions" or i != 1 else listed(rows).select(F.concat("value", F.lit("?")).alias("value"))
                write_one(spark, text, f"{path}/{kind}/{lang}.json")
    predictions, _ = files.json_files(spark, f"{path}/predictions", "doc_id string")
    sources, log = files.json_files(spark, f"{path}/sources", "id string, lang string")
    found, missing = files.paired(predictions, sources)
    counts = found.groupBy(F.col("document.lang").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return counts.union(missing.unionByName(log).groupBy("reason").agg(F.count(F.lit(1))))


def write_one(spark, text, path):
    """One row as one file of a given name."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(text.first()[0].encode()))
    out.close()


def incremental_copy(spark, sf_dir):
    """A stream over files that is stopped and goes on: each row once."""
    path = folder(spark, "stream")
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    for i in range(2):
        files.append_ndjson(rows.filter(F.col("doc_id") % 2 == i), f"{path}/in")
        resumable(spark, f"{path}/in", "doc_id long, toxic int", lambda df: df.withColumn("twice", F.col("toxic") * 2), f"{path}/out", f"{path}/mark").awaitTermination()
    return files.read_ndjson(spark, f"{path}/out", "doc_id long, toxic int, twice int")


def model_filter(spark, sf_dir):
    spelled = F.element_at(F.array(*map(F.lit, ("llm", " llm ", "gliner", "llm2"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return en.of_model(documents(spark, sf_dir).select("doc_id", spelled.alias("model")), "llm").select("doc_id")


def min_entities_filter(spark, sf_dir):
    return en.with_enough_entities(documents(spark, sf_dir).select("doc_id", given().alias("entities")), 3).select("doc_id", F.size("entities").cast("long").alias("n"))


def domain_filter(spark, sf_dir):
    keyed = documents(spark, sf_dir).select(F.concat_ws("_", "source", "doc_id").alias("doc_id"))
    return linking.from_domain(keyed, "news|wiki|_1")


def null_drop(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    return rows.na.drop(subset=["lang"])


def docs_with_pages(spark, sf_dir):
    """Documents joined to what was fetched for their url."""
    urls = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    docs = urls.select((F.col("page_id") * 2).alias("id")).join(urls.select(F.col("page_id").alias("id"), "url"), "id")
    return linking.with_pages(docs, urls).select("id", "page_id", F.length("html").cast("long").alias("n_chars"))


def lang_counts_union(spark, sf_dir):
    """Counts of several files added up."""
    docs = documents(spark, sf_dir)
    parts = [docs.filter(F.col("doc_id") % 3 == i).groupBy("lang").agg(F.count(F.lit(1)).alias("n")) for i in range(3)]
    return files.summed_counts(parts, "lang")


def elapsed_by_model(spark, sf_dir):
    timings = documents(spark, sf_dir).select(F.concat(F.lit("m"), F.col("doc_id") % 3).alias("name"), (F.col("n_chars") % 64 / 64).alias("elapsed"))
    return annotators.seconds_by_model(timings)


def detected_language(spark, sf_dir):
    """The hook with a toy detector that knows two words and fails on the rest."""

    def detect(text):
        return {" und ": "de", " the ": "en"}[next(w for w in (" und ", " the ") if w in text)]

    return annotators.with_language(documents(spark, sf_dir).select("doc_id", "text"), detect).select("doc_id", "detected")


def plugged_tokenizer(spark, sf_dir):
    """A tokenizer that a user brings: cuts at commas."""
    align.register_tokenizer("commas", align.by_pattern(r"[^,]+"))
    lines = documents(spark, sf_dir).select("doc_id", "text", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))).alias("spans"))
    return align.spans_on_tokens(lines, ["doc_id"], mode="commas").select("doc_id", "first", "last")


class OddLength:
    """A judge that finds one entity, as long as the payload, and none in payloads of even length."""

    def annotate(self, texts):
        return [[{"start": 0, "end": len(t), "label": "X", "text": "", "confidence": 1.0}] if len(t) % 2 else [] for t in texts]


def silver_standard(spark, sf_dir):
    """Lines of documents annotated by a gazetteer, then judged with the links of their chunk."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("in_language"), F.split("text", "\n").alias("text"))
    out = silver.silver_standard(docs, link_rows(spark, sf_dir), annotators.Gazetteer({"The": "Word"}), OddLength(), "gazetteer", "odd", ["ord"])
    ends = F.coalesce(F.get("judged_ents", F.lit(0))["end"], F.lit(0)).cast("long")
    return out.groupBy("doc_id", "lang", "annotator_model", "judge_model").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("annotator_ents")).alias("ents"), F.sum(ends).alias("ends"))


def relation_report(spark, sf_dir):
    chunks = align.align_entities(lines_with_entities(spark, sf_dir), ["doc_id", "line"], with_tokens=False)
    return rel.relation_report(chunks, relation_rows(spark, sf_dir), relation_entities(spark, sf_dir), ["doc_id"]).select("total_chunks", "relations_raw", "relations_kept")


def relation_label_set(spark, sf_dir):
    labels, unruled = rel.relation_labels([" location ", "related to", "location", "made by", ""])
    return spark.createDataFrame([(i, x, x in unruled) for i, x in enumerate(labels)], "position int, label string, unruled boolean")


def chunk_reassembly(spark, sf_dir):
    """Chunks joined again, in order, from rows in any order."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.chunks(F.col("text"))).alias("k", "chunk"))
    by = linking.collected(rows, ["doc_id"], ["k"], F.col("chunk"), "chunks")
    return by.select("doc_id", F.array_join("chunks", " ").alias("text"))


def match_normalisation(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.normalise_for_match(F.col("text")).cast("binary")).alias("digest"))


def token_surfaces(spark, sf_dir):
    """Lines rebuilt from their tokens."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter("text not like '%''%'")
    return lines.select("doc_id", "line", tx.tokens_to_surface(tx.tokens(F.col("text"))).alias("surface"))


QUERIES = {
    f.__name__: f
    for f in (
        ndjson_round_trip, parquet_round_trip, csv_round_trip, append_round_trip, json_array_round_trip, dump_scan, renamed_scan, repaired_scan, broken_lines, paired_files, incremental_copy,
        model_filter, min_entities_filter, domain_filter, null_drop, docs_with_pages, lang_counts_union, elapsed_by_model, detected_language, plugged_tokenizer, silver_standard, relation_report,
        relation_label_set, chunk_reassembly, match_normalisation, token_surfaces,
    )
}

SQL_RELATIONS = ANNOTATION_SQL["relation_constraints"]

ORACLE_SQL = {
    "ndjson_round_trip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "parquet_round_trip": "SELECT doc_id, quality, toxic FROM labels",
    "csv_round_trip": "SELECT event_id, user_id, event_type FROM events",
    "append_round_trip": "SELECT doc_id, CAST(toxic AS INTEGER) AS toxic FROM labels",
    "json_array_round_trip": "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation",
    "dump_scan": "SELECT CAST(conv_id AS VARCHAR) AS id, CASE conv_id % 3 WHEN 2 THEN 'de' ELSE 'fr' END AS lang, count(*) AS n FROM conversations GROUP BY conv_id",
    "renamed_scan": "SELECT doc_id AS id, lang AS in_language FROM documents",
    "repaired_scan": "SELECT doc_id, CAST(toxic AS INTEGER) AS toxic FROM labels WHERE doc_id % 7 <> 0",
    "broken_lines": """SELECT CASE doc_id % 5 WHEN 0 THEN '{' WHEN 1 THEN '[1]' ELSE 'good' END AS line, count(*) AS n FROM documents WHERE doc_id % 5 <> 2 GROUP BY 1""",
    "paired_files": """WITH l AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) AS k FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT lang AS what, n FROM l WHERE k > 2 UNION ALL SELECT 'no source file', 2 UNION ALL SELECT 'not JSON', 1""",
    "incremental_copy": "SELECT doc_id, CAST(toxic AS INTEGER) AS toxic, CAST(toxic * 2 AS INTEGER) AS twice FROM labels",
    "model_filter": "SELECT doc_id FROM documents WHERE doc_id % 4 < 2",
    "min_entities_filter": f"WITH {SQL_MENTIONS} SELECT doc_id, count(*) AS n FROM fa GROUP BY doc_id HAVING count(*) >= 3",
    "domain_filter": "SELECT concat_ws('_', source, doc_id) AS doc_id FROM documents WHERE regexp_matches(concat_ws('_', source, doc_id), 'news|wiki|_1')",
    "null_drop": "SELECT doc_id, lang, CASE WHEN doc_id % 5 <> 0 THEN source END AS source FROM documents WHERE doc_id % 3 <> 0 AND lang IS NOT NULL",
    "docs_with_pages": "SELECT a.page_id AS id, b.page_id, length(b.html) AS n_chars FROM pages a JOIN pages b USING (url) WHERE a.page_id IN (SELECT page_id * 2 FROM pages)",
    "lang_counts_union": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "elapsed_by_model": "SELECT 'm' || (doc_id % 3) AS name, sum(CAST(n_chars % 64 AS DOUBLE) / 64) AS elapsed FROM documents GROUP BY 1",
    "detected_language": "SELECT doc_id, CASE WHEN contains(text, ' und ') THEN 'de' WHEN contains(text, ' the ') THEN 'en' END AS detected FROM documents",
    "plugged_tokenizer": """WITH t AS (SELECT doc_id, len(list_filter(string_split(text, ','), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n > 0 THEN 0 END AS first, CAST(CASE WHEN n > 0 THEN n - 1 END AS INTEGER) AS last FROM t""",
    "silver_standard": f"""WITH {SQL_LINKS}, ln AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
c AS (SELECT doc_id, lang, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS t FROM ln),
g AS (SELECT *, len(regexp_extract_all(' ' || regexp_replace(t, '([^\\p{{L}}\\p{{M}}\\p{{N}}_])', ' \\1 ', 'g') || ' ', ' The ')) AS n FROM c),
w AS (SELECT doc_id, chunk_idx, string_agg('"' || linked_entity || '"', ',' ORDER BY ord) AS l FROM ok GROUP BY ALL),
a AS (SELECT doc_id, k, t FROM c),
p AS (SELECT g.*, length(t) + length('INPUT:' || chr(10) || chr(10) || chr(10) || 'ANNOTATIONS:' || chr(10) || chr(10) || chr(10) || 'LINKED ENTITIES:' || chr(10)) + 2 + length(coalesce(w.l, '')) AS rest
      FROM g LEFT JOIN w ON w.doc_id = g.doc_id AND w.chunk_idx = g.k),
s AS (SELECT doc_id, k, t, unnest(range(1, CAST(length(t) AS BIGINT) - 1)) AS i FROM a WHERE contains(t, 'The')),
f AS (SELECT doc_id, k, i - 1 AS st FROM s WHERE substr(t, i, 3) = 'The' AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[\\p{{L}}\\p{{M}}\\p{{N}}_]'))
        AND (i + 3 > length(t) OR NOT regexp_matches(substr(t, i + 3, 1), '[\\p{{L}}\\p{{M}}\\p{{N}}_]'))),
e AS (SELECT doc_id, k, count(*) AS m, sum(length('{{"start":' || st || ',"end":' || (st + 3) || ',"label":"Word","text":"The","confidence":1.0}}')) + count(*) - 1 AS len FROM f GROUP BY ALL),
z AS (SELECT p.*, coalesce(e.m, 0) AS m, rest + 2 + coalesce(e.len, 0) AS total FROM p LEFT JOIN e ON e.doc_id = p.doc_id AND e.k = p.k)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, 'gazetteer' AS annotator_model, 'odd' AS judge_model, count(*) AS chunks, CAST(sum(m) AS BIGINT) AS ents,
  CAST(sum(CASE WHEN total % 2 = 1 THEN total ELSE 0 END) AS BIGINT) AS ends FROM z GROUP BY ALL""",
    "relation_report": f"""WITH {SQL_MENTIONS}, ln AS (SELECT len(string_split(text, chr(10))) AS n FROM documents)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM ln) AS total_chunks, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM fa GROUP BY doc_id)) AS relations_raw,
  (SELECT count(*) FROM ({SQL_RELATIONS})) AS relations_kept""",
    "relation_label_set": "SELECT * FROM (VALUES (0, 'location', FALSE), (1, 'related to', FALSE), (2, 'made by', TRUE)) v(position, label, unruled)",
    "chunk_reassembly": f"WITH RECURSIVE {SQL_CHUNKS} SELECT doc_id, array_to_string(l, ' ') AS text FROM c0",
    "match_normalisation": r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}_]+', '', 'g')) AS digest FROM documents",
    "token_surfaces": r"""WITH ln AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), li AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS text FROM ln),
t AS (SELECT doc_id, line, array_to_string(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}_]+(?:[-_][\p{L}\p{M}\p{Nd}_]+)*|\S'), ' ') AS s FROM li WHERE NOT contains(text, chr(39)))
SELECT doc_id, CAST(line AS INTEGER) AS line, trim(regexp_replace(regexp_replace(regexp_replace(s, '\s+([,.;:!?%])', '\1', 'g'), '([(\[{])\s+', '\1', 'g'), '\s+([)\]}])', '\1', 'g')) AS surface FROM t""",
}
