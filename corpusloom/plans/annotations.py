"""Queries on entities, tags, links and relations derived from the documents."""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import entities as en, text as tx
from corpusloom.operators import align, evaluate as ev, linking, relations as rel
from corpusloom.plans.adapters import LABELS, MENTION, SQL_MENTIONS, annotated, mentions, table



def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def given(extra=None):
    """A document's mentions as entities inside its row: start 3 i, end 3 i + n."""
    found = F.regexp_extract_all("text", F.lit(MENTION), 0)
    labels = F.array(*map(F.lit, LABELS))

    def one(t, i):
        n = F.length(t)
        conf = F.lit(0.5) + ((F.col("doc_id") * 7 + i * 13 + n) % 50).cast("double") / 100
        return F.struct((i * 3).alias("start"), (i * 3 + n).alias("end"), F.element_at(labels, n % 4 + 1).alias("label"), t.alias("text"), conf.alias("confidence"))

    return F.transform(found, one)


def responses(spark, sf_dir):
    """`doc_id, attempts`: model answers in several spellings; kind 4 and 5 fail at first, 6 always."""
    plain = F.to_json(given())
    kind = F.col("doc_id") % 7
    fence = F.concat(F.lit("```json"), plain, F.lit("```"))
    thought = F.concat(F.lit("<think>so</think>"), plain)
    literal = F.replace(plain, F.lit('"'), F.lit("'"))
    broken = F.concat(plain, F.lit(" and so on"))
    bold = F.to_json(F.transform(given(), lambda e: e.withField("confidence", e["confidence"] + 1)))
    attempts = (
        F.when(kind == 0, F.array(plain)).when(kind == 1, F.array(fence)).when(kind == 2, F.array(thought)).when(kind == 3, F.array(literal))
        .when(kind == 4, F.array(broken, plain)).when(kind == 5, F.array(bold, broken, fence)).otherwise(F.array(broken, F.lit("none"), bold, plain))
    )
    return documents(spark, sf_dir).select("doc_id", attempts.alias("attempts"))


def parse_llm_response(spark, sf_dir):
    from corpusloom.operators.annotators import answers_to_entities

    found = answers_to_entities(responses(spark, sf_dir))
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.coalesce(F.aggregate("entities", F.lit(0).cast("long"), lambda a, e: a + e["end"]), F.lit(0)).alias("sum_end"))


def validate_entities(spark, sf_dir):
    """Of single answers: whether all their entities are sound."""
    odd = F.transform(given(), lambda e: e.withField("confidence", e["confidence"] + F.when(F.col("doc_id") % 2 == 0, 0.0).otherwise(0.02)))
    rows = documents(spark, sf_dir).select("doc_id", F.to_json(odd).alias("doc"))
    return rows.select("doc_id", en.validated(F.col("doc")).isNotNull().alias("valid"))


def normalize_entities(spark, sf_dir):
    other = F.to_json(F.transform(given(), lambda e: F.struct((e["start"] * 10 - 6).alias("start_char"), (e["start"] * 9 + e["end"]).alias("end_char"), F.concat(F.lit(" "), e["label"]).alias("label"), e["text"].alias("text"), e["confidence"].alias("score"))))
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(given())).otherwise(other)
    items = F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>"), F.array().cast("array<variant>"))
    rows = documents(spark, sf_dir).select("doc_id", F.explode(en.normalised(items, F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.start", "e.end", "e.label", "e.text", "e.confidence")


def ents_polymorphic(spark, sf_dir):
    e = F.to_json(F.slice(given(), 1, 1_000_000))
    kind = F.col("doc_id") % 6
    choice = lambda a, b: F.concat(F.lit('{"chunk_0":['), a, F.lit(","), b, F.lit("]}"))
    none = F.lit("[]")
    ents = (
        F.when(kind == 0, F.concat(F.lit("[[0,"), e, F.lit("]]"))).when(kind == 1, F.concat(F.lit("["), e, F.lit("]"))).when(kind == 2, choice(e, none))
        .when(kind == 3, choice(none, e)).when(kind == 4, F.concat(F.lit('{"choice_2":['), e, F.lit('],"choice_10":[[]]}')))
    )
    rows = documents(spark, sf_dir).select("doc_id", ents.alias("ents"))
    at = lambda c: F.size(en.chunk_entities(F.col("ents"), F.lit(0), F.lit(c))).cast("long")
    return rows.select("doc_id", at(0).alias("first_choice"), at(1).alias("second_choice"))


REMAP = {"Person": "Person", "Organization": "Organization", "Event": "Event", "Place": "Location", "Time": "Creative Object"}


def label_remap_filter(spark, sf_dir):
    pairs = F.transform(given(), lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label")))
    short = F.filter(pairs, lambda e: F.length(e["text"]) > 12)
    rows = documents(spark, sf_dir).select("doc_id", en.remapped(short, REMAP, en.SCORED).alias("entities")).filter(F.size("entities") > 0)
    return rows.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.text", "e.label")


def canonical_labels(spark, sf_dir):
    spelled = F.element_at(F.array(*map(F.lit, ("publication_title", " Point_of Interest", "PUBLICATION", "Creative_Work"))), (F.col("n") % 4 + 1).cast("int"))
    return mentions(spark, sf_dir).select(spelled.alias("raw")).groupBy(en.canonical_label(F.col("raw")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def tagged_words(spark, sf_dir, numbers=False):
    """`doc_id, words, tags`: words with tags by position, as text or by number."""
    kinds = (1, 2, 0, 2, 5, 6, 0) if numbers else ("B-PER", "I-PER", "O", "I-PER", "B-LOC", "I-LOC", "O")
    known = F.array(*map(F.lit, kinds))
    words = F.regexp_extract_all("text", F.lit(r"\S+"), 0)
    tags = F.transform(words, lambda w, i: F.element_at(known, ((F.col("doc_id") + i) % 7 + 1).cast("int")))
    return documents(spark, sf_dir).select("doc_id", words.alias("words"), (en.numbered_tags(tags) if numbers else tags).alias("tags"))


def iob2_decode_string(spark, sf_dir):
    return en.iob2_rows(tagged_words(spark, sf_dir), ["doc_id"])


def iob2_decode_numeric(spark, sf_dir):
    return en.iob2_rows(tagged_words(spark, sf_dir, numbers=True), ["doc_id"], passing_over=True)


def link_rows(spark, sf_dir):
    """Entity links: `doc_id, entity_text, linked_entity, confidence, chunk_idx, ord`."""
    rows = mentions(spark, sf_dir)
    return rows.select(
        F.when(F.col("i") % 17 != 0, F.col("doc_id")).alias("doc_id"), F.col("txt").alias("entity_text"), F.when(F.col("n") % 5 == 0, "").otherwise(F.concat(F.lit("kb:"), "txt")).alias("linked_entity"),
        F.when(F.col("i") % 13 != 0, F.col("conf")).alias("confidence"), F.when(F.col("i") % 11 == 0, "x").otherwise((F.col("i") % 3 - F.when(F.col("i") % 19 == 0, 3).otherwise(0)).cast("string")).alias("chunk_idx"),
        F.col("i").alias("ord"),
    )


def link_confidence_filter(spark, sf_dir):
    return linking.confident_links(link_rows(spark, sf_dir))


def link_left_collect(spark, sf_dir):
    chunks = documents(spark, sf_dir).select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("chunk_idx"))
    out = linking.chunks_with_links(chunks, linking.confident_links(link_rows(spark, sf_dir)), ["ord"])
    return out.select("doc_id", "chunk_idx", F.array_join("linked", "|").alias("linked"))


def link_first_chunk(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("text"))
    links = mentions(spark, sf_dir).select("doc_id", F.lower("txt").alias("entity_text")).distinct()
    placed, lost = linking.with_first_chunk(docs, links)
    return placed.unionByName(lost).select("doc_id", "entity_text", "chunk_idx")


def linkability_inputs(spark, sf_dir):
    _, pred = annotated(spark, sf_dir)
    rows = pred.withColumn("chunk", F.col("ord") % 3)
    links = mentions(spark, sf_dir).filter("i % 2 = 0").select(F.col("doc_id").alias("rec"), (F.col("i") % 3).alias("chunk"), F.col("txt").alias("text"), F.col("conf").alias("confidence"))
    return rows, links


def linkability(spark, sf_dir):
    return linking.linkability(*linkability_inputs(spark, sf_dir), ["a", "b", "c"])


def linkability_by_label(spark, sf_dir):
    return linking.linkability(*linkability_inputs(spark, sf_dir), ["a", "b", "c"], ["label"])


def linkability_average(spark, sf_dir):
    """One row for model a and one for b and c together, as runs of one model."""
    return linking.mean_of_runs(linkability(spark, sf_dir), {"b": "b and c", "c": "b and c"})


def merge_outputs(spark, sf_dir):
    model = lambda n: F.when(F.col("doc_id") % 3 == 0, "m0").when(F.col("doc_id") % 3 == 1, "m1").otherwise("m2").alias("model")
    left = documents(spark, sf_dir).select("doc_id", model(3), "lang", F.lit("left").alias("origin"))
    right = table(spark, sf_dir, "labels").select("doc_id", F.lit("m9").alias("model"), F.lit("xx").alias("lang"), F.lit("right").alias("origin"))
    return linking.merged_outputs(left, right, ["m0", "m1"])


def positional_interleave(spark, sf_dir):
    left = table(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("origin"))
    right = documents(spark, sf_dir).filter("lang = 'fr'").select("doc_id", F.lit("fr").alias("origin"))
    return linking.interleaved(left, right, ["doc_id"])


def resume_anti_join(spark, sf_dir):
    return linking.unfinished(documents(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


def dedup_first(spark, sf_dir):
    return linking.first_by_key(mentions(spark, sf_dir), ["doc_id", "txt", "gold"], ["i"]).select("doc_id", "txt", "gold", "i")


def last_source_join(spark, sf_dir):
    sources = documents(spark, sf_dir).select(F.col("lang"), "doc_id", "source")
    predictions = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return linking.predictions_with_sources(predictions, sources, ["doc_id"], "lang")


CAPITALISED = re.compile(r"(?<![^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])[A-Z][a-z]{2,}[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*")
FULL = 1_000_000


def line_entities(line, text):
    """(start, end, surface) of a line's capitalised words; every fifth surface is misspelt, every seventh misplaced."""
    for m in CAPITALISED.finditer(text):
        odd, off = m.start() + line, 9 if (m.start() + line) % 7 == 0 else 0
        yield m.start() + off, m.end() + off, m.group()[1:101] + "e" if odd % 5 == 0 else m.group()


def lines_with_entities(spark, sf_dir):
    """Lines as chunks with one entity for each capitalised word, see `line_entities`; one scan of the text, in Arrow batches of bounded size."""
    entity = [pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("label", pa.string()), pa.field("text", pa.string()), pa.field("confidence", pa.float64())]

    def batch_of(rows):
        found = [list(line_entities(line, text)) for _, line, text in rows]
        start, end, surface = zip(*[e for f in found for e in f], strict=True) if any(found) else ((), (), ())
        columns = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(["Event"] * len(start), pa.string()), pa.array(surface, pa.string()), pa.array([0.9] * len(start), pa.float64())]
        entities = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), pa.StructArray.from_arrays(columns, fields=entity))
        ids, lines, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(texts, pa.string()), entities], names=["doc_id", "line", "text", "entities"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                text, doc_id = text.as_py(), doc_id.as_py()
                rows += [(doc_id, line, own) for line, own in enumerate(text.split("\n"))]
                size += len(text)
                if size > FULL:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    kinds = "doc_id long, line int, text string, entities array<struct<start:int,end:int,label:string,text:string,confidence:double>>"
    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(run, kinds)


def char_to_token_span(spark, sf_dir):
    return align.spans_on_tokens(lines_with_entities(spark, sf_dir), ["doc_id", "line"], spans_col="entities")


def fuzzy_align(spark, sf_dir):
    found = align.align_entities(lines_with_entities(spark, sf_dir), ["doc_id", "line"], with_tokens=False)
    return found.select("doc_id", "line", F.explode("entities").alias("e")).select("doc_id", "line", "e.*")


def alignment_stats(spark, sf_dir):
    rows = fuzzy_align(spark, sf_dir)
    return rows.groupBy("alignment_method").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bround(F.avg("alignment_score"), 4), F.lit(0.0)).alias("mean_score"))


NAMES = tuple(rel.RULES)


def relation_rows(spark, sf_dir):
    """Consecutive mentions as relations: token units are mention numbers, ends exclusive."""
    rows = mentions(spark, sf_dir)
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("i")
    nxt = rows.withColumn("tail", F.lead("txt").over(w)).filter("tail is not null")
    label = F.element_at(F.array(*[F.lit(n) for n in (*NAMES, "unruled")]), ((F.col("doc_id") + F.col("i")) % 7 + 1).cast("int"))
    shift = F.when(F.col("i") % 4 == 0, 1000000).otherwise(0)
    pair = lambda a, b: F.when(F.col("i") % 23 == 0, F.array(a)).otherwise(F.array(a, b))
    return nxt.select(
        "doc_id", "i", label.alias("label"), pair(F.col("i") + shift, F.col("i") + 1 + shift).alias("head_pos"), F.array(F.col("i") + 1, F.col("i") + 2).alias("tail_pos"), F.upper("txt").alias("head_text"), F.col("tail").alias("tail_text")
    )


def relation_entities(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", F.col("i").alias("start_token"), F.col("i").alias("end_token"), F.col("gold").alias("label"), F.col("txt").alias("text"), F.col("txt").alias("text_tokenized"))


def relation_constraints(spark, sf_dir):
    kept = rel.constrained(relation_rows(spark, sf_dir), relation_entities(spark, sf_dir), ["doc_id"])
    return kept.select("doc_id", "i", "label", F.array_join(F.array_sort("head_types"), "|").alias("head_types"), F.array_join(F.array_sort("tail_types"), "|").alias("tail_types"))


def relation_error_rate(spark, sf_dir):
    i, d = F.col("i"), F.col("doc_id")
    valid = F.when((d + i) % 17 == 0, F.lit(None)).when((d + i) % 29 == 0, 2).when((d + i) % 11 == 0, 0).otherwise((F.col("n") % 3 != 0).cast("int"))
    return ev.error_rate(mentions(spark, sf_dir).select(F.col("doc_id").alias("item"), valid.alias("valid")))


def prompt_filling(spark, sf_dir):
    filled = en.filled_prompt("Find {WHAT} in: {TEXT}", {"WHAT": F.col("lang"), "TEXT": F.replace("text", F.lit("{"), F.lit("("))})
    return documents(spark, sf_dir).select("doc_id", F.length(filled).alias("n"), F.md5(filled.cast("binary")).alias("digest"))


def entity_pair_parsing(spark, sf_dir):
    pairs = F.to_json(F.transform(given(), lambda e: F.array(e["text"], e["label"])))
    named = F.to_json(F.transform(given(), lambda e: F.struct(F.lit("").alias("text"), e["text"].alias("mention"), F.when(F.length(e["text"]) % 2 == 0, e["label"]).alias("label"))))
    raw = F.when(F.col("doc_id") % 2 == 0, pairs).otherwise(named)
    rows = documents(spark, sf_dir).select("doc_id", F.explode(ev.entity_pairs(raw)).alias("e"))
    return rows.groupBy("doc_id", "e.label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("e.text")).alias("n_chars"))


def gazetteer_annotate(spark, sf_dir):
    from corpusloom.operators.annotators import Gazetteer, annotate

    model = Gazetteer({"The": "Word", "the": "Word", "und": "Word", "que": "Word"})
    rows = annotate(documents(spark, sf_dir).select("doc_id", "text"), model)
    return rows.select("doc_id", F.size("entities").cast("long").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_llm_response, validate_entities, normalize_entities, ents_polymorphic, label_remap_filter, canonical_labels, iob2_decode_string, iob2_decode_numeric, link_confidence_filter,
        link_left_collect, link_first_chunk, linkability, linkability_by_label, linkability_average, merge_outputs, positional_interleave, resume_anti_join, dedup_first, last_source_join, char_to_token_span, fuzzy_align,
        alignment_stats, relation_constraints, relation_error_rate, prompt_filling, entity_pair_parsing, gazetteer_annotate,
    )
}

SQL_LINKS = SQL_MENTIONS + """,
lk AS (SELECT CASE WHEN i % 17 <> 0 THEN doc_id END AS doc_id, txt AS entity_text, CASE WHEN n % 5 = 0 THEN '' ELSE 'kb:' || txt END AS linked_entity, CASE WHEN i % 13 <> 0 THEN conf END AS confidence,
         CASE WHEN i % 11 = 0 THEN 'x' ELSE CAST(i % 3 - CASE WHEN i % 19 = 0 THEN 3 ELSE 0 END AS VARCHAR) END AS chunk_idx, i AS ord FROM fa),
ok AS (SELECT doc_id, entity_text, linked_entity, confidence, TRY_CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(ord AS INTEGER) AS ord FROM lk
       WHERE coalesce(confidence, 0) > 0.8::DOUBLE AND doc_id IS NOT NULL AND linked_entity <> '' AND TRY_CAST(chunk_idx AS INTEGER) >= 0)"""


def sql_linkability(dims: str) -> str:
    d = f", {dims}" if dims else ""
    aligned = "" if dims else "count(DISTINCT (rec, chunk)) AS aligned_chunks, "
    return f"""WITH {SQL_MENTIONS}, e AS (SELECT model, doc_id AS rec, i % 3 AS chunk, txt, label FROM pred),
l AS (SELECT doc_id AS rec, i % 3 AS chunk, txt, conf FROM fa WHERE i % 2 = 0),
cm AS (SELECT rec, chunk FROM e GROUP BY rec, chunk HAVING count(DISTINCT model) = 3 INTERSECT SELECT rec, chunk FROM l),
b AS (SELECT rec, chunk, txt, max(conf) AS c FROM l GROUP BY ALL),
t AS (SELECT e.*, b.c FROM e SEMI JOIN cm USING (rec, chunk) LEFT JOIN b USING (rec, chunk, txt)),
th AS (SELECT model, quantile_cont(c, 0.6) AS threshold FROM t GROUP BY model)
SELECT model{d}, {aligned}count(DISTINCT (rec, chunk)) AS chunks_with_entities, count(DISTINCT (rec, chunk)) FILTER (WHERE c IS NOT NULL) AS chunks_with_any_linked_entity,
  count(*) AS total_entities, count(c) AS linked_entities, count(*) FILTER (WHERE c >= threshold) AS linked_entities_top,
  max(threshold) AS threshold, CAST(count(c) AS DOUBLE) / count(*) AS linkability_rate, CAST(count(*) FILTER (WHERE c >= threshold) AS DOUBLE) / count(*) AS linkability_rate_top
FROM t JOIN th USING (model) GROUP BY model{d}"""


def sql_iob2(tags: str, where: str) -> str:
    return rf"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS l FROM documents),
u AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS word FROM a),
t AS (SELECT doc_id, pos, word, {tags}[(doc_id + pos) % 7 + 1] AS tag FROM u),
x AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS label FROM t),
y AS (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM x WHERE {where}),
z AS (SELECT *, sum(CASE WHEN label IS NOT NULL AND (tag LIKE 'B-%' OR prev IS DISTINCT FROM label) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM y)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start, string_agg(word, ' ' ORDER BY pos) AS text, min(label) AS label FROM z WHERE label IS NOT NULL GROUP BY doc_id, e"""


SQL_LINES = r"""
ln AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
li AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS text FROM ln),
wp AS (SELECT doc_id, line, regexp_extract_all(text, '\s+|\S+') AS l, regexp_extract_all(text, '\s+|[\p{L}\p{M}\p{Nd}_]+(?:[-_][\p{L}\p{M}\p{Nd}_]+)*|\S') AS tl FROM li),
wu AS (SELECT doc_id, line, generate_subscripts(l, 1) AS k, unnest(l) AS w FROM wp),
tu AS (SELECT doc_id, line, generate_subscripts(tl, 1) AS k, unnest(tl) AS w FROM wp),
wo AS (SELECT *, CAST(coalesce(sum(length(w)) OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM wu),
tq AS (SELECT *, CAST(coalesce(sum(length(w)) OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM tu),
tk AS (SELECT doc_id, line, s, s + length(w) AS e, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) - 1 AS idx FROM tq WHERE NOT regexp_matches(w, '^\s')),
en AS (SELECT doc_id, line, s + CASE WHEN (s + line) % 7 = 0 THEN 9 ELSE 0 END AS start, s + length(w) + CASE WHEN (s + line) % 7 = 0 THEN 9 ELSE 0 END AS "end" FROM wo WHERE regexp_matches(w, '^[A-Z][a-z]{2,}'))"""

RULE_ROWS = ", ".join(f"('{name}', {rule['allowed_head']}, {rule['allowed_tail']})" for name, rule in rel.RULES.items())

ORACLE_SQL = {
    "parse_llm_response": f"""WITH {SQL_MENTIONS} SELECT d.doc_id, count(fa.i) FILTER (WHERE d.doc_id % 7 <> 6) AS n_entities, coalesce(CAST(sum(fa.i * 3 + fa.n) FILTER (WHERE d.doc_id % 7 <> 6) AS BIGINT), 0) AS sum_end
FROM documents d LEFT JOIN fa USING (doc_id) GROUP BY d.doc_id""",
    "validate_entities": f"""WITH {SQL_MENTIONS} SELECT d.doc_id, coalesce(max(fa.conf), 0) + CASE WHEN d.doc_id % 2 = 0 THEN 0.0::DOUBLE ELSE 0.02::DOUBLE END <= 1 AS valid
FROM documents d LEFT JOIN fa USING (doc_id) GROUP BY d.doc_id""",
    "normalize_entities": f"""WITH {SQL_MENTIONS}, o AS (SELECT fa.doc_id, CASE WHEN fa.doc_id % 2 = 0 THEN i * 3 ELSE i * 30 - 6 END AS s, CASE WHEN fa.doc_id % 2 = 0 THEN i * 3 ELSE i * 30 END + n AS e, length(d.text) AS len, gold, txt, conf FROM fa JOIN documents d USING (doc_id))
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(least(e, len) AS INTEGER) AS "end", gold AS label, txt AS text, conf AS confidence FROM o WHERE s >= 0 AND s < e AND s < len""",
    "ents_polymorphic": f"""WITH {SQL_MENTIONS}, c AS (SELECT d.doc_id, count(fa.i) AS n FROM documents d LEFT JOIN fa USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 2, 4) THEN n ELSE 0 END AS first_choice, CASE WHEN doc_id % 6 IN (0, 1, 3, 4) THEN n ELSE 0 END AS second_choice FROM c""",
    "label_remap_filter": f"""WITH {SQL_MENTIONS} SELECT doc_id, txt AS text, CASE gold WHEN 'Place' THEN 'Location' ELSE gold END AS label FROM fa WHERE n > 12""",
    "canonical_labels": f"""WITH {SQL_MENTIONS} SELECT CASE n % 4 WHEN 1 THEN 'Point of Interest' WHEN 3 THEN 'Creative Work' ELSE 'Publication' END AS label, count(*) AS n FROM fa GROUP BY 1""",
    "iob2_decode_string": sql_iob2("['B-PER', 'I-PER', 'O', 'I-PER', 'B-LOC', 'I-LOC', 'O']", "TRUE"),
    "iob2_decode_numeric": sql_iob2("['B-PER', 'I-PER', 'O', 'I-PER', 'B-LOC', 'I-LOC', 'O']", "label IS NOT NULL"),
    "link_confidence_filter": f"WITH {SQL_LINKS} SELECT * FROM ok",
    "link_left_collect": f"""WITH {SQL_LINKS}, g AS (SELECT doc_id, chunk_idx, string_agg(linked_entity, '|' ORDER BY ord) AS linked FROM ok GROUP BY ALL)
SELECT d.doc_id, CAST(c.k AS INTEGER) AS chunk_idx, coalesce(linked, '') AS linked FROM documents d CROSS JOIN range(0, 4) c(k) LEFT JOIN g ON g.doc_id = d.doc_id AND g.chunk_idx = c.k""",
    "link_first_chunk": f"""WITH {SQL_MENTIONS}, q AS (SELECT DISTINCT doc_id, lower(txt) AS entity_text FROM fa), s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT q.doc_id, entity_text, CAST(nullif(list_position(list_transform(l, lambda c: contains(c, entity_text)), TRUE), 0) - 1 AS INTEGER) AS chunk_idx FROM q JOIN s USING (doc_id)""",
    "linkability": sql_linkability(""),
    "linkability_by_label": sql_linkability("label"),
    "linkability_average": f"""SELECT CASE WHEN model = 'a' THEN 'a' ELSE 'b and c' END AS model, avg(COLUMNS(* EXCLUDE model)) FROM ({sql_linkability("")}) GROUP BY 1""",
    "merge_outputs": """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 3 < 2 THEN 'm9' ELSE 'm' || (d.doc_id % 3) END AS model,
CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 3 < 2 THEN 'xx' ELSE d.lang END AS lang, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 3 < 2 THEN 'right' ELSE 'left' END AS origin
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "positional_interleave": """WITH a AS (SELECT doc_id, 'labels' AS origin, row_number() OVER (ORDER BY doc_id) - 1 AS idx, 0 AS side FROM labels),
b AS (SELECT doc_id, 'fr' AS origin, row_number() OVER (ORDER BY doc_id) - 1 AS idx, 1 AS side FROM documents WHERE lang = 'fr'),
n AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n)
SELECT doc_id, origin, CAST(idx AS INTEGER) AS idx, side FROM (SELECT * FROM a UNION ALL SELECT * FROM b), n WHERE idx < n""",
    "resume_anti_join": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "dedup_first": f"WITH {SQL_MENTIONS} SELECT doc_id, txt, gold, CAST(min(i) AS INTEGER) AS i FROM fa GROUP BY ALL",
    "last_source_join": "SELECT lang, count(*) AS n, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY lang",
    "char_to_token_span": f"""WITH {SQL_LINES} SELECT en.doc_id, CAST(en.line AS INTEGER) AS line, CAST(en.start AS INTEGER) AS start, CAST(en."end" AS INTEGER) AS "end", CAST(min(tk.idx) AS INTEGER) AS first, CAST(max(tk.idx) AS INTEGER) AS last
FROM en LEFT JOIN tk ON tk.doc_id = en.doc_id AND tk.line = en.line AND tk.e > en.start AND tk.s < en."end" GROUP BY en.doc_id, en.line, en.start, en."end\"""",
    "relation_constraints": f"""WITH {SQL_MENTIONS}, n AS (SELECT *, lead(txt) OVER (PARTITION BY doc_id ORDER BY i) AS tail FROM fa),
names AS (SELECT {list(NAMES)} || ['unruled'] AS l),
r AS (SELECT doc_id, i, l[(doc_id + i) % 7 + 1] AS label, txt, tail, gold FROM n, names WHERE tail IS NOT NULL AND i % 23 <> 0),
bt AS (SELECT doc_id, lower(txt) AS t, list_sort(list(DISTINCT gold)) AS ls FROM fa GROUP BY ALL),
h AS (SELECT r.*, CASE WHEN r.i % 4 = 0 THEN bt.ls ELSE [r.gold] END AS ht, [f2.gold] AS tt FROM r LEFT JOIN bt ON bt.doc_id = r.doc_id AND bt.t = lower(r.txt) JOIN fa f2 ON f2.doc_id = r.doc_id AND f2.i = r.i + 1),
ru AS (SELECT * FROM (VALUES {RULE_ROWS}) v(name, ah, atl))
SELECT doc_id, CAST(i AS INTEGER) AS i, label, array_to_string(ht, '|') AS head_types, array_to_string(tt, '|') AS tail_types FROM h LEFT JOIN ru ON ru.name = h.label
WHERE ru.name IS NULL OR (list_has_any(ah, ht) AND list_has_any(atl, tt))""",
    "relation_error_rate": f"""WITH {SQL_MENTIONS}, v AS (SELECT doc_id, CASE WHEN (doc_id + i) % 17 = 0 THEN NULL WHEN (doc_id + i) % 29 = 0 THEN 2 WHEN (doc_id + i) % 11 = 0 THEN 0 WHEN n % 3 <> 0 THEN 1 ELSE 0 END AS valid FROM fa)
SELECT count(DISTINCT doc_id) AS items_with_relations, count(*) AS relations, count(*) FILTER (WHERE valid = 1) AS valid_relations, count(*) FILTER (WHERE valid = 0) AS invalid_relations,
  count(*) FILTER (WHERE valid IS NULL) AS missing_flags, count(*) FILTER (WHERE valid = 2) AS non_binary_flags, CAST(count(*) FILTER (WHERE valid = 0) AS DOUBLE) / count(*) FILTER (WHERE valid IN (0, 1)) AS error_rate FROM v""",
    "prompt_filling": "SELECT doc_id, CAST(length('Find ' || lang || ' in: ' || replace(text, '{', '(')) AS INTEGER) AS n, md5('Find ' || lang || ' in: ' || replace(text, '{', '(')) AS digest FROM documents",
    "entity_pair_parsing": f"""WITH {SQL_MENTIONS} SELECT doc_id, gold AS label, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_chars FROM fa WHERE doc_id % 2 = 0 OR n % 2 = 0 GROUP BY ALL""",
    "gazetteer_annotate": r"SELECT doc_id, len(regexp_extract_all(' ' || regexp_replace(text, '([^\p{L}\p{M}\p{N}_])', ' \1 ', 'g') || ' ', ' (?:The|the|und|que) ')) AS n FROM documents",
}
