"""Queries on documents, pages and conversations: counts, samples, cleaning, quality, chunks, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import chunking, text as tx
from corpusloom.operators import quality, sampling
from corpusloom.plans.adapters import table
from corpusloom.streaming.incremental import after_suffix, windowed_counts

REDIRECTS = {"spam-farm.example.org": "archive.example.org"}


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def lang_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("doc_id").alias("n")).orderBy("n", "lang")


def lang_source_ratios(spark, sf_dir):
    counts = docs(spark, sf_dir).groupBy("lang", F.col("source").alias("discipline")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.ratios(counts)


def sample_allocation(spark, sf_dir):
    return sampling.allocation(lang_source_ratios(spark, sf_dir), 500).select("lang", "discipline", "lang_sample", "sample")


def sample_balanced(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    return sampling.balanced_sample(rows, "lang", ["de", "en", "es", "fr"], 120, "doc_id")


def take_until_target(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    return sampling.take_until(rows, F.col("n_chars") > 1000, [F.col("doc_id")], 50)


def turns_as_records(spark, sf_dir):
    """Conversations as harvested records: languages, abstracts and headlines as lists."""
    turns = table(spark, sf_dir, "conversations")
    lang = F.when(F.col("turn") % 2 == 0, "en").otherwise("fr")
    by = turns.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.struct("text", lang.alias("lang")).alias("t")))).alias("a"))
    texts = F.transform("a", lambda x: x["t"])
    return by.select(
        "id",
        F.when(F.col("id") % 3 == 0, F.array(F.lit("fr"), F.lit("en"))).when(F.col("id") % 3 == 1, F.array(F.lit("fr"))).otherwise(F.array(F.lit("de"))).alias("in_language"),
        texts.alias("abstract"),
        F.when(F.col("id") % 5 == 0, F.slice(texts, 1, 0)).otherwise(F.slice(texts, 1, 1)).alias("headline"),
    )


def nonempty_single_lang_filter(spark, sf_dir):
    return quality.single_language(turns_as_records(spark, sf_dir)).select("id", F.get("in_language", F.lit(0)).alias("in_language"), F.size("abstract").cast("long").alias("n_abstracts"))


def language_matched_pick(spark, sf_dir):
    kept = quality.single_language(turns_as_records(spark, sf_dir))
    lang = F.get("in_language", F.lit(0))
    return kept.select("id", quality.language_matched(F.col("abstract"), lang).alias("abstract_text"), quality.language_matched(F.col("headline"), lang).alias("headline_text"))


def language_filter(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.col("lang") == "fr").select("doc_id", "source", "n_chars")


def doc_quality_metrics(spark, sf_dir):
    measured = quality.with_quality(docs(spark, sf_dir).select("doc_id", "text"))
    return measured.drop("text")


def doc_quality_filter(spark, sf_dir):
    return quality.with_quality(docs(spark, sf_dir).select("doc_id", "text")).filter("is_good").select("doc_id")


def gibberish_lines(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "line"))
    return rows.filter(tx.is_gibberish(tx.strip(F.col("line"))))


def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.clean_page(F.col("text")).alias("cleaned"))


def hyphenated(text):
    """Line ends after long words made into broken words, so that there is something to mend."""
    return F.regexp_replace(text, r"(\p{L}{6})(\p{L}{3})", "$1-\n$2")


def fix_hyphenation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.fix_hyphenation(hyphenated(F.col("text"))).alias("fixed"))


def collapse_whitespace(spark, sf_dir):
    spaced = F.replace(F.replace("text", F.lit(". "), F.lit(".  \t \n\n")), F.lit(" of "), F.lit("   of  "))
    return docs(spark, sf_dir).select("doc_id", tx.collapse_whitespace(spaced).alias("collapsed"))


def pages_of_lines(spark, sf_dir, size=5):
    """Documents with `pages`: their lines in groups of five."""
    parts = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / size).cast("int")), lambda i: F.array_join(F.slice("_l", i * size + 1, F.lit(size)), "\n"))
    return docs(spark, sf_dir).filter("text is not null").select("doc_id", parts.alias("_l")).withColumn("pages", pages).drop("_l")


def remove_headers_footers(spark, sf_dir):
    cleaned = quality.without_headers_footers(pages_of_lines(spark, sf_dir))
    return cleaned.select("doc_id", F.size("pages").cast("long").alias("n_pages"), F.array_join("pages", "\f").alias("cleaned"))


def min_pages_filter(spark, sf_dir):
    return pages_of_lines(spark, sf_dir).filter(quality.long_enough(F.col("pages"))).select("doc_id", F.size("pages").cast("long").alias("n_pages"))


def url_domain_normalize(spark, sf_dir):
    moved = tx.redirect_domain(F.col("url"), REDIRECTS)
    return table(spark, sf_dir, "pages").select("page_id", moved.alias("url"), tx.url_domain(moved).alias("domain"))


def domain_failures(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 20).alias("domain"), "event_type")
    out = sampling.circuit_breaker(events, "domain", F.col("event_type") == "error", ["ts", "event_id"])
    return out.select("event_id", "domain", F.col("fails_before").cast("long").alias("fails_before"), "skipped")


def binary_sniff(spark, sf_dir):
    content = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-1.7\n"), "html")).otherwise(F.col("html")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", quality.is_pdf(content).alias("is_pdf"))


def chunk_documents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.chunks(F.col("text"))).alias("chunk_idx", "chunk"))


def chunk_overlap(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.with_overlap(chunking.chunks(F.col("text")))).alias("chunk_idx", "chunk"))


def token_statistics(pattern):
    def query(spark, sf_dir):
        rows = tx.token_rows(docs(spark, sf_dir), ["doc_id"], "text", pattern)
        return rows.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n_tokens"), F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end"), F.sum(F.col("idx") * F.length("token")).alias("weighted")
        )

    return query


def resume_suffix_filter(spark, sf_dir):
    keyed = docs(spark, sf_dir).select("doc_id", F.concat_ws("_", "source", "doc_id").alias("id"))
    return keyed.filter(after_suffix(F.col("id"), 16))


def row_index_ids(spark, sf_dir):
    """Ids made of a prefix and the position inside the record."""
    rows = docs(spark, sf_dir).select("doc_id", "source", F.posexplode(tx.lines(F.col("text"))).alias("i", "line"))
    return rows.select(F.concat_ws("_", "source", "doc_id", "i").alias("id"), F.length("line").cast("long").alias("n_chars"))


def events_windowed(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


QUERIES = {
    f.__name__: f
    for f in (
        lang_counts, lang_source_ratios, sample_allocation, sample_balanced, take_until_target, nonempty_single_lang_filter, language_matched_pick, language_filter,
        doc_quality_metrics, doc_quality_filter, gibberish_lines, clean_text, fix_hyphenation, collapse_whitespace, remove_headers_footers, min_pages_filter,
        url_domain_normalize, domain_failures, binary_sniff, chunk_documents, chunk_overlap, resume_suffix_filter, row_index_ids, events_windowed,
    )
} | {"tokenize_regex": token_statistics(tx.REGEX_TOKEN), "tokenize_whitespace": token_statistics(tx.WHITESPACE_TOKEN)}

SQL_RATIOS = """
c AS (SELECT lang, source AS discipline, count(*) AS n FROM documents GROUP BY ALL),
l AS (SELECT lang, CAST(sum(n) AS BIGINT) AS lang_n FROM c GROUP BY lang),
ra AS (SELECT c.lang, c.discipline, c.n, round_even(CAST(c.n AS DOUBLE) / sum(c.n) OVER (PARTITION BY c.lang), 4) AS discipline_ratio, l.lang_n,
         round_even(CAST(l.lang_n AS DOUBLE) / (SELECT sum(lang_n) FROM l), 4) AS lang_ratio
       FROM c JOIN l USING (lang))"""

SQL_TURNS = """
t AS (SELECT conv_id AS id, list({'text': text, 'lang': CASE WHEN turn % 2 = 0 THEN 'en' ELSE 'fr' END} ORDER BY turn, text) AS abstract FROM conversations GROUP BY conv_id),
k AS (SELECT id, CASE id % 3 WHEN 1 THEN 'fr' ELSE 'de' END AS in_language, abstract, abstract[:1] AS headline FROM t WHERE id % 3 <> 0 AND id % 5 <> 0 AND len(abstract) > 0)"""

GIBBERISH = r"""(length({x}) < 3 OR length(regexp_replace({x}, '[\p{{L}}\p{{N}}\s]', '', 'g')) > 0.4::DOUBLE * length({x})
  OR regexp_matches({x}, '\p{{So}}') OR regexp_matches(lower({x}), '[bcdfghjklmnpqrstvwxyz]{{6,}}'))"""


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_count(pattern: str, x: str = "t") -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS INTEGER)"


SCRIPT_COUNTS = [sql_count(rf"\p{{{s}}}") for s in tx.SCRIPTS]
LATIN_LETTERS = " + ".join(SCRIPT_COUNTS)

SQL_QUALITY = rf"""
st AS (SELECT doc_id, {sql_strip("text")} AS t FROM documents),
q AS (SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, {sql_count(chr(92) + "p{L}")} AS letters, {sql_count(chr(92) + "p{L}")} - ({LATIN_LETTERS}) AS other_letters,
        {" + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END" for c in SCRIPT_COUNTS)} AS scripts, {sql_count(chr(92) + "p{S}")} AS symbols, {sql_count(chr(92) + "p{L}+")} AS words
      FROM st),
qq AS (SELECT *, letters >= 30 AND letters >= 0.05::DOUBLE * n_chars AND other_letters <= 0.85::DOUBLE * letters AND scripts <= 4 AND symbols <= 0.25::DOUBLE * n_chars AND words >= 10 AS is_good FROM q)"""

SQL_CHUNKS = r"""
g AS (SELECT doc_id, 0 AS k, '' AS piece, regexp_replace(text, '^\s+', '') AS rest FROM documents
      UNION ALL
      SELECT doc_id, k + 1, substr(rest, 1, n), regexp_replace(substr(rest, n + 1), '^\s+', '')
      FROM (SELECT doc_id, k, rest, CASE WHEN length(rest) <= 512 THEN length(rest)
                 WHEN regexp_matches(substr(rest, 1, 513), '\s') THEN length(regexp_extract(substr(rest, 1, 513), '(?s)^(.*)\s', 1)) ELSE 512 END AS n
            FROM g WHERE rest <> '')),
c0 AS (SELECT doc_id, list(piece ORDER BY k) AS l FROM (SELECT doc_id, k, regexp_replace(piece, '\s+$', '') AS piece FROM g WHERE k > 0) WHERE length(piece) >= 20 GROUP BY doc_id)"""

WORD_CLASS = r"[\p{L}\p{M}\p{Nd}_]"


def sql_tokens(pattern: str) -> str:
    return rf"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '\s+|{pattern}') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM p),
w AS (SELECT doc_id, token, coalesce(sum(length(token)) OVER b, 0) AS start, coalesce(sum(CASE WHEN regexp_matches(token, '^\s') THEN 0 ELSE 1 END) OVER b, 0) AS idx
      FROM u WINDOW b AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, count(*) AS n_tokens, CAST(sum(start) AS BIGINT) AS sum_start, CAST(sum(start + length(token)) AS BIGINT) AS sum_end, CAST(sum(idx * length(token)) AS BIGINT) AS weighted
FROM w WHERE NOT regexp_matches(token, '^\s') GROUP BY doc_id"""


ORACLE_SQL = {
    "lang_counts": "SELECT lang, count(doc_id) AS n FROM documents GROUP BY lang",
    "lang_source_ratios": f"WITH {SQL_RATIOS} SELECT * FROM ra",
    "sample_allocation": f"""WITH {SQL_RATIOS}, a AS (SELECT lang, discipline, discipline_ratio, CAST(round_even(500 * lang_ratio, 0) AS BIGINT) AS lang_sample FROM ra)
SELECT lang, discipline, lang_sample, greatest(CAST(round_even(lang_sample * discipline_ratio, 0) AS BIGINT), 1) AS sample FROM a""",
    "sample_balanced": """WITH RECURSIVE c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY lang),
lv AS (SELECT max(k) AS k FROM range(0, 121) r(k) WHERE (SELECT sum(least(n, k)) FROM c) <= 120),
b AS (SELECT lang, n, least(n, (SELECT k FROM lv)) AS q FROM c),
f AS (SELECT lang, q + CASE WHEN row_number() OVER (ORDER BY (n > q) DESC, n - q DESC, lang) <= 120 - (SELECT sum(q) FROM b) AND n > q THEN 1 ELSE 0 END AS quota FROM b),
o AS (SELECT doc_id, d.lang, quota, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42|' || doc_id), doc_id) AS rk FROM documents d JOIN f USING (lang))
SELECT doc_id, lang, CAST(quota AS INTEGER) AS quota FROM o WHERE rk <= quota""",
    "take_until_target": "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000 ORDER BY doc_id LIMIT 50",
    "nonempty_single_lang_filter": f"WITH {SQL_TURNS} SELECT id, in_language, len(abstract) AS n_abstracts FROM k",
    "language_matched_pick": f"""WITH {SQL_TURNS} SELECT id, list_filter(abstract, lambda x: x.lang = in_language)[1].text AS abstract_text,
list_filter(headline, lambda x: x.lang = in_language)[1].text AS headline_text FROM k""",
    "language_filter": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr'",
    "doc_quality_metrics": f"WITH {SQL_QUALITY} SELECT * FROM qq",
    "doc_quality_filter": f"WITH {SQL_QUALITY} SELECT doc_id FROM qq WHERE is_good",
    "gibberish_lines": rf"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM s),
u AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM e)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM u WHERE {GIBBERISH.format(x=sql_strip("line"))}""",
    "clean_text": rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0e-\x1b\x7f]', '', 'g'),
    '({WORD_CLASS}+)-\n({WORD_CLASS}+)', '\1\2', 'g'), '[ \t]{{2,}}', ' ', 'g'), '\s+\n', chr(10), 'g'), chr(10)) AS l FROM documents)
SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda x: NOT {GIBBERISH.format(x=sql_strip("x"))} AND length({sql_strip("x")}) > 5), chr(10)), '') AS cleaned FROM s""",
    "fix_hyphenation": rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '(\p{{L}}{{6}})(\p{{L}}{{3}})', '\1-' || chr(10) || '\2', 'g'), '({WORD_CLASS}+)-\n({WORD_CLASS}+)', '\1\2', 'g') AS fixed FROM documents""",
    "collapse_whitespace": r"""SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, '. ', '.  ' || chr(9) || ' ' || chr(10) || chr(10)), ' of ', '   of  '), '[ \t]{2,}', ' ', 'g'), '\s+\n', chr(10), 'g') AS collapsed FROM documents""",
    "remove_headers_footers": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(range(0, 1 + (len(l) - 1) // 5)) AS page, l FROM s),
g0 AS (SELECT doc_id, page, l[page * 5 + 1 : page * 5 + 5] AS pl FROM p),
g AS (SELECT doc_id, page, CASE WHEN pl[len(pl)] = '' THEN pl[:len(pl) - 1] ELSE pl END AS pl FROM g0),
n AS (SELECT doc_id, count(*) AS n_pages, greatest(2, CAST(floor(count(*) * 0.3::DOUBLE) AS BIGINT)) AS lim FROM g GROUP BY doc_id),
c AS (SELECT doc_id, unnest([pl[1], pl[len(pl)]]) AS line FROM g WHERE len(pl) > 0),
h AS (SELECT doc_id, line FROM c JOIN n USING (doc_id) GROUP BY doc_id, line, lim HAVING count(*) >= lim),
hl AS (SELECT doc_id, list(line) AS hf FROM h GROUP BY doc_id),
k AS (SELECT g.doc_id, page, coalesce(array_to_string(list_filter(pl, lambda x: hf IS NULL OR NOT list_contains(hf, x)), chr(10)), '') AS t FROM g LEFT JOIN hl USING (doc_id))
SELECT doc_id, n_pages, string_agg(t, chr(12) ORDER BY page) AS cleaned FROM k JOIN n USING (doc_id) GROUP BY doc_id, n_pages""",
    "min_pages_filter": "SELECT doc_id, 1 + (len(string_split(text, chr(10))) - 1) // 5 AS n_pages FROM documents WHERE 1 + (len(string_split(text, chr(10))) - 1) // 5 > 5",
    "url_domain_normalize": """WITH u AS (SELECT page_id, CASE WHEN split_part(url, '/', 3) = 'spam-farm.example.org' THEN replace(url, '//spam-farm.example.org', '//archive.example.org') ELSE url END AS url FROM pages)
SELECT page_id, url, split_part(url, '/', 3) AS domain FROM u""",
    "domain_failures": """WITH RECURSIVE a AS (SELECT event_id, user_id % 20 AS domain, CASE WHEN event_type = 'error' THEN 1 ELSE -1 END AS d,
    row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT event_id, domain, d, rn, CAST(0 AS BIGINT) AS fails_before FROM a WHERE rn = 1
      UNION ALL SELECT a.event_id, a.domain, a.d, a.rn, CASE WHEN f.fails_before >= 3 THEN f.fails_before ELSE f.fails_before + f.d END FROM f JOIN a ON a.domain = f.domain AND a.rn = f.rn + 1)
SELECT event_id, domain, fails_before, fails_before >= 3 AS skipped FROM f""",
    "binary_sniff": "SELECT page_id, contains(substr(CASE WHEN page_id % 3 = 0 THEN '%PDF-1.7' || chr(10) || html ELSE html END, 1, 1024), '%PDF-') AS is_pdf FROM pages",
    "chunk_documents": f"WITH RECURSIVE {SQL_CHUNKS} SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk_idx, unnest(l) AS chunk FROM c0",
    "chunk_overlap": f"""WITH RECURSIVE {SQL_CHUNKS}, u AS (SELECT doc_id, generate_subscripts(l, 1) AS k, l FROM c0)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_idx, CASE WHEN k = 1 THEN l[1] ELSE right(l[k - 1], 50) || l[k] END AS chunk FROM u""",
    "resume_suffix_filter": "SELECT doc_id, source || '_' || doc_id AS id FROM documents WHERE doc_id >= 16",
    "row_index_ids": """WITH s AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, source, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM s),
u AS (SELECT doc_id, source, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM e) SELECT concat_ws('_', source, doc_id, i) AS id, length(line) AS n_chars FROM u""",
    "events_windowed": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "tokenize_regex": sql_tokens(rf"{WORD_CLASS}+(?:[-_]{WORD_CLASS}+)*|\S"),
    "tokenize_whitespace": sql_tokens(r"\S+"),
}
