"""Table and column types; sources are read with these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def parse(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


ENTITY_DDL = "struct<start:int, end:int, label:string, text:string, confidence:double>"
TEXT_DDL = "struct<text:string, lang:string>"
RELATION_DDL = f"struct<head:{ENTITY_DDL}, tail:{ENTITY_DDL}, type:string>"
TRIPLE_DDL = f"struct<subject:{ENTITY_DDL}, predicate:{RELATION_DDL}, object:{ENTITY_DDL}>"

#: Source documents as harvested: one record per document, fields as lists.
DUMP = f"id string, url array<string>, in_language array<string>, abstract array<{TEXT_DDL}>, headline array<{TEXT_DDL}>"
#: Search-engine statistics: languages and, inside, disciplines.
STATS = "buckets array<struct<key:string, doc_count:bigint, by_discipline:struct<buckets:array<struct<key:string, doc_count:bigint>>>>>"
#: Documents with page texts or chunks.
DOCUMENTS = "id string, url string, in_language string, abstract_text string, headline_text string, text array<string>"
#: Chunks with entities, relations or triples: the one that `annotation_t` names is not null.
ANNOTATED_CHUNKS = f"doc_id string, chunk_idx int, span string, annotation_t string, ents array<{ENTITY_DDL}>, rels array<{RELATION_DDL}>, triples array<{TRIPLE_DDL}>"
#: Predictions; `ents` comes in eight encodings and is kept as text until normalised.
PREDICTIONS = "doc_id string, model string, lang string, ents string"
LINKS = "doc_id string, entity_text string, linked_entity string, confidence double, chunk_idx int"
SILVER = f"doc_id string, chunk_idx int, lang string, annotator_model string, judge_model string, annotator_ents array<{ENTITY_DDL}>, judged_ents array<{ENTITY_DDL}>"
IOB2_NAMED = "tokens array<string>, ner_tags array<string>"
IOB2_NUMBERED = "tokens array<string>, ner_tags array<bigint>"
BENCHMARK = "text string, entities array<array<string>>"

#: Models return relations in token units; ends are exclusive.
PREDICTED_RELATION_DDL = (
    "struct<head_pos:array<int>, tail_pos:array<int>, head_text:string, tail_text:string, label:string, score:double>"
)
