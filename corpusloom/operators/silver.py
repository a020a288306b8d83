"""The silver standard: chunks annotated by one model, then judged by another that sees the annotations and the linked entities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.entities import ENTITIES, judge_payload
from corpusloom.operators.annotators import Annotator
from corpusloom.operators.linking import chunks_with_links, confident_links


def flat_chunks(docs: DataFrame, id_col: str = "id", lang_col: str = "in_language", text_col: str = "text") -> DataFrame:
    """Documents -> `doc_id, chunk_idx, lang, text`, one row for each chunk; a plain text is one chunk."""
    text = F.col(text_col) if docs.schema[text_col].dataType.typeName() == "array" else F.array(text_col)
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(lang_col).alias("lang"), F.posexplode(text).alias("chunk_idx", "text"))


def annotated_by(chunks: DataFrame, model: Annotator, text_col: str, column: str, batch: int) -> DataFrame:
    """`chunks` with a model's entities; each batch must come back whole."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                found = model.annotate(part[text_col].tolist())
                if len(found) != len(part):
                    raise ValueError(f"the model gave {len(found)} results for {len(part)} chunks")
                yield part.assign(**{column: found})

    return chunks.mapInPandas(run, f"{kinds}, {column} {ENTITIES}")


def silver_standard(
    docs: DataFrame, links: DataFrame, annotator: Annotator, judge: Annotator, annotator_name: str, judge_name: str, link_order: list[str], batch: int = 500
) -> DataFrame:
    """`doc_id, chunk_idx, lang, annotator_model, judge_model, annotator_ents, judged_ents` for each chunk of `docs`.

    The judge's input is the chunk, the annotator's entities and the entities linked in the
    chunk with confidence above 0.8, in `link_order`.  Documents without chunks give no rows.
    """
    chunks = annotated_by(flat_chunks(docs), annotator, "text", "annotator_ents", batch)
    sure = confident_links(links).withColumn("doc_id", F.col("doc_id").cast("string"))
    shown = chunks_with_links(chunks, sure, link_order)
    shown = shown.withColumn("payload", judge_payload(F.col("text"), F.col("annotator_ents"), F.col("linked"))).drop("text", "linked")
    judged = annotated_by(shown, judge, "payload", "judged_ents", batch)
    return judged.select("doc_id", "chunk_idx", "lang", F.lit(annotator_name).alias("annotator_model"), F.lit(judge_name).alias("judge_model"), "annotator_ents", "judged_ents")
