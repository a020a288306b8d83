"""Annotators behind one interface: batches of texts in, entities or relations out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from corpusloom.functions import entities as en
from corpusloom.functions.entities import ENTITIES
from corpusloom.schemas import PREDICTED_RELATION_DDL


class Annotator(Protocol):
    """Entities of each text: dicts with start, end (characters, end exclusive), label, text, confidence."""

    def annotate(self, texts: list[str]) -> list[list[dict]]: ...


class RelationModel(Protocol):
    """Relations of each chunk from its tokens and entities; positions in tokens, ends exclusive."""

    def predict(self, tokens: list[list[str]], entities: list[list[dict]]) -> list[list[dict]]: ...


_known: dict[str, Callable[..., Annotator]] = {}


def register(name: str, factory: Callable[..., Annotator]) -> None:
    _known[name] = factory


def annotator(name: str, **options) -> Annotator:
    """The annotator registered under a name; a language model needs a prompt."""
    if name not in _known:
        raise ValueError(f"no annotator {name!r}; known are {sorted(_known)}")
    if name == "llm" and not options.get("prompt"):
        raise ValueError("a language model needs a prompt")
    return _known[name](**options)


class Gazetteer:
    """Finds given surfaces as whole words; longest first, no overlaps."""

    def __init__(self, surfaces: dict[str, str], confidence: float = 1.0):
        import re

        self.labels = surfaces
        self.confidence = confidence
        self.pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(s) for s in sorted(surfaces, key=len, reverse=True)) + r")(?!\w)") if surfaces else None

    def annotate(self, texts: list[str]) -> list[list[dict]]:
        found = []
        for text in texts:
            matches = self.pattern.finditer(text or "") if self.pattern else ()
            found.append([{"start": m.start(), "end": m.end(), "label": self.labels[m.group()], "text": m.group(), "confidence": self.confidence} for m in matches])
        return found


class LanguageModel:
    """Any model that answers prompts with JSON: `ask(prompts)` gives an answer, or a list of `choices` answers, for each.

    Up to `attempts` rounds: after the first, only texts whose answer failed are asked again.
    An answer of several choices counts only if all of them are sound; a text whose rounds
    all fail has no entities in any choice.
    """

    def __init__(self, prompt: str, ask: Callable[[list[str]], list], attempts: int = 3, choices: int = 1):
        self.prompt, self.ask, self.attempts, self.choices = prompt, ask, attempts, choices

    def annotate_choices(self, texts: list[str]) -> list[list[list[dict]]]:
        """For each text a list of entities for each choice."""
        prompts = [self.prompt.replace("{TEXT}", t or "") for t in texts]
        found: dict[int, list[list[dict]]] = {}
        for _ in range(self.attempts):
            failed = [i for i in range(len(texts)) if i not in found]
            if not failed:
                break
            for i, answer in zip(failed, self.ask([prompts[i] for i in failed]), strict=True):
                read = [en.read_answer(a) for a in ([answer] if isinstance(answer, str) or answer is None else answer)]
                if read and None not in read:
                    found[i] = read
        return [found.get(i, [[] for _ in range(self.choices)]) for i in range(len(texts))]

    def annotate(self, texts: list[str]) -> list[list[dict]]:
        """Entities of the first choice."""
        return [choices[0] for choices in self.annotate_choices(texts)]


def allowed_model(name: str, allowed: str | None) -> str:
    """`name` if it contains one of the names listed in `allowed` (set apart by "; ", none listed allows all); else ValueError."""
    if allowed and not any(a in name for a in allowed.split("; ") if a):
        raise ValueError(f"model {name!r} is not among {allowed!r}")
    return name


register("gazetteer", Gazetteer)
register("llm", LanguageModel)


def annotate(chunks: DataFrame, model: Annotator, text_col: str = "text", batch: int = 512) -> DataFrame:
    """`chunks` with `entities`; texts go to the model in batches and every batch must come back whole."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                found = model.annotate(part[text_col].tolist())
                if len(found) != len(part):
                    raise ValueError(f"the annotator gave {len(found)} results for {len(part)} texts")
                yield part.assign(entities=found)

    return chunks.mapInPandas(run, f"{columns}, entities {ENTITIES}")


def answers_to_entities(df: DataFrame, attempts_col: str = "attempts") -> DataFrame:
    """Model answers (an array for each row, one for each attempt) -> `entities` of the first that validates.

    All of it happens inside the row; null or empty arrays give no entities.
    """
    cleaned = F.transform(attempts_col, en.clean_response)
    return df.withColumn("entities", en.first_valid(en.parsed_all(cleaned)))


def predict_relations(chunks: DataFrame, model: RelationModel, keys: list[str], batch: int = 8) -> DataFrame:
    """`keys, tokens, relations`, one row for each chunk in one pass; chunks without two entities skip the model."""
    kinds = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = [i for i, e in enumerate(pdf["entities"]) if e is not None and len(e) > 1]
            relations: list[list] = [[] for _ in range(len(pdf))]
            for lo in range(0, len(asked), batch):
                part = pdf.iloc[asked[lo : lo + batch]]
                found = model.predict([list(t) for t in part["tokens"]], [list(e) for e in part["entities"]])
                for i, r in zip(asked[lo : lo + batch], found, strict=True):
                    relations[i] = r
            yield pdf[[*keys, "tokens"]].assign(relations=relations)

    return chunks.select(*keys, "tokens", "entities").mapInPandas(run, f"{kinds}, tokens array<string>, relations array<{PREDICTED_RELATION_DDL}>")


def with_language(df: DataFrame, detect: Callable[[str], str | None], text_col: str = "text", column: str = "detected") -> DataFrame:
    """Hook for language detection: `detect(text)` for each row, in batches; null where it fails or the text is null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else detect(text)
        except Exception:  # best effort: any failure of a detector means not known
            return None

    @pandas_udf("string")
    def detected(texts: pd.Series) -> pd.Series:
        return texts.map(one).astype(object)

    return df.withColumn(column, detected(text_col))


def timed(name: str, action: Callable[[], object]) -> dict:
    """Seconds that an action took, to be written beside its output."""
    began = time.monotonic()
    action()
    return {"name": name, "elapsed": time.monotonic() - began}


def write_timings(spark, timings: list[dict], path: str) -> None:
    """Timings of this run beside its output, one JSON line each; they add to those of earlier runs."""
    spark.createDataFrame(timings, "name string, elapsed double").coalesce(1).write.mode("append").json(path)


def seconds_by_model(timings: DataFrame, model: str = "name", seconds: str = "elapsed") -> DataFrame:
    """Seconds summed by model."""
    return timings.groupBy(model).agg(F.sum(seconds).alias(seconds))
