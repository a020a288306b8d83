"""Typed constraints on relations between entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.entities import ALIASES
from corpusloom.functions.text import normalise_surface

# Which entity labels each relation takes as head and as tail.
RULES = {
    "authored by": {"allowed_head": ["Creative Work", "Software", "Publication", "Dataset"], "allowed_tail": ["Person", "Project", "Organization"]},
    "related to": {"allowed_head": ["Person"], "allowed_tail": ["Person"]},
    "participant in": {"allowed_head": ["Person", "Organization"], "allowed_tail": ["Event"]},
    "location": {"allowed_head": ["Organization", "Event", "Place", "Point of Interest"], "allowed_tail": ["Place"]},
    "occurred during": {"allowed_head": ["Event"], "allowed_tail": ["Time"]},
    "published by": {"allowed_head": ["Publication"], "allowed_tail": ["Organization", "Person", "Project"]},
}


SIDES = ("allowed_head", "allowed_tail")


def is_name(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


def canonical(label: str) -> str:
    text = label.strip().replace("_", " ")
    return ALIASES.get(" ".join(text.split()).lower(), text)


def validated_rules(rules: dict) -> dict[str, dict[str, list[str]]]:
    """Rules with canonical labels, sorted and without repeats; one ValueError names every malformed entry."""
    table = [(relation, side, sides.get(side) if isinstance(sides, dict) else None) for relation, sides in (rules.items() if isinstance(rules, dict) else ()) for side in SIDES]
    sound = lambda relation, labels: is_name(relation) and isinstance(labels, list) and labels and all(map(is_name, labels))
    wrong = [f"{relation!r} {side}: {labels!r}" for relation, side, labels in table if not sound(relation, labels)]
    if wrong or not table:
        raise ValueError("malformed rules: " + ("; ".join(wrong) or "no relation given"))
    out: dict[str, dict[str, list[str]]] = {}
    for relation, side, labels in table:
        out.setdefault(relation.strip(), {})[side] = sorted(set(map(canonical, labels)))
    return out


def relation_labels(given: list[str] | None, rules: dict | None = None) -> tuple[list[str], list[str]]:
    """Labels to ask for, stripped, once each in the given order (those of the rules if none is given), and those without a rule."""
    known = RULES if rules is None else rules
    labels = list(dict.fromkeys(x.strip() for x in given if is_name(x)) if given else known)
    return labels, [x for x in labels if x not in known]


def allowed(rules: dict, relation: Column, heads: Column, tails: Column) -> Column:
    """Whether some head and some tail label fit the relation's rule; relations without a rule are allowed."""
    checked = validated_rules(rules)

    def side(name: str) -> Column:
        known = F.create_map(*[x for r, s in checked.items() for x in (F.lit(r), F.array(*map(F.lit, s[name])))])
        return F.try_element_at(known, relation)

    head, tail = side("allowed_head"), side("allowed_tail")
    return F.when(head.isNull(), True).otherwise(F.coalesce(F.arrays_overlap(head, heads) & F.arrays_overlap(tail, tails), F.lit(False)))


def label_indexes(entities: DataFrame, chunk: list[str]) -> tuple[DataFrame, DataFrame]:
    """Labels by token span and by surface (as tokenised and as given) of each chunk's entities.

    `entities` has the chunk's key, `start_token, end_token` (inclusive), `label, text, text_tokenized`.
    """
    spans = entities.groupBy(*chunk, "start_token", "end_token").agg(F.collect_set("label").alias("labels"))
    surface = F.explode(F.array_distinct(F.array(normalise_surface(F.col("text")), normalise_surface(F.col("text_tokenized")))))
    texts = entities.select(*chunk, "label", surface.alias("surface")).filter("surface <> ''").groupBy(*chunk, "surface").agg(F.collect_set("label").alias("labels"))
    return spans, texts


def with_types(relations: DataFrame, entities: DataFrame, chunk: list[str]) -> DataFrame:
    """Adds `head_types, tail_types`: labels of the exact span, else of the surface.

    `relations` has the chunk's key, `head_pos, tail_pos` (arrays, end exclusive), `head_text, tail_text`.
    """
    spans, texts = label_indexes(entities, chunk)
    out = relations
    for side in ("head", "tail"):
        span = spans.select(*[F.col(c).alias(f"_{c}") for c in chunk], F.col("start_token").alias("_s"), F.col("end_token").alias("_e"), F.col("labels").alias(f"_{side}_by_span"))
        text = texts.select(*[F.col(c).alias(f"_{c}") for c in chunk], F.col("surface").alias("_t"), F.col("labels").alias(f"_{side}_by_text"))
        same = lambda: [F.col(c) == F.col(f"_{c}") for c in chunk]
        pos = F.col(f"{side}_pos")
        at = [F.get(pos, F.lit(0)) == F.col("_s"), F.get(pos, F.lit(1)) - 1 == F.col("_e")]
        out = out.join(span, [*same(), *at], "left").drop(*[f"_{c}" for c in chunk], "_s", "_e")
        out = out.join(text, [*same(), normalise_surface(F.col(f"{side}_text")) == F.col("_t")], "left").drop(*[f"_{c}" for c in chunk], "_t")
        out = out.withColumn(f"{side}_types", F.coalesce(f"_{side}_by_span", f"_{side}_by_text", F.array().cast("array<string>"))).drop(f"_{side}_by_span", f"_{side}_by_text")
    return out


def constrained(relations: DataFrame, entities: DataFrame, chunk: list[str], rules: dict | None = None) -> DataFrame:
    """Relations that have well-formed positions and satisfy the rules, with `head_types, tail_types`."""
    sound = (F.size("head_pos") == 2) & (F.size("tail_pos") == 2)
    typed = with_types(relations.filter(F.coalesce(sound, F.lit(False))), entities, chunk)
    return typed.filter(allowed(RULES if rules is None else rules, F.col("label"), F.col("head_types"), F.col("tail_types")))


def decoded(relations: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Adds `head_text, tail_text`, the surfaces of the positions (end exclusive)."""
    from corpusloom.functions.text import tokens_to_surface

    surface = lambda pos: tokens_to_surface(F.slice(tokens, F.get(pos, F.lit(0)) + 1, F.get(pos, F.lit(1)) - F.get(pos, F.lit(0))))
    return relations.withColumns({f"{s}_text": surface(F.col(f"{s}_pos")) for s in ("head", "tail")})


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """One row on aligned chunks; they are read once, as aligning is what takes the time."""
    of = lambda method: F.size(F.filter("entities", lambda e: e["alignment_method"] == method)).cast("long")
    scores = F.filter(F.transform("entities", lambda e: e["alignment_score"]), lambda s: s.isNotNull())
    each = chunks.withColumn("entities", F.coalesce("entities", F.array().cast(chunks.schema["entities"].dataType))).select(
        of("char_offset").alias("a"), of("text_fuzzy").alias("b"), F.size(scores).cast("long").alias("n"), F.aggregate(scores, F.lit(0.0), lambda x, y: x + y).alias("s")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    mean = F.coalesce(F.bround(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), 4), F.lit(0.0))
    return each.agg(F.count(F.lit(1)).alias("total_chunks"), total("a").alias("by_offset"), total("b").alias("by_text"), mean.alias("alignment_score_avg"))


def relation_report(chunks: DataFrame, relations: DataFrame, entities: DataFrame, chunk: list[str], rules: dict | None = None, labels_only: bool = False) -> DataFrame:
    """One row of sample statistics: chunks, aligned entities by method, mean alignment score, relations raw and kept.

    `chunks` has the chunk's key and `entities` as `align_entities` gives them; `relations`
    and `entities` are what `constrained` takes.  With `labels_only` no rule applies.
    """
    kept = relations if labels_only else constrained(relations, entities, chunk, rules)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [chunk_statistics(chunks), one(relations, "relations_raw"), one(kept, "relations_kept")]
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]  # a row each
    return keyed[0].join(keyed[1], "_one").join(keyed[2], "_one").drop("_one")
