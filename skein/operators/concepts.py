"""Linking concepts that documents, images and videos name to symbols of the code.

Tiers go from certain to tolerant: exact, then normalized, then approximate, then the provider. A file
refers to each target once over all tiers, and whether a concept goes on to the next tier hangs on
what earlier concepts of its file took, so a file's concepts are handled in turn: one group for each file,
with only the symbols that can match joined to it beforehand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import fuzzy
from skein.functions import text as X
from skein.operators import resolve
from skein.schemas import AMBIGUOUS, INFERRED
from skein.shared import ship, stored


def backtick_mentions(mentions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of a file to the symbols it names between backticks, one for each target, at the first mention.

    mentions: rel_path, file_id, name, line, pos."""
    found = mentions.join(symbols.select("name", F.col("id").alias("target")), "name")
    first = found.groupBy("rel_path", "file_id", "target").agg(F.min_by("line", "pos").alias("line"))
    return first.select(F.col("file_id").alias("source"), "target", F.lit("describes").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.col("rel_path").alias("source_file"), F.concat(F.lit("L"), "line").alias("source_location"), F.lit("backtick_mention").alias("context"))


def exact_matches(concepts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(concept_id, target): symbols whose name is a word of the concept."""
    exploded = concepts.select("concept_id", F.explode(X.words(F.col("name"))).alias("name"))
    return exploded.join(symbols.select("name", F.col("id").alias("target")), "name").select("concept_id", "target").distinct()


def normalized_matches(concepts: DataFrame, symbols: DataFrame, whole: bool = False) -> DataFrame:
    """(concept_id, target) by normal form: of each word, or of the whole name (images)."""
    named = concepts.select("concept_id", F.col("name").alias("word")) if whole else concepts.select("concept_id", F.explode(X.words(F.col("name"))).alias("word"))
    lookup = resolve.normalized_first_wins(symbols)
    return named.withColumn("normalized", X.normalize_identifier(F.col("word"))).join(lookup, "normalized").select("concept_id", F.col("id").alias("target")).distinct()


def _tiers(prefix: str, provider):
    """Contexts are named after the kind of file; a document matches words, an image whole names."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        taken = set(rows["already"].iloc[0]) if len(rows) else set()
        out, pending = [], []

        def add(concept, target, confidence, tier):
            taken.add(target)
            out.append((concept, target, None, confidence, tier))

        for r in rows.itertuples():
            exact, normal = list(r.exact), list(r.normalized)
            open_exact = [t for t in exact if t not in taken]
            if prefix == "vision":
                if exact:
                    for t in open_exact[:1]:
                        add(r.concept_id, t, INFERRED, "vision_exact_match")
                    continue
                hits = [t for t in normal if t not in taken][:1]
                tier = "vision_normalized_match"
            else:
                for t in open_exact:
                    add(r.concept_id, t, INFERRED, "semantic_concept_mention")
                if open_exact:
                    continue
                hits, tier = [t for t in dict.fromkeys(normal) if t not in taken], "normalized_concept_mention"
            for t in hits:
                add(r.concept_id, t, INFERRED, tier)
            if hits:
                continue
            if isinstance(r.fuzzy, str) and r.fuzzy not in taken:
                add(r.concept_id, r.fuzzy, AMBIGUOUS, "vision_fuzzy_match" if prefix == "vision" else "fuzzy_concept_mention")
            else:
                pending.append((r.concept_id, r.name_))
        if pending and provider is not None:
            answers = provider.ask([n for _, n in pending])
            tier = "vision_semantic_llm_link_batch" if prefix == "vision" else "semantic_llm_link_batch"
            out += [(concept, None, answers[name], AMBIGUOUS, tier) for concept, name in pending if name in answers]
        return pd.DataFrame([(rows["rel_path"].iloc[0], k, *x) for k, x in enumerate(out)], columns=["rel_path", "place", "source", "target", "answer", "confidence", "context"])

    return link


def link_concepts(concepts: DataFrame, symbols: DataFrame, already: DataFrame, prefix: str = "semantic", provider=None, threshold: float = fuzzy.THRESHOLD) -> DataFrame:
    """Edges (source, target, relation, confidence, source_file, context) from concepts to symbols.

    concepts: rel_path, concept_id, name, pos. already: rel_path, target of earlier references. A file's
    concepts are as many as its provider named, so a group is bounded by one file."""
    ship(concepts.sparkSession)
    ordered = symbols.withColumnRenamed("id", "target")
    if prefix == "vision":
        exact = concepts.select("concept_id", "name").join(ordered.select("name", "target"), "name").select("concept_id", "target")
    else:
        exact = exact_matches(concepts, symbols)
    # in the symbols' order
    rank = ordered.groupBy("target").agg(F.min("seq").alias("seq"))
    in_order = lambda df, name: df.join(rank, "target").groupBy("concept_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("seq", "target"))), lambda x: x["target"]).alias(name))
    best = fuzzy.best_symbols(concepts, symbols, threshold).select("name", F.col("id").alias("fuzzy"))
    taken = already.groupBy("rel_path").agg(F.collect_set("target").alias("already"))
    none = F.array().cast("array<string>")
    rows = concepts.join(in_order(exact, "exact"), "concept_id", "left").join(in_order(normalized_matches(concepts, symbols, prefix == "vision"), "normalized"), "concept_id", "left")
    rows = rows.join(best, "name", "left").join(taken, "rel_path", "left").withColumnRenamed("name", "name_")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("exact", "normalized", "already")})
    linked = rows.groupBy("rel_path").applyInPandas(_tiers(prefix, provider), "rel_path string, place int, source string, target string, answer string, confidence string, context string")
    if provider is not None:
        linked = _checked(stored(linked, "linked"), symbols, already)
    return linked.select("source", "target", F.lit("references").alias("relation"), "confidence", F.col("rel_path").alias("source_file"), "context")


def _checked(linked: DataFrame, symbols: DataFrame, already: DataFrame) -> DataFrame:
    """linked with a provider's answers as targets, where they are symbols that the file doesn't refer to yet: a file's first one for each."""
    sure = linked.filter("answer is null")
    answered = linked.filter("answer is not null").drop("target").join(symbols.select(F.col("name").alias("answer"), F.col("id").alias("target")), "answer")
    known = sure.select("rel_path", "target").unionByName(already.select("rel_path", "target"))
    new = answered.join(known, ["rel_path", "target"], "left_anti").groupBy("rel_path", "target").agg(F.min(F.struct("place", "source", "confidence", "context")).alias("first"))
    return sure.select("rel_path", "target", "source", "confidence", "context").unionByName(new.select("rel_path", "target", "first.source", "first.confidence", "first.context"))


def relation_edges(relations: DataFrame, concepts: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Edges between what a file's relations name: its concepts, or, with symbols, a symbol first. Others fall away.

    relations: rel_path, source_name, target_name, relation."""
    own = concepts.groupBy("rel_path", "name").agg(F.max_by("concept_id", "pos").alias("concept_id"))
    out = relations
    for end in ("source", "target"):
        out = out.join(own.select("rel_path", F.col("name").alias(f"{end}_name"), F.col("concept_id").alias(f"{end}_concept")), ["rel_path", f"{end}_name"], "left")
        if symbols is not None:
            out = out.join(symbols.select(F.col("name").alias(f"{end}_name"), F.col("id").alias(f"{end}_symbol")), f"{end}_name", "left")
            out = out.withColumn(end, F.coalesce(f"{end}_symbol", f"{end}_concept"))
        else:
            out = out.withColumn(end, F.col(f"{end}_concept"))
    kept = out.filter("source is not null and target is not null")
    return kept.select("source", "target", F.coalesce("relation", F.lit("references")).alias("relation"), F.lit(INFERRED).alias("confidence"), F.col("rel_path").alias("source_file"))
