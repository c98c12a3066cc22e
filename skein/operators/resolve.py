"""Calls and imports across files: joins that never guess between several candidates.

What a join looks up is a table of its own first, so that both sides are dealt out anew and adaptive execution can split
a name that a third of all calls hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.schemas import EXTRACTED
from skein.shared import stored


def symbol_rows(nodes: DataFrame) -> DataFrame:
    """(name, id, seq, source_file) of nodes that name a symbol: not empty, and not the file's own name."""
    named = nodes.withColumn("name", X.simple_label(F.col("label")))
    return named.filter((F.col("name") != "") & (F.col("name") != X.basename(F.col("source_file")))).select("name", "id", "seq", "source_file")


def unique_symbols(nodes: DataFrame) -> DataFrame:
    """(name, id, target_source_file) of names with exactly one definition."""
    found = symbol_rows(nodes).groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("source_file").alias("target_source_file"))
    return stored(found.filter("n = 1").drop("n"), "unique_symbols")


def symbols_last_wins(nodes: DataFrame) -> DataFrame:
    return symbol_rows(nodes).groupBy("name").agg(F.max_by("id", "seq").alias("id"), F.max("seq").alias("seq"))


def normalized_first_wins(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(X.normalize_identifier(F.col("name")).alias("normalized")).agg(F.min_by("id", "seq").alias("id"))


def module_imports(raw_imports: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of imports that name a module's dotted path (the last file of a path wins), and the imports left."""
    known = stored(modules.groupBy("module").agg(F.max_by("id", "seq").alias("target")), "modules")
    joined = raw_imports.join(known, "module", "left")
    edges = joined.filter(F.col("target").isNotNull()).select(F.col("source_id").alias("source"), "target", "relation", F.lit(EXTRACTED).alias("confidence"), "source_file", F.col("line").alias("source_location"), F.lit(None).cast("string").alias("context"))
    return edges, joined.filter(F.col("target").isNull()).select(*raw_imports.columns)


def resolve_calls(raw_calls: DataFrame, nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Edges for calls whose name has one definition, other than the caller itself, with the calls' columns ``keep``."""
    found = raw_calls.join(unique_symbols(nodes).withColumnRenamed("name", "callee_name"), "callee_name")
    return found.filter(F.col("id") != F.col("caller_id")).select(
        F.col("caller_id").alias("source"), F.col("id").alias("target"), F.lit("calls").alias("relation"), F.lit(EXTRACTED).alias("confidence"), "source_file", F.col("line").alias("source_location"), F.lit("cross_file").alias("context"), "target_source_file", *keep
    )


def resolve_imports(raw_imports: DataFrame, nodes: DataFrame, namespaces: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Edges for imports: by the symbol that the last component names, if it is unique; else by a
    declared namespace (rows namespace, id) that one file has. An import of oneself gives no edge, and no second try."""
    unique = unique_symbols(nodes).withColumnRenamed("name", "symbol")
    spaces = namespaces.groupBy("namespace").agg(F.count("*").alias("n"), F.first("id").alias("file_id")).filter("n = 1").drop("n")
    spaces = stored(spaces, "namespaces")
    keyed = raw_imports.withColumns({"symbol": X.last_component(F.col("module")), "namespace": F.trim("module")})
    joined = keyed.join(unique, "symbol", "left").join(spaces, "namespace", "left")
    by_symbol = F.col("id").isNotNull()
    target = F.when(by_symbol, F.col("id")).otherwise(F.col("file_id"))
    found = joined.withColumns({"target": target, "context": F.when(by_symbol, "cross_file_import").otherwise("cross_file_import_namespace")})
    return found.filter(F.col("target").isNotNull() & (F.col("target") != F.col("source_id"))).select(
        F.col("source_id").alias("source"), "target", "relation", F.lit(EXTRACTED).alias("confidence"), "source_file", F.col("line").alias("source_location"), "context", F.when(by_symbol, F.col("target_source_file")).alias("target_source_file"), *keep
    )
