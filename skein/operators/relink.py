"""Links across files after some files have changed: only what a change can reach is joined again.

A call or import of one file may be answered by any other, so a cached file's links can go stale without the file
changing. What decides a link is the set of definitions of a name (one: a link; several: none), of a namespace and of a
module's path. Signed deltas find the names whose set differs: definitions of changed files before count -1, after +1, and a
name is stale where something is left. Links are kept with the keys that they were found by; those of changed files or of
stale keys go, and the calls and imports of changed files or with stale keys are resolved anew, against the
definitions of just the names that they use. The result is that of a whole resolution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import resolve
from skein.shared import stored

KEYS = ["callee_name", "symbol", "namespace", "module"]
EDGE = ["source", "target", "relation", "confidence", "source_file", "source_location", "context", "target_source_file"]


@dataclass
class Change:
    """Files that changed (rel_path), links kept from the last time (EDGE and KEYS), and stale names (name), namespaces (namespace) and modules (module)."""

    files: DataFrame
    kept: DataFrame
    names: DataFrame
    namespaces: DataFrame
    modules: DataFrame


def stale(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key) of what two tables of definitions, of the same columns, don't hold equally often."""
    columns = before.columns
    signed = before.withColumn("sign", F.lit(-1)).unionByName(after.select(*columns).withColumn("sign", F.lit(1)))
    return stored(signed.groupBy(*columns).agg(F.sum("sign").alias("delta")).filter("delta <> 0").select(key).distinct(), "stale")


def names_of(nodes: DataFrame) -> DataFrame:
    """(name, id, source_file): what nodes define."""
    return resolve.symbol_rows(nodes.withColumn("seq", F.lit(0))).select("name", "id", "source_file")


def _in(rows: DataFrame, keys: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """rows whose column is, or isn't, among the one column of keys."""
    return rows.join(keys.toDF(column), column, how)


def to_resolve(calls: DataFrame, imports: DataFrame, change: Change) -> tuple[DataFrame, DataFrame]:
    """The calls and imports that the change can reach."""
    keyed = imports.withColumns({"symbol": X.last_component(F.col("module")), "namespace": F.trim("module")})
    new_calls = _in(calls, change.files, "source_file")
    new_calls = new_calls.unionByName(_in(_in(calls, change.files, "source_file", "left_anti"), change.names, "callee_name"))
    left = _in(keyed, change.files, "source_file", "left_anti")
    marks = left
    for table, column in ((change.names, "symbol"), (change.namespaces, "namespace"), (change.modules, "module")):
        marks = marks.join(table.toDF(column).withColumn(f"_{column}", F.lit(True)), column, "left")
    reached = marks.filter("_symbol OR _namespace OR _module").select(*imports.columns)
    return stored(new_calls, "calls"), stored(_in(imports, change.files, "source_file").unionByName(reached), "imports")


def resolved(calls: DataFrame, imports: DataFrame, nodes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Links (EDGE, KEYS) of calls and imports, whole."""
    of_calls = resolve.resolve_calls(calls, nodes, keep=["callee_name"])
    of_imports = resolve.resolve_imports(imports, nodes, namespaces, keep=["symbol", "namespace", "module"])
    return of_calls.unionByName(of_imports, allowMissingColumns=True).select(*EDGE, *KEYS)


def relinked(calls: DataFrame, imports: DataFrame, nodes: DataFrame, namespaces: DataFrame, change: Change) -> DataFrame:
    """What ``resolved`` gives, from the links kept and the calls and imports that the change can reach."""
    kept = _in(change.kept, change.files, "source_file", "left_anti")
    for table, column in ((change.names, "callee_name"), (change.names, "symbol"), (change.namespaces, "namespace"), (change.modules, "module")):
        kept = _in(kept, table, column, "left_anti")  # a key that a link doesn't have is null and stays
    some_calls, some_imports = to_resolve(calls, imports, change)
    used = some_calls.select(F.col("callee_name").alias("name")).union(some_imports.select(X.last_component(F.col("module")))).distinct()
    needed = nodes.withColumn("name", X.simple_label(F.col("label"))).join(stored(used, "used"), "name", "left_semi").drop("name")
    return kept.select(*EDGE, *KEYS).unionByName(resolved(some_calls, some_imports, needed, namespaces))
