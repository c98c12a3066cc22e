"""What changed since the last build, and what of it is cached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(rel_path, state) with state new, changed, unchanged or deleted, from rows (rel_path, sha1) of both."""
    now, then = files.select("rel_path", F.col("sha1").alias("now")), cache.select("rel_path", F.col("sha1").alias("then"))
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    return now.join(then, "rel_path", "full_outer").select("rel_path", state.alias("state"))


def status_summary(states: DataFrame) -> DataFrame:
    """One row: the counts, and whether anything needs a build."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, 1)), F.lit(0)).cast("long").alias(s)
    return states.agg(*[count(s) for s in ("new", "changed", "unchanged", "deleted")]).withColumn("needs_rebuild", (F.col("new") + F.col("changed") + F.col("deleted")) > 0)


def _key(files: DataFrame, cache: DataFrame) -> list[str]:
    """A cached result holds for a path and hash, and for the provider that made it where both tables name one."""
    return ["rel_path", "sha1", *(["provider"] if "provider" in files.columns and "provider" in cache.columns else [])]


def hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    key = _key(files, cache)
    return cache.join(files.select(*key), key, "left_semi")


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    key = _key(files, cache)
    return files.join(cache.select(*key), key, "left_anti")


def pruned(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows of files that still exist."""
    return cache.join(files.select("rel_path"), "rel_path", "left_semi")


def updated(cache: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next cache: what still holds and was not extracted again, and fresh results that aren't incomplete.

    A file whose extraction failed leaves the cache. ``fresh`` has the cache's columns and ``incomplete``."""
    kept = hits(files, pruned(cache, files)).join(fresh.select("rel_path"), "rel_path", "left_anti")
    return kept.unionByName(fresh.filter(~F.col("incomplete")).drop("incomplete").select(*cache.columns))
