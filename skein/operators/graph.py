"""Assembling the graph: collisions, duplicates, dangling edges, weights, degrees and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X


def colliding_ids(nodes: DataFrame) -> DataFrame:
    """(id) of ids that nodes of different files share; min and max of the files merge on the map side."""
    return nodes.groupBy("id").agg(F.min("source_file").alias("a"), F.max("source_file").alias("b")).filter("a <> b").select("id")


def salted(node_id, source_file):
    return F.concat(node_id, F.lit("_"), F.substring(F.sha1(F.encode(source_file, "UTF-8")), 1, 6))


def resolve_collisions(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with salted ids where files clash. An edge's end is salted by the file that holds the node:
    ``target_source_file`` where an edge has it, else the edge's own file."""
    clash = colliding_ids(nodes)
    held = nodes.select("id", "source_file").distinct().join(clash, "id", "left_semi")
    fix = held.select(F.col("id").alias("old"), F.col("source_file").alias("of"), salted(F.col("id"), F.col("source_file")).alias("new"))
    out_nodes = nodes.join(fix, (nodes.id == fix.old) & (nodes.source_file == fix["of"]), "left").select(*[F.coalesce("new", "id").alias("id") if c == "id" else F.col(c) for c in nodes.columns])
    out = edges
    for end in ("source", "target"):
        file = F.coalesce("target_source_file", "source_file") if end == "target" and "target_source_file" in edges.columns else F.col("source_file")
        keyed = out.withColumn("_of", file)
        joined = keyed.join(fix, (keyed[end] == fix.old) & (keyed["_of"] == fix["of"]), "left")
        out = joined.select(*[F.coalesce("new", end).alias(end) if c == end else keyed[c].alias(c) for c in edges.columns])
    return out_nodes, out


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the last one's attributes at the first one's place."""
    rest = [c for c in nodes.columns if c not in ("id", "seq")]
    found = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("r"), F.min("seq").alias("first"))
    return found.select(*[F.col("id") if c == "id" else F.col("first").alias("seq") if c == "seq" else F.col(f"r.{c}").alias(c) for c in nodes.columns])


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes, edges = resolve_collisions(nodes, edges)
    nodes = dedup_nodes(nodes)
    return nodes, drop_dangling(edges, nodes)


def collapse_edges(edges: DataFrame) -> DataFrame:
    """(u, v, w): parallel and opposite edges as one, u <= v, weighted by confidence; self-loops stay."""
    return edges.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.sum(X.confidence_weight(F.col("confidence"))).alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) in the directed multigraph; a self-loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def keyed_edges(edges: DataFrame) -> DataFrame:
    """Edges with ``key``: the running number among edges from the same source to the same target."""
    from pyspark.sql import Window

    return edges.withColumn("key", F.row_number().over(Window.partitionBy("source", "target").orderBy("seq")) - 1)


def undirected_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) after opposite edges with equal keys become one."""
    once = keyed_edges(edges).select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "key").distinct()
    return degrees(once)


def top_degrees(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    joined = nodes.select("id", "label", "seq").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return joined.orderBy(F.desc("degree"), "seq").limit(k).select("id", "label", "degree")


def modality_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("modality", F.lit("?")).alias("modality")).agg(F.count("*").alias("n_nodes"))
