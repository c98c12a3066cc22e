"""Graphs out of the driver's tables, for queries that have no project's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas

#: The question of the flagship query; it names two nations and a region.
QUESTION = "How do NATION_3, NATION_7 and the region ASIA hang together?"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, modality, source_file, seq): regions and nations as concepts, customers and suppliers as code, orders as documents."""
    kinds = (("region", "r_regionkey", F.col("r_name"), "concept", 0), ("nation", "n_nationkey", F.col("n_name"), "concept", 1), ("customer", "c_custkey", F.col("c_name"), "code", 2), ("supplier", "s_suppkey", F.col("s_name"), "code", 3), ("orders", "o_orderkey", _id("order", "o_orderkey"), "document", 4))
    parts = [table(spark, sf_dir, t).select(_id(t, k).alias("id"), label.alias("label"), F.lit(m).alias("modality"), F.lit(f"{t}.tbl").alias("source_file"), (F.col(k).cast("long") + F.lit(n * 10**12)).alias("seq")) for t, k, label, m, n in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, relation, confidence, source_file, seq): who lies where, and whose orders there are."""
    status = F.when(F.col("o_orderstatus") == "F", schemas.EXTRACTED).when(F.col("o_orderstatus") == "O", schemas.INFERRED).otherwise(schemas.AMBIGUOUS)
    kinds = (
        ("nation", "n_nationkey", "region", "n_regionkey", "lies_in", F.lit(schemas.EXTRACTED), 1),
        ("customer", "c_custkey", "nation", "c_nationkey", "lives_in", F.lit(schemas.EXTRACTED), 2),
        ("supplier", "s_suppkey", "nation", "s_nationkey", "sells_from", F.lit(schemas.INFERRED), 3),
        ("orders", "o_orderkey", "customer", "o_custkey", "placed_by", status, 4),
    )
    parts = [table(spark, sf_dir, t).select(_id(t, k).alias("source"), _id(to, ref).alias("target"), F.lit(r).alias("relation"), c.alias("confidence"), F.lit(f"{t}.tbl").alias("source_file"), (F.col(k).cast("long") + F.lit(n * 10**12)).alias("seq")) for t, k, to, ref, r, c, n in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multigraph of parts and suppliers: one edge for each line item, with the return flag as confidence."""
    flag = F.when(F.col("l_returnflag") == "N", schemas.EXTRACTED).when(F.col("l_returnflag") == "R", schemas.INFERRED).otherwise(schemas.AMBIGUOUS)
    return table(spark, sf_dir, "lineitem").select(_id("part", "l_partkey").alias("source"), _id("supplier", "l_suppkey").alias("target"), F.lit("supplied_by").alias("relation"), flag.alias("confidence"), F.lit("lineitem.tbl").alias("source_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


#: The same graphs as DuckDB views.
SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'concept' AS modality, 'region.tbl' AS source_file, r_regionkey::BIGINT AS seq FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'concept', 'nation.tbl', n_nationkey + 1000000000000 FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'code', 'customer.tbl', c_custkey + 2000000000000 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'code', 'supplier.tbl', s_suppkey + 3000000000000 FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'order:' || o_orderkey, 'document', 'orders.tbl', o_orderkey + 4000000000000 FROM orders),
edges AS (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'lies_in' AS relation, 'EXTRACTED' AS confidence, 'nation.tbl' AS source_file, n_nationkey + 1000000000000 AS seq FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives_in', 'EXTRACTED', 'customer.tbl', c_custkey + 2000000000000 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'sells_from', 'INFERRED', 'supplier.tbl', s_suppkey + 3000000000000 FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', CASE o_orderstatus WHEN 'F' THEN 'EXTRACTED' WHEN 'O' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, 'orders.tbl', o_orderkey + 4000000000000 FROM orders),
links AS (
  SELECT least(source, target) AS u, greatest(source, target) AS v, sum(CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.6 WHEN 'AMBIGUOUS' THEN 0.3 ELSE 0.5 END) AS w FROM edges GROUP BY ALL),
supply AS (
  SELECT 'part:' || l_partkey AS source, 'supplier:' || l_suppkey AS target, CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
"""
