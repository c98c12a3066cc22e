"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

``assign_shards`` maps each row's key to one of ``shards`` shards without a ring table. The walk of
jumps depends on the key alone, so a further shard takes rows only into itself and every other row
stays. Rows get a gapless slot inside their shard, in key order.

Plan: one narrow range exchange of (key, size, checksum) - the text never moves - then local counts for
each range and shard, whose running sums (ranges x shards rows, a bound that doesn't follow the
rows' number) are broadcast back. A key that a third of the rows share is spread over many ranges,
because the input position is the last sort column.

Defined cases: a null key hashes as 0 and sorts first; a null text has size 1 and checksum 0; repeated
rows each get a slot of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import read_table, ship, written

SHARDS = 8


def jump_hash(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each unsigned 64-bit key among ``shards``, and among one more."""
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    following = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = following[live]
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            following[live] = ((at[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
            live = live[following[live] < shards]
    return at.astype(np.int32), np.where(following == shards, shards, at).astype(np.int32)


def assign_shards(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: key, size, text_crc32, law, shard, slot, grown_shard (the shard if there were one more)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    ship(df.sparkSession)
    narrow = df.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("input_position"),
    )
    numeric = dict(narrow.dtypes)["key"] in ("tinyint", "smallint", "int", "bigint")
    hashed = F.col("key").cast("long") if numeric else F.xxhash64("key")
    order = ["key", "size", "text_crc32", "input_position"]
    ranged = narrow.withColumn("hashed", F.coalesce(hashed, F.lit(0))).repartitionByRange(*order).sortWithinPartitions(*order)

    def place(batches):
        block, taken = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("hashed")).to_numpy(zero_copy_only=False)
            shard, grown = jump_hash(keys.astype(np.int64).view(np.uint64), shards)
            position = np.empty(len(shard), np.int64)
            for s in range(shards):
                mine = np.flatnonzero(shard == s)
                position[mine] = taken[s] + np.arange(len(mine))
                taken[s] += len(mine)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.full(len(shard), block, np.int32)), pa.array(shard), pa.array(grown), pa.array(position)],
                names=["key", "size", "text_crc32", "block", "shard", "grown_shard", "position"],
            )

    kind = narrow.schema["key"].dataType.simpleString()
    placed = written(ranged.mapInArrow(place, f"key {kind}, size long, text_crc32 long, block int, shard int, grown_shard int, position long"), "shards")
    running = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("block", "shard").agg((F.max("position") + 1).alias("rows"))
    offsets = offsets.select("block", "shard", F.coalesce(F.sum("rows").over(running), F.lit(0)).alias("before"))
    # ranges x shards rows at most: the number of ranges is spark.sql.shuffle.partitions
    return placed.join(F.broadcast(offsets), ["block", "shard"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("position")).alias("slot"), "grown_shard"
    )


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), SHARDS)


#: Walks the jumps with 128-bit integers, and computes CRC-32 byte by byte with a table made from the polynomial.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
jumps AS (
  SELECT doc_id, (coalesce(doc_id, 0) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM d
  UNION ALL
  SELECT doc_id, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM jumps WHERE j < {SHARDS})
),
ends AS (SELECT doc_id, max(b) AS shard, max(j) AS j FROM jumps GROUP BY doc_id),
rule AS (SELECT list(v ORDER BY i) AS crc FROM (
  SELECT i, list_reduce([i::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i))),
sums AS (
  SELECT doc_id, t, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM d, rule)
SELECT s.doc_id, strlen(s.t)::BIGINT + 1 AS size, s.crc::BIGINT AS text_crc32, 'key' AS law, e.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY e.shard ORDER BY s.doc_id) - 1 AS slot,
  (CASE WHEN e.j = {SHARDS} THEN {SHARDS} ELSE e.shard END)::INTEGER AS grown_shard
FROM sums s JOIN ends e ON s.doc_id IS NOT DISTINCT FROM e.doc_id
"""
QUERIES = {"op1_jump_shards": op1_jump_shards}
ORACLES = {"op1_jump_shards": SQL}
