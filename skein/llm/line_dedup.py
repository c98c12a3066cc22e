"""Line dedup over the whole corpus, in DataFrame operations only.

Lines become 128-bit hashes of their keys. (hash, document, position) rows are range-partitioned by all three,
so that a line that a third of the documents hold is spread over many ranges. Each range is sorted by hash, then
document, then position, and streamed: a row whose hash is not the row's before it is its hash's first
occurrence there, and the rows after it look back to that one. Only what crosses a border is carried: one row
for each range says where the run of its last hash began, and the ranges that begin inside that run take the
earliest. Rows of a later document than the first are dropped, and each document gets its runs of kept and dropped
lines: a run-length bitmap, not text. ``apply_bitmaps`` cuts the texts where that is wanted.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. Keys
of at least ``min_chars`` code points found in two documents or more stay only in the smallest doc_id
that holds them (there, every time).

Defined cases: a null or empty text is one empty line; rows with equal doc_id are one document; a null
doc_id counts as the largest long integer, so other documents keep the line; repeated rows lose
the same lines; other columns pass through ``drop_lines``; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import packed, read_table, written

MIN_CHARS = 10
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 2**63 - 1


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _document() -> tuple[Column, Column]:
    """A document's id for comparisons, and what tells texts of one id apart."""
    return F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row (h1, h2, doc, text_hash, pos) for each line whose key is long enough."""
    lines = docs.select(*_document(), F.posexplode(_lines()).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(STRIPPED)), UPPER, LOWER)
    keyed = lines.select("doc", "text_hash", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "text_hash", "pos")


def later_occurrences(occurrences: DataFrame) -> DataFrame:
    """Those of the rows (h1, h2, doc, text_hash, pos) whose hash a smaller doc holds."""
    order = ["h1", "h2", "doc", "pos"]
    ranged = written(occurrences.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    # one row for each range: its first hash, and its last with the least document that holds it there
    last = F.max(F.struct("h1", "h2", F.bitwise_not("doc").alias("not_doc")))
    edges = written(ranged.groupBy("_range").agg(F.min(F.struct("h1", "h2")).alias("low"), last.alias("high")), "edges")
    begun = edges.groupBy("high.h1", "high.h2").agg(F.min(F.bitwise_not("high.not_doc")).alias("_carried"))
    carried = edges.select("_range", "low.h1", "low.h2").join(F.broadcast(begun), ["h1", "h2"])
    # what streams: the row before, and the last row that began a hash
    rows = Window.partitionBy("_range").orderBy(*order)
    new = ~(F.lag("h1").over(rows).eqNullSafe(F.col("h1")) & F.lag("h2").over(rows).eqNullSafe(F.col("h2")))
    first = F.last(F.when(F.col("_new"), F.col("doc")), ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    streamed = ranged.withColumn("_new", new).withColumn("_first", first)
    # as many rows as there are ranges
    known = streamed.join(F.broadcast(carried), ["_range", "h1", "h2"], "left")
    return known.filter(F.col("doc") > F.least("_first", "_carried")).select(*occurrences.columns)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text_hash, n_dropped, runs) of documents that lose lines; runs: alternating numbers of lines to keep and to drop."""
    later = later_occurrences(written(line_occurrences(docs, min_chars), "lines"))  # texts are split once; ranges are drawn from hashes
    dropped = later.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("at"))  # as many as a document has lines
    at = F.col("at")
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    runs = dropped.select("doc", "text_hash", F.size("at").cast("long").alias("n_dropped"), starts.alias("starts"), ends.alias("ends"))
    begin, end = F.col("starts"), F.col("ends")
    pair = F.transform("starts", lambda x, i: F.struct((x - F.coalesce(F.when(i > 0, F.get(end, i - 1) + 1), F.lit(0))).alias("keep"), (F.get(end, i) - F.get(begin, i) + 1).alias("drop")))
    return runs.select("doc", "text_hash", "n_dropped", pair.alias("runs"))


def _cut(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): row holds all of docs, so that no column can clash and a text moves once."""
    joined = packed(docs, *_document()).join(bitmaps, ["doc", "text_hash"], "left")
    lines = F.split(F.coalesce(F.col("row")["text"], F.lit("")), "\n", -1)
    mask = F.flatten(F.transform("runs", lambda r: F.concat(F.array_repeat(F.lit(True), r["keep"]), F.array_repeat(F.lit(False), r["drop"]))))
    # in an array of one, so that the mask is made once for each text
    cut = F.transform(F.array(mask), lambda m: F.array_join(F.filter(lines, lambda _, i: F.coalesce(F.get(m, i), F.lit(True))), "\n"))
    return joined.select(
        "row",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("runs").isNull(), F.coalesce(F.col("row")["text"], F.lit(""))).otherwise(F.get(cut, 0)).alias("kept_text"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text, in place of columns of these names."""
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    return _cut(docs, bitmaps).select(*[F.col("row")[c].alias(c) for c in rest], "n_lines", "n_dropped", "kept_text")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text that is left, under the same columns."""
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row")["text"])
    done = _cut(docs, keep_bitmaps(docs, min_chars))
    return done.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op7_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)),
k AS (SELECT doc_id, pos, line,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first_doc FROM k),
j AS (SELECT *, length(key) >= {MIN_CHARS} AND doc_id > first_doc AS gone FROM f)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
QUERIES = {"op7_line_bitmaps": op7_line_bitmaps}
ORACLES = {"op7_line_bitmaps": SQL}
