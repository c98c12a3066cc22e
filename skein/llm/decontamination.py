r"""Benchmark decontamination: a prefix-filtered set join of items' windows with documents.

A window is ten consecutive words of an item, or all words of a shorter one. Its elements are its shingles of five words
(or the whole window, where that is shorter). A document contains a window only if it contains every one of
its shingles, so it is enough to look for one: the necessary prefix of a set that has to be contained whole is its first
element in any order. Ordered by rarity in the documents, that is the shingle which fewest of them hold.

1. A pass over the documents counts how often each item shingle comes up in them. Windows whose rarest shingle never does are done with.
2. A second pass emits, for each place that holds the rarest shingle of some window, the words around it
   (a window's reach on either side, some fifteen words), so texts never move.
3. Those places are joined with the windows by shingle. Where the shingle stands in its window gives the only place where
   the window can begin; it has to begin in the text (positional bound) and end in it (length bound).
4. The words at that place are compared with the window's: exact, whatever hashes collided.
5. Occurrences become, for each document, the number of words that any of them covers, and the items that they belong to.

Both passes leave out places by a bitmap of the shingles' hashes, of MOST_BITS bits at most, whatever the benchmark's
size: it is all that is sent to every task. A place that it lets through in error ends in the join. Frequent
shingles are keys of joins between two written tables only, which adaptive execution splits.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` with A-Z in lower case.

Defined cases: a null or empty text has no words; an item without words has no window; an item_id that several rows hold
is one item with the windows of all; items without an id mark words but are not listed; rows with equal doc_id and
text have equal results, and rows without an id are told apart by their texts; other columns pass through ``clean``; with an empty
benchmark nothing is hit; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import read_table, ship, written

WINDOW, SHINGLE = 10, 5
#: Bits of a bitmap for each shingle, and in all.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 26
#: Words whose hash a worker keeps; it starts anew beyond.
KEPT_WORDS = 200_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
KEY = ["id", "none", "text_hash"]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; runs of other sizes have other hashes."""
    own = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ own[k : k + n]) * _ODD
        h ^= h >> np.uint64(29)
    return h


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window, size, shingle, hashes): each window of each item; shingle is its elements' number of words."""
    ship(items.sparkSession)

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if not words:
                    continue
                size = min(WINDOW, len(words))
                shingle = min(SHINGLE, size)
                hashes = shingle_hashes(words, shingle).view(np.int64).tolist()
                for k in range(len(words) - size + 1):
                    for column, value in zip(out, (item, b" ".join(words[k : k + size]).decode(), size, shingle, hashes[k : k + size - shingle + 1]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["item_id", "window", "size", "shingle", "hashes"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, window string, size int, shingle int, hashes array<long>")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Two bits for each hash (column h). No more than MOST_BITS bits whatever there is."""
    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_EACH).bit_length()))
    at = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1)))).alias("at"))
    by_word = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    found = by_word.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of hashes that the bitmap doesn't rule out."""
    mask = np.uint64(len(bits) * 64 - 1)
    test = lambda x: (bits[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1)
    first = np.flatnonzero(test(h & mask))
    return first[test((h[first] >> np.uint64(32)) & mask) != 0]


def shingle_counts(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(h, n): how often shingles that the bitmap lets through come up in docs."""

    def run(batches):
        for batch in batches:
            found = [h[_may_hold(bits, h)] for t in batch.column(0) for words in (words_of(t.as_py()),) for h in (shingle_hashes(words, s) for s in sizes)]
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _key() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def places(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(id, none, text_hash, doc_id, n_words, places): by row, where a shingle of the bitmap may stand, with the words around."""
    id_type = docs.schema["doc_id"].dataType
    key_type = docs.select(_key()[0]).schema["id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("around", pa.string())]))

    def run(batches):
        for batch in batches:
            counts, found = [], []
            for t in batch.column(4):
                words = words_of(t.as_py())
                own = []
                for size in sizes:
                    h = shingle_hashes(words, size)
                    reach = WINDOW - size if size == SHINGLE else 0  # shorter windows are one shingle
                    for at in _may_hold(bits, h).tolist():
                        first = max(0, at - reach)
                        own.append({"h": int(h[at : at + 1].view(np.int64)[0]), "at": at, "first": first, "around": b" ".join(words[first : at + size + reach]).decode()})
                counts.append(len(words))
                found.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, pa.int64()), pa.array(found, kind)], names=[*KEY, "doc_id", "n_words", "places"])

    rows = docs.select(*_key(), "doc_id", "text")
    return rows.mapInArrow(run, f"id {key_type}, none boolean, text_hash long, doc_id {id_type.simpleString()}, n_words long, places array<struct<h: long, at: long, first: long, around: string>>")


def occurrences(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of docs with n_words; (key, begin, end, window) for every occurrence; (window, item_id)."""
    ship(docs.sparkSession)
    windows = written(item_windows(items), "windows")
    own = written(windows.groupBy("window").agg(F.first("size").alias("size"), F.first("shingle").alias("shingle"), F.first("hashes").alias("hashes")), "own_windows")
    listed = written(windows.filter("item_id IS NOT NULL").select("window", "item_id").distinct(), "listed")
    sizes = sorted(r["shingle"] for r in own.select("shingle").distinct().collect())  # SHINGLE at most
    elements = own.select("window", "size", F.posexplode("hashes").alias("offset", "h"))
    counts = written(shingle_counts(docs, bitmap(elements.select("h").distinct()), sizes), "counts")
    # the rarest shingle of each window; one that no document holds rules the window out
    ordered = elements.join(counts, "h", "left").select("window", "size", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset").alias("rarity"))
    rarest = ordered.groupBy("window", "size").agg(F.min("rarity").alias("prefix")).filter("prefix.n > 0")
    prefixes = written(rarest.select("window", "size", "prefix.h", "prefix.offset"), "prefixes")
    rows = written(places(docs, bitmap(prefixes.select("h").distinct()), sizes), "places")
    candidates = rows.select(*KEY, "n_words", F.explode("places").alias("p")).select(*KEY, "n_words", "p.*").join(prefixes, "h")
    begin = F.col("at") - F.col("offset")
    bounded = candidates.withColumn("begin", begin).filter((F.col("begin") >= 0) & (F.col("begin") + F.col("size") <= F.col("n_words")) & (F.col("begin") >= F.col("first")))
    there = F.array_join(F.slice(F.split("around", " "), (F.col("begin") - F.col("first") + 1).cast("int"), F.col("size")), " ")
    verified = bounded.filter(there == F.col("window")).select(*KEY, "begin", (F.col("begin") + F.col("size")).alias("end"), "window")
    return rows.select("doc_id", *KEY, "n_words"), written(verified, "occurrences"), listed


def marked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, none, n_words, n_hit, items) by row: words inside occurrences, and the ids of the items found as sorted strings."""
    rows, found, listed = occurrences(docs, items)
    spans = F.sort_array(F.collect_set(F.struct("begin", "end")))  # as many as the text has words
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["begin"]))).alias("n")),
        lambda a: a["n"],
    )
    hits = written(found.groupBy(*KEY).agg(spans.alias("spans")).select(*KEY, covered.alias("n_hit")), "hits")
    of_items = found.select(*KEY, "window").distinct().join(listed, "window").groupBy(*KEY).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    done = rows.join(hits, KEY, "left").join(written(of_items, "items"), KEY, "left")
    return done.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no window, under the same columns."""
    _, found, _ = occurrences(docs, items)
    bad = written(found.select(*KEY).distinct(), "contaminated").toDF(*(f"_{k}" for k in KEY))
    held = docs.select(*[c.alias(f"_{n}") for n, c in zip(KEY, _key(), strict=True)], F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return held.join(bad, [f"_{k}" for k in KEY], "left_anti").select("_row.*")


def op13_prefix_filtered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = marked(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least({WINDOW}, len(ws)) AS size, ws[k : k + least({WINDOW}, len(ws)) - 1] AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
s AS (SELECT DISTINCT size FROM w),
p AS (SELECT doc_id, size, k, ws[k : k + size - 1] AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM t, s WHERE len(ws) >= size)),
o AS (SELECT p.doc_id, p.k, p.size, item_id FROM p JOIN w USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, size)) AS j FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
QUERIES = {"op13_prefix_filtered_windows": op13_prefix_filtered_windows}
ORACLES = {"op13_prefix_filtered_windows": SQL}
