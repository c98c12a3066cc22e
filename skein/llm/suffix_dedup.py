"""Removal of long byte strings that occur twice, with suffix arrays by induced sorting.

Every byte covered by a string of ``length`` bytes that also starts anywhere else - in this text or in
another - is marked. Matches never cross texts, overlaps count, and strings are judged on the input.

1. Each text's windows of ``length`` bytes are dealt into segments without looking at other texts:
   a window belongs to the place of the smallest hash among the GRAM-byte strings inside it, and windows
   in turn with the same place are one segment. Equal windows have equal places, so they lie in
   segments with equal keys (that hash); other segments can't share a window.
2. Keys are counted, with partial sums. Segments whose key occurs once are done: most are.
3. Equal segments are one from then on, and wholly covered where there are two: a text that a third of the
   rows copy is one row in all that follows.
4. Segments that share their key with different ones are gathered, by key, into shards of about
   SHARD_BYTES. A shard's suffix array is made by induced sorting, with strings that all of a group's
   windows share as one number, and neighbours whose permuted common prefix is a whole window mark it.
5. The different segments of a key beyond SHARD_BYTES (a passage in very many texts, each with other
   text around it) are not put into one shard: their windows are hashed and counted, dealt out by hash.
   That is the exact way for the rest, not a cap.
6. Covered runs meet their texts in one equi-join.

Defined cases: a null text is empty; texts below ``length`` bytes keep everything; repeated rows
are occurrences of their own, so both lose what they share; a null doc_id is the largest long integer
inside, and null in results; other columns pass through ``remove_repeats``; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import free_names, read_table, ship, written
from skein.llm.suffix_array import permuted_lcp, suffix_array

LENGTH = 400
#: A segment's key is the hash of so many bytes.
GRAM = 128
SHARD_BYTES = 2 << 20
PARTS = 4
#: Bytes that are hashed at a time; positions among them take 21 bits.
BLOCK = 1 << 18
#: Rows of an Arrow batch that are Python objects at a time.
ROWS = 200
LAST_ID = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def few_rows(batches):
    """The batches in slices, so that whole texts are few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if n not in _TABLES:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _TABLES[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _TABLES[n]


def _gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram-byte string."""
    up, down = _powers(2 * BLOCK)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(codes) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in turn."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def segments_of(data: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, first byte, last byte + 1, place) of the segments of texts laid one after the other in at most BLOCK + length bytes; ends: theirs."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none, none
    codes = np.frombuffer(data, np.uint8)
    hashes = _gram_hashes(codes, gram)
    tagged = ((hashes >> np.uint64(21)) << np.uint64(21)) | np.arange(len(hashes), dtype=np.uint64)
    place = (_sliding_least(tagged, length - gram + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
    starts = np.arange(len(place))
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[text]
    starts, place, text = starts[inside], place[inside], text[inside]
    if not len(starts):
        return none.view(np.uint64), none, none, none
    new = np.r_[True, (starts[1:] != starts[:-1] + 1) | (place[1:] != place[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    return hashes[place[first]], starts[first], starts[last] + length, place[first]


def _blocks(texts: list[bytes], length: int):
    """(numbers of texts, offsets in them, ends, bytes): short texts together, long ones in overlapping blocks."""
    held: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > BLOCK:
            for start in range(0, len(text) - length + 1, BLOCK):  # windows that start in the block
                part = text[start : start + BLOCK + length - 1]
                yield np.array([k]), np.array([start]), np.array([len(part)]), part
            continue
        if size + len(text) > BLOCK:
            yield np.array(held), np.zeros(len(held), np.int64), np.cumsum([len(texts[i]) for i in held]), b"".join(texts[i] for i in held)
            held, size = [], 0
        held.append(k)
        size += len(text)
    if held:
        yield np.array(held), np.zeros(len(held), np.int64), np.cumsum([len(texts[i]) for i in held]), b"".join(texts[i] for i in held)


def find_segments(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, segment, doc, text_hash, start, size, place): segment is a hash of the segment's bytes, place where its key's string starts in it."""
    ship(docs.sparkSession)

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for batch in few_rows(batches):
            docs_in, hashes_in = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [x.as_py() for x in batch.column(2)]
            for numbers, offsets, ends, data in _blocks(texts, length):
                keys, a, b, place = segments_of(data, ends, length, gram)
                if not len(keys):
                    continue
                own = np.searchsorted(ends, a, side="right")
                text_start = np.r_[0, ends[:-1]][own]
                view = memoryview(data)
                digests = np.array([xxh3_64_intdigest(view[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
                row = numbers[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(digests.view(np.int64)), pa.array(docs_in[row]), pa.array(hashes_in[row]), pa.array(a - text_start + offsets[own]), pa.array((b - a).astype(np.int32)), pa.array((place - a).astype(np.int32))],
                    names=["key", "segment", "doc", "text_hash", "start", "size", "place"],
                )

    rows = docs.select(*_document(), _bytes()).filter(F.octet_length("data") >= length)
    return rows.mapInArrow(run, "key long, segment long, doc long, text_hash long, start long, size int, place int")


def _document():
    return F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def _bytes():
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data")


def repeated_windows(pieces: list[bytes], places: list[int], length: int = LENGTH, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """Of each piece, the runs of bytes that windows found elsewhere among the pieces cover.

    All windows of a piece hold the gram bytes at its place. They fall into PARTS by how far before it they
    start; a part's windows hold a longer string, its core, and only pieces that share a core can
    share a window of that part. In the text that is sorted a core is one number, so that just the bytes
    around it are left.
    """
    width = -(-(length - gram + 1) // PARTS)
    sharing: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
    for k, (piece, place) in enumerate(zip(pieces, places, strict=True)):
        for part in range(PARTS):
            near, far = part * width, min((part + 1) * width - 1, length - gram)
            low, high = max(place - far, 0), min(place - near, len(piece) - length)
            if low <= high:
                sharing.setdefault((part, piece[place - near : place - far + length]), []).append((k, low, high))
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    codes, own, least, core_number = [], [], [], 256
    closing = 256 + sum(len(v) > 1 for v in sharing.values())
    for (part, core), members in sharing.items():
        if len(members) < 2:
            continue
        near = part * width
        for k, low, high in members:
            before, after = places[k] - near, places[k] - near + len(core)
            piece = pieces[k]
            # closed by a number of its own, so that no match goes on into the next
            codes += [np.frombuffer(piece, np.uint8, before - low, low), [core_number], np.frombuffer(piece, np.uint8, high + length - after, after), [closing]]
            own.append((k, low, high + length - after + before - low + 2, before - low))
            least.append(length - len(core) + 1)
            closing += 1
        core_number += 1
    if not own:
        return out
    text = np.concatenate(codes).astype(np.int64)
    members, lows, sizes, lefts = (np.array(x) for x in zip(*own, strict=True))
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(text)) - (ends - sizes)[of]
    windows = inside <= lefts[of]  # those that start no later than their core
    order = suffix_array(text)
    common = permuted_lcp(text, order)
    order = np.array(order)
    needed = np.where(windows, np.array(least)[of], len(text) + 1)
    same = np.flatnonzero(common[order] >= needed[order])  # ranks whose predecessor shares a window
    marked = np.unique(np.r_[order[same], order[same - 1]])
    found = np.stack([members[of[marked]], lows[of[marked]] + inside[marked]], axis=1)
    for k, p in sorted(map(tuple, found.tolist())):
        runs = out[k]
        if runs and p <= runs[-1][1]:
            runs[-1] = (runs[-1][0], p + length)
        else:
            runs.append((p, p + length))
    return out


def _covered_in_shards(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, text_hash, a, b) from rows (key, n, doc, text_hash, start, data, place), by suffix arrays of whole keys."""

    def cover(rows):
        found = repeated_windows([r[5] for r in rows], [r[6] for r in rows], length, gram)
        spans = [(r[2], r[3], r[4] + a, r[4] + b) for r, runs in zip(rows, found, strict=True) if r[1] == 1 for a, b in runs]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*spans, strict=True) if spans else ([], [], [], []))], names=["doc", "text_hash", "a", "b"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= SHARD_BYTES:
                    yield cover(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield cover(held)

    dealt = pieces.repartition("key").sortWithinPartitions("key", "segment")
    return dealt.select("key", "n", "doc", "text_hash", "start", "data", "place").mapInArrow(run, "doc long, text_hash long, a long, b long")


def _covered_by_windows(pieces: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many different segments: windows are hashed and counted."""

    def run(batches):
        for batch in few_rows(batches):
            for n, doc, text_hash, start, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                at = range(len(data) - length + 1)
                digests = np.frombuffer(b"".join(hashlib.blake2b(data[p : p + length], digest_size=16).digest() for p in at), np.int64).reshape(-1, 2)
                same = lambda x: pa.array(np.full(len(at), x, np.int64))
                arrays = [pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), same(n), same(doc), same(text_hash), pa.array(np.arange(len(at)) + start)]
                yield pa.RecordBatch.from_arrays(arrays, names=["w1", "w2", "n", "doc", "text_hash", "a"])

    rows = pieces.select("n", "doc", "text_hash", "start", "data").mapInArrow(run, "w1 long, w2 long, n long, doc long, text_hash long, a long")
    rows = written(rows, "windows")
    again = written(rows.groupBy("w1", "w2").agg(F.count("*").alias("times")).filter("times > 1").select("w1", "w2"), "again")
    found = rows.filter("n = 1").join(again, ["w1", "w2"], "left_semi").select("doc", "text_hash", "a").distinct()
    # windows that touch become one run before a text gathers its own
    order = Window.partitionBy("doc", "text_hash").orderBy("a")
    found = found.withColumn("new", F.coalesce(F.col("a") > F.lag("a").over(order) + length, F.lit(True)).cast("long"))
    found = found.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return found.groupBy("doc", "text_hash", "run").agg(F.min("a").alias("a"), (F.max("a") + length).alias("b")).drop("run")


def covered_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, text_hash, spans) of texts that hold repeated windows: an array of (a, b), which may overlap."""
    found = written(find_segments(docs, length, gram), "segments")
    # a table of its own, so that the join deals both sides out anew and a key of very many rows can be split
    shared = written(found.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"), "keys")
    # dealt out by document: a key or segment of very many rows lies in every file, so that later joins can split it
    rows = written(found.join(shared, "key").repartition("doc", "start"), "shared")
    distinct = rows.groupBy("key", "segment").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc", "text_hash", "start", "size", "place")])
    distinct = written(distinct, "distinct")
    copies = rows.join(distinct.filter("n > 1").select("key", "segment"), ["key", "segment"], "left_semi")
    copies = copies.select("doc", "text_hash", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))

    keys = distinct.groupBy("key").agg(F.count("*").alias("different"), F.sum("size").alias("bytes")).filter("different > 1")
    wanted = distinct.join(written(keys.select("key", "bytes"), "sizes"), "key")
    wanted = wanted.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("key", "segment", "n", "start", "size", "place", (F.col("bytes") > SHARD_BYTES).alias("many"))).alias("wanted"))
    texts = docs.select(*_document(), _bytes()).join(wanted, ["doc", "text_hash"])
    kind = "key long, segment long, n long, start long, place int, many boolean"

    def cut(batches):
        for batch in few_rows(batches):
            for doc, text_hash, data, ones in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                columns = [[x[c] for x in ones] for c in ("key", "segment", "n", "start", "place", "many")]
                parts = [data[x["start"] : x["start"] + x["size"]] for x in ones]
                arrays = [*(pa.array(v, t) for v, t in zip(columns, (pa.int64(),) * 4 + (pa.int32(), pa.bool_()), strict=True)), pa.array([doc] * len(ones), pa.int64()), pa.array([text_hash] * len(ones), pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "segment", "n", "start", "place", "many", "doc", "text_hash", "data"])

    pieces = texts.select("doc", "text_hash", "data", "wanted").mapInArrow(cut, f"{kind}, doc long, text_hash long, data binary")
    # rows that repeat an id and text give a segment twice, which then marks itself: it is one of n > 1 and covered anyway
    pieces = written(pieces, "pieces")
    spans = copies.union(_covered_in_shards(pieces.filter("not many"), length, gram)).union(_covered_by_windows(pieces.filter("many"), length))
    return spans.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with n_bytes, runs (array of (a, b), the removed bytes) and kept (the remaining bytes)."""
    doc, text_hash, found, data = free_names(docs, "doc", "text_hash", "spans", "data")
    rows = docs.withColumns(dict(zip((doc, text_hash), _document(), strict=True)))
    spans = covered_spans(docs.select("doc_id", "text"), length, gram).toDF(doc, text_hash, found)
    joined = rows.join(spans, [doc, text_hash], "left")
    own = [f for f in docs.schema.fields if f.name.lower() not in ("n_bytes", "runs", "kept")]
    run_type = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    schema = T.StructType([*own, T.StructField("n_bytes", T.LongType()), T.StructField("runs", run_type), T.StructField("kept", T.BinaryType())])
    names = [f.name for f in own]

    def cut(batches):
        for batch in few_rows(batches):
            texts, found = batch.column(len(names)), batch.column(len(names) + 1)
            sizes, runs, kept = [], [], []
            for text, spans in zip(texts, found, strict=True):
                data, own_runs = text.as_py(), merged([(x["a"], x["b"]) for x in spans.as_py() or ()])
                edges = [0, *(x for r in own_runs for x in r), len(data)]
                sizes.append(len(data))
                runs.append([{"a": a, "b": b} for a, b in own_runs])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int64()), pa.array(runs, pair), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "runs", "kept"])

    return joined.select(*names, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias(data), found).mapInArrow(cut, schema)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 400 bytes, as 800 hexadecimal digits, is hashed and counted.
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, a, md5(substr(h, 2 * a + 1, {2 * LENGTH})) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS a FROM d WHERE length(h) >= {2 * LENGTH})),
again AS (SELECT r, a FROM (SELECT r, a, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
marks AS (SELECT *, CASE WHEN a <= lag(a) OVER (PARTITION BY r ORDER BY a) + {LENGTH} THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT r, g, min(a) AS a, max(a) + {LENGTH} AS b FROM (SELECT r, a, sum(new) OVER (PARTITION BY r ORDER BY a) AS g FROM marks) GROUP BY r, g),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, list({{'f': before, 't': a}} ORDER BY a) AS keep FROM gaps GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN keep IS NULL THEN h ELSE array_to_string(list_transform(keep, lambda x: substr(h, 2 * x.f + 1, 2 * (x.t - x.f))), '') || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
ORACLES = {"op5_suffix_array_dedup": SQL}
