"""Cross-entropy difference between a target and a background n-gram model (Moore and Lewis, 2010).

Both models are bigram models with the same order, smoothing and vocabulary: every word and every pair of words
in the corpus, known by a hash in a space that grows with the corpus. The background is counted over all
documents, the target over the documents that ``labels`` mark as good. Every document stands to its models alike,
labelled or not: it belongs to the background, and a target document's own counts are taken out of the target
before it is scored. The models are matched: the background's counts are scaled to the target's number of words,
so that smoothing weighs as much in both. A document's score is the mean, over its words, of the target's log
probability minus the background's: higher is more like the target.

    P1(w)   = (c(w) + ALPHA) / (N + ALPHA * V)
    P(w|v)  = (c(v,w) + MU * P1(w)) / (c(v) + MU)

with N the target's words and V the number of different words. A text's first word is scored by P1; what follows
a text's last word counts as one more symbol, which isn't scored.

Plan: documents and labels are dealt into chunks of about CHUNK_BYTES by doc_id, so no label needs a join of
its own and texts move once. Each chunk counts its words and pairs and sends every different one once, as a 32-bit
number in one of P parts, dealt by hash, of about PART_GRAMS. A part sums what the chunks sent, however frequent an
n-gram is: a chunk sends it once. It answers each chunk with the sums of those n-grams that another chunk
holds too; of the rest, the chunk's own counts are all there are. Then the chunk scores its documents. Nothing is broadcast,
no task holds more than a chunk or a part, and parts grow in number with the corpus (two n-grams of a part
share a number with a chance of PART_GRAMS in 2^32, at every size). Chunks times parts bounds the messages:
beyond some 10 TB, raise CHUNK_BYTES and PART_GRAMS with the executors' memory.

Defined cases: words are maximal runs other than [\\x20\\x09-\\x0D], with A-Z in lower case; a null or
empty text, or one of white space, has no words and a null score; a doc_id counts as target if any of
its labels is good; rows without an id are dealt by their text's hash and are never target; repeated rows
count each, so only one of them is taken out; without labels both models are uniform and scores are 0; other columns pass
through, but ``n_words`` and the scores are replaced; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import free_names, read_table, ship

CHUNK_BYTES = 8 << 20
PART_GRAMS = 2 << 20
ALPHA, MU = 0.1, 50.0
#: Words whose hash a worker keeps; it starts anew beyond.
KEPT_WORDS = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
ADDED = ["n_words", "target_loss", "background_loss", "score"]
#: What chunks and parts send each other. In an answer, parts' sums of all words: how many there are, and how many differ.
MESSAGE = "chunk long, part int, grams binary, total binary, target binary, words long, target_words long, vocabulary long"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().translate(_LOWER).split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


class Space:
    """Numbers of n-grams: (part << 32) + a 32-bit hash. The first ``words`` parts hold words, the others pairs."""

    def __init__(self, words: int, pairs: int):
        self.words, self.pairs = words, pairs

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's words, and of its pairs."""
        with np.errstate(over="ignore"):
            mixed = hashes[:-1] * _MIX + hashes[1:]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
            mixed ^= mixed >> np.uint64(32)
        return self._numbers(hashes, 0, self.words), self._numbers(mixed, self.words, self.pairs)

    @staticmethod
    def _numbers(hashes: np.ndarray, first: int, parts: int) -> np.ndarray:
        part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        return (((part + np.uint64(first)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))).view(np.int64)


def squeezed(counts: np.ndarray) -> bytes:
    """A byte for each count; those from 255 on follow as 64-bit integers."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, -1, n) if len(data) > n else 0
    return out


class Chunk:
    """A chunk's documents as numbers, and its counts of every different n-gram."""

    def __init__(self, texts: list[str], targets: list[bool], space: Space):
        self.texts = [space.of(word_hashes(t)) for t in texts]
        self.targets = targets
        both = [np.concatenate(x) for x in self.texts]
        every = np.concatenate([np.empty(0, np.int64), *both])
        self.grams, self.at = np.unique(every, return_inverse=True)
        good = np.repeat(np.array(targets, bool), [len(x) for x in both]) if both else np.empty(0, bool)
        self.total = np.bincount(self.at, minlength=len(self.grams))
        self.target = np.bincount(self.at[good], minlength=len(self.grams))
        self.n_words = [len(w) for w, _ in self.texts]

    def scores(self, total: np.ndarray, target: np.ndarray, n: int, n_target: int, vocabulary: int) -> list[tuple]:
        """(n_words, target_loss, background_loss, score) of each document, from the corpus's counts of the chunk's n-grams."""
        out, start = [], 0
        for (words, pairs), good, size in zip(self.texts, self.targets, self.n_words, strict=True):
            ids = self.at[start : start + size + len(pairs)]
            start += size + len(pairs)
            if not size:
                out.append((0, None, None, None))
                continue
            own_ids, at, own = np.unique(ids, return_inverse=True, return_counts=True)
            losses = []
            words_target = n_target - size * good
            for counts, without, scale in ((target, good, 1.0), (total, False, words_target / n)):
                c = (counts[own_ids] - own if without else counts[own_ids])[at] * scale
                single, pair = c[:size], c[size:]
                p = (single + ALPHA) / (words_target + ALPHA * vocabulary)
                p[1:] = (pair + MU * p[1:]) / (single[:-1] + MU)
                losses.append(-float(np.log(p).sum()) / size)
            out.append((size, *losses, losses[1] - losses[0]))
        return out


def _message(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names=names)


def _chunk_of(ids: pa.Table, good: pa.Table, space: Space) -> Chunk:
    wanted = set(good.column("doc_id").to_pylist())
    return Chunk([t.as_py() or "" for t in ids.column("text")], [x in wanted for x in ids.column("doc_id").to_pylist()], space)


def _answer(rows: list[tuple], chunks: int) -> list[tuple]:
    """A part's answers to all chunks, from their messages."""
    if not rows:
        return []
    part = rows[0][1]
    grams = [np.frombuffer(r[2], np.uint32) for r in rows]
    sizes = [len(g) for g in grams]
    own, at = np.unique(np.concatenate(grams), return_inverse=True)
    weight = lambda k: np.bincount(at, np.concatenate([unsqueezed(r[k], n) for r, n in zip(rows, sizes, strict=True)]), len(own)).astype(np.int64)
    total, target = weight(3), weight(4)
    held = np.bincount(at, minlength=len(own))
    sums = (int(total.sum()), int(target.sum()), len(own)) if rows[0][5] else (0, 0, 0)  # pairs' parts have no words
    out, seen, start = [], set(), 0
    for r, size in zip(rows, sizes, strict=True):
        mine = at[start : start + size]
        start += size
        mine = mine[held[mine] > 1]
        out.append((r[0], part, own[mine].tobytes(), squeezed(total[mine]), squeezed(target[mine]), *sums))
        seen.add(r[0])
    if sums[0]:
        out += [(c, part, b"", b"", b"", *sums) for c in range(chunks) if c not in seen]
    return out


def score(docs: DataFrame, labels: DataFrame, chunk_bytes: int = CHUNK_BYTES, part_grams: int = PART_GRAMS) -> DataFrame:
    """docs with n_words, target_loss, background_loss (per word, in nats) and score, their difference."""
    ship(docs.sparkSession)
    sizes = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words")).first()
    chunks = max(1, -(-(sizes["bytes"] or 0) // chunk_bytes))
    parts = max(1, -(-(sizes["words"] or 0) // part_grams))
    space = Space(max(1, parts // 8), parts)
    # a chunk and a part are each a task's work
    tasks = min(chunks, 20_000)

    chunk, held = free_names(docs, "chunk", "row")
    dealt = lambda key: F.pmod(key, F.lit(chunks)).alias(chunk)
    by_id = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit("")), F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))
    rest = [f for f in docs.schema.fields if f.name.lower() not in ADDED]
    rows = docs.select(dealt(by_id), "doc_id", "text", F.struct(*[docs[f.name] for f in rest if f.name.lower() not in ("doc_id", "text")] or [F.lit(0).alias("none")]).alias(held)).repartition(tasks, chunk)
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.select(dealt(F.xxhash64(F.col("doc_id").cast(docs.schema["doc_id"].dataType))), "doc_id")

    def count(texts: pa.Table, marked: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_batches([_message([])])
        own = _chunk_of(texts, marked, space)
        part = own.grams >> 32
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, int)
        number, out = texts.column(chunk)[0].as_py(), []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=False):
            p = int(part[a])
            out.append((number, p, (own.grams[a:b] & 0xFFFFFFFF).astype(np.uint32).tobytes(), squeezed(own.total[a:b]), squeezed(own.target[a:b]), int(p < space.words), 0, 0))
        return pa.Table.from_batches([_message(out)])

    def add(batches):
        waiting: dict[int, list[tuple]] = {}
        for batch in batches:  # sorted by part: an earlier one is whole
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] not in waiting:
                    for done in list(waiting):
                        yield from _sliced(_answer(waiting.pop(done), chunks))
                waiting.setdefault(row[1], []).append(row)
        for done in list(waiting):
            yield from _sliced(_answer(waiting.pop(done), chunks))

    def finish(key, texts: pa.Table, notes: pa.Table) -> pa.Table:
        is_label = np.array([x is not None for x in notes.column("doc_id").to_pylist()], bool)
        own = _chunk_of(texts, notes.filter(pa.array(is_label)), space)
        total, target = own.total.copy(), own.target.copy()
        sums = np.zeros(3, np.int64)
        for row in notes.filter(pa.array(~is_label)).to_pylist():
            at = np.searchsorted(own.grams, (row["part"] << 32) + np.frombuffer(row["grams"], np.uint32).astype(np.int64))
            total[at], target[at] = unsqueezed(row["total"], len(at)), unsqueezed(row["target"], len(at))
            sums += row["words"], row["target_words"], row["vocabulary"]
        found = own.scores(total, target, *sums.tolist())
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        arrays = [texts.column("doc_id"), texts.column("text"), texts.column(held), pa.array(columns[0], pa.int64()), *(pa.array(x, pa.float64()) for x in columns[1:])]
        return pa.Table.from_arrays(arrays, names=["doc_id", "text", held, *ADDED])

    sent = rows.groupBy(chunk).cogroup(good.groupBy(chunk)).applyInArrow(count, MESSAGE)
    answers = sent.repartition(min(space.words + space.pairs, 20_000), "part").sortWithinPartitions("part").mapInArrow(add, MESSAGE)
    notes = answers.withColumnRenamed("chunk", chunk).withColumn("doc_id", F.lit(None).cast("long"))
    notes = notes.unionByName(good.withColumn("doc_id", F.col("doc_id").cast("long")), allowMissingColumns=True)
    schema = T.StructType([*(rows.schema[n] for n in ("doc_id", "text", held)), T.StructField("n_words", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ADDED[1:])])
    done = rows.groupBy(chunk).cogroup(notes.groupBy(chunk)).applyInArrow(finish, schema)
    return done.select(*[F.col(f.name) if f.name.lower() in ("doc_id", "text") else F.col(held)[f.name].alias(f.name) for f in rest], *ADDED)


def _sliced(rows: list[tuple]):
    for start in range(0, len(rows), 64):  # a part's answers are many megabytes
        yield _message(rows[start : start + 64])


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, x) for x in ("documents", "labels"))
    return score(docs.select("doc_id", "text"), labels).drop("text")


QUERIES = {"op10_cross_entropy_difference": op10_cross_entropy_difference}
#: SQL over every pair of words of every document takes too long; the tests count with dictionaries and compare.
ORACLES: dict[str, str] = {}
