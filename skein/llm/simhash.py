"""SimHash near-dedup: exact comparison of fingerprints in tiles, with numpy.

A text's fingerprint has a bit set where over half of its shingles' hashes have it; ``Prints`` says how many
words a shingle has, how many times 64 bits a fingerprint, whether repeats count, and what is linked:

* ``Prints()``: three words, 64 bits, links at 3 or fewer differing bits.
* ``Prints.similar(0.8)``: five words, 256 bits, sets of shingles. Bits differ as often as the angle between
  the sets is of half a circle, so a cosine of 0.8 or more is 52 or fewer differing bits. Sets with a Jaccard of
  0.8 have a cosine of 0.889 at least, so nearly all of them are within (the README has the measured share).
  A cosine of 0.8 also needs sizes within 0.64 of each other, which rules out most pairs of texts.

Equal fingerprints are one row from then on. Rows are numbered in order of their population counts (of
all bits, then of halves and quarters), or of their sizes where sizes matter, and packed into tiles of so many. Only
pairs of tiles whose population counts, or sizes, come within reach are dealt out, each to a task of its
own. There sub-tiles are compared by exclusive-or and bit counts, and a pair of sub-tiles is left out where
the population counts of any blocks of bits add up to a difference beyond the radius, or the sizes
rule it out. So every pair within the radius is found, nothing is capped, and no group lies in one task.
A tile pair gives stars of the trees that its links make, not all pairs; components come from components.py.

What that costs: comparisons grow with the square of the number of different fingerprints, less what is left
out: some two thirds by population counts at radius 3, some seven tenths by sizes. Tiles grow with the input,
so that a fingerprint moves 64 times at most up to 64 million of them.

Defined cases: a null or empty text, or one of white space, has the fingerprint zero, which links
like any other of its size; fewer words than ``size`` are one shingle; a null doc_id takes part, and a
component's id is the smallest id that isn't null; repeated rows have equal results; other columns pass
through ``one_of_each``; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat
from math import acos, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import read_table, ship, written
from skein.llm.components import components
from skein.shared import numbered

SEED = 42
#: A tile holds a 64th of the rows, within these bounds (a layout: whatever they are, all pairs are compared).
TILE_FROM, TILE_TO = 1 << 13, 1 << 20
SUB_TILE = 256
#: Tasks for pairs of tiles.
MOST_TASKS = 20_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Prints:
    """Fingerprints of ``words`` times 64 bits over shingles of ``size`` words; links at ``radius`` or fewer differing bits and sizes within ``ratio``."""

    size: int = 3
    words: int = 1
    repeats: bool = True
    radius: int = 3
    ratio: float = 0.0

    @staticmethod
    def similar(cosine: float = 0.8, size: int = 5, words: int = 4) -> Prints:
        return Prints(size, words, False, int(64 * words * acos(cosine) / pi), cosine * cosine)

    @property
    def columns(self) -> list[str]:
        return [f"w{k}" for k in range(self.words)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8192):
        part = hashes[start : start + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def _other(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of each hash."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, kind: Prints = Prints()) -> tuple[np.ndarray, int]:  # noqa: B008
    """The unsigned 64-bit words of a text's fingerprint, and its number of shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(kind.words, np.uint64), 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(kind.size)), strict=False)) if len(words) >= kind.size else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    if not kind.repeats:
        hashes = np.unique(hashes)
    bits = [_bit_counts(_other(hashes, k) if k else hashes) * 2 > len(hashes) for k in range(kind.words)]
    return np.packbits(np.concatenate(bits), bitorder="little").view(np.uint64), len(hashes)


def fingerprints(docs: DataFrame, kind: Prints = Prints()) -> DataFrame:  # noqa: B008
    """(doc_id, text_hash, fp, n, w0, w1 ...) by row: fp names the fingerprint (64 bits: w0 itself), n is the number of shingles where sizes matter, else 0."""
    from xxhash import xxh64_intdigest

    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py() or "", kind) for t in batch.column(1)]
            prints = np.array([p for p, _ in found], np.uint64).reshape(len(found), kind.words)
            sizes = np.array([n if kind.ratio else 0 for _, n in found], np.int64)
            names = prints[:, 0] if kind.words == 1 and not kind.ratio else np.array([xxh64_intdigest(p.tobytes() + n.tobytes()) for p, n in zip(prints, sizes, strict=True)], np.uint64)
            longs = [names.view(np.int64), sizes, *prints.T.copy().view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, longs)], names=["doc_id", "text_hash", "fp", "n", *kind.columns])

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {id_type}, text_hash long, fp long, n long, " + ", ".join(f"{c} long" for c in kind.columns))


class _Sub:
    """A tile's rows (fp, n, words) with what bounds its sub-tiles: least and most of their sizes, and of the population counts of blocks of bits."""

    def __init__(self, rows: np.ndarray):
        self.names, self.sizes = rows[:, 0], rows[:, 1]
        self.prints = np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
        self.starts = np.arange(0, len(rows), SUB_TILE)
        pops = np.bitwise_count(self.prints.view(np.uint8)).astype(np.int16).reshape(len(rows), -1)
        edges = lambda x: (np.minimum.reduceat(x, self.starts), np.maximum.reduceat(x, self.starts))
        self.blocks = []
        while True:  # of 8 bits, 16, ... all
            self.blocks.append(edges(pops))
            if pops.shape[1] == 1:
                break
            pops = pops.reshape(len(rows), -1, 2).sum(axis=2, dtype=np.int16)
        self.size_edges = edges(self.sizes)

    def reachable(self, i: int, other: _Sub, kind: Prints) -> np.ndarray:
        """Of other's sub-tiles, those that may hold a link to this one's i-th."""
        least = np.zeros(len(other.starts), np.int64)
        for (low, high), (low2, high2) in zip(self.blocks, other.blocks, strict=True):
            apart = np.maximum(np.maximum(low2 - high[i], low[i] - high2), 0).sum(axis=1, dtype=np.int64)
            least = np.maximum(least, apart)
        (low, high), (low2, high2) = self.size_edges, other.size_edges
        return (least <= kind.radius) & (high[i] >= kind.ratio * low2) & (high2 >= kind.ratio * low[i])


def _near(a: _Sub, b: _Sub, i: slice, j: slice, kind: Prints) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a's slice i and b's slice j that are linked."""
    left, right = a.prints[i], b.prints[j]
    some = np.bitwise_count(left[:, 0][:, None] ^ right[:, 0][None])
    if kind.words > 1:  # the first 128 bits rule most out
        some += np.bitwise_count(left[:, 1][:, None] ^ right[:, 1][None])
    x, y = np.nonzero(some <= kind.radius)
    if kind.words > 1 and len(x):
        full = np.bitwise_count(left[x] ^ right[y]).sum(axis=1, dtype=np.int64)
        m, n = a.sizes[i][x], b.sizes[j][y]
        ok = (full <= kind.radius) & (np.minimum(m, n) >= kind.ratio * np.maximum(m, n))
        x, y = x[ok], y[ok]
    return x + i.start, y + j.start


def forest(a: np.ndarray, b: np.ndarray | None, kind: Prints = Prints()) -> tuple[list[tuple[int, int]], int, int]:  # noqa: B008
    """What the links between rows (fp, n, words) of two tiles, or inside one (b is None), connect: stars (name, its tree's root); pairs of sub-tiles compared and left out."""
    one, two = _Sub(a), _Sub(a if b is None else b)
    shift = 0 if b is None else len(a)
    parent = list(range(shift + len(two.names)))
    names = one.names if b is None else np.concatenate([one.names, two.names])
    touched = np.zeros(len(parent), bool)
    compared = left_out = 0

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def roots(x: np.ndarray) -> np.ndarray:
        own, at = np.unique(x, return_inverse=True)
        return np.array([find(k) for k in own.tolist()])[at]

    def joined(*parts: np.ndarray) -> bool:
        """Whether all of these rows are in one tree already."""
        return all(touched[p].all() for p in parts) and len({find(k) for p in parts for k in p.tolist()}) == 1

    for s, start in enumerate(one.starts.tolist()):
        i = slice(start, min(start + SUB_TILE, len(one.names)))
        may = one.reachable(s, two, kind)
        for t, other in enumerate(two.starts.tolist()):
            if b is None and t < s:
                continue
            if not may[t]:
                left_out += 1
                continue
            j = slice(other, min(other + SUB_TILE, len(two.names)))
            if joined(np.arange(i.start, i.stop), np.arange(j.start, j.stop) + shift):
                left_out += 1
                continue
            compared += 1
            x, y = _near(one, two, i, j, kind)
            y = y + shift
            if b is None and s == t:
                x, y = x[x < y], y[x < y]
            while len(x):
                rx = roots(x)
                apart = rx != roots(y)
                x, y, rx = x[apart], y[apart], rx[apart]
                for k in np.unique(rx, return_index=True)[1].tolist():
                    p, q = find(int(x[k])), find(int(y[k]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        touched[[x[k], y[k]]] = True
    at = np.flatnonzero(touched).tolist()
    return [(int(names[x]), int(names[r])) for x, r in zip(at, map(find, at), strict=True) if x != r], compared, left_out


def _level(kind: Prints) -> Column:
    """Linked rows are at most ``_reach`` apart here."""
    if kind.ratio:
        return F.when(F.col("n") > 0, F.floor(F.log("n") / F.lit(log(1 / kind.ratio) * (1 + 1e-9)))).otherwise(-9).cast("int")
    return sum((F.bit_count(c) for c in kind.columns[1:]), F.bit_count("w0"))


def _reach(kind: Prints) -> int:
    return 1 if kind.ratio else kind.radius


def tiles(prints: DataFrame, kind: Prints, rows: int) -> DataFrame:
    """(id, low, high, data): prints (fp, n, w0 ...) in order, packed ``rows`` at a time however many partitions there are, with the least and the largest level."""
    half, quarter = F.bit_count(F.shiftrightunsigned("w0", 32)), F.bit_count(F.col("w0").bitwiseAND(F.lit(0xFFFF0000FFFF)))
    order = ["n", "fp"] if kind.ratio else ["level", half, quarter, "fp"]
    placed = numbered(prints.withColumn("level", _level(kind)), "place", *order)
    dealt = placed.withColumn("id", F.floor(F.col("place") / rows)).repartition("id").sortWithinPartitions("id", "place")

    def cut(parts: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array(whole[:1, 0], pa.int64()), pa.array(whole[:1, 1], pa.int32()), pa.array(whole[-1:, 1], pa.int32()), pa.array([np.ascontiguousarray(whole[:, 2:]).tobytes()], pa.binary())],
            names=["id", "low", "high", "data"],
        )

    def pack(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            whole = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            for part in np.split(whole, np.flatnonzero(np.diff(whole[:, 0])) + 1):
                if held and len(part) and part[0, 0] != held[0][0, 0]:
                    yield cut(held)
                    held = []
                held += [part] if len(part) else []
        if held:
            yield cut(held)

    return written(dealt.select("id", "level", "fp", "n", *kind.columns).mapInArrow(pack, "id long, low int, high int, data binary"), "tiles")


def links(prints: DataFrame, kind: Prints = Prints(), tile: int | None = None) -> DataFrame:  # noqa: B008
    """(a, b): links among the distinct fingerprints of prints (fp, n, w0 ...) that connect all that are linked."""
    ship(prints.sparkSession)
    packed = tiles(prints, kind, tile or min(TILE_TO, max(TILE_FROM, prints.count() // 64)))
    reach = _reach(kind)
    own = packed.select("id", F.explode(F.sequence("low", "high")).alias("level"))
    near = packed.select(F.col("id").alias("other"), F.explode(F.sequence(F.col("low") - reach, F.col("high") + reach)).alias("level"))
    pairs = written(own.join(near, "level").filter("id <= other").select("id", "other").distinct(), "tile_pairs")
    one, two = packed.select("id", "data"), packed.select(F.col("id").alias("other"), F.col("data").alias("data2"))
    # one pair is a task's work: as many partitions as pairs, whatever their bytes
    dealt = pairs.join(one, "id").join(two, "other").repartition(max(1, min(MOST_TASKS, pairs.count())), "id", "other")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, data = (batch.column(c)[k].as_py() for c in ("id", "other")), (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64).reshape(-1, 2 + kind.words) for c in ("data", "data2"))
                same, (a, b) = len(set(ids)) == 1, data
                found = forest(a, None if same else b, kind)[0]
                yield pa.RecordBatch.from_arrays([pa.array([p[s] for p in found], pa.int64()) for s in (0, 1)], names=["a", "b"])

    return dealt.select("id", "other", "data", "data2").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, kind: Prints = Prints(), tile: int | None = None) -> DataFrame:  # noqa: B008
    """(doc_id, text_hash, fp, root, component_id) by row; root names a fingerprint of the row's component."""
    rows = written(fingerprints(docs, kind), "fingerprints")
    own = ["n", *kind.columns]
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in own]), "distinct")
    roots = written(components(links(prints.select("fp", *own), kind, tile)), "roots")
    placed = written(prints.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    # tables of their own, so that a join deals both sides out anew and a component of very many fingerprints can be split
    smallest = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    classes = written(placed.join(smallest, "root").select("fp", "root", "component_id"), "classes")
    return rows.select("doc_id", "text_hash", "fp").join(classes, "fp")


def one_of_each(docs: DataFrame, kind: Prints = Prints()) -> DataFrame:  # noqa: B008
    """docs with one document of each component: the smallest doc_id (an id beats null), then the smallest hash of its text."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keepers = grouped(docs, kind).groupBy("root").agg(F.min(rank).alias("r"))
    keepers = written(keepers.select("r.none", F.coalesce("r.doc_id", F.lit(0)).alias("id"), F.col("r.text_hash").alias("hash")).distinct(), "keepers")
    keys = {"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "hash": F.xxhash64(F.coalesce("text", F.lit("")))}
    held = docs.select(*[c.alias(f"_{k}") for k, c in keys.items()], F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    kept = held.join(keepers.select(*[F.col(k).alias(f"_{k}") for k in keys]), [f"_{k}" for k in keys], "left_semi")
    return kept.dropDuplicates([f"_{k}" for k in keys]).select("_row.*")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = grouped(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_components": op9_simhash_components}
#: SQL here has no XXH64; the tests compare all pairs by brute force.
ORACLES: dict[str, str] = {}
