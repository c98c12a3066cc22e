"""Leiden communities (Traag, Waltman and van Eck, 2019) at any size: local moving, refinement, contraction, level by level.

The quality is the configuration model's with a resolution: weight inside communities, less resolution times what
chance would give. A level moves nodes to the neighbouring community that gains most, splits every community into
connected parts, and makes each part a node of the next level, which starts with the communities found so far.

While a graph has more links than one task takes, a level is DataFrames. In a round of moving, half of the nodes, drawn anew
by hash each time, look at their neighbours' communities; only nodes whose neighbours have moved since they last looked
stay on the frontier, and a round joins the frontier's links, not all. Parts come from each node's best link inside its
community: what these links connect is a part, so parts at least halve a community's nodes, and a part is connected
whatever moved at the same time. Before nodes move, those that are linked to one other node only join it where that gains, which is
most of a graph like a tree. Once a level's graph fits, one task finishes with the published sequential form: a queue of nodes to look at,
and a refinement that merges single nodes into well-connected parts.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import traverse
from skein.shared import forget, ship, stored, summed_before

#: Rounds of moving in a level at most; what is left on the frontier moves in the next level.
ROUNDS = 12
#: Times that one task goes through all levels at most.
ITERATIONS = 10
EPS = 1e-12


class _Graph:
    """A level in one task: neighbours of n nodes as lists, and the nodes' strengths."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int):
        self.u, self.v, self.w, self.n = u, v, w, n
        self.strength = (np.bincount(u, w, n) + np.bincount(v, w, n)).tolist()
        real = u != v
        a, b, x = np.r_[u[real], v[real]], np.r_[v[real], u[real]], np.r_[w[real], w[real]]
        order = np.lexsort((b, a))
        self.near, self.weight = b[order].tolist(), x[order].tolist()
        self.begin = np.searchsorted(a[order], np.arange(n + 1)).tolist()

    def moved(self, at: list[int], total: float, resolution: float) -> list[int]:
        """Local moving from the communities ``at`` (numbers below n), by a queue."""
        n, begin, near, weight, strength = self.n, self.begin, self.near, self.weight, self.strength
        sums = np.bincount(at, strength, n).tolist()
        unused = sorted(set(range(n)) - set(at), reverse=True)
        size = np.bincount(at, minlength=n).tolist()
        queue, queued = deque(range(n)), bytearray(b"\x01") * n
        while queue:
            k = queue.popleft()
            queued[k] = 0
            own, s = at[k], strength[k]
            to: dict[int, float] = {}
            for j in range(begin[k], begin[k + 1]):
                c = at[near[j]]
                to[c] = to.get(c, 0.0) + weight[j]
            rate = resolution * s / total
            best, most = own, to.get(own, 0.0) - rate * (sums[own] - s)
            for c, x in to.items():
                gain = x - rate * sums[c]
                if c != own and gain > most + EPS:
                    best, most = c, gain
            if most < -EPS and size[own] > 1:
                best = unused.pop()  # alone is better
            if best != own:
                sums[own] -= s
                sums[best] += s
                size[own] -= 1
                size[best] += 1
                if not size[own]:
                    unused.append(own)
                at[k] = best
                for j in range(begin[k], begin[k + 1]):
                    b = near[j]
                    if at[b] != best and not queued[b]:
                        queued[b] = 1
                        queue.append(b)
        return at

    def parts(self, at: list[int], total: float, resolution: float) -> list[int]:
        """Each community's connected parts: single nodes join the part that gains most, where both hold to their community well."""
        n, begin, near, weight, strength = self.n, self.begin, self.near, self.weight, self.strength
        whole = np.bincount(at, strength, n).tolist()
        part, sums, size = list(range(n)), list(strength), [1] * n
        ties = [sum(weight[j] for j in range(begin[k], begin[k + 1]) if at[near[j]] == at[k]) for k in range(n)]
        well = lambda p, c: ties[p] >= resolution * sums[p] * (whole[c] - sums[p]) / total - EPS
        for k in range(n):
            c = at[k]
            if part[k] != k or size[k] != 1 or not well(k, c):
                continue
            to: dict[int, float] = {}
            for j in range(begin[k], begin[k + 1]):
                if at[near[j]] == c:
                    p = part[near[j]]
                    to[p] = to.get(p, 0.0) + weight[j]
            best, most = k, 0.0
            for p, x in to.items():
                gain = x - resolution * strength[k] * sums[p] / total
                if gain > most + EPS and well(p, c):
                    best, most = p, gain
            if best != k:
                part[k] = best
                size[best], size[k] = size[best] + 1, 0
                sums[best] += strength[k]
                ties[best] += ties[k] - 2 * to[best]
        return part

    def contracted(self, labels: np.ndarray, n: int) -> _Graph:
        low, high = np.minimum(labels[self.u], labels[self.v]), np.maximum(labels[self.u], labels[self.v])
        keys, inverse = np.unique(low * n + high, return_inverse=True)
        return _Graph(keys // n, keys % n, np.bincount(inverse, self.w), n)


def in_one_task(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, total: float, resolution: float, start: np.ndarray) -> np.ndarray:
    """Communities of n nodes with links u, v (loops too), weight ``total`` (both ways) over the whole graph, from a start membership.

    All levels are gone through again from what was found, until that is stable: no node gains by moving then."""
    base = _Graph(u, v, w, n)
    found = np.unique(start, return_inverse=True)[1]
    for _ in range(ITERATIONS):
        graph, at, mapped = base, found.tolist(), np.arange(n)
        while True:
            at = graph.moved(at, total, resolution)
            names, labels = np.unique(graph.parts(at, total, resolution), return_inverse=True)
            if len(names) == graph.n:
                break
            mapped = labels[mapped]
            at = np.unique(np.array(at)[names], return_inverse=True)[1].tolist()
            graph = graph.contracted(labels, len(names))
        before, found = found, np.unique(np.array(at, np.int64)[mapped], return_inverse=True)[1]
        if len(set(zip(before.tolist(), found.tolist(), strict=True))) == len(set(found.tolist())) == len(set(before.tolist())):
            break
    return connected_parts(u, v, found)


def connected_parts(u: np.ndarray, v: np.ndarray, membership: np.ndarray) -> np.ndarray:
    """The same communities, each split where its members aren't connected by links inside it."""
    parent = np.arange(len(membership))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        if membership[a] == membership[b]:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return np.array([find(k) for k in range(len(membership))], np.int64)


def whole_group(total: float, resolution: float):
    """A function of one group's rows (u, v, w, u_start, v_start) to (id, leader); equal starts are one community to begin with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([rows.u, rows.v]), return_inverse=True)
        u, v = at[: len(rows)], at[len(rows) :]
        start = np.arange(len(names), dtype=np.int64)
        starts = pd.concat([rows.u_start, rows.v_start], ignore_index=True)
        codes = pd.factorize(starts)[0]  # -1: none
        start[at[codes >= 0]] = codes[codes >= 0] + len(names)
        found = in_one_task(u, v, rows.w.to_numpy(), len(names), total, resolution, start)
        return pd.DataFrame({"id": names, "leader": names[found]})

    return run


def merged(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, total: float) -> np.ndarray:
    """Communities of n nodes by merging, from a heap of gains in modularity: the pair that gains most first, the smaller numbers among equals."""
    strength = (np.bincount(u, w, n) + np.bincount(v, w, n)).tolist()
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True):
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + x
    into, version = list(range(n)), [0] * n
    gain = lambda a, b: near[a][b] - strength[a] * strength[b] / total
    heap = [(-gain(a, b), a, b, 0, 0) for a in range(n) for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        less, a, b, va, vb = heapq.heappop(heap)
        if -less <= EPS:
            break
        if version[a] != va or version[b] != vb:
            continue  # one of the two has changed since
        into[b], version[b] = a, -1
        del near[a][b], near[b][a]
        for c, x in near[b].items():
            del near[c][b]
            near[a][c] = near[c][a] = near[a].get(c, 0.0) + x
        near[b] = {}
        strength[a] += strength[b]
        version[a] += 1
        for c in near[a]:
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (-gain(x, y), x, y, version[x], version[y]))
    for k in range(n):  # what a node was merged into has a smaller number or was merged before
        root = k
        while into[root] != root:
            root = into[root]
        into[k] = root
    return np.array(into, np.int64)


def merged_group(total: float):
    """A function of one group's rows (u, v, w) to (point, leader) by greedy merging."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([rows.u, rows.v]), return_inverse=True)
        found = merged(at[: len(rows)], at[len(rows) :], rows.w.to_numpy(), len(names), total)
        return pd.DataFrame({"point": names, "leader": names[found]})

    return run


def _moving(pairs: DataFrame, at: DataFrame, total: float, resolution: float, level: int) -> DataFrame:
    """at (id, s, c) after rounds of local moving along pairs (u, v, w), both ways and without loops."""
    active = None  # all
    for k in range(ROUNDS):
        # tables of their own before joins, so that a large community's rows can be split
        sums = stored(at.groupBy("c").agg(F.sum("s").alias("whole"), F.count("*").alias("n")), "sums")
        turn = F.pmod(F.xxhash64("id", F.lit(level * ROUNDS + k)), F.lit(2)) == 0
        looking = at.filter(turn) if active is None else at.filter(turn).join(active, "id", "left_semi")
        looking = looking.select(F.col("id").alias("u"), "s", F.col("c").alias("mine"))
        seen = pairs.join(looking, "u").join(at.select(F.col("id").alias("v"), "c"), "v").select("u", "s", "mine", "c", "w")
        staying = looking.select("u", "s", "mine", F.col("mine").alias("c"), F.lit(0.0).alias("w"))
        near = seen.union(staying).groupBy("u", "s", "mine", "c").agg(F.sum("w").alias("to")).join(sums, "c")
        own = F.col("c") == F.col("mine")
        gain = F.col("to") - F.lit(resolution) * F.col("s") * (F.col("whole") - F.when(own, F.col("s")).otherwise(0.0)) / F.lit(total)
        choice = near.withColumn("gain", gain).groupBy("u").agg(
            F.max(F.struct("gain", "c", "n")).alias("best"), F.max(F.when(own, F.col("gain"))).alias("stay"), F.max(F.when(own, F.col("n"))).alias("n_own"), F.first("mine").alias("mine")
        )
        # of two single nodes, one moves to the other
        swap = (F.col("n_own") == 1) & (F.col("best.n") == 1) & (F.col("best.c") > F.col("mine"))
        moves = choice.filter((F.col("best.gain") > F.col("stay") + EPS) & ~swap).select(F.col("u").alias("id"), F.col("best.c").alias("new"))
        moves = stored(moves, "moves")
        after = stored(at.join(moves, "id", "left").select("id", "s", F.coalesce("new", "c").alias("c")), "at")
        # who looks next: neighbours of those that moved, and those whose turn it wasn't
        waiting = at.filter(~turn) if active is None else at.filter(~turn).join(active, "id", "left_semi")
        touched = pairs.join(moves.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id"))
        next_active = stored(touched.union(waiting.select("id")).distinct(), "frontier")
        old = [t for t in (active, sums, moves) if t is not None]
        at, active = after, next_active
        done = active.isEmpty()
        forget(*old)
        if done:
            break
    return at


def _joined_parts(pairs: DataFrame, at: DataFrame, total: float, resolution: float, one_task: int) -> DataFrame:
    """(id, part) of the nodes whose best link inside their community joins them to others."""
    a = at.select(F.col("id").alias("u"), F.col("s").alias("su"), F.col("c").alias("cu"))
    b = at.select(F.col("id").alias("v"), F.col("s").alias("sv"), F.col("c").alias("cv"))
    gain = F.col("w") - F.lit(resolution) * F.col("su") * F.col("sv") / F.lit(total)
    inside = pairs.join(a, "u").join(b, "v").filter("cu = cv").withColumn("gain", gain).filter("gain > 0")
    best = inside.groupBy("u").agg(F.max(F.struct("gain", "v"))["v"].alias("v"))
    links = stored(best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(1.0).alias("w")).distinct(), "best_links")
    return stored(traverse.ranked_components(links, one_task).select("id", F.col("component").alias("part")), "parts")


def _joining_hosts(links: DataFrame, at: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, part) of the nodes linked to one other node, their host, that gain by joining it; their only other choice is to be alone.

    A host takes them one by one, those with most weight for their strength first, as long as the sum of the host and those
    before leaves a gain. So after the first that doesn't gain none does, and none that joined gains by leaving."""
    _, ends = traverse.folded(links.filter("u <> v AND w > 0"))
    hosts = at.join(ends.select(F.col("host").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("host"), F.col("s").alias("host_s"))
    ends = ends.join(at.select("id", "s"), "id").join(hosts, "host")
    ends = stored(ends.select("host", "id", "w", "s", "host_s", (F.col("s") / F.col("w")).alias("load")), "ends")
    gain = F.col("w") - F.lit(resolution) * F.col("s") * (F.col("host_s") + F.col("before")) / F.lit(total)
    done = stored(summed_before(ends, "before", "s", "host", "load", "id").filter(gain > EPS).select("id", F.col("host").alias("part")), "joining")
    forget(ends)
    return done


def _contracted(links: DataFrame, at: DataFrame, member: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links, at and member of the next level, after nodes became (id, part) of ``joined``; a part has the community of the node it is named by."""
    to = lambda end, name: joined.select(F.col("id").alias(end), F.col("part").alias(name))
    ends = links.join(to("u", "pu"), "u", "left").join(to("v", "pv"), "v", "left").select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"), "w")
    smaller = stored(ends.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w")), "contracted")
    named = at.join(joined, "id", "left").withColumn("point", F.coalesce("part", "id"))
    after = stored(named.groupBy("point").agg(F.sum("s").alias("s"), F.max(F.when(F.col("id") == F.col("point"), F.col("c"))).alias("c")).withColumnRenamed("point", "id"), "at")
    return smaller, after, stored(member.join(to("point", "part"), "point", "left").select("id", F.coalesce("part", "point").alias("point")), "points")


def in_levels(links: DataFrame, start: DataFrame, total: float, resolution: float, one_task: int) -> DataFrame:
    """(id, leader) of links (u, v, w), from start (id, c): levels of DataFrames until one task can finish. A level joins nodes to
    the only one they are linked to, as often as that takes a tenth of the links away, and moves nodes otherwise."""
    ship(links.sparkSession)
    strength = links.select(F.explode(F.array("u", "v")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("s"))
    at = stored(strength.join(start, "id", "left").select("id", "s", F.coalesce("c", "id").alias("c")), "at")
    member = stored(at.select("id", F.col("id").alias("point")), "points")
    base, n, level, hanging = links, links.count(), 0, True
    while n > one_task:
        if hanging:
            joined = _joining_hosts(links, at, total, resolution)
        else:
            pairs = stored(traverse.both_ways(links).filter("u <> v"), "pairs")
            at = _moving(pairs, at, total, resolution, level)
            joined = _joined_parts(pairs, at, total, resolution, one_task)
            forget(pairs)
            level += 1
        if joined.isEmpty():
            if not hanging:
                break
            hanging = False
            continue
        old = [at, member, joined, *([links] if links is not base else [])]
        links, at, member = _contracted(links, at, member, joined)
        forget(*old)
        before, n = n, links.count()
        hanging = not hanging or 10 * n <= 9 * before
    if n <= one_task:
        c = lambda end: at.select(F.col("id").alias(end), F.col("c").alias(f"{end}_start"))
        rows = links.join(c("u"), "u").join(c("v"), "v").select(F.lit(True).alias("one"), "u", "v", "w", "u_start", "v_start")
        found = rows.groupBy("one").applyInPandas(whole_group(total, resolution), "id string, leader string")
        return member.join(stored(found.select(F.col("id").alias("point"), "leader"), "finished"), "point").select("id", "leader")
    # links inside communities connect what is one community in the end
    found = member.join(at.select(F.col("id").alias("point"), "c"), "point").select("id", "c")
    found = stored(found, "found")
    a, b = (found.select(F.col("id").alias(e), F.col("c").alias(f"c{e}")) for e in ("u", "v"))
    inside = base.join(a, "u").join(b, "v").filter("cu = cv").select("u", "v", "w")
    parts = traverse.ranked_components(inside, one_task).select("id", "component")
    return found.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("leader"))
