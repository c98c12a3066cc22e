"""Communities at two resolutions by the Leiden method, which ``leiden`` has at any size.

The quality never gains from joining what isn't connected, so components are independent given the whole graph's
weight, and each is one group of a grouped map; one beyond ONE_TASK_LINKS is contracted by DataFrames until it fits."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import leiden, traverse
from skein.shared import forget, numbered, ship, stored

FINE, COARSE = 0.6, 0.15
LARGE_GRAPH = 5000
ONE_TASK_LINKS = 500_000
PALETTE = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac")
log = logging.getLogger("skein")


def initial_membership(ids: DataFrame, previous: DataFrame) -> DataFrame:
    """(id, start): an earlier community stays; new ids get numbers after the largest, in order of id."""
    top = previous.agg(F.max("community")).first()[0]
    known = ids.select("id").distinct().join(previous.select("id", F.col("community").cast("long").alias("start")), "id", "left")
    old, new = known.filter("start is not null"), known.filter("start is null").select("id")
    base = (top if top is not None else -1) + 1
    return old.unionByName(numbered(new, "place", "id").select("id", (F.lit(base) + F.col("place")).alias("start")))


class Links:
    """Collapsed links (u, v, w) among nodes, and what partitions of them share: their weight, nodes without links, the nodes that
    have one link only, and components. Up to one_task links, or for resolutions beyond 1, no node is taken off."""

    def __init__(self, nodes: DataFrame, links: DataFrame, one_task: int = ONE_TASK_LINKS, resolution: float = FINE):
        ship(links.sparkSession)
        self.n, weight = links.agg(F.count("*"), F.sum("w")).first()
        self.total = 2.0 * (weight or 0.0) or 1.0
        self.folded = self.n > one_task and resolution <= 1
        links = links.select("u", "v", "w")
        if self.folded:
            # a node with one link gains by joining its host whatever else is there, so it is a loop of its host from the start
            known = stored(traverse.not_leaves(links, nodes), "linked")
            self.alone = known.filter("n = 0").select("id")
            self.core, self.leaves = traverse.folded(links, known=known)
            self.held = stored(self.leaves.groupBy("host").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("id").alias("least")), "held")
            loops = self.held.select(F.col("host").alias("u"), F.col("host").alias("v"), "w")
            self.rows = stored(self.core.union(loops).groupBy("u", "v").agg(F.sum("w").alias("w")), "core")
        else:
            self.rows = self.core = links
            self.leaves = links.filter("false").select(F.col("u").alias("id"), F.col("v").alias("host"), "w")
            self.held = self.leaves.select("host", "w", F.lit(0).cast("long").alias("n"), F.col("id").alias("least"))
            ends = links.select(F.explode(F.array("u", "v")).alias("id"))
            self.alone = stored(nodes.select("id").distinct().join(ends, "id", "left_anti"), "alone")
        # loops connect nothing
        self.components = stored(traverse.ranked_components(self.rows.filter("u <> v")), "components")

    def links(self) -> DataFrame:
        """(u, v, w, leaf): all links again, and whether u has no other."""
        leaves = self.leaves.select(F.col("id").alias("u"), F.col("host").alias("v"), "w", F.lit(True).alias("leaf"))
        return self.core.select("u", "v", "w", F.lit(False).alias("leaf")).union(leaves)

    def whole(self, member: DataFrame) -> DataFrame:
        """member (id, ...) of the nodes that aren't leaves, and of leaves as their hosts'."""
        rest = [c for c in member.columns if c != "id"]
        return member.union(self.leaves.select("id", "host").join(member.withColumnRenamed("id", "host"), "host").select("id", *rest))


def partition(nodes: DataFrame, links: DataFrame, resolution: float, previous: DataFrame | None = None, one_task: int = ONE_TASK_LINKS, shared: Links | None = None) -> DataFrame:
    """(id, community): numbers by size, then smallest id; with ``previous`` (id, community) a community keeps
    the number that most of its members had, where no larger one has it. ``shared`` is what other partitions of these links share."""
    have = shared or Links(nodes, links, one_task, resolution)
    return have.whole(without_leaves(have, resolution, previous, one_task))


def without_leaves(have: Links, resolution: float, previous: DataFrame | None = None, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(id, community) of a partition, but for the leaves, which are in their hosts'."""
    rows = have.rows.join(have.components.select(F.col("id").alias("u"), "component"), "u", "left").withColumn("component", F.coalesce("component", "u"))
    for end in ("u", "v"):
        if previous is None:
            rows = rows.withColumn(f"{end}_start", F.lit(None).cast("string"))
        else:
            rows = rows.join(previous.select(F.col("id").alias(end), F.col("community").cast("string").alias(f"{end}_start")), end, "left")
    rows = stored(rows, "clustered")
    sizes = stored(rows.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    big = sizes.filter(F.col("n") > one_task).select("component")
    small = rows.join(big, "component", "left_anti").select("component", "u", "v", "w", "u_start", "v_start")
    found = small.groupBy("component").applyInPandas(leiden.whole_group(have.total, resolution), "id string, leader string")
    if not big.isEmpty():
        large = stored(rows.join(big, "component", "left_semi"), "large")
        # a community of the last time starts under its smallest id in each component
        known = large.select("component", F.explode(F.array(*[F.struct(F.col(e).alias("id"), F.col(f"{e}_start").alias("start")) for e in ("u", "v")])).alias("x")).select("component", "x.*").filter("start IS NOT NULL").distinct()
        firsts = stored(known.groupBy("component", "start").agg(F.min("id").alias("c")), "starts")
        start = stored(known.join(firsts, ["component", "start"]).select("id", "c"), "start")
        found = found.union(leiden.in_levels(large.select("u", "v", "w"), start, have.total, resolution, one_task))
    found = stored(found.union(have.alone.select("id", F.col("id").alias("leader"))), "members")
    # a leaf counts with its host, so that sizes and smallest ids need no row of its own
    with_leaves = found.join(have.held.select(F.col("host").alias("id"), "n", "least"), "id", "left")
    sizes = with_leaves.groupBy("leader").agg(F.sum(F.coalesce("n", F.lit(0)) + 1).alias("n"), F.min(F.least("id", "least")).alias("least"))
    numbers = stored(_numbers(sizes, have.whole(found), previous), "numbers")
    return stored(found.join(numbers, "leader").select("id", "community"), "communities")


def _numbers(sizes: DataFrame, member: DataFrame, previous: DataFrame | None) -> DataFrame:
    """(leader, community) of sizes (leader, n, least)."""
    if previous is None:
        return numbered(sizes, "community", F.desc("n"), "least").select("leader", F.col("community").cast("long").alias("community"))
    votes = member.join(previous.select("id", F.col("community").cast("long").alias("old")), "id").groupBy("leader", "old").agg(F.count("*").alias("votes"))
    first = F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("votes"), "old"))
    wish = votes.withColumn("place", first).filter("place = 1").select("leader", "old", "votes")
    claim = F.row_number().over(Window.partitionBy("old").orderBy(F.desc("votes"), "leader"))
    kept = wish.withColumn("place", claim).filter("place = 1").select("leader", F.col("old").alias("community"))
    top = previous.agg(F.max("community")).first()[0]
    others = numbered(sizes.join(kept, "leader", "left_anti"), "place", F.desc("n"), "least").withColumn("community", F.col("place") + F.lit((top if top is not None else -1) + 1))
    return kept.union(others.select("leader", F.col("community").cast("long")))


def _numbered(member: DataFrame) -> DataFrame:
    sizes = member.groupBy("leader").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    return member.join(_numbers(sizes, member, None), "leader").select("id", "community")


def modularity(links: DataFrame, member: DataFrame, resolution: float = 1.0) -> float:
    """Weight inside communities over all, less resolution times the share that chance would give."""
    a, b = (member.select(F.col("id").alias(e), F.col("community").alias(f"c{e}")) for e in ("u", "v"))
    return quality(links.join(a, "u").join(b, "v").groupBy("cu", "cv").agg(F.sum("w").alias("w")), resolution)


def quality(between: DataFrame, resolution: float) -> float:
    """Modularity from the links between communities (cu, cv, w)."""
    same = F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)
    ends = between.select(F.col("cu").alias("c"), "w", same.alias("inside")).union(between.select("cv", "w", F.lit(0.0)))
    per = ends.groupBy("c").agg(F.sum("w").alias("s"), F.sum("inside").alias("inside"))
    inside, both, squares = per.agg(F.sum("inside"), F.sum("s"), F.sum(F.col("s") * F.col("s"))).first()
    return 2 * inside / both - resolution * squares / both**2 if both else 0.0


def torn(member: DataFrame, placed: DataFrame) -> DataFrame:
    """(community, parts) of communities that their links leave in parts, from member (id, community) and links (u, v, leaf, cu, cv)
    between members. A community has as many parts as members, less the links of a spanning forest: the inner link of every leaf,
    and those between the other nodes of each component."""
    inside = placed.filter("cu = cv")
    core = stored(inside.filter("NOT leaf").select("u", "v", "cu"), "inside")
    parts = traverse.ranked_components(core)
    where = core.select(F.explode(F.array("u", "v")).alias("id"), F.col("cu").alias("community")).distinct()
    forest = parts.join(where, "id").groupBy("community").agg((F.count("*") - F.count_distinct("component")).alias("less"))
    leaves = inside.filter("leaf").groupBy(F.col("cu").alias("community")).agg(F.count("*").alias("less"))
    less = forest.union(leaves).groupBy("community").agg(F.sum("less").alias("less"))
    sizes = member.groupBy("community").agg(F.count("*").alias("n")).join(less, "community", "left")
    return sizes.select("community", (F.col("n") - F.coalesce("less", F.lit(0))).alias("parts")).filter("parts > 1")


def cluster(nodes: DataFrame, edges: DataFrame, fine: float = FINE, coarse: float = COARSE) -> DataFrame:
    """nodes with community and community_group; warm start from these columns where nodes have them. Should the
    Leiden method fail, greedy merging gives both."""
    ids = [c for c in nodes.columns if c not in ("community", "community_group")]
    n = nodes.count()
    if n > LARGE_GRAPH:
        log.warning("%d nodes: clustering anew at every build may be slow", n)
    if n == 0:
        return nodes
    links = stored(G.collapse_edges(edges), "links")
    out = nodes.select(*ids)
    try:
        have = Links(nodes, links, resolution=max(fine, coarse))
        for name, resolution in (("community", fine), ("community_group", coarse)):
            earlier = nodes.filter(F.col(name).isNotNull()).select("id", F.col(name).alias("community")) if name in nodes.columns else None
            out = out.join(partition(nodes, links, resolution, earlier, shared=have).withColumnRenamed("community", name), "id", "left")
    except Exception as error:
        log.warning("no Leiden communities (%s): merging greedily", error)
        member = greedy_modularity(nodes, links)
        out = nodes.select(*ids).join(member.withColumn("community_group", F.col("community")), "id", "left")
    return out


def greedy_modularity(nodes: DataFrame, links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(id, community): communities of one node each, merged while that raises modularity, the pair that gains most first
    (Clauset, Newman and Moore, 2004). Beyond one_task links, rounds first merge all pairs that are each other's best."""
    ship(links.sparkSession)
    total = 2.0 * (links.agg(F.sum("w")).first()[0] or 0.0) or 1.0
    strength = links.select(F.explode(F.array("u", "v")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("s"))
    at = stored(strength, "strength")
    member = stored(at.select("id", F.col("id").alias("point")), "points")
    left = stored(links.select("u", "v", "w"), "links")
    while left.count() > one_task:
        a, b = (at.select(F.col("id").alias(e), F.col("s").alias(f"s{e}")) for e in ("u", "v"))
        gain = F.col("w") - F.col("su") * F.col("sv") / F.lit(total)
        gains = traverse.both_ways(left).filter("u <> v").join(a, "u").join(b, "v").withColumn("gain", gain).filter("gain > 1e-12")
        # ties go to the link whose ends come first, which is the same seen from either end
        rank = F.struct("gain", F.xxhash64(F.least("u", "v"), F.greatest("u", "v")), "v")
        best = stored(gains.groupBy("u").agg(F.max(rank)["v"].alias("v")), "best")
        mutual = best.join(best.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"]).filter("u < v")
        into = stored(mutual.select(F.col("v").alias("id"), F.col("u").alias("into")), "merged")
        if into.isEmpty():
            break
        to = lambda end: into.select(F.col("id").alias(end), F.col("into").alias(f"to_{end}"))  # noqa: E731, B023
        ends = left.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("to_u", "u").alias("a"), F.coalesce("to_v", "v").alias("b"), "w")
        smaller = stored(ends.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w")), "links")
        at2 = stored(at.join(into, "id", "left").groupBy(F.coalesce("into", "id").alias("id")).agg(F.sum("s").alias("s")), "strength")
        member2 = stored(member.join(into.withColumnRenamed("id", "point"), "point", "left").select("id", F.coalesce("into", "point").alias("point")), "points")
        forget(left, at, member, best, into)
        left, at, member = smaller, at2, member2
    if left.count() <= one_task:
        found = left.withColumn("one", F.lit(True)).groupBy("one").applyInPandas(leiden.merged_group(total), "point string, leader string")
        member = member.join(stored(found, "merged"), "point").select("id", "leader")
    else:
        member = member.select("id", F.col("point").alias("leader"))
    alone = nodes.select("id").distinct().join(member.select("id"), "id", "left_anti")
    return _numbered(stored(member.union(alone.select("id", F.col("id").alias("leader"))), "members"))


def representatives(nodes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """(community, label, n_members, color, top_labels): the best connected member names a community."""
    ranked = nodes.select("id", "label", "seq", F.coalesce("community", F.lit(0)).cast("long").alias("community")).join(G.undirected_degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    # the k best of each community come by a window that keeps only k rows a task
    best = traverse.first_k(ranked, "community", k, F.desc("degree"), "seq")
    top = best.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("place", "label"))).alias("t"))
    sizes = numbered(ranked.groupBy("community").agg(F.count("*").alias("n_members")), "index", "community")
    colors = F.array(*[F.lit(c) for c in PALETTE])
    labels = F.transform("t", lambda x: x["label"])
    return top.join(sizes, "community").select("community", F.get(labels, 0).alias("label"), "n_members", F.get(colors, (F.col("index") % len(PALETTE)).cast("int")).alias("color"), labels.alias("top_labels"))
