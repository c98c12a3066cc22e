"""From a question to a ranked subgraph: seeds, components, Personalized PageRank, top k, context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import fuzzy
from skein.functions import text as X
from skein.operators.graph import collapse_edges
from skein.shared import forget, numbered, ship, stored

ALPHA = 0.85
TOLERANCE = 1e-6
MAX_ITERATIONS = 100
TOP_K = 20
#: Up to so many links in scope one task ranks them; beyond, every iteration is a distributed step.
ONE_TASK_LINKS = 500_000
ROUND = 10
#: So many lines of a context are sorted and put together at a time.
CHUNK = 10_000


def question_words(spark: SparkSession, question: str) -> DataFrame:
    return spark.createDataFrame([(question,)], "q string").select(F.explode(X.words(F.col("q"))).alias("word"))


def labelled(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("name", X.simple_label(F.col("label"))).filter(F.col("name") != "").select("name", "id", "seq")


def exact_seeds(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """(id) of all nodes whose label is a word of the question; words are few and go to every task."""
    return labelled(nodes).join(F.broadcast(words.withColumnRenamed("word", "name")), "name", "left_semi").select("id")


def fuzzy_seeds(nodes: DataFrame, words: DataFrame) -> DataFrame:
    long_words = words.filter(F.length("word") >= 4).withColumnRenamed("word", "name")
    near = fuzzy.in_reach(labelled(nodes), long_words)
    last = stored(near.groupBy("name").agg(F.max_by("id", "seq").alias("id"), F.min("seq").alias("seq")), "near")
    return fuzzy.best_symbols(long_words, last).select("id").distinct()


def seeds(nodes: DataFrame, words: DataFrame) -> DataFrame:
    found = exact_seeds(nodes, words)
    return fuzzy_seeds(nodes, words) if found.isEmpty() else found


def both_ways(links: DataFrame) -> DataFrame:
    """(u, v, w) for each direction; a self-loop once."""
    return links.select("u", "v", "w").union(links.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def _components_in_one_task(rows: pd.DataFrame) -> pd.DataFrame:
    """(id, component) by pointer jumping over arrays."""
    names, at = np.unique(np.concatenate([rows.u, rows.v]), return_inverse=True)
    u, v, label = at[: len(rows)], at[len(rows) :], np.arange(len(names))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            return pd.DataFrame({"id": names, "component": names[label]})
        label = new


def not_leaves(links: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, n) of ids with two links or more; with ``ids`` also of those among them that no link names, where n is 0."""
    # a self-loop names its node twice
    ends = links.select(F.explode(F.array("u", "v")).alias("id"), F.lit(1).alias("n"))
    every = ends if ids is None else ends.union(ids.select("id", F.lit(0)))
    return every.groupBy("id").agg(F.sum("n").alias("n")).filter("n <> 1")


def folded(links: DataFrame, keep: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(core, leaves): the links that are left without the nodes that have one link only, and these nodes as (id, host, rest of
    the link). Ids of ``keep`` are no leaves; of two nodes with one link between them the smaller is the host. ``known`` has
    what ``not_leaves`` gives, where that is at hand."""
    rest = [c for c in links.columns if c not in ("u", "v")]
    hosts = (not_leaves(links) if known is None else known).filter("n > 1").select("id")
    hosts = stored(hosts if keep is None else hosts.union(keep.select("id")).distinct(), "hosts")
    stays = lambda end: hosts.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_stays"))
    marked = stored(links.join(stays("u"), "u", "left").join(stays("v"), "v", "left"), "folded")
    forget(hosts)
    of_v = F.col("v_stays").isNotNull()
    core = marked.filter("u_stays AND v_stays").select("u", "v", *rest)
    leaves = marked.filter("u_stays IS NULL OR v_stays IS NULL").select(F.when(of_v, F.col("u")).otherwise(F.col("v")).alias("id"), F.when(of_v, F.col("v")).otherwise(F.col("u")).alias("host"), *rest)
    return core, leaves


def component_scope(links: DataFrame, seed_ids: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(id) of everything that a seed reaches: the members of the seeds' components. Beyond one_task links components
    take as many rounds as the logarithm of the graph asks for, not as its diameter."""
    inside = stored(ranked_components(links, one_task), "components")
    wanted = stored(inside.join(seed_ids.select("id").distinct(), "id", "left_semi").select("component").distinct(), "wanted")
    alone = seed_ids.select("id").distinct().join(inside.select("id"), "id", "left_anti")
    return inside.join(wanted, "component", "left_semi").select("id").union(alone)


def _ranked_in_one_task(iterations: int, tolerance: float):
    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([rows.u, rows.v]), return_inverse=True)
        n, u, v = len(names), at[: len(rows)], at[len(rows) :]
        w, teleport = np.maximum(rows.w.to_numpy(), 0.0), np.zeros(n)
        marked = rows.seed.to_numpy().astype(bool)
        teleport[u[marked]] = 1.0
        teleport /= max(teleport.sum(), 1.0)
        out = np.bincount(u, w, n)
        share, dangling = np.divide(w, out[u], out=np.zeros(len(w)), where=out[u] > 0), out == 0
        x = np.full(n, 1.0 / n)
        for _ in range(iterations):
            new = ALPHA * (np.bincount(v, x[u] * share, n) + x[dangling].sum() * teleport) + (1 - ALPHA) * teleport
            change, x = np.abs(new - x).sum(), new
            if change < n * tolerance:
                break
        else:
            x = x if tolerance <= 0 else np.ones(n)  # no convergence: all alike
        return pd.DataFrame({"id": names, "score": x})

    return rank


def pagerank(links: DataFrame, ids: DataFrame, seed_ids: DataFrame, iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(id, score): Personalized PageRank over weighted undirected links among ids; all 1.0 if it doesn't converge.

    A tolerance of 0 runs exactly ``iterations`` rounds."""
    ship(links.sparkSession)
    links = stored(links.select("u", "v", "w"), "inside")
    marks = seed_ids.select("id").distinct().withColumn("seed", F.lit(True))
    # nodes without links keep their place by a link of weight 0 to themselves
    alone = ids.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("w"))
    every = both_ways(links).union(alone)
    if every.count() <= one_task:
        rows = every.join(marks.withColumnRenamed("id", "u"), "u", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
        return rows.withColumn("scope", F.lit(True)).groupBy("scope").applyInPandas(_ranked_in_one_task(iterations, tolerance), "id string, score double")
    # A node with one link sends all it has to its host and gets its share of the host's score alone, so a host's leaves are one
    # sum, exactly, from the first round on: the rounds go over the other links. Seeds are no leaves, nor is what hands on nothing.
    core, leaves = folded(links, marks.select("id").union(links.filter("w <= 0").select(F.explode(F.array("u", "v")))))
    row = lambda table, u, w, leaf, n: table.select(F.col(u).alias("id"), w.alias("w"), F.lit(leaf).alias("leaf"), (w if n else F.lit(0.0)).alias("held_w"), F.lit(n).cast("long").alias("held_n"))
    zero, w = F.lit(0.0), F.col("w")
    parts = row(both_ways(core), "u", w, False, 0).union(row(ids, "id", zero, False, 0)).union(row(leaves, "host", w, False, 1)).union(row(leaves, "id", zero, True, 0))
    per = parts.groupBy("id").agg(F.sum("w").alias("out"), F.max("leaf").alias("leaf"), F.sum("held_w").alias("held_w"), F.sum("held_n").alias("held_n")).filter("NOT leaf").drop("leaf")
    per = stored(per.join(marks, "id", "left").withColumn("seed", F.coalesce("seed", F.lit(False))), "points")
    n, n_seeds = per.agg(F.count("*") + F.coalesce(F.sum("held_n"), F.lit(0)), F.sum(F.col("seed").cast("int"))).first()
    teleport = F.when(F.col("seed"), F.lit(1.0 / max(n_seeds or 0, 1))).otherwise(0.0)
    start = F.lit(1.0 / max(n, 1))
    points = per.select("id", "out", teleport.alias("t"), F.when(F.col("held_n") > 0, F.col("held_w") / F.col("out")).otherwise(0.0).alias("held_p"), "held_n")
    # a table of its own before the join, so that a host which very many links name can be split
    shares = stored(both_ways(core).filter("w > 0").join(per.select(F.col("id").alias("u"), "out"), "u").select("u", "v", (F.col("w") / F.col("out")).alias("p")), "shares")
    x = stored(points.select("id", "out", "t", "held_p", start.alias("score"), (F.col("held_n") * start).alias("held"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("change")), "scores")
    forget(per)
    settled = tolerance <= 0
    for k in range(iterations):
        lost, change = x.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("score"))), F.lit(0.0)), F.sum("change")).first()
        if k and tolerance > 0 and change < n * tolerance:
            settled = True
            break
        sent = shares.join(x.select(F.col("id").alias("u"), "score"), "u").groupBy("v").agg(F.sum(F.col("p") * F.col("score")).alias("got")).withColumnRenamed("v", "id")
        new = ALPHA * (F.coalesce("got", F.lit(0.0)) + F.col("held") + F.lit(lost) * F.col("t")) + (1 - ALPHA) * F.col("t")
        held = ALPHA * F.col("score") * F.col("held_p")
        # a host's leaves all rise or all fall
        change = F.abs(new - F.col("score")) + F.abs(held - F.col("held"))
        old, x = x, stored(x.join(sent, "id", "left").select("id", "out", "t", "held_p", new.alias("score"), held.alias("held"), F.col("score").alias("before"), change.alias("change")), "scores")
        forget(old)
    else:
        settled = settled or (iterations > 0 and x.agg(F.sum("change")).first()[0] < n * tolerance)
    forget(shares)
    of_leaf = F.coalesce(ALPHA * F.col("before") * F.col("w") / F.col("out"), start)
    found = x.select("id", "score").union(leaves.join(x.select(F.col("id").alias("host"), "out", "before"), "host").select("id", of_leaf.alias("score")))
    return found if settled else found.select("id", F.lit(1.0).alias("score"))


def top_k_pinned(scores: DataFrame, seed_ids: DataFrame, k: int = TOP_K, digits: int = ROUND) -> DataFrame:
    """(id, score) of the k best by rounded score, then id, with every seed: the best k that hold all seeds,
    or k of which others make room; more seeds than k are all kept."""
    marked = scores.join(seed_ids.select("id").distinct().withColumn("seed", F.lit(True)), "id", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    rounded = F.round("score", digits)
    # seeds are few: their number decides how many others are taken
    n_seeds = marked.filter("seed").count()
    others = marked.filter("not seed").orderBy(F.desc(rounded), "id").limit(max(0, k - n_seeds))
    return marked.filter("seed").unionByName(others).select("id", "score")


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    few = ids.select("id").distinct()
    kept = edges.join(few.withColumnRenamed("id", "source"), "source", "left_semi")
    return kept.join(few.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def fact_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file, is_code, seq, line): each edge as a sentence; ends without a node are code under their own id."""
    ends = nodes.select("id", F.coalesce("label", "id").alias("label"), F.coalesce("modality", F.lit("code")).alias("modality"))
    a, b = (ends.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"), F.col("modality").alias(f"{end}_modality")) for end in ("source", "target"))
    joined = edges.join(a, "source", "left").join(b, "target", "left")
    sentence = F.concat(F.coalesce("source_label", "source"), F.lit(" —"), F.coalesce("relation", F.lit("?")), F.lit("—> "), F.coalesce("target_label", "target"))
    is_code = (F.coalesce("source_modality", F.lit("code")) == "code") & (F.coalesce("target_modality", F.lit("code")) == "code")
    return joined.select(F.when(F.coalesce("source_file", F.lit("")) == "", "unknown source").otherwise(F.col("source_file")).alias("source_file"), is_code.alias("is_code"), "seq", sentence.alias("line"))


def context_sections(lines: DataFrame) -> DataFrame:
    """(section, n_facts, body): code facts under '', others by file. Lines are sorted and put together by many tasks, CHUNK of
    them at a time; what one task puts together is a section's chunks. A body is one string, so it has to stay below 2 GB."""
    section = F.when(F.col("is_code"), "").otherwise(F.col("source_file"))
    placed = numbered(lines.select(section.alias("section"), "seq", "line"), "place", "section", "seq", "line")
    rows = placed.groupBy("section", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("rows"), F.count("*").alias("n"))
    # a table of its own, so that the sorting is done when a section's chunks meet
    chunks = stored(rows.select("section", "chunk", "n", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body")), "chunks")
    whole = chunks.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("chunk", "body"))).alias("rows"), F.sum("n").alias("n_facts"))
    return whole.select("section", "n_facts", F.array_join(F.transform("rows", lambda r: r["body"]), "\n").alias("body"))


def context_text(sections: DataFrame) -> str:
    """The whole context, code first; at most a subgraph's lines."""
    rows = sorted((r["section"], r["body"]) for r in sections.collect())
    parts = ["Facts from the code itself:\n" + b for s, b in rows if s == ""]
    documents = [f"From {s}:\n{b}" for s, b in rows if s != ""]
    return "\n\n".join(parts + (["Related documents:\n\n" + "\n\n".join(documents)] if documents else []))


def ask(nodes: DataFrame, edges: DataFrame, question: str, k: int = TOP_K) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(seeds, nodes with ppr_score, edges) that answer a question, or None without a seed."""
    found = stored(seeds(nodes, question_words(nodes.sparkSession, question)), "seeds")
    if found.isEmpty():
        return None
    links = stored(collapse_edges(edges), "links")
    scope = component_scope(links, found)
    inside = links.join(scope.select(F.col("id").alias("u")), "u", "left_semi")
    best = stored(top_k_pinned(pagerank(inside, scope, found), found, k), "best")
    shown = nodes.join(best.select("id", F.round("score", 5).alias("ppr_score")), "id")
    return found, shown, induced_edges(edges, best)


def ranked_components(links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. Beyond one_task links, nodes with one link, loops aside, go with
    their host, as often as that halves the links; then alternating large and small stars."""
    ship(links.sparkSession)
    n = links.count()
    if n <= one_task:
        return links.select("u", "v").withColumn("all", F.lit(True)).groupBy("all").applyInPandas(lambda rows: _components_in_one_task(rows), "id string, component string")
    core, leaves = folded(links.filter("u <> v").select("u", "v"))
    found = ranked_components(core, one_task) if 2 * core.count() <= n else _components_by_stars(core)
    least = leaves.groupBy("host").agg(F.min("id").alias("leaf"))
    hosts = stored(found.join(least.withColumnRenamed("host", "id"), "id", "full").select("id", F.coalesce("component", "id").alias("component"), F.least("id", "leaf").alias("least")), "hosts")
    names = stored(hosts.groupBy("component").agg(F.min("least").alias("name")), "names")
    named = stored(hosts.join(names, "component").select("id", F.col("name").alias("component")), "named")
    forget(hosts, names)
    linked = named.union(leaves.join(named.withColumnRenamed("id", "host"), "host").select("id", "component"))
    loops = links.filter("u = v").select(F.col("u").alias("id")).distinct()
    if loops.isEmpty():
        return linked
    return linked.union(loops.join(linked.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))


def _components_by_stars(links: DataFrame) -> DataFrame:
    """(id, component) by alternating large and small stars."""
    at = stored(links.filter("u <> v").select("u", "v").distinct(), "stars")
    before = None
    while True:
        both = at.union(at.select("v", "u"))
        # tables of their own before the joins, so that a star which very many links name can be split
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = stored(down.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, at = at, stored(moved.filter("u <> v").distinct(), "stars")
        forget(old, least, large, low)
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    linked = at.select(F.col("u").alias("id"), F.col("v").alias("component"))
    # centres, and ids whose only link is to themselves
    others = links.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(linked, "id", "left_anti")
    return linked.union(others.select("id", F.col("id").alias("component")))


def first_k(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= k)
