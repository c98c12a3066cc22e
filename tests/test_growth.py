"""What steps keep small when tables grow: rows of the tables that loops and joins write, with the results of the plain paths."""

import pytest
from pyspark.sql import functions as F

from skein.functions import fuzzy
from skein.operators import community, leiden, traverse
from skein.plans import adapters, catalog
from skein.shared import stored
from skein.sources import extract


@pytest.fixture
def tables(monkeypatch):
    """(name, rows) of the tables that are written from here on."""
    seen = []

    def keep(df, name="step"):
        out = stored(df, name)
        seen.append((name, out.count()))
        return out

    for module in (traverse, community, leiden, fuzzy):
        monkeypatch.setattr(module, "stored", keep)
    return seen


def _links(spark):
    """Two hubs of a ring with 40 leaves each, a pair, a loop alone, a leaf that is a seed and one whose link weighs nothing."""
    rows = [("h0", "h1", 1.0), ("h1", "h2", 0.6), ("h0", "h2", 0.3), ("a", "b", 1.0), ("s", "s", 1.0), ("h0", "seed", 0.6), ("h1", "nil", 0.0)]
    rows += [(f"h{k % 2}", f"{'' if k else '0'}l{k}", (1.0, 0.6, 0.3)[k % 3]) for k in range(80)]
    return spark.createDataFrame([(min(u, v), max(u, v), w) for u, v, w in rows], "u string, v string, w double")


@pytest.mark.parametrize(("rounds", "tolerance"), [(1, 0.0), (2, 0.0), (30, 0.0), (100, 1e-6), (2, 1e-6)])
def test_pagerank_rounds_leave_leaves_out(spark, tables, rounds, tolerance):
    links = _links(spark)
    ids = links.select(F.explode(F.array("u", "v")).alias("id")).union(spark.createDataFrame([("alone",)], "id string")).distinct()
    marks = spark.createDataFrame([("seed",), ("a",), ("h2",)], "id string")
    one, many = ({r.id: r.score for r in traverse.pagerank(links, ids, marks, rounds, tolerance, n).collect()} for n in (10**6, 0))
    assert one.keys() == many.keys() == {r.id for r in ids.collect()}
    assert max(abs(one[k] - many[k]) for k in one) < 1e-12
    # hubs, the pair's seed, the loop, the seed, the link of no weight and what is alone
    assert [n for name, n in tables if name == "scores"] and max(n for name, n in tables if name == "scores") == 8


def test_components_leave_leaves_out(spark, tables):
    links = _links(spark)
    one, many = ({r.id: r.component for r in traverse.ranked_components(links, n).collect()} for n in (10**6, 0))
    assert one == many
    assert many["h2"] == "0l0"  # the smallest id is a leaf's
    assert all(n <= 6 for name, n in tables if name == "stars")


def test_communities_start_without_leaves(spark, tables):
    links = _links(spark).filter("w > 0")
    ids = links.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    member = {r.id: r.community for r in community.partition(ids, links, 0.6, one_task=2).collect()}
    assert member.keys() == {r.id for r in ids.collect()}
    assert all(member[r.u] == member[r.v] for r in links.collect() if r.u[0] == "h" and r.v[0] == "l")
    assert max(n for name, n in tables if name == "clustered") < 10


def _tree(spark, inner=12, middle=20, outer=6):
    """A root, nodes below it, nodes below these, and leaves below them; weights differ."""
    rows = [("r", f"n{k:02}", 1.0) for k in range(inner)]
    rows += [(f"m{k:03}", f"n{k % inner:02}", (1.0, 0.6)[k % 2]) for k in range(inner * middle)]
    rows += [(f"m{k % (inner * middle):03}", f"o{k:04}", (1.0, 0.6, 0.3)[k % 3]) for k in range(inner * middle * outer)]
    return spark.createDataFrame(rows, "u string, v string, w double")


@pytest.mark.parametrize("resolution", [0.15, 0.6, 1.0])
def test_communities_of_a_tree_need_no_rounds(spark, tables, resolution):
    links = _tree(spark)
    ids = links.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    levels = stored(community.partition(ids, links, resolution, one_task=100), "levels")
    # at 1.0 more nodes stay alone than one task takes
    assert resolution == 1.0 or not {"moves", "stars"} & {name for name, _ in tables}
    # what has leaves is written once a step: neither the leaves nor their hosts' loops come back
    assert max(n for name, n in tables if name in ("contracted", "at", "ends", "clustered")) < 600
    whole = stored(community.partition(ids, links, resolution), "one_task")
    assert levels.count() == levels.select("id").distinct().count() == ids.count()
    assert community.modularity(links, levels, resolution) >= 0.99 * community.modularity(links, whole, resolution)


def test_hosts_take_nodes_while_these_gain(spark):
    """Against one task that tries them in turn."""
    rows = [("h", f"p{k}", (1.0, 0.6, 0.3)[k % 3]) for k in range(30)] + [("h", "h", 1.0), ("h", "i", 1.0), ("i", "j", 0.5), ("j", "h", 0.5), ("x", "y", 1.0)]
    rows += [(f"p{k}", f"p{k}", float(k % 7)) for k in range(30)]
    rows = [(min(u, v), max(u, v), w) for u, v, w in rows]
    links, total = spark.createDataFrame(rows, "u string, v string, w double"), 2 * sum(w for *_, w in rows)
    s = {}
    for u, v, w in rows:
        s[u], s[v] = s.get(u, 0.0) + w, s.get(v, 0.0) + w if u != v else s.get(u, 0.0) + 2 * w
    at = spark.createDataFrame([(k, x, k) for k, x in s.items()], "id string, s double, c string")
    sizes = set()
    for resolution in (0.15, 0.6, 1.0, 4.0):
        got = {r.id: r.part for r in leiden._joining_hosts(links, at, total, resolution).collect()}
        sums, want = dict(s), {}
        for load, p, h, w in sorted((s[p] / w, p, h, w) for h, p, w in rows if h in "hx" and p[0] in "py" and h != p):
            if w > resolution * s[p] * sums[h] / total:
                want[p], sums[h] = h, sums[h] + s[p]
        assert got == want
        for h, p, w in rows:
            if p in got and h != p:  # none gains by being alone again, nor by coming after all
                assert w > resolution * s[p] * (sums[h] - s[p]) / total - 0.1
        sizes.add(len(got))
    assert len(sizes) > 2


def test_components_leave_loops_out(spark, tables):
    links = _tree(spark).union(spark.createDataFrame([(f"m{k:03}", f"m{k:03}", 1.0) for k in range(240)] + [("z", "z", 1.0)], "u string, v string, w double"))
    one, many = ({r.id: r.component for r in traverse.ranked_components(links, n).collect()} for n in (10**6, 100))
    assert one == many and many["z"] == "z"
    assert "stars" not in {name for name, _ in tables}


def test_partitions_of_the_same_links_share_what_they_can(spark, tables):
    links = _tree(spark)
    ids = links.select(F.explode(F.array("u", "v")).alias("id")).distinct().union(spark.createDataFrame([("alone",)], "id string"))
    have = community.Links(ids, links, one_task=100)
    pairs = lambda t: sorted((min(r.u, r.v), max(r.u, r.v), r.w) for r in t.collect())
    assert pairs(have.links()) == pairs(links)
    before = len([name for name, _ in tables if name == "folded"])
    for resolution in (0.6, 0.15):
        own, both = (stored(community.partition(ids, links, resolution, one_task=10**4, shared=x), "member") for x in (None, have))
        assert community.modularity(links, both, resolution) >= 0.99 * community.modularity(links, own, resolution)
        assert {r.id for r in both.collect()} == {r.id for r in ids.collect()}
    assert len([name for name, _ in tables if name == "folded"]) == before


def test_parts_of_communities_are_counted(spark):
    """Against a search from node to node, over communities dealt at random."""
    import random

    links = _links(spark).union(spark.createDataFrame([("l1", "l3", 1.0), ("a", "a", 1.0)], "u string, v string, w double"))
    ids = links.select(F.explode(F.array("u", "v")).alias("id")).distinct().union(spark.createDataFrame([("alone",)], "id string"))
    have = community.Links(ids, links, one_task=2)
    assert have.folded and have.links().filter("leaf").count() > 70
    near = {}
    for r in links.collect():
        near.setdefault(r.u, set()).add(r.v)
        near.setdefault(r.v, set()).add(r.u)
    torn = 0
    for seed in range(6):
        draw = random.Random(seed)
        at = {r.id: draw.randrange(40 if seed % 2 else 3) for r in ids.collect()} if seed else dict.fromkeys([r.id for r in ids.collect()], 1)
        member = stored(spark.createDataFrame(list(at.items()), "id string, community long"), "member")
        a, b = (member.select(F.col("id").alias(e), F.col("community").alias(f"c{e}")) for e in ("u", "v"))
        placed = have.links().join(a, "u").join(b, "v")
        want, seen = {}, set()
        for k in at:
            if k not in seen:
                want[at[k]], todo = want.get(at[k], 0) + 1, [k]
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        todo += [y for y in near.get(x, ()) if at[y] == at[k]]
        got = {r.community: r.parts for r in community.torn(member, placed).collect()}
        assert got == {c: n for c, n in want.items() if n > 1}
        torn += len(got)
        inside = sum(r.w for r in links.collect() if at[r.u] == at[r.v])
        total, sums = sum(r.w for r in links.collect()), {}
        for r in links.collect():
            for k in (r.u, r.v):
                sums[at[k]] = sums.get(at[k], 0.0) + r.w
        due = inside / total - 0.6 * sum(x * x for x in sums.values()) / (2 * total) ** 2
        for between in (links.join(a, "u").join(b, "v"), placed):
            assert abs(community.quality(between.groupBy("cu", "cv").agg(F.sum("w").alias("w")), 0.6) - due) < 1e-9
        assert abs(community.modularity(links, member, 0.6) - due) < 1e-9
    assert torn


def test_seeds_of_a_question_index_no_table(spark, tables):
    nodes = spark.createDataFrame([(f"n{k}", f"order:{k}", k) for k in range(500)] + [("x", "NATION_12", 600), ("y", "NATION_12", 601)], "id string, label string, seq long")
    found = traverse.fuzzy_seeds(nodes, traverse.question_words(spark, "what of NATINO_12 here"))
    assert [r.id for r in found.collect()] == ["y"]
    assert max(n for _, n in tables) < 50


@pytest.mark.parametrize("threshold", [0.5, 0.72, 0.85, 1.0])
def test_what_is_in_reach_is_all_that_matches(spark, threshold):
    import difflib
    import itertools

    words = ["abcd", "abdc", "Bacd", "abcde", "abcdefgh", "abcdfegh", "zzzz", "abc", "aabbccdd", "abcdabcd"]
    names, symbols = (spark.createDataFrame([(w,) for w in words], "name string") for _ in range(2))
    kept = {r.name for r in fuzzy.in_reach(symbols, names.filter("length(name) > 4"), threshold).collect()}
    due = {b for a, b in itertools.product((w for w in words if len(w) > 4), words) if difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= threshold}
    assert due <= kept


def test_context_is_put_together_by_chunks(spark, tables, monkeypatch):
    monkeypatch.setattr(traverse, "CHUNK", 3)
    rows = [(("f.md", "g.md")[k % 2], k % 5 == 0, 100 - k // 2, f"line {k}") for k in range(40)]
    got = {r.section: (r.n_facts, r.body) for r in traverse.context_sections(spark.createDataFrame(rows, "source_file string, is_code boolean, seq long, line string")).collect()}
    want = {}
    for seq, line, section in sorted((seq, line, "" if code else file) for file, code, seq, line in rows):
        want.setdefault(section, []).append(line)
    assert got == {k: (len(v), "\n".join(v)) for k, v in want.items()}
    assert sum(n for name, n in tables if name == "chunks") >= 40 / 3


def test_files_of_a_small_table_are_read_by_many_tasks(spark, monkeypatch):
    seen = []
    plain = extract.extract
    monkeypatch.setattr(extract, "extract", lambda files: seen.append(files) or plain(files))
    monkeypatch.setattr(adapters, "table", lambda *_: spark.range(200).coalesce(1).select(F.col("id").alias("p_partkey")))
    assert catalog.code_facts(spark, "").select("rel_path").distinct().count() == 200
    assert sum(1 for n in seen[0].groupBy(F.spark_partition_id()).count().collect() if n["count"]) > 8


def test_rows_of_small_files_leave_together(spark, monkeypatch):
    monkeypatch.setattr(extract, "ROWS", 7)
    text = "# a\n## b\n"
    files = spark.createDataFrame([(f"f{k}.md", "document", None, text.encode()) for k in range(300)], "rel_path string, modality string, language string, content binary").coalesce(1)
    done = extract.extract(files)
    assert done.count() == 300 * 5
