"""Operators on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import fuzzy
from skein.functions import text as X
from skein.operators import community, concepts, graph, incremental, leiden, resolve, traverse
from skein.sources import providers

N = "id string, label string, modality string, source_file string, seq long"
E = "source string, target string, relation string, confidence string, source_file string, seq long"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, label, "code", f, k) for k, (i, label, f) in enumerate(rows)], N)


def edges(spark, *rows):
    return spark.createDataFrame([(s, t, r, c, f, k) for k, (s, t, r, c, f) in enumerate(rows)], E)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column,want",
    [
        (lambda: X.make_id(F.lit("account/account.py"), F.lit("Account"), F.lit(""), F.lit("find_by_email")), "account_account_py_account_find_by_email"),
        (lambda: X.slug(F.lit("!!!")), "x"),
        (lambda: X.slug(F.lit("ﬁle Ａ")), "file_a"),
        (lambda: X.normalize_identifier(F.lit("checkPassword")), "check_password"),
        (lambda: X.normalize_identifier(F.lit("CheckPassword")), "check_password"),
        (lambda: X.normalize_identifier(F.lit("check-password")), "check_password"),
        (lambda: X.simple_label(F.lit(".login()")), "login"),
        (lambda: X.last_component(F.lit("App\\Utils\\Helper")), "Helper"),
        (lambda: X.last_component(F.lit("com.example.data.Helper ")), "Helper"),
        (lambda: X.module_path(F.lit("src/a/b.test.py")), "src.a.b.test"),
        (lambda: X.clock(F.lit(125.9)), "02:05"),
        (lambda: X.media_type(F.lit("a/b.JPG")), "image/jpeg"),
        (lambda: X.file_modality(F.lit("a/.b.PY")), "code"),
        (lambda: X.file_modality(F.lit("a/b")), None),
        (lambda: X.file_language(F.lit("x.hpp")), "cpp"),
        (lambda: X.words(F.lit("a b_1 a 2c é")), ["a", "b_1", "c"]),
        (lambda: X.fallback_answer(F.lit(" ")), "Nothing in the graph bears on this question."),
    ],
)
def test_functions(spark, column, want):
    assert value(spark, column()) == want


def test_headings_and_replies(spark):
    got = value(spark, X.headings(F.lit("# One\ntext\n### Two  \n#no\n")))
    assert [(h.level, h.title) for h in got] == [(1, "One"), (3, "Two")]
    assert value(spark, X.parse_reply(F.lit("[1]"))["entities"]) == []
    assert providers.parse_reply("```json\n{\"a\": 1}\n```") == {"a": 1}
    assert providers.parse_reply("[1]") == {"entities": [], "relations": []}


def test_security(spark):
    rows = [("a/hr/x.md", "", True), ("a/x.py", 'password = "abcd"', True), ("a/x.java", 'password = "abcd"', False), ("a/x.md", None, False), ("Patents/x.bin", None, True)]
    df = spark.createDataFrame(rows, "path string, text string, want boolean")
    got = df.select(X.security(F.col("path"), F.col("text"), ("patents",))["force_local"].alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_fuzzy(spark):
    symbols = spark.createDataFrame([("email_sercice", "1", 1), ("other", "2", 2), ("email_servicf", "3", 3)], "name string, id string, seq long")
    names = spark.createDataFrame([("email_service",), ("zzz",)], "name string")
    assert [r.id for r in fuzzy.best_symbols(names, symbols).collect()] == ["1"]
    assert fuzzy.best_symbols(names, symbols, 0.99).count() == 0


@pytest.mark.parametrize("threshold", [0.85, 0.72, 0.5])
def test_fuzzy_index_loses_nothing(spark, threshold):
    import difflib
    import random

    draw = random.Random(2)
    words = ["", *("".join(draw.choice("abAB") for _ in range(draw.randint(0, 9))) for _ in range(80))]
    symbols = list(dict.fromkeys("".join(draw.choice("abAB") for _ in range(draw.randint(0, 9))) for _ in range(80)))
    df = spark.createDataFrame([(s, s, k) for k, s in enumerate(symbols)], "name string, id string, seq long")
    got = {r.name: r.id for r in fuzzy.best_symbols(spark.createDataFrame([(w,) for w in words], "name string"), df, threshold).collect()}
    for w in words:
        scores = [difflib.SequenceMatcher(None, w.lower(), s.lower()).ratio() for s in symbols]
        best = max(scores)
        assert got.get(w) == (symbols[scores.index(best)] if best >= threshold else None)


def test_fuzzy_pairs_are_few(spark):
    """Rows of the join, of all pairs of words that texts hold; and nothing lost."""
    import difflib

    words = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.split(F.lower("text"), r"\W+")).alias("a")).filter(F.length("a") >= 4).distinct()
    a, b = (words.filter(F.pmod(F.xxhash64("a"), F.lit(20)) == k) for k in (0, 1))
    left, right = ([r[0] for r in t.collect()] for t in (a, b))
    near = {(x, y) for x in left for y in right if difflib.SequenceMatcher(None, x, y).ratio() >= 0.85}
    b = b.withColumnRenamed("a", "b")
    found = {tuple(r) for r in fuzzy.candidates(a, b).collect()}
    assert near and near <= found and len(found) < 10 * len(near)
    assert len(left) * len(right) > 10_000 and fuzzy.joined(a, b).count() < len(left) * len(right) / 10


def test_collisions_duplicates_and_dangling_edges(spark):
    n = nodes(spark, ("auth_login_py", "login.py", "auth/login.py"), ("auth_login_py", "auth_login.py", "auth_login.py"), ("b", "b", "f"), ("b", "b again", "f"))
    e = edges(spark, ("b", "auth_login_py", "imports", "EXTRACTED", "f"), ("b", "none", "calls", "EXTRACTED", "f"), ("b", "b", "calls", "EXTRACTED", "f"), ("b", "b", "uses", "EXTRACTED", "f"))
    e = e.withColumn("target_source_file", F.when(F.col("target") == "auth_login_py", "auth/login.py"))
    n2, e2 = graph.build_graph(n, e)
    ids = {r.id: r for r in n2.collect()}
    assert len(ids) == 3 and ids["b"].label == "b again" and ids["b"].seq == 2
    assert {(r.source, r.relation) for r in e2.collect()} == {("b", "imports"), ("b", "calls"), ("b", "uses")}


def test_weights(spark):
    e = edges(spark, ("a", "b", "x", "EXTRACTED", "f"), ("b", "a", "y", "EXTRACTED", "f"), ("a", "c", "x", "INFERRED", "f"), ("a", "d", "x", "AMBIGUOUS", "f"), ("a", "e", "x", "?", "f"))
    assert {(r.u, r.v): r.w for r in graph.collapse_edges(e).collect()} == {("a", "b"): 2.0, ("a", "c"): 0.6, ("a", "d"): 0.3, ("a", "e"): 0.5}
    assert {r.id: r.degree for r in graph.degrees(e.limit(2)).collect()} == {"a": 2, "b": 2}


def test_imports(spark):
    n = nodes(spark, ("f1", "Helper.php", "Helper.php"), ("h", "Helper", "Helper.php"), ("t1", "Twice", "a"), ("t2", "Twice()", "b"))
    raw = spark.createDataFrame([("x", "App\\Utils\\Helper", "imports", "x", "L1"), ("x", "a.Twice", "imports", "x", "L2"), ("h", "Helper", "imports", "x", "L3"), ("x", "App.Utils", "imports", "x", "L4"), ("x", "App.Two", "imports", "x", "L5")], "source_id string, module string, relation string, source_file string, line string")
    spaces = spark.createDataFrame([("App.Utils", "f9"), ("App.Two", "f1"), ("App.Two", "f2"), ("Helper", "f3")], "namespace string, id string")
    got = {(r.source, r.target, r.context) for r in resolve.resolve_imports(raw, n, spaces).collect()}
    assert got == {("x", "h", "cross_file_import"), ("x", "f9", "cross_file_import_namespace")}


def test_incremental(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2x"), ("c", "3")], "rel_path string, sha1 string")
    cache = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "rel_path string, sha1 string")
    assert {r.rel_path: r.state for r in incremental.status(files, cache).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "deleted"}
    fresh = spark.createDataFrame([("b", "2x", True), ("c", "3", False)], "rel_path string, sha1 string, incomplete boolean")
    assert {r.rel_path for r in incremental.updated(cache, files, fresh).collect()} == {"a", "c"}


QUERY_GRAPH = [("login", "login()", "f"), ("check", "check_password()", "f"), ("charge", "charge()", "g"), ("invoice", "invoice()", "g")]


def query_graph(spark):
    return nodes(spark, *QUERY_GRAPH), edges(spark, ("login", "check", "calls", "EXTRACTED", "f"), ("charge", "invoice", "calls", "EXTRACTED", "g"))


@pytest.mark.parametrize("one_task", [traverse.ONE_TASK_LINKS, 0])
def test_scope_leaves_other_components_out(spark, one_task):
    n, e = query_graph(spark)
    links, seeds = graph.collapse_edges(e), n.filter("id = 'login'").select("id")
    scope = traverse.component_scope(links, seeds, one_task=one_task)
    assert {r.id for r in scope.collect()} == {"login", "check"}
    scores = {r.id: r.score for r in traverse.pagerank(links.filter("u = 'check'"), scope, seeds, one_task=one_task).collect()}
    assert scores["login"] == pytest.approx(1 / 1.85, abs=1e-4) and sum(scores.values()) == pytest.approx(1)


def test_questions(spark):
    n, e = query_graph(spark)
    seeds, shown, links = traverse.ask(n, e, "How does login work?")
    assert {r.id for r in shown.collect()} == {"login", "check"} and links.count() == 1
    ids = lambda q: {r.id for r in traverse.seeds(n, traverse.question_words(spark, q)).collect()}
    assert ids("loginout") == set() and ids("what of check_pasword") == {"check"}
    assert traverse.ask(n, e, "nothing of the kind") is None
    alone = nodes(spark, ("s", "solo()", "f"))
    _, shown, _ = traverse.ask(alone, e.limit(0), "solo", k=1)
    assert [r.id for r in shown.collect()] == ["s"]


def test_exact_seeds_leave_no_room_for_near_ones(spark):
    n = nodes(spark, ("a", "login", "f"), ("b", "logi", "f"))
    assert [r.id for r in traverse.seeds(n, traverse.question_words(spark, "login")).collect()] == ["a"]


def test_seeds_are_always_kept(spark):
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 0.3)], "id string, score double")
    pick = lambda k, *s: {r.id for r in traverse.top_k_pinned(scores, spark.createDataFrame([(x,) for x in s], "id string"), k).collect()}
    assert pick(2, "a") == {"a", "c"} and pick(1, "a", "b") == {"a", "b"} and pick(3, "c") == {"c", "d", "b"}


def test_context(spark):
    n = spark.createDataFrame([("a", "A", "code"), ("b", "B", "code"), ("d", "Doc", "document")], "id string, label string, modality string")
    e = edges(spark, ("a", "b", "calls", "EXTRACTED", "f"), ("d", "a", "describes", "EXTRACTED", "z.md"), ("d", "x", None, "EXTRACTED", ""))
    text = traverse.context_text(traverse.context_sections(traverse.fact_lines(n, e)))
    assert text == "Facts from the code itself:\nA —calls—> B\n\nRelated documents:\n\nFrom unknown source:\nDoc —?—> x\n\nFrom z.md:\nDoc —describes—> A"
    assert len(providers.fallback_answer("line of text\n" * 100)) < 860
    assert providers.answer(None, "q", "").startswith("Nothing")


@pytest.mark.parametrize("one_task", [traverse.ONE_TASK_LINKS, 0])
def test_components(spark, one_task):
    rows = [(f"{k:04}", f"{k + 1:04}", 1.0) for k in range(0, 300)] + [("x", "y", 1.0), ("z", "z", 1.0)]
    got = {r.id: r.component for r in traverse.ranked_components(spark.createDataFrame(rows, "u string, v string, w double"), one_task).collect()}
    assert got == {**{f"{k:04}": "0000" for k in range(301)}, "x": "x", "y": "x", "z": "z"}


def two_rings(spark):
    ring = lambda p: [(f"{p}{a}", f"{p}{b}", 1.0) for a in range(5) for b in range(a + 1, 5)]
    return spark.createDataFrame([*ring("a"), *ring("b"), ("a0", "b0", 0.1)], "u string, v string, w double")


@pytest.mark.parametrize("one_task", [community.ONE_TASK_LINKS, 0])
def test_communities_of_two_rings(spark, one_task):
    links = two_rings(spark)
    ids = spark.createDataFrame([(f"{p}{k}",) for p in "ab" for k in range(5)] + [("alone",)], "id string")
    member = community.partition(ids, links, 1.0, one_task=one_task)
    got = {r.id: r.community for r in member.collect()}
    assert len(got) == 11 and len({got[f"a{k}"] for k in range(5)}) == 1 and len(set(got.values())) == 3
    assert community.modularity(links, member) > 0.4


def planted(groups, size, seed, across):
    """Links of a graph with dense groups and some links across."""
    import random

    draw = random.Random(seed)
    ids = [(g, k) for g in range(groups) for k in range(size)]
    name = lambda x: f"n{x[0]:02}_{x[1]:02}"
    return [(name(a), name(b), 1.0) for i, a in enumerate(ids) for b in ids[i + 1 :] if draw.random() < (0.5 if a[0] == b[0] else across)]


def by_array(rows):
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    place = {x: k for k, x in enumerate(names)}
    return names, *(np.array(c) for c in ([place[a] for a, _, _ in rows], [place[b] for _, b, _ in rows], [w for *_, w in rows]))


def quality(u, v, w, member, resolution):
    m, strength = w.sum(), np.bincount(u, w, len(member)) + np.bincount(v, w, len(member))
    squares = sum(strength[member == c].sum() ** 2 for c in set(member.tolist()))
    return w[member[u] == member[v]].sum() / m - resolution * squares / (2 * m) ** 2


def test_leiden_is_stable_and_near_the_best_of_all_partitions():
    def partitions(n, upto=0):
        if n == 0:
            yield []
        else:
            for rest in partitions(n - 1):
                for c in range(max(rest, default=-1) + 2):
                    yield [*rest, c]

    shares = []
    for seed in range(12):
        names, u, v, w = by_array(planted(2, 4, seed, 0.25))
        for resolution in (0.6, 1.0):
            found = leiden.in_one_task(u, v, w, len(names), 2 * w.sum(), resolution, np.arange(len(names)))
            own = quality(u, v, w, found, resolution)
            shares.append(own / max(quality(u, v, w, np.array(p), resolution) for p in partitions(len(names))))
            # no node gains by moving to another community, or to one of its own
            for k in range(len(names)):
                for c in {*found.tolist(), -1}:
                    moved = found.copy()
                    moved[k] = c
                    assert quality(u, v, w, moved, resolution) <= own + 1e-9
            assert (leiden.in_one_task(u, v, w, len(names), 2 * w.sum(), resolution, found) == found).all()
    assert sum(shares) / len(shares) > 0.97 and sum(x > 1 - 1e-9 for x in shares) > len(shares) / 2


def test_parts_are_connected_and_inside():
    rows = planted(4, 10, 3, 0.02)
    names, u, v, w = by_array(rows)
    graph = leiden._Graph(u, v, w, len(names))
    at = [k % 3 for k in range(len(names))]  # a poor partition
    part = np.array(graph.parts(at, 2 * w.sum(), 1.0))
    assert all(at[k] == at[p] for k, p in enumerate(part)) and 3 < len(set(part.tolist())) < len(names)
    assert len(set(leiden.connected_parts(u, v, part).tolist())) == len(set(part.tolist()))


def test_levels_are_as_good_as_one_task(spark):
    rows = planted(8, 12, 5, 0.02)
    links = spark.createDataFrame(rows, "u string, v string, w double")
    names, u, v, w = by_array(rows)
    ids = spark.createDataFrame([(x,) for x in names], "id string")
    one = leiden.in_one_task(u, v, w, len(names), 2 * w.sum(), 1.0, np.arange(len(names)))
    for one_task in (150,):
        member = {r.id: r.community for r in community.partition(ids, links, 1.0, one_task=one_task).collect()}
        found = np.array([member[x] for x in names])
        assert quality(u, v, w, found, 1.0) >= 0.99 * quality(u, v, w, one, 1.0)
        assert len(set(leiden.connected_parts(u, v, found).tolist())) == len(set(found.tolist()))
    # a warm start keeps the numbers there too
    earlier = spark.createDataFrame([(x, int(c) + 70) for x, c in zip(names, one, strict=True)], "id string, community long")
    again = {r.id: r.community for r in community.partition(ids, links, 1.0, earlier, one_task=150).collect()}
    assert again == {x: int(c) + 70 for x, c in zip(names, one, strict=True)}


def test_greedy_merging_takes_the_best_pair_each_time(spark, monkeypatch):
    for seed in range(8):
        names, u, v, w = by_array(planted(3, 5, seed, 0.1))
        member = np.arange(len(names))
        while True:  # brute force: try every merge
            now, best = quality(u, v, w, member, 1.0), None
            for a in sorted(set(member.tolist())):
                for b in sorted(set(member.tolist())):
                    if a < b and ((member[u] == a) & (member[v] == b) | (member[u] == b) & (member[v] == a)).any():
                        gain = quality(u, v, w, np.where(member == b, a, member), 1.0) - now
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, a, b)
            if best is None:
                break
            member = np.where(member == best[2], best[1], member)
        found = leiden.merged(u, v, w, len(names), 2 * w.sum())
        assert abs(quality(u, v, w, found, 1.0) - quality(u, v, w, member, 1.0)) < 1e-9
    rows = planted(6, 10, 1, 0.02)
    links, (names, u, v, w) = spark.createDataFrame(rows, "u string, v string, w double"), by_array(rows)
    ids = spark.createDataFrame([(x,) for x in [*names, "alone"]], "id string")
    one = leiden.merged(u, v, w, len(names), 2 * w.sum())
    for one_task in (10_000, 60):
        got = {r.id: r.community for r in community.greedy_modularity(ids, links, one_task).collect()}
        assert set(got) == {*names, "alone"} and list(got.values()).count(got["alone"]) == 1
        assert quality(u, v, w, np.array([got[x] for x in names]), 1.0) >= 0.95 * quality(u, v, w, one, 1.0)

    def broken(*args, **more):
        raise RuntimeError("no Leiden here")

    monkeypatch.setattr(community, "partition", broken)
    n = nodes(spark, *[(x, x, "f") for x in "abcde"])
    e = edges(spark, ("a", "b", "x", "EXTRACTED", "f"), ("b", "c", "x", "EXTRACTED", "f"), ("d", "e", "x", "EXTRACTED", "f"))
    done = community.cluster(n, e).collect()
    assert {tuple(sorted(r.id for r in done if r.community == c)) for c in {r.community for r in done}} == {("a", "b", "c"), ("d", "e")} and all(r.community == r.community_group for r in done)


def test_warm_start_keeps_numbers(spark):
    n = nodes(spark, *[(x, x, "f") for x in "abcde"])
    e = edges(spark, ("a", "b", "x", "EXTRACTED", "f"), ("b", "c", "x", "EXTRACTED", "f"), ("d", "e", "x", "EXTRACTED", "f"))
    first = community.cluster(n, e)
    assert first.filter("community is null or community_group is null").count() == 0
    renamed = first.withColumns({"community": F.col("community") + 40, "community_group": F.col("community_group") + 70})
    again = {r.id: (r.community, r.community_group) for r in community.cluster(renamed, e).collect()}
    assert again == {r.id: (r.community, r.community_group) for r in renamed.collect()}
    assert community.cluster(n.limit(0), e.limit(0)).count() == 0
    start = {r.id: r.start for r in community.initial_membership(n, first.filter("id < 'c'").select("id", F.lit(7).alias("community"))).collect()}
    assert start == {"a": 7, "b": 7, "c": 8, "d": 9, "e": 10}


def test_tiers(spark):
    class Links:
        def __init__(self, answers):
            self.answers = answers

        def ask(self, names):
            return {n: self.answers[n] for n in names if n in self.answers}

    symbols = spark.createDataFrame([("checkPassword", "t1", 1), ("save", "t2", 2)], "name string, id string, seq long")
    rows = [("d", "c1", "the save step", 1), ("d", "c2", "check_password", 2), ("d", "c3", "checkPasswrd", 3), ("e", "c4", "checkPasswrd", 1), ("f", "c5", "persist", 1), ("g", "c6", "made up", 1)]
    found = spark.createDataFrame(rows, "rel_path string, concept_id string, name string, pos int")
    none = spark.createDataFrame([("z", "t1")], "rel_path string, target string")
    got = {(r.source, r.target, r.confidence, r.context) for r in concepts.link_concepts(found, symbols, none, provider=Links({"persist": "save", "made up": "no such symbol"})).collect()}
    assert got == {("c1", "t2", "INFERRED", "semantic_concept_mention"), ("c2", "t1", "INFERRED", "normalized_concept_mention"), ("c4", "t1", "AMBIGUOUS", "fuzzy_concept_mention"), ("c5", "t2", "AMBIGUOUS", "semantic_llm_link_batch")}
    seen = {(r.source, r.context) for r in concepts.link_concepts(found, symbols, none, "vision").collect()}
    assert ("c2", "vision_normalized_match") in seen and ("c4", "vision_fuzzy_match") in seen


def test_answers_must_be_symbols():
    class Model:
        name = "m"

        def link_names(self, names, candidates):
            return {"a": "real", "b": "invented", "c": None}

    assert providers.link_names(Model(), ["a", "b", "c"], {"real"}) == {"a": "real"} and providers.link_one(Model(), "b", {"real": "1"}) is None


def test_answers_name_any_symbol_and_each_once_a_file(spark):
    """Beyond the candidates that a model is shown, too; a symbol that a file refers to already isn't linked again."""

    class Links:
        def ask(self, names):
            return {n: "zz900" for n in names} | {"taken": "zz001"}

    symbols = spark.createDataFrame([(f"zz{k:03}", f"t{k}", k) for k in range(1000)], "name string, id string, seq long")
    found = spark.createDataFrame([("d", "c1", "unheard", 1), ("d", "c2", "of", 2), ("d", "c3", "taken", 3), ("e", "c4", "other", 1)], "rel_path string, concept_id string, name string, pos int")
    got = concepts.link_concepts(found, symbols, spark.createDataFrame([("d", "t1")], "rel_path string, target string"), provider=Links())
    assert {(r.source, r.target, r.source_file) for r in got.collect()} == {("c1", "t900", "d"), ("c4", "t900", "e")}


def test_replies_with_and_without_fences():
    one = {"entities": [{"name": "a"}]}
    text = json.dumps(one)
    for raw in (text, f"  {text}\n", f"```json\n{text}\n```", f"```\n{text}```", f"```{text}```", f"```json\n{text}"):
        assert providers.parse_reply(raw) == one
    for raw in ("", "no", "[1]", "```\nno\n```"):
        assert providers.parse_reply(raw) == {"entities": [], "relations": []}


def test_long_answers_end_with_a_whole_line():
    lines = "\n".join(f"fact {k}" for k in range(500))
    body = providers.fallback_answer(lines).split("\n\n", 1)[1]
    assert body.endswith("\n[...]") and len(body) <= 806 and body[:-6] + "\nfact" in lines
    assert providers.shortened("x" * 900) == "x" * 800 + "\n[...]" and "Nothing" in providers.fallback_answer(" ")
