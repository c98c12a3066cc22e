"""Links after a change, from the links before, against a whole resolution."""

import random

import pytest

from skein.functions import text as X
from skein.operators import relink
from skein.plans import project


def tables(spark, files):
    """calls, imports, nodes and namespaces of {path: (names defined, names called, modules imported, namespace)}."""
    calls, imports, nodes, spaces = [], [], [], []
    for path, (defined, called, modules, space) in files.items():
        nodes.append((path, path.rsplit("/", 1)[-1], path))
        nodes += [(f"{path}:{n}", f"{n}()", path) for n in defined]
        calls += [(f"{path}:{defined[0] if defined else ''}", n, path, "L1") for n in called]
        imports += [(path, m, "imports", path, "L1") for m in modules]
        spaces += [(space, path)] if space else []
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return (
        frame(calls, "caller_id string, callee_name string, source_file string, line string"),
        frame(imports, "source_id string, module string, relation string, source_file string, line string"),
        frame(nodes, "id string, label string, source_file string").selectExpr("*", "0 AS seq"),
        frame(spaces, "namespace string, id string"),
    )


def change_of(spark, before, after):
    """The change from one project's files to another's, and the links kept."""
    moved = sorted(p for p in {*before, *after} if before.get(p) != after.get(p))
    own = [tables(spark, {p: f for p, f in files.items() if p in moved}) for files in (before, after)]
    names = relink.stale(relink.names_of(own[0][2]), relink.names_of(own[1][2]), "name")
    spaces = relink.stale(own[0][3], own[1][3], "namespace")
    modules = [spark.createDataFrame([(p,) for p in files if p in moved], "p string").select(X.module_path("p").alias("module")) for files in (before, after)]
    return relink.Change(spark.createDataFrame([(p,) for p in moved], "rel_path string"), relink.resolved(*tables(spark, before)), names, spaces, relink.stale(*modules, "module"))


def test_one_changed_file_reaches_few_links(spark):
    draw = random.Random(4)
    names = [f"name{k}" for k in range(60)]
    one = lambda: (draw.sample(names, 3), draw.sample(names, 6), [f"a.b.{draw.choice(names)}", f"Space{draw.randint(0, 9)}"], f"Space{draw.randint(0, 9)}" if draw.random() < 0.3 else None)
    before = {f"src/f{k}.cs": one() for k in range(40)}
    for changed in ({"src/f3.cs": one()}, {"src/f3.cs": None}, {"src/new.cs": one()}, {f"src/f{k}.cs": one() for k in range(40)}):
        after = {p: f for p, f in {**before, **changed}.items() if f}
        calls, imports, nodes, spaces = tables(spark, after)
        change = change_of(spark, before, after)
        got = sorted(map(repr, relink.relinked(calls, imports, nodes, spaces, change).collect()))
        assert got == sorted(map(repr, relink.resolved(calls, imports, nodes, spaces).collect())) and got
        again = sum(t.count() for t in relink.to_resolve(calls, imports, change))
        assert again < (calls.count() + imports.count()) / 3 or len(changed) > 1


def test_builds_after_changes_equal_whole_builds(spark, tmp_path):
    root = tmp_path / "project"
    root.mkdir()
    write = lambda name, text: (root / name).write_text(text)
    write("a.py", "from b import helper\nimport c\ndef first():\n    helper()\n    other()\n")
    write("b.py", "def helper():\n    pass\n")
    write("c.py", "def other():\n    first()\n")

    def links(out):
        _, edges = project.build(spark, str(root), out, do_cluster=False)
        return sorted((r.source, r.target, r.relation, r.context or "") for r in edges.collect())

    kept = str(tmp_path / "kept")
    steps = [
        lambda: write("d.py", "def helper():\n    pass\n"),  # helper has two definitions now
        lambda: (root / "b.py").unlink(),  # and one again, elsewhere; the module b is gone
        lambda: write("c.py", "def renamed():\n    first()\n"),
    ]
    links(kept)
    for k, step in enumerate(steps):
        step()
        assert links(kept) == links(str(tmp_path / f"whole{k}")), k


@pytest.mark.parametrize("key", ["name", "id"])
def test_stale_keys(spark, key):
    rows = lambda *x: spark.createDataFrame(list(x), "name string, id string")
    got = {r[0] for r in relink.stale(rows(("a", "1"), ("b", "2"), ("b", "2"), ("c", "3")), rows(("a", "1"), ("b", "2"), ("d", "4")), key).collect()}
    assert got == ({"b", "c", "d"} if key == "name" else {"2", "3", "4"})
