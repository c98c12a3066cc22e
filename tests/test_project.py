"""Whole builds of a small project, and what surrounds them."""

import json
import os
import struct

import pytest

from skein import cli
from skein.plans import catalog, project
from skein.sources import extract, settings


@pytest.fixture
def root(tmp_path):
    files = {
        "src/__init__.py": "",
        "src/account.py": "from src.helper import verify\nclass Account:\n    def check_password(self, p):\n        return verify(p)\n",
        "src/helper.py": "def verify(p):\n    return bool(p)\n",
        "docs/guide.md": "# Guide\nSee `Account`.\n## Part\n# End\n",
        "node_modules/x.js": "f()",
        "secret/a.txt": "x",
        "data.bin": "x",
    }
    for name, text in files.items():
        path = tmp_path / "project" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path / "project"


def test_build_query_status(spark, root, tmp_path):
    out = str(tmp_path / "out")
    nodes, edges = project.build(spark, str(root), out)
    ids = {r.id: r for r in nodes.collect()}
    assert {"src_init_py", "src_account_py_account", "docs_guide_md_guide_1"} <= set(ids) and "node_modules_x_js" not in ids
    assert all(r.community is not None and r.community_group is not None for r in ids.values())
    links = {(r.source, r.target, r.relation) for r in edges.collect()}
    assert ("src_account_py", "src_helper_py", "imports_from") in links
    assert ("src_account_py_check_password", "src_helper_py_verify", "calls") in links
    assert ("docs_guide_md", "src_account_py_account", "describes") in links
    assert ("docs_guide_md_guide_1", "docs_guide_md_part_3", "contains") in links and ("docs_guide_md", "docs_guide_md_end_4", "contains") in links
    assert "check_password() —calls—> verify()" in project.query(spark, out, "what does check_password do")
    assert project.query(spark, out, "zzzz").startswith("No node")
    assert not project.status(spark, str(root), out)["needs_rebuild"]
    for name in ("graph.json", "graph.html", "REPORT.md"):
        assert os.path.getsize(f"{out}/{name}") > 100
    shown = json.loads(open(f"{out}/graph.json").read())
    assert len(shown["nodes"]) == nodes.count() and len(shown["edges"]) == edges.count()

    (root / "src/helper.py").write_text("def check(p):\n    return bool(p)\n")
    (root / "secret/a.txt").unlink()
    state = project.status(spark, str(root), out)
    assert state["changed"] == ["src/helper.py"] and state["deleted"] == ["secret/a.txt"] and state["needs_rebuild"]
    nodes, edges = project.build(spark, str(root), out)
    # a cached file's links are made anew: its call has no target any more
    assert "src_helper_py_verify" not in {r.id for r in nodes.collect()}
    assert not [r for r in edges.collect() if r.relation == "calls"]


def test_settings(tmp_path, monkeypatch):
    assert settings.load_settings(tmp_path) == settings.Settings()
    assert settings.write_example(tmp_path) and not settings.write_example(tmp_path)
    assert settings.load_settings(tmp_path).fine_resolution == 0.6
    (tmp_path / settings.FILE).write_text('[security]\nextra_sensitive_dirs = ["x"]\n[cluster]\nfine_resolution = 0.9\n')
    assert settings.load_settings(tmp_path).extra_sensitive_dirs == ("x",) and settings.load_settings(tmp_path).fine_resolution == 0.9
    (tmp_path / settings.FILE).write_text("not = = toml")
    assert settings.load_settings(tmp_path) == settings.Settings()
    (tmp_path / ".env").write_text("SKEIN_A='one'\nSKEIN_B=two\n# c\n")
    monkeypatch.setenv("SKEIN_B", "kept")
    monkeypatch.delenv("SKEIN_A", raising=False)
    (tmp_path / "inner").mkdir()
    assert settings.load_env(tmp_path / "inner") == tmp_path / ".env"
    assert os.environ.pop("SKEIN_A") == "one" and os.environ["SKEIN_B"] == "kept"


def test_init_config_command(tmp_path):
    assert cli.main(["init-config", str(tmp_path)]) == 0 and (tmp_path / settings.FILE).exists()


def test_commands(spark, root, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["-q", "status", str(root), "--out", out]) == 0
    assert json.loads(capsys.readouterr().out)["needs_rebuild"]
    assert cli.main(["-q", "build", str(root), "--out", out, "--no-cluster"]) == 0
    assert "community" not in spark.read.parquet(f"{out}/nodes").columns
    assert cli.main(["-q", "cluster", "--out", out]) == 0
    assert spark.read.parquet(f"{out}/nodes").filter("community is null").count() == 0
    capsys.readouterr()
    assert cli.main(["-q", "query", "what is Account", "--out", out]) == 0
    assert "Account —contains—> check_password()" in capsys.readouterr().out


def kinds(facts):
    return [(r["kind"], r.get("label")) for r in facts.rows]


class Model:
    name = "fake"

    def read_text(self, text):
        return {"entities": [{"name": "Login", "type": "concept"}, {"name": None}], "relations": [{"source": "Login", "target": "User", "relation": "of"}]}

    def read_image(self, image, media_type):
        return {"entities": [{"name": "check_password"}] if image != b"empty" else []}

    def transcribe(self, content):
        return [{"start": 61.5, "text": "hello"}] if content else []

    def key_frames(self, content):
        return [b"1", b"2"] if content else []


def test_pictures():
    assert extract.image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 16, 8)) == {"width": 16, "height": 8, "format": "PNG"}
    assert extract.image_size(b"GIF89a" + struct.pack("<HH", 3, 4))["height"] == 4
    assert extract.image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 5, 7) + b"\0" * 9) == {"width": 7, "height": 5, "format": "JPEG"}
    assert extract.image_size(b"nonsense") == {}
    assert kinds(extract.image_facts("a.png", b"", "image/png"))[-1] == ("incomplete", None)
    assert ("node", "check_password") in kinds(extract.image_facts("a.png", b"x", "image/png", Model()))
    assert ("incomplete", None) in kinds(extract.image_facts("a.png", b"empty", "image/png", Model()))


def test_pdf_and_video():
    assert kinds(extract.pdf_facts("a.pdf", " ")) == [("node", "a.pdf")]
    assert ("incomplete", None) in kinds(extract.pdf_facts("a.pdf", "text"))
    rows = extract.pdf_facts("a.pdf", "text", Model()).rows
    assert [r["target"] for r in rows if r["kind"] == "edge"] == ["a_pdf_login", "a_pdf_user"]
    assert ("incomplete", None) in kinds(extract.video_facts("a.mp4", b"x"))
    seen = kinds(extract.video_facts("a.mp4", b"x", Model()))
    assert ("node", "hello") in seen and seen.count(("node", "check_password")) == 1
    assert kinds(extract.video_facts("a.mp4", b"", Model()))[-1][1].startswith("[neither")


def test_providers(monkeypatch):
    from skein.sources import providers

    monkeypatch.setattr(providers, "_FACTORIES", {})
    providers.register("far", "SKEIN_FAR", lambda model, vision: ("far", model, vision))
    providers.register("near", "SKEIN_NEAR", lambda model, vision: ("near", model, vision), local=True)
    assert providers.choose(False) is None
    monkeypatch.setenv("SKEIN_NEAR", "1")
    monkeypatch.setenv("SKEIN_FAR", "1")
    assert providers.choose(False, "m")[:2] == ("far", "m") and providers.choose(True)[0] == "near"

    waits, answers = [], [providers.Busy(3), providers.Busy(5), "done"]

    def call():
        if isinstance(answers[0], Exception):
            raise answers.pop(0)
        return answers[0]

    assert providers.patiently(call, sleep=waits.append) == "done" and waits == [3, 5]
    answers[:] = [providers.Busy()] * 3
    with pytest.raises(providers.Busy):
        providers.patiently(call, sleep=waits.append)
    assert providers.describe_image(Model(), b"", "image/png") is None

    class Namer:
        name = "n"

        def link_names(self, names, candidates):
            return {"a": "real", "b": "invented"}

        def name_group(self, labels):
            return " Payments "

    assert providers.link_one(Namer(), "a", {"real": "1"}) == "real" and providers.link_one(Namer(), "b", {"real": "1"}) is None
    assert providers.group_name(Namer(), ["x", "y"]) == "Payments" and providers.group_name(Namer(), ["x"]) is None


def test_graph_file_round_trip_and_page(spark, tmp_path):
    from skein.sinks import export

    nodes = spark.createDataFrame([("a", "</script><b>", "code", "f", 1), ("b", "B", "document", "g", 2)], "id string, label string, modality string, source_file string, seq long")
    edges = spark.createDataFrame([("a", "b", "calls", "EXTRACTED", "f", 1), ("a", "b", "uses", "EXTRACTED", "f", 2)], "source string, target string, relation string, confidence string, source_file string, seq long")
    out = str(tmp_path / "graph")
    export.export(nodes, edges, out)
    again, links = export.from_json(spark, f"file://{out}/graph.json")
    assert {r.id for r in again.collect()} == {"a", "b"} and {(r.key, r.relation) for r in links.collect()} == {(0, "calls"), (1, "uses")}
    page = open(f"{out}/graph.html").read()
    assert "</script><b>" not in page and page.count("</script>") == 3
    assert "- code: 1" in open(f"{out}/REPORT.md").read()


def test_document_with_provider():
    rows = extract.document_facts("a.md", "# T\r\n`f` and `g`\n", Model()).rows
    assert [r["name"] for r in rows if r["kind"] == "mention"] == ["f", "g"]
    assert [r["name"] for r in rows if r["kind"] == "concept"] == ["Login"]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    df = catalog.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    columns = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {names} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_graph_json_holds_all_of_a_large_graph(spark, tmp_path):
    from skein.sinks import export

    nodes = spark.range(10_000).selectExpr("concat('n', id) AS id", "concat('label </', id) AS label", "'code' AS modality", "'f' AS source_file", "CAST(NULL AS STRING) AS source_location", "id AS seq")
    edges = spark.range(30_000).selectExpr("concat('n', id % 10000) AS source", "concat('n', (id * 7 + 1) % 10000) AS target", "'calls' AS relation", "'EXTRACTED' AS confidence", "'f' AS source_file", "id AS seq")
    export.write_json(nodes, edges, f"{tmp_path}/graph.json")
    whole = json.loads(open(f"{tmp_path}/graph.json").read())
    assert [n["id"] for n in whole["nodes"]] == [f"n{k}" for k in range(10_000)] and len(whole["edges"]) == 30_000
    assert whole["nodes"][0]["source_location"] is None and whole["directed"] and whole["multigraph"]
    again, links = export.from_json(spark, f"file://{tmp_path}/graph.json")
    assert again.count() == 10_000 and links.count() == 30_000
    export.write_json(nodes.limit(0), edges.limit(0), f"{tmp_path}/empty.json")
    assert json.loads(open(f"{tmp_path}/empty.json").read())["nodes"] == []
    shown = export.graph_dict(nodes, edges)
    assert shown["graph"]["left_out"] == {"nodes": 5000, "edges": 30_000 - len(shown["edges"])}


def test_what_must_stay_here_is_not_sent(spark, tmp_path):
    """Labels and facts of files in a sensitive folder go to local providers only."""

    class Far:
        name, sent = "far", []

        def link_names(self, names, candidates):
            Far.sent.append(("link", list(candidates)))
            return {}

        def name_group(self, labels):
            Far.sent.append(("group", list(labels)))
            return "Named"

        def answer(self, question, context):
            Far.sent.append(("answer", context))
            return "answered"

    class Near(Far):
        name, local = "near", True

    files = {"src/vault.py": "def open_vault():\n    return helper_one()\ndef helper_one():\n    return open_vault()\n", "secret/plan.md": "# Midnight\n## Heist\nSee `open_vault`.\n"}
    for name, text in files.items():
        path = tmp_path / "project" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    out = str(tmp_path / "out")
    nodes, _ = project.build(spark, str(tmp_path / "project"), out, provider=Far())
    assert {r.source_file for r in nodes.filter("force_local").collect()} == {"secret/plan.md"}
    for provider, known in ((Far(), False), (Near(), True)):
        assert project.query(spark, out, "what does open_vault do", provider) == "answered"
        context = Far.sent[-1][1]
        assert "open_vault()" in context and ("plan.md" in context) == known
    text = repr([x for x in Far.sent if x[0] != "answer"])
    assert "open_vault" in text and "Midnight" not in text and "Heist" not in text
    with open(f"{out}/graph.html") as page:
        assert "left_out" in page.read()
