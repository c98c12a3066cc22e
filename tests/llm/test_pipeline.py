"""The pipeline's stages on awkward rows, and as a whole."""

import numpy as np
import pytest

import corpus_pipeline as pipeline
from skein.llm import bpe


def test_stages_keep_columns_and_stand_awkward_rows(spark, awkward, empty, tmp_path):
    for docs, name in ((awkward, "a"), (empty, "e")):
        columns = docs.columns
        for k, (_, stage) in enumerate(pipeline.STAGES):
            before = docs.count()
            stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"file://{tmp_path}/{name}{k}")
            assert docs.count() <= before
            assert k == len(pipeline.STAGES) - 1 or docs.columns == columns


def test_run(spark):
    rows = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.decodes for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    own = bpe.load(bpe.vocabulary_path())
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.n_tokens and own.decode(r.ids) for r in rows[:20])


def brute_run(rows):
    """The pipeline's rows without Spark: {doc_id: (source, lang, ids)} of the documents that are left."""
    import hashlib

    from test_operators import WORD, brute_lines, brute_quality
    from test_similar_texts import by_prints
    from tokenizers import Tokenizer

    from skein.llm import mixing, quality

    hosts = {}
    for r in rows:
        hosts.setdefault(r["source"] or "", []).append(brute_quality(r["text"])[-1])
    n = sum(map(len, hosts.values()))
    mean = sum(map(sum, hosts.values())) / n
    spread = sum(len(v) * (sum(v) / len(v)) ** 2 for v in hosts.values()) / n - mean * mean - mean * (1 - mean) * len(hosts) / n
    weight = min(quality.PRIOR_TO, max(quality.PRIOR_FROM, mean * (1 - mean) / spread - 1)) if spread > 0 else quality.PRIOR_TO
    good = {h for h, v in hosts.items() if (sum(v) + mean * weight) / (len(v) + weight) <= quality.MAX_RATE}
    rows = [r for r in rows if not brute_quality(r["text"])[-1] and (r["source"] or "") in good]

    left = {d: t for d, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in rows])}
    rows = [{**r, "text": left[r["doc_id"]]} for r in rows]

    groups, first = by_prints([r["text"] for r in rows]), {}
    for r, g in zip(rows, groups, strict=True):
        if g not in first or r["doc_id"] < first[g]["doc_id"]:
            first[g] = r
    rows = list(first.values())

    def topic(t):
        low = t.lower()
        return "empty" if not t else "legal" if "license" in low or "copyright" in low else "contact" if "@" in t else "figures" if any(t[k : k + 3].isascii() and t[k : k + 3].isdigit() and len(t[k : k + 3]) == 3 for k in range(len(t))) else "prose"

    cells = {}
    for r in rows:
        r["cell"] = (r["source"] or "", r["lang"] or "", topic(r["text"]))
        cells[r["cell"]] = cells.get(r["cell"], 0) + len(WORD.findall(r["text"]))
    total = sum(cells.values())
    share = {c: x / total for c, x in cells.items()}
    weights = dict(share)
    targets = []
    for k in range(3):
        own = {}
        for c, x in share.items():
            own[c[k]] = own.get(c[k], 0) + x
        raw = {v: x**mixing.TEMPER for v, x in own.items()}
        targets.append({v: x / sum(raw.values()) for v, x in raw.items()})
    gap = float("inf")
    while True:
        for k in [0, 1, 2] * mixing.SWEEPS:
            now = {}
            for c, x in weights.items():
                now[c[k]] = now.get(c[k], 0) + x
            weights = {c: x * targets[k][c[k]] / now[c[k]] if now[c[k]] else 0 for c, x in weights.items()}
        before, gap = gap, max(abs(sum(x for c, x in weights.items() if c[k] == v) - t) for k in range(3) for v, t in targets[k].items())
        if gap <= mixing.TOLERANCE or gap > 0.99 * before:
            break
    ratio = {c: weights[c] / share[c] if share[c] else 0 for c in share}
    low, high = 0.0, 1e9
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(share[c] * min(1, ratio[c] * middle) for c in share) < pipeline.BUDGET else (low, middle)
    draw = lambda d: int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) / 2**52
    rows = [r for r in rows if draw(r["doc_id"]) < min(1, ratio[r["cell"]] * high)]

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {r["doc_id"]: (r["source"], r["lang"], library.encode(r["text"], add_special_tokens=False).ids) for r in rows}


def test_run_equals_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.source, r.lang, np.frombuffer(r.ids, "<u4").tolist()) for r in pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_run(docs)


def test_queries_and_sql_have_equal_names():
    from skein.llm import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", ["op1_", "op2_", "op4_", "op5_", "op6_", "op7_", "op8_", "op13_"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from skein.llm import registry

    (key,) = [k for k in registry.queries() if k.startswith(name)]
    df = registry.queries()[key](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    names = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {names} FROM ({registry.oracle_sql()[key]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))
