"""Windows of items in documents, against a search at every place."""

import hashlib
import re

import numpy as np
import pytest
from conftest import PASSAGE, rows_of

from skein.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    """By text: n_words, n_hit, sorted items."""
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(item)
    out = []
    for text in texts:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(own[k : k + size])] - {None}
        out.append((len(own), len(hit), sorted(map(str, found))))
    return out


ITEMS = [
    (1, "Word3 of the passage, word4 OF the passage; word5 of the passage word6"),
    (10, "spam spam spam spam spam spam spam spam spam spam spam spam"),
    (2, "short"),
    (3, "naïve café 日本語"),
    (3, "line number 7 of a long"),  # an id of two texts
    (4, None),
    (5, "!?"),
    (6, "word3 of the passage word4 of the passage word5 of"),  # a window of item 1
    (None, "two words"),
    (7, "not in any of the documents at all or so one would think today"),
    (7, "not in any of the documents at all or so one would think today"),
]
EDGES = ["two words", "x word3 of the passage word4 of the passage word5 of", "word3 of the passage word4 of the passage word5 o", "of the passage word4 of the passage word5 of the passage word6 y", "", "short"]


def test_marks(spark, awkward, empty):
    docs = awkward.union(spark.createDataFrame(rows_of(EDGES, 100), awkward.schema))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in dec.marked(docs, items).collect())
    rows = docs.collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, *b) for r, b in zip(rows, brute([r.text for r in rows], ITEMS), strict=True))
    assert got == want and any(r[3] for r in got) and any(r[4] == ["1", "6"] for r in got)
    left = dec.clean(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(repr, left.collect())) == sorted(repr(r) for r, b in zip(rows, brute([r.text for r in rows], ITEMS), strict=True) if not b[1])
    assert dec.marked(empty, items).count() == 0
    assert {(r.n_hit, len(r["items"])) for r in dec.marked(docs, items.limit(0)).collect()} == {(0, 0)}


def test_a_very_common_window(spark):
    texts = [f"a{k} " + PASSAGE + f" b{k}" if k % 3 == 0 else f"other text number {k} of many" for k in range(600)]
    docs = spark.createDataFrame(rows_of(texts), "doc_id long, text string, lang string, source string, n_chars long, key string, size int, _words string, runs string, host string, _source string, doc string, row string, n_words string")
    items = [(k, PASSAGE) for k in range(3)] + [(9, "text number")]
    got = {r.doc_id: (r.n_hit, r["items"]) for r in dec.marked(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: (n, found) for k, (_, n, found) in enumerate(brute(texts, items))}


def test_bitmap_loses_no_hash(spark, monkeypatch):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    frame = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    for most in (dec.MOST_BITS, 1 << 12):  # full or not
        monkeypatch.setattr(dec, "MOST_BITS", most)
        assert len(dec._may_hold(dec.bitmap(frame), hashes.view(np.uint64))) == len(hashes)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_its_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf{sf}/{t}.parquet'")
    df = dec.op13_prefix_filtered_windows(spark, f"/root/testdata/sf{sf}")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({dec.SQL})").fetchall()
    got = list(map(tuple, df.collect()))
    assert sorted(got) == sorted(want) and any(r[-1] for r in got)
    assert {r[4] for r in got if not r[3]} == {hashlib.sha256(b"").hexdigest()}
