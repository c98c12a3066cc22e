"""Each operator against a brute-force version on small tables with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, line_dedup, lm_scoring, mixing, mtree, quality, sharding, simhash, suffix_array, suffix_dedup, warc
from skein.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_walk():
    keys = np.array([0, 1, 2, 10, 2**63, 2**64 - 1, 123456789], np.uint64)
    for n in (1, 2, 8, 100):
        at, grown = sharding.jump_hash(keys, n)
        assert at.tolist() == [jump(int(k), n) for k in keys]
        assert grown.tolist() == [jump(int(k), n + 1) for k in keys]


def test_shards(awkward, empty):
    rows = sharding.assign_shards(awkward, 4).collect()
    texts = Counter((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in awkward.collect())
    assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in rows) == texts
    for r in rows:
        assert r["shard"] == jump((r.doc_id or 0) % 2**64, 4) and r.grown_shard in (r["shard"], 4) and r.law == "key"
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign_shards(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(empty, 0)


# WARC


def test_archive_round_trip(spark, tmp_path):
    big = "<html>" + "é" * 60
    rows = [(3, "http://a/\r\nx", big), (1, None, big), (1, None, big), (2, "u", "tiny"), (5, "u", "tiny"), (7, "u", None), (8, "u", ""), (None, "v", big), (None, None, "<p>" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/a")
    out = warc.read_archive(spark, f"file://{tmp_path}/a").collect()
    got = Counter((r.page_id, bytes(r.payload), r.payload_digest, r.record_type, r.refers_to) for r in out)
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if h == html and p is not None), default=None)
        whole = len(data) < 100 or page == first
        want[page, data, sha(data), "response" if whole else "revisit", None if whole else first] += 1
    assert got == want
    for r in out:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert body[:-4] == (bytes(r.payload) if r.record_type == "response" else b"")
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == len({h or "" for _, _, h in rows})
    for r in out:
        head = bytes(r.record).partition(b"\r\n\r\n")[0].decode().split("\r\n")
        names = [line.split(": ")[0] for line in head[1:]]
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(names) and len(names) == len(set(names))
        assert ("Content-Type" in names) == (r.record_type == "response")
    warc.write_archive(spark.createDataFrame([(1, "http://a/\u2028b\x85c", "h")], pages.schema), f"file://{tmp_path}/u")
    assert [r.url for r in warc.read_archive(spark, f"file://{tmp_path}/u").collect()] == ["http://a/\u2028b\x85c"]
    hot = spark.range(400).selectExpr("id AS page_id", "cast(null AS string) AS url", f"if(id % 3 = 1, '{'x' * 200}', concat('{'y' * 200}', id)) AS html")
    warc.write_archive(hot, f"file://{tmp_path}/h")
    kinds = Counter((r.record_type, r.refers_to) for r in warc.read_archive(spark, f"file://{tmp_path}/h").collect())
    assert kinds == {("response", None): 268, ("revisit", 1): 132}
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archive(spark, f"file://{tmp_path}/b").count() == 0


def test_damaged_archive_is_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/c")
    broken = spark.read.parquet(f"file://{tmp_path}/c/payloads").withColumn("payload", F.lit(b"other"))
    broken.collect()
    broken.write.parquet(f"file://{tmp_path}/d/payloads")
    spark.read.parquet(f"file://{tmp_path}/c/headers").write.parquet(f"file://{tmp_path}/d/headers")
    with pytest.raises(Exception, match="archive damaged"):
        warc.read_archive(spark, f"file://{tmp_path}/d").collect()


# BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("fragment", [0, 1, 3, 2048])
def test_bpe_equals_the_library(library, fragment):
    import random

    own = bpe.ForcedBoundaryBpe(bpe.vocabulary_path(), fragment=fragment)
    draw = random.Random(fragment)
    texts = ["".join(draw.choice("ab 's\n\t éà日1! \x1c<|>\xa0 \x85.") for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    # letters of every age: the library's Unicode tables decide
    texts += [f"a{c}1{c}!{c}{c}b" for c in map(chr, [0x558, 0x88F, 0x208F, 0x3FC3F, *range(0x80, 0xD800, 97), *range(0xE000, 0x110000, 1999)])]
    texts += ["日本語" * 2000 + "a" * 5000, " !" * 3000, "<|endoftext|>x<|endoftext|>", "", " \n \n x"]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_cuts_at_forced_pairs(library):
    own = bpe.load(bpe.vocabulary_path())
    pieces = ["Ġthe", "qxzj" * 30, "日本語のテキスト", "!!??;;--", "ĠZvxqk"]
    for piece in ["".join(p for p, _ in library.pre_tokenizer.pre_tokenize_str(x)) for x in pieces] + pieces[:1]:
        cut = own.fragments(piece)
        assert "".join(cut) == piece
        assert all(a[-1] + b[0] not in own.inside for a, b in zip(cut, cut[1:], strict=False))
        assert all(x[k : k + 2] in own.inside for x in cut for k in range(len(x) - 1))
        assert [k for x in cut for k in own.merged(x)] == own.merged(piece)
    assert len(own.fragments("qxzj" * 30)) > 30


def test_bpe_on_rows(awkward, empty, library):
    out = bpe.decode(bpe.encode(awkward))
    assert out.columns == [*awkward.columns, "ids", "n_tokens", "decoded"]
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == (r.text or "")
    assert sorted(map(repr, bpe.round_trip(awkward).collect())) == sorted(map(repr, out.collect()))
    assert bpe.encode(empty).count() == 0
    broken = bpe.load(bpe.vocabulary_path())
    half = np.array([broken.tokens.index(b"\xc3")], "<u4").tobytes()
    assert broken.decode(half) == "�"


# mixing


def test_raking_meets_its_targets(spark, empty):
    cells = [("a", "en", "x", 600), ("a", "de", "x", 200), ("b", "en", "y", 100), ("b", "de", "x", 70), ("b", "en", "x", 25), ("a", "de", "y", 5)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.25, "b": 0.25, "none": 0.5}, "lang": {"en": 0.4, "de": 0.6}, "topic": {"x": 0.7, "y": 0.3}}
    rows = mixing.raked(df, targets=targets).collect()
    for d, want in (("source", {"a": 0.5, "b": 0.5}), ("lang", targets["lang"]), ("topic", targets["topic"])):
        for value, share in want.items():
            assert abs(sum(r.weight for r in rows if r[d] == value) - share) < 1e-6
    done = mixing.calibrated(mixing.raked(df), 0.6).collect()
    assert all(0 < r.probability <= 1 for r in done)
    assert abs(sum(r.tokens * r.probability for r in done) - 0.6 * 1000) < 1e-6
    assert mixing.mixed(empty).count() == 0


def test_raking_goes_on_until_shares_are_met(spark, caplog):
    """Cells that hang together by thin threads take far more than one round of sweeps; targets that no weights fit end with a warning."""
    cells = [("a", "x", "t", 10_000), ("a", "y", "t", 1), ("b", "x", "t", 1), ("b", "y", "t", 10_000)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.8, "b": 0.2}, "lang": {"x": 0.3, "y": 0.7}, "topic": {"t": 1.0}}
    rows = mixing.raked(df, targets=targets).collect()
    for place, name in enumerate(("source", "lang")):
        for value, share in targets[name].items():
            assert sum(r["weight"] for r in rows if r[place] == value) == pytest.approx(share, abs=2 * mixing.TOLERANCE)
    assert not caplog.records
    apart = spark.createDataFrame([c for c in cells if c[3] > 1], df.schema)
    mixing.raked(apart, targets=targets)
    assert "off its target" in caplog.text


def test_mixing_keeps_rows_and_draws(awkward):
    one, two = (sorted(map(repr, mixing.mixed(awkward, 0.5).collect())) for _ in range(2))
    assert one == two and mixing.mixed(awkward, 0.5).columns == awkward.columns
    whole = mixing.mixed(awkward, 1.0)
    assert whole.filter(F.char_length("text") > 20).count() == awkward.filter(F.char_length("text") > 20).count()


# suffix arrays


def brute_removed(texts, length):
    seen = Counter()
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((bytes(c for c, g in zip(t, gone, strict=True) if not g), [tuple(x) for x in edge.reshape(-1, 2).tolist()]))
    return out


def test_suffix_array_and_prefixes():
    draw = np.random.default_rng(5)
    for _ in range(1500):
        text = draw.integers(0, draw.integers(1, 6), draw.integers(0, 40))
        order = suffix_array.suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        common = suffix_array.permuted_lcp(text, order)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert common[b] == n


@pytest.mark.parametrize("shard_bytes", [1 << 20, 0])
def test_removed_repeats_equal_brute_force(spark, awkward, empty, monkeypatch, shard_bytes):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)  # 0: every shared key goes the way for the largest
    draw = np.random.default_rng(1)
    base = "".join(draw.choice(list("abcé "), 900))
    texts = [base, base[100:700], "q" + base[:500] + "z", base[300:] + base[:300], "ab" * 300, "ab" * 200 + "!" + "ab" * 150, None, "", base[:69], "x" * 800]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, base[50:400]), (0, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit(1), "spans": F.lit("s")})
    for length, gram in ((60, 20), (100, 32)):
        done = suffix_dedup.remove_repeats(df, length, gram).collect()
        data = [(d, (t or "").encode()) for d, t in rows]
        want = Counter((d, *map(str, x)) for (d, _), x in zip(data, brute_removed([t for _, t in data], length), strict=True))
        assert Counter((r.doc_id, str(bytes(r.kept)), str([tuple(x) for x in r.runs])) for r in done) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_removed_repeats_of_awkward_rows(awkward):
    rows = [(r.doc_id, (r.text or "").encode()) for r in awkward.collect()]
    want = Counter((d, str(x[0])) for (d, _), x in zip(rows, brute_removed([t for _, t in rows], 400), strict=True))
    assert Counter((r.doc_id, str(bytes(r.kept))) for r in suffix_dedup.remove_repeats(awkward).collect()) == want


def test_segments_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    draw = np.random.default_rng(2)
    base = bytes(draw.integers(97, 101, 4000).astype(np.uint8))
    texts = [base, base[500:2600] + b"x" + base[3000:], base[:90], b"", base[:79], b"ab" * 400]
    windows, keys = Counter(), defaultdict(set)
    for numbers, offsets, ends, data in suffix_dedup._blocks(texts, 80):
        for key, start, end, place in zip(*suffix_dedup.segments_of(data, ends, 80, 24), strict=True):
            own = int(np.searchsorted(ends, start, side="right"))
            first = start - (ends[own - 1] if own else 0) + offsets[own]
            for k in range(end - start - 79):
                windows[numbers[own], first + k] += 1
                text = texts[numbers[own]][first + k : first + k + 80]
                keys[text].add((int(key), int(place - start - k)))
                assert len(text) == 80 and 0 <= place - start - k <= 56
    assert windows == Counter((n, k) for n, t in enumerate(texts) for k in range(len(t) - 79))
    assert all(len(v) == 1 for v in keys.values())  # equal windows have equal keys, at equal places


def test_very_long_texts(spark):
    draw = np.random.default_rng(3)
    long, other = ("".join(map(chr, draw.integers(97, 123, n))) for n in (2_500_000, 5_000))
    rows = [(1, long), (2, other + long[1_000_000:2_200_000] + other[::-1])]
    done = {r.doc_id: [tuple(x) for x in r.runs] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert done == {1: [(1_000_000, 2_200_000)], 2: [(5_000, 1_205_000)]}


# search


def test_top_k_equals_brute_force(spark):
    draw = np.random.default_rng(3)
    few = [draw.normal(size=6).astype(float).tolist() for _ in range(40)]
    rows = [(k, few[draw.integers(0, 40)] if k % 3 else draw.normal(size=6).tolist()) for k in range(400)]
    rows += [(900, None), (901, [float("nan")] * 6), (902, [1.0] * 5 + [None]), (903, [float("inf")] * 6), (None, few[0]), (950, [0.5, 0.5]), (951, [0.5, 0.1]), (960, []), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    vectors = mtree.integer_vectors(df)
    index = mtree.build_index(vectors, shard_rows=150)
    done = mtree.search(index, vectors.filter("id % 50 = 0")).collect()
    good = {k: [math.floor(256 * x) for x in v] for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), k) for k, v in good.items() if k != q and len(v) == len(good[q]))
            want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(scores[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in done} == want
    assert mtree.search(mtree.build_index(vectors.limit(0)), vectors.limit(0)).count() == 0


def test_tree_leaves_out_pages():
    draw = np.random.default_rng(4)
    centres = draw.integers(-200, 200, (12, 8))
    vectors = np.repeat(centres, 60, axis=0) + draw.integers(-3, 4, (720, 8))
    tree = mtree.Tree(vectors, np.arange(720), 6, page=16, fanout=4)
    for q in range(0, 720, 37):
        scores = sorted((-int(vectors[k] @ vectors[q]), k) for k in range(720) if k != q)[:5]
        assert tree.search(vectors[q : q + 1], np.array([q]), 5) == [(q, k, -s) for s, k in scores]


# lines


def brute_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(2**63 - 1 if d is None else d)
    out = []
    for d, t in rows:
        own, lines = 2**63 - 1 if d is None else d, (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == own]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(awkward, empty):
    done = line_dedup.apply_bitmaps(awkward, line_dedup.keep_bitmaps(awkward))
    want = Counter(brute_lines([(r.doc_id, r.text) for r in awkward.collect()]))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in done.collect()) == want
    left = line_dedup.drop_lines(awkward)
    assert left.columns == awkward.columns
    assert line_dedup.drop_lines(empty).count() == 0


def test_bitmaps_are_runs(spark):
    lines = [f"a line that is shared {k}" for k in range(6)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["mine alone, this one", lines[0], lines[1], "short", lines[4], "another of my own"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    (one,) = line_dedup.keep_bitmaps(df).collect()
    assert one["doc"] == 2 and one.n_dropped == 3 and [tuple(x) for x in one.runs] == [(1, 2), (1, 1)]


def test_first_occurrences_cross_borders_of_ranges(spark):
    """Hashes that fill whole ranges, begin inside one or end at a border; documents' order is not the rows' order."""
    import random

    draw = random.Random(2)
    rows = [(h, h + 1, d, 7, p) for h, docs in ((5, 200), (6, 1), (7, 3), (8, 150), (9, 40)) for d in draw.sample(range(10**6), docs) for p in range(draw.randint(1, 3))]
    rows += [(h, h + 1, -h, 7, 0) for h in range(1000, 1100)]
    draw.shuffle(rows)
    least = {}
    for h, _, d, _, _ in rows:
        least[h] = min(least.get(h, d), d)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "h1 long, h2 long, doc long, text_hash long, pos int").repartition(5)
        got = Counter(map(tuple, line_dedup.later_occurrences(df).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == Counter(r for r in rows if r[2] > least[r[0]])


# quality


def brute_quality(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = len({i + k for i, w in enumerate(windows) if w in often for k in range(3)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated, failed


def test_quality_counts(awkward, empty):
    done = quality.features(awkward).collect()
    names = [*quality.COUNTS, "base_failed"]
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in done) == Counter((r.doc_id, *brute_quality(r.text)) for r in awkward.collect())
    assert quality.kept_documents(empty).count() == 0
    kept = quality.kept_documents(awkward)
    assert kept.columns == awkward.columns and all(not brute_quality(r.text)[-1] for r in kept.collect())


def test_hosts_that_mostly_fail_are_rejected(spark):
    good = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(200)]
    rows = [(k, t, "good") for k, t in enumerate(good[:100])] + [(100 + k, "too short", "bad") for k in range(100)] + [(300, good[150], "bad"), (301, good[151], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.kept_documents(df).collect()}
    assert kept == {*range(100), 301}


# SimHash


def brute_print(text, size=3):
    import xxhash

    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_rows(awkward, empty):
    rows = awkward.collect()
    prints = [brute_print(r.text) for r in rows]
    groups = brute_groups(prints, 3)
    least = {g: min((r.doc_id for r, h in zip(rows, groups, strict=True) if h == g and r.doc_id is not None), default=None) for g in groups}
    want = Counter((r.doc_id, p, least[g]) for r, p, g in zip(rows, prints, groups, strict=True))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.grouped(awkward).collect()) == want
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(groups))
    assert {r.doc_id for r in kept.collect()} == set(least.values())
    assert simhash.grouped(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("tile", [4096, 5])
def test_links_equal_all_pairs(spark, tile):
    import random

    draw = random.Random(tile)
    prints = [draw.getrandbits(64) for _ in range(60)]
    for p in prints[:25]:
        q = p
        for _ in range(12):  # chains of near ones
            q ^= sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 4)))
            prints.append(q % 2**64)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, 0) for p in prints], "fp long, n long").withColumn("w0", F.col("fp"))
    found = components(simhash.links(df, tile=tile)).collect()
    root = {r.a: r.root for r in found}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    groups = brute_groups(prints, 3)
    by_root, by_group = defaultdict(set), defaultdict(set)
    for s, g in zip(signed, groups, strict=True):
        by_root[root.get(s, s)].add(s)
        by_group[g].add(s)
    assert {frozenset(v) for v in by_root.values()} == {frozenset(v) for v in by_group.values()}


def test_components_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    done = {r.a: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert done == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


# language models


@pytest.mark.parametrize(("chunk_bytes", "part_grams"), [(8 << 20, 4 << 20), (3000, 400)])
def test_scores_equal_counts_by_dictionary(spark, awkward, empty, chunk_bytes, part_grams):
    """A target document's own counts are not in the target that it is scored by."""
    labels = spark.createDataFrame([(3, 1), (5, 1), (5, 0), (7, 1), (8, 0), (None, 1), (9, None), (777, 1)], "doc_id long, quality int")
    rows = awkward.collect()
    words = {r.text: WORD.findall(lower(r.text or "")) for r in rows}
    vocabulary = len({w for own in words.values() for w in own})

    def counts(own):
        single, pairs = Counter(), Counter()
        for t in own:
            single.update(words[t])
            pairs.update(zip(words[t], words[t][1:], strict=False))
        return single, pairs

    every = [counts([r.text for r in rows]), counts([r.text for r in rows if r.doc_id in (3, 5, 7)])]

    def losses(text, good):
        mine = counts([text] * good)
        (a, b), (c, d) = every[0], (every[1][0] - mine[0], every[1][1] - mine[1])
        n, w = sum(c.values()), words[text]
        for single, pairs, scale in ((a, b, n / sum(a.values())), (c, d, 1)):
            one = [(scale * single[x] + lm_scoring.ALPHA) / (n + lm_scoring.ALPHA * vocabulary) for x in w]
            both = [(scale * pairs[w[i - 1], w[i]] + lm_scoring.MU * one[i]) / (scale * single[w[i - 1]] + lm_scoring.MU) for i in range(1, len(w))]
            yield -sum(map(math.log, one[:1] + both)) / len(w)

    done = lm_scoring.score(awkward, labels, chunk_bytes, part_grams)
    assert done.columns == [*[c for c in awkward.columns if c != "n_words"], "n_words", "target_loss", "background_loss", "score"]
    got = done.collect()
    assert Counter((r.doc_id, r.text, r.key, r.size) for r in got) == Counter((r.doc_id, r.text, r.key, r["size"]) for r in rows)
    for r in got:
        assert r.n_words == len(words[r.text])
        if r.n_words:
            background, target = losses(r.text, r.doc_id in (3, 5, 7))
            assert r.target_loss == pytest.approx(target) and r.background_loss == pytest.approx(background) and r.score == pytest.approx(background - target)
        else:
            assert r.score is None
    assert lm_scoring.score(empty, labels).count() == 0
    assert lm_scoring.score(awkward, labels.limit(0)).count() == awkward.count()


def test_counts_of_any_size_come_back():
    counts = np.array([0, 1, 254, 255, 256, 2**40, 255])
    assert lm_scoring.unsqueezed(lm_scoring.squeezed(counts), 7).tolist() == counts.tolist() and lm_scoring.unsqueezed(b"", 0).tolist() == []


def test_a_word_in_every_chunk_is_one_message_a_chunk(spark):
    """A hot pair and a hot word are sent once by each chunk, however often they come up."""
    df = spark.createDataFrame([(k, "hot pair " * 200) for k in range(300)], "doc_id long, text string")
    rows = lm_scoring.score(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), 20_000, 1000).collect()
    assert len(rows) == 300 and len({round(r.background_loss, 9) for r in rows if r.doc_id != 1}) == 1
    own = lm_scoring.Chunk(["hot pair " * 200] * 50, [False] * 50, lm_scoring.Space(2, 16))
    assert len(own.grams) == 4 and own.total.sum() == 50 * (400 + 399)


def test_scores_tell_kinds_of_text_apart(spark):
    import random

    draw = random.Random(1)
    kinds = [[f"a{k}" for k in range(50)], [f"b{k}" for k in range(50)]]
    rows = [(k, " ".join(draw.choices(kinds[k % 2], k=80))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(200)], "doc_id long, quality int")
    held_out = [(r.score, r.doc_id % 2) for r in lm_scoring.score(df, labels).filter("doc_id >= 200").collect()]
    assert min(s for s, k in held_out if k == 0) > max(s for s, k in held_out if k == 1)


def test_scores_tell_good_from_bad_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    rows = lm_scoring.score(docs.select("doc_id", "text"), labels.filter(half == 0)).join(labels.filter(half == 1), "doc_id").filter("score is not null").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.8
