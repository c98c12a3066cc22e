"""Two tokenizers' tokens on the same bytes, against dictionaries."""

import hashlib
import json
import random
from collections import Counter
from pathlib import Path

import pytest
from conftest import rows_of

from skein.llm import alignment


def brute(texts):
    """By text: n_a, n_b, n_groups, n_links, n_best, count_sum, digest."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}

    def b_bytes(k):
        piece = two.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(k) else piece.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        pa = [bytes(byte_of[c] for c in one.id_to_token(k)) for k in a]
        pb = [b_bytes(k) for k in b]
        if b"".join(pa) != whole or b"".join(pb) != whole:
            rows.append(([], [], [], []))
            continue
        ends_a, ends_b = {}, {}
        for ids, pieces, ends in ((a, pa, ends_a), (b, pb, ends_b)):
            at = 0
            for k, (_, p) in enumerate(zip(ids, pieces, strict=True)):
                at += len(p)
                ends[at] = k
        groups, links, i, j = [], [], 0, 0
        for at in sorted(ends_a.keys() & ends_b.keys()):
            groups.append(",".join(map(str, a[i : ends_a[at] + 1])) + "|" + ",".join(map(str, b[j : ends_b[at] + 1])))
            i, j = ends_a[at] + 1, ends_b[at] + 1
            links.append((a[i - 1], b[j - 1]))
        counts.update(links)
        rows.append((a, b, groups, links))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [(len(a), len(b), len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, x in rows]


ODD = ["▁a▁", "é ﬁ 　x", " lead", "trail ", "a  b   c", "<s>x</s><unk><0x41>", "\x00\x01", "\U0001f642՘࢏₏", "<|endoftext|>", "ẞİ"]


def digest(rows):
    return Counter((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(";".join(r.groups).encode()).hexdigest() if r.groups else "") for r in rows)


@pytest.mark.parametrize("hot", [1 << 17, 40, 0])
def test_links_and_groups(spark, awkward, empty, hot):
    more = spark.createDataFrame(rows_of(ODD, 100), awkward.schema)
    docs = awkward.union(more)
    out = alignment.align(docs, hot=hot)
    rows = out.collect()
    assert digest(rows) == Counter(brute([r.text for r in docs.collect()]))
    assert {"key", "row", "_words", "doc_id"} <= set(out.columns) and "text" not in out.columns
    assert alignment.align(empty).count() == 0


def test_ids_of_either_way_agree():
    both = alignment.load(*alignment.paths())
    texts = [*ODD, " \n\n  \t x", "naïve café's 12345", "x" * 3000]
    for text in texts:
        if not text.isascii() and max(text) >= alignment.AGREED:
            continue
        assert both.a_ids(text).tolist() == both.library.encode(text, add_special_tokens=False).ids
    assert all(len(both.encode(x)[0]) for x in (" " * 100_000, "ab" * 100_000))


def test_parts_give_the_tokens_of_whole_texts_and_are_read_once(monkeypatch):
    both = alignment.Pair(*alignment.paths())
    odd = random.Random(1)
    chars = [*"ab  \n\n\t\r;)'1\x0b\x0c\x1c\x85\xa0\u3000\u2581é日ß\u0301\u200b\u180e\x00", " the", "\U0001f642", " word" * 20]
    texts = [*ODD, "", " ", " \n\n  \t x", "x" * 3000, *("".join(odd.choices(chars, k=odd.randrange(1, 30))) for _ in range(3000))]
    shown = lambda found: [(a.tolist(), b.tolist()) for a, b in found]
    whole = shown(map(both._whole, texts))
    assert sum(bool(a) for a, _ in whole) > 1000
    monkeypatch.setattr(alignment, "TOGETHER", 200)
    for kept in (1 << 20, 300):
        monkeypatch.setattr(alignment, "KEPT", kept)
        assert shown(x for k in range(0, len(texts), 64) for x in both.encode_all(texts[k : k + 64])) == whole
        assert len(both.known) <= kept or kept == 1 << 20
    read, learn = [], both._learn
    monkeypatch.setattr(both, "_learn", lambda parts: (read.extend(parts), learn(parts)))
    both.encode_all(["new words here, new words"] * 3)
    both.encode_all(["here, new words"])
    assert len(read) == len(set(read)) and {" new", " words", " here,"} >= set(read)


def test_tokens_come_as_sorted_longs(spark):
    row = alignment.tokenised(spark.createDataFrame([("one other",)], "text string")).first()
    a, b = alignment.load(*alignment.paths()).encode("one other")
    assert [x & alignment.MARK for x in row.a_tokens] == a.tolist() and [x & alignment.MARK for x in row.b_tokens] == b.tolist()
    assert [x >> 32 for x in row.a_tokens] == row.a_ends and [x >> 32 for x in row.b_tokens] == row.b_ends and row.a_ends[-1] == 10


def test_a_file_whose_ids_are_no_ranks_is_refused(tmp_path):
    path = alignment.paths()[0]
    alignment.check_ranks(path)
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    merges = spec["model"]["merges"]
    for wrong in ([*merges[1:], merges[0]], merges[:-1]):
        (tmp_path / "wrong.json").write_text(json.dumps({**spec, "model": {**spec["model"], "merges": wrong}}), encoding="utf-8")
        with pytest.raises(ValueError, match="merges"):
            alignment.check_ranks(str(tmp_path / "wrong.json"))


def test_query(spark):
    rows = alignment.op12_cross_tokenizer_links(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = dict(zip(texts, brute(list(texts.values())), strict=True))
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows} == want
