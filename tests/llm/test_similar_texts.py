"""Wide fingerprints of five-word shingles: tiles against all pairs, and what they find of the pairs with a Jaccard of 0.8."""

import random

import numpy as np
import pytest
from test_operators import WORD

import corpus_pipeline as pipeline
from skein.llm import simhash

KIND = simhash.Prints.similar(0.8)


def brute_set(text):
    words = [w.lower() if w.isascii() else w for w in WORD.findall(text or "")]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def joined(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def by_prints(texts, kind=KIND):
    """Groups by all pairs of fingerprints."""
    found = [simhash.fingerprint(t or "", kind) for t in texts]
    near = lambda i, j: np.bitwise_count(found[i][0] ^ found[j][0]).sum(dtype=int) <= kind.radius and min(found[i][1], found[j][1]) >= kind.ratio * max(found[i][1], found[j][1])
    return joined(len(texts), near)


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """Texts and copies with edits all over them, on both sides of the threshold; a group of many; a common passage."""
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = draw.choices(vocabulary, k=60)
    texts = []
    for k in range(40):
        words = draw.choices(vocabulary, k=draw.randint(80, 300)) + (passage if k % 2 else [])
        texts.append(" ".join(words))
        texts += [edited(draw, words, e) for e in (1, len(words) // 60, len(words) // 45, len(words) // 35)]
    words = draw.choices(vocabulary, k=200)
    texts += [edited(draw, words, draw.randint(1, 6)) for _ in range(120)]
    return [*texts, None, "", " \n", "one two", "One  two", "one two three four five six"]


def test_radius_is_the_angle_of_the_cosine():
    assert (KIND.size, KIND.words, KIND.radius) == (5, 4, 52) and abs(KIND.ratio - 0.64) < 1e-12


@pytest.mark.parametrize("tile", [None, 7])
def test_groups_equal_all_pairs(spark, copies, tile):
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in simhash.grouped(df, KIND, tile).collect()} == dict(enumerate(by_prints(copies)))


def test_pairs_with_a_jaccard_of_eight_tenths_are_found(copies):
    own, groups = [brute_set(t) for t in copies], by_prints(copies)
    jaccard = {(i, j): len(own[i] & own[j]) / max(1, len(own[i] | own[j])) for i in range(len(own)) for j in range(i)}
    near = [(i, j) for (i, j), s in jaccard.items() if s >= 0.8 or own[i] == own[j]]
    assert len(near) > 1000 and sum(groups[i] == groups[j] for i, j in near) >= 0.99 * len(near)
    apart = [(i, j) for (i, j), s in jaccard.items() if s < 0.2 and own[i] != own[j]]
    assert len(apart) > 10_000 and not any(groups[i] == groups[j] for i, j in apart)


def test_stage_keeps_one_of_each_group(spark, copies):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(copies)], "doc_id long, text string, more string")
    kept = pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(by_prints(copies))


def test_stage_on_awkward_rows(spark, awkward, empty):
    kept = pipeline.near_dedup(spark, awkward, "")
    assert kept.count() == len(set(by_prints([r.text for r in awkward.collect()])))
    assert pipeline.near_dedup(spark, empty, "").count() == 0


def rows_of(prints, sizes=None):
    n = len(prints)
    return np.concatenate([np.arange(n)[:, None], (np.zeros(n, int) if sizes is None else sizes)[:, None], prints.view(np.int64).reshape(n, -1)], axis=1)


def test_population_counts_leave_out_sub_tiles():
    random = np.random.default_rng(3)
    prints = random.integers(0, 2**64, 40_000, dtype=np.uint64)
    prints = np.concatenate([prints, prints[:500] ^ np.uint64(5)])
    pops = np.bitwise_count(prints).astype(int)
    prints = prints[np.lexsort((np.bitwise_count(prints >> np.uint64(32)), pops))]
    found, compared, left_out = simhash.forest(rows_of(prints), None)
    assert len(found) == 500 and left_out > 1.5 * compared  # the population counts of all bits alone leave out half
    halves = simhash.forest(rows_of(prints[:15000]), rows_of(prints[15000:]))
    inside = [simhash.forest(rows_of(x), None)[0] for x in (prints[:15000], prints[15000:])]
    assert len(halves[0]) + sum(map(len, inside)) == 500


def test_sizes_leave_out_sub_tiles():
    random = np.random.default_rng(4)
    prints = random.integers(0, 2**64, (4000, 4), dtype=np.uint64)
    sizes = np.sort(random.integers(1, 5000, 4000))
    _, compared, left_out = simhash.forest(rows_of(prints, sizes), None, KIND)
    assert left_out > compared / 2


def test_a_large_group_is_a_tree():
    random = np.random.default_rng(5)
    one = random.integers(0, 2**64, 1, dtype=np.uint64)
    prints = np.unique(one ^ (np.uint64(1) << random.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << random.integers(0, 64, 4000).astype(np.uint64)))
    found, _, _ = simhash.forest(rows_of(prints), None, simhash.Prints(radius=4))
    assert len(found) == len(prints) - 1
