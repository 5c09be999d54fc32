from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lattica.llm import neardup as nd
from lattica.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, width=5, percent=75):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= percent * either:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["Été", "THE"]
    rows, key = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "one two"), (-5, "One  TWO"), (-6, "one two three")], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 30, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 20])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((key, rng.choice([" ", "  ", "\n"]).join(copy)))
            key += 1
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(40):  # a common passage, at similarities around the threshold
        rows.append((key, " ".join(shared + [rng.choice(vocabulary) for _ in range(rng.randrange(40))])))
        key += 1
    return rows


@pytest.mark.parametrize("most", [nd.BLOCK, 4])
def test_against_brute_force(spark, most):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, band int, key string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs, most=most).collect()}
    assert got == brute(rows)


def test_texts_are_shuffled_where_keys_are_too_many(spark, monkeypatch):
    monkeypatch.setattr(nd, "MOST_BROADCAST", -1)
    rows = corpus(5)[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs).collect()} == brute(rows)


def test_repeated_rows_and_null_keys(spark):
    docs = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (None, "a b c"), (None, "q r"), (1, "a b c")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in nd.near_duplicates(docs).collect() if r.component_id is not None)
    assert got == [(0, 1, False), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert nd.near_duplicates(docs.where("doc_id > 9")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, 3000).astype(np.uint64) for _ in range(2))
    shared = a[:2000]
    one, two = np.unique(a), np.unique(np.concatenate([shared, b[:700]]))
    s = nd.sketches([one, two, np.unique(np.concatenate([one, two])), np.empty(0, np.uint64)])
    assert (np.maximum(s[0], s[1]) == s[2]).all() and not s[3].any()
    j = 2000 / 3700
    grid = np.linspace(0, 0.9, 91)
    more, less = (s[0] > s[1]).sum(), (s[0] < s[1]).sum()
    best = grid[np.argmax(nd.log_likelihood(grid, more, less, np.float64(len(one)), np.float64(len(two))))]
    assert abs(best - j) < 0.15
    n = np.array([float(len(one))])
    assert nd.likely(s[:1], s[:1], n, n, 0.75)[0] and not nd.likely(s[:1], s[1:2], n, np.array([10.0]), 0.75)[0]


def test_similar_pairs_pass_the_screen():
    rng = np.random.default_rng(1)
    for n in (4, 20, 300):
        for j in (0.75, 0.8, 0.9, 0.97, 1.0):
            a = [rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(60)]
            keep = int(np.ceil(2 * j * n / (1 + j)))
            b = [np.concatenate([x[:keep], rng.integers(0, 1 << 63, n - keep).astype(np.uint64)]) for x in a]
            one, two = nd.sketches([np.unique(x) for x in a]), nd.sketches([np.unique(x) for x in b])
            size = np.full(60, float(n))
            assert nd.likely(one, two, size, size, 0.75).all(), (n, j)


def test_components_both_ways(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, 7), (1000, 1001), (1001, 999)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.v: r.component for r in components(frame).collect()}
    assert got == {r.v: r.component for r in components(frame, one_task=0).collect()}
    assert got[1000] == got[1001] == got[999] == 999 and all(got[a] == got[b] for a, b in links if a != b)
    assert components(frame.where("a > 5000")).count() == 0


def test_small_similar_sets_share_a_band():
    rng, missed = np.random.default_rng(5), 0
    for _ in range(12):  # 3 of 4 shingles, similarity 0.75
        x = rng.integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
        same = nd.sketches(list(x[:, :3])) == nd.sketches(list(x))
        missed += int((~same.reshape(-1, nd.BANDS, nd.ROWS).all(2).any(1)).sum())
    assert missed <= 3
    keys = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    orders = np.sort(np.stack([nd._order(j, keys) for j in range(nd.M)]), axis=0)
    assert (orders == np.arange(nd.M)[:, None]).all()
