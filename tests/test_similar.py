"""Similar pairs at thresholds against brute force."""

from __future__ import annotations

import random
from itertools import combinations, product

import numpy as np
import pytest

from lattica.operators import reorder, similar


def sets_of(rng, n, members):
    out = {}
    for v in range(n):
        if v % 5 == 4:  # like an earlier one
            s = set(out[rng.randrange(v)])
            s ^= set(rng.sample(range(members), rng.randrange(4)))
        else:
            s = {min(int(rng.paretovariate(0.4)), members) - 1 for _ in range(rng.randrange(1, 25))}
        out[v] = s
    return out


def brute(sets, least):
    out = {}
    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and common / len(sets[a] | sets[b]) >= least - 1e-12:
            out[a, b] = (common, common / len(sets[a] | sets[b]))
    return out


def frame(spark, sets):
    rows = [(v * 3 - 40, u) for v, s in sets.items() for u in s]
    return spark.createDataFrame(rows + rows[:9] + [(None, 1), (1, None)], "v long, u long").repartition(5)


def found(spark, sets, least):
    got = similar.similar_pairs(frame(spark, sets), least).collect()
    assert len({(r.a, r.b) for r in got}) == len(got)
    return {((r.a + 40) // 3, (r.b + 40) // 3): (r.common, pytest.approx(r.jaccard)) for r in got}


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8])
def test_against_brute_force(spark, least, monkeypatch):
    sets = sets_of(random.Random(int(least * 10)), 260, 60)
    want = brute(sets, least)
    assert want and found(spark, sets, least) == want
    monkeypatch.setattr(similar, "BLOCK", 9)  # common members are cut into blocks
    assert found(spark, sets, least) == want
    monkeypatch.setattr(similar, "LARGE", 12)  # and large sets are compared by joins
    monkeypatch.setattr(similar, "MOST_BROADCAST", -1)
    assert found(spark, sets, least) == want


def test_exact_thresholds_copies_and_empty(spark):
    sets = {0: {1, 2, 3, 4}, 1: {1, 2, 3, 4}, 2: {1, 2, 3, 5}, 3: {9}, 4: {9}, 5: {7}}
    assert found(spark, sets, 1.0) == brute(sets, 1.0) and found(spark, sets, 0.6) == brute(sets, 0.6)
    assert similar.similar_pairs(spark.createDataFrame([], "v long, u long"), 0.5).count() == 0
    with pytest.raises(ValueError):
        similar.similar_pairs(frame(spark, sets), 0.0)


def test_rows_shuffled_grow_with_prefixes(spark):
    """Twice as many sets of the same kind meet in about twice as many groups, where blocks of all sets would be four times."""
    rng = random.Random(1)
    def dealt(n):
        sets = {v: {rng.randrange(n * 4) for _ in range(10)} for v in range(n)}
        whole = similar.ordered_sets(frame(spark, sets))
        tokens = whole.selectExpr("v", "s", "explode(slice(s, 1, 3)) AS r")
        return similar._dealt(tokens).count()

    assert dealt(2000) < 2.5 * dealt(1000)


def test_a_block_is_scored_in_chunks_not_set_by_set():
    """Chunks give what each two sets give, within a list and between two, and come as few arrays."""
    rng = random.Random(4)
    sets = [(3 * v, np.array(sorted({7, *rng.sample(range(8, 60), 12), *rng.sample(range(7), rng.randrange(2))}))) for v in range(300)]
    for left, right in ((sets, None), (sets[:150], sets[150:])):
        parts = list(similar._pairs(7, left, right, 0.2))
        got = {(int(a), int(b)): (int(n), float(x)) for p in parts for a, b, n, x in zip(*p, strict=True)}
        want = {}
        for (a, s), (b, t) in combinations(sets, 2) if right is None else product(left, right):
            both = set(s.tolist()) & set(t.tolist())
            if min(both) == 7 and len(both) / len({*s.tolist(), *t.tolist()}) >= 0.2:
                want[a, b] = (len(both), len(both) / len({*s.tolist(), *t.tolist()}))
        assert got == want and want
        assert len(parts) <= -(-len(left) // 32)


def test_clusters_find_pairs_once(spark):
    """The pairs are computed for one write, however often groups and merges read them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    given = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.4), (4, 5, 0.3)], "a long, b long, jaccard double").repartition(2)
    sets = spark.createDataFrame([(v, u) for v in range(6) for u in (v, v + 1)], "v long, u long")
    named = reorder.clusters(given.mapInArrow(counted, given.schema), sets, sets.select("v").distinct())
    assert named.count() == 6 and seen.value == 3
