import math
import random

import numpy as np
import pytest

from wayfold.llm import neighbours as nb


def brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[(i, tuple(v))] = nb.units(np.array([v], float))[0]
    out = {}
    for (i, v), a in ok.items():
        if i % every == 0:
            found = sorted({(-float((a * b).sum()), j) for (j, w), b in ok.items() if j != i and len(w) == len(v)})
            out[i] = [(j, -s) for s, j in found[:k]]
    return {i: x for i, x in out.items() if x}


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [x for x, _ in a[q]] == [x for x, _ in b[q]], q
        assert [s for _, s in a[q]] == pytest.approx([s for _, s in b[q]], abs=1e-12)


def test_small_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (11, [3.0, 2.0, 1.0]), (3, [0.0, 1.0]), (150, [-1.0, -1.0])]
    same(got(nb.search(table(spark, rows))), brute(rows, 50, 5))
    assert nb.search(table(spark, rows).limit(0)).collect() == []
    assert nb.search(table(spark, [(0, [1.0])])).collect() == []


def test_parallel_vectors_are_ties(spark):
    rows = [(50, [1.0, 2.0, 3.0])] + [(103 + i, [float(m), 2.0 * m, 3.0 * m]) for i, m in enumerate(range(21, 0, -1))] + [(7, [1.0, 2.0, 2.9])]
    assert [v for v, _ in got(nb.search(table(spark, rows)))[50]] == [103, 104, 105, 106, 107]


def test_an_id_with_two_vectors_is_asked_by_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [1.0, 0.01 * i]) for i in range(1, 8)] + [(i, [0.01 * i, 1.0]) for i in range(11, 18)]
    found = nb.search(table(spark, rows)).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == sorted([(n, n) for n in range(1, 6)] + [(n, 10 + n) for n in range(1, 6)])


def test_blocks_and_growing_parts_change_nothing_but_the_cost(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (700, 6)).astype(np.float32))]
    monkeypatch.setattr(nb, "BLOCK", 40)
    same(got(nb.search(table(spark, rows), every=3, parts=4, recall=1.0)), brute(rows, 3, 5))


def test_few_parts_are_visited_where_vectors_have_structure():
    rng = np.random.default_rng(9)
    x = nb.units(rng.normal(0, 1, (64, 32))[rng.integers(64, size=6000)] + rng.normal(0, 0.15, (6000, 32)))
    index = nb.fit(x[:5000], 5, 32)
    assert index.probes <= 8


def test_a_common_vector_costs_its_smallest_ids_only(spark):
    rng = random.Random(1)
    rows = [(i, [1.0, 1.0, 0.5] if i % 3 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(600)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    same(got(nb.search(table(spark, rows), parts=1)), brute(rows, 50, 5))


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (10, 24))
    x = (centres[rng.integers(10, size=4000)] + rng.normal(0, 0.6, (4000, 24))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    a, b = got(nb.search(table(spark, rows), parts=16, sample=2000)), brute(rows, 50, 5)
    assert a.keys() == b.keys() and all(len(v) == 5 for v in a.values())
    assert sum(len({j for j, _ in a[q]} & {j for j, _ in b[q]}) for q in b) >= 0.9 * 5 * len(b)


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    x = nb.units(rng.normal(0, 1, (8, 16))[rng.integers(8, size=1600)] + rng.normal(0, 0.1, (1600, 16)))
    graph = nb.nearest_in(x, 10)
    part = nb.balanced(x, graph, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(nb.SLACK * 1600 / 8)
    assert (part[graph] == part[:, None]).mean() > 0.6
    index = nb.fit(x, 5, 8)
    assert 1 <= index.probes < 8
