import random

import numpy as np
import pytest

from wayfold.llm import near_dups as nd
from wayfold.llm.components import components


def brute(rows):
    sets, parent = [], {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = [None, "", " \t\n", "a b", "A  b", "b a", "one two three four five", "x " * 3000, " a b c"]
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 20, 80, 300]))]
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    for n in range(60):  # a passage that many share, with own words before it
        texts.append(" ".join([rng.choice(vocab) for _ in range(n)] + passage))
    texts += texts[10:14]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(None, "a b"), (3, "repeated id"), (3, "repeated id")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, key string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.judge(df).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert nd.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7), (None, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_recall_of_tables():
    rng, words, hit = np.random.default_rng(1), nd.Words(), 0
    for _ in range(300):
        both = rng.integers(1 << 62, size=300, dtype=np.uint64)
        a = np.concatenate((both, rng.integers(1 << 62, size=50, dtype=np.uint64)))
        b = np.concatenate((both, rng.integers(1 << 62, size=50, dtype=np.uint64)))
        same = nd.half_keys(np.unique(a)) == nd.half_keys(np.unique(b))
        hit += same[: nd.TABLES].any() and same[nd.TABLES :].any()
    assert hit >= 299
    assert len(nd.shingles("A b C d e F", words)) == 2 and (nd.shingles("a B c", words) == nd.shingles("A b  c\n", words)).all()
