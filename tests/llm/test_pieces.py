import itertools
import random

import pytest
from pyspark.sql import functions as F

from wayfold.llm import pieces as pc

TEXTS = [None, "", " ", "   ", "Hello  world\n\tfoo ", "  a  b", "é️‍👨 ﬁ ½　x", "▁a ▁", "x▁y", "a" * 700, "ab" * 300 + " end", "The quick brown fox, 12345.", "日本語テスト", "\x00\x01 <0x0A> <s> </s> <unk>", "haha" * 40, "1111111111 2222", "don't  stop", "ßüö Ñandú", "a\nb\n\nc d\n", "\nx", "x \ny", "a\n b", "\n", " \n "]


@pytest.fixture(scope="module")
def vocabulary():
    return pc.load(pc.model_file())


@pytest.mark.parametrize("frequent", [0, 5, 131_072])
def test_equals_the_library(spark, vocabulary, frequent):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pc.model_file())
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("etaoin shr. \n") for _ in range(n)) for n in (5, 50, 400)]
    rows = [(i % 15, t, "k", [1]) for i, t in enumerate(texts)] + [(None, "none", "k", [2])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids array<int>")
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in pc.decode(pc.encode(df, vocabulary, frequent), vocabulary).collect()), key=repr)
    assert got == sorted(((i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t, *_ in rows), key=repr)


def test_round_trip_and_empty(spark, vocabulary):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert all(r.round_trip for r in pc.round_trip(df, vocabulary).collect())
    assert pc.round_trip(df.limit(0), vocabulary).collect() == []


def test_viterbi_equals_brute_force(spark):
    rng = random.Random(6)
    pieces = {"".join(p): -rng.random() * 5 for n in (1, 2, 3) for p in itertools.product("abc", repeat=n) if n == 1 and p != ("c",) or rng.random() < 0.5}
    units = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))) for _ in range(60)]

    def best(u):
        found = []
        for k in range(len(u)):
            for inner in itertools.combinations(range(1, len(u)), k):
                at = [0, *inner, len(u)]
                parts = [u[a:b] for a, b in itertools.pairwise(at)]
                if all(p in pieces or len(p) == 1 for p in parts):
                    found.append((sum(pieces.get(p, -20.0) for p in parts), at))
        return max(found)

    table = spark.createDataFrame(list(pieces.items()), "piece string, score double")
    df = spark.createDataFrame([(u,) for u in set(units)], "unit string")
    edges = pc.lattice(df, table, 3)
    single = df.select("unit", F.expr("inline(transform(sequence(0, length(unit) - 1), s -> struct(s as b, s + 1 as e, substring(unit, s + 1, 1) as piece)))")).join(table, "piece").groupBy("unit").agg(F.collect_list(F.struct("b", "e", "score")).alias("one"))
    both = edges.join(single, "unit", "left").select("unit", F.concat("edges", F.coalesce("one", F.array().cast("array<struct<b:int,e:int,score:double>>"))).alias("edges"))
    for r in both.select("unit", pc.fold_viterbi(-20.0).alias("at")).collect():
        assert list(r.at) == best(r.unit)[1]


def test_merging_at_once_and_heap_equal_fold(spark, vocabulary):
    rng = random.Random(8)
    units = {"".join(rng.choice("theandiong▁é‍") for _ in range(rng.randrange(2, 48))) for _ in range(300)}
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    v = vocabulary
    some = sorted(units) + ["x", "‍", "ab" * 200]
    at_once = dict(zip(some, pc.Merger(v.pieces, v.byte, v.unknown).ids(some), strict=True))
    assert all(ids == pc.put(u, pc.merged(u, v.pieces), v.pieces, v.byte, v.unknown) for u, ids in at_once.items())
    for r in pc.lattice(df, pc.piece_table(spark, v), v.longest).select("unit", pc.fold_merges().alias("at")).collect():
        assert pc.bounds(r.at) == pc.merged(r.unit, v.pieces)
    assert pc.Merger(v.pieces, v.byte, v.unknown).ids([]) == []


def test_caches_that_overflow_give_the_same_ids(vocabulary, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pc.model_file())
    monkeypatch.setattr(pc, "CACHE_ENTRIES", 40)
    monkeypatch.setattr(pc, "RARE_ENTRIES", 20)
    v, rng = vocabulary, random.Random(4)
    ids = pc.Ids(v.side_by_side(), v.pieces, v.byte, v.unknown, {})
    for _ in range(60):
        texts = [" ".join("".join(rng.choice("etaoinshr,.") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))) for _ in range(5)]
        assert [list(memoryview(x).cast("i")) for x in ids.encode(texts)] == [sp.encode(t) for t in texts]


def test_long_text(spark, vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pc.model_file())
    text = " ".join(["word", "y" * 3000, "the\nend."] * 1000)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pc.round_trip(df, vocabulary).first()
    assert row.round_trip and list(row.ids) == sp.encode(text) and row.n_pieces == len(row.ids)


def test_most_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + i // 10) for i in range(100)], "word string, n long")
    assert [pc.most_frequent(counts, k).count() for k in (0, 9, 10, 25, 100, 1000)] == [0, 0, 10, 20, 100, 100]
    assert {r.unit for r in pc.most_frequent(counts, 25).collect()} == {f"w{i}" for i in range(80, 100)}
