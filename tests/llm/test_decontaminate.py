import random
import time

from wayfold.llm import decontaminate as dc


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(4)
    for _ in range(300):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(12)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randrange(12)))
        for k in (0, 1, 3, 20):
            d = plain_distance(a, b)
            assert dc.distance(a, b, k) == (d if d <= k else k + 1)


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([8, 20, 50]))) for i in range(12)] + [(50, None), (51, ""), (52, "ab")]
    docs, want = [], set()
    for d in range(60):
        body = text(rng.choice([0, 5, 60, 900]))
        if d % 3 == 0:
            i, t = items[rng.randrange(12)]
            part = list(t.upper() if d % 2 else t)
            for k in range(len(part) // 60):  # a few edits, apart
                at = 20 + 60 * k
                part[at : at + 1] = rng.choice(["", "x", part[at] + "y"])
            body = body + ". " + "".join(part) + "! " + text(30)
            want.add((d, i))
        docs.append((d, body))
    return docs + [(60, None), (61, ""), (62, items[0][1][: len(items[0][1]) // 4])], items, want


def test_planted_items_and_no_other(spark):
    docs, items, want = made(1)
    df = spark.createDataFrame([(d, t, 0, "s") for d, t in docs + docs[:1]], "doc_id long, text string, item_id int, place string")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items + items[:2]], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in dc.find(df, bench).collect()}
    assert got == want
    kept = dc.clean(df, bench)
    assert kept.columns == df.columns
    dirty = {d for d, _ in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs + docs[:1] if d not in dirty)


def test_lemma_drops_no_match_within_budget():
    rng = random.Random(9)
    for _ in range(200):
        item = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(90, 300)))
        index = dc.Index([(1, dc.normal(item))])
        at = rng.randrange(0, len(index.items[0][1]) - dc.STRETCH)
        own = bytearray(index.items[0][1][at : at + dc.STRETCH])
        for _ in range(dc.budget(dc.STRETCH)):
            own[rng.randrange(len(own))] = ord("z")
        k, _, p = index.hits(bytes(own))
        assert len(k) >= dc.least_hits(dc.STRETCH)


def test_replaced_phrase_keeps_the_exact_stretches():
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    for head, phrase, tail in [(100, 25, 100), (150, 35, 150), (90, 20, 90), (40, 30, 200)] * 5:
        item = text(head + phrase + tail)
        doc = text(300) + item[:head] + text(phrase) + item[head + phrase :] + text(300)
        ((i, size, edits, place),) = dc.Index([(7, dc.normal(item))]).matches(doc)
        assert i == 7 and max(head, tail) <= size <= len(item) and edits <= dc.budget(size) and 300 <= place < 300 + len(item)


def test_edits_ten_bytes_apart():
    rng = random.Random(22)
    for _ in range(20):
        item = "".join(rng.choice("abcdefghijkl") for _ in range(80))
        own = list(item)
        for at in range(15, 65, 10):
            own[at] = "z"
        doc = "w" * 100 + "".join(own) + "w" * 100
        assert [m[0] for m in dc.Index([(3, dc.normal(item + "q" * 40))]).matches(doc)] == [3]


def test_every_stretch_is_decided_as_brute_force_does():
    rng = random.Random(23)
    seen = set()
    for case in range(24):
        item = "".join(rng.choice("abcdefgh") for _ in range(110))
        own = list(item)
        for _ in range(rng.randrange(4, 16)):
            at = rng.randrange(len(own))
            own[at] = rng.choice(["", "z", own[at] + "y"])
        index = dc.Index([(1, dc.normal(item))])
        (_, mine), text = index.items[0], dc.normal("k" * 30 + "".join(own) + "k" * 30)
        want = False
        for a in range(len(mine) - dc.STRETCH + 1):
            row = [0] * (len(text) + 1)
            for x in mine[a : a + dc.STRETCH]:
                new = [row[0] + 1]
                for j, y in enumerate(text, 1):
                    new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
                row = new
            want = want or min(row) <= dc.budget(dc.STRETCH)
        got = index.matches(text.decode())
        assert got or not want, case
        for _, size, edits, place in got:
            assert size >= dc.STRETCH and edits <= dc.budget(size) and (want or size > dc.STRETCH)
        seen.add(want)
    assert seen == {True, False}


def test_blocks_and_empty(spark, monkeypatch):
    docs, items, want = made(2)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find(df, bench).collect()} == want
    assert dc.find(df.limit(0), bench).collect() == [] and dc.find(df, bench.limit(0)).collect() == []


def test_repetitive_texts_are_quick_and_bounded():
    began = time.perf_counter()
    index = dc.Index([(1, dc.normal("a" * 2000)), (2, dc.normal("ab" * 500))])
    assert [m[:3] for m in index.matches("a" * 20_000 + " end")][0][0] == 1
    assert dc.Index([(1, dc.normal("a" * 400))]).matches("a" * 8000)
    assert time.perf_counter() - began < 20


def test_blocks_of_diagonals_give_the_same(monkeypatch):
    rng = random.Random(21)
    for _ in range(60):
        unit = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 30)))
        item = (unit * 400)[: rng.randrange(20, 260)] + "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        doc = "".join(rng.choice("xyz ") for _ in range(rng.randrange(200))) + (unit * 200)[: rng.randrange(10, 500)] + worn_some(item, rng) + "".join(rng.choice("xyz ab") for _ in range(rng.randrange(200)))
        index = dc.Index([(5, dc.normal(item)), (6, dc.normal(item[::-1]))])
        want = index.matches(doc)
        monkeypatch.setattr(dc, "MOST_HITS", 0)
        got = index.matches(doc)
        monkeypatch.undo()
        assert got == want


def worn_some(text, rng):
    out = list(text)
    for _ in range(rng.randrange(0, 6)):
        out[rng.randrange(len(out))] = rng.choice(["", "q", "qq"])
    return "".join(out)
