import random
import zlib

from wayfold.llm import toxicity as tx

BAD = ["idiot", "moron", "worthless", "disgusting"]


def made(n):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("aeiourstnlmdc") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 400]))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                b = rng.choice(BAD)
                if zlib.crc32(str(i).encode()) % 4 == 2:  # held out: misspelt as never in training
                    k = rng.randrange(1, len(b) - 1)
                    b = b[:k] + b[k] + b[k:]
                w[rng.randrange(len(w))] = b
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = made(700)
    df = spark.createDataFrame(docs + [(1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (None, "plain", "x")] + docs[:1], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(0, 1, labels[0][2]), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = tx.judge(df, lab).collect()
    assert len(got) == len(docs) + 5
    truth = dict((i, t) for i, _, t in labels)
    out = [(truth[r.doc_id], r.predicted) for r in got if r.doc_id in truth and r.held_out]
    assert len(out) > 100 and sum(a == b for a, b in out) / len(out) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (1000, 1001, 1002))
    model = tx.fit_on(df, lab)
    kept = tx.clean(df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in tx.judge(df, lab).collect()] == [0]
    assert tx.judge(df.limit(0), lab).collect() == []


def test_repeats_count_once():
    assert tx.kept_words("a a a b a c d e f g h a") == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert tx.kept_words("a b c d e f g h a") == ["a", "b", "c", "d", "e", "f", "g", "h", "a"]
