import random

import corpus_pipeline
from wayfold.llm import pieces, toxicity
from wayfold.llm.common import table

from .test_near_dups import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, path):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("aeiourstnlmdc") for _ in range(rng.randrange(3, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    docs, labels, planted = [None, "", " "], [], {"toxic": set(), "leak": set()}
    for _ in range(240):
        docs.append(text(rng.choice([8, 40, 120])))
    for k in range(40):
        w = text(40).split()
        for _ in range(3):
            w[rng.randrange(40)] = rng.choice(["idiot", "moron", "worthless"])
        planted["toxic"].add(len(docs))
        docs.append(" ".join(w))
    for k in range(10):
        planted["leak"].add(len(docs))
        docs.append(text(20) + " " + items[k % 5][1] + " " + text(20))
    for k in range(20):
        docs.append(docs[10 + k])  # copies
        w = docs[40 + k].split()
        if len(w) > 60:
            w[3] = "changed"
        docs.append(" ".join(w))
    labels = [(i, 1, int(i in planted["toxic"])) for i in range(len(docs))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items, planted


def test_each_stage_against_brute_force(spark, tmp_path):
    import sentencepiece

    docs, items, planted = made(spark, str(tmp_path))
    d = str(tmp_path)
    rows = table(spark, d, "documents")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "sentencepiece"]
    seen = [{r.doc_id: r.text for r in rows.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, d)
        if k < 3:
            assert out.columns == rows.columns
            out.write.parquet(f"{d}/stage{k}")
            rows = spark.read.parquet(f"{d}/stage{k}")
            seen.append({r.doc_id: r.text for r in rows.collect()})
    scores = {r.doc_id: r.predicted for r in toxicity.judge(table(spark, d, "documents"), table(spark, d, "labels")).collect()}
    assert seen[1] == {i: t for i, t in seen[0].items() if not scores[i]}
    assert not planted["toxic"] & set(seen[1]) and len(seen[1]) >= len(docs) - len(planted["toxic"]) - 12
    kept = {r[0] for r in brute(sorted(seen[1].items())) if r[3]}
    assert set(seen[2]) == kept and len(kept) < len(seen[1])
    clean = {i for i, t in seen[2].items() if not any(x in (t or "") for _, x in items)}
    assert set(seen[3]) == clean and not planted["leak"] & clean
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_file())
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert {i: list(r.ids) for i, r in last.items()} == {i: sp.encode(t or "") for i, t in seen[3].items()}
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in last.values())


def test_odd_rows_empty_tables_and_clashing_columns(spark, tmp_path):
    d = str(tmp_path)
    more = ", ".join(f"{c} string" for c in ("rep", "half", "score", "item_id", "ids", "component_id", "kept", "unit"))
    rows = [(1, "plain words stand here"), (1, "plain words stand here"), (2, None), (3, ""), (4, " \n"), (None, "no id"), (5, "plain words stand here")]
    rows = [(i, t, None, None, None, *"abcdefgh") for i, t in rows]
    spark.createDataFrame(rows, f"{COLUMNS}, {more}").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == [f.name for f in table(spark, d, "documents").schema]
    assert sorted(((r.doc_id, r.n_pieces > 0, r.round_trip) for r in corpus_pipeline.run(spark, d).collect()), key=repr) == sorted([(1, True, True), (1, True, True), (2, False, True), (3, False, True), (4, True, True), (None, True, True)], key=repr)
    none = table(spark, d, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, d) if none.columns[1:2] == ["text"] else none
    assert none.collect() == []
