import pytest

from wayfold.llm import token_counts as tc

TEXTS = [None, "", "   \n\t ", "Hello, WORLD's  it's 12345 ...", "a<|endoftext|>b <|startoftext|>", "x\x1cy \x1f z", "é e\u0301 \u0301 ß İ ΑΣ", "日本語 テスト 😀👍🏽", "\u00a0a\u2003b\u3000c\u180ed", "z" * 5000, "word " * 3000, "don't" * 50]


@pytest.mark.parametrize("entries", [0, 3, 65_536])
def test_equals_the_library(spark, entries):
    js = tc.tokenizer_file("word_bpe_49k.json")
    tok = tc.load(js)
    rows = [(i % 9, t, "x", 1) for i, t in enumerate(TEXTS + TEXTS[3:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, chunk int")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.count_tokens(df, js, entries=entries).collect())
    want = []
    for i, t, *_ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tc.count_tokens(df, tc.tokenizer_file("word_bpe_49k.json")).collect() == []
