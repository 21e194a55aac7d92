import itertools
import random

from wayfold.llm import url_filter as uf
from wayfold.llm.registry import queries


def rows(spark, urls):
    return spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_explicit_rules(spark):
    urls = [None, "", "no-scheme.com/en/1", "http://A.Example.COM/en/7?q#f", "http://example.com/en/71", "http://b.com/en/", "http://b.com/enx", "https://notcom/en/", "http://x.net/de/8", "http://y.example.net/de/8/a", "http://z.org?x=/es/", "http://z.org/es/#a://q.com/en/", "ftp://com", "http://İ.com/en/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(rows(spark, urls), None).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[4][2:] == ("example.com/en/7", "allow")
    assert got[5][2:] == ("com/en/", "block") and got[6][2:] == (None, "allow") and got[7][2:] == (None, "allow")
    assert got[8][2:] == ("net/de/", "block") and got[9][2:] == ("example.net/de/8", "allow")
    assert got[10] == ("z.org", "", None, "allow") and got[11] == ("z.org", "/es/", "org/es/", "block")
    assert got[12] == ("com", "", None, "allow") and got[13][0] == "İ.com"


def test_each_rule_has_the_word_of_the_contract(spark, tmp_path):
    # Its list: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/.
    urls = ["http://a.com/en/", "http://a.example.com/en/7", "http://x.net/de/8", "http://y.example.net/de/8/a", "http://example.net/de/7", "http://z.org/es/"]
    rows(spark, urls).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries()["op2_url_filter"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]))


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(5)
    urls = [f"http://{rng.choice(['good', 'spam', 'shop'])}.{rng.choice(['example', 'test'])}.xx/{rng.choice(['a', 'b', 'win'])}?r={rng.choice('pqr')}" for _ in range(300)]
    bad = ["spam" in u and "win" in u or "r=q" in u and rng.random() < 0.7 for u in urls]
    pages = rows(spark, urls)
    labels = spark.createDataFrame([(i, 1 - int(b), 0) for i, b in enumerate(bad)] + [(None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in uf.judge(pages, labels, min_count=10, min_confidence=0.6).collect()}
    sets = [set(r.t) for r in pages.select(uf.tokens(pages.url).alias("t")).collect()]
    every = sorted(set().union(*sets))
    rules = []
    for k in range(1, 8):
        for c in itertools.combinations(every, k):
            has = [b for s, b in zip(sets, bad, strict=True) if s >= set(c)]
            if sum(has) >= 10 and sum(has) / len(has) >= 0.6:
                rules.append(set(c))
    assert rules
    assert got == {i: "block" if any(r <= s for r in rules) else "allow" for i, s in enumerate(sets)}


def test_too_few_labels_and_empty(spark):
    labels = spark.createDataFrame([(0, 0, 1)], "doc_id long, quality int, toxic int")
    assert [r.verdict for r in uf.judge(rows(spark, ["http://q.zz/"]), labels).collect()] == ["allow"]
    assert uf.judge(rows(spark, []), labels).collect() == []
