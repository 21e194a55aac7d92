"""Registered queries read whole texts and whole tables."""

import pytest

from wayfold.functions.text import STOP_WORDS
from wayfold.functions.udfs import fold
from wayfold.plans.registry import queries
from wayfold.plans.views import view


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """A folder with documents whose interest lies beyond character 60."""
    folder = tmp_path_factory.mktemp("long")
    head = "plain words " * 10
    rows = [(1, head + "Straße  in the city", "de"), (2, head + "東京 end", "ja"), (3, head + "nothing", "en"), (4, None, "en"), (6, "", "en"), (7, "çà " * 20_000, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder), {i: t for i, t, _ in rows}


def test_folds_whole_texts(spark, long_texts):
    folder, texts = long_texts
    got = {r.id: r.folded for r in queries()["N15_fold"](spark, folder).collect()}
    assert got == {i: None if t is None or fold(t) == t else fold(t) for i, t in texts.items()} and got[1].endswith("Strasse  in the city")
    got = {r.id: r.folded for r in queries()["N16_fold_for_compare"](spark, folder).collect()}
    assert got == {i: None if t is None else fold(t).strip().lower() for i, t in texts.items()} and len(got[7]) == 20_000 * 3 - 1


def test_tests_and_filters_whole_texts(spark, long_texts):
    folder, texts = long_texts
    assert {r.id: r.cjk for r in queries()["N17_cjk"](spark, folder).collect()} == {i: None if t is None else "東" in t for i, t in texts.items()}
    got = {r.id: r.kept for r in queries()["N18_stop_words"](spark, folder).collect()}
    for i, t in texts.items():
        words = (t or "").split()
        kept = [w for k, w in enumerate(words) if k in (0, len(words) - 1) or w not in STOP_WORDS]
        assert got[i] == (t if len(words) < 3 or kept == words else " ".join(kept))
    assert got[1].endswith("Straße city")


def test_every_supplier_is_a_query(spark, tmp_path):
    spark.range(1, 301).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1, 401).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(r.qid for r in view(spark, str(tmp_path), "v_queries").collect()) == list(range(1, 301))
