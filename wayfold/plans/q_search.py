"""Queries: the text index, ranked search and what is built on it."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from . import views
from .base import query
from .views import view

TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND strlen(x) < 40)"
NAME_TOK = TOK.format("name")
INDEX = f"""t AS (SELECT place_id, unnest({NAME_TOK}) AS term FROM v_named),
  pt AS (SELECT term, place_id, count(*) AS tf FROM t GROUP BY 1, 2),
  ln AS (SELECT place_id, sum(tf) AS len FROM pt GROUP BY 1),
  st AS (SELECT (SELECT count(*) FROM v_named) AS n, (SELECT sum(len) FROM ln) / (SELECT count(*) FROM v_named) AS avg_len),
  df AS (SELECT term, count(*) AS df FROM pt GROUP BY 1)"""
QT = "qt AS (SELECT DISTINCT qid, unnest(" + TOK.format("q") + ") AS term FROM v_queries)"
BM = """bm AS (SELECT qid, place_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS bm25
  FROM qt JOIN df USING (term) JOIN pt USING (term) JOIN ln USING (place_id), st GROUP BY 1, 2)"""
CUT = "cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, place_id) AS rn FROM {0}) WHERE rn <= 50)"


def named(spark, d):
    """Places to index, dealt out: the tables they are made of are small files, which few tasks would read."""
    return views.places(spark, d, "v_named").repartition("place_id")


def index(spark, d):
    return search.build_index(named(spark, d), plain=True)


def asked(spark, d, **options):
    q = view(spark, d, "v_queries").select("qid", "q", *[v.alias(k) for k, v in options.items()])
    return q


def rounded(rows):
    return rows.select("qid", "rank", "place_id", F.round("score", 6).alias("score"))


@query("A11_corpus_statistics", f"WITH {INDEX} SELECT term, df, st.n AS n, round(st.avg_len, 6) AS avg_len FROM df, st")
def a11(spark, d):
    ix = index(spark, d)
    return ix.terms.where("field = 'name'").join(F.broadcast(ix.fields), "field").select("term", "df", "n", F.round("avg_len", 6).alias("avg_len"))


@query("K5_postings", f"WITH {INDEX} SELECT term, place_id, tf, len FROM pt JOIN ln USING (place_id)")
def k5(spark, d):
    ix = index(spark, d)
    return ix.postings.where("field = 'name'").select("term", "place_id", "tf", "len")


@query("K5_prefix_postings", "SELECT place_id, lower(substring(name, 1, i::INT)) AS term FROM v_named, range(1, 26) r(i) WHERE i <= length(name)")
def k5p(spark, d):
    ix = index(spark, d)
    return ix.postings.where("field = 'name_prefix'").select("place_id", "term")


FINAL = "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, place_id) AS rank, place_id, score FROM {0}"


@query("X2_search", f"WITH {INDEX}, {QT}, {BM}, {CUT.format('bm')}, sc AS (SELECT qid, place_id, bm25 AS score FROM cut) SELECT qid, rank::INT AS rank, place_id, round(score, 6) AS score FROM ({FINAL.format('sc')}) WHERE rank <= 10")
def x2(spark, d):
    return by_bm25(asked(spark, d), index(spark, d))


def by_bm25(q, ix):
    """Candidates in the order of their first score."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "place_id"))
    hits = search.candidates(search.with_options(q), ix, True, frozenset(q.columns))
    return rounded(hits.withColumn("rank", rank).where("rank <= 10"))


BOOST = "bm25 * CASE WHEN lower(trim(q)) = lower(trim(name)) THEN 4.0 ELSE 1 END * CASE WHEN population > 0 THEN 1 + 0.1 * log10(1 + population) ELSE 1 END"


@query("X17_ranked_search", f"WITH {INDEX}, {QT}, {BM}, {CUT.format('bm')}, sc AS (SELECT qid, place_id, {BOOST} AS score FROM cut JOIN v_queries USING (qid) JOIN v_named USING (place_id)) SELECT qid, rank::INT AS rank, place_id, round(score, 6) AS score FROM ({FINAL.format('sc')}) WHERE rank <= 10")
def x17(spark, d):
    return rounded(search.search(asked(spark, d), index(spark, d), plain=True))


LAYERED = "lay AS (SELECT b.qid, b.place_id, b.bm25 + ln(1 + (n - kdf + 0.5) / (kdf + 0.5)) AS bm25 FROM bm b JOIN v_queries USING (qid) JOIN v_named p USING (place_id) JOIN (SELECT kind, count(*) AS kdf FROM v_named GROUP BY 1) k ON k.kind = p.kind, st WHERE p.kind = layer)"


@query("X7_layer_filter", f"WITH {INDEX}, {QT}, {BM}, {LAYERED}, {CUT.format('lay')}, sc AS (SELECT qid, place_id, {BOOST} AS score FROM cut JOIN v_queries USING (qid) JOIN v_named USING (place_id)) SELECT qid, rank::INT AS rank, place_id, round(score, 6) AS score FROM ({FINAL.format('sc')}) WHERE rank <= 10")
def x7(spark, d):
    alias = F.when(F.col("layer") == "poi", "Venue").otherwise(F.col("layer"))
    return rounded(search.search(asked(spark, d, layers=F.array(alias)), index(spark, d), plain=True))


CATS = "cat AS (SELECT b.qid, b.place_id, b.bm25 + ln(1 + (n - kdf + 0.5) / (kdf + 0.5)) AS bm25 FROM bm b JOIN v_named p USING (place_id), st, (SELECT count(*) AS kdf FROM v_named WHERE kind = 'address') k WHERE p.kind = 'address')"


@query("F2_category_filter", f"WITH {INDEX}, {QT}, {BM}, {CATS}, {CUT.format('cat')}, sc AS (SELECT qid, place_id, {BOOST} AS score FROM cut JOIN v_queries USING (qid) JOIN v_named USING (place_id)) SELECT qid, rank::INT AS rank, place_id, round(score, 6) AS score FROM ({FINAL.format('sc')}) WHERE rank <= 10")
def f2(spark, d):
    return rounded(search.search(asked(spark, d, categories=F.array(F.lit(" Address "), F.lit(""))), index(spark, d), plain=True))


@query("F4_bbox", f"WITH {INDEX}, {QT}, {BM}, sc AS (SELECT qid, place_id, {BOOST} AS score FROM bm JOIN v_queries USING (qid) JOIN v_named USING (place_id) WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45) SELECT qid, rank::INT AS rank, place_id, round(score, 6) AS score FROM ({FINAL.format('sc')}) WHERE rank <= 10")
def f4(spark, d):
    box = {"min_x": F.lit(-90.0), "min_y": F.lit(-45.0), "max_x": F.lit(90.0), "max_y": F.lit(45.0)}
    return rounded(search.search(asked(spark, d, **box), index(spark, d), plain=True))


KM = "2 * 6371.0088 * asin(least(sqrt(pow(sin((radians(lat) - radians(focus_lat)) / 2), 2) + cos(radians(focus_lat)) * cos(radians(lat)) * pow(sin(radians(lon - focus_lon) / 2), 2)), 1))"


@query("X16_geo_bias", f"WITH {INDEX}, {QT}, {BM}, {CUT.format('bm')}, sc AS (SELECT qid, place_id, {BOOST} / (1 + 0.5 * {KM}) AS score FROM cut JOIN v_queries USING (qid) JOIN v_named USING (place_id)) SELECT qid, rank::INT AS rank, place_id, round(score, 6) AS score FROM ({FINAL.format('sc')}) WHERE rank <= 10")
def x16(spark, d):
    return rounded(search.search(asked(spark, d, focus_lon=F.col("focus_lon"), focus_lat=F.col("focus_lat")), index(spark, d), plain=True))


@query("X14_language_boost", f"WITH {INDEX}, {QT}, {BM}, {CUT.format('bm')}, sc AS (SELECT qid, place_id, {BOOST} * CASE WHEN qid % 2 = 0 THEN 1.5 ELSE 1 END AS score FROM cut JOIN v_queries USING (qid) JOIN v_named USING (place_id)) SELECT qid, rank::INT AS rank, place_id, round(score, 6) AS score FROM ({FINAL.format('sc')}) WHERE rank <= 10")
def x14(spark, d):
    lang = F.when(F.col("qid") % 2 == 0, "DEFAULT").otherwise("xx")
    return rounded(search.search(asked(spark, d, lang=lang), index(spark, d), plain=True))


@query("X18_explain", f"WITH {INDEX}, {QT}, {BM}, {CUT.format('bm')}, sc AS (SELECT qid, place_id, bm25, CASE WHEN lower(trim(q)) = lower(trim(name)) THEN 4.0 ELSE 1 END AS ex, CASE WHEN population > 0 THEN 1 + 0.1 * log10(1 + population) ELSE 1 END AS po, {BOOST} AS score FROM cut JOIN v_queries USING (qid) JOIN v_named USING (place_id)), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, place_id) AS rank FROM sc) SELECT qid, place_id, round(bm25, 6) AS bm25, ex::DOUBLE AS exact_boost, round(po, 6) AS population_boost FROM rk WHERE rank <= 10")
def x18(spark, d):
    return search.search(asked(spark, d), index(spark, d), plain=True).select("qid", "place_id", F.round("bm25", 6).alias("bm25"), "exact_boost", F.round("population_boost", 6).alias("population_boost"))


@query("X3_autocomplete", f"""WITH pl AS (SELECT place_id, name, length(name) AS l FROM v_named), st AS (SELECT count(*) AS n, avg(least(l, 25)) AS avg_len FROM pl),
  q AS (SELECT qid, lower(substring(name, 1, 9 + qid::INT % 5)) AS p FROM v_queries JOIN v_named ON place_id = 1000000000 + qid),
  m AS (SELECT qid, place_id, least(l, 25) AS len, count(*) OVER (PARTITION BY qid) AS df FROM q JOIN pl ON starts_with(lower(name), p)),
  sc AS (SELECT qid, place_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / avg_len)) AS score FROM m, st)
  SELECT qid, rank::INT AS rank, place_id, round(score, 6) AS score FROM ({FINAL.format('sc')}) WHERE rank <= 10""")
def x3(spark, d):
    q = view(spark, d, "v_queries").select("qid").join(view(spark, d, "v_named").select("place_id", "name"), F.col("place_id") == F.col("qid") + 1000000000)
    q = q.select("qid", F.substring(F.col("name"), F.lit(1), (9 + F.col("qid") % 5).cast("int")).alias("q"), F.lit("autocomplete").alias("mode"))
    return by_bm25(q, index(spark, d))


@query("X1_stop_word_search", "SELECT qid, 'La Place ' || n_name AS q FROM v_queries JOIN nation ON n_nationkey = qid")
def x1(spark, d):
    q = view(spark, d, "v_queries").select("qid").join(view(spark, d, "nation"), F.col("n_nationkey") == F.col("qid"))
    return q.select("qid", text.drop_stop_words(F.concat(F.lit("La de la Place des "), "n_name")).alias("q"))


@query("X5_trigram_join", """WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT DISTINCT p_name, unnest([substring(chr(1) || p_name || chr(1), i, 3) FOR i IN range(1, length(p_name) + 1)]) AS g FROM n)
  SELECT a.p_name AS a, b.p_name AS b, count(*) AS shared FROM g a JOIN g b USING (g) WHERE a.p_name < b.p_name GROUP BY 1, 2""")
def x5(spark, d):
    g = view(spark, d, "part").select("p_name").distinct().select("p_name", F.explode(text.trigrams(F.col("p_name"))).alias("g"))
    return g.withColumnRenamed("p_name", "a").join(g.withColumnRenamed("p_name", "b"), "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("X12_edit_boost", "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT p_name, round(CASE WHEN d < 4 THEN 1 + 0.6 * (4 - d) / 4 ELSE 1 END, 6) AS boost FROM (SELECT p_name, levenshtein(p_name, 'red widget') AS d FROM n)")
def x12(spark, d):
    return view(spark, d, "part").select("p_name").distinct().select("p_name", F.round(search.edit_boost(F.levenshtein("p_name", F.lit("red widget"))), 6).alias("boost"))


@query("X13_population_boost", "SELECT place_id, round(CASE WHEN population > 0 THEN 1 + 0.1 * log10(1 + population) ELSE 1 END, 6) AS boost FROM v_places")
def x13(spark, d):
    return view(spark, d, "v_places").select("place_id", F.round(search.population_boost(F.col("population")), 6).alias("boost"))


@query("X4_fuzzy_search")
def x4(spark, d):
    q = view(spark, d, "v_queries").select("qid", F.regexp_replace("q", "^(.)(.)(.)", "$1$3$2").alias("q"), F.lit(2).alias("fuzzy"))
    return rounded(search.search(q, search.build_index(named(spark, d))))


@query("X6_phonetic_search")
def x6(spark, d):
    q = view(spark, d, "v_queries").select("qid", F.regexp_replace("q", "i", "y").alias("q"), F.lit(True).alias("phonetic"))
    return rounded(search.search(q, search.build_index(named(spark, d))))


@query("X15_semantic_search")
def x15(spark, d):
    q = view(spark, d, "v_queries").select("qid", "q", F.lit(True).alias("semantic"))
    return rounded(search.search(q, search.build_index(named(spark, d))))


@query("X19_labels", f"WITH {INDEX}, {QT}, {BM}, {CUT.format('bm')}, sc AS (SELECT qid, place_id, {BOOST} AS score FROM cut JOIN v_queries USING (qid) JOIN v_named USING (place_id)), rk AS ({FINAL.format('sc')}) SELECT qid, rank::INT AS rank, p.name || CASE WHEN n_name IS NOT NULL THEN ', ' || n_name ELSE '' END || ', ' || r_name AS label FROM rk JOIN v_named p USING (place_id) JOIN region ON region_id = r_regionkey + 1 LEFT JOIN nation ON nation_id = n_nationkey + 1000 WHERE rank <= 10")
def x19(spark, d):
    hits = search.search(asked(spark, d), index(spark, d), plain=True)
    names_ = view(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("place_id"), F.col("r_name").alias("name")).unionByName(view(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("place_id"), F.col("n_name").alias("name")))
    return search.labelled(hits, names_).select("qid", "rank", "label")


@query("X20_lookup", "SELECT qid AS pos, place_id, name, round(ln(1 + (n - 1 + 0.5) / 1.5), 6) AS score FROM (SELECT min(s_suppkey) AS qid, 1000000000 + s_suppkey % 50 AS place_id FROM supplier GROUP BY 2) JOIN v_named USING (place_id), (SELECT count(*) AS n FROM v_named)")
def x20(spark, d):
    wanted = view(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), (1000000000 + F.col("s_suppkey") % 50).cast("string").alias("token"))
    return search.lookup(wanted, index(spark, d)).withColumn("score", F.round("score", 6))


@query("X21_lookup_gid", "SELECT qid AS pos, place_id, name FROM (SELECT min(s_suppkey) AS qid, 1000000000 + s_suppkey % 70 AS place_id FROM supplier GROUP BY 2) JOIN v_named USING (place_id)")
def x21(spark, d):
    wanted = view(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("x:"), (1000000000 + F.col("s_suppkey") % 70).cast("string")).alias("token"))
    return search.lookup(wanted, index(spark, d)).select("pos", "place_id", "name")


@query("X22_structured", "SELECT c_custkey AS qid, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR || ' ' ELSE '' END || c_mktsegment || ' ' || n_name AS q, CASE WHEN c_custkey % 2 = 0 THEN 'address' ELSE 'street' END AS layer FROM customer JOIN nation ON c_nationkey = n_nationkey")
def x22(spark, d):
    q = view(spark, d, "customer").join(view(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    q = q.select(F.col("c_custkey").alias("qid"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).alias("house_number"), F.col("c_mktsegment").alias("road"), F.lit("  ").alias("city"), F.col("n_name").alias("country"))
    return search.structured(q).select("qid", "q", F.col("layers")[0].alias("layer"))


@query("X23_autoparse", "SELECT qid, NULL::VARCHAR AS category FROM v_addr")
def x23(spark, d):
    q = view(spark, d, "v_addr").withColumn("categories", F.array().cast("array<string>"))
    return search.autoparse(q).select("qid", F.get("categories", F.lit(0)).alias("category"))


@query("X24_complete", "WITH k AS (SELECT DISTINCT lower(name) AS name FROM v_named), q AS (SELECT qid, CASE WHEN qid = 3 THEN '' WHEN qid = 4 THEN 'supplier#000000001 big yellow bolt' ELSE lower(substring(name, 1, 17)) END AS q FROM v_queries JOIN v_named ON place_id = 1000000000 + qid) SELECT qid, rank::INT AS rank, name FROM (SELECT qid, k.name, row_number() OVER (PARTITION BY qid ORDER BY k.name) AS rank FROM q JOIN k ON starts_with(k.name, q)) WHERE rank <= 5")
def x24(spark, d):
    p = view(spark, d, "v_named")
    q = view(spark, d, "v_queries").select("qid").join(p, F.col("place_id") == F.col("qid") + 1000000000)
    q = q.select("qid", F.when(F.col("qid") == 3, "").when(F.col("qid") == 4, "SUPPLIER#000000001 big yellow bolt").otherwise(F.substring("name", 1, 17)).alias("q"))
    return search.complete(q, p, 5)


def _halves(spark, d):
    p = named(spark, d)
    return {"even": search.build_index(p.where("place_id % 2 = 0"), plain=True), "odd": search.build_index(p.where("place_id % 2 = 1"), plain=True)}


FED = """t AS (SELECT place_id % 2 AS m, place_id, unnest({0}) AS term FROM v_named), pt AS (SELECT m, term, place_id, count(*) AS tf FROM t GROUP BY 1, 2, 3), ln AS (SELECT m, place_id, sum(tf) AS len FROM pt GROUP BY 1, 2),
  st AS (SELECT place_id % 2 AS m, count(*) AS n FROM v_named GROUP BY 1), av AS (SELECT m, sum(len) / any_value(n) AS avg_len FROM ln JOIN st USING (m) GROUP BY 1), df AS (SELECT m, term, count(*) AS df FROM pt GROUP BY 1, 2),
  bm AS (SELECT m, qid, place_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS bm25 FROM qt JOIN df USING (term) JOIN pt USING (m, term) JOIN ln USING (m, place_id) JOIN st USING (m) JOIN av USING (m) GROUP BY 1, 2, 3),
  cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, qid ORDER BY round(bm25, 9) DESC, place_id) AS rn FROM bm) WHERE rn <= 50)""".format(NAME_TOK)


@query("X25_federated", f"WITH {QT}, {FED}, sc AS (SELECT qid, place_id, CASE m WHEN 0 THEN 'even' ELSE 'odd' END AS bundle_id, {BOOST} AS score FROM cut JOIN v_queries USING (qid) JOIN v_named USING (place_id)), r1 AS (SELECT *, row_number() OVER (PARTITION BY qid, bundle_id ORDER BY round(score, 9) DESC, place_id) AS k FROM sc) SELECT qid, rank::INT AS rank, place_id, bundle_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, bundle_id, place_id) AS rank FROM r1 WHERE k <= 10) WHERE rank <= 10")
def x25(spark, d):
    return search.federated(asked(spark, d), _halves(spark, d), plain=True).select("qid", "rank", "place_id", "bundle_id", F.round("score", 6).alias("score"))


@query("X26_pelias", f"WITH {INDEX}, {QT}, {BM}, {CUT.format('bm')}, sc AS (SELECT qid, place_id, {BOOST} AS score FROM cut JOIN v_queries USING (qid) JOIN v_named USING (place_id)) SELECT qid, rank::INT AS rank, place_id, round(score / (score + 1), 6) AS confidence FROM ({FINAL.format('sc')}) WHERE rank <= 10")
def x26(spark, d):
    rows = search.search(asked(spark, d), index(spark, d), plain=True)
    return rows.select("qid", "rank", "place_id", F.round(text.confidence(F.col("score")), 6).alias("confidence"))


@query("F3_valid_at", "SELECT id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 1000 + id % 1500 END AS a, CASE WHEN id % 4 = 0 THEN 1500 + id % 900 END AS b FROM v_years) WHERE (a IS NULL OR a <= 1800) AND (b IS NULL OR b >= 1800)")
def f3(spark, d):
    y = view(spark, d, "v_years").select("id", F.when(F.col("id") % 3 == 0, 1000 + F.col("id") % 1500).alias("a"), F.when(F.col("id") % 4 == 0, 1500 + F.col("id") % 900).alias("b"))
    return y.where("(a IS NULL OR a <= 1800) AND (b IS NULL OR b >= 1800)").select("id")
