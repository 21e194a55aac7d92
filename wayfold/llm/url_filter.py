"""URL filters: explicit host/path rules, then association rules mined from labels.

Spark's FP-growth mines frequent combinations of URL tokens together with the
label of the page; rules ``tokens -> block`` with enough support and confidence are
kept, less those that a shorter kept rule implies. They are matched by an inverted
index: each rule is filed under its rarest token, the distinct urls' tokens are
equi-joined to that file, and a rule holds if all of its tokens are in the url.

Defined results: a null url, or one without ``://``, has empty host and path, fits no
rule and is allowed unless mined rules say otherwise; repeated rows are judged each.
Labels: a page is bad if its row in the label table has quality 0 or toxic 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000
"""Explicit rules are an expression; longer lists are refused."""
BAD = "label=block"

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A-Z are lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (size, name, verdict); null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} at most")
    fits = [F.when((host != "") & ((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("name"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,name:string,verdict:string>")


def tokens(url: Column) -> Column:
    """Distinct tokens with the part of the url they stand in: ``h=`` host, ``p=`` path, ``q=`` query and fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)

    def parts(text: Column, mark: str) -> Column:
        return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.concat(F.lit(mark), t))

    found = F.array_distinct(F.concat(parts(host(url), "h="), parts(path(url), "p="), parts(F.coalesce(rest, F.lit("")), "q=")))
    return F.coalesce(found, F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, min_count: int = 30, min_confidence: float = 0.6) -> DataFrame | None:
    """Rules ``anchor, items, confidence, support``; None if there are too few labelled urls to reach the least support.

    A rule holds on ``min_count`` labelled pages at least, at every size of the table. Rules are a table, joined and never
    collected or broadcast by hint, so their number may grow with the labels.
    """
    from pyspark.ml.fpm import FPGrowth

    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("page_id is not null and bad is not null")
    bad = bad.groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = pages.where("page_id is not null and url is not null").select("page_id", tokens(F.col("url")).alias("items")).join(bad, "page_id")
    known = known.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    n = known.count()
    if n < min_count:
        return None
    model = FPGrowth(itemsCol="items", minSupport=min_count / n, minConfidence=min_confidence).fit(known)
    alone = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("item"), "freq")
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    rarest = rules.select("items", F.explode("items").alias("item")).join(alone, "item").groupBy("items").agg(F.min_by("item", F.struct("freq", "item")).alias("anchor"))
    rules = rules.join(rarest, "items")
    less = rules.select(F.col("anchor").alias("a"), F.col("items").alias("shorter"))
    implied = rules.select("items", F.explode("items").alias("a")).join(less, "a").where((F.size("shorter") < F.size("items")) & (F.size(F.array_except("shorter", "items")) == 0)).select("items").distinct()
    return rules.join(implied, "items", "left_anti").select("anchor", "items", "confidence", "support")


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, confidence`` of the distinct urls that some mined rule fits."""
    urls = pages.where("url is not null").select("url").distinct().withColumn("has", tokens(F.col("url")))
    filed = rules.select("anchor", F.col("items").alias("needs"), "confidence")
    hit = urls.select("url", "has", F.explode("has").alias("anchor")).join(filed, "anchor").where(F.size(F.array_except("needs", "has")) == 0)
    return hit.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame | None, rules: list[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` of every row of ``pages`` (``page_id``, ``url``)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    mined = mine(pages, labels, **mining) if labels is not None else None
    found = pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    if mined is None:
        found = found.withColumn("confidence", F.lit(None).cast("double"))
    else:
        found = found.join(matches(pages, mined), "url", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("fit.name").alias("rule"), verdict.alias("verdict"), "confidence")
