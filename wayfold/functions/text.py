"""Tokens, stop-words, trigrams, years, addresses, abbreviations and labels, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interior stop-words by language group.
STOP_WORDS = """
a an and as at by for from in into of on or the to with
am an auf aus bei das dem den der des die ein eine im in mit und von vom zum zur
à au aux de des du en et la le les sur
al alla alle alto ai del della delle di il la le lo su sul sulla
a al da das de del do dos el en la las los para por
aan bij de der het in naar op te tot van voor
""".split()
# Abbreviations that address expansion knows, each with or without a full stop.
ABBREVIATIONS = {"st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "ln": "lane", "dr": "drive", "ct": "court", "pl": "place", "n": "north", "s": "south", "e": "east", "w": "west"}
# The partial Latin fold of trigrams.
TRIGRAM_FROM, TRIGRAM_TO = "àáâãäåæçèéêëìíîïñòóôõöøœšùúûüýÿž", "aaaaaaaceeeeiiiinooooooosuuuuyyz"
PAD = "\x01"
CJK = "[\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF]"
LONGEST_TOKEN, LONGEST_PREFIX, LONGEST_PREFIX_BYTES = 40, 25, 64


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: what stands inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, shorter than 40 bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) < LONGEST_TOKEN))


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def ngrams(text: Column, low: int, high: int) -> Column:
    """All n-grams of a lower-cased text with low to high characters."""
    return let(F.lower(text), lambda t: F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))).otherwise(F.array().cast("array<string>")))))


def prefixes(text: Column) -> Column:
    """Prefixes of the whole lower-cased value with 1 to 25 characters and 64 bytes at most."""
    return let(F.lower(text), lambda t: F.when(F.length(t) > 0, F.filter(F.transform(F.sequence(F.lit(1), F.least(F.length(t), F.lit(LONGEST_PREFIX))), lambda n: F.substring(t, F.lit(1), n)), lambda p: F.octet_length(p) <= LONGEST_PREFIX_BYTES)).otherwise(F.array().cast("array<string>")))


def trigram_fold(text: Column) -> Column:
    """Lower case, partial Latin fold, everything but letters and digits to single spaces, trimmed."""
    t = F.translate(F.regexp_replace(F.lower(text), "ß", "ss"), TRIGRAM_FROM, TRIGRAM_TO)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the folded, padded text, in order."""
    padded = F.concat(F.lit(PAD), trigram_fold(text), F.lit(PAD))
    return let(padded, lambda p: F.when(F.length(p) > 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))).otherwise(F.array().cast("array<string>")))


def drop_stop_words(query: Column) -> Column:
    """Of three words or more, the inner ones that are lower-case stop-words go; the first and last stay."""
    words = F.split(F.trim(F.regexp_replace(query, r"\s+", " ")), " ")
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: ~w.isin(sorted(set(STOP_WORDS))))  # no words in the lambda: they would be split anew for each
    kept = F.concat(F.slice(words, 1, 1), inner, F.slice(words, -1, 1))
    return F.when((F.size(words) < 3) | (F.size(kept) == F.size(words)), query).otherwise(F.array_join(kept, " "))


def parse_year(text: Column) -> Column:
    """A year from loose text: ``1939-09-01``, ``before 1939``, ``ca. 1200``, ``44 BC`` (negative); else null."""
    low = F.lower(F.trim(text))
    digits = F.trim(F.regexp_replace(low, r" ?bc$", ""))
    plain = F.regexp_replace(digits, r"^(before )*(after )*(circa )*(ca\. )*(ca\.)*(c\. )*", "")
    year = F.regexp_extract(F.trim(plain), r"^([0-9]+)", 1)
    return F.when(year != "", year.try_cast("long") * F.when(low.endswith("bc"), -1).otherwise(1))


def fuzzy_distance(token: Column, most: Column) -> Column:
    """Edits allowed: none up to 3 characters, 1 up to 5, else 2; never more than asked for."""
    n = F.length(token)
    return F.least(most, F.when(n <= 3, 0).when(n <= 5, 1).otherwise(2))


def expand(address: Column) -> Column:
    """Lower case, abbreviations written out, commas at the ends of words dropped; null if blank."""
    words = F.filter(F.split(F.lower(F.trim(address)), r"\s+"), lambda w: w != "")

    def out(w: Column) -> Column:
        bare = F.regexp_replace(w, ",+$", "")
        found = None
        for short, long in ABBREVIATIONS.items():
            hit = bare.isin(short, short + ".")
            found = F.when(hit, long) if found is None else found.when(hit, long)
        return found.otherwise(bare)

    return F.when(F.trim(address) != "", F.array_join(F.transform(words, out), " "))


def parse_address(address: Column) -> Column:
    """struct(house_number, road, unit, city, state, postcode, country) by commas: number and road, then postcode, city and state, then a country."""
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != "")
    n, first, last = F.size(parts), F.get(parts, F.lit(0)), F.element_at(parts, -1)
    leading = F.regexp_extract(first, r"^([0-9]+[A-Za-z](?= |$)|[0-9]+)", 1)
    number = F.when(leading != "", leading)
    road = F.trim(F.substring(first, F.length(leading) + 1, F.length(first)))
    is_country = (n >= 2) & last.rlike(r"^[\p{L} .]+$") & (F.octet_length(last) <= 32)
    middle = F.slice(parts, 2, F.greatest(n - 1 - F.when(is_country, 1).otherwise(0), F.lit(0)))
    code = r"^([0-9]{3,8}[A-Za-z]?) "
    codes = F.filter(F.transform(middle, lambda p: F.regexp_extract(p, code, 1)), lambda c: c != "")
    rest = F.filter(F.transform(middle, lambda p: F.trim(F.regexp_replace(p, code, ""))), lambda p: p != "")
    return F.when(
        n > 0,
        F.struct(number.alias("house_number"), F.when(road != "", road).alias("road"), F.lit(None).cast("string").alias("unit"), F.get(rest, F.lit(0)).alias("city"), F.get(rest, F.lit(1)).alias("state"), F.get(codes, F.lit(0)).alias("postcode"), F.when(is_country, last).alias("country")),
    )


def normal_lang(lang: Column) -> Column:
    """Without the mark of an alias."""
    return F.regexp_replace(lang, "_alt$", "")


def label_key(name: Column) -> Column:
    """What labels compare: lower case, cut before a parenthesis, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"(?s)\(.*$", ""))


def label(name: Column, admin_names: Column) -> Column:
    """The name and its admin names from leaf to root, without repeats."""
    entries = F.concat(F.array(name), F.filter(admin_names, lambda x: x.isNotNull() & (label_key(x) != "")))
    keys = F.transform(entries, label_key)
    return F.array_join(F.filter(entries, lambda x, i: (i == 0) | (F.array_position(keys, label_key(x)) == i + 1)), ", ")


def confidence(score: Column) -> Column:
    return score / (score + 1)
