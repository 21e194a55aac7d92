"""Names and tags of places, as expressions on arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KEPT_TAGS, KEPT_TOO, NAMES, tag


def primary_name(names: Column) -> Column:
    """The first ``default`` name, else the first."""
    return F.coalesce(F.get(F.filter(names, lambda n: n["lang"] == "default"), F.lit(0))["value"], F.get(names, F.lit(0))["value"])


def primary_name_lc(names: Column) -> Column:
    return F.lower(F.coalesce(primary_name(names), F.lit("")))


def collect_names(tags: Column) -> Column:
    """``name`` and ``name:<lang>`` tags as names; a language with a colon is none."""
    own = F.filter(tags, lambda t: (t["key"] == "name") | t["key"].rlike("^name:[^:]+$"))
    return F.transform(own, lambda t: F.struct(F.when(t["key"] == "name", "default").otherwise(F.substring(t["key"], F.lit(6), F.length(t["key"]))).alias("lang"), t["value"].alias("value"))).cast(NAMES)


def kept_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: t["key"].isin(KEPT_TAGS + KEPT_TOO))


def sorted_names(names: Column) -> Column:
    """``default`` first, then by language; equal ones keep their order."""
    return F.transform(F.array_sort(F.transform(names, lambda n, i: F.struct((n["lang"] != "default").alias("other"), n["lang"].alias("lang"), i.alias("i"), n["value"].alias("value")))), lambda n: F.struct(n["lang"].alias("lang"), n["value"].alias("value")))


def gid(tags: Column) -> Column:
    return tag(tags, "gid")


def set_gid(tags: Column, value: Column) -> Column:
    """``tags`` with one ``gid``, the last entry."""
    return F.concat(F.filter(tags, lambda t: t["key"] != "gid"), F.array(F.struct(F.lit("gid").alias("key"), value.alias("value"))))


# The category taxonomy, by tag key: the group, and the values that are of it.
AMENITY = {
    "health": ["hospital", "clinic", "doctors", "pharmacy", "dentist", "veterinary"],
    "food": ["restaurant", "cafe", "bar", "pub", "fast_food", "food_court", "ice_cream", "biergarten"],
    "education": ["school", "university", "college", "kindergarten", "library"],
    "government": ["police", "fire_station", "post_office", "townhall", "courthouse", "embassy", "prison", "social_facility"],
    "finance": ["bank", "atm", "bureau_de_change"],
    "entertainment": ["cinema", "theatre", "arts_centre", "nightclub", "casino"],
    "religion": ["place_of_worship"],
    "transport": ["parking", "fuel", "charging_station", "bus_station", "ferry_terminal", "taxi"],
}
TOURISM = {
    "accommodation": ["hotel", "motel", "hostel", "guest_house", "apartment", "chalet", "alpine_hut", "wilderness_hut", "camp_site", "caravan_site"],
    "attraction": ["museum", "gallery", "attraction", "viewpoint", "theme_park", "zoo", "aquarium", "artwork"],
}
SHOP_FOOD = ["supermarket", "convenience", "grocery", "bakery"]
KIND_CATEGORY = {"country": "admin", "region": "admin", "county": "admin", "city": "admin", "district": "admin", "neighborhood": "admin", "street": "street", "address": "address", "postcode": "postal"}


def categories(kind: Column, tags: Column) -> Column:
    """Distinct category words of a place, in order: of its kind, then of eleven tag keys."""
    none = F.lit(None).cast("string")

    def group(v: Column, table: dict[str, list[str]], other: Column) -> Column:
        out = F.when(v.isNull(), none)
        for name, values in table.items():
            out = out.when(v.isin(values), F.lit(name))
        return out.otherwise(other)

    own = None
    for name in dict.fromkeys(KIND_CATEGORY.values()):
        hit = kind.isin([k for k, v in KIND_CATEGORY.items() if v == name])
        own = F.when(hit, name) if own is None else own.when(hit, name)
    found = [own]
    v = tag(tags, "amenity")
    found += [group(v, AMENITY, none), v]
    v = tag(tags, "shop")
    found += [F.when(v.isNotNull(), "commercial"), F.when(v.isin(SHOP_FOOD), "food"), v]
    v = tag(tags, "tourism")
    found += [group(v, TOURISM, F.lit("tourism")), v]
    for key in ("leisure", "historic", "emergency", "office"):
        v = tag(tags, key)
        found += [F.when(v.isNotNull(), key), v]
    v = tag(tags, "healthcare")
    found += [F.when(v.isNotNull(), "health"), v]
    v = tag(tags, "craft")
    found += [F.when(v.isNotNull(), "commercial"), v]
    for key, values, word in (("aeroway", ["aerodrome", "terminal", "gate"], "airport"), ("railway", ["station", "halt", "tram_stop", "subway_entrance"], "railway")):
        v = tag(tags, key)
        found += [F.when(v.isin(values), "transport"), F.when(v.isin(values), word)]
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))
