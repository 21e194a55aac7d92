"""MinHash near-duplicates with tensored banding, confirmed on full sets.

A document's set is its distinct 5-word shingles. Two collections of ``TABLES`` half keys
(``HASHES`` minhashes each) are computed; a table's key is a pair of one half key from
each, so ``2 * TABLES * HASHES`` minhashes serve ``TABLES ** 2`` tables of ``2 * HASHES`` ones:
about the square root of the work. At a similarity of 0.75, texts share no table with
probability 4e-6, at 0.8 with 1e-7; what is linked through others does not need a table of its own.

1. One pass over the texts: set size, 128-bit digest of the set, half keys. Equal sets
   become one class, with the smallest id, by a pre-aggregated minimum.
2. Only half keys that two classes have are kept, and only classes with such keys on
   both sides pair theirs up to table keys; for unrelated texts it ends there.
3. Every class is held against one other, the smallest that it shares a table with.
   Full sets decide. The links confirmed make components.
4. Tables whose classes are then in more than one component leave work to do. Their
   classes go to an exact search: with shingles in a fixed order, rare ones first, sets of
   that similarity share a shingle among their first ``n - ceil(0.75 n) + 1`` ones, so
   classes meet by these, across components and where sizes and places in that order
   allow it, and full sets decide again: first each with the smallest set that shares
   the shingle, then, across the components that are left, all that meet. A passage common to many texts comes late in that order and brings
   nobody together; a group of copies is one component by then. No link that a table
   could show is given up, and no table is searched pair by pair.

The order of shingles is by counts in a table of fixed size (``SKETCH`` numbers), over all
classes of step 4; ties and collisions only blur the order, never the result.

Defined results: null, empty and blank texts have no set, and each is a component of its
own; rows with equal ids are judged each, and all rows of a kept id are kept; a row
without id is kept, linked with nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts
from .components import components

WORDS, TABLES, HASHES = 5, 24, 3
NEED, OF = 75, 100
SKETCH_BITS = 18
CACHE_ENTRIES = 300_000

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(1 << 62, size=2 * TABLES * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1 << 63, size=2 * TABLES * HASHES, dtype=np.uint64)
_PLACE = _rng.integers(1 << 62, size=WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _rng.integers(1 << 62, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = _rng.integers(1 << 63, size=2 * TABLES, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """Hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles. ``bytes.lower`` changes A-Z alone, ``bytes.split`` parts at space and U+0009..U+000D alone."""
    found = text.encode().lower().split()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, np.uint64(min(len(h), WORDS))) * _PLACE[WORDS]
    for j in range(min(len(h), WORDS)):
        out = mixed(out + h[j : j + n] * _PLACE[j])
    return np.unique(out)


def half_keys(sets: np.ndarray) -> np.ndarray:
    """``2 * TABLES`` keys of ``HASHES`` minhashes each, the first half for one side."""
    low = None
    for at in range(0, len(sets), 2048):
        part = ((sets[at : at + 2048, None] * _ODD + _ADD) >> np.uint64(32)).min(0)
        low = part if low is None else np.minimum(low, part)
    fold = (low.reshape(2 * TABLES, HASHES) * _FOLD).sum(1, dtype=np.uint64)
    return mixed(fold + _TABLE).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """If two sorted distinct sets reach the similarity."""
    if not len(a) or not len(b) or OF * min(len(a), len(b)) < NEED * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return OF * same >= NEED * (len(a) + len(b) - same)


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, n, d1, d2, half`` of every row; half is null if the set is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("half", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingles(text, words)
                    raw = s.tobytes()
                    d1, d2 = (xxhash.xxh3_64_intdigest(raw, k) - (1 << 63) for k in (1, 2))
                    rows.append((d, len(s), d1, d2, half_keys(s) if len(s) else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, half array<long>")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose full sets, from ``held`` (``rep``, ``text``), reach the similarity."""
    both = pairs.join(held.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = Words(), {}

        def sets(i: int, text: str) -> np.ndarray:
            if i not in last:
                if len(last) >= 64:
                    last.clear()
                last[i] = shingles(text, words)
            return last[i]

        for batch in batches:
            for part in slices(batch, 3):
                ok = [linked(sets(a, ta), sets(b, tb)) for a, b, ta, tb in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def prefixes(left: DataFrame) -> DataFrame:
    """``shingle, rep, n, pos`` of each class's rarest shingles, as many as a partner must share one of. left: ``rep, text``."""
    spark, mask = left.sparkSession, np.uint64((1 << SKETCH_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount((shingles(text, words) & mask).astype(np.int64), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["slot", "n"])

    rows = left.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # a slot each, at most
    table = np.zeros(1 << SKETCH_BITS, np.int64)
    table[[r.slot for r in rows]] = [r.n for r in rows]
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(), shared.value
        for batch in batches:
            for part in slices(batch):
                keys, reps, sizes, places = [], [], [], []
                for rep, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    s = shingles(text, words)
                    n = len(s)
                    first = s[np.lexsort((s, table[(s & mask).astype(np.int64)]))][: n - -(-NEED * n // OF) + 1]
                    keys.append(first.view(np.int64))
                    reps.append(np.full(len(first), rep))
                    sizes.append(np.full(len(first), n))
                    places.append(np.arange(len(first)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (keys, reps, sizes, places)], ["shingle", "rep", "n", "pos"])

    return left.select("rep", "text").mapInArrow(run, "shingle long, rep long, n long, pos long")


#: Of two sets whose first common shingle stands at these places, the intersection can still be large enough: ``100 (a + b - s) >= ...`` solved for s.
MAY_LINK = f"ca <> cb and {OF} * least(na, nb) >= {NEED} * greatest(na, nb) and {OF + NEED} * least(na - pa, nb - pb) >= {NEED} * (na + nb)"


def meeting(firsts: DataFrame, comps: DataFrame, star: bool) -> DataFrame:
    """``a, b``: classes of different components that share one of their first shingles where sizes and places allow a link.

    star: each is paired with the smallest set of those that share the shingle, not with all.
    """
    rows = firsts.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = F.min(F.struct("n", "rep", "component", "pos")).alias("s")
    open_ = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), smallest).where("lo < hi")
    x = rows.select("shingle", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    if star:
        y = open_.select("shingle", F.col("s.rep").alias("b"), F.col("s.component").alias("cb"), F.col("s.n").alias("nb"), F.col("s.pos").alias("pb"))
        return x.join(y, "shingle").where(MAY_LINK).select("a", "b").distinct()
    rows = rows.join(open_.select("shingle"), "shingle", "left_semi")
    x, y = (rows.select("shingle", F.col("rep").alias(i), F.col("component").alias("c" + i), F.col("n").alias("n" + i), F.col("pos").alias("p" + i)) for i in "ab")
    return x.join(y, "shingle").where(f"a > b and {MAY_LINK}").select("a", "b").distinct()


def shared_halves(classes: DataFrame, side: str, begin: int) -> DataFrame:
    """``rep, <side>``: the half keys of one side that some other class has too."""
    rows = classes.select("rep", F.explode(F.slice("half", begin + 1, TABLES)).alias("key"))
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return rows.join(often, "key", "left_semi").groupBy("rep").agg(F.collect_list("key").alias(side))  # TABLES at most


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id``, ``text``)."""
    docs = texts(docs)
    rows = materialize(sketched(docs), "sketches")
    usable = rows.where("n > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("half").alias("half")), "classes")
    tables = shared_halves(classes, "left", 0).join(shared_halves(classes, "right", TABLES), "rep")
    tables = tables.select("rep", "right", F.explode("left").alias("l")).select("rep", "l", F.explode("right").alias("r")).select("rep", F.xxhash64("l", "r").alias("key"))
    tables = materialize(tables, "tables")
    leaders = tables.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("most")).where("leader < most").select("key", "leader")
    first = materialize(tables.join(leaders, "key").groupBy("rep").agg(F.min("leader").alias("b")).select(F.col("rep").alias("a"), "b"), "candidates")
    held = materialize(docs.withColumnRenamed("doc_id", "rep").join(first.select(F.col("a").alias("rep")), "rep", "left_semi"), "texts")
    links = materialize(verified(first.where("a > b"), held), "links")
    comps = materialize(components(links), "components")
    where = tables.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = where.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = where.join(open_, "key", "left_semi").select("rep").distinct().join(held, "rep")
    firsts = materialize(prefixes(materialize(left, "left")), "prefixes")
    for star in (True, False):
        more = verified(materialize(meeting(firsts, comps, star), "meeting"), held)
        links = materialize(links.unionByName(more), "links")
        comps = materialize(components(links), "components")
    comps = comps.withColumnRenamed("node", "rep")
    found = classes.select("d1", "d2", "rep").join(comps, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    key = [F.when(F.col("n") > 0, F.col(k)).alias(k) for k in ("d1", "d2")]  # empty sets meet nothing
    out = rows.select("doc_id", "n", *key).join(found, ["d1", "d2"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))



def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that ``judge`` keeps."""
    gone = judge(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
