"""Benchmark decontamination: q-gram lemma filtering, then banded alignment.

Benchmark items and documents are normalised alike (lower case, runs of ASCII
punctuation and space to one space). Every q-gram of a document that an item has is a hit
on the diagonal (place in document - place in item). Hits are counted by item in
diagonal bands, which overlap by half so that a match whose edits shift it by up to half
a band lies in one band whole. By the q-gram lemma a stretch of ``m`` bytes with ``e``
edits shares at least ``m + 1 - q - q * e`` q-grams; bands with fewer hits are dropped. What
is left is verified by banded alignment, which looks for the longest stretch within budget in it.

A document is contaminated by an item if it holds a stretch of it of ``STRETCH`` bytes (or
all of a shorter one) with one edit in ``BYTES_PER_EDIT`` bytes at most, or a longer stretch
within its budget whose edits shift it by half a band at most.

The items go to the workers in blocks of bounded size (one block, usually); each block is
matched against all documents in a map without any shuffle: the documents are read once for each ``BLOCK_BYTES`` of items.

Defined results: null and empty texts and items match nothing; items of fewer than ``Q``
normalised bytes match nothing; repeated documents are reported each, repeated items
(equal ids) once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

Q = 10
STRETCH = 80
BYTES_PER_EDIT = 16
BAND = 16
FAR = 4 * STRETCH + Q
"""Hits that are further apart are looked at separately: so long a part without a hit has so many edits that one side alone has a stretch within budget."""
STARTS = 1 << 12
"""Places of an item from which alignments are carried on at once."""
BLOCK_BYTES = 8 << 20
"""Normalised item text in one block, at most (one item at least)."""
MOST_HITS = 1 << 21
"""Hits of a text that are held at once; what is more repetitive than that is looked at item by item, in blocks of diagonals, with the same result."""
TABLE_BITS = 22

_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str) -> bytes:
    """The text as it is compared, with a space at either end."""
    return b" " + b" ".join(text.lower().encode().translate(_SPACE).split()) + b" "


def grams(raw: bytes) -> np.ndarray:
    """Hashes of all q-grams (8 bytes and 2 bytes, mixed)."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    a = np.ndarray((n,), "<u8", raw, 0, (1,)) * _C1
    b = np.ndarray((n,), "<u2", raw, 8, (1,)).astype(np.uint64) * _C2
    h = a ^ (b + (a >> np.uint64(29)))
    return h * _C1


def budget(m: int) -> int:
    return m // BYTES_PER_EDIT


def least_hits(m: int) -> int:
    """By the q-gram lemma, of a stretch of m bytes within its budget."""
    return max(1, m + 1 - Q - Q * budget(m))


class Index:
    """Q-grams of a block of items: sorted hashes with (item, place) postings, and a table that tells most absent ones."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items = items
        hashes = [grams(raw) for _, raw in items]
        key = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order]
        self.key, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.least = np.array([least_hits(min(len(raw), STRETCH)) for _, raw in items], np.int64)

    def shared(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text's q-grams that an item has, and their numbers."""
        h = grams(raw)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.key, h[at]), len(self.key) - 1)
        same = self.key[k] == h[at]
        return at[same], k[same]

    def hits(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in item, place in text) of every shared q-gram."""
        at, k = self.shared(raw)
        return self._hits(at, k)

    def _hits(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.count[k]
        post = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(at) else at
        return self.item[post], self.place[post], np.repeat(at, n)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, bytes matched, edits, place in the normalised text) of the items found, each once with its longest stretch."""
        raw = normal(text)
        at, k = self.shared(raw)
        if not len(at):
            return []
        found: dict[int, tuple[int, int, int]] = {}
        if self.count[k].sum() <= MOST_HITS:
            self._banded(*self._hits(at, k), raw, found)
        else:
            for i in range(len(self.items)):
                self._repetitive(i, raw, found)
        return sorted((self.items[i][0], *x) for i, x in found.items())

    def _banded(self, item: np.ndarray, place: np.ndarray, at: np.ndarray, raw: bytes, found: dict, first: int | None = None, last: int = 0) -> None:
        """Looks at all bands with enough hits; with ``first``, at those that begin from there up to ``last``."""
        diagonal = at - place + (1 << 40)
        for shift in (0, BAND // 2):
            band = item * (1 << 42) + (diagonal + shift) // BAND
            order = np.argsort(band, kind="stable")
            kinds, begin, count = np.unique(band[order], return_index=True, return_counts=True)
            for b in np.flatnonzero(count >= self.least[kinds >> 42]):
                i = int(kinds[b] >> 42)
                low = (int(kinds[b]) & ((1 << 42) - 1)) * BAND - shift - (1 << 40)
                if first is not None and not first <= low < last:
                    continue
                mine = order[begin[b] : begin[b] + count[b]]
                got = self._verified(i, place[mine], at[mine], low, raw)
                if got and (i not in found or (-got[0], got[1], got[2]) < (-found[i][0], found[i][1], found[i][2])):
                    found[i] = got

    def _repetitive(self, i: int, raw: bytes, found: dict) -> None:
        """One item against a text with very many hits: a block of diagonals at a time, each with the part of the text that it touches."""
        own = self.items[i][1]
        if (p := raw.find(own)) >= 0:
            found[i] = len(own), 0, p
            return
        key, place = np.unique(grams(own), return_inverse=True)
        if not len(key):
            return
        h = grams(raw)
        k = np.minimum(np.searchsorted(key, h), len(key) - 1)
        at = np.flatnonzero(key[k] == h)
        k = k[at]
        filed = np.sort(place * (1 << 40) + np.arange(len(place)))  # by q-gram, then place
        wide = max(BAND, min(1024, (MOST_HITS // len(own)) // BAND * BAND))
        begin = -(len(own) // wide + 1) * wide
        before = None
        for low in range(begin, len(raw), wide):
            a, z = max(0, low - BAND), low + wide + BAND + len(own)
            part = raw[a:z] if low - BAND >= 0 and z <= len(raw) else None
            if part is not None and part == before:
                continue  # as the block before, whose places are smaller
            before = part
            x, y = np.searchsorted(at, (a, z))
            t, kt = at[x:y], k[x:y]
            lo = np.searchsorted(filed, kt * (1 << 40) + np.maximum(0, t - low - wide - BAND + 1))
            hi = np.maximum(lo, np.searchsorted(filed, kt * (1 << 40) + np.minimum(len(own), t - low + BAND), side="right"))
            hi[t - low + BAND < 0] = lo[t - low + BAND < 0]
            n = hi - lo
            post = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else n
            if len(post):
                self._banded(np.full(len(post), i), filed[post] & ((1 << 40) - 1), np.repeat(t, n), raw, found, low, low + wide)

    def _verified(self, i: int, place: np.ndarray, at: np.ndarray, low: int, raw: bytes) -> tuple[int, int, int] | None:
        """(bytes, edits, place in the text) of the longest stretch within budget near the diagonals from ``low`` on."""
        own = self.items[i][1]
        need = min(len(own), STRETCH)
        order = np.argsort(place, kind="stable")
        place, at = place[order], at[order]
        best = None
        for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place) > FAR) + 1):
            if len(part) < least_hits(need):
                continue
            a, z = int(place[part[0]]), int(place[part[-1]]) + Q
            p, e = int(at[part].min()), int(at[part].max()) + Q
            if z - a >= need and own[a:z] == raw[p:e]:
                got = z - a, 0, p
            else:
                a, z = max(0, a - need), min(len(own), z + need)
                got = longest(own[a:z], raw, a + low, need)
            if got and (best is None or (-got[0], got[1], got[2]) < (-best[0], best[1], best[2])):
                best = got
        return best


def runs(own: bytes, raw: bytes, low: int) -> np.ndarray:
    """Bytes that are equal from place ``j`` of ``own`` on, by diagonal (from ``low - BAND // 2``, two bands wide) and ``j``."""
    n, wide = len(own), 2 * BAND
    text = np.full(n + wide - 1, -1, np.int16)
    first = low - BAND // 2
    a, z = max(0, first), min(len(raw), first + len(text))
    if a < z:
        text[a - first : z - first] = np.frombuffer(raw, np.uint8, z - a, a)
    differs = np.lib.stride_tricks.sliding_window_view(text, n) != np.frombuffer(own, np.uint8)
    at = np.arange(n, dtype=np.int32)
    ends = np.minimum.accumulate(np.where(differs, at, np.int32(n))[:, ::-1], axis=1)[:, ::-1]
    return np.pad(ends - at, ((0, 0), (0, 1)))


def reaches(run: np.ndarray, start: np.ndarray, diagonal: np.ndarray | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 0 to ``most`` edits: the furthest place reached from each start on each diagonal, and how many equal bytes end there.

    A start is on its diagonal, or (None) on any. Bytes beyond the text differ from all, which costs as much as leaving them out.
    """
    wide, n = len(run), run.shape[1] - 1
    every = np.arange(wide)[None, :]
    far = np.repeat(start[:, None], wide, axis=1).astype(np.int64)
    if diagonal is not None:
        far[every != diagonal[:, None]] = -1
    for edits in range(most + 1):
        if edits:
            new = np.where(far < 0, -1, far + 1)
            new[:, :-1] = np.maximum(new[:, :-1], np.where(far[:, 1:] < 0, -1, far[:, 1:] + 1))
            new[:, 1:] = np.maximum(new[:, 1:], far[:, :-1])
            far = np.minimum(new, n)
        equal = np.where(far < 0, 0, run[every, np.maximum(far, 0)])
        far = far + equal
        yield far, equal


def longest(own: bytes, raw: bytes, low: int, need: int) -> tuple[int, int, int] | None:
    """(bytes, edits, place in ``raw``) of the longest stretch of ``own`` within budget, of ``need`` bytes at least.

    A stretch that is long enough without what lies beyond its first and last run of ``Q`` equal
    bytes stays within budget if it ends there, and it begins where its first run does: few starts are to
    be tried. The others hold one of ``need`` bytes within budget, looked for at every place.
    """
    run, n = runs(own, raw, low), len(own)
    first = low - BAND // 2
    best: tuple[int, int, int] | None = None
    begins = run[:, :-1] >= Q
    begins[:, 1:] &= run[:, :-2] == 0
    diagonal, start = np.nonzero(begins)
    keep = np.flatnonzero(start <= n - need)
    for k in np.split(keep, range(STARTS, len(keep), STARTS)):
        a, d = start[k], diagonal[k]
        for edits, (far, equal) in enumerate(reaches(run, a, d, budget(n - int(a.min())) if len(a) else -1)):
            size = np.where(equal >= Q, far, 0).max(axis=1) - a
            for j in np.flatnonzero(size >= max(need, BYTES_PER_EDIT * edits)):
                got = int(size[j]), edits, max(0, int(a[j] + d[j]) + first)
                if best is None or (-got[0], got[1], got[2]) < (-best[0], best[1], best[2]):
                    best = got
    if best is not None and best[0] > need:
        return best
    every = np.arange(n - need + 1)
    for a in np.split(every, range(STARTS, len(every), STARTS)):
        for edits, (far, _) in enumerate(reaches(run, a, None, budget(need))):
            if best is not None and edits >= best[1]:
                break
            whole = np.flatnonzero(far.max(axis=1) >= a + need)
            if len(whole):
                one = np.repeat(a[whole[:1]], len(run))
                *_, (last, _) = reaches(run, one, np.arange(len(run)), edits)
                d = int(np.flatnonzero(last.max(axis=1) >= one + need)[0])
                best = need, edits, max(0, int(one[0]) + d + first)
                break
    return best


def distance(a: bytes, b: bytes, most: int) -> int:
    """Edit distance by banded alignment; ``most + 1`` if it is above ``most`` (the plain form, for tests)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                new[j] = i
                continue
            new[j] = min(row.get(j - 1, far) + (x != b[j - 1]), row.get(j, far) + 1, new.get(j - 1, far) + 1)
        if min(new.values()) > most:
            return far
        row = new
    return min(row.get(len(b), far), far)


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, bytes]]]:
    """The items, normalised, in lists of bounded size."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    held: list[tuple[int, bytes]] = []
    size = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        raw = normal(r.text)
        if len(raw) < Q:
            continue
        if held and size + len(raw) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r.item_id, raw))
        size += len(raw)
    if held:
        yield held


FOUND = "doc_id long, item_id long, matched_bytes int, edits int, place int"


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, matched_bytes, edits, place`` for each document and item it holds a stretch of; clean documents give no row."""
    spark, docs = docs.sparkSession, texts(docs)
    out = spark.createDataFrame([], FOUND)
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                for part in slices(batch):
                    rows = [(d, *m) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for m in index.matches(t)]
                    if rows:
                        cols = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "matched_bytes", "edits", "place"])

        out = out.unionByName(docs.mapInArrow(run, FOUND))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched_bytes", -F.col("edits"), -F.col("place"))).alias("m")).select("doc_id", "item_id", "m.matched_bytes", (-F.col("m.col2")).alias("edits"), (-F.col("m.col3")).alias("place"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item; a map without a shuffle."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                for part in slices(batch, at):
                    yield part.filter(pa.array([not t or not index.matches(t) for t in part.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
