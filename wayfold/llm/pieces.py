"""SentencePiece encoding and decoding on a relational lattice.

The words of the whole corpus are counted with map-side combining. The most frequent ones
(``FREQUENT`` at most, whatever the input; the least count is read off a histogram of
bounded size) make the lattice: their substrings of 2 to the longest piece's length are
exploded and equi-joined to the piece table, and the edges are grouped by word. Each
group is folded by ``aggregate``:

* unigram models: Viterbi, the path with the best sum of scores;
* BPE models: a sum of scores does not give their ids, so the fold replays the merges on
  the same edges: of the pairs of neighbours that an edge covers, that with the best
  score (the leftmost of equals) becomes one, until there is none.

The result, a list of ids a word, goes to all workers. Words that are rarer, or longer than
``LONGEST_UNIT`` characters, are merged in the worker by the same rule: joining
every rare word back to its documents took three times the limit (see the README). There
they are cut into units at places that no piece spans (before a run of word marks, and
between any two characters that stand side by side in no piece), so a word's ids are its
units' ids in order; all new units of a slice are merged at once, one merge a unit a round.
What a worker has learned stays with its copy of the broadcast, for its next tasks.

Decoding maps ids to pieces with a table of the vocabulary's size.

Supported: models with the identity normalizer and no user-defined pieces, as
``piece_bpe_32k.model``; others are refused. Characters without a piece become their
UTF-8 bytes' pieces, or the unknown id if the model has none.

Defined results: null and empty texts have no ids and decode to the empty text; repeated
rows are encoded each; an empty table gives no rows; other columns are ignored. U+2581
stands for a space in the library too, and decodes to one.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, texts

MARK = "▁"
FREQUENT = 200_000
LONGEST_UNIT = 48
MAX_PIECES = 1 << 18
"""Largest vocabulary: what is broadcast has this bound."""
COUNTS_HELD, CACHE_ENTRIES, RARE_ENTRIES = 400_000, 800_000, 250_000
STEPS = 32
"""Classes of counts, for each doubling: the histogram has 64 times as many rows at most."""

_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass(frozen=True)
class Vocabulary:
    """pieces: text -> (id, score) of ordinary pieces; byte: 256 ids, or none; all: every id's piece, with its kind for decoding."""

    kind: str
    pieces: dict[str, tuple[int, float]]
    byte: tuple[int, ...]
    unknown: int
    all: tuple[tuple[str, int], ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    def side_by_side(self) -> np.ndarray:
        """Sorted codes of the pairs of characters that some piece spans; never empty."""
        return np.array(sorted({-1} | {ord(a) << 21 | ord(b) for p in self.pieces for a, b in pairwise(p)}), np.int64)


def load(model: bytes) -> Vocabulary:
    """Reads a SentencePiece model file's bytes."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    kind = {1: "unigram", 2: "bpe"}.get(m.trainer_spec.model_type)
    norm = m.normalizer_spec
    if kind is None or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or m.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in m.pieces) or len(m.pieces) > MAX_PIECES:
        raise ValueError("this kind of SentencePiece model is not supported")
    if any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece[1:] for p in m.pieces):
        raise ValueError("pieces that span words or lines are not supported")
    pieces = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == 1}
    byte = tuple(i for i, p in enumerate(m.pieces) if p.type == 6)
    return Vocabulary(kind, pieces, byte if len(byte) == 256 else (), next(i for i, p in enumerate(m.pieces) if p.type == 2), tuple((p.piece, p.type) for p in m.pieces))


def model_file(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def words_of(text: str) -> list[str]:
    """The text's words, short: one that a single space or the text's begin precedes stands without its mark, one that a line feed precedes with that."""
    if not text:
        return []
    if MARK not in text and "  " not in text and " \n" not in text and text[-1] != " " and text[0] != " ":
        return text.replace("\n", " \n").split(" ")
    return _WORD.findall(MARK + text.replace(" ", MARK))


def marked(word: str) -> str:
    """A word of ``words_of`` as it is encoded."""
    return word if word[:1] in ("\n", MARK) and word else MARK + word


def bare(unit: str) -> str:
    """A word as it is encoded, as ``words_of`` gives it."""
    return unit[1:] if unit[:1] == MARK and unit[1:2] not in ("", "\n", MARK) else unit


def cut_all(words: list[str], near: np.ndarray) -> tuple[list[str], list[int]]:
    """The units of all words in one list, and where in it each word's end. near: sorted codes of the pairs that some piece spans."""
    big = "".join(words)
    codes = np.frombuffer(big.encode("utf-32-le"), "<u4").astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    pairs = (codes[:-1] << 21) | codes[1:]
    cut = near[np.minimum(np.searchsorted(near, pairs), len(near) - 1)] != pairs
    cut[ends[:-1] - 1] = True
    at = np.concatenate(([0], np.flatnonzero(cut) + 1, [len(codes)]))
    flat = at.tolist()
    return [big[i:j] for i, j in pairwise(flat)], np.searchsorted(at, ends).tolist()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of the distinct words with 2 to ``LONGEST_UNIT`` characters, as they are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(m, n) for w, n in seen.items() if 2 <= len(m := marked(w)) <= LONGEST_UNIT]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch):
                for text in part.column(1).to_pylist():
                    seen.update(words_of(text))
                if len(seen) > COUNTS_HELD:
                    yield flush()
        yield flush()

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """``unit``: the words of the highest classes of counts that hold ``most`` words at most together."""
    step = F.floor(F.log2("n") * STEPS)
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):  # 64 * STEPS rows at most
        total += r.words
        if total > most:
            break
        least = r.step
    return counts.where(F.lit(False) if least is None else step >= least).select(F.col("word").alias("unit"))


def piece_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """``piece, score`` of the pieces with two characters or more."""
    rows = [(p, float(s)) for p, (_, s) in v.pieces.items() if len(p) > 1]
    return spark.createDataFrame(pa.table({"piece": pa.array([p for p, _ in rows], pa.string()), "score": pa.array([s for _, s in rows], pa.float64())}))


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``unit, edges``: edges are (begin, end, score) of the substrings of two characters or more that are pieces."""
    subs = F.expr(f"flatten(transform(sequence(0, length(unit) - 2), s -> transform(sequence(2, least({longest}, length(unit) - s)), n -> struct(s as b, s + n as e, substring(unit, s + 1, n) as piece))))")
    rows = units.select("unit", F.inline(subs))
    edges = rows.join(F.broadcast(pieces), "piece").groupBy("unit").agg(F.collect_list(F.struct("b", "e", "score")).alias("edges"))
    return units.select("unit").join(edges, "unit", "left").select("unit", F.coalesce("edges", F.array().cast("array<struct<b:int,e:int,score:double>>")).alias("edges"))


def fold_merges() -> Column:
    """The bounds that BPE merges leave, as bits of a number (bit i: a piece begins or ends at i), from ``unit`` and ``edges``.

    An edge is a candidate while both its ends are bounds and one bound stands between
    them; the fold takes the first candidate in order of score, then place, and clears
    that bound.
    """
    return F.expr("""
        aggregate(
          sequence(2, length(unit)),
          named_struct('m', shiftleft(1L, length(unit) + 1) - 1, 'by', transform(
            array_sort(transform(edges, x -> struct(-x.score as s, x.b as b, x.e as e))),
            x -> named_struct('ends', shiftleft(1L, x.b) | shiftleft(1L, x.e), 'inner', shiftleft(1L, x.e) - shiftleft(2L, x.b)))),
          (s, step) -> named_struct('m', s.m & ~coalesce(get(filter(s.by,
            x -> (s.m & x.ends) = x.ends AND (s.m & x.inner) <> 0 AND (s.m & x.inner & ((s.m & x.inner) - 1)) = 0), 0).inner, 0L), 'by', s.by),
          s -> s.m)""")


def bounds(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def fold_viterbi(unknown: float) -> Column:
    """Bounds of the path with the best sum of scores; ``edges`` must hold single characters too, those without a piece score ``unknown``."""
    return F.expr(f"""
        aggregate(
          sequence(1, length(unit)),
          array(named_struct('score', 0D, 'at', array(0))),
          (best, e) -> concat(best, array(aggregate(
            filter(edges, x -> x.e = e AND x.e - x.b > 1),
            named_struct('score', best[e - 1].score + coalesce(element_at(transform(filter(edges, x -> x.e = e AND x.b = e - 1), x -> x.score), 1), {unknown}D), 'at', concat(best[e - 1].at, array(e))),
            (a, x) -> CASE WHEN best[x.b].score + x.score > a.score THEN named_struct('score', best[x.b].score + x.score, 'at', concat(best[x.b].at, array(e))) ELSE a END))),
          best -> element_at(best, -1).at)""")


def put(unit: str, cuts: list[int], pieces: dict[str, tuple[int, float]], byte: tuple[int, ...], unknown: int) -> bytes:
    """The ids between a unit's bounds, as the bytes of 32-bit numbers."""
    out: list[int] = []
    for a, b in pairwise(cuts):
        p = pieces.get(unit[a:b])
        out += [p[0]] if p else [byte[x] for x in unit[a:b].encode()] if byte else [unknown]
    return array("i", out).tobytes()


def merged(unit: str, pieces: dict[str, tuple[int, float]]) -> list[int]:
    """The bounds that merges leave, with a heap: for long units."""
    n = len(unit)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a] if a >= 0 else n
        if a >= 0 and b < n and (p := pieces.get(unit[a : end[b]])) is not None:
            heapq.heappush(heap, (-p[1], a, b, end[b]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, a, b, e = heapq.heappop(heap)
        if not alive[a] or not alive[b] or after[a] != b or end[b] != e:
            continue
        alive[b], end[a], after[a] = False, e, after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(before[a])
        offer(a)
    return [i for i in range(n) if alive[i]] + [n]


class Merger:
    """Merges many units at once: in each round the best pair of each unit (the leftmost of equals) becomes one."""

    CHARS = 1 << 18
    NONE = np.int32(1 << 30)

    def __init__(self, pieces: dict[str, tuple[int, float]], byte: tuple[int, ...], unknown: int) -> None:
        self.pieces, self.byte, self.unknown = pieces, byte, unknown
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.CHARS  # characters without a piece
        for p, (i, _) in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}

        def of(p: str) -> int | None:
            return int(self.symbol[ord(p)]) if len(p) == 1 else found[0] if (found := pieces.get(p)) else None

        pairs = {}
        for p, (i, score) in pieces.items():
            for k in range(1, len(p)):
                if (a := of(p[:k])) is not None and (b := of(p[k:])) is not None:
                    pairs[a << 21 | b] = order[score], i
        self.key = np.array([-1, *sorted(pairs)], np.int64)
        self.rank = np.array([self.NONE, *(pairs[k][0] for k in self.key[1:].tolist())], np.int32)
        self.made = np.array([0, *(pairs[k][1] for k in self.key[1:].tolist())], np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pairs of symbols (the less the better), and what they become."""
        key = a << 21 | b
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        at[self.key[at] != key] = 0
        return self.rank[at], self.made[at]

    def ids(self, units: list[str]) -> list[bytes]:
        """Each unit's ids, as the bytes of 32-bit numbers."""
        out: dict[int, bytes] = {i: put(u, merged(u, self.pieces), self.pieces, self.byte, self.unknown) for i, u in enumerate(units) if len(u) > LONGEST_UNIT}
        if out:
            short = iter(self.ids([u for u in units if len(u) <= LONGEST_UNIT]))
            return [out[i] if i in out else next(short) for i in range(len(units))]
        if not units:
            return []
        size = np.fromiter(map(len, units), np.int64, len(units))
        symbol = self.symbol[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        whose = np.repeat(np.arange(len(units)), size)
        last, kept = symbol.copy(), np.ones(len(symbol), bool)
        at, sym, own = (x[np.repeat(size > 1, size)] for x in (np.arange(len(symbol)), symbol, whose))
        rank, made = np.full(len(sym), self.NONE), np.zeros(len(sym), np.int64)
        inside = np.flatnonzero(own[:-1] == own[1:])
        rank[inside], made[inside] = self.pair(sym[inside], sym[inside + 1])
        while len(sym):
            begin = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
            best = np.minimum.reduceat(rank, begin)
            many = np.diff(np.append(begin, len(own)))
            if (over := best == self.NONE).any():
                ended = np.repeat(over, many)
                last[at[ended]] = sym[ended]
                at, sym, own, rank, made = (x[~ended] for x in (at, sym, own, rank, made))
                best, many = best[~over], many[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, many))
            hit = hit[np.concatenate(([True], own[hit[1:]] != own[hit[:-1]]))]
            sym[hit] = made[hit]
            kept[at[hit + 1]] = False
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            at, sym, own, rank, made = (x[stay] for x in (at, sym, own, rank, made))
            hit -= np.arange(len(hit))
            for i in (hit, hit[hit > 0] - 1):
                j = np.minimum(i + 1, len(sym) - 1)
                rank[i], made[i] = self.pair(sym[i], sym[j])
                rank[i[(j == i) | (own[i] != own[j])]] = self.NONE
        return self._bytes(last[kept], whose[kept], len(units))

    def _bytes(self, symbol: np.ndarray, whose: np.ndarray, n: int) -> list[bytes]:
        odd = np.flatnonzero(symbol >= self.CHARS)
        if len(odd):
            spelled = [[self.byte[x] for x in chr(c).encode()] if self.byte else [self.unknown] for c in (symbol[odd] - self.CHARS).tolist()]
            many = np.ones(len(symbol), np.int64)
            many[odd] = [len(x) for x in spelled]
            whose = np.repeat(whose, many)
            replaced = np.repeat(symbol >= self.CHARS, many)
            symbol = np.repeat(symbol, many)
            symbol[replaced] = [x for xs in spelled for x in xs]
        raw = symbol.astype("<i4").tobytes()
        ends = np.cumsum(np.bincount(whose, minlength=n)) * 4
        return [raw[a:b] for a, b in pairwise([0, *ends.tolist()])]


class Ids:
    """Encodes texts; keeps words' ids (the bytes of 32-bit numbers) while there is room, those of the lattice always."""

    def __init__(self, near: np.ndarray, pieces: dict[str, tuple[int, float]], byte: tuple[int, ...], unknown: int, frequent: dict[str, bytes]) -> None:
        self.near, self.merger, self.frequent = near, Merger(pieces, byte, unknown), frequent
        self.words = dict(frequent)
        self.rare: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words, all worked out at once."""
        units, ends = cut_all(list(map(marked, words)), self.near)
        known = self.rare.get
        held = {u: known(u) for u in set(units)}
        missing = [u for u, x in held.items() if x is None]
        if len(self.rare) + len(missing) > RARE_ENTRIES:
            self.rare = {}
        fresh = dict(zip(missing, self.merger.ids(missing), strict=True))
        self.rare.update(fresh)
        held.update(fresh)
        ids = list(map(held.__getitem__, units))
        return dict(zip(words, [b"".join(ids[a:b]) for a, b in pairwise([0, *ends])], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split, known = [words_of(t) for t in texts], self.words.get
        held = {w: known(w) for w in set().union(*split)}
        if new := [w for w, x in held.items() if x is None]:
            fresh = self.learn(new)
            held.update(fresh)
            if len(self.words) + len(fresh) > CACHE_ENTRIES:
                self.words = dict(self.frequent)
            self.words.update(fresh)
        get = held.__getitem__
        return [b"".join(map(get, words)) for words in split]


Batches = Iterator[pa.RecordBatch]


def encoder(docs: DataFrame, v: Vocabulary, frequent: int) -> Callable[[pa.RecordBatch], pa.ListArray]:
    """Cuts the corpus's frequent words on the lattice; gives the function that encodes the second column of a batch."""
    if v.kind != "bpe":
        raise ValueError("unigram models: use lattice() and fold_viterbi()")
    spark, near = docs.sparkSession, v.side_by_side()
    top = most_frequent(materialize(word_counts(docs), "words"), frequent)
    cut = lattice(top.repartition("unit"), piece_table(spark, v), v.longest).select("unit", fold_merges().alias("mask"))
    known = {bare(r.unit): put(r.unit, bounds(r.mask), v.pieces, v.byte, v.unknown) for r in cut.collect()}  # ``frequent`` rows at most
    shared = spark.sparkContext.broadcast({"from": (near, v.pieces, v.byte, v.unknown, known)})

    def run(part: pa.RecordBatch) -> pa.ListArray:
        held = shared.value
        if "from" in held:
            held["ids"] = Ids(*held.pop("from"))
        out = held["ids"].encode(part.column(1).to_pylist())
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in out]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), np.int32)))

    return run


def encode(docs: DataFrame, v: Vocabulary, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs`` (``doc_id``, ``text``)."""
    docs = texts(docs)
    ids = encoder(docs, v, frequent)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), ids(part)], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def decoder(spark: SparkSession, v: Vocabulary) -> Callable[[pa.ListArray], Iterator[bytes]]:
    """The function that gives the UTF-8 bytes of each list of ids (null: empty)."""
    table = []
    for piece, kind in v.all:
        table.append(bytes([int(piece[3:5], 16)]) if kind == 6 else b" \xe2\x81\x87 " if kind == 2 else b"" if kind == 3 else piece.replace(MARK, " ").encode())
    shared = spark.sparkContext.broadcast(table)

    def run(column: pa.ListArray) -> Iterator[bytes]:
        lists = column.offsets.to_numpy()
        spelled = pa.array(shared.value, pa.large_binary()).take(column.values.slice(lists[0], lists[-1] - lists[0]))
        ends = np.frombuffer(spelled.buffers()[1], np.int64, len(spelled) + 1) if len(spelled) else np.zeros(1, np.int64)
        raw = spelled.buffers()[2].to_pybytes() if len(spelled) else b""
        begins, null = ends[lists - lists[0]].tolist(), column.is_null().to_pylist()
        for (a, b), no in zip(pairwise(begins), null, strict=True):
            yield b"" if no else raw[a + 1 : b] if raw[a : a + 1] == b" " and a < b else raw[a:b]

    return run


def decode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """``rows`` with the column ``decoded``: the text of the column ``ids`` (null: empty)."""
    text, at = decoder(rows.sparkSession, v), rows.columns.index("ids")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.decode("utf-8", "replace") for x in text(batch.column(at))], pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, decoded string")


def round_trip(docs: DataFrame, v: Vocabulary, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip``: each text's ids, and if they decode to it; both ways in one pass of the same workers."""
    docs = texts(docs)
    forth, back = encoder(docs, v, frequent), decoder(docs.sparkSession, v)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids = forth(part)
                same = [x == t.replace(MARK, " ").encode() for x, t in zip(back(ids), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ids.offsets.to_numpy()), pa.int64()), ids, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")
