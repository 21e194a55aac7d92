"""Toxicity: subword-bag embeddings, averaged, into a linear softmax.

A word is the bag of its character 3- to 5-grams (with word-boundary marks),
hashed into a fixed number of buckets; a misspelling that was never seen
shares most of them. A window of eight words (repeats within it count once) is
the mean of its words' vectors, and
embeddings and softmax are trained jointly in numpy. Since a few words make a text
toxic, the text's logit is the largest of its windows' (overlapping by half, the last
one flush with the end): long texts are not diluted, and whole texts are read.

Training uses a bounded sample (``MAX_PER_CLASS`` labelled rows of class 0 and of class 1 with
``MAX_TRAIN_CHARS`` characters at most, by hash of the id, of those whose document has a text). Scoring is one map over
all rows with a model of fixed size; since all is linear up to the maximum, workers
need only one number for each bucket.

Defined results: null, empty or blank text has score 0; without labelled rows of both
classes every score is 0; contradicting labels of an id count as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

BUCKETS, DIM, WINDOW, STRIDE = 1 << 17, 8, 8, 4
GRAMS = (3, 4, 5)
MAX_PER_CLASS = (4_000, 2_000)
MAX_TRAIN_CHARS = 8_000
THRESHOLD = 0.3
STEPS_ALL, STEPS_MAX, RATE, DECAY, NEARER = 25, 60, 0.05, 1e-5, 0.2
"""``DECAY`` and ``NEARER`` come from a threefold cross-validation on training rows alone (4 by 5 values): of those within 0.005 of the
best F1 (0.9987), the strongest decay and the cut nearest to class 0 (F1 0.9946), since unseen misspellings score lower."""
CACHE_ENTRIES = 300_000
WORDS_AT_ONCE = 20_000
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—·¿¡"


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never taken from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_SPREAD = np.random.default_rng(20240301).integers(1 << 62, size=GRAMS[-1] + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bags(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of white-space-delimited chunks, and whose they are (ascending); all chunks at once."""
    marked = [f"<{low.strip(EDGE) or low}>" for low in map(str.lower, chunks)]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(marked), dtype=np.int32), [len(w) for w in marked])
    found, whose = [], []
    for n in GRAMS:
        m = max(0, len(codes) - n + 1)
        h = np.full(m, np.uint64(n)) * _SPREAD[0]
        for j in range(n):
            h = (h ^ codes[j : m + j]) * _SPREAD[j + 1]
            h ^= h >> np.uint64(31)
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        found.append(((h * _SPREAD[0]) >> np.uint64(47)).astype(np.int32)[inside])
        whose.append(owner[:m][inside])
    flat, whose_all = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    return flat[order], whose_all[order]


def kept_words(text: str) -> list[str]:
    """The text's words, less those that stood among the ``WINDOW - 1`` words before: repeats in a window count once."""
    last: dict[str, int] = {}
    out = []
    for i, w in enumerate(text.split()):
        if i - last.get(w, -WINDOW) >= WINDOW:
            out.append(w)
        last[w] = i
    return out


def starts(n: int) -> np.ndarray:
    """Where the windows of a text of n words begin."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW + 1, STRIDE), n - WINDOW))


@dataclass
class Model:
    """value: what each bucket adds to a logit; bias: added once."""

    value: np.ndarray
    bias: float

    def words(self, chunks: list[str]) -> list[float]:
        """What each chunk adds to its window's sum."""
        if not chunks:
            return []
        flat, whose = bags(chunks)
        return (np.bincount(whose, self.value[flat], len(chunks)) / np.bincount(whose, minlength=len(chunks))).tolist()

    def score(self, values: np.ndarray) -> float:
        """Of a text, from its words' values."""
        n = len(values)
        if not n:
            return 0.0
        total = np.concatenate(([0.0], np.cumsum(values)))
        at = starts(n)
        logit = float((total[np.minimum(at + WINDOW, n)] - total[at]).max()) / WINDOW + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def train(rows: list[tuple[str, int]], seed: int = 11) -> Model:
    """Fits the model on (text, label) rows."""
    words: dict[str, int] = {}
    mats, owner, labels = [], [], []
    for text, label in rows:
        ids = np.array([words.setdefault(w, len(words)) for w in kept_words(text)], np.int32)
        if not len(ids):
            continue
        at = starts(len(ids))
        padded = np.concatenate((ids, np.full(WINDOW, -1, np.int32)))
        mats.append(padded[at[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(at), len(labels), np.int32))
        labels.append(label)
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), -40.0)
    blocks = []  # of words, each with its n-grams: what is worked out for all n-grams of a block is not held for all words
    for at in range(0, len(words), WORDS_AT_ONCE):
        flat, whose = bags(list(islice(words, at, at + WORDS_AT_ONCE)))
        blocks.append((flat, whose, np.concatenate(([0], np.flatnonzero(np.diff(whose)) + 1)), slice(at, at + WORDS_AT_ONCE)))
    size = np.concatenate([np.bincount(whose) for _, whose, _, _ in blocks]).astype(np.int32)
    m, owner = np.concatenate(mats), np.concatenate(owner)
    mats.clear()
    first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    slot = np.where(m < 0, np.int32(len(size)), m)
    del m
    rng = np.random.default_rng(seed)
    emb, out, bias = [rng.normal(0, 0.1, BUCKETS).astype(np.float32) for _ in range(DIM)], rng.normal(0, 0.5, DIM), 0.0
    class_weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    windows_of = np.diff(np.append(first, len(owner)))
    logits = np.zeros(len(owner))
    adam: dict[int, list] = {}

    def moved(key: int, p, g, step: int):
        mo = adam.setdefault(key, [0.0, 0.0])
        mo[0], mo[1] = 0.9 * mo[0] + 0.1 * g, 0.99 * mo[1] + 0.01 * g * g
        return p - RATE * (mo[0] / (1 - 0.9**step)) / (np.sqrt(mo[1] / (1 - 0.99**step)) + 1e-8)

    for step in range(1, STEPS_ALL + STEPS_MAX + 2):
        vectors = [np.concatenate([np.add.reduceat(e[flat], begin) for flat, _, begin, _ in blocks]) / size for e in emb]
        value = np.append(sum(v * o for v, o in zip(vectors, out, strict=True)), 0.0)
        logits = sum(value[slot[:, j]] for j in range(WINDOW)) / WINDOW + bias
        if step > STEPS_ALL + STEPS_MAX:
            break
        prob = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
        if step <= STEPS_ALL:
            grad = (prob - y[owner]) * (class_weight / windows_of)[owner]
        else:
            top = np.maximum.reduceat(logits, first)
            best = logits >= top[owner]
            grad = np.where(best, (prob - y[owner]) * (class_weight / np.add.reduceat(best, first))[owner], 0)
        used = np.flatnonzero(grad)
        per_word = sum(np.bincount(slot[used, j], grad[used] / WINDOW, len(size) + 1) for j in range(WINDOW))[:-1]
        share = per_word / size
        per_bucket = sum(np.bincount(flat, share[own][whose], BUCKETS) for flat, whose, _, own in blocks)
        slope = np.array([v @ per_word for v in vectors])
        emb = [moved(d, e, (per_bucket * out[d] + DECAY * e).astype(np.float32), step).astype(np.float32) for d, e in enumerate(emb)]
        out, bias = moved(-1, out, slope, step), moved(-2, bias, grad.sum(), step)
    tops = np.maximum.reduceat(logits, first)
    value = sum(e * o for e, o in zip(emb, out, strict=True)).astype(np.float32)
    return Model(value, bias + np.log(THRESHOLD / (1 - THRESHOLD)) - cut(tops, y))


def cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the classes with the best F1; in its gap, nearer to class 0, since unseen misspellings score lower than what was trained on."""
    order = np.argsort(-logits, kind="stable")
    z, hit = logits[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(np.argmax(f1))
    return float(NEARER * z[k] + (1 - NEARER) * z[k + 1]) if k + 1 < len(z) else float(z[k] - 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = MAX_PER_CLASS) -> Model:
    """Trains on a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.where(F.col("text").rlike(r"\S") & (F.length("text") <= MAX_TRAIN_CHARS))
    ids = usable.select("doc_id").distinct().join(known, "doc_id")
    label_of: dict[int, int] = {}
    for c in (0, 1):
        label_of |= {r.doc_id: c for r in ids.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[c]).collect()}
    if not label_of:
        return Model(np.zeros(BUCKETS, np.float32), -40.0)
    rows = usable.where(F.col("doc_id").isin(list(label_of))).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * sum(per_class)).collect()
    return train([(r.text, label_of[r.doc_id]) for r in rows])


class Values:
    """Scores texts; keeps words' values while there is room, and works out those of all new words at once."""

    def __init__(self, model: Model) -> None:
        self.model, self.kept = model, {}

    def scores(self, texts: list[str | None]) -> list[float]:
        split = [kept_words(t or "") for t in texts]
        new = {w for words in split for w in words if w not in self.kept}
        if len(self.kept) + len(new) > CACHE_ENTRIES:
            self.kept, new = {}, {w for words in split for w in words}
        ordered = sorted(new)
        self.kept.update(zip(ordered, self.model.words(ordered), strict=True))
        return [self.model.score(np.fromiter(map(self.kept.__getitem__, words), np.float64, len(words))) for words in split]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.value, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Values(Model(*shared.value))
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.scores(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose ``text`` scores below the threshold; a map without a shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast((model.value, model.bias)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Values(Model(*shared.value))
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([x < threshold for x in values.scores(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """``fit`` for a table with other columns and null texts."""
    return fit(texts(docs), labels)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id``, ``text``)."""
    docs = texts(docs)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
