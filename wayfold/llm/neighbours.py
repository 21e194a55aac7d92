"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts (recursive median
splits along principal directions, then moves that bring neighbours together while no
part outgrows its share). A small classifier learns a vector's part from its neighbours'
parts. Every vector is filed under its most probable part; a query goes to its most
probable ones, and what is filed there is ranked by exact cosine in double precision.

How many parts a query visits is set on the sample, by the recall wanted.

The number of parts grows with the table, from ``PARTS`` to ``MOST_PARTS``, one for each ``BLOCK`` distinct vectors.

Equal vectors are one class with its smallest ids (as many as can be asked for), found by
a limited window that Spark cuts before the shuffle, so a vector that a third of all rows
share costs no more than another. Parts are dealt out in blocks of ``BLOCK`` classes, and a part's queries in
blocks of as many; a task holds one of either, about. A query that finds fewer than ``k`` in its parts is run
again over all of them, so no query misses neighbours that exist.

What a block may hold of a query's best by unit vectors, all within ``NEAR`` of the last of them, is scored anew on the
original vectors, with extended precision; scores that agree to 14 places are ties.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do rows without id; vectors of different lengths are never compared (each length has an index of its own); equal
(id, vector) rows count once; an id with several vectors is a query by each, with ranks of its own, and its rows are no
candidates of each other; ties go to the smaller id; no candidates: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 6_000
"""Distinct vectors that the index is fitted on, at most; ``SAMPLE_PER_PART`` for each part if that is more."""
SAMPLE_PER_PART = 64
PARTS, MOST_PARTS = 32, 256
"""Parts, at least (if there are vectors for them) and at most; powers of two."""
GRAPH_K, SLACK = 10, 1.1
RECALL = 0.96
"""Wanted on the sample; the rest of the index costs some."""
BLOCK = 4_096
NEAR = 1e-12
"""More than the error of a score by unit vectors."""
HIDDEN, EPOCHS = 128, 30


class Index:
    """parts, probes and the classifier: centre, w1, b1, w2, b2."""

    def __init__(self, parts: int, probes: int, net: tuple[np.ndarray, ...]) -> None:
        self.parts, self.probes, self.net = parts, probes, net

    def logits(self, unit: np.ndarray) -> np.ndarray:
        centre, w1, b1, w2, b2 = self.net
        return np.maximum((unit - centre) @ w1 + b1, 0) @ w2 + b2

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Parts by probability, the most probable first; equal vectors get equal orders."""
        return np.argsort(-self.logits(unit).round(5), axis=1, kind="stable")


def nearest_in(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest others of each unit vector, in blocks."""
    out = []
    for at in range(0, len(x), 512):
        sim = x[at : at + 512] @ x.T
        sim[np.arange(len(sim)), at + np.arange(len(sim))] = -9
        top = np.argpartition(-sim, k, axis=1)[:, :k]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def balanced(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part for each vector: few edges of the graph cut, no part over its share by more than ``SLACK``."""
    n = len(x)
    part = np.zeros(n, np.int64)
    for level in range(parts.bit_length() - 1):
        for p in range(1 << level):
            mine = np.flatnonzero(part == p)
            own = x[mine] - x[mine].mean(0)
            axis = np.linalg.eigh(own.T @ own)[1][:, -1]
            part[mine[np.argsort(own @ axis, kind="stable")[len(mine) // 2 :]]] = p + (1 << level)
    cap, size = int(np.ceil(SLACK * n / parts)), np.bincount(part, minlength=parts)
    edges = np.concatenate((np.stack((np.repeat(np.arange(n), graph.shape[1]), graph.ravel())), np.stack((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))), 1)
    rng = np.random.default_rng(seed)
    for _ in range(8):
        near = np.zeros((n, parts), np.int64)
        np.add.at(near, (edges[0], part[edges[1]]), 1)
        gain = near.max(1) - near[np.arange(n), part]
        moved = 0
        for i in sorted(np.flatnonzero(gain > 0), key=lambda i: (-gain[i], rng.random())):
            free = np.where((size < cap) | (np.arange(parts) == part[i]), near[i], -1)
            to = int(np.argmax(free))
            if to != part[i] and free[to] > near[i, part[i]] and size[part[i]] > n / parts / 2:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


def learned(x: np.ndarray, target: np.ndarray, seed: int = 7) -> tuple[np.ndarray, ...]:
    """A one-hidden-layer softmax classifier of soft targets, trained with Adam."""
    rng = np.random.default_rng(seed)
    centre, parts = x.mean(0), target.shape[1]
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    mean, var, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            step += 1
            a = x[rows] - centre
            h = np.maximum(a @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ p[2].T) * (h > 0)
            for k, d in enumerate((a.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                mean[k] = 0.9 * mean[k] + 0.1 * d
                var[k] = 0.999 * var[k] + 0.001 * d * d
                p[k] = p[k] - 0.01 * (1 - epoch / EPOCHS) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return (centre, *p)


def fit(x: np.ndarray, k: int, parts: int = PARTS, recall: float = RECALL) -> Index:
    """Fits the index on distinct unit vectors."""
    while parts > 1 and len(x) < 32 * parts:
        parts //= 2
    width = x.shape[1]
    if parts == 1:
        return Index(1, 1, (np.zeros(width), np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)))
    graph = nearest_in(x, max(GRAPH_K, k))
    part = balanced(x, graph[:, :GRAPH_K], parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), GRAPH_K), part[graph[:, :GRAPH_K].ravel()]), 0.5 / GRAPH_K)
    target[np.arange(len(x)), part] += 0.5
    index = Index(parts, parts, learned(x, target))
    order = index.order(x)
    filed, rank = order[:, 0], np.argsort(order, axis=1)
    needed = np.take_along_axis(rank, filed[graph[:, :k]], 1)  # the visit in which each true neighbour is found
    found = np.array([(needed < n).mean() for n in range(1, parts + 1)])
    index.probes = int(np.argmax(found >= recall)) + 1
    return index


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, size, raw``: the vectors that take part, as little-endian doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(good).select("vec_id", F.size("v").alias("size"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat, at = column.values.to_numpy() + 0.0, column.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat[a:b].astype("<f8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["vec_id", "size", "raw"])

    return rows.mapInArrow(run, "vec_id long, size int, raw binary").distinct()


def matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def routed(rows: DataFrame, index: Index, visits: int, columns: str, names: list[str]) -> DataFrame:
    """``rows`` (raw first) with the column ``parts``: the ``visits`` most probable ones."""
    shared = rows.sparkSession.sparkContext.broadcast((index.parts, index.probes, index.net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            if batch.num_rows:
                order = index.order(units(matrix(batch.column(0).to_pylist())))[:, :visits]
                parts = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]).astype(np.int32)), pa.array(order.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*names, "parts"])

    return rows.select(*names).mapInArrow(run, f"{columns}, parts array<int>")


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of one vector with many, on the vectors as they are."""
    a, b = (v.astype(np.longdouble) / np.abs(v).max(-1, keepdims=True) for v in (a, b))  # scaled, so that squares neither overflow nor vanish
    return np.clip(((b @ a) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1)))).astype(np.float64), -1, 1)


def ranked(queries: DataFrame, filed: DataFrame, blocks: dict[int, int], k: int) -> DataFrame:
    """``query_id, own, vec_id, score`` of the k best of each query and block. queries: ``query_id, own, raw, parts``; filed: ``raw, ids, part, block``."""
    if not blocks:
        return queries.sparkSession.createDataFrame([], "query_id long, own long, vec_id long, score double")
    lookup = lambda of: F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("part"))
    asked = queries.select("query_id", "own", "raw", F.explode("parts").alias("part")).withColumn("n", lookup(blocks)).where("n is not null")
    heaps = {r.part: -(-r.n // BLOCK) for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    if not heaps:
        return queries.sparkSession.createDataFrame([], "query_id long, own long, vec_id long, score double")
    asked = asked.withColumn("heap", F.pmod(F.xxhash64("query_id", "own"), lookup(heaps).cast("long")).cast("int"))
    asked = asked.select("query_id", "own", "raw", "part", "heap", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    filed = filed.withColumn("heaps", lookup(heaps)).where("heaps is not null").select("raw", "ids", "part", "block", F.explode(F.sequence(F.lit(0), F.col("heaps") - 1)).alias("heap"))

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int, float]] = []
        if len(q) and len(c):
            mine, all_, ids = matrix(list(q["raw"])), matrix(list(c["raw"])), list(c["ids"])
            names, owns = q["query_id"].tolist(), q["own"].tolist()
            uq, uc = units(mine), units(all_)
            keep = min(len(all_), k + 1)  # one may be the query's own
            for at in range(0, len(mine), 512):
                sim = uq[at : at + 512] @ uc.T
                last = np.partition(sim, len(all_) - keep, axis=1)[:, len(all_) - keep]
                for i, near in enumerate(sim >= last[:, None] - NEAR):
                    places = np.flatnonzero(near)
                    found = [(-round(x, 14), v, x) for j, x in zip(places.tolist(), exact(mine[at + i], all_[places]).tolist(), strict=True) for v in ids[j] if v != names[at + i]]
                    rows += [(names[at + i], owns[at + i], v, x) for _, v, x in sorted(found)[:k]]
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=t) for i, (n, t) in enumerate((("query_id", "int64"), ("own", "int64"), ("vec_id", "int64"), ("score", "float64")))})

    key = ("part", "block", "heap")
    return asked.groupBy(*key).cogroup(filed.groupBy(*key)).applyInPandas(score, "query_id long, own long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "own").orderBy(F.desc(F.round("score", 14)), "vec_id", F.desc("score"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "own", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, parts: int = PARTS, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each row whose id ``every`` divides, among all other rows."""
    rows = materialize(packed(vectors, id_col, vector_col), "vectors")
    out = None
    for size in sorted(r.size_ for r in rows.select(F.col("size").alias("size_")).distinct().collect()):
        found = _search(rows.where(F.col("size") == size).select("vec_id", "raw"), every, k, sample, parts, recall)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, every: int, k: int, sample: int, parts: int, recall: float) -> DataFrame:
    few = Window.partitionBy("raw").orderBy("vec_id")
    classes = rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).groupBy("raw").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    classes = materialize(classes, "classes")
    wanted = classes.count() // BLOCK
    while parts < min(wanted, MOST_PARTS):
        parts *= 2
    some = [r.raw for r in classes.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(max(sample, SAMPLE_PER_PART * parts if parts > PARTS else 0)).collect()]
    index = fit(units(matrix(some)), k, parts, recall)
    routes = materialize(routed(classes, index, 1, "raw binary, ids array<long>", ["raw", "ids"]), "filed").withColumn("part", F.element_at("parts", 1))
    blocks = {r.part: -(-r.n // BLOCK) for r in routes.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    per_part = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    filed = routes.withColumn("block", F.pmod(F.xxhash64("raw"), F.try_element_at(per_part, F.col("part")).cast("long")).cast("int")).select("raw", "ids", "part", "block")
    queries = rows.where(F.col("vec_id") % every == 0).select("raw", F.col("vec_id").alias("query_id"), F.xxhash64("raw").alias("own"))
    form, names = "raw binary, query_id long, own long", ["raw", "query_id", "own"]
    asked = materialize(routed(queries, index, index.probes, form, names), "asked")
    found = materialize(best(ranked(asked, filed, blocks, k), k), "found")
    full = found.groupBy("query_id", "own").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "own")
    short = materialize(queries.join(full, ["query_id", "own"], "left_anti").select(*names), "short")
    if not short.isEmpty():
        again = best(ranked(materialize(routed(short, index, index.parts, form, names), "asked"), filed, blocks, k), k)
        found = found.join(short.select("query_id", "own"), ["query_id", "own"], "left_anti").unionByName(again.select(*found.columns))
    return found.select("query_id", "rank", "vec_id", "score")
