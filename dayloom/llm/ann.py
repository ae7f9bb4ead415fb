"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin
first.

The tree is fitted on the driver from a bounded sample (``SAMPLE`` vectors in expectation);
every row is put into its leaf. A query walks the tree with a priority queue: the nearest
node that was not opened yet is opened next, whichever level it is on; leaves come out in the
order in which they would be visited. How many leaves to visit is calibrated: for a bounded
set of queries the true neighbours are found by brute force over all rows, and the visits
are widened until ``TARGET`` of them lie in visited leaves (with a margin). A query whose leaves
hold fewer than k other rows goes on in the same order until they do.

Distribution: a leaf is cut into blocks of bounded size, as are the queries that visit it, so
a leaf that holds a third of all rows is worked on by many tasks; each block pair returns its
best k. Broadcast and driver hold the tree and the calibration queries, both bounded.

Scores are the cosine of the original vectors in double precision, computed row by row in
one fixed order, so that equal vectors get equal scores; ties go to the smaller id.

Edge cases: vectors that are null, zero, or hold null or non-finite components, or whose id is
null, take no part; nor do those of another length than the most common one (ties: the
smaller). Repeated rows of an id count once; where their vectors differ, the first in the order of
arrays counts. Fewer than k candidates give fewer rows. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from dayloom.llm.common import Scratch

SAMPLE = 20_000
LEAF_ROWS = 150  # wished for rows of a leaf, while the tree is below MOST_LEAVES
MOST_LEAVES = 1024
CALIBRATION = 200
TARGET = 0.96
VECTOR_BLOCK, QUERY_BLOCK = 8192, 2048
STEP = 128  # queries multiplied at once
PAIRS = 32_768  # pairs scored at once


@dataclass
class Tree:
    """Two levels of unit centroids: inner nodes, and leaves grouped by inner node."""

    inner: np.ndarray
    leaves: np.ndarray
    parent: np.ndarray

    def assign(self, units: np.ndarray) -> np.ndarray:
        """Each vector goes down the tree: nearest inner node, then its nearest leaf."""
        first = (units @ self.inner.T).argmax(1)
        near = units @ self.leaves.T
        near[self.parent[None, :] != first[:, None]] = -np.inf
        return near.argmax(1).astype(np.int32)

    def visits(self, unit: np.ndarray, most: int, rows_of: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: ``most``, and more until they hold ``least`` rows."""
        heap = [(-s, 0, i) for i, s in enumerate((self.inner @ unit).tolist())]
        heapq.heapify(heap)
        near, out = (self.leaves @ unit).tolist(), []
        children: dict[int, list[int]] = {}
        for k, p in enumerate(self.parent.tolist()):
            children.setdefault(p, []).append(k)
        held = 0
        while heap and (len(out) < most or held < least):
            _, is_leaf, i = heapq.heappop(heap)
            if is_leaf:
                out.append(i)
                held += rows_of.get(i, 0) if rows_of else 0
            else:
                for k in children.get(i, ()):
                    heapq.heappush(heap, (-near[k], 1, k))
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    """Spherical k-means; an empty cluster is dropped."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1)
        c = sums[norms > 1e-12] / norms[norms > 1e-12, None]
    return c


def fit_tree(units: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    inner = kmeans(units, max(1, round(leaves**0.5)), rng)
    near, parts, parent = (units @ inner.T).argmax(1), [], []
    for i in range(len(inner)):
        own = units[near == i]
        part = kmeans(own, max(1, round(leaves * len(own) / len(units))), rng) if len(own) else inner[i : i + 1]
        parts.append(part)
        parent += [i] * len(part)
    return Tree(inner, np.concatenate(parts), np.array(parent, np.int32))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of the rows of q (or its only row) with the rows of v, row by row in one order."""
    q, v = q / np.abs(q).max(axis=1)[:, None], v / np.abs(v).max(axis=1)[:, None]
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def best(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, allowed: np.ndarray | None = None, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of queries, positions of their best k rows, and scores, for a few queries at a
    time. ``allowed``: queries x groups, whether a query looks at the rows of a group."""
    _, once = np.unique(v_ids, return_index=True)  # also sorts by id
    v, v_ids = v[once], v_ids[once]
    group = None if group is None else group[once]
    units, q_units = _units(v), _units(q)
    for at in range(0, len(q), STEP):
        rough = q_units[at : at + STEP] @ units.T
        own = np.minimum(np.searchsorted(v_ids, q_ids[at : at + STEP]), len(v_ids) - 1)
        same = np.flatnonzero(v_ids[own] == q_ids[at : at + STEP])
        rough[same, own[same]] = -np.inf
        if allowed is not None:
            rough[~allowed[at : at + STEP][:, group]] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k] - 1e-9 if len(v) > k else np.full(len(rough), -2.0)
        i, j = np.nonzero(rough >= np.maximum(least, -2.0)[:, None])
        exact = np.concatenate([cosine(q[at + i[x : x + PAIRS]], v[j[x : x + PAIRS]]) for x in range(0, len(i), PAIRS)] or [np.empty(0)])
        order = np.lexsort((v_ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield at + i[kept], once[j[kept]], exact[kept]


def usable(df: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(vec_id).isNotNull() & v.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = width.w if width else 0
    return rows.where(F.size("v") == width), width


def nearest(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", target: float = TARGET, report: dict | None = None) -> DataFrame:
    """For each row that ``is_query`` (over vec_id) holds for, its k nearest other rows:
    query_id, rank, vec_id, score."""
    spark = df.sparkSession
    rows, width = usable(df, vec_id, embedding)
    shape = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], shape)
    n, ids = rows.count(), rows.select("vec_id").distinct().count()
    if ids < n:
        rows, n = Scratch(spark).put(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors"), ids
    share = int((1 << 30) * min(1.0, SAMPLE / n))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).select("vec_id", "v").orderBy("vec_id").toArrow()
    if not sample.num_rows:
        sample = rows.limit(SAMPLE).toArrow()
    tree = fit_tree(_units(_matrix(sample["v"], width)), max(1, min(MOST_LEAVES, n // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast((tree.inner, tree.leaves, tree.parent))  # plain arrays: at most MOST_LEAVES centroids

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(*shared.value)
        for b in batches:
            units = _units(_matrix(b.column(1), width))
            leaf = np.concatenate([own.assign(units[i : i + 1024]) for i in range(0, len(units), 1024)]) if len(units) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    index = Scratch(spark).put(rows.mapInArrow(place, "vec_id long, v array<double>, leaf int"), "leaves")
    queries = index.where(is_query).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    # Calibration: the true neighbours of a bounded number of queries, by brute force over all rows.
    n_queries = max(1, queries.count())
    few = queries.where(F.pmod(F.xxhash64(F.col("query_id") + 17), F.lit(1 << 30)) < int((1 << 30) * min(1.0, CALIBRATION / n_queries))).orderBy("query_id").toArrow()
    q, q_ids = _matrix(few["q"], width), np.asarray(few["query_id"], np.int64)

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.int32)]  # the best k of each query so far
        for b in batches:
            ids, v, leaf = np.asarray(b.column(0), np.int64), _matrix(b.column(1), width), np.asarray(b.column(2))
            found = [(i, ids[j], score, leaf[j]) for i, j, score in best(q, q_ids, v, ids, k)] if len(ids) and len(q) else []
            kept = [np.concatenate([a, *(f[c] for f in found)]) for c, a in enumerate(kept)]
            order = np.lexsort((kept[1], -kept[2], kept[0]))
            order = order[np.arange(len(order)) - np.searchsorted(kept[0][order], kept[0][order]) < k]
            kept = [a[order] for a in kept]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in kept], names=["i", "vec_id", "score", "leaf"])

    by_query = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    truth = index.mapInArrow(brute, "i long, vec_id long, score double, leaf int").withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k).select("i", "leaf").collect()
    orders = [{leaf: r for r, leaf in enumerate(tree.visits(u, len(tree.leaves)))} for u in (_units(q) if len(q) else q)]
    ranks = np.sort([orders[t.i][t.leaf] for t in truth]) if truth else np.array([0])
    visits = min(len(tree.leaves), int(np.ceil(1.05 * (ranks[max(0, int(np.ceil(target * len(ranks))) - 1)] + 1))))
    if report is not None:
        report |= {"leaves": len(tree.leaves), "visits": visits, "calibrated": float((ranks < visits).mean())}

    # Leaves are packed into bins of bounded size, in the tree's order; a larger leaf is a bin of its
    # own, cut into blocks, as are the queries of a bin. At most MOST_LEAVES counts reach the driver.
    counted = index.groupBy("leaf", "vec_id").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("ids")).collect()
    rows_of, ids_of = {r.leaf: r.n for r in counted}, {r.leaf: r.ids for r in counted}
    bin_of, sizes = np.zeros(len(tree.leaves), np.int32), [0]
    for i in range(len(tree.leaves)):
        if sizes[-1] and sizes[-1] + rows_of.get(i, 0) > VECTOR_BLOCK:
            sizes.append(0)
        bin_of[i] = len(sizes) - 1
        sizes[-1] += rows_of.get(i, 0)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                take, bins, leaves = [], [], []
                for i, u in enumerate(_units(_matrix(part.column(1), width))):
                    found = np.array(own.visits(u, visits, ids_of, k + 1))
                    for j in np.unique(bin_of[found]):
                        take.append(i)
                        bins.append(int(j))
                        leaves.append(found[bin_of[found] == j].tolist())
                take = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(bins, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "q", "bin", "leaves"])

    visiting = queries.mapInArrow(walk, "query_id long, q array<double>, bin int, leaves array<int>")
    queries_of = {r.bin: r.n for r in visiting.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    blocks = [max(1, -(-n // VECTOR_BLOCK)) for n in sizes]
    q_blocks = [max(1, -(-queries_of.get(i, 0) // QUERY_BLOCK)) for i in range(len(sizes))]
    table = lambda values, at: F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), F.col(at))
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    mine = lambda column, count: F.pmod(F.xxhash64(column, F.lit(3)), count).cast("int")
    left = visiting.withColumn("b", every(table(blocks, "bin"))).withColumn("c", mine("query_id", table(q_blocks, "bin"))).select("bin", "b", "c", "query_id", "q", "leaves")
    right = index.withColumn("bin", table(bin_of.tolist(), "leaf")).withColumn("b", mine("vec_id", table(blocks, "bin"))).withColumn("c", every(table(q_blocks, "bin"))).select("bin", "b", "c", "vec_id", "v", "leaf")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            qi, vi = np.asarray(a["query_id"], np.int64), np.asarray(b["vec_id"], np.int64)
            leaves, group = np.unique(np.asarray(b["leaf"]), return_inverse=True)
            allowed = np.stack([np.isin(leaves, x) for x in a["leaves"].to_pylist()])
            out = [(qi[i], vi[f], s) for i, f, s in best(_matrix(a["q"], width), qi, _matrix(b["v"], width), vi, k, allowed, group)]
        columns = [np.concatenate([o[j] for o in out]) if out else np.empty(0, t) for j, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    found = left.groupBy("bin", "b", "c").cogroup(right.groupBy("bin", "b", "c")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(embeddings, F.col("vec_id") % 50 == 0)
