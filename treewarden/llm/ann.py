"""Approximate nearest neighbours by inner product: a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample and held by every task (its size is bounded by the sample). Every row goes to a
leaf. A query walks the tree through a priority queue of nodes by the inner product with their centres and so gets leaves
in order; how many it visits is calibrated: the fewest with which calibration queries, compared with all
rows, reach the wanted recall. Leaves that follow each other in the tree make cells of bounded size; a query meets a cell once,
with the list of the leaves that it visits there. Answers come from visited leaves only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import marks, maybe_marked, written


class Tree:
    """Nodes: (centres, children); a child >= 0 is a node, another one the leaf -1 - child."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = 8, seed: int = 7):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0  # numbered from left to right
        self.least = max(1, len(sample) // max(1, leaves))
        self.root = self._grow(sample, branch, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, branch: int, rng) -> int:
        if len(x) > 2 * self.least:
            k = min(branch, max(2, len(x) // self.least))
            centres = x[rng.choice(len(x), k, replace=False)]
            for _ in range(12):
                nearest = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
                centres = np.stack([x[nearest == i].mean(0) if (nearest == i).any() else centres[i] for i in range(k)])
            nearest = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
            counts = np.bincount(nearest, minlength=k)
            if counts.max() < len(x):
                at = len(self.nodes)
                self.nodes.append((centres, []))
                children = [self._grow(x[nearest == i], branch, rng) if counts[i] else None for i in range(k)]
                keep = [i for i, c in enumerate(children) if c is not None]
                self.nodes[at] = (centres[keep], [children[i] for i in keep])
                return at
        self.leaves += 1
        return -self.leaves

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest centre of every level."""
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            centres, children = self.nodes[node]
            nearest = np.argmin((centres**2).sum(1) - 2 * x[rows] @ centres.T, axis=1)
            todo += [(child, rows[nearest == i]) for i, child in enumerate(children) if (nearest == i).any()]
        return out

    def visit(self, q: np.ndarray, most: int, rows: np.ndarray | None = None, least_rows: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and further ones while those have fewer than ``least_rows`` of the ``rows`` of each leaf."""
        out, heap, have = [], [(0.0, self.root)], 0
        while heap and (len(out) < most or have < least_rows):
            _, node = heapq.heappop(heap)
            if node < 0:
                out.append(-1 - node)
                have += int(rows[-1 - node]) if rows is not None else 0
                continue
            centres, children = self.nodes[node]
            for score, child in zip((centres @ q).tolist(), children, strict=True):
                heapq.heappush(heap, (-score, child))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, all of one length and without nulls, as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, rough: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k largest inner products ``among`` rows, of which ``rough`` is known; ties to smaller ids. Scores are summed row by row in one order, so equal vectors tie exactly."""
    about = rough[among]
    if len(about) > k:
        least = np.partition(about, len(about) - k)[len(about) - k]
        among = among[about >= least - 1e-9 * (1 + abs(least))]
    scores = (x[among] * q).sum(1)
    order = np.lexsort((ids[among], -scores))[:k]
    return among[order], scores[order]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null, not zero, and has finite components only."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding")).where(fine & F.col("vec_id").isNotNull())


def cells(rows: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each leaf its cell and into how many parts that is split: neighbouring leaves share a cell up to ``block`` rows, a larger leaf is split by a hash."""
    cell, parts, now, held = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), 0, 0
    for i, n in enumerate(rows.tolist()):
        if held and held + n > block:
            now, held = now + 1, 0
        cell[i], parts[i] = now, -(-n // block) or 1
        held += n
        if held >= block:
            now, held = now + 1, 0
    return cell, parts


def search(vectors: DataFrame, is_query, k: int = 20, sample: int = 20_000, rows_per_leaf: int = 50, recall: float = 0.95, calibration: int = 200, block: int = 4_000, at_once: int = 20_000) -> DataFrame:
    """The ``k`` nearest rows of each row for which the Column ``is_query`` holds: query_id, rank, vec_id, score.

    Vectors that are null, zero or hold a null or non-finite component take no part. All vectors must have one length; those of another length than the
    commonest take no part either. Equal vectors are one candidate that stands for its k + 1 smallest ids, which is all that k answers can hold; equal query
    vectors are searched once. Rows that repeat a vec_id are candidates of their own, but a query never finds its own id; of query rows with one id each
    different vector is a query, with ranks of its own. Other columns are ignored; no rows: no answers.
    ``sample`` (rows for fitting the tree, which has sample / 8 leaves at most) and ``calibration`` bound what comes to the driver; every row is indexed.
    A cell's rows (``block``) meet ``at_once`` queries at a time.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == lengths[0]["d"])
    # equal vectors: the k + 1 smallest ids, with how many rows each; the rank filter also holds within each task before the shuffle
    ranked = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = rows.groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times")).withColumn("copy", F.row_number().over(ranked)).where(F.col("copy") <= k + 1)
    distinct = written(distinct.select("vec_id", "times", "copy", "embedding"), "distinct")
    firsts = distinct.where("copy = 1")
    n = firsts.count()
    by_hash = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    fitted = firsts.where(by_hash < F.lit(min(1.0, sample / n) * (1 << 30))).select("embedding").toArrow()
    tree = Tree(matrix(fitted["embedding"].combine_chunks()) if fitted.num_rows else np.zeros((0, lengths[0]["d"])), max(1, min(math.ceil(n / rows_per_leaf), sample // 8)))
    held = spark.sparkContext.broadcast(tree)  # at most sample / 8 leaves

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"vec_id": b.column("vec_id"), "times": b.column("times"), "embedding": b.column("embedding"), "leaf": pa.array(held.value.assign(matrix(b.column("embedding"))), pa.int64())})

    placed = written(distinct.select("vec_id", "times", "embedding").mapInArrow(assign, "vec_id long, times int, embedding array<double>, leaf long"), "leaves")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row a leaf
        sizes[r["leaf"]] = r["count"]
    cell, parts = cells(sizes, block)

    # a vector is asked once for all queries that have it; an id with several vectors asks for itself, so that all its rows can be left out
    queries = rows.where(is_query).select("vec_id", "embedding").distinct()
    several = queries.groupBy("vec_id").count().where("count > 1").select("vec_id")
    own = written(queries.join(several, "vec_id", "left_semi"), "own")
    queries = queries.join(several, "vec_id", "left_anti")
    grouped = written(queries.groupBy("embedding").agg(F.min("vec_id").alias("asked"), F.count("*").alias("n")), "asked")
    asked = grouped.select(F.concat(F.lit("v"), "asked").alias("asked"), F.lit(None).cast("long").alias("own"), "embedding").unionAll(own.select(F.concat(F.lit("i"), "vec_id", F.lit("-"), F.xxhash64("embedding")), "vec_id", "embedding"))
    visits = calibrated(placed, grouped, tree, k, recall, calibration)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, where, lists = [], [], []
            for i, q in enumerate(matrix(b.column("embedding"))):
                leaves = np.sort(np.array(held.value.visit(q, visits, sizes, 2 * k + 2), np.int64))
                for c in np.unique(cell[leaves]).tolist():
                    here = leaves[cell[leaves] == c]
                    for part in range(int(parts[here].max())):
                        at.append(i)
                        where.append((c, part))
                        lists.append(here)
            yield pa.record_batch({"asked": b.column("asked").take(pa.array(at, pa.int64())), "own": b.column("own").take(pa.array(at, pa.int64())), "q": b.column("embedding").take(pa.array(at, pa.int64())), "cell": pa.array([c for c, _ in where], pa.int64()), "part": pa.array([p for _, p in where], pa.int64()), "visited": pa.array(lists, pa.list_(pa.int64()))})

    probes = written(asked.mapInArrow(walk, "asked string, own long, q array<double>, cell long, part long, visited array<long>"), "probes")
    # a cell that very many queries visit meets them in groups of about ``at_once``
    groups = probes.groupBy("cell", "part").agg(F.ceil(F.count("*") / at_once).cast("int").alias("groups"))  # a row a cell
    probes = probes.join(groups, ["cell", "part"]).withColumn("group", F.pmod(F.xxhash64("asked"), "groups").cast("int")).drop("groups")
    of_leaf = spark.createDataFrame([(i, int(c), int(p)) for i, (c, p) in enumerate(zip(cell, parts, strict=True))], "leaf long, cell long, parts long")  # a row a leaf
    stored = placed.join(F.broadcast(of_leaf), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).join(groups, ["cell", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups", "parts")

    def scan(_, asked_here: pa.Table, here: pa.Table) -> pa.Table:
        names, ids, times, scores = [], [], [], []
        if asked_here.num_rows and here.num_rows:
            x, x_ids, x_times, x_leaf = matrix(here["embedding"].combine_chunks()), here["vec_id"].to_numpy(), here["times"].to_numpy(), here["leaf"].to_numpy()
            for some in asked_here.to_batches(256):
                q, own = matrix(some.column("q")), some.column("own").to_pylist()
                rough = q @ x.T
                for i, (name, leaves) in enumerate(zip(some.column("asked").to_pylist(), some.column("visited").to_pylist(), strict=True)):
                    fits = np.isin(x_leaf, leaves)
                    if own[i] is not None:
                        fits &= x_ids != own[i]
                    found, score = best(x, x_ids, q[i], k + 1, rough[i], np.flatnonzero(fits))
                    names += [name] * len(found)
                    ids.append(x_ids[found])
                    times.append(x_times[found])
                    scores.append(score)
        return pa.table({"asked": pa.array(names, pa.string()), "vec_id": np.concatenate([np.empty(0, np.int64), *ids]), "times": np.concatenate([np.empty(0, np.int32), *times]), "score": np.concatenate([np.empty(0), *scores])})

    keys = ["cell", "part", "group"]
    found = probes.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(scan, "asked string, vec_id long, times int, score double")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    nearest = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    # back to every query of that vector; those of a vector that several have are dealt over parts
    alone = grouped.where("n = 1").select(F.col("asked").alias("query_id"), F.concat(F.lit("v"), "asked").alias("asked")).unionAll(own.select("vec_id", F.concat(F.lit("i"), "vec_id", F.lit("-"), F.xxhash64("embedding"))))
    shared = written(grouped.where("n > 1"), "shared")
    salted = shared.select("embedding", F.concat(F.lit("v"), "asked").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    members = maybe_marked(queries, marks(shared, "embedding"), "embedding").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)).cast("int")).join(salted, ["embedding", "salt"])
    of = alone.unionAll(members.select(F.col("vec_id").alias("query_id"), "asked"))
    answers = nearest.join(of, "asked").where("vec_id != query_id").withColumn("time", F.explode(F.sequence(F.lit(1), "times")))
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrated(placed: DataFrame, asked: DataFrame, tree: Tree, k: int, recall: float, most: int) -> int:
    """How many leaves to visit: some ``most`` query vectors are compared with all rows, and their true neighbours' leaves looked up in visiting order."""
    n = asked.count()
    some = asked.where(F.pmod(F.xxhash64("asked", F.lit(1)), F.lit(1 << 30)) < F.lit(min(1.0, most / max(1, n)) * (1 << 30))).toArrow()
    if not some.num_rows:
        return tree.leaves
    wanted, own = matrix(some["embedding"].combine_chunks()), some["asked"].to_numpy()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, ids, leaf = matrix(b.column("embedding")), b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
                rough = wanted @ x.T
                for i, q in enumerate(wanted):
                    rows, scores = best(x, ids, q, k, rough[i], np.flatnonzero(ids != own[i]))
                    yield pa.record_batch({"query": np.full(len(rows), i), "vec_id": ids[rows], "leaf": leaf[rows], "score": scores})

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    true = placed.mapInArrow(exact, "query long, vec_id long, leaf long, score double").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "leaf").toArrow()
    visiting = [{leaf: at for at, leaf in enumerate(tree.visit(q, tree.leaves))} for q in wanted]
    needed = np.sort([1 + visiting[q][leaf] for q, leaf in zip(true["query"].to_pylist(), true["leaf"].to_pylist(), strict=True)])
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) if len(needed) else tree.leaves
