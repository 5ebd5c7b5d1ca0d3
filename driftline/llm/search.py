"""Nearest neighbours by inner product, with an adaptive scan over dimensions inside probed lists.

Vectors get one more component that makes their norms equal, so the largest inner product
is the smallest distance. Centroids fitted on a bounded sample split all rows into lists;
a long list is dealt out over blocks of bounded size, and so are the queries that probe it.
The number of lists probed is the least that reaches a wanted recall on the sample.
Inside a block, vectors lie rotated at random and in blocks of columns. After each block
of columns a candidate is dropped when its distance so far, scaled to all dimensions,
exceeds the distance of the query's k-th best by a margin that such a sample of dimensions
passes with little chance otherwise. The survivors' scores are computed on the vectors
as they came, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import prepare, Scratch, trimmed

#: Rows that the centroids are fitted on (by hash of the id), most lists, and rounds of fitting.
SAMPLE, LISTS, ROUNDS = 20_000, 4096, 8
#: Share of nearest neighbours that the probed lists are to hold, and rows of the sample it is measured on.
RECALL, ASKED = 0.96, 400
#: Rows of the sample that every query is held against first: their k-th best score is where the scan starts.
START = 2_000
#: Nearest lists that are scanned first; the k-th best of them is where the scan of the others starts.
FIRST = 2
#: Rows and queries of one block; columns of one step; the test's margin.
BLOCK_ROWS, BLOCK_QUERIES, COLUMNS, EPSILON = 4096, 1024, 16, 2.1


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` of vectors that take part: not null or zero, without null or non-finite components."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def centroids(x: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd rounds; an empty cluster takes a random row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096))])


def rotation(width: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def widened(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component, so that every row has the norm ``norm``."""
    return np.concatenate([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def scan(queries: np.ndarray, own: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, norm: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best of the block: ids and exact scores. ``least``: a score that k candidates are known to reach."""
    width = rows.shape[1] + 1
    turn = rotation(width)
    cuts = list(range(COLUMNS, width, COLUMNS))
    columns = [np.ascontiguousarray(b) for b in np.split(widened(rows, norm) @ turn, cuts, axis=1)]
    turned = np.split(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1) @ turn, cuts, axis=1)
    limit = np.maximum((queries**2).sum(axis=1) + norm**2 - 2 * least, 0.0)
    head, ask = columns[0], turned[0]
    first = (head**2).sum(axis=1)[None, :] + (ask**2).sum(axis=1)[:, None] - 2 * ask @ head.T
    alive_all = first <= (limit * _ratio(ask.shape[1], width))[:, None]
    for q in range(len(queries)):
        alive = np.flatnonzero(alive_all[q])
        so_far, done = first[q, alive], ask.shape[1]
        for block, part in zip(columns[1:], turned[1:], strict=True):
            if not len(alive):
                break
            so_far = so_far + ((block[alive] - part[q]) ** 2).sum(axis=1)
            done += part.shape[1]
            keep = so_far <= limit[q] * _ratio(done, width)
            alive, so_far = alive[keep], so_far[keep]
        alive = alive[ids[alive] != own[q]]
        scores = np.einsum("ij,j->i", rows[alive], queries[q])
        best = np.lexsort((ids[alive], -scores))[:k]
        yield q, ids[alive[best]], scores[best]


def _ratio(done: int, width: int) -> float:
    """How much of the limit a distance over ``done`` rotated dimensions may have reached."""
    return (1.0 if done == width else (done / width) * (1 + EPSILON / done**0.5) ** 2) * (1 + 1e-9)


def lists_needed(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """Fewest lists that hold the wanted share of the k nearest, over some rows of the sample against all of it."""
    asked = np.arange(0, len(x), max(1, len(x) // ASKED))[:ASKED]
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    half = (c**2).sum(axis=1) / 2
    flat = np.concatenate([x[asked, :-1], np.zeros((len(asked), 1))], axis=1)
    order = np.argsort(half - flat @ c.T, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(c)), order.shape), axis=1)
    found = np.take_along_axis(place, nearest(x, c)[top], axis=1)
    return int(np.quantile(found, RECALL, method="higher")) + 1


def search(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest found of each query, ties to the smaller id.

    Both tables have the same columns; a row never finds rows of its own id. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do those of
    another dimension than most have (the smaller, if equally many). With fewer than k
    candidates all are returned. Rows that repeat an id are one candidate, by its best
    score, and one query. An empty table gives an empty result.
    """
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "search")
    rows = valid(df, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).orderBy(F.desc("n"), "width").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total, norm = sizes["width"], sizes["n"], sizes["norm"] * (1 + 1e-12)
    rows = rows.filter(F.size("v") == width)
    asked = valid(queries, id_col, vector_col).filter(F.size("v") == width)
    lists = int(min(LISTS, max(1, round(total**0.5 / 4))))
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample, sample_ids = _matrix(sampled.column("v")).copy(), sampled.column("vec_id").to_numpy()
    centre = centroids(widened(sample, norm), lists)
    least = lists_needed(widened(sample, norm), centre, k)
    shared = spark.sparkContext.broadcast(centre)
    known = spark.sparkContext.broadcast((sample[:START], sample_ids[:START]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = nearest(widened(_matrix(batch.column("v")), norm), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("vec_id"), batch.column("v")], ["list", "vec_id", "v"])

    placed = scratch.write(rows.mapInArrow(trimmed(place), "list int, vec_id long, v array<double>"), "lists")
    held = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect():
        held[r["list"]] = r["n"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (shared.value**2).sum(axis=1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column("v")), np.asarray(batch.column("vec_id"))
            order = np.argsort(half - np.concatenate([x, np.zeros((len(x), 1))], axis=1) @ shared.value.T, axis=1, kind="stable")
            enough = (np.cumsum(held[order], axis=1) - held[order] < k + 1) | (np.arange(lists) < least)
            starts = [start(x[i : i + 256], ids[i : i + 256]) for i in range(0, len(x), 256)]
            least_, near, scores = ([y for part in starts for y in part[j]] for j in range(3))
            chosen = pa.array([o[e].astype(np.int32) for o, e in zip(order, enough, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(least_, pa.float64()), chosen, pa.array(near, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["vec_id", "v", "least", "lists", "near", "scores"]
            )

    def start(x: np.ndarray, ids: np.ndarray) -> tuple[list[float], list[np.ndarray], list[np.ndarray]]:
        """The k best of the first rows of the sample, and the least of their scores if there are k."""
        vectors, own = known.value
        scores = x @ vectors.T
        least_, near, best = [], [], []
        for i in range(len(x)):
            order = np.lexsort((own, -scores[i]))
            order = order[own[order] != ids[i]][:k]
            exact = np.einsum("ij,j->i", vectors[order], x[i])
            least_.append(float(exact.min()) - 1e-9 if len(order) == k and len(np.unique(own[order])) == k else -np.inf)
            near.append(own[order])
            best.append(exact)
        return least_, near, best

    probes = scratch.write(asked.mapInArrow(trimmed(probe), "vec_id long, v array<double>, least double, lists array<int>, near array<long>, scores array<double>"), "probes")
    key = ["list", "rb", "qb"]

    def scanned(asked_lists: DataFrame) -> DataFrame:
        """The k best of each probed list's blocks, for rows of ``vec_id``, ``v``, ``least``, ``list``."""
        asks = {r["list"]: r["n"] for r in asked_lists.groupBy("list").agg(F.count("*").alias("n")).collect()}
        shape = [(i, int(-(-int(held[i]) // BLOCK_ROWS)), int(-(-asks.get(i, 0) // BLOCK_QUERIES))) for i in range(lists) if held[i] and asks.get(i)]
        shape = F.broadcast(spark.createDataFrame(shape or [(-1, 1, 1)], "list int, row_blocks int, query_blocks int"))  # a row for each list, at most LISTS
        spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = placed.join(shape, "list").withColumn("rb", spread("row_blocks")).withColumn("qb", every("query_blocks")).select(*key, "vec_id", "v")
        right = asked_lists.join(shape, "list").withColumn("qb", spread("query_blocks")).withColumn("rb", every("row_blocks")).select(*key, "vec_id", "v", "least")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(block, "query_id long, vec_id long, score double")

    def block(data: pa.Table, ask: pa.Table) -> pa.Table:
        query, rank_id, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if data.num_rows and ask.num_rows:
            own = ask.column("vec_id").to_numpy()
            for q, ids, scores in scan(_matrix(ask.column("v")), own, ask.column("least").to_numpy(), _matrix(data.column("v")), data.column("vec_id").to_numpy(), norm, k):
                query.append(np.full(len(ids), own[q]))
                rank_id.append(ids)
                score.append(scores)
        return pa.table({"query_id": np.concatenate(query), "vec_id": np.concatenate(rank_id), "score": np.concatenate(score)})

    begun = probes.select(F.col("vec_id").alias("query_id"), F.inline(F.arrays_zip(F.col("near").alias("vec_id"), F.col("scores").alias("score"))))
    first = scanned(probes.select("vec_id", "v", "least", F.explode(F.slice("lists", 1, FIRST)).alias("list"))).unionByName(begun)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = scratch.write(first.select("query_id", "vec_id", "score"), "first")
    reached = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score") - 1e-9).alias("reached"))
    rest = probes.join(reached, probes["vec_id"] == reached["query_id"], "left").select("vec_id", "v", F.greatest("least", F.coalesce("reached", F.lit(float("-inf")))).alias("least"), "lists")
    found = scanned(rest.select("vec_id", "v", "least", F.explode(F.slice("lists", FIRST + 1, lists)).alias("list")))
    found = found.unionByName(first).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
