"""Approximate nearest neighbours with an inverted multi-index."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chosen, in_arrow, stored

#: Vectors and queries that meet in one task at a time.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024


def usable(vectors: DataFrame, ident: str, vector: str, dim: int | None) -> tuple[DataFrame, int]:
    """``id, v`` (doubles) of the rows that take part, and the dimension (of the largest number of rows, if not given)."""
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(finite, F.lit(False)))
    if dim is None:
        common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = common["d"] if common else 2
    return rows.filter(F.size("v") == dim), dim


def codebook(sample: np.ndarray, size: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of a bounded sample by Lloyd's rounds."""
    random = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[random.permutation(len(distinct))[:size]].copy()
    for _ in range(rounds):
        near = nearest_centre(sample, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared(x, centres).argmin(1)


def traverse(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells (row of ``left`` times the columns plus column) in order of the summed distance, until they hold ``wanted`` vectors.

    The multi-sequence walk: both lists of distances sorted, a heap of pairs; a pair is pushed when its
    neighbours before it in both lists have been taken.
    """
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, taken, out, got = [(left[a[0]] + right[b[0]], 0, 0)], set(), [], 0
    while heap and got < wanted:
        _, i, j = heappop(heap)
        taken.add((i, j))
        cell = int(a[i]) * len(right) + int(b[j])
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in taken):
            heappush(heap, (left[a[i + 1]] + right[b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in taken):
            heappush(heap, (left[a[i]] + right[b[j + 1]], i, j + 1))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = 10, dim: int | None = None, centres: int = 64,
            sample: int = 20_000, rounds: int = 8, candidates: int = 8_000, share: float = 0.45, seed: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` nearest vectors found, by Euclidean distance.

    ``queries`` are rows of the same columns; a vector with the query's own id is no candidate. Nearest first,
    ties to the smaller id. Distances are taken in double precision on the vectors as given. Vectors that are
    null, zero, of another length than ``dim``, or hold nulls or non-finite numbers take no part, nor do rows
    without an id. Repeated ids among the vectors are candidates each; a repeated query id counts once (its
    smallest vector).

    The index: both halves of the vectors have a codebook of ``centres`` centroids, fitted on a bounded sample
    of about ``sample`` vectors; every vector lies in the cell of its two nearest centroids. A query walks the
    cells by the summed distance of both halves until they hold ``candidates`` vectors or the ``share`` of all
    vectors, whichever is more, and all of them are ranked by the true distance. ``share`` sets the recall: vectors
    without much structure need a large one.

    Tasks meet by the left centroid. Its vectors are cut into blocks of about ``BLOCK_VECTORS`` and its queries into
    groups of ``BLOCK_QUERIES``, so no task holds a common cell. A task gives at most ``k`` rows per query.
    """
    data, dim = usable(vectors, ident, vector, dim)
    asked, _ = usable(queries, ident, vector, dim)
    spark, half = vectors.sparkSession, max(1, dim // 2)
    n = data.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = data.filter(chosen(F.xxhash64("id", F.lit(seed)), sample / n))
    fitted = np.array([r["v"] for r in picked.toLocalIterator()] or [r["v"] for r in data.limit(1).collect()])
    books = (codebook(fitted[:, :half], centres, rounds, seed), codebook(fitted[:, half:], centres, rounds, seed + 1) if dim > half else np.zeros((1, 0)))
    sent = spark.sparkContext.broadcast(books)
    right_size = len(books[1])

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), dim)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sent.value
        for batch in batches:
            x = matrix(batch.column(1))
            yield pa.record_batch([*batch.columns, pa.array(nearest_centre(x[:, :half], a)), pa.array(nearest_centre(x[:, half:], b))], ["id", "v", "left", "right"])

    lists = stored(in_arrow(data, place, "id long, v array<double>, left long, right long"), "lists")
    sizes = np.zeros((len(books[0]), right_size), np.int64)
    for r in lists.groupBy("left", "right").agg(F.count("*").alias("n")).collect():  # at most the square of ``centres``
        sizes[r["left"], r["right"]] = r["n"]
    splits = np.maximum(1, -(-sizes.sum(1) // BLOCK_VECTORS))
    wanted = max(candidates, int(np.ceil(share * n))) + 1
    counts = spark.sparkContext.broadcast(sizes.ravel())

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), cells = sent.value, counts.value
        for batch in batches:
            x = matrix(batch.column(1))
            left, right = squared(x[:, :half], a), squared(x[:, half:], b)
            rows, lefts, rights = [], [], []
            for i in range(len(x)):
                found = np.sort(np.array(traverse(left[i], right[i], cells, wanted), np.int64))
                at, cuts = np.unique(found // right_size, return_index=True)
                rows.extend([i] * len(at))
                lefts.extend(at.tolist())
                rights.extend(np.split(found % right_size, cuts[1:]) if len(at) else [])
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(lefts, pa.int64()), pa.array(rights, pa.list_(pa.int64()))], ["query", "q", "left", "rights"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a walk is long, so even few queries are dealt out
    one = stored(asked.groupBy("id").agg(F.min("v").alias("v")).repartition(parts, "id"), "queries")
    visits = stored(in_arrow(one, walk, "query long, q array<double>, left long, rights array<long>"), "visits")
    load = {r["left"]: -(-r["n"] // BLOCK_QUERIES) for r in visits.groupBy("left").agg(F.count("*").alias("n")).collect()}  # at most ``centres`` rows
    table = spark.createDataFrame([(c, int(splits[c]), groups) for c, groups in sorted(load.items())], "left long, blocks long, groups long")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    table = F.broadcast(table)  # a row per left centroid
    asking = visits.join(table, "left").withColumn("block", every("blocks")).withColumn("group", F.pmod(F.xxhash64("query"), "groups")).select("left", "block", "group", "query", "q", "rights")
    given = lists.join(table, "left").withColumn("block", F.pmod(F.xxhash64("id", F.lit(11)), "blocks")).withColumn("group", every("groups")).select("left", "block", "group", "id", "v", "right")
    found = asking.groupBy("left", "block", "group").cogroup(given.groupBy("left", "block", "group")).applyInPandas(
        lambda x, y: _rank(x, y, k, right_size), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rank(asking: pd.DataFrame, given: pd.DataFrame, k: int, right_size: int) -> pd.DataFrame:
    """The best ``k`` of a block of vectors for each query, among the cells that the query visits."""
    out: list[tuple] = []
    if len(asking) and len(given):
        y, names, cell = np.stack(given["v"].to_numpy()), given["id"].to_numpy(), given["right"].to_numpy()
        for query, q, rights in zip(asking["query"], asking["q"], asking["rights"], strict=True):
            visited = np.zeros(right_size, bool)
            visited[rights] = True
            at = np.flatnonzero(visited[cell] & (names != query))
            d = np.sqrt(((y[at] - q) ** 2).sum(1))
            if len(d) > k:
                near = d <= np.partition(d, k - 1)[k - 1]
                at, d = at[near], d[near]
            best = np.lexsort((names[at], d))[:k]
            out.append((np.full(len(best), query), names[at[best]], d[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))
