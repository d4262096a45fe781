"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1 and their two halves quantised separately, with K centroids each
trained on a bounded sample (the `sample` smallest hashes of vec_id). A vector lies in the cell of
its two centroids. A query takes cells by the sum of its halves' squared distances, smallest first,
with a heap over the two sorted lists, until they hold `share` of all vectors; then every entry of
those cells is ranked by exact cosine in double precision. K is twice the fourth root of the
number of vectors and `most` at most, so a cell holds about a quarter of the square root of them
until then. Without a given share, the sample tells it: of PROBES of its vectors and their nearest
within it, by brute force, the share of all vectors at which traversal has reached `recall` of these
neighbours. Vectors that lie close together so need few cells, vectors without structure many.

Cells are cut by a hash of vec_id into blocks of about `block` vectors, so a hot cell is as many
tasks' work as it needs. Spark joins queries and blocks by cell; a task keeps a query's best few.

Vectors that are null or zero, or hold null or non-finite components, or aren't of the most
frequent dimension (the smaller one on ties), take no part: a cosine needs one dimension. Rows of
one vec_id count apart as candidates; a query isn't compared with rows of its own vec_id. Equal query
rows are one query, rows of one vec_id with unlike vectors are queries of their own, each with ranks
from 1. Ties go to the smaller vec_id. An empty table has no rows in the result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAREST, RECALL, SAMPLE, PROBES, MOST, BLOCK = 5, 0.97, 20_000, 200, 256, 2_000
FOUND = "query_id long, q long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole & F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (size["d"] if size else 0))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the square
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def k_means(x: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        of = nearest_centre(x, centres)
        for c in range(k):
            if (of == c).any():
                centres[c] = x[of == c].mean(0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(x, centres).argmin(1)


def traverse(one: np.ndarray, two: np.ndarray, filled: np.ndarray, enough: int) -> list[int]:
    """Cells by rising one[i] + two[j] that hold `enough` vectors together; filled[i, j]: vectors there."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, seen, out, have = [(one[a[0]] + two[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        n = int(filled[a[i], b[j]])
        if n:
            out.append(int(a[i]) * len(b) + int(b[j]))
            have += n
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (one[a[p]] + two[b[q]], p, q))
    return out


def needed_share(x: np.ndarray, one: np.ndarray, two: np.ndarray, filled: np.ndarray, nearest: int, recall: float) -> float:
    """The share of all vectors that traversal visits before it has reached `recall` of the neighbours within a sample x."""
    half, n = one.shape[1], max(1, int(filled.sum()))
    cell = nearest_centre(x[:, :half], one) * len(two) + nearest_centre(x[:, half:], two)
    reached = []
    for i in range(min(PROBES, len(x))):
        near = x @ x[i]
        near[i] = -2
        k = min(nearest, len(x) - 1)
        if k:
            found = np.argpartition(-near, k - 1)[:k]
            cost = distances(x[i : i + 1, :half], one)[0][:, None] + distances(x[i : i + 1, half:], two)[0][None]
            order = np.argsort(cost.ravel(), kind="stable")
            share = np.empty(len(order))
            share[order] = np.cumsum(filled.ravel()[order]) / n
            reached.append(share[cell[found]])
    return float(np.quantile(np.concatenate(reached), recall)) if reached else 1.0


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Equal for equal rows, wherever they stand."""
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def best(query_id: int, query: np.ndarray, near: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """ids and exact cosines of the k best rows, from rough ones."""
    near = np.where(ids == query_id, -2.0, near)
    if len(ids) > k:
        take = np.flatnonzero(near >= np.partition(near, -k)[-k] - 1e-9)
    else:
        take = np.arange(len(ids))
    take = take[ids[take] != query_id]
    score = cosine(query, rows[take])
    order = np.lexsort((ids[take], -score))[:k]
    return ids[take][order], score[order]


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, share: float | None = None, sample: int = SAMPLE, block: int = BLOCK,
           recall: float = RECALL, most: int = MOST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row for which is_query, of vec_id, holds."""
    rows = usable(vectors)
    n = rows.count()
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow() if n else None  # at most `sample`
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = unit(matrix(some["embedding"]))
    half = x.shape[1] // 2
    k = int(max(1, min(len(x), round(2 * n**0.25), most)))
    one, two = k_means(x[:, :half], k) if half else np.zeros((1, 0)), k_means(x[:, half:], k)
    wide = len(two)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = unit(matrix(batch["embedding"]))
                cell = nearest_centre(y[:, :half], one) * wide + nearest_centre(y[:, half:], two)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(cell.astype(np.int32))], ["vec_id", "embedding", "cell"])

    placed = rows.mapInArrow(place, "vec_id long, embedding array<double>, cell int")
    filled = np.zeros(len(one) * wide, np.int64)
    for r in placed.groupBy("cell").count().collect():  # k*k cells at most
        filled[r["cell"]] = r["count"]
    parts = np.maximum(1, -(-filled // block))
    grid = filled.reshape(len(one), wide)
    if share is None:
        share = needed_share(x, one, two, grid, nearest, recall)
    enough = max(min(n, 50 * nearest), int(np.ceil(share * n)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = unit(matrix(batch["embedding"]))
            d1, d2 = distances(y[:, :half], one), distances(y[:, half:], two)
            for i in range(batch.num_rows):
                cells = np.array(traverse(d1[i], d2[i], grid, enough), np.int64)
                times = parts[cells]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(np.full(len(part), i))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(cells, times).astype(np.int32)), pa.array(part.astype(np.int32)),
                    batch["vec_id"].take(take), batch["q"].take(take), batch["embedding"].take(take)], ["cell", "part", "query_id", "q", "embedding"])

    def rank(block_rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, scores, who, which = [], [], [], []
        if len(block_rows) and len(asked):
            mine, v, q = block_rows["vec_id"].to_numpy(), matrix(block_rows["embedding"]), matrix(asked["embedding"])
            normal, names, keys = unit(v), asked["query_id"].to_numpy(), asked["q"].to_numpy()
            for a in range(0, len(q), 256):
                near = unit(q[a : a + 256]) @ normal.T
                for i in range(len(near)):
                    found, score = best(names[a + i], q[a + i], near[i], mine, v, nearest)
                    ids.append(found)
                    scores.append(score)
                    who.append(np.full(len(found), names[a + i]))
                    which.append(np.full(len(found), keys[a + i]))
        cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        return pa.table([cat(who, pa.int64()), cat(which, pa.int64()), cat(ids, pa.int64()), cat(scores, pa.float64())], names=["query_id", "q", "vec_id", "score"])

    blocks = F.array(*[F.lit(int(p)) for p in parts]) if len(parts) <= 64 else None
    if blocks is None:
        table = vectors.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "cell int, parts int")
        split = placed.join(F.broadcast(table), "cell")  # k*k rows at most
    else:
        split = placed.withColumn("parts", blocks[F.col("cell")])
    split = split.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("cell", "part", "vec_id", "embedding")
    asking = rows.where(is_query).dropDuplicates(["vec_id", "embedding"]).withColumn("q", F.xxhash64("embedding"))
    asked = asking.mapInArrow(ask, "cell int, part int, query_id long, q long, embedding array<double>")
    found = split.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(lambda a, b: rank(a, b), FOUND)
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
