"""Exact top-k inner products by pivot-table elimination.

Distances to a few pivots are kept with every vector. By the triangle inequality the largest difference of two
vectors' pivot distances bounds their own distance from below, and with the lengths that bounds their inner product
from above. A query takes its candidates by falling bound and stops when no bound reaches its k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots, the bounded sample of vectors that they are chosen from, and the factor that turns components to integers.
PIVOTS, SAMPLE, SCALE = 32, 1000, 256
#: Vectors and queries of a block.
VECTORS, QUERIES = 8192, 1024


def _pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Vectors far from each other: each the one farthest from those before."""
    chosen, far = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(count, len(vectors)):
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return vectors[chosen]


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with q, all of 64-bit integers; OverflowError where one does not fit."""
    reach = np.abs(x.astype(np.float64)) @ np.abs(q.astype(np.float64))  # no partial sum is larger
    out = x @ q
    for i in np.flatnonzero(reach >= 2.0**62):
        exact = sum(int(a) * int(b) for a, b in zip(x[i], q))
        if not -(1 << 63) <= exact < 1 << 63:
            raise OverflowError(f"an inner product is {exact}, which no 64-bit score holds; take a smaller scale")
        out[i] = exact
    return out


def _best(q_whole: np.ndarray, q_far: np.ndarray, q_ids: np.ndarray, x_whole: np.ndarray, x_far: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, score) of the k best vectors of a block for each query; ties go to smaller ids.

    Bounds are doubles with a margin; scores are integer products of those candidates that the bounds leave.
    """
    q, x = q_whole.astype(np.float64), x_whole.astype(np.float64)
    gap = np.zeros((len(q), len(x)))
    for p in range(q_far.shape[1]):
        np.maximum(gap, np.abs(q_far[:, p, None] - x_far[None, :, p]), out=gap)
    # Squared distances are sums of integers, exact below 2**53; beyond, their relative error and that of the root stay
    # under 1e-6 of the squared lengths that they are made of, which the bound is raised by.
    q_squares, x_squares = (q * q).sum(1), (x * x).sum(1)
    squares = q_squares[:, None] + x_squares[None, :]
    # No partial sum of a product is larger than the product of the lengths; below 2**53 doubles hold them all exactly.
    small = math.sqrt(q_squares.max()) * math.sqrt(x_squares.max()) < 2.0**52
    far = (q_far**2).max(1)[:, None] + (x_far**2).max(1)[None, :]
    bound = (squares - gap**2) / 2 + 1 + 1e-6 * (squares + far)
    order = np.argsort(-bound, axis=1)
    places, scores = [], []
    for i in range(len(q)):
        done, at, best, mine = False, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        while not done:
            part = order[i, at : at + 512]
            at += len(part)
            part = part[x_ids[part] != q_ids[i]]
            mine = np.concatenate([mine, part])
            best = np.concatenate([best, (x[part] @ q[i]).astype(np.int64) if small else _products(x_whole[part], q_whole[i])])
            top = np.lexsort((x_ids[mine], ~best))[:k]
            mine, best = mine[top], best[top]
            done = at >= len(x) or len(best) == k and bound[i, order[i, at]] < best[-1]
        places.append(mine)
        scores.append(best)
    return np.repeat(np.arange(len(q)), [len(p) for p in places]), np.concatenate(places), np.concatenate(scores)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors by inner product of floor(scale * x).

    Queries are the rows whose key is divisible by `every`; all rows are candidates but those with the query's own
    key. Ties go to the smaller key; fewer candidates give fewer rows. Vectors that are null, empty, or hold nulls or
    non-finite components, and rows with a null key, take no part. A query meets the vectors that have as many
    components as it has. Scores are exact; a product outside the 64-bit integers that a bound does not rule out ends
    the job with OverflowError, components themselves must lie within them. Rows that repeat a key are one candidate each; as queries they share one ranking. Queries meet the
    vectors block by block; a block has a bounded number of rows, and blocks are spread by hash.
    """
    spark = vectors.sparkSession
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    rows = rows.select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    schema = "query_id long, rank int, vec_id long, score long"
    first = rows.limit(SAMPLE).collect()  # bounded: SAMPLE vectors
    if not first:
        return spark.createDataFrame([], schema)
    widths = {len(r["v"]) for r in first}
    pivots = {w: _pivots(np.array([r["v"] for r in first if len(r["v"]) == w], np.float64), PIVOTS) for w in widths}

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column(1).value_lengths().to_numpy()
            for width in np.unique(sizes).tolist():
                b = whole.take(pa.array(np.flatnonzero(sizes == width)))
                to = pivots.get(width, np.zeros((1, width)))  # a width that the sample lacks has the origin as pivot
                v = b.column(1).flatten().to_numpy().reshape(-1, width).astype(np.float64)
                far = np.sqrt(np.maximum((v * v).sum(1)[:, None] + (to * to).sum(1)[None] - 2 * v @ to.T, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(to)), pa.array(far.ravel()))
                out = [b.column(0), b.column(1), lists, pa.array(np.full(len(v), width, np.int32))]
                yield pa.RecordBatch.from_arrays(out, schema=pa.schema([("id", pa.int64()), ("v", b.column(1).type), ("far", pa.list_(pa.float64())), ("width", pa.int32())]))

    table = rows.mapInArrow(distances, "id long, v array<bigint>, far array<double>, width int")
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    n_blocks, q_blocks = max(1, math.ceil(counts["n"] / VECTORS)), max(1, math.ceil(counts["q"] / QUERIES))
    spread = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = table.filter(F.col("id") % every == 0).withColumn("qb", spread(q_blocks)).withColumn("xb", each(n_blocks))
    given = table.withColumn("xb", spread(n_blocks)).withColumn("qb", each(q_blocks))

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        out = []
        x, x_far, x_ids = np.stack(block.v.to_numpy()).astype(np.int64), np.stack(block.far.to_numpy()), block.id.to_numpy()
        for lo in range(0, len(queries), 128):
            some = queries.iloc[lo : lo + 128]
            qi, xi, score = _best(np.stack(some.v.to_numpy()).astype(np.int64), np.stack(some.far.to_numpy()), some.id.to_numpy(), x, x_far, x_ids, k)
            out.append(pd.DataFrame({"query_id": some.id.to_numpy()[qi], "vec_id": x_ids[xi], "score": score}))
        return pd.concat(out)

    met = asked.groupBy("width", "qb", "xb").cogroup(given.groupBy("width", "qb", "xb")).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
