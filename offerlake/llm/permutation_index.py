"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. Every vector is represented by its nearest pivots in order, and posted in
the inverted file of each of them with the pivot's place. For a query the inverted files of its own nearest pivots
give the footrule distance to every vector that shares one; the nearest by footrule are reranked on original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlake.llm.common import checkpointed

PIVOTS = 128  # the index is fitted on so many vectors
PREFIX = 32  # nearest pivots that represent a vector
RERANKED = 0.4  # share of a block's vectors, nearest by footrule, that are reranked; ties at the end are all kept
BLOCK, QUERY_BLOCK = 8192, 8192  # vectors and queries that meet in one task, about


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part: no null id, vector or component, all finite, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def usual_length(rows: DataFrame) -> int | None:
    """The length that most vectors have, of equally common ones the smaller; null without any."""
    found = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return found["size"] if found else None


def pivots_of(rows: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Of vectors of one length the distinct ones with the smallest hashes, `n` at most; they go through the driver."""
    found = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(n).collect()
    return np.array([r["v"] for r in found], np.float64)


def places(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Weight of every pivot for every vector: prefix for the nearest (largest inner product), one less for the next,
    0 beyond the prefix. The footrule distance of two such orders falls as the sum of the smaller weights grows."""
    prefix = min(prefix, len(pivots))
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]
    out = np.zeros((len(x), len(pivots)), np.int16)
    np.put_along_axis(out, order, np.arange(prefix, 0, -1, dtype=np.int16)[None, :], axis=1)
    return out


def inverted_files(weights: np.ndarray) -> np.ndarray:
    """For each pivot the weights of a block's vectors, 0 where one isn't posted. A fourth of the vectors is posted with
    a pivot, so a full row costs less to add up than lists of places."""
    return np.ascontiguousarray(weights.T)


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, prefix: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: ids and inner products of its k nearest in the block, ties to smaller ids, itself left out."""
    files = inverted_files(places(x, pivots, prefix))
    wanted = min(len(x), max(4 * k, int(np.ceil(share * len(x)))))
    for own, vector, weights in zip(query_ids, q, places(q, pivots, prefix), strict=True):
        common = np.zeros(len(x), np.int16)  # prefix * (prefix + 1) / 2 at most
        for p in np.flatnonzero(weights):
            common += np.minimum(files[p], weights[p])
        common[ids == own] = -1
        cut = np.partition(common, len(x) - wanted)[len(x) - wanted]
        near = np.flatnonzero(common >= max(cut, 0))
        # One row at a time, so that a score doesn't depend on the block's shape.
        scores = np.einsum("ij,j->i", x[near], vector)
        if len(near) > k:
            best = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            near, scores = near[best], scores[best]
        best = np.lexsort((ids[near], -scores))[:k]
        yield int(own), ids[near][best], scores[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = RERANKED, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query among all vectors.

    A candidate with the query's own id is left out; ties go to the smaller id; with fewer than k candidates all come.
    Rows that share an id and vector count once, and rows that share an id only are all candidates. Vectors of another
    length than the most usual one take no part, nor do those that `usable` leaves out. Other columns are ignored.

    Vectors and queries are dealt into blocks of bounded size, however often one vector occurs, and every query block
    meets every vector block; each meeting returns k rows a query at most, which a window then merges.
    """
    rows = checkpointed(usable(vectors, id_col, vector_col).distinct())
    asked = usable(queries, id_col, vector_col).distinct()
    schema = "query_id long, vec_id long, score double"
    size = usual_length(rows)
    if size is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (x.where(F.size("v") == size) for x in (rows, asked))
    fitted = pivots_of(rows, pivots)
    n_blocks = max(1, -(-rows.count() // block))
    n_queries = max(1, -(-asked.count() // query_block))
    spread = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(n)).cast("int")
    left = rows.select("id", "v", spread(n_blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"))
    right = asked.select("id", "v", spread(n_queries, 2).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("v").combine_chunks()
        return table.column("id").to_numpy(), flat.flatten().to_numpy().reshape(-1, size)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not a.num_rows or not b.num_rows:
            return pa.table(empty)
        found = list(nearest(*arrays(a), *arrays(b), shared.value, k, prefix, share))
        return pa.table({"query_id": np.repeat([x[0] for x in found], [len(x[1]) for x in found]), "vec_id": np.concatenate([x[1] for x in found]), "score": np.concatenate([x[2] for x in found])})

    met = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(meet, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others.

    Equal scores go to the smaller vec_id; rows that repeat count once; fewer than 20 candidates all come. Null, zero and
    non-finite vectors, null ids and unusual lengths take no part. An empty table gives no rows. Only vec_id and embedding
    are read.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
