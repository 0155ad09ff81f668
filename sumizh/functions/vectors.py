"""Vectors: array expressions for single pairs, and block kernels for searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a block; a product of two blocks fits easily in a worker.
BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-8) -> Column:
    """A vector of length one; zeros if it is shorter than ``least``."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n < least, 0.0).otherwise(x.cast("double") / n))


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """One row (mean): the mean by position; rows are added up before the shuffle."""
    exploded = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # as many rows as the vectors have positions
    return exploded.agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("all")).select(F.transform("all", lambda s: s["m"]).alias("mean"))


def _blocks(df: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """Rows packed by hash into blocks of about ``BLOCK``: (block, ids, vectors)."""
    many = F.floor((F.col("_n") - 1) / BLOCK) + 1
    counted = df.select(key, vector).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    placed = counted.withColumn("block", F.pmod(F.xxhash64(key), many))
    packed = placed.groupBy("block").agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))).alias("rows"))
    return packed.select(F.col("block").alias(f"{prefix}block"), F.col("rows").alias(f"{prefix}rows"))


def search(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, least: float | None = None) -> DataFrame:
    """(query, id, similarity, place): the ``k`` rows most like each query by cosine, itself left out.

    Queries and rows are packed into blocks; each pair of a block of queries and one of
    rows is one matrix product, of which the best ``k`` a query are kept, so what is
    shuffled afterwards is ``k`` per query and block.  Equal similarities, to six
    digits, are ordered by id.
    """
    q = _blocks(queries, key, vector, "q_")
    r = _blocks(rows, key, vector, "r_")

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def matrix(packed) -> tuple[np.ndarray, np.ndarray]:
            ids = np.array([x["id"] for x in packed])
            m = np.array([x["v"] for x in packed], dtype="f8")
            return ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)

        for f in frames:
            for q_rows, r_rows in zip(f["q_rows"], f["r_rows"]):
                q_ids, q_m = matrix(q_rows)
                r_ids, r_m = matrix(r_rows)
                like = np.round(q_m @ r_m.T, 6) + 0.0
                found = []
                for i, own in enumerate(q_ids):
                    keep = np.flatnonzero(r_ids != own)
                    if least is not None:
                        keep = keep[like[i, keep] >= least]
                    if len(keep) > k:  # no less than the k-th value can be among the first
                        at_k = np.partition(like[i, keep], len(keep) - k)[len(keep) - k]
                        keep = keep[like[i, keep] >= at_k]
                    order = keep[np.lexsort((r_ids[keep], -like[i, keep]))][:k]
                    found += [(own, r_ids[j], like[i, j]) for j in order]
                yield pd.DataFrame(found, columns=["query", "id", "similarity"]).astype({"query": "int64", "id": "int64", "similarity": "float64"})

    # of blocks, not rows; multiplied where they meet, since a pair of blocks is larger than its result
    best = q.crossJoin(r).mapInPandas(multiply, "query bigint, id bigint, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return best.withColumn("place", place).where(F.col("place") <= k)
