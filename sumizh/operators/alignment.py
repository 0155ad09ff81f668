"""Similarity of owners that have several lines each, from the vectors of the lines.

For two owners: each line's best match on the other side, the mean of the best matches
capped at the smaller number of lines and weighted, and the cosine of the owners'
centroids; the blend of the two.  Lines that many owners share weigh less.

Lines are packed into blocks of bounded size, an owner with many lines into several.
Pairs of blocks meet, each in one small matrix product, of which each line's best match
for each other owner is kept; these are put together afterwards, so that an owner may
have any number of lines and is never one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.functions import vectors as V

# Shares of the aligned lines and of the centroids; similarity from which a line counts as shared; owners that may share one for nothing.
ALIGNED, CENTROID = 0.65, 0.35
SHARED, FREE = 0.90, 2
#: Lines of a block at most.
BLOCK = 1024


def weight_of(df: F.Column) -> F.Column:
    """The weight of a line that ``df`` other owners have as well."""
    return 1 / (1 + F.log1p(F.greatest(df - FREE, F.lit(0)).cast("double")))


def _blocks(lines: DataFrame, prefix: str) -> DataFrame:
    """Lines (id, owner, v) packed by hash into blocks of about ``BLOCK``."""
    many = F.floor((F.col("_n") - 1) / BLOCK) + 1
    counted = lines.crossJoin(F.broadcast(lines.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    placed = counted.withColumn(f"{prefix}block", F.pmod(F.xxhash64("id"), many))
    return placed.groupBy(f"{prefix}block").agg(F.collect_list(F.struct("id", "owner", "v")).alias(f"{prefix}rows"))


def _matrix(packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.array([x["v"] for x in packed], dtype="f8")
    return np.array([x["id"] for x in packed]), np.array([x["owner"] for x in packed]), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def sharing_owners(queries: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """(id, df): how many other owners have a line at least so much like each of ``queries`` (id, owner, v); none gives no row.

    What leaves a pair of blocks is one row for a query and an owner.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q_rows, r_rows in zip(f["q_rows"], f["r_rows"]):
                (q, q_owner, q_m), (_, r_owner, r_m) = _matrix(q_rows), _matrix(r_rows)
                i, j = np.nonzero((np.round(q_m @ r_m.T, 6) >= least) & (q_owner[:, None] != r_owner[None, :]))
                yield pd.DataFrame({"id": q[i], "other": r_owner[j]}).drop_duplicates()

    kind, owner = queries.schema["id"].dataType.simpleString(), queries.schema["owner"].dataType.simpleString()
    # of blocks, not lines
    met = _blocks(queries, "q_").crossJoin(_blocks(lines, "r_")).mapInPandas(run, f"id {kind}, other {owner}")
    return met.groupBy("id").agg(F.count_distinct("other").alias("df"))


def best_matches(lines: DataFrame) -> DataFrame:
    """(id, owner, other, best): the similarity of each line (id, owner, v) to the line of each other owner that is most like it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q_rows, r_rows in zip(f["q_rows"], f["r_rows"]):
                (q, q_owner, q_m), (_, r_owner, r_m) = _matrix(q_rows), _matrix(r_rows)
                order = np.argsort(r_owner, kind="stable")
                owners, starts = np.unique(r_owner[order], return_index=True)
                best = np.maximum.reduceat(q_m @ r_m[order].T, starts, axis=1)
                i, j = np.nonzero(q_owner[:, None] != owners[None, :])
                yield pd.DataFrame({"id": q[i], "owner": q_owner[i], "other": owners[j], "best": best[i, j]})

    kind, owner = lines.schema["id"].dataType.simpleString(), lines.schema["owner"].dataType.simpleString()
    met = _blocks(lines, "q_").crossJoin(_blocks(lines, "r_")).mapInPandas(run, f"id {kind}, owner {owner}, other {owner}, best double")  # of blocks
    return met.groupBy("id", "owner", "other").agg(F.max("best").alias("best"))


def centred(lines: DataFrame) -> DataFrame:
    """Lines (id, owner, v) with the mean of all taken off, as unit vectors."""
    off = lines.crossJoin(F.broadcast(V.mean_vector(lines, "v"))).withColumn("v", F.zip_with("v", "mean", lambda x, m: x.cast("double") - m))  # one row
    return off.select("id", "owner", V.unit(F.col("v")).alias("v"))


def owner_similarity(lines: DataFrame) -> DataFrame:
    """(a, b, similarity), a < b, of every two owners of ``lines`` (id, owner, v); 0 at least.

    Vectors are centred and lines weighted by how many owners share them.
    """
    units = centred(lines)
    weights = sharing_owners(lines, lines, SHARED)
    weighted = units.join(weights, "id", "left").withColumn("w", weight_of(F.coalesce("df", F.lit(0))))
    counts = lines.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    best = best_matches(units).join(weighted.select("id", "w"), "id")
    best = best.join(counts, "owner").join(counts.select(F.col("owner").alias("other"), F.col("n").alias("m")), "other")
    place = F.row_number().over(Window.partitionBy("owner", "other").orderBy(F.desc(F.round("best", 9)), "id"))
    capped = best.withColumn("r", place).where(F.col("r") <= F.least("n", "m"))
    sides = capped.groupBy("owner", "other").agg((F.sum(F.col("best") * F.col("w")) / F.sum("w")).alias("aligned"))
    pairs = sides.groupBy(F.least("owner", "other").alias("a"), F.greatest("owner", "other").alias("b")).agg(F.avg("aligned").alias("aligned"))
    positions = weighted.select("owner", "w", F.posexplode("v").alias("at", "x")).groupBy("owner", "at").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    # as many numbers as a vector has positions
    middle = positions.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v")).select("owner", V.unit(F.col("v")).alias("v"))
    joined = pairs.join(middle.select(F.col("owner").alias("a"), F.col("v").alias("va")), "a").join(middle.select(F.col("owner").alias("b"), F.col("v").alias("vb")), "b")
    return joined.select("a", "b", F.round(F.greatest(F.lit(0.0), ALIGNED * F.col("aligned") + CENTROID * V.dot(F.col("va"), F.col("vb"))), 6).alias("similarity"))
