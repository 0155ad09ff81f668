"""Ranks and order statistics over whole tables, without a single sorting task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.session import cut, width


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's position from 1 in ``order``, which should be total.

    Rows are sorted by range partitions; a position is the one within the partition
    plus the rows of the partitions before.
    """
    parts = width(df.sparkSession)
    ordered = cut(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


#: Accuracy of the bracket in which an exact percentile is looked for.
ACCURACY = 10_000


def nearest_rank(df: DataFrame, column: str, percent: float) -> DataFrame:
    """One row (value): the nearest-rank percentile, rank = round(percent / 100 * n), half to even, within 1..n.

    An approximate percentile, whose error is bounded, gives a narrow bracket; values
    below it are only counted, those within it are ranked.
    """
    values = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).alias("value"))
    share, n = percent / 100.0, values.count()
    wide = 4.0 / ACCURACY + 2.0 / max(n, 1)
    bounds = values.agg(F.percentile_approx("value", [max(0.0, share - wide), min(1.0, share + wide)], ACCURACY).alias("p")).select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
    wanted = F.lit(min(max(round(share * n), 1), n))
    placed = values.crossJoin(F.broadcast(bounds.withColumn("wanted", wanted)))  # one row
    below = placed.agg(F.count_if(F.col("value") < F.col("low")).alias("below"))
    inside = placed.where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).groupBy("value", "wanted").agg(F.count(F.lit(1)).alias("times"))
    ranked = global_rank(inside, [F.col("value")])
    upto = F.sum("times").over(Window.orderBy("rank"))  # of a few in ten thousand of the rows, equal ones once
    reached = ranked.crossJoin(F.broadcast(below)).withColumn("upto", F.col("below") + upto)  # one row
    return reached.where(F.col("upto") >= F.col("wanted")).agg(F.min("value").alias("value"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], fields: Sequence[str]) -> DataFrame:
    """``fields`` of the first row of each group; ``order``: (column, descending), all descending or all ascending.

    A minimum or maximum of structs, so that rows are reduced before the shuffle and a
    hot group is no larger a task.
    """
    directions = {d for _, d in order}
    if len(directions) != 1:
        raise ValueError("one direction only; turn the sign of numbers for the other")
    best = F.max if directions == {True} else F.min
    picked = F.struct(*(F.col(c) for c, _ in order), *(F.col(f) for f in fields if f not in {c for c, _ in order}))
    return df.groupBy(*keys).agg(best(picked).alias("_best")).select(*keys, *(F.col(f"_best.{f}").alias(f) for f in fields if f not in keys))
