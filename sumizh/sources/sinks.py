"""Sinks: slim and full edges, manifests, upserts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.session import cut


def write_slim(df: DataFrame, path: str, core: Sequence[str], droppable: str) -> None:
    """The core columns as JSON lines; nulls are written, but a null ``droppable`` is left out."""
    whole = F.to_json(F.struct(*core), {"ignoreNullFields": "false"})
    without = F.to_json(F.struct(*(c for c in core if c != droppable)), {"ignoreNullFields": "false"})
    df.select(F.when(F.col(droppable).isNull(), without).otherwise(whole).alias("value")).write.mode("overwrite").text(path)


def write_full(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_manifest(df: DataFrame, path: str, counts: Mapping[str, Column], **more) -> dict:
    """Counts of a table, in one pass, as a small JSON file."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in counts.items())).first()
    manifest = {**more, **row.asDict()}
    write_text(df.sparkSession, path, json.dumps(manifest, ensure_ascii=False, indent=2) + "\n")
    return manifest


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, on whatever file system the path is of."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_json(df: DataFrame, path: str) -> None:
    """All columns as JSON lines, nulls written."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_preview(df: DataFrame, path: str, order: Sequence[Column], most: int) -> None:
    """The first ``most`` rows in ``order`` as JSON lines, for display."""
    write_json(df.orderBy(*order).limit(most), path)


def upsert(rows: DataFrame, updates: DataFrame, keys: Sequence[str], fields: Sequence[str], only_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with the updates in, updates that met no row).

    An update meets rows by the first of ``keys`` under which it finds any.  Of several
    updates for a row the first by key order wins, then that with the smallest values.
    A null in an update keeps the old value; ``only_missing`` keeps every old value.
    """
    # both are read by several branches, in which the numbers must be the same
    numbered = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    tagged = cut(updates.withColumn("_update", F.monotonically_increasing_id()))
    left = tagged
    hits = None
    for order, key in enumerate(keys):
        met = left.where(F.col(key).isNotNull()).alias("u").join(numbered.select(F.col(key).alias("_k"), "_row"), F.col(key) == F.col("_k"))
        found = met.select(F.lit(order).alias("_order"), "_row", "_update", *(F.col(f"u.{f}").alias(f"_new_{f}") for f in fields))
        hits = found if hits is None else hits.unionByName(found)
        left = left.join(found.select("_update").distinct(), "_update", "left_anti")
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy("_row").orderBy("_order", *(F.col(f"_new_{f}") for f in fields)))).where("_r = 1")
    joined = numbered.join(first.drop("_update", "_order", "_r"), "_row", "left")
    value = lambda f: F.coalesce(f, f"_new_{f}") if only_missing else F.coalesce(f"_new_{f}", f)
    merged = joined.select(*(value(c).alias(c) if c in fields else F.col(c) for c in rows.columns))
    return merged, left.drop("_update")


def place_after(df: DataFrame, column: str, after: str) -> DataFrame:
    """``df`` with one column moved behind another."""
    rest = [c for c in df.columns if c != column]
    at = rest.index(after) + 1
    return df.select(*rest[:at], column, *rest[at:])
