"""Transcription and stems of names, and the resolution of names against a list of places."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ukrainian letters in German transcription.
GERMAN = dict(
    zip(
        "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя",
        "a b w h g d e je sch s y i ji j k l m n o p r s t u f ch z tsch sch schtsch  ju ja".split(" "),
    )
)
#: Endings of adjectives that a stem is tried without.
ENDINGS = ("ська", "цька", "зька", "івка", "ове", "еве", "ка")


def transcribe(text: Column, table: dict[str, str] = GERMAN) -> Column:
    """Small letters of a text by a table whose entries may have several letters."""
    letters = F.split(F.lower(text), "")
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(entries, c), c)), "")


def stems(name: Column) -> Column:
    """A name, and the name without the first ending that fits, if four letters remain."""
    low = F.lower(F.trim(name))
    cut = reduce(lambda c, e: c.when(low.endswith(e) & (F.length(low) >= len(e) + 4), F.left(low, F.length(low) - len(e))), ENDINGS[1:],
                 F.when(low.endswith(ENDINGS[0]) & (F.length(low) >= len(ENDINGS[0]) + 4), F.left(low, F.length(low) - len(ENDINGS[0]))))
    return F.array_compact(F.array(low, cut))


def resolve(names: DataFrame, places: DataFrame) -> DataFrame:
    """``names`` (id, name, region) with (place, how) from ``places`` (place, name, region).

    In turn: equal name and region; equal name that only one place has; equal stem within
    the region, of one place only; equal stem of one place only.
    """
    keyed = names.withColumn("low", F.lower(F.trim("name")))
    listed = places.select("place", F.lower(F.trim("name")).alias("low"), F.col("region").alias("at"), F.explode(stems(F.col("name"))).alias("stem"))

    def once(by: list[Column], out: str) -> DataFrame:
        grouped = listed.groupBy(*by).agg(F.min("place").alias(out), F.count_distinct("place").alias("n"))
        return grouped.where("n = 1").drop("n")

    steps = [
        ("name_region", once([F.col("low"), F.col("at").alias("region")], "p0"), ["low", "region"]),
        ("name", once([F.col("low")], "p1"), ["low"]),
        ("stem_region", once([F.col("stem"), F.col("at").alias("region")], "p2"), ["stem", "region"]),
        ("stem", once([F.col("stem")], "p3"), ["stem"]),
    ]
    joined = keyed.withColumn("stem", F.try_element_at(stems(F.col("name")), F.lit(-1)))
    for _, side, on in steps:
        joined = joined.join(side, on, "left")
    how = reduce(lambda c, i: c.when(F.col(f"p{i}").isNotNull(), steps[i][0]), range(1, 4), F.when(F.col("p0").isNotNull(), steps[0][0])).otherwise("none")
    return joined.select(*names.columns, F.coalesce("p0", "p1", "p2", "p3").alias("place"), how.alias("how"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two lines; not an edit distance, so it needs Python."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
