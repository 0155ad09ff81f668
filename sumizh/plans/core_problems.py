"""Queries of the general problems on data of mixed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumizh.operators.multivalue import split_values
from sumizh.plans.registry import registry
from sumizh.sources.tables import table

#: Names of the list of known programmes at most; it is held by every worker.
MOST_PROGRAMMES = 10_000


def known_programmes(spark: SparkSession, folder: str) -> list[str]:
    """The names of donor_programs, a small fixed list."""
    found = [r.program for r in table(spark, folder, "donor_programs").select("program").limit(MOST_PROGRAMMES + 1).collect()]
    if len(found) > MOST_PROGRAMMES:
        raise ValueError(f"donor_programs has more than {MOST_PROGRAMMES} names")
    return [x for x in found if x]


@registry.add("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each programme in hromadas.donorsprograms, with its position."""
    return split_values(table(spark, folder, "hromadas"), "row_id", "donorsprograms", known_programmes(spark, folder))

