"""Every query that SQL can say gives the rows of the SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from sumizh.plans import registry


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_equals_sql(spark, folder, sql, name):
    df = registry.queries[name](spark, folder)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = sql.execute(registry.sql[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert [repr(x) for x in found] == [repr(x) for x in wanted]


def test_queries_without_sql():
    assert set(registry.queries) - set(registry.sql) == {"p3_found", "near_duplicate_lines"}


def test_packed_fields(spark, folder):
    """Every field that isn't null gives its values, in places from 1 on without gaps; the known programmes are whole."""
    found = registry.queries["p3_found"](spark, folder).toPandas()
    fields = spark.read.parquet(f"{folder}/hromadas.parquet").select("row_id", "donorsprograms").toPandas().set_index("row_id")["donorsprograms"]
    assert len(found) > 0 and (found["val"].str.strip() == found["val"]).all()
    for row, f in found.groupby("row_id"):
        assert sorted(f["pos"]) == list(range(1, len(f) + 1))
        plain = lambda x: "".join(c for c in x if c.isalnum())
        assert all(plain(v) in plain(fields[row]) for v in f["val"] if "\\" not in fields[row])


def test_near_duplicate_lines_are_those_of_plain_loops(spark, folder):
    import difflib
    import re

    rows = spark.read.parquet(f"{folder}/hromadas.parquet").toPandas().sort_values(["loaded_at", "row_id"]).drop_duplicates("katottg", keep="last")
    lines = {r.katottg: [x for y in r.goals.split("\n") if len(x := y.strip(" \t-•\r\n")) > 15] for r in rows.itertuples() if r.goals is not None}
    normal = lambda x: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", x.lower())).strip()
    wanted = {}
    for c in spark.read.parquet(f"{folder}/known_curation_candidates.parquet").collect():
        if c.a_katottg in lines and c.b_katottg in lines and c.a_katottg != c.b_katottg:
            pairs = [(normal(x), normal(y)) for x in lines[c.a_katottg] for y in lines[c.b_katottg]]
            best = max((difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs if min(len(x), len(y)) >= 20), default=0.0)
            if best > 0.75:
                wanted[c.cand_id] = best
    found = {r.cand_id: r.ratio for r in registry.queries["near_duplicate_lines"](spark, folder).collect()}
    assert found == pytest.approx(wanted, abs=1e-6)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.queries) <= set(__spark_entry__.queries())
