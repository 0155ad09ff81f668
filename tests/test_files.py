"""Scans, sinks and streams."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from sumizh.sources import files, sinks
from sumizh.streaming.incremental import append_unseen, event_windows, read_new


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "a"}, {"id": 2}]', encoding="utf-8")
    (tmp_path / "b.json").write_text(' {"list": [{"id": 3, "name": "c", "more": 1}]}', encoding="utf-8")
    assert {tuple(r) for r in files.json_records(spark, str(tmp_path), "id bigint, name string").collect()} == {(1, "a"), (2, None), (3, "c")}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('KATOTTG,lat,n\nUA1,50.1,3\nUA2,x,\n', encoding="utf-8")
    rows = files.typed_csv(spark, str(tmp_path / "a.csv"), {"katottg": "string", "lat": "double", "n": "int", "none": "int"}, {"katottg": ["KATOTTG"]}).collect()
    assert [tuple(r) for r in rows] == [("UA1", 50.1, 3, None), ("UA2", None, None, None)]


def test_workbook(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>num</t></si><si><t>Угода</t></si></sst>")
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>12.0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3"/></row></sheetData></worksheet>',
        )
    rows = files.xlsx_rows(spark, str(tmp_path / "*.xlsx"), ["num", "date", "title"])
    assert [tuple(r) for r in rows.select(files.whole_number(F.col("num")), "date", "title").collect()] == [("12", None, "Угода")]


def test_pages(spark):
    page = '<script>var m = {"a": "}", b: {c: undefined}};</script><h2>One</h2><p>Type: x</p><h2>Two</h2><ul><li>A – B</li><li>C – D</li></ul>&amp; end'
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    blocks = files.labelled_blocks(df, "html", "<h2>", {"title": "<h2>([^<]+)", "type": "Type: ([a-z]+)"}).collect()
    assert [(r.title, r.type) for r in blocks] == [("One", "x"), ("Two", None)]
    assert [(r.left, r.right) for r in files.list_rows(df, "html", "<li>([^<]+) – ([^<]+)</li>", ["left", "right"]).collect()] == [("A", "B"), ("C", "D")]
    row = df.select(files.embedded_object("html", F.lit("var m")).alias("o"), files.plain_text(F.col("html")).alias("t"), files.without_undefined(F.lit('{"a":undefined,"b":[undefined]}')).alias("u")).first()
    assert row.o == '{"a": "}", b: {c: undefined}}' and row.t == "One Type: x Two A – B C – D & end" and row.u == '{"a":null,"b":[null]}'


def test_paging():
    pages = {None: [{"id": 1, "u": "a"}, {"id": 2, "u": "b"}], "b": [{"id": 2, "u": "b"}, {"id": 3, "u": "c"}], "c": [{"id": 3, "u": "c"}]}
    assert [r["id"] for r in files.cursor_pages(pages.get, "id", "u", 2)] == [1, 2, 3]
    assert [r["id"] for r in files.offset_pages(lambda o: [{"id": i} for i in range(o, min(o + 2, 5))], 2)] == [0, 1, 2, 3, 4]


def test_manifests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    assert files.file_manifest(spark, str(tmp_path / "in")).first().sha256.startswith("ba7816bf")
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    found = sinks.write_manifest(df, str(tmp_path / "m" / "x.json"), {"with_b": F.col("b").isNotNull()}, version=1)
    assert found == {"version": 1, "rows": 2, "with_b": 1} == json.loads((tmp_path / "m" / "x.json").read_text())


def test_slim(spark, tmp_path):
    df = spark.createDataFrame([("a", None, None, 1), ("b", 0.5, 2.0, 2)], "a string, geo double, op double, extra int")
    sinks.write_slim(df, str(tmp_path / "slim"), ["a", "geo", "op"], "op")
    rows = {r["a"]: r for r in map(json.loads, (v.value for v in spark.read.text(str(tmp_path / "slim")).collect()))}
    assert rows == {"a": {"a": "a", "geo": None}, "b": {"a": "b", "geo": 0.5, "op": 2.0}}


def test_upsert(spark):
    rows = spark.createDataFrame([("k1", "n1", "old", 1), ("k2", "n2", None, 2), (None, "n3", "o", 3)], "code string, name string, goals string, z int")
    updates = spark.createDataFrame([("k1", "x", "new"), (None, "n2", "two"), ("k9", "n3", None), ("k8", "nowhere", "q")], "code string, name string, goals string")
    merged, unmet = sinks.upsert(rows, updates, ["code", "name"], ["goals"])
    assert {(r.name, r.goals) for r in merged.collect()} == {("n1", "new"), ("n2", "two"), ("n3", "o")}
    assert [r.name for r in unmet.collect()] == ["nowhere"] and merged.columns == rows.columns
    kept, _ = sinks.upsert(rows, updates, ["code", "name"], ["goals"], only_missing=True)
    assert {(r.name, r.goals) for r in kept.collect()} == {("n1", "old"), ("n2", "two"), ("n3", "o")}
    assert sinks.place_after(rows, "z", "code").columns == ["code", "z", "name", "goals"]


def test_streams(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id bigint, v string"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).coalesce(1).write.parquet(source)
    for more in ([], [(2, "again"), (3, "c")]):
        if more:
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
        append_unseen(read_new(spark, source, schema), target, mark, "id").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_windows(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/events.parquet").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema.simpleString()[7:-1].replace(":", " ")
    stream = event_windows(read_new(spark, str(tmp_path / "e"), schema), "ts", "event_type", "value")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{folder}/events.parquet").count()


def test_missing_ids_are_fetched_once_and_errors_kept(spark, tmp_path):
    marks = str(tmp_path)

    def fetch(i: str) -> str:
        import os

        tries = len([x for x in os.listdir(marks) if x.startswith(f"{i}-")])
        open(os.path.join(marks, f"{i}-{tries}"), "w").close()
        if i == "3" or (i == "2" and tries == 0):
            raise ValueError("not now")
        return f"body {i}"

    ids = spark.createDataFrame([("1",), ("2",), ("2",), ("3",), ("4",), (None,)], "id string")
    cached = spark.createDataFrame([("4",)], "id string")
    found = {r.id: (r.body, r.error) for r in files.fetch_missing(ids, cached, "id", fetch, width=2, retries=2, pause=0.0).collect()}
    assert found == {"1": ("body 1", None), "2": ("body 2", None), "3": (None, "ValueError: not now")}


def test_catalogue_and_packages(spark):
    rows = spark.createDataFrame([(1, [("R", [("a", 1), ("b", 2)]), ("S", [])])], "id int, regions array<struct<region:string,documents:array<struct<title:string,n:int>>>>")
    assert sorted((r.region, r["at"], r.title, r.n) for r in files.catalogue_documents(rows, "regions", "documents").collect()) == [("R", 0, "a", 1), ("R", 1, "b", 2)]
    packages = spark.createDataFrame([("p", [("u", "x"), ("v", "y")]), ("q", [])], "package string, resources array<struct<url:string,format:string>>")
    assert sorted(tuple(r) for r in files.package_resources(packages, "resources").collect()) == [("p", "u", "x"), ("p", "v", "y")]


def test_classifier_levels(spark):
    rows = [("UA05", None, None, "O", "Обл"), ("UA05", "UA0501", None, "P", "Рай"), ("UA05", "UA0501", "UA050101", "H", "Гром")]
    found = files.classifier_levels(spark.createDataFrame(rows, "level1 string, level2 string, level3 string, category string, name string"), "code", "category", "name", {"regions": "O", "districts": "P", "entities": "H"})
    assert {k: [tuple(r) for r in d.collect()] for k, d in found.items()} == {"regions": [("UA05", None, "Обл")], "districts": [("UA0501", "UA05", "Рай")], "entities": [("UA050101", "UA0501", "Гром")]}
