"""Scans of files as data portals deliver them.

Schemas are given, never inferred; what can't be read as its type is null, not zero.
"""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that are a list of records, or an object with the list under ``list``."""
    text = spark.read.text(path, wholetext=True)
    trimmed = F.ltrim("value")
    listed = F.from_json("value", f"array<struct<{schema}>>")
    wrapped = F.from_json("value", f"struct<list:array<struct<{schema}>>>")["list"]
    rows = text.select(F.explode(F.when(trimmed.startswith("["), listed).otherwise(wrapped)).alias("r"))
    return rows.select("r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def typed_csv(spark: SparkSession, path: str, types: Mapping[str, str], aliases: Mapping[str, Iterable[str]] | None = None, line_breaks: bool = False) -> DataFrame:
    """Columns of a CSV with a header, cast to ``types``; a column may go by one of its ``aliases``.

    Large files are split between tasks; only ``line_breaks`` within fields keep a file whole.
    """
    raw = spark.read.csv(path, header=True, multiLine=line_breaks, escape='"')
    out = []
    for name, kind in types.items():
        present = [c for c in (name, *((aliases or {}).get(name, ()))) if c in raw.columns]
        value = F.coalesce(*(F.col(f"`{c}`") for c in present)) if present else F.lit(None).cast("string")
        trimmed = F.trim(value)
        out.append((F.when(trimmed != "", trimmed) if kind == "string" else trimmed.try_cast(kind)).alias(name))
    return raw.select(*out)


def _cells(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of a workbook, as text."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{space}t")))
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{space}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{space}c"):
                letters = re.match(r"[A-Z]+", c.get("r", "A")).group()
                at = 0
                for letter in letters:
                    at = at * 26 + ord(letter) - 64
                value = c.find(f"{space}v")
                if c.get("t") == "s" and value is not None:
                    cells[at - 1] = shared[int(value.text)]
                elif c.get("t") == "inlineStr":
                    cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{space}t"))
                else:
                    cells[at - 1] = value.text if value is not None else None
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def whole_number(value: Column) -> Column:
    """A key that a workbook holds as a number, without the decimals: 12.0 is 12."""
    return F.regexp_replace(value, r"^(-?[0-9]+)\.0+$", "$1")


def xlsx_rows(spark: SparkSession, path: str, columns: list[str], skip: int = 1) -> DataFrame:
    """Rows of workbooks, read file by file on the workers; the first ``skip`` rows and empty ones are left out."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                rows = [r for i, r in enumerate(_cells(content)) if i >= skip and any(v not in (None, "") for v in r)]
                yield pd.DataFrame([(r + [None] * len(columns))[: len(columns)] for r in rows], columns=columns, dtype="object")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"`{c}` string" for c in columns))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def labelled_blocks(pages: DataFrame, html: str, start: str, labels: Mapping[str, str]) -> DataFrame:
    """One row per block of a page, blocks beginning at ``start``; per label the first group of its pattern."""
    blocks = pages.select(*(c for c in pages.columns if c != html), F.posexplode(F.split(html, f"(?={start})")).alias("at", "block")).where(F.col("block").rlike(start))
    found = lambda p: F.nullif(F.trim(F.regexp_extract("block", p, 1)), F.lit(""))
    return blocks.select(*(c for c in blocks.columns if c not in ("at", "block")), "at", *(found(p).alias(n) for n, p in labels.items()))


def list_rows(pages: DataFrame, html: str, row: str, names: list[str]) -> DataFrame:
    """One row per match of a pattern, its groups as columns."""
    groups = [F.regexp_extract_all(html, F.lit(row), i + 1) for i in range(len(names))]
    zipped = pages.select(*(c for c in pages.columns if c != html), F.posexplode(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, names)))).alias("at", "r"))
    return zipped.select(*(c for c in pages.columns if c != html), "at", *(F.col(f"r.{n}").alias(n) for n in names))


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags off, the common entities resolved, blanks brought together."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.udf(T.StringType())
def embedded_object(text: str | None, marker: str | None) -> str | None:
    """The object in braces after a marker; braces within strings don't count.  Balance is no regular language."""
    if text is None or not marker or (at := text.find(marker)) < 0 or (start := text.find("{", at)) < 0:
        return None
    depth, quote, i = 0, "", start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
        i += 1
    return None


def without_undefined(script: Column) -> Column:
    """``undefined`` as a value becomes ``null``, so that a state of a page is JSON."""
    return F.regexp_replace(script, r"(?<=[:\[,])\s*undefined(?=\s*[,}\]])", "null")


def cursor_pages(fetch: Callable[[str | None], list[dict]], key: str, cursor: str, size: int) -> Iterator[dict]:
    """Records of a list read from a cursor on, each key once; ends at a short page or one without new keys."""
    seen: set = set()
    at = None
    while True:
        page = fetch(at)
        new = [r for r in page if r[key] not in seen]
        seen.update(r[key] for r in new)
        yield from new
        if len(page) < size or not new:
            return
        at = page[-1][cursor]


def offset_pages(fetch: Callable[[int], list[dict]], size: int) -> Iterator[dict]:
    """Records of a list read by offset, until a short page."""
    offset = 0
    while True:
        page = fetch(offset)
        yield from page
        if len(page) < size:
            return
        offset += size


def newest_first(resources: DataFrame, preferred_host: str) -> DataFrame:
    """The one resource to read: of the preferred host if there is any, then the newest."""
    return resources.orderBy(F.desc(F.col("url").contains(preferred_host)), F.desc_nulls_last("modified"), "url").limit(1)


def catalogue_documents(catalogue: DataFrame, regions: str, documents: str) -> DataFrame:
    """One row for each document of a nested catalogue: an array of regions, each with an array of documents; a region's own fields stay beside."""
    region = catalogue.select(*(c for c in catalogue.columns if c != regions), F.explode(regions).alias("_r"))
    fields = [f.name for f in region.schema["_r"].dataType.fields if f.name != documents]
    listed = region.select(*(c for c in region.columns if c != "_r"), *(F.col(f"_r.{f}").alias(f) for f in fields), F.posexplode(f"_r.{documents}").alias("at", "_d"))
    return listed.select(*(c for c in listed.columns if c != "_d"), "_d.*")


def package_resources(packages: DataFrame, resources: str) -> DataFrame:
    """One row for each resource of each package, packages without any left out."""
    return packages.select(*(c for c in packages.columns if c != resources), F.explode(resources).alias("_r")).select(*(c for c in packages.columns if c != resources), "_r.*")


def classifier_levels(rows: DataFrame, code: str, category: str, name: str, levels: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """A relation (code, parent, name) for each level of a classifier, by category letters; the parent is the nearest code above that the row names."""
    columns = [c for c in rows.columns if c.startswith("level")]
    own = F.coalesce(*(F.col(c) for c in reversed(columns)))
    above = F.element_at(F.filter(F.array(*(F.col(c) for c in columns)), lambda x: x.isNotNull() & (x != own)), -1)
    keyed = rows.select(own.alias(code), F.when(F.size(F.array_compact(F.array(*columns))) > 1, above).alias("parent"), category, name)
    return {level: keyed.where(F.col(category).isin(*letters)).select(code, "parent", name) for level, letters in levels.items()}


def fetch_missing(ids: DataFrame, cached: DataFrame, key: str, fetch: Callable[[str], str | None], width: int = 8, retries: int = 3, pause: float = 0.5, limit: int | None = None) -> DataFrame:
    """(key, body, error): what ``fetch`` gives for each id that ``cached`` doesn't have yet.

    ``width`` partitions bound how many requests run at once; a failed one is tried again
    after a pause that doubles, and its last error is kept in the row, not raised.
    """
    wanted = ids.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct().join(cached.select(F.col(key).cast("string").alias(key)), key, "left_anti")
    if limit is not None:
        wanted = wanted.orderBy(key).limit(limit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i in f[key]:
                body, error = None, None
                for turn in range(retries):
                    try:
                        body, error = fetch(i), None
                        break
                    except Exception as e:  # whatever a request may raise
                        error = f"{type(e).__name__}: {e}"
                        if turn + 1 < retries:
                            time.sleep(pause * 2**turn)
                out.append((i, body, error))
            yield pd.DataFrame(out, columns=[key, "body", "error"], dtype="object")

    return wanted.repartition(width, key).mapInPandas(run, f"{key} string, body string, error string")


def page_state(html: Column, marker: str) -> Column:
    """The JSON of the state that a page's script holds after a marker, ``undefined`` made null."""
    return without_undefined(embedded_object(html, F.lit(marker)))
