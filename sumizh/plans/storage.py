"""Queries that write tables to the shared folder and read them back, as files and as streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.plans.registry import registry
from sumizh.session import ensure_checkpoint_dir
from sumizh.sources import files, sinks
from sumizh.sources.tables import table
from sumizh.streaming import incremental


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid4().hex}"


@registry.add("json_list_scan", "SELECT portal_id, name, katottg, population FROM hromada_portals")
def json_list_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A table written as lists of records and read with a given schema."""
    at = scratch(spark)
    rows = table(spark, folder, "hromada_portals").select("portal_id", "name", "katottg", "population")
    # a list for each of many groups of rows, so that no file is large
    lists = rows.groupBy((F.col("portal_id") % 64).alias("g")).agg(F.collect_list(F.struct("portal_id", "name", "katottg", "population")).alias("list"))
    lists.select(F.to_json(F.struct("list")).alias("value")).repartition(64).write.option("maxRecordsPerFile", 1).text(at)
    return files.json_records(spark, at, "portal_id bigint, name string, katottg string, population bigint")


@registry.add("json_lines_scan", "SELECT edge_id, a, b, known FROM matching_edges13")
def json_lines_scan(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch(spark)
    sinks.write_json(table(spark, folder, "matching_edges13").select("edge_id", "a", "b", "known"), at)
    return files.json_lines(spark, at, "edge_id bigint, a string, b string, known boolean")


@registry.add("csv_scan", "SELECT card_id, nullif(trim(title, ' '), '') AS title, residents, CAST(NULL AS INTEGER) AS year FROM gisrr_cards")
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV with a column under another name, numbers as text, and a column that isn't there."""
    at = scratch(spark)
    table(spark, folder, "gisrr_cards").select("card_id", F.col("title").alias("Title"), F.col("residents").cast("string").alias("People")).write.option("escape", '"').csv(at, header=True)
    return files.typed_csv(spark, at, {"card_id": "bigint", "title": "string", "residents": "bigint", "year": "int"}, {"title": ["Title"], "residents": ["People"]}, line_breaks=True)


@registry.add(
    "slim_sink",
    """SELECT edge_id, a, b, CASE WHEN isnan(sector_jaccard) THEN NULL ELSE sector_jaccard END AS sector_jaccard, sector_jaccard IS NULL AS left_out FROM matching_edges13""",
)
def slim_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Core columns as JSON lines; a null of one column is left out of the line, which is told here."""
    at = scratch(spark)
    sinks.write_slim(table(spark, folder, "matching_edges13"), at, ["edge_id", "a", "b", "sector_jaccard"], "sector_jaccard")
    lines = spark.read.text(at)
    parsed = lines.select(F.from_json("value", "edge_id bigint, a string, b string, sector_jaccard double", {"allowNonNumericNumbers": "true"}).alias("r"), (~F.col("value").contains('"sector_jaccard"')).alias("left_out"))
    return parsed.select("r.edge_id", "r.a", "r.b", F.when(~F.isnan("r.sector_jaccard"), F.col("r.sector_jaccard")).alias("sector_jaccard"), "left_out")


@registry.add("full_sink", "SELECT oblast, CAST(count(*) AS BIGINT) AS n, min(row_id) AS first_id FROM hromadas GROUP BY oblast")
def full_sink(spark: SparkSession, folder: str) -> DataFrame:
    """A table written by region and read back: a filter on the region would prune folders."""
    at = scratch(spark)
    rows = table(spark, folder, "hromadas").select("row_id", "name", "oblast")
    sinks.write_full(rows.repartition("oblast"), at, ["oblast"])
    return spark.read.parquet(at).groupBy("oblast").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"))


@registry.add("preview_sink", "SELECT cand_id, a, b, score FROM known_curation_candidates ORDER BY score DESC, cand_id LIMIT 20")
def preview_sink(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best candidates as a small file for display."""
    at = scratch(spark)
    sinks.write_preview(table(spark, folder, "known_curation_candidates").select("cand_id", "a", "b", "score"), at, [F.desc("score"), F.asc("cand_id")], 20)
    return files.json_lines(spark, at, "cand_id bigint, a string, b string, score double")


@registry.add("upsert_rows", "SELECT p.portal_id, coalesce(g.oblast, p.oblast) AS oblast FROM hromada_portals p LEFT JOIN (SELECT katottg, min(oblast) AS oblast FROM corpus_growth_priority WHERE katottg IS NOT NULL GROUP BY katottg) g ON g.katottg = p.katottg")
def upsert_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of portals with those that another table has for the code."""
    rows = table(spark, folder, "hromada_portals").select("portal_id", "katottg", "oblast")
    updates = table(spark, folder, "corpus_growth_priority").where("katottg IS NOT NULL").select("katottg", "oblast")
    return sinks.upsert(rows, updates, ["katottg"], ["oblast"])[0].select("portal_id", "oblast")


@registry.add("stream_append", "SELECT event_id, event_type, value FROM events")
def stream_append(spark: SparkSession, folder: str) -> DataFrame:
    """Events delivered in two parts, the second with the first in it again, appended by two runs; each event once."""
    at = scratch(spark)
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    for run, rows in enumerate((events.where("event_id % 2 = 0"), events)):
        rows.write.mode("append").parquet(f"{at}/in")
        stream = incremental.read_new(spark, f"{at}/in", "event_id bigint, event_type string, value double")
        incremental.append_unseen(stream, f"{at}/out", f"{at}/state", "event_id").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "event_type", "value")


@registry.add("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS starts, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour and kind."""
    rows = incremental.event_windows(table(spark, folder, "events"), "ts", "event_type", "value")
    return rows.select("starts", "event_type", "n", F.round("total", 4).alias("total"))


@registry.add(
    "localized_titles",
    """WITH t AS (SELECT katottg, lang, doc_id, split_part(text, chr(10), 1) AS title FROM documents WHERE katottg IS NOT NULL AND text <> '')
    SELECT katottg, coalesce(min_by(title, doc_id) FILTER (lang = 'uk'), min_by(title, doc_id)) AS title, CAST(count(*) AS BIGINT) AS texts FROM t GROUP BY katottg""",
)
def localized_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The first title in one language, else the first in any; rows are reduced, never gathered."""
    rows = table(spark, folder, "documents").where("katottg IS NOT NULL AND text <> ''").withColumn("title", F.substring_index("text", "\n", 1))
    own = F.min_by(F.when(F.col("lang") == "uk", F.col("title")), F.when(F.col("lang") == "uk", F.col("doc_id")))
    return rows.groupBy("katottg").agg(F.coalesce(own, F.min_by("title", "doc_id")).alias("title"), F.count(F.lit(1)).alias("texts"))


@registry.add(
    "location_codes",
    """SELECT cand_id, list_sort(list_distinct(list_filter([a_katottg, b_katottg], lambda c: c IS NOT NULL AND c <> ''))) AS codes, list_sort(list_distinct([oblast_a, oblast_b])) AS regions FROM known_curation_candidates""",
)
def location_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of one scheme out of lists nested in lists: places, their items, and the identifiers of each."""
    item = lambda scheme, c: F.struct(F.array(F.struct(F.lit(scheme).alias("scheme"), F.col(c).alias("id")), F.struct(F.lit("other").alias("scheme"), F.lit("-").alias("id"))).alias("ids"))
    places = F.array(F.struct(F.array(item("code", "a_katottg"), item("region", "oblast_a")).alias("items")), F.struct(F.array(item("code", "b_katottg"), item("region", "oblast_b")).alias("items")))
    rows = table(spark, folder, "known_curation_candidates").select("cand_id", places.alias("places"))
    every = F.flatten(F.flatten(F.transform("places", lambda p: F.transform(p["items"], lambda i: i["ids"]))))
    of = lambda scheme: F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda x: (x["scheme"] == scheme) & (x["id"] != "")), lambda x: x["id"])))
    return rows.select("cand_id", of("code").alias("codes"), of("region").alias("regions"))


@registry.add(
    "catalogue_flatten",
    """SELECT oblast AS region, name AS title, row_id FROM hromadas""",
)
def catalogue_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue of regions with their documents, in parts, flattened to documents."""
    rows = table(spark, folder, "hromadas").select("oblast", F.struct(F.col("name").alias("title"), "row_id").alias("d"), (F.col("row_id") % 16).alias("part"))
    regions = rows.groupBy("part", "oblast").agg(F.collect_list("d").alias("documents"))  # a sixteenth of a region
    catalogue = regions.groupBy("part").agg(F.collect_list(F.struct(F.col("oblast").alias("region"), "documents")).alias("regions"))
    return files.catalogue_documents(catalogue, "regions", "documents").select("region", "title", "row_id")


@registry.add(
    "first_by_sector",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN CAST(props->>'k' AS INTEGER) < 50 THEN 'low' ELSE 'high' END AS sector FROM events), f AS (SELECT sector, user_id, min(event_id) AS event_id FROM e GROUP BY 1, 2)
    SELECT sector, user_id, event_id, CAST(row_number() OVER (PARTITION BY sector ORDER BY event_id) AS INTEGER) AS place FROM f QUALIFY place <= 80""",
)
def first_by_sector(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of each user in a sector, and of these the eighty first of the sector."""
    k = F.from_json("props", "k int")["k"]
    first = table(spark, folder, "events").groupBy(F.when(k < 50, "low").otherwise("high").alias("sector"), "user_id").agg(F.min("event_id").alias("event_id"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("sector").orderBy("event_id"))).where("place <= 80")
