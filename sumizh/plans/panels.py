"""Queries over keyed panels, events, graphs and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.functions import geo as G
from sumizh.operators.graph import components, triangles
from sumizh.operators.ranking import first_of
from sumizh.plans.entities import undirected
from sumizh.plans.registry import registry
from sumizh.sources.tables import table


@registry.add(
    "latest_panel_row",
    """SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_panel_row(spark: SparkSession, folder: str) -> DataFrame:
    """The last order of each customer; an order without a date would never win over one with."""
    best = first_of(table(spark, folder, "orders"), ["o_custkey"], [("o_orderdate", True), ("o_orderkey", True)], ["o_orderkey", "o_totalprice", "o_orderdate"])
    return best.select("o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))


@registry.add(
    "panel_agg",
    """SELECT o_custkey, CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS years, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS most,
    CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS finished FROM orders GROUP BY o_custkey""",
)
def panel_agg(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct years, sum, maximum and a conditional count by key."""
    return (
        table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count_distinct(F.year("o_orderdate")).alias("years"),
            F.round(F.sum("o_totalprice"), 2).alias("total"),
            F.max("o_totalprice").alias("most"),
            F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        )
    )


@registry.add(
    "covariate_left_joins",
    """WITH o AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey)
    SELECT c_custkey, n_name, r_name, CAST(coalesce(n, 0) AS BIGINT) AS orders, most, n IS NOT NULL AS has_orders
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN o ON o_custkey = c_custkey""",
)
def covariate_left_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Covariates tied to each customer; what is missing stays null and is flagged."""
    counts = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    joined = table(spark, folder, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey", "left").join(counts, "c_custkey", "left")
    return joined.select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("orders"), "most", F.col("n").isNotNull().alias("has_orders"))


@registry.add(
    "supplier_shares",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers,
    round(sum(l_quantity) / count(DISTINCT l_orderkey), 4) AS per_order FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY n_name""",
)
def supplier_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue of a period by the nation of the supplier; dates and columns reach the scan."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    lines = table(spark, folder, "lineitem").where((F.col("l_shipdate") >= day("1995-01-01")) & (F.col("l_shipdate") < day("1997-01-01")))
    joined = lines.join(table(spark, folder, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return joined.groupBy("n_name").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.round(F.sum("l_quantity") / F.count_distinct("l_orderkey"), 4).alias("per_order"),
    )


@registry.add(
    "order_histograms",
    """SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers
    FROM orders GROUP BY 1, 2""",
)
def order_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by category and year."""
    rows = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@registry.add(
    "group_medians",
    """WITH s AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_orderkey), o AS (SELECT n, row_number() OVER (ORDER BY n, l_orderkey) AS r, count(*) OVER () AS c FROM s)
    SELECT CAST((SELECT n FROM o WHERE r = c // 2 + 1) AS BIGINT) AS upper_median, round((SELECT avg(d) FROM s), 6) AS mean_distinct""",
)
def group_medians(spark: SparkSession, folder: str) -> DataFrame:
    """The upper median of the sizes of groups and the mean of their distinct members."""
    sizes = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("d"))
    # one row per size, so the running sum has as many rows as there are sizes
    counts = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.select("n", F.sum("c").over(Window.orderBy("n")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("all"))
    median = upto.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n").alias("upper_median"))
    return median.crossJoin(F.broadcast(sizes.agg(F.round(F.avg("d"), 6).alias("mean_distinct"))))  # one row each


@registry.add(
    "project_sectors",
    """WITH e AS (SELECT event_id, user_id, event_type, value, CAST(props->>'k' AS INTEGER) AS k FROM events WHERE event_type <> 'error'),
    c AS (SELECT *, CASE WHEN k < 25 THEN 'roads' WHEN k < 50 THEN 'water' WHEN k < 75 THEN 'culture' ELSE 'other' END AS sector FROM e)
    SELECT user_id, sector, CAST(count(*) AS BIGINT) AS projects, round(sum(value), 2) AS total, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds, list_sort(list(event_id))[1:3] AS samples
    FROM c GROUP BY user_id, sector""",
)
def project_sectors(spark: SparkSession, folder: str) -> DataFrame:
    """Events classified by a number in their JSON, with counts and the three first as samples."""
    rows = table(spark, folder, "events").where("event_type <> 'error'").withColumn("k", F.from_json("props", "k int")["k"])
    sector = F.when(F.col("k") < 25, "roads").when(F.col("k") < 50, "water").when(F.col("k") < 75, "culture").otherwise("other")
    rows = rows.withColumn("sector", sector)
    place = F.row_number().over(Window.partitionBy("user_id", "sector").orderBy("event_id"))
    samples = rows.select("user_id", "sector", "event_id", place.alias("r")).where("r <= 3").groupBy("user_id", "sector").agg(F.array_sort(F.collect_list("event_id")).alias("samples"))
    counts = rows.groupBy("user_id", "sector").agg(F.count(F.lit(1)).alias("projects"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("event_type").alias("kinds"))
    return counts.join(samples, ["user_id", "sector"])


@registry.add(
    "event_maps",
    """SELECT user_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
    CAST(count(DISTINCT event_type) AS INTEGER) AS kinds FROM events GROUP BY user_id""",
)
def event_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse counts by kind held in a map, and read from it."""
    counted = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    # a map entry for each kind of event
    maps = counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    at = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).cast("bigint")
    return maps.select("user_id", at("view").alias("views"), at("click").alias("clicks"), F.size("m").alias("kinds"))


@registry.add(
    "min_max_scale",
    """SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS scaled FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""",
)
def min_max_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Values between 0 and 1 by the least and the greatest of the table."""
    rows = table(spark, folder, "part")
    ends = rows.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).select("p_partkey", F.round((F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("scaled"))  # one row


_EDGES_SQL = """edges AS (SELECT DISTINCT least(a_katottg, b_katottg) AS a, greatest(a_katottg, b_katottg) AS b FROM known_curation_candidates
    WHERE a_katottg IS NOT NULL AND b_katottg IS NOT NULL AND a_katottg <> b_katottg)"""


@registry.add(
    "connected_components",
    f"""WITH RECURSIVE {_EDGES_SQL}, both_ways AS (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges),
    reach(node, root) AS (SELECT u, u FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.root)
    SELECT node, min(root) AS component FROM reach GROUP BY node""",
)
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    """The component of each node of the candidate graph."""
    return components(undirected(table(spark, folder, "known_curation_candidates"), "a_katottg", "b_katottg"))


@registry.add(
    "cliques3",
    """WITH e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM matching_edges13 WHERE a IS NOT NULL AND a <> b AND goals_cosine >= 0.5 AND NOT isnan(goals_cosine))
    SELECT p.a AS x, p.b AS y, q.b AS z FROM e p JOIN e q ON p.b = q.a JOIN e r ON r.a = p.a AND r.b = q.b""",
)
def cliques3(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of names that are all alike."""
    rows = table(spark, folder, "matching_edges13").where((F.col("goals_cosine") >= 0.5) & ~F.isnan("goals_cosine"))
    return triangles(undirected(rows, "a", "b"))


@registry.add(
    "degree_share",
    f"""WITH {_EDGES_SQL}, d AS (SELECT node, count(*) AS d FROM (SELECT unnest([a, b]) AS node FROM edges) GROUP BY node)
    SELECT CAST(least(d, 6) AS BIGINT) AS degree, CAST(count(*) AS BIGINT) AS nodes, round(count(*) / (SELECT count(*) FROM d)::DOUBLE, 4) AS share FROM d GROUP BY 1""",
)
def degree_share(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes by their number of neighbours, six and more together."""
    edges = undirected(table(spark, folder, "known_curation_candidates"), "a_katottg", "b_katottg")
    degrees = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    counted = degrees.groupBy(F.least("d", F.lit(6)).cast("bigint").alias("degree")).agg(F.count(F.lit(1)).alias("nodes"))
    return counted.select("degree", "nodes", F.round(F.col("nodes") / F.sum("nodes").over(Window.partitionBy()), 4).alias("share"))  # six rows


# Polygons by their corners; the second lies apart from the first, with a gap between them.
AREAS = (("west", ((-1.0, -1.0), (3.5, -1.0), (3.5, 4.0), (-1.0, 8.5))), ("south", ((4.0, -1.0), (9.0, -1.0), (4.0, 4.0))))
#: Side of a cell of the grid that points and polygons meet by.
CELL = 1.0
_RINGS_SQL = ", ".join(f"('{n}', {', '.join(map(str, a))}, {', '.join(map(str, b))})" for n, r in AREAS for a, b in zip(r, r[1:] + r[:1]))


@registry.add(
    "point_in_polygon",
    f"""WITH p AS (SELECT row_id, CAST(substr(katottg, 7, 4) AS DOUBLE) % 800 / 100 AS x, CAST(substr(katottg, 11, 4) AS DOUBLE) % 800 / 100 AS y FROM hromadas WHERE length(katottg) >= 14),
    edge(area, ax, ay, ex, ey) AS (SELECT * FROM (VALUES {_RINGS_SQL}) v),
    met AS (SELECT row_id, area, sum(CASE WHEN (ay > y) <> (ey > y) AND x < (ex - ax) * (y - ay) / (ey - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside,
      min(sqrt(pow(x - ax - greatest(0, least(1, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / (pow(ex - ax, 2) + pow(ey - ay, 2)))) * (ex - ax), 2)
        + pow(y - ay - greatest(0, least(1, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / (pow(ex - ax, 2) + pow(ey - ay, 2)))) * (ey - ay), 2))) AS away FROM p, edge GROUP BY row_id, area)
    SELECT row_id, min_by(area, (CASE WHEN inside THEN 0 ELSE round(away, 9) END, area)) AS area, CASE WHEN bool_or(inside) THEN 'inside' ELSE 'nearest' END AS how FROM met GROUP BY row_id""",
)
def point_in_polygon(spark: SparkSession, folder: str) -> DataFrame:
    """The polygon that holds each point, else the nearest one.

    Points meet polygons by the cells of a grid; only those that no cell settles are
    measured against all edges of the polygons, which are few and given here.  A point on
    an edge counts by the rule of crossings.
    """
    code = F.col("katottg")
    points = table(spark, folder, "hromadas").where(F.length(code) >= 14).select(
        "row_id", (F.substring(code, 7, 4).cast("double") % 800 / 100).alias("x"), (F.substring(code, 11, 4).cast("double") % 800 / 100).alias("y")
    )
    areas = spark.createDataFrame([(n, [dict(x=x, y=y) for x, y in r]) for n, r in AREAS], "area string, ring array<struct<x:double,y:double>>")
    return nearest_area(points, areas, "row_id")


def nearest_area(points: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """(key, area, how): for each point (key, x, y) the polygon (area, ring) that holds it, or the nearest; the first by name if several."""
    cell = lambda c: F.floor(c / CELL).cast("int")
    ends = {f"{e}{c}": f(F.col("ring")[c]) for c in "xy" for e, f in (("low_", F.array_min), ("high_", F.array_max))}
    boxed = areas.withColumns(ends)
    spread = lambda c: F.explode(F.sequence(cell(F.col(f"low_{c}")), cell(F.col(f"high_{c}"))))
    gridded = boxed.withColumn("cx", spread("x")).withColumn("cy", spread("y")).select("area", "ring", "cx", "cy")
    placed = points.withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))})
    inside = placed.join(gridded, ["cx", "cy"]).where(G.in_ring(F.col("x"), F.col("y"), F.col("ring"))).groupBy(key).agg(F.min("area").alias("area"))
    left = points.join(inside.select(key), key, "left_anti")
    edges = areas.select("area", F.posexplode("ring").alias("at", "a"), "ring").select("area", "a", F.element_at("ring", ((F.col("at") + 1) % F.size("ring") + 1).cast("int")).alias("b"))
    away = G.from_segment(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    # the edges of all polygons are one array in one row
    every = edges.agg(F.collect_list(F.struct("area", "a", "b")).alias("edges"))
    near = left.crossJoin(F.broadcast(every)).select(key, "x", "y", F.explode("edges").alias("e")).select(key, "x", "y", "e.*")
    nearest = near.withColumn("away", F.round(away, 9)).groupBy(key).agg(F.min(F.struct("away", "area")).alias("m")).select(key, "m.area")
    return inside.withColumn("how", F.lit("inside")).unionByName(nearest.withColumn("how", F.lit("nearest")))
