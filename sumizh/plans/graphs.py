"""Queries over graphs: components for a layout, cliques, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.operators.graph import cliques4, components, maximal, triangles
from sumizh.operators.ranking import global_rank
from sumizh.plans.entities import latest_entities, undirected
from sumizh.plans.registry import registry
from sumizh.sources.tables import table

#: Neighbours that a node of the layout has at least, and nodes beyond which no further component is taken.
DEGREE, NODES = 2, 70
#: Similarity from which two names are joined in a clique.
LIKE = 0.5

_EDGES_SQL = """edges AS (SELECT DISTINCT least(a_katottg, b_katottg) AS a, greatest(a_katottg, b_katottg) AS b FROM known_curation_candidates
    WHERE a_katottg IS NOT NULL AND b_katottg IS NOT NULL AND a_katottg <> b_katottg)"""


@registry.add(
    "layout_components",
    f"""WITH RECURSIVE {_EDGES_SQL}, d AS (SELECT node, count(*) AS d FROM (SELECT unnest([a, b]) AS node FROM edges) GROUP BY node),
    kept AS (SELECT a, b FROM edges JOIN d x ON x.node = a JOIN d y ON y.node = b WHERE x.d >= {DEGREE} AND y.d >= {DEGREE}),
    both_ways AS (SELECT a AS u, b AS v FROM kept UNION ALL SELECT b, a FROM kept), reach(node, root) AS (SELECT u, u FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.root),
    c AS (SELECT node, min(root) AS component FROM reach GROUP BY node), s AS (SELECT component, count(*) AS n FROM c GROUP BY component),
    o AS (SELECT component, n, coalesce(sum(n) OVER (ORDER BY n DESC, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sooner FROM s)
    SELECT node, component, CAST(n AS BIGINT) AS size FROM c JOIN o USING (component) WHERE sooner <= {NODES}""",
)
def layout_components(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the components of well-linked nodes, the largest components first until there are more than seventy nodes."""
    edges = undirected(table(spark, folder, "known_curation_candidates"), "a_katottg", "b_katottg")
    degrees = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= DEGREE).select("node")
    kept = edges.join(degrees.withColumnRenamed("node", "a"), "a", "left_semi").join(degrees.withColumnRenamed("node", "b"), "b", "left_semi")
    found = components(kept)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # of all components no more than a hundred can be among the first of more than seventy nodes, as each has a node at least
    largest = sizes.orderBy(F.desc("size"), "component").limit(NODES + 1)
    sooner = F.coalesce(F.sum("size").over(Window.orderBy(F.desc("size"), "component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = largest.withColumn("sooner", sooner).where(F.col("sooner") <= NODES).select("component", "size")
    return found.join(F.broadcast(chosen), "component").select("node", "component", "size")  # seventy-one rows at most


_CLIQUES_SQL = f"""rated AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(goals_cosine) AS v FROM matching_edges13 WHERE a IS NOT NULL AND a <> b AND goals_cosine >= {LIKE} AND NOT isnan(goals_cosine) GROUP BY 1, 2),
    t AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM rated p JOIN rated q ON p.b = q.a JOIN rated r ON r.a = p.a AND r.b = q.b),
    f AS (SELECT t.x, t.y, t.z, e.b AS w FROM t JOIN rated e ON e.a = t.z JOIN rated g ON g.a = t.x AND g.b = e.b JOIN rated h ON h.a = t.y AND h.b = e.b),
    inside AS (SELECT DISTINCT unnest([[x, y, z], [x, y, w], [x, z, w], [y, z, w]]) AS m FROM f),
    cliques AS (SELECT [x, y, z, w] AS members FROM f UNION ALL SELECT [x, y, z] FROM t WHERE [x, y, z] NOT IN (SELECT m FROM inside))"""


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "matching_edges13").where((F.col("goals_cosine") >= LIKE) & ~F.isnan("goals_cosine") & (F.col("a") != F.col("b")) & (F.col("a") != "") & (F.col("b") != ""))
    return rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("goals_cosine").alias("v"))


def _cliques(edges: DataFrame) -> DataFrame:
    three = triangles(edges.select("a", "b"))
    return maximal(three, cliques4(three, edges.select("a", "b")))


@registry.add("maximal_cliques", f"WITH {_CLIQUES_SQL} SELECT members, CAST(len(members) AS INTEGER) AS size FROM cliques")
def maximal_cliques(spark: SparkSession, folder: str) -> DataFrame:
    """Cliques of four names that are all alike, and those of three that are in none of four."""
    return _cliques(_rated(spark, folder)).select("members", F.size("members").alias("size"))


@registry.add(
    "clique_means",
    f"""WITH {_CLIQUES_SQL}, pairs AS (SELECT members, members[i] AS a, members[j] AS b FROM (SELECT members, unnest(range(1, 5)) AS i FROM cliques), (SELECT unnest(range(2, 5)) AS j) WHERE i < j AND j <= len(members))
    SELECT array_to_string(members, '|') AS clique, round(avg(v), 6) AS mean FROM pairs JOIN rated USING (a, b) GROUP BY members""",
)
def clique_means(spark: SparkSession, folder: str) -> DataFrame:
    """The mean similarity of the pairs within each clique."""
    rated = _rated(spark, folder)
    members = _cliques(rated).select("members", F.explode("members").alias("a"))
    pairs = members.select("members", "a", F.explode("members").alias("b")).where("a < b")
    return pairs.join(rated, ["a", "b"]).groupBy(F.array_join("members", "|").alias("clique")).agg(F.round(F.avg("v"), 6).alias("mean"))


@registry.add(
    "region_lift",
    """WITH e AS (SELECT cand_id, a_katottg, b_katottg, oblast_a, oblast_b FROM known_curation_candidates WHERE a_katottg IS NOT NULL AND b_katottg IS NOT NULL),
    s AS (SELECT count(*) AS n, count(*) FILTER (substr(a_katottg, 1, 6) = substr(b_katottg, 1, 6)) AS basin, count(*) FILTER (oblast_a = oblast_b) AS region FROM e)
    SELECT CAST(n AS BIGINT) AS pairs, round(100.0::DOUBLE * basin / n, 2) AS basin_share, round(100.0::DOUBLE * region / n, 2) AS region_share, round(100.0::DOUBLE * basin / n - 100.0::DOUBLE * region / n, 2) AS lift_points FROM s""",
)
def region_lift(spark: SparkSession, folder: str) -> DataFrame:
    """By how many points more pairs lie within one of the smaller areas than within one region."""
    rows = table(spark, folder, "known_curation_candidates").where("a_katottg IS NOT NULL AND b_katottg IS NOT NULL")
    basin, region = F.count_if(F.substring("a_katottg", 1, 6) == F.substring("b_katottg", 1, 6)), F.count_if(F.col("oblast_a") == F.col("oblast_b"))
    counts = rows.agg(F.count(F.lit(1)).alias("pairs"), basin.alias("basin"), region.alias("region"))
    share = lambda c: 100.0 * F.col(c) / F.col("pairs")
    return counts.select("pairs", F.round(share("basin"), 2).alias("basin_share"), F.round(share("region"), 2).alias("region_share"), F.round(share("basin") - share("region"), 2).alias("lift_points"))


#: Entities of the first release, for which the number of places asked for was set.
BASE_PAIRS = 4950


@registry.add(
    "scaled_places",
    f"""WITH n AS (SELECT count(DISTINCT katottg) AS n FROM hromadas), p AS (SELECT CAST(n * (n - 1) / 2 AS BIGINT) AS pairs FROM n) SELECT base, pairs, CAST(greatest(base, round_even(base * pairs / {BASE_PAIRS}::DOUBLE, 0)) AS BIGINT) AS places FROM p, (SELECT unnest([10, 50, 100]) AS base)""",
)
def scaled_places(spark: SparkSession, folder: str) -> DataFrame:
    """How many places a known pair may be down, in proportion to the number of all pairs."""
    n = table(spark, folder, "hromadas").agg(F.count_distinct("katottg").alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))
    places = F.greatest(F.col("base"), F.rint(F.col("base") * F.col("pairs") / BASE_PAIRS).cast("bigint"))
    return n.select(F.explode(F.array(*(F.lit(b) for b in (10, 50, 100)))).alias("base"), "pairs").select("base", "pairs", places.alias("places"))


@registry.add(
    "site_order",
    """WITH h AS (SELECT katottg, name, population FROM hromadas QUALIFY row_number() OVER (PARTITION BY katottg ORDER BY loaded_at DESC, row_id DESC) = 1),
    p AS (SELECT a_katottg AS katottg, count(*) AS projects FROM known_curation_candidates WHERE a_katottg IS NOT NULL GROUP BY 1)
    SELECT katottg, CAST(coalesce(projects, 0) AS BIGINT) AS projects, CAST(row_number() OVER (ORDER BY coalesce(projects, 0) DESC, coalesce(population, 0) DESC, name, katottg) AS BIGINT) AS place FROM h LEFT JOIN p USING (katottg)""",
)
def site_order(spark: SparkSession, folder: str) -> DataFrame:
    """All entities with their place by projects, then size, then name."""
    projects = table(spark, folder, "known_curation_candidates").where("a_katottg IS NOT NULL").groupBy(F.col("a_katottg").alias("katottg")).agg(F.count(F.lit(1)).alias("projects"))
    rows = latest_entities(spark, folder, "name", "population").join(projects, "katottg", "left").fillna(0, ["projects", "population"])
    return global_rank(rows, [F.desc("projects"), F.desc("population"), F.asc("name"), F.asc("katottg")], "place").select("katottg", "projects", "place")
