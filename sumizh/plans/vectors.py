"""Queries over vectors: searches, centring, document frequency, alignment of owners.

A search takes as queries every vector whose id is divisible by 100, against all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumizh.functions import vectors as V
from sumizh.operators.alignment import owner_similarity, sharing_owners, weight_of
from sumizh.plans.registry import registry
from sumizh.sources.tables import table

TOP = 10
#: A line counts as shared from this similarity on.
SHARED = 0.2

_COSINE = "round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6)"


@registry.add(
    "pairwise_cosine_topk",
    f"""SELECT query, id, similarity, CAST(place AS INTEGER) AS place FROM (
      SELECT q.vec_id AS query, r.vec_id AS id, {_COSINE} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, r.vec_id) AS place
      FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id) WHERE place <= {TOP}""",
)
def pairwise_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors most like each query."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return V.search(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", TOP)


_CENTRED_SQL = """mean AS (SELECT pos, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos),
    means AS (SELECT list(m ORDER BY pos) AS m FROM mean),
    centred AS (SELECT vec_id, list_transform(list_zip(embedding, m), lambda z: z[1]::DOUBLE - z[2]) AS embedding FROM embeddings, means)"""


@registry.add(
    "mean_centered_pairs",
    f"""WITH {_CENTRED_SQL} SELECT query, id, similarity, CAST(place AS INTEGER) AS place FROM (
      SELECT q.vec_id AS query, r.vec_id AS id, {_COSINE} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, r.vec_id) AS place
      FROM centred q JOIN centred r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id) WHERE place <= {TOP}""",
)
def mean_centered_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """As above, after the mean of all vectors is taken off."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    centred = rows.crossJoin(F.broadcast(V.mean_vector(rows, "embedding"))).select(  # one row
        "vec_id", F.zip_with("embedding", "mean", lambda x, m: x.cast("double") - m).alias("embedding")
    )
    return V.search(centred.where("vec_id % 100 = 0"), centred, "vec_id", "embedding", TOP)


@registry.add(
    "doc_frequency_weight",
    f"""SELECT q.vec_id AS query, CAST(count(DISTINCT r.label) FILTER ({_COSINE} >= {SHARED} AND r.label <> q.label) AS BIGINT) AS df,
    round(1 / (1 + ln(1 + greatest(count(DISTINCT r.label) FILTER ({_COSINE} >= {SHARED} AND r.label <> q.label) - 2, 0))), 6) AS weight
    FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id GROUP BY q.vec_id""",
)
def doc_frequency_weight(spark: SparkSession, folder: str) -> DataFrame:
    """How many other owners have a line like each query, and the weight that follows."""
    lines = _lines(table(spark, folder, "embeddings"))
    queries = lines.where("id % 100 = 0")
    counted = queries.select("id").join(sharing_owners(queries, lines, SHARED), "id", "left").select(F.col("id").alias("query"), F.coalesce("df", F.lit(0)).alias("df"))
    return counted.withColumn("weight", F.round(weight_of(F.col("df")), 6))


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").alias("id"), F.col("label").alias("owner"), F.col("embedding").alias("v"))


# Parts of the operational and the strategic lines where both owners have both.
OPERATIONAL, STRATEGIC = 0.65, 0.35


def _aligned_sql(name: str, condition: str) -> str:
    """The similarity of every two owners over the lines that a condition keeps, as tables ending in ``name``."""
    cosine = "list_cosine_similarity(p.v, q.v)"
    return f"""{name}_raw AS (SELECT vec_id AS id, label AS owner, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE {condition}),
    {name}_mean AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {name}_raw) GROUP BY pos)),
    {name}_off AS (SELECT id, owner, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS v FROM {name}_raw, {name}_mean),
    {name}_unit AS (SELECT id, owner, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) AS v FROM {name}_off),
    {name}_df AS (SELECT p.id, count(DISTINCT q.owner) AS df FROM {name}_raw p JOIN {name}_raw q ON p.owner <> q.owner AND round({cosine}, 6) >= 0.9 GROUP BY p.id),
    {name}_w AS (SELECT u.*, 1 / (1 + ln(1 + greatest(coalesce(df, 0) - 2, 0))) AS w FROM {name}_unit u LEFT JOIN {name}_df USING (id)),
    {name}_n AS (SELECT owner, count(*) AS n FROM {name}_raw GROUP BY owner),
    {name}_best AS (SELECT p.id, p.owner, q.owner AS other, any_value(p.w) AS w, max(list_dot_product(p.v, q.v)) AS best FROM {name}_w p JOIN {name}_w q ON p.owner <> q.owner GROUP BY 1, 2, 3),
    {name}_top AS (SELECT b.*, row_number() OVER (PARTITION BY b.owner, other ORDER BY round(best, 9) DESC, id) AS r, least(x.n, y.n) AS k FROM {name}_best b JOIN {name}_n x ON x.owner = b.owner JOIN {name}_n y ON y.owner = other),
    {name}_side AS (SELECT owner, other, sum(best * w) / sum(w) AS aligned FROM {name}_top WHERE r <= k GROUP BY 1, 2),
    {name}_pair AS (SELECT least(owner, other) AS a, greatest(owner, other) AS b, avg(aligned) AS aligned FROM {name}_side GROUP BY 1, 2),
    {name}_mid AS (SELECT owner, list(x ORDER BY pos) AS v FROM (SELECT owner, pos, sum(x * w) / sum(w) AS x FROM (SELECT owner, w, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {name}_w) GROUP BY 1, 2) GROUP BY 1),
    {name} AS (SELECT a, b, round(greatest(0, 0.65 * aligned + 0.35 * list_cosine_similarity(x.v, y.v)), 6) AS similarity FROM {name}_pair JOIN {name}_mid x ON x.owner = a JOIN {name}_mid y ON y.owner = b)"""


@registry.add("owner_blend", f"WITH {_aligned_sql('whole', 'TRUE')} SELECT * FROM whole")
def owner_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of all owners (labels) by their centred lines, weighted by how few owners share them, and centroids."""
    return owner_similarity(_lines(table(spark, folder, "embeddings")))


@registry.add(
    "goals_similarity",
    f"""WITH {_aligned_sql("whole", "TRUE")}, {_aligned_sql("ops", "vec_id % 3 = 0 AND label <> 9")}, {_aligned_sql("strat", "vec_id % 3 = 1 AND label <> 8")}
    SELECT w.a, w.b, CASE WHEN o.a IS NOT NULL AND s.a IS NOT NULL THEN round(0.65 * o.similarity + 0.35 * s.similarity, 6) WHEN o.a IS NOT NULL THEN o.similarity ELSE w.similarity END AS similarity,
    CASE WHEN o.a IS NOT NULL AND s.a IS NOT NULL THEN 'both' WHEN o.a IS NOT NULL THEN 'operational' ELSE 'all' END AS lines
    FROM whole w LEFT JOIN ops o USING (a, b) LEFT JOIN strat s USING (a, b)""",
)
def goals_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of owners by their operational and strategic lines where both have both, else by operational or by all.

    The vectors have no kind of line; every third is taken as operational, every third as
    strategic, and two owners lack one kind each.
    """
    rows = table(spark, folder, "embeddings")
    return line_kinds_blend(_lines(rows), _lines(rows.where("vec_id % 3 = 0 AND label <> 9")), _lines(rows.where("vec_id % 3 = 1 AND label <> 8")))


def line_kinds_blend(every: DataFrame, operational: DataFrame, strategic: DataFrame) -> DataFrame:
    """(a, b, similarity, lines) of every two owners of ``every``, from three sets of lines (id, owner, v)."""
    ops = owner_similarity(operational).withColumnRenamed("similarity", "ops")
    strat = owner_similarity(strategic).withColumnRenamed("similarity", "strat")
    joined = owner_similarity(every).join(ops, ["a", "b"], "left").join(strat, ["a", "b"], "left")
    has_ops, has_strat = F.col("ops").isNotNull(), F.col("strat").isNotNull()
    both = F.round(OPERATIONAL * F.col("ops") + STRATEGIC * F.col("strat"), 6)
    return joined.select(
        "a", "b", F.when(has_ops & has_strat, both).otherwise(F.coalesce("ops", "similarity")).alias("similarity"),
        F.when(has_ops & has_strat, "both").when(has_ops, "operational").otherwise("all").alias("lines"),
    )


@registry.add(
    "owner_distinctness",
    f"""WITH {_aligned_sql('whole', 'TRUE')}, ends AS (SELECT a AS owner, similarity FROM whole UNION ALL SELECT b, similarity FROM whole)
    SELECT owner, round(avg(similarity), 6) AS mean_similarity, CAST(count(*) AS BIGINT) AS others FROM ends GROUP BY owner""",
)
def owner_distinctness(spark: SparkSession, folder: str) -> DataFrame:
    """The mean similarity of each owner to all others; the lower, the more distinct."""
    ends = owner_blend(spark, folder).select(F.explode(F.array("a", "b")).alias("owner"), "similarity")
    return ends.groupBy("owner").agg(F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.count(F.lit(1)).alias("others"))


@registry.add(
    "owner_centroids",
    """WITH n AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len, embedding FROM embeddings)
    SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (
      SELECT label, unnest(embedding)::DOUBLE / len AS x, generate_subscripts(embedding, 1) AS pos FROM n) GROUP BY label, pos""",
)
def owner_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of the unit vectors of each owner, by position."""
    units = table(spark, folder, "embeddings").select("label", F.posexplode(V.unit(F.col("embedding"))).alias("at", "x"))
    return units.groupBy("label", (F.col("at") + 1).alias("pos")).agg(F.round(F.avg("x"), 6).alias("mean"))
