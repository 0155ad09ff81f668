"""Queries over pairs: filters, flags, covariates, scores, tracks, slices, merges, recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.functions import geo as G
from sumizh.functions import text as X
from sumizh.operators.ranking import first_of, global_rank, nearest_rank
from sumizh.plans.entities import LATEST_SQL, latest_entities, undirected
from sumizh.plans.registry import registry
from sumizh.sources.tables import table

#: Places of a slice, and of a sidecar slice.
SLICE, SIDECAR = 50, 40
#: A pair is near from this score on, and far up to that one.
NEAR, FAR = 0.85, 0.35

_LATEST_EDGES_SQL = """edges AS (SELECT * FROM matching_edges13 WHERE a IS NOT NULL AND a <> b
    QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY loaded_at DESC, edge_id DESC) = 1)"""


def latest_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The last delivery of each unordered pair; loops and pairs without an end are left out."""
    rows = table(spark, folder, "matching_edges13").where("a IS NOT NULL AND a <> b")
    rows = rows.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    return first_of(rows, ["x", "y"], [("loaded_at", True), ("edge_id", True)], ["edge_id", "a", "b", "sector_jaccard", "goals_cosine", "same_oblast", "known"])


@registry.add("edge_latest", f"WITH {_LATEST_EDGES_SQL} SELECT edge_id, a, b, sector_jaccard, CASE WHEN isnan(goals_cosine) THEN NULL ELSE goals_cosine END AS goals_cosine FROM edges")
def edge_latest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each unordered pair; what is no number is null."""
    return latest_edges(spark, folder).select("edge_id", "a", "b", "sector_jaccard", F.when(~F.isnan("goals_cosine"), F.col("goals_cosine")).alias("goals_cosine"))


@registry.add(
    "known_pairs",
    f"""WITH {_LATEST_EDGES_SQL}, kp AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM known_curation_candidates)
    SELECT edge_id, kp.x IS NOT NULL AS curated, CASE WHEN coalesce(known, FALSE) THEN 'registry_known' ELSE 'hypothesis' END AS state
    FROM edges LEFT JOIN kp ON kp.x = least(a, b) AND kp.y = greatest(a, b)""",
)
def known_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Is a pair among the curated ones, in either order?"""
    curated = undirected(table(spark, folder, "known_curation_candidates"), "a", "b").select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(True).alias("hit"))
    state = F.when(F.coalesce("known", F.lit(False)), "registry_known").otherwise("hypothesis")
    return latest_edges(spark, folder).join(curated, ["x", "y"], "left").select("edge_id", F.col("hit").isNotNull().alias("curated"), state.alias("state"))


@registry.add(
    "pair_difference",
    f"""WITH {_LATEST_EDGES_SQL} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM known_curation_candidates WHERE a <> b
    EXCEPT SELECT least(a, b), greatest(a, b) FROM edges""",
)
def pair_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Curated pairs that have no edge."""
    curated = undirected(table(spark, folder, "known_curation_candidates"), "a", "b")
    return curated.join(latest_edges(spark, folder).select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti")


@registry.add(
    "homonym_filter",
    """SELECT cand_id FROM known_curation_candidates WHERE NOT coalesce(a_katottg = b_katottg, FALSE)
    AND NOT (a_katottg IS NOT NULL AND b_katottg IS NOT NULL AND (a = b OR split_part(trim(a), ' ', 1) = split_part(trim(b), ' ', 1)))""",
)
def homonym_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs without those of one code, and those of one name under two codes; a missing code keeps a pair."""
    a, b = F.col("a_katottg"), F.col("b_katottg")
    same_word = X.first_word(F.col("a")) == X.first_word(F.col("b"))
    namesakes = a.isNotNull() & b.isNotNull() & ((F.col("a") == F.col("b")) | same_word)
    return table(spark, folder, "known_curation_candidates").where(~F.coalesce(a == b, F.lit(False)) & ~namesakes).select("cand_id")


_PLACE_SQL = "44 + (CAST(substr(k, 7, 4) AS DOUBLE) % 800) / 100"


def _degrees(code: Column, start: int, least: float, spread: int) -> Column:
    """A coordinate made of four digits of a code, as the tables have none."""
    return least + F.substring(code, start, 4).cast("double") % spread / 100


@registry.add(
    "geo_ladder",
    """WITH p AS (SELECT cand_id, oblast_a = oblast_b AS same_region, substr(a_katottg, 1, 6) = substr(b_katottg, 1, 6) AS same_district,
      44 + CAST(substr(a_katottg, 7, 4) AS DOUBLE) % 800 / 100 AS la, 22 + CAST(substr(a_katottg, 11, 4) AS DOUBLE) % 1800 / 100 AS oa,
      44 + CAST(substr(b_katottg, 7, 4) AS DOUBLE) % 800 / 100 AS lb, 22 + CAST(substr(b_katottg, 11, 4) AS DOUBLE) % 1800 / 100 AS ob FROM known_curation_candidates),
    d AS (SELECT *, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(ob - oa) / 2), 2), 1.0))) AS km FROM p)
    SELECT cand_id, round(km, 3) AS km, CAST(CASE WHEN km IS NULL THEN CASE WHEN same_district THEN 0.7 WHEN same_region THEN 0.4 ELSE 0.0 END
      WHEN km <= 15 THEN 1.0 WHEN km <= 40 THEN 0.85 WHEN km <= 80 THEN 0.6 WHEN km <= 150 THEN 0.35
      WHEN same_district THEN 0.75 WHEN same_region THEN 0.45 ELSE 0.0 END AS DOUBLE) AS geo FROM d""",
)
def geo_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of the ends of a pair, and the score of the ladder."""
    a, b = F.col("a_katottg"), F.col("b_katottg")
    km = G.haversine_km(_degrees(a, 7, 44, 800), _degrees(a, 11, 22, 1800), _degrees(b, 7, 44, 800), _degrees(b, 11, 22, 1800))
    rows = table(spark, folder, "known_curation_candidates").withColumn("km", km)
    same_district = F.substring(a, 1, 6) == F.substring(b, 1, 6)
    score = G.distance_score(F.col("km"), same_district, F.col("oblast_a") == F.col("oblast_b"))
    return rows.select("cand_id", F.round("km", 3).alias("km"), score.alias("geo"))


@registry.add(
    "combined_score",
    f"""WITH {_LATEST_EDGES_SQL}, kp AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM known_curation_candidates)
    SELECT edge_id, CASE WHEN kp.x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS network,
    round(0.6::DOUBLE * goals_cosine + 0.25::DOUBLE * same_oblast::INT + 0.15::DOUBLE * (kp.x IS NOT NULL)::INT, 3) AS score
    FROM edges LEFT JOIN kp ON kp.x = least(a, b) AND kp.y = greatest(a, b) WHERE goals_cosine IS NOT NULL AND NOT isnan(goals_cosine)""",
)
def combined_score(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted sum of text, place and network; the network counts where the pair is curated."""
    curated = undirected(table(spark, folder, "known_curation_candidates"), "a", "b").select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("hit"))
    rows = latest_edges(spark, folder).where(F.col("goals_cosine").isNotNull() & ~F.isnan("goals_cosine")).join(curated, ["x", "y"], "left")
    network = F.coalesce("hit", F.lit(0.0))
    score = 0.6 * F.col("goals_cosine") + 0.25 * F.col("same_oblast").cast("int") + 0.15 * network
    return rows.select("edge_id", network.alias("network"), F.round(score, 3).alias("score"))


_FLOOR_SQL = """ordered AS (SELECT coalesce(goals_cosine, 0) AS v, row_number() OVER (ORDER BY coalesce(goals_cosine, 0)) AS rn, count(*) OVER () AS n FROM known_curation_candidates WHERE NOT isnan(coalesce(goals_cosine, 0))),
    floor_value AS (SELECT v AS fl FROM ordered WHERE rn = least(greatest(CAST(round_even(0.9 * n, 0) AS BIGINT), 1), n))"""
_TRACK_SQL = f"""CASE WHEN goals_cosine >= fl AND geo_score <= {FAR} THEN 'thematic' WHEN geo_score >= {NEAR} THEN 'operational' ELSE 'mixed' END"""


def tracked(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the track that the 90th nearest-rank percentile and the distance give."""
    rows = table(spark, folder, "known_curation_candidates")
    floor = nearest_rank(rows.withColumn("goals_cosine", F.coalesce("goals_cosine", F.lit(0.0))), "goals_cosine", 90.0).withColumnRenamed("value", "floor")
    track = F.when((F.col("goals_cosine") >= F.col("floor")) & (F.col("geo_score") <= FAR), "thematic").when(F.col("geo_score") >= NEAR, "operational").otherwise("mixed")
    return rows.drop("track").crossJoin(F.broadcast(floor)).withColumn("track", track)  # one row


@registry.add("dual_track", f"WITH {_FLOOR_SQL} SELECT cand_id, fl AS floor, {_TRACK_SQL} AS track FROM known_curation_candidates, floor_value")
def dual_track(spark: SparkSession, folder: str) -> DataFrame:
    """The track of each candidate."""
    return tracked(spark, folder).select("cand_id", "floor", "track")


@registry.add(
    "track_counts",
    f"""WITH {_FLOOR_SQL} SELECT {_TRACK_SQL} AS track, CAST(count(*) AS BIGINT) AS n, round(avg(goals_cosine), 6) AS mean_goals, max(geo_score) AS most_geo
    FROM known_curation_candidates, floor_value GROUP BY 1""",
)
def track_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = tracked(spark, folder).groupBy("track")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("goals_cosine"), 6).alias("mean_goals"), F.max("geo_score").alias("most_geo"))


@registry.add(
    "thematic_slice",
    f"WITH {_FLOOR_SQL} SELECT cand_id, goals_cosine, score FROM known_curation_candidates, floor_value WHERE {_TRACK_SQL} = 'thematic' AND status <> 'known' ORDER BY goals_cosine DESC, score DESC, cand_id LIMIT {SLICE}",
)
def thematic_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The thematic candidates that aren't known, most alike first."""
    rows = tracked(spark, folder).where("track = 'thematic' AND status <> 'known'").orderBy(F.desc("goals_cosine"), F.desc("score"), "cand_id").limit(SLICE)
    return rows.select("cand_id", "goals_cosine", "score")


LINKED_SQL = """linked AS (SELECT DISTINCT least(katottg, code) AS x, greatest(katottg, code) AS y FROM (
      SELECT katottg, unnest(corpusneighbourcodes) AS code FROM corpus_growth_priority WHERE katottg IS NOT NULL) WHERE katottg <> code AND katottg <> '' AND code <> '')"""


def linked(spark: SparkSession, folder: str) -> DataFrame:
    """(x, y), x < y, of the codes that the network of neighbours links."""
    ends = table(spark, folder, "corpus_growth_priority").select("katottg", F.explode("corpusneighbourcodes").alias("code"))
    return undirected(ends, "katottg", "code").select(F.col("a").alias("x"), F.col("b").alias("y"))


_FISCAL_SQL = "CASE WHEN pa > 0 AND pb > 0 THEN greatest(0.0, 1 - log10(greatest(pa, pb)::DOUBLE / least(pa, pb))) END"


def _with_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the population and the sectors of both ends, by code."""
    ends = latest_entities(spark, folder, "population", "sectors")
    side = lambda s: ends.select(F.col("katottg").alias(f"{s}_katottg"), F.col("population").alias(f"p{s}"), F.col("sectors").alias(f"s{s}"))
    return table(spark, folder, "known_curation_candidates").join(side("a"), "a_katottg", "left").join(side("b"), "b_katottg", "left")


def size_similarity(a: Column, b: Column) -> Column:
    """1 for equal sizes, 0 from ten times on; null if one is missing or not positive."""
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - F.log10(F.greatest(a, b).cast("double") / F.least(a, b))))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; null if either side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


_SIZES_SQL = f"""WITH {LATEST_SQL}, ends AS (SELECT c.*, x.population AS pa, y.population AS pb, x.sectors AS sa, y.sectors AS sb
    FROM known_curation_candidates c LEFT JOIN latest x ON x.katottg = a_katottg LEFT JOIN latest y ON y.katottg = b_katottg),
    parts AS (SELECT *, {_FISCAL_SQL} AS sizes, CASE WHEN len(sa) > 0 AND len(sb) > 0 THEN len(list_intersect(sa, sb)) / len(list_distinct(sa || sb))::DOUBLE END AS shared FROM ends)"""


@registry.add("fiscal_similarity", f"{_SIZES_SQL} SELECT cand_id, round(sizes, 6) AS sizes FROM parts")
def fiscal_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """How near the populations of the ends are, on a logarithmic scale."""
    return _with_sizes(spark, folder).select("cand_id", F.round(size_similarity(F.col("pa"), F.col("pb")), 6).alias("sizes"))


@registry.add("sector_jaccard", f"{_SIZES_SQL} SELECT cand_id, round(shared, 6) AS shared, round(coalesce(shared, 0), 6) AS shared_or_zero FROM parts")
def sector_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Shared sectors of the ends, null where an end has none, and with 0 instead."""
    shared = jaccard(F.col("sa"), F.col("sb"))
    return _with_sizes(spark, folder).select("cand_id", F.round(shared, 6).alias("shared"), F.round(F.coalesce(shared, F.lit(0.0)), 6).alias("shared_or_zero"))


_OPERATIONAL_SQL = f"""CASE WHEN geo_score >= {NEAR} THEN round((0.55::DOUBLE * geo_score + coalesce(0.25::DOUBLE * sizes, 0) + coalesce(0.2::DOUBLE * shared, 0))
    / (0.55::DOUBLE + CASE WHEN sizes IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN shared IS NULL THEN 0 ELSE 0.2::DOUBLE END), 3) END"""


def operational(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the score of the near ones; parts that are missing leave their weight to the others."""
    sizes, shared = size_similarity(F.col("pa"), F.col("pb")), jaccard(F.col("sa"), F.col("sb"))
    rows = _with_sizes(spark, folder).withColumns({"sizes": sizes, "shared": shared})
    return rows.withColumn("operational_score", near_score(F.col("geo_score"), F.col("sizes"), F.col("shared")))


# Weights of place, size and shared sectors in the score of near pairs.
PLACE, SIZES, SECTORS = 0.55, 0.25, 0.2


def near_score(geo: Column, sizes: Column, shared: Column) -> Column:
    """The score of a near pair, to three digits; null for one that isn't near."""
    part = lambda c, w: F.coalesce(F.lit(w) * c, F.lit(0.0))
    weight = lambda c, w: F.when(c.isNull(), 0.0).otherwise(w)
    score = (PLACE * geo + part(sizes, SIZES) + part(shared, SECTORS)) / (PLACE + weight(sizes, SIZES) + weight(shared, SECTORS))
    return F.when(geo >= NEAR, F.round(score, 3))


@registry.add("operational_score", f"{_SIZES_SQL} SELECT cand_id, {_OPERATIONAL_SQL} AS operational_score FROM parts")
def operational_score(spark: SparkSession, folder: str) -> DataFrame:
    return operational(spark, folder).select("cand_id", "operational_score")


@registry.add(
    "operational_slice",
    f"""{_SIZES_SQL}, scored AS (SELECT *, {_OPERATIONAL_SQL} AS op FROM parts), {LINKED_SQL}
    SELECT cand_id, op AS operational_score, geo_score FROM scored WHERE geo_score >= {NEAR} AND status <> 'known'
    AND NOT EXISTS (SELECT 1 FROM linked WHERE x = least(a_katottg, b_katottg) AND y = greatest(a_katottg, b_katottg))
    ORDER BY coalesce(op, score) DESC, geo_score DESC, cand_id LIMIT {SLICE}""",
)
def operational_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The best near candidates that are neither known nor linked in the network."""
    near = operational(spark, folder).where((F.col("geo_score") >= NEAR) & (F.col("status") != "known"))
    rows = near.withColumns({"x": F.least("a_katottg", "b_katottg"), "y": F.greatest("a_katottg", "b_katottg")}).join(linked(spark, folder), ["x", "y"], "left_anti")
    return rows.orderBy(F.desc(F.coalesce("operational_score", "score")), F.desc("geo_score"), "cand_id").limit(SLICE).select("cand_id", "operational_score", "geo_score")


@registry.add(
    "signals_primary",
    f"""WITH {_FLOOR_SQL}, s AS (SELECT cand_id, {_TRACK_SQL} AS track, list_filter([
        {{'id': 'goals', 'strength': CASE WHEN goals_cosine > 0 OR {_TRACK_SQL} = 'thematic' THEN CASE WHEN goals_cosine >= 0.12 THEN 'high' WHEN goals_cosine >= 0.05 OR {_TRACK_SQL} = 'thematic' THEN 'medium' ELSE 'low' END END}},
        {{'id': 'place', 'strength': CASE WHEN geo_score > 0 OR {_TRACK_SQL} = 'operational' THEN CASE WHEN geo_score >= 0.85 THEN 'high' WHEN geo_score >= 0.5 OR {_TRACK_SQL} = 'operational' THEN 'medium' ELSE 'low' END END}},
        {{'id': 'whole', 'strength': CASE WHEN score > 0 THEN CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END END}}], lambda x: x.strength IS NOT NULL) AS signals
      FROM known_curation_candidates, floor_value)
    SELECT cand_id, CAST(len(signals) AS INTEGER) AS n, array_to_string(list_transform(signals[1:3], lambda x: x.id || ':' || x.strength), ',') AS chips,
    coalesce(CASE WHEN track = 'thematic' THEN 'goals' WHEN track = 'operational' THEN 'place' END, signals[1].id, 'none') AS first_signal FROM s""",
)
def signals_primary(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of a candidate as a list of signals with strengths, the first of them, and the one to show."""

    rows = tracked(spark, folder)

    def signal(name: str, column: str, high: float, medium: float, track: str) -> Column:
        """What a measure says if it says anything; the track it makes counts as medium at least."""
        of_track = F.col("track") == track
        strength = F.when(F.col(column) >= high, "high").when((F.col(column) >= medium) | of_track, "medium").otherwise("low")
        return F.struct(F.lit(name).alias("id"), F.when((F.col(column) > 0) | of_track, strength).alias("strength"))

    every = F.array(signal("goals", "goals_cosine", 0.12, 0.05, "thematic"), signal("place", "geo_score", 0.85, 0.5, "operational"), signal("whole", "score", 0.7, 0.4, ""))
    rows = rows.select("cand_id", "track", F.filter(every, lambda s: s["strength"].isNotNull()).alias("signals"))
    chips = F.array_join(F.transform(F.slice("signals", 1, 3), lambda s: F.concat(s["id"], F.lit(":"), s["strength"])), ",")
    by_track = F.when(F.col("track") == "thematic", "goals").when(F.col("track") == "operational", "place")
    return rows.select("cand_id", F.size("signals").alias("n"), chips.alias("chips"), F.coalesce(by_track, F.get("signals", F.lit(0))["id"], F.lit("none")).alias("first_signal"))


def _slice_sql(number: int, name: str, condition: str, by: str) -> str:
    earlier = "".join(f" AND (x, y) NOT IN (SELECT (x, y) FROM s{i})" for i in range(number))
    return f"""s{number} AS (SELECT '{name}' AS slice, x, y, cand_id, CAST(row_number() OVER (ORDER BY {by} DESC, cand_id) AS INTEGER) AS place FROM (
      SELECT * FROM rows WHERE {condition}{earlier} QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY {by} DESC, cand_id) = 1) QUALIFY place <= {SIDECAR})"""


SLICES = (("thematic", "track = 'thematic'", "goals_cosine"), ("operational", "track = 'operational'", "geo_score"), ("any", "true", "score"))


@registry.add(
    "candidate_sidecar",
    f"""WITH {_FLOOR_SQL}, rows AS (SELECT cand_id, goals_cosine, geo_score, score, least(a, b) AS x, greatest(a, b) AS y, {_TRACK_SQL} AS track FROM known_curation_candidates, floor_value),
    {", ".join(_slice_sql(i, *s) for i, s in enumerate(SLICES))} {" UNION ALL ".join(f"SELECT slice, place, cand_id FROM s{i}" for i in range(len(SLICES)))}""",
)
def candidate_sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """Slices one after the other, each with up to forty pairs that no earlier slice took.

    A slice takes its rows in order until it is full; what it leaves stays for the next.
    """
    rows = tracked(spark, folder).withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    taken: list[DataFrame] = []
    for number, (name, condition, by) in enumerate(SLICES):
        left = rows.where(condition)
        # first row of each pair, in the order of the slice
        best = first_of(left.withColumn("minus", -F.col("cand_id")), ["x", "y"], [(by, True), ("minus", True)], ["x", "y", "cand_id", by])
        for earlier in taken:
            best = best.join(earlier.select("x", "y"), ["x", "y"], "left_anti")
        top = best.orderBy(F.desc(by), "cand_id").limit(SIDECAR)
        place = F.row_number().over(Window.orderBy(F.desc(by), "cand_id"))  # at most forty rows
        taken.append(top.select("x", "y", "cand_id", F.lit(name).alias("slice"), place.alias("place"), F.lit(number).alias("number")))
    return reduce(DataFrame.unionByName, taken).select("slice", "place", "cand_id")


@registry.add(
    "pair_lift",
    """WITH n AS (SELECT count(*) AS n, count(*) FILTER (oblast_a = oblast_b) AS region, count(*) FILTER (substr(a_katottg, 1, 6) = substr(b_katottg, 1, 6)) AS district FROM known_curation_candidates),
    e AS (SELECT sum(CAST(n AS DOUBLE) * n) / pow(sum(n), 2) AS chance FROM (SELECT oblast_a, count(*) AS n FROM known_curation_candidates WHERE oblast_a IS NOT NULL GROUP BY oblast_a))
    SELECT CAST(n AS BIGINT) AS pairs, CAST(region AS BIGINT) AS same_region, CAST(district AS BIGINT) AS same_district, round(region / n::DOUBLE, 4) AS region_share,
    round(100 * (region / n::DOUBLE - chance), 2) AS lift_points FROM n, e""",
)
def pair_lift(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs within one region and district, and how far the share is above that of chance pairs."""
    rows = table(spark, folder, "known_curation_candidates")
    same_district = F.substring("a_katottg", 1, 6) == F.substring("b_katottg", 1, 6)
    counts = rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("oblast_a") == F.col("oblast_b")).alias("same_region"), F.count_if(same_district).alias("same_district"))
    sizes = rows.where("oblast_a IS NOT NULL").groupBy("oblast_a").agg(F.count(F.lit(1)).cast("double").alias("n"))
    chance = sizes.agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("chance"))
    share = F.col("same_region") / F.col("pairs")
    return counts.crossJoin(F.broadcast(chance)).select(  # one row each
        "pairs", "same_region", "same_district", F.round(share, 4).alias("region_share"), F.round(100 * (share - F.col("chance")), 2).alias("lift_points")
    )


@registry.add(
    "network_overlap",
    f"""WITH {_LATEST_EDGES_SQL}, ranked AS (SELECT least(a, b) AS x, greatest(a, b) AS y, edge_id, row_number() OVER (ORDER BY goals_cosine DESC, edge_id) AS place
      FROM edges WHERE goals_cosine IS NOT NULL AND NOT isnan(goals_cosine)),
    best AS (SELECT least(a, b) AS x, greatest(a, b) AS y, cand_id, rank, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY rank NULLS LAST, cand_id) AS r FROM known_curation_candidates)
    SELECT edge_id, cand_id, CAST(place AS BIGINT) AS place, rank FROM ranked JOIN best USING (x, y) WHERE r = 1""",
)
def network_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that are curated pairs, with their place among all edges and the best row of the pair."""
    usable = latest_edges(spark, folder).where(F.col("goals_cosine").isNotNull() & ~F.isnan("goals_cosine"))
    ranked = global_rank(usable.select("x", "y", "edge_id", "goals_cosine"), [F.desc("goals_cosine"), F.asc("edge_id")], "place")
    rows = table(spark, folder, "known_curation_candidates").where("a <> b").withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b"), "known_rank": F.coalesce("rank", F.lit(2**31 - 1))})
    best = first_of(rows, ["x", "y"], [("known_rank", False), ("cand_id", False)], ["cand_id", "rank"])
    return ranked.join(best, ["x", "y"]).select("edge_id", "cand_id", "place", "rank")


@registry.add(
    "two_ranks",
    """SELECT cand_id, CAST(by_goals AS BIGINT) AS by_goals, CAST(by_score AS BIGINT) AS by_score, CAST(by_goals - by_score AS BIGINT) AS gained,
    round(pow(1 - (by_score - 1) / (n - 1)::DOUBLE, 2), 6) AS weight FROM (
      SELECT cand_id, row_number() OVER (ORDER BY goals_cosine DESC, cand_id) AS by_goals, row_number() OVER (ORDER BY score DESC, cand_id) AS by_score, count(*) OVER () AS n FROM known_curation_candidates)""",
)
def two_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Places by two measures, what a pair gains from the one to the other, and a weight by place."""
    rows = table(spark, folder, "known_curation_candidates").select("cand_id", "goals_cosine", "score")
    first = global_rank(rows, [F.desc("goals_cosine"), F.asc("cand_id")], "by_goals")
    both = global_rank(first, [F.desc("score"), F.asc("cand_id")], "by_score")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    weight = F.pow(1 - (F.col("by_score") - 1) / (F.col("n") - 1), 2)
    return both.crossJoin(F.broadcast(n)).select("cand_id", "by_goals", "by_score", (F.col("by_goals") - F.col("by_score")).alias("gained"), F.round(weight, 6).alias("weight"))


_MERGE_SQL = f"""{_LATEST_EDGES_SQL}, last AS (SELECT *, least(a, b) AS x, greatest(a, b) AS y FROM known_curation_candidates WHERE a <> b
      QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY loaded_at DESC, cand_id DESC) = 1)"""


@registry.add(
    "edge_merge",
    f"""WITH {_MERGE_SQL} SELECT coalesce(least(e.a, e.b), l.x) AS a, coalesce(greatest(e.a, e.b), l.y) AS b, coalesce(l.goals_cosine, CASE WHEN NOT isnan(e.goals_cosine) THEN e.goals_cosine END) AS goals_cosine,
    CASE WHEN trim(l.primary_theme) <> '' THEN l.primary_theme ELSE 'other' END AS theme, CASE WHEN l.x IS NULL THEN 'edge' WHEN e.edge_id IS NULL THEN 'candidate' ELSE 'both' END AS origin
    FROM edges e FULL JOIN last l ON l.x = least(e.a, e.b) AND l.y = greatest(e.a, e.b)""",
)
def edge_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Both sets of pairs in one, by unordered pair; the later candidate of a pair wins, an empty theme gives way."""
    rows = table(spark, folder, "known_curation_candidates").where("a <> b").withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    last = first_of(rows, ["x", "y"], [("loaded_at", True), ("cand_id", True)], ["cand_id", "goals_cosine", "primary_theme"]).withColumnRenamed("goals_cosine", "own")
    joined = latest_edges(spark, folder).join(last, ["x", "y"], "full")
    theme = F.when(F.trim("primary_theme") != "", F.col("primary_theme")).otherwise("other")
    origin = F.when(F.col("cand_id").isNull(), "edge").when(F.col("edge_id").isNull(), "candidate").otherwise("both")
    goals = F.coalesce("own", F.when(~F.isnan("goals_cosine"), F.col("goals_cosine")))
    return joined.select(F.col("x").alias("a"), F.col("y").alias("b"), goals.alias("goals_cosine"), theme.alias("theme"), origin.alias("origin"))


# Weights of text, place and whole score by what is asked for.
POLICIES = [("text", 0.7, 0.1, 0.2), ("place", 0.1, 0.7, 0.2), ("even", 0.4, 0.4, 0.2), ("score", 0.0, 0.0, 1.0)]
_POLICY_SQL = ", ".join(f"('{n}', {t}::DOUBLE, {p}::DOUBLE, {s}::DOUBLE)" for n, t, p, s in POLICIES)


@registry.add(
    "recommend_policy",
    f"""WITH policy(name, t, p, s) AS (VALUES {_POLICY_SQL}), ends AS (
      SELECT cand_id, a_katottg AS seed, b AS partner, goals_cosine, geo_score, score FROM known_curation_candidates WHERE a_katottg IS NOT NULL
      UNION ALL SELECT cand_id, b_katottg, a, goals_cosine, geo_score, score FROM known_curation_candidates WHERE b_katottg IS NOT NULL AND b_katottg IS DISTINCT FROM a_katottg)
    SELECT seed, policy, cand_id, partner, agent, CAST(place AS INTEGER) AS place FROM (
      SELECT seed, name AS policy, cand_id, partner, round(t * goals_cosine + p * geo_score + s * score, 6) AS agent,
      row_number() OVER (PARTITION BY seed, name ORDER BY round(t * goals_cosine + p * geo_score + s * score, 6) DESC, score DESC, cand_id) AS place FROM ends, policy) WHERE place <= 5""",
)
def recommend_policy(spark: SparkSession, folder: str) -> DataFrame:
    """For each entity and policy the five best partners."""
    rows = table(spark, folder, "known_curation_candidates")
    side = lambda own, other: F.struct(F.col(own).alias("seed"), F.col(other).alias("partner"))
    second = F.when(~F.col("b_katottg").eqNullSafe(F.col("a_katottg")), side("b_katottg", "a"))
    ends = rows.select("cand_id", "goals_cosine", "geo_score", "score", F.explode(F.array_compact(F.array(side("a_katottg", "b"), second))).alias("end"))
    ends = ends.select("cand_id", "goals_cosine", "geo_score", "score", "end.seed", "end.partner").where("seed IS NOT NULL")
    policies = F.array(*(F.struct(F.lit(n).alias("policy"), F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(s).alias("s")) for n, t, p, s in POLICIES))
    rated = ends.withColumn("by", F.explode(policies)).select(
        "seed", F.col("by.policy").alias("policy"), "cand_id", "partner", "score",
        F.round(F.col("by.t") * F.col("goals_cosine") + F.col("by.p") * F.col("geo_score") + F.col("by.s") * F.col("score"), 6).alias("agent"),
    )
    place = F.row_number().over(Window.partitionBy("seed", "policy").orderBy(F.desc("agent"), F.desc("score"), "cand_id"))
    return rated.withColumn("place", place).where("place <= 5").select("seed", "policy", "cand_id", "partner", "agent", "place")


# Weights of a sector by where it is told, the sum a pair must reach, and how the score grows with it.
FULL, PARTIAL, FLOOR, GROWTH, SAME_REGION = 1.0, 0.85, 1.2, 0.4, 1.2
#: Places of one need, and those of its own region at most; places of the slice.
PLACES, OWN_PLACES, BEST = 12, 8, 400

_COMPLEMENTARY_SQL = f"""{LATEST_SQL}, need AS (SELECT katottg, oblast, unnest(list_distinct(sectors)) AS sector FROM latest WHERE row_id % 100 = 0),
    offer AS (SELECT katottg, oblast, unnest(list_distinct(sectors)) AS sector, CASE sourcequality WHEN 'full-strategy' THEN {FULL}::DOUBLE ELSE {PARTIAL}::DOUBLE END AS w FROM latest WHERE sourcequality IN ('full-strategy', 'partial')),
    pairs AS (SELECT n.katottg AS need, o.katottg AS offer, any_value(n.oblast = o.oblast) AS same, count(*) AS hits, count(*) * any_value(w) AS total
      FROM need n JOIN offer o ON n.sector = o.sector AND n.katottg <> o.katottg GROUP BY 1, 2),
    scored AS (SELECT *, round(least(1.0, (1 - exp(-{GROWTH}::DOUBLE * total)) * CASE WHEN same THEN {SAME_REGION}::DOUBLE ELSE 1.0 END), 3) AS score FROM pairs WHERE total >= {FLOOR}::DOUBLE),
    placed AS (SELECT *, row_number() OVER (PARTITION BY need, same ORDER BY score DESC, offer) AS r, count(*) FILTER (same) OVER (PARTITION BY need) AS same_n FROM scored),
    chosen AS (SELECT need, offer, same, CAST(hits AS BIGINT) AS hits, score FROM placed WHERE CASE WHEN same THEN r <= {OWN_PLACES} ELSE r <= {PLACES} - least(same_n, {OWN_PLACES}) END)"""


@registry.add("complementary_match", f"WITH {_COMPLEMENTARY_SQL} SELECT * FROM chosen")
def complementary_match(spark: SparkSession, folder: str) -> DataFrame:
    """Offers for needs by shared sectors: up to eight of the same region, filled to twelve from others.

    Needs are the query set of a search, the entities whose row is divisible by 100, and
    meet all offers.  What a pair scores depends on the sectors of either side only, so
    that sets of sectors meet, not entities: there are as many as a few sectors combine
    to, whatever the number of entities.  Of the entities with one set in one region the
    first few come into question; sets that can't come up to the last place are left out.
    """
    rows = latest_entities(spark, folder, "row_id", "oblast", "sectors", "sourcequality").withColumn("set", F.array_sort(F.array_distinct("sectors"))).where("size(set) > 0")
    need = rows.where("row_id % 100 = 0").select(F.col("katottg").alias("need"), F.col("oblast").alias("n_oblast"), F.col("set").alias("n_set"))
    weight = F.when(F.col("sourcequality") == "full-strategy", FULL).otherwise(PARTIAL)
    offer = rows.where(F.col("sourcequality").isin("full-strategy", "partial")).select(F.col("katottg").alias("offer"), F.col("oblast").alias("o_oblast"), F.col("set").alias("o_set"), weight.alias("w"))
    of_set = ["o_set", "w", "o_oblast"]
    # one more than the places, as an entity isn't its own partner
    first = offer.withColumn("r", F.row_number().over(Window.partitionBy(*of_set).orderBy("offer"))).where(F.col("r") <= PLACES + 1).drop("r")
    sizes = offer.groupBy(*of_set).agg(F.count(F.lit(1)).alias("n"))
    sets = need.select("n_set").distinct().select("n_set", F.explode("n_set").alias("sector"))
    offered = sizes.select("o_set", "w").distinct().select("o_set", "w", F.explode("o_set").alias("sector"))
    hits = sets.join(offered, "sector").groupBy("n_set", "o_set", "w").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") * F.col("w") >= FLOOR)
    rated = hits.withColumn("base", 1 - F.exp(-GROWTH * F.col("hits") * F.col("w"))).join(sizes, ["o_set", "w"])
    better = Window.partitionBy("n_set", "o_oblast").orderBy(F.desc("base"))
    upto = F.sum("n").over(better.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("n").over(Window.partitionBy("n_set", "o_oblast", "base"))
    usable = rated.withColumn("sooner", upto).where(F.col("sooner") <= PLACES).select("n_set", *of_set, "hits", "base")
    # by set and region the first few, then for each need
    by_region = Window.partitionBy("n_set", "o_oblast").orderBy(F.desc(F.round("base", 3)), "offer")
    few = usable.join(first, of_set).withColumn("r", F.row_number().over(by_region)).where(F.col("r") <= 4 * (PLACES + 1)).drop("r")
    met = need.join(few, "n_set").where("need <> offer")
    same = F.coalesce(F.col("n_oblast") == F.col("o_oblast"), F.lit(False))
    score = F.round(F.least(F.lit(1.0), F.col("base") * F.when(same, SAME_REGION).otherwise(1.0)), 3)
    scored = met.select("need", "offer", same.alias("same"), "hits", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("need", "same").orderBy(F.desc("score"), "offer"))
    placed = scored.withColumn("r", place).where(F.col("r") <= F.when(F.col("same"), OWN_PLACES).otherwise(PLACES))
    own = F.count_if(F.col("same")).over(Window.partitionBy("need"))  # twenty rows
    return placed.withColumn("own", own).where(F.col("same") | (F.col("r") <= PLACES - F.col("own"))).select("need", "offer", "same", "hits", "score")


@registry.add(
    "complementary_slice",
    f"""WITH {_COMPLEMENTARY_SQL}, best AS (SELECT least(need, offer) AS a, greatest(need, offer) AS b, max(score) AS score, bool_or(same) AS same, max(hits) AS hits FROM chosen GROUP BY 1, 2)
    SELECT * FROM best ORDER BY score DESC, same DESC, hits DESC, a, b LIMIT {BEST}""",
)
def complementary_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The best complementary pairs, each once whichever end needs: by score, region and hits, then by codes."""
    rows = complementary_match(spark, folder).groupBy(F.least("need", "offer").alias("a"), F.greatest("need", "offer").alias("b"))
    best = rows.agg(F.max("score").alias("score"), F.bool_or("same").alias("same"), F.max("hits").alias("hits"))
    return best.orderBy(F.desc("score"), F.desc("same"), F.desc("hits"), "a", "b").limit(BEST)
