"""Queries over agreements, duplicates, unions of sources and updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.functions import text as X
from sumizh.operators.ranking import first_of, global_rank
from sumizh.plans.entities import LATEST_SQL, latest_entities, undirected
from sumizh.plans.registry import registry
from sumizh.sources.tables import table

# Categories by the first pattern that fits a title.
CATEGORIES = [("roads", "велом|мост|стежк"), ("water", "водогон|річк"), ("waste", "сміт"), ("school", "ліце|учн"), ("health", "амбулатор"), ("safety", "укрит|пожеж"), ("records", "архів")]

_AGREEMENTS_SQL = "agreements AS (SELECT cand_id, a, b, primary_theme, CAST(pos AS INTEGER) AS pos, g.n AS n, g.title AS title, g.date AS date FROM (SELECT cand_id, a, b, primary_theme, unnest(agreements) AS g, generate_subscripts(agreements, 1) AS pos FROM known_curation_candidates) WHERE g IS NOT NULL)"
_CATEGORY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{c}'" for c, p in CATEGORIES) + " ELSE 'other' END"


def agreements(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "known_curation_candidates").select("cand_id", "a", "b", "primary_theme", F.posexplode("agreements").alias("at", "g"))
    return rows.where("g IS NOT NULL").select("cand_id", "a", "b", "primary_theme", (F.col("at") + 1).alias("pos"), F.col("g.n").alias("n"), F.col("g.title").alias("title"), F.col("g.date").alias("date"))


def category(title):
    low = F.lower(title)
    return reduce(lambda c, r: c.when(low.rlike(r[1]), r[0]), CATEGORIES[1:], F.when(low.rlike(CATEGORIES[0][1]), CATEGORIES[0][0])).otherwise("other")


@registry.add(
    "agreement_essence",
    f"""WITH {_AGREEMENTS_SQL} SELECT cand_id, pos, coalesce(nullif(regexp_extract(title, '«([^»]+)»', 1), ''), nullif(regexp_extract(title, '[„”"]([^„”“"]+)[”“"]', 1), ''),
      trim(regexp_replace(title, '^(?:Договір|Угода|Дог\\.)\\s+(?:про|щодо):?\\s+(?:співробітництво[^:]*:\\s*)?', ''))) AS essence FROM agreements WHERE title IS NOT NULL""",
)
def agreement_essence(spark: SparkSession, folder: str) -> DataFrame:
    """What an agreement is about: its quoted name, else the title without the usual beginning."""
    quoted = lambda p: F.nullif(F.regexp_extract("title", p, 1), F.lit(""))
    rest = F.trim(F.regexp_replace("title", r"^(?:Договір|Угода|Дог\.)\s+(?:про|щодо):?\s+(?:співробітництво[^:]*:\s*)?", ""))
    rows = agreements(spark, folder).where("title IS NOT NULL")
    return rows.select("cand_id", "pos", F.coalesce(quoted("«([^»]+)»"), quoted('[„”"]([^„”“"]+)[”“"]'), rest).alias("essence"))


@registry.add(
    "agreement_years",
    f"""WITH {_AGREEMENTS_SQL} SELECT {_CATEGORY_SQL} AS category, try_cast(substr(date, 1, 4) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n FROM agreements WHERE title IS NOT NULL GROUP BY 1, 2""",
)
def agreement_years(spark: SparkSession, folder: str) -> DataFrame:
    """Agreements by category and year; a date that is none has no year."""
    rows = agreements(spark, folder).where("title IS NOT NULL")
    return rows.groupBy(category(F.col("title")).alias("category"), F.substring("date", 1, 4).try_cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "pair_aggregate",
    f"""WITH {_AGREEMENTS_SQL} SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(count(*) AS BIGINT) AS n, list_sort(list(DISTINCT {_CATEGORY_SQL})) AS categories, min(date) AS first_date
    FROM agreements WHERE title IS NOT NULL GROUP BY 1, 2""",
)
def pair_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Agreements of each unordered pair with their categories, of which there are few."""
    rows = agreements(spark, folder).where("title IS NOT NULL").withColumn("category", category(F.col("title")))
    grouped = rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("category")).alias("categories"), F.min("date").alias("first_date"))


@registry.add(
    "party_counts",
    """WITH p AS (SELECT least(a, b) AS x, greatest(a, b) AS y, unnest(agreements) AS g FROM known_curation_candidates), e AS (SELECT g.n AS n, unnest([x, y]) AS party FROM p WHERE g.n IS NOT NULL),
    c AS (SELECT n, count(DISTINCT party) AS parties FROM e GROUP BY n) SELECT CAST(least(parties, 6) AS BIGINT) AS parties, CAST(count(*) AS BIGINT) AS numbers FROM c GROUP BY 1""",
)
def party_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Register numbers by how many parties they have, six and more together."""
    ends = agreements(spark, folder).where("n IS NOT NULL").select("n", F.explode(F.array("a", "b")).alias("party"))
    counted = ends.groupBy("n").agg(F.count_distinct("party").alias("parties"))
    return counted.groupBy(F.least("parties", F.lit(6)).cast("bigint").alias("parties")).agg(F.count(F.lit(1)).alias("numbers"))


_RICH = ["rayon", "type", "population", "strategyurl", "portalurl", "strategyyear", "goals", "donorsprograms", "sourcequality"]
_RICH_SQL = " + ".join(f"({c} IS NOT NULL)::INT" for c in _RICH)


@registry.add(
    "richest_row",
    f"""SELECT katottg, row_id, CAST({_RICH_SQL} AS INTEGER) AS filled FROM hromadas QUALIFY row_number() OVER (PARTITION BY katottg ORDER BY {_RICH_SQL} DESC, row_id) = 1""",
)
def richest_row(spark: SparkSession, folder: str) -> DataFrame:
    """Of repeated deliveries that with the most fields filled, the first if equal."""
    filled = reduce(lambda s, c: s + F.col(c).isNotNull().cast("int"), _RICH[1:], F.col(_RICH[0]).isNotNull().cast("int"))
    rows = table(spark, folder, "hromadas").select("katottg", "row_id", filled.alias("filled"), (-filled).alias("minus"))
    return first_of(rows, ["katottg"], [("minus", False), ("row_id", False)], ["row_id", "filled"])


@registry.add(
    "partner_union",
    """WITH u AS (SELECT portal_id AS id, name, oblast AS region, 1 AS src FROM hromada_portals UNION ALL SELECT growth_id, name, oblast, 2 FROM corpus_growth_priority UNION ALL SELECT id, name, oblast, 3 FROM hromadas_full30)
    SELECT lower(name) AS key, region, CAST(src AS INTEGER) AS src, id FROM u WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(name), region ORDER BY src, id) = 1""",
)
def partner_union(spark: SparkSession, folder: str) -> DataFrame:
    """Three sources in one list, each name and region once, from the first source that has it."""
    parts = [("hromada_portals", "portal_id", 1), ("corpus_growth_priority", "growth_id", 2), ("hromadas_full30", "id", 3)]
    rows = [table(spark, folder, t).select(F.col(i).alias("id"), "name", F.col("oblast").alias("region"), F.lit(n).alias("src")) for t, i, n in parts]
    united = reduce(DataFrame.unionByName, rows).where("name IS NOT NULL").withColumn("key", F.lower("name"))
    return first_of(united, ["key", "region"], [("src", False), ("id", False)], ["src", "id"])


@registry.add(
    "profile_merge",
    f"""WITH {LATEST_SQL}, p AS (SELECT katottg, count(*) AS rows, count(portalurl) AS portals FROM hromada_portals WHERE katottg IS NOT NULL GROUP BY katottg)
    SELECT coalesce(l.katottg, p.katottg) AS katottg, name, CAST(coalesce(rows, 0) AS BIGINT) AS rows, CAST(coalesce(portals, 0) AS BIGINT) AS portals, l.katottg IS NULL AS only_portal FROM latest l FULL JOIN p ON p.katottg = l.katottg""",
)
def profile_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Entities and portals in one, whichever has a code; counts default to 0."""
    portals = table(spark, folder, "hromada_portals").where("katottg IS NOT NULL").groupBy("katottg").agg(F.count(F.lit(1)).alias("rows"), F.count("portalurl").alias("portals"))
    joined = latest_entities(spark, folder, "name").withColumn("here", F.lit(True)).join(portals, "katottg", "full")
    return joined.select("katottg", "name", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), F.coalesce("portals", F.lit(0)).cast("bigint").alias("portals"), F.col("here").isNull().alias("only_portal"))


@registry.add(
    "update_or_insert",
    """WITH k AS (SELECT DISTINCT katottg FROM hromadas) SELECT growth_id, CASE WHEN g.katottg IS NULL THEN 'no code' WHEN k.katottg IS NULL THEN 'insert' ELSE 'update' END AS action
    FROM corpus_growth_priority g LEFT JOIN k ON k.katottg = g.katottg""",
)
def update_or_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Which rows would update an entity and which would be new."""
    known = table(spark, folder, "hromadas").select("katottg", F.lit(True).alias("hit")).distinct()
    action = F.when(F.col("katottg").isNull(), "no code").when(F.col("hit").isNull(), "insert").otherwise("update")
    return table(spark, folder, "corpus_growth_priority").join(known, "katottg", "left").select("growth_id", action.alias("action"))


@registry.add(
    "overlay_pairs",
    """WITH e AS (SELECT DISTINCT least(a_katottg, b_katottg) AS a, greatest(a_katottg, b_katottg) AS b FROM known_curation_candidates WHERE a_katottg <> b_katottg),
    n AS (SELECT DISTINCT least(katottg, code) AS a, greatest(katottg, code) AS b FROM (SELECT katottg, unnest(corpusneighbourcodes) AS code FROM corpus_growth_priority WHERE katottg IS NOT NULL) WHERE katottg <> code)
    SELECT a, b, 'network' AS layer FROM n UNION ALL SELECT a, b, 'candidate' FROM (SELECT a, b FROM e EXCEPT SELECT a, b FROM n)""",
)
def overlay_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of the network, and over them the candidates that aren't among these."""
    links = table(spark, folder, "corpus_growth_priority").select("katottg", F.explode("corpusneighbourcodes").alias("code"))
    network = undirected(links, "katottg", "code")
    candidates = undirected(table(spark, folder, "known_curation_candidates"), "a_katottg", "b_katottg")
    over = candidates.join(network, ["a", "b"], "left_anti")
    return network.withColumn("layer", F.lit("network")).unionByName(over.withColumn("layer", F.lit("candidate")))


@registry.add(
    "sectors_in_order",
    f"""WITH {LATEST_SQL} SELECT cand_id, array_to_string(list_filter(['Дороги', 'Медицина', 'Ремесла', 'Спадщина', 'Соціальний захист'], lambda x: list_contains(p.sectors, x) AND list_contains(q.sectors, x)), ', ') AS shared
    FROM known_curation_candidates c JOIN latest p ON p.katottg = a_katottg JOIN latest q ON q.katottg = b_katottg""",
)
def sectors_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Sectors that both ends have, in a given order."""
    order = F.array(*(F.lit(s) for s in ("Дороги", "Медицина", "Ремесла", "Спадщина", "Соціальний захист")))
    ends = latest_entities(spark, folder, "sectors")
    a, b = ends.select(F.col("katottg").alias("a_katottg"), F.col("sectors").alias("sa")), ends.select(F.col("katottg").alias("b_katottg"), F.col("sectors").alias("sb"))
    joined = table(spark, folder, "known_curation_candidates").select("cand_id", "a_katottg", "b_katottg").join(a, "a_katottg").join(b, "b_katottg")
    return joined.select("cand_id", F.array_join(F.array_intersect(F.array_intersect(order, "sa"), "sb"), ", ").alias("shared"))


@registry.add(
    "donor_ranks",
    f"""WITH {LATEST_SQL}, m AS (SELECT DISTINCT katottg, trim(p) AS program FROM (SELECT katottg, unnest(string_split_regex(donorsprograms, '[,;]')) AS p FROM latest) WHERE trim(p) <> ''),
    r AS (SELECT m.program, c.cand_id, c.goals_cosine, row_number() OVER (PARTITION BY m.program ORDER BY c.status = 'known' DESC, c.goals_cosine DESC, c.score DESC, c.cand_id) AS place
      FROM known_curation_candidates c JOIN m ON m.katottg = c.a_katottg JOIN m o ON o.katottg = c.b_katottg AND o.program = m.program)
    SELECT program, cand_id, goals_cosine, CAST(place AS INTEGER) AS place FROM r WHERE place <= 15""",
)
def donor_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """The fifteen best candidates within each programme, known ones first."""
    rows = latest_entities(spark, folder, "donorsprograms").select("katottg", F.explode(X.programmes(F.col("donorsprograms"))).alias("program")).distinct()
    a, b = rows.select(F.col("katottg").alias("a_katottg"), "program"), rows.select(F.col("katottg").alias("b_katottg"), "program")
    joined = table(spark, folder, "known_curation_candidates").join(a, "a_katottg").join(b, ["b_katottg", "program"])
    place = F.row_number().over(Window.partitionBy("program").orderBy(F.desc(F.col("status") == "known"), F.desc("goals_cosine"), F.desc("score"), "cand_id"))
    return joined.withColumn("place", place).where("place <= 15").select("program", "cand_id", "goals_cosine", "place")


#: Pairs of a baseline at most.
BASELINE = 2000


@registry.add(
    "hash_baseline",
    f"""WITH nodes AS (SELECT DISTINCT a_katottg AS k FROM known_curation_candidates WHERE a_katottg IS NOT NULL UNION SELECT b_katottg FROM known_curation_candidates WHERE b_katottg IS NOT NULL),
    numbered AS (SELECT k, row_number() OVER (ORDER BY md5('a' || k)) AS ra, row_number() OVER (ORDER BY md5('b' || k)) AS rb FROM nodes),
    pairs AS (SELECT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b FROM numbered x JOIN numbered y ON x.ra = y.rb WHERE x.k <> y.k), e AS (SELECT count(DISTINCT [least(a_katottg, b_katottg), greatest(a_katottg, b_katottg)]) AS n
      FROM known_curation_candidates WHERE a_katottg IS NOT NULL AND b_katottg IS NOT NULL AND a_katottg <> b_katottg)
    SELECT a, b FROM (SELECT DISTINCT a, b FROM pairs) QUALIFY row_number() OVER (ORDER BY md5(a || b), a) <= least({BASELINE}, (SELECT n FROM e))""",
)
def hash_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """As many pairs of nodes as the network has links, two thousand at most, drawn by two orders that hashes give: the same in every run."""
    rows = table(spark, folder, "known_curation_candidates")
    nodes = rows.select(F.explode(F.array("a_katottg", "b_katottg")).alias("k")).where("k IS NOT NULL").distinct()
    by = lambda salt, name: global_rank(nodes, [F.md5(F.concat(F.lit(salt), "k"))], "rank").select(F.col("k").alias(name), "rank")
    pairs = by("a", "x").join(by("b", "y"), "rank").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    most = min(BASELINE, undirected(rows, "a_katottg", "b_katottg").count())
    return pairs.orderBy(F.md5(F.concat("a", "b")), "a").limit(most)


@registry.add(
    "coverage_manifest",
    """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(population) AS BIGINT) AS with_population, CAST(count(*) FILTER (trim(goals) <> '') AS BIGINT) AS with_goals,
    CAST(count(*) FILTER (len(sectors) > 0) AS BIGINT) AS with_sectors, CAST(count(DISTINCT katottg) AS BIGINT) AS codes, CAST(count(DISTINCT oblast) AS BIGINT) AS regions FROM hromadas""",
)
def coverage_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Counts for a manifest, in one pass."""
    return table(spark, folder, "hromadas").agg(
        F.count(F.lit(1)).alias("rows"), F.count("population").alias("with_population"), F.count_if(F.trim("goals") != "").alias("with_goals"), F.count_if(F.size("sectors") > 0).alias("with_sectors"),
        F.count_distinct("katottg").alias("codes"), F.count_distinct("oblast").alias("regions"),
    )


@registry.add(
    "namesakes",
    """WITH d AS (SELECT DISTINCT name, katottg FROM hromadas)
    SELECT name, min(katottg) AS first_code, max(katottg) AS last_code, CAST(count(*) AS BIGINT) AS codes FROM d GROUP BY name HAVING count(*) > 1""",
)
def namesakes(spark: SparkSession, folder: str) -> DataFrame:
    """Names of more than one entity with the first and the last code: the two ways a map by name would go."""
    rows = table(spark, folder, "hromadas").select("name", "katottg").distinct()
    return rows.groupBy("name").agg(F.min("katottg").alias("first_code"), F.max("katottg").alias("last_code"), F.count(F.lit(1)).alias("codes")).where("codes > 1")
