"""Queries over entities: latest rows, lines of goals, names, addresses, programmes, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.functions import text as X
from sumizh.operators.ranking import first_of, global_rank
from sumizh.plans.registry import registry
from sumizh.sources.tables import table

QUALITIES = ("full-strategy", "partial", "proxy-info")
LATEST_SQL = "latest AS (SELECT * FROM hromadas QUALIFY row_number() OVER (PARTITION BY katottg ORDER BY loaded_at DESC, row_id DESC) = 1)"


def latest_entities(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    """The row of each code that was loaded last."""
    return first_of(table(spark, folder, "hromadas"), ["katottg"], [("loaded_at", True), ("row_id", True)], ["katottg", *fields])


@registry.add(
    "entity_scan",
    f"""SELECT row_id, katottg, name, oblast, sourcequality, CAST(length(goals) AS INTEGER) AS goals_length FROM hromadas
    WHERE sourcequality IN {QUALITIES} AND trim(goals) <> ''""",
)
def entity_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of usable quality that have goals; both conditions reach the scan."""
    rows = table(spark, folder, "hromadas").where(F.col("sourcequality").isin(*QUALITIES) & F.col("goals").isNotNull() & (F.trim("goals") != ""))
    return rows.select("row_id", "katottg", "name", "oblast", "sourcequality", F.length("goals").alias("goals_length"))


@registry.add(
    "entity_latest",
    f"WITH {LATEST_SQL} SELECT katottg, row_id, name, oblast, rayon, population, coalesce(sourcequality, 'none') AS quality FROM latest",
)
def entity_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last delivery of each code, with defaults for what is missing."""
    rows = latest_entities(spark, folder, "row_id", "name", "oblast", "rayon", "population", "sourcequality")
    return rows.select("katottg", "row_id", "name", "oblast", "rayon", "population", F.coalesce("sourcequality", F.lit("none")).alias("quality"))


@registry.add(
    "typed_periods",
    """SELECT row_id, try_cast(regexp_extract(strategyperiod, '^([0-9]{4})', 1) AS INTEGER) AS starts,
    try_cast(regexp_extract(strategyperiod, '([0-9]{4})$', 1) AS INTEGER) AS ends, strategyyear,
    CAST(strategyyear = try_cast(regexp_extract(strategyperiod, '^([0-9]{4})', 1) AS INTEGER) AS BOOLEAN) AS agrees FROM hromadas""",
)
def typed_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers out of text; what is no number is null, not zero."""
    year = lambda p: F.regexp_extract("strategyperiod", p, 1).try_cast("int")
    rows = table(spark, folder, "hromadas").select("row_id", year("^([0-9]{4})").alias("starts"), year("([0-9]{4})$").alias("ends"), "strategyyear")
    return rows.withColumn("agrees", F.col("strategyyear") == F.col("starts"))


_LINES_SQL = """lines AS (SELECT row_id, CAST(pos AS INTEGER) AS pos, line FROM (
  SELECT row_id, unnest(kept) AS line, generate_subscripts(kept, 1) AS pos FROM (
    SELECT row_id, list_filter(list_transform(string_split(goals, chr(10)), lambda x: trim(x, ' ' || chr(9) || '-•' || chr(13) || chr(10))), lambda x: length(x) > 15) AS kept
    FROM hromadas WHERE goals IS NOT NULL)))"""


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hromadas").where("goals IS NOT NULL")
    exploded = rows.select("row_id", F.posexplode(X.goal_lines(F.col("goals"))).alias("at", "line"))
    return exploded.select("row_id", (F.col("at") + 1).alias("pos"), "line")


@registry.add("goal_lines", f"WITH {_LINES_SQL} SELECT * FROM lines")
def goal_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the goals, one row each."""
    return lines_of(spark, folder)


@registry.add(
    "line_kinds",
    f"""WITH {_LINES_SQL} SELECT row_id, pos,
    CASE WHEN regexp_matches(line, '^[0-9]+\\.[0-9]+') THEN 'operational' WHEN regexp_matches(line, '^(?:Стратегічна ціль|Ціль|[0-9]+\\.)') THEN 'strategic'
      WHEN length(line) > 80 THEN 'strategic' ELSE 'other' END AS kind,
    regexp_extract(line, '^(?:Стратегічна ціль |Ціль )?([0-9]+(?:\\.[0-9]+)?)', 1) AS num,
    regexp_extract(line, '^([0-9]+)\\.[0-9]+', 1) AS parent,
    trim(regexp_replace(line, '^(?:Стратегічна ціль|Ціль)?\\s*[0-9]+(?:\\.[0-9]+)*[.:)]?\\s*', '')) AS body FROM lines""",
)
def line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kind, number, parent and body of each line."""
    line = F.col("line")
    return lines_of(spark, folder).select(
        "row_id", "pos", X.line_kind(line).alias("kind"), X.line_number(line).alias("num"), X.parent_number(line).alias("parent"), X.clean_line(line).alias("body")
    )


@registry.add(
    "goal_hierarchy",
    f"""WITH {_LINES_SQL}, parts AS (SELECT row_id, pos, regexp_extract(line, '^(?:Стратегічна ціль |Ціль )?([0-9]+)', 1) AS top,
      regexp_matches(line, '^[0-9]+\\.[0-9]+') AS sub FROM lines)
    SELECT row_id, top, CAST(count(*) FILTER (NOT sub) AS BIGINT) AS goals, CAST(count(*) FILTER (sub) AS BIGINT) AS subgoals, min(pos) AS first_pos
    FROM parts WHERE top <> '' GROUP BY row_id, top""",
)
def goal_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Goals with the number of goals under them, by the first part of the number."""
    line = F.col("line")
    top = F.regexp_extract(line, r"^(?:Стратегічна ціль |Ціль )?([0-9]+)", 1)
    rows = lines_of(spark, folder).select("row_id", "pos", top.alias("top"), (X.parent_number(line) != "").alias("sub")).where("top <> ''")
    return rows.groupBy("row_id", "top").agg(F.count_if(~F.col("sub")).alias("goals"), F.count_if("sub").alias("subgoals"), F.min("pos").alias("first_pos"))


@registry.add(
    "best_delivery",
    f"""WITH {_LINES_SQL}, counted AS (SELECT row_id, count(*) FILTER (regexp_matches(line, '^[0-9]+\\.[0-9]+')) AS subs, count(*) FILTER (NOT regexp_matches(line, '^[0-9]+\\.[0-9]+')) AS tops
      FROM lines GROUP BY row_id)
    SELECT katottg, row_id, CAST(score AS BIGINT) AS score, CASE WHEN tops >= 2 AND subs >= 5 THEN 'full-strategy' WHEN tops >= 1 THEN 'partial' ELSE 'none' END AS quality FROM (
      SELECT h.katottg, h.row_id, coalesce(subs, 0) AS subs, coalesce(tops, 0) AS tops, 10 * coalesce(subs, 0) + 3 * coalesce(tops, 0) AS score
      FROM hromadas h LEFT JOIN counted USING (row_id)
      QUALIFY row_number() OVER (PARTITION BY h.katottg ORDER BY score DESC, h.row_id DESC) = 1)""",
)
def best_delivery(spark: SparkSession, folder: str) -> DataFrame:
    """The delivery of each code with the richest goals, and the quality these show."""
    lines = X.goal_lines(F.col("goals"))
    sub = F.size(F.filter(lines, lambda x: x.rlike(r"^[0-9]+\.[0-9]+")))
    rows = table(spark, folder, "hromadas").select("katottg", "row_id", F.coalesce(sub, F.lit(0)).alias("subs"), F.coalesce(F.size(lines), F.lit(0)).alias("all"))
    counted = rows.select("katottg", "row_id", "subs", (F.col("all") - F.col("subs")).alias("tops"))
    scored = counted.withColumn("score", (10 * F.col("subs") + 3 * F.col("tops")).cast("bigint"))
    best = first_of(scored, ["katottg"], [("score", True), ("row_id", True)], ["row_id", "score", "subs", "tops"])
    quality = F.when((F.col("tops") >= 2) & (F.col("subs") >= 5), "full-strategy").when(F.col("tops") >= 1, "partial").otherwise("none")
    return best.select("katottg", "row_id", "score", quality.alias("quality"))


@registry.add(
    "short_names",
    """SELECT row_id, split_part(trim(name), ' ', 1) AS first_word, regexp_replace(name, ' (?:сільська|селищна|міська)? ?територіальна громада.*$', '') AS stem,
    array_to_string(string_split(trim(name), ' ')[1:2], ' ') AS two_words, regexp_replace(trim(translate(lower(name), '’ʼ`´', '''''''''')), '\\s+', ' ', 'g') AS normal FROM hromadas""",
)
def short_names(spark: SparkSession, folder: str) -> DataFrame:
    """The three short forms of a name, which differ, and its normal form."""
    name = F.col("name")
    return table(spark, folder, "hromadas").select(
        "row_id", X.first_word(name).alias("first_word"), X.without_suffix(name).alias("stem"), X.two_words(name).alias("two_words"), X.normal_name(name).alias("normal")
    )


@registry.add(
    "portal_addresses",
    """WITH derived AS (SELECT portal_id, nullif(regexp_extract(lower(trim(strategyurl)), '^(?:https?://)?(?:www\\.)?([^/?#:]+)', 1), '') AS host,
      nullif(regexp_extract(trim(strategyurl), '^(https?://[^/?#]+)', 1), '') AS base, portalurl FROM hromada_portals)
    SELECT portal_id, host, coalesce(portalurl, CASE WHEN host NOT LIKE '%register%' THEN base || '/' END) AS portal,
    CASE WHEN portalurl IS NOT NULL THEN 'given' WHEN base IS NOT NULL AND host NOT LIKE '%register%' THEN 'derived' ELSE 'none' END AS how FROM derived""",
)
def portal_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """The portal of each row: as given, else derived from the document's address unless that is a shared host."""
    rows = table(spark, folder, "hromada_portals").select("portal_id", X.host(F.col("strategyurl")).alias("host"), X.homepage(F.col("strategyurl")).alias("base"), "portalurl")
    own = ~F.col("host").contains("register")
    how = F.when(F.col("portalurl").isNotNull(), "given").when(F.col("base").isNotNull() & own, "derived").otherwise("none")
    return rows.select("portal_id", "host", F.coalesce("portalurl", F.when(own, F.col("base"))).alias("portal"), how.alias("how"))


@registry.add(
    "document_hosts",
    """SELECT host, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, 'https?://([a-z0-9.-]+)', 1)) AS host FROM documents) GROUP BY host""",
)
def document_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts that texts link to, with links and documents."""
    found = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("https?://([a-z0-9.-]+)"), 1)).alias("host"))
    return found.groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("doc_id").alias("documents"))


_PROGRAMMES_SQL = f"""{LATEST_SQL}, members AS (SELECT DISTINCT katottg, oblast, goals IS NOT NULL AND length(trim(goals)) > 40 AS has_goals, trim(p) AS program FROM (
    SELECT katottg, oblast, goals, unnest(string_split_regex(donorsprograms, '[,;]')) AS p FROM latest) WHERE trim(p) <> '')"""


def _members(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_entities(spark, folder, "oblast", "goals", "donorsprograms")
    has_goals = F.col("goals").isNotNull() & (F.length(F.trim("goals")) > 40)
    return rows.select("katottg", "oblast", has_goals.alias("has_goals"), F.explode(X.programmes(F.col("donorsprograms"))).alias("program")).distinct()


@registry.add(
    "donor_portfolio",
    f"""WITH {_PROGRAMMES_SQL} SELECT program, CAST(count(*) AS BIGINT) AS members, CAST(count(*) FILTER (has_goals) AS BIGINT) AS with_goals,
    CAST(count(DISTINCT oblast) AS BIGINT) AS regions FROM members GROUP BY program""",
)
def donor_portfolio(spark: SparkSession, folder: str) -> DataFrame:
    """Members, members with goals and regions of each programme."""
    return (
        _members(spark, folder)
        .groupBy("program")
        .agg(F.count(F.lit(1)).alias("members"), F.count_if("has_goals").alias("with_goals"), F.count_distinct("oblast").alias("regions"))
    )


@registry.add(
    "donor_bridges",
    f"""WITH {_PROGRAMMES_SQL}, edges AS (SELECT DISTINCT least(a_katottg, b_katottg) AS a, greatest(a_katottg, b_katottg) AS b FROM known_curation_candidates
      WHERE a_katottg IS NOT NULL AND b_katottg IS NOT NULL AND a_katottg <> b_katottg), ends AS (SELECT a, b, a AS one FROM edges UNION ALL SELECT a, b, b FROM edges),
    inside AS (SELECT program, a, b, count(*) AS n FROM ends JOIN members ON one = katottg GROUP BY program, a, b)
    SELECT program, CAST(count(*) FILTER (n = 2) AS BIGINT) AS within_edges, CAST(count(*) FILTER (n = 1) AS BIGINT) AS bridge_edges FROM inside GROUP BY program""",
)
def donor_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of each programme with both ends among its members, and with one."""
    members = _members(spark, folder).select(F.col("katottg").alias("one"), "program")
    edges = undirected(table(spark, folder, "known_curation_candidates"), "a_katottg", "b_katottg")
    ends = edges.select("a", "b", F.explode(F.array("a", "b")).alias("one"))
    inside = ends.join(members, "one").groupBy("program", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return inside.groupBy("program").agg(F.count_if(F.col("n") == 2).alias("within_edges"), F.count_if(F.col("n") == 1).alias("bridge_edges"))


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs (a, b) with a < b; loops and pairs with a null end are left out."""
    return (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)) & (F.col(a) != "") & (F.col(b) != ""))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )


@registry.add(
    "hubs",
    """WITH edges AS (SELECT DISTINCT least(a_katottg, b_katottg) AS a, greatest(a_katottg, b_katottg) AS b FROM known_curation_candidates
      WHERE a_katottg IS NOT NULL AND b_katottg IS NOT NULL AND a_katottg <> b_katottg)
    SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT unnest([a, b]) AS node FROM edges) GROUP BY node ORDER BY degree DESC, node LIMIT 8""",
)
def hubs(spark: SparkSession, folder: str) -> DataFrame:
    """The eight nodes with most neighbours."""
    edges = undirected(table(spark, folder, "known_curation_candidates"), "a_katottg", "b_katottg")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return nodes.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(8)


@registry.add(
    "region_coverage",
    f"""WITH {LATEST_SQL} SELECT oblast, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (trim(goals) <> '') AS BIGINT) AS covered,
    round(count(*) FILTER (trim(goals) <> '') / count(*)::DOUBLE, 3) AS share FROM latest GROUP BY oblast""",
)
def region_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of each region, those with goals, and their share."""
    covered = F.count_if(F.trim("goals") != "")
    total = F.count(F.lit(1))
    return latest_entities(spark, folder, "oblast", "goals").groupBy("oblast").agg(total.alias("total"), covered.alias("covered"), F.round(covered / total, 3).alias("share"))


@registry.add(
    "growth_priority",
    """SELECT growth_id, name, oblast, pindegree, coalesce(oblastcorpusshare, 1.0) AS share_or_one, CAST(len(list_distinct(corpusneighbourcodes)) AS INTEGER) AS neighbours
    FROM corpus_growth_priority ORDER BY corpuspinlinks DESC, pindegree DESC, coalesce(oblastcorpusshare, 1.0), name, growth_id LIMIT 40""",
)
def growth_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The forty first entities to add: links, degree, then the lowest share of the region; no share counts as one."""
    rows = table(spark, folder, "corpus_growth_priority").withColumn("share_or_one", F.coalesce("oblastcorpusshare", F.lit(1.0)))
    top = rows.orderBy(F.desc("corpuspinlinks"), F.desc("pindegree"), "share_or_one", "name", "growth_id").limit(40)
    return top.select("growth_id", "name", "oblast", "pindegree", "share_or_one", F.size(F.array_distinct("corpusneighbourcodes")).alias("neighbours"))


@registry.add(
    "neighbour_regions",
    """WITH links AS (SELECT DISTINCT katottg, unnest(corpusneighbourcodes) AS code FROM corpus_growth_priority WHERE katottg IS NOT NULL)
    SELECT substr(code, 1, 4) AS region_code, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT katottg) AS BIGINT) AS entities FROM links
    WHERE code NOT IN (SELECT katottg FROM corpus_growth_priority WHERE katottg IS NOT NULL) GROUP BY region_code""",
)
def neighbour_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Links to entities that aren't listed themselves, by the region in their code."""
    rows = table(spark, folder, "corpus_growth_priority").where("katottg IS NOT NULL")
    links = rows.select("katottg", F.explode("corpusneighbourcodes").alias("code")).distinct()
    outside = links.join(rows.select(F.col("katottg").alias("code")).distinct(), "code", "left_anti")
    return outside.groupBy(F.substring("code", 1, 4).alias("region_code")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("katottg").alias("entities"))


@registry.add(
    "unique_name_join",
    f"""WITH {LATEST_SQL}, single AS (SELECT name, min(katottg) AS katottg FROM latest GROUP BY name HAVING count(*) = 1)
    SELECT portal_id, s.katottg, p.katottg IS NULL AS had_no_code FROM hromada_portals p JOIN single s USING (name)""",
)
def unique_name_join(spark: SparkSession, folder: str) -> DataFrame:
    """Codes for rows that have a name only; names of more than one entity give none."""
    single = latest_entities(spark, folder, "name").groupBy("name").agg(F.min("katottg").alias("code"), F.count(F.lit(1)).alias("n")).where("n = 1")
    joined = table(spark, folder, "hromada_portals").select("portal_id", "name", "katottg").join(single.select("name", "code"), "name")
    return joined.select("portal_id", F.col("code").alias("katottg"), F.col("katottg").isNull().alias("had_no_code"))


@registry.add(
    "coded_or_named",
    f"""WITH {LATEST_SQL}, single AS (SELECT name, min(katottg) AS katottg FROM latest GROUP BY name HAVING count(*) = 1)
    SELECT portal_id, coalesce(l.katottg, s.katottg) AS katottg, CASE WHEN l.katottg IS NOT NULL THEN 'code' WHEN s.katottg IS NOT NULL THEN 'name' ELSE 'none' END AS how
    FROM hromada_portals p LEFT JOIN latest l ON l.katottg = p.katottg LEFT JOIN single s ON s.name = p.name""",
)
def coded_or_named(spark: SparkSession, folder: str) -> DataFrame:
    """Lookup by code first, then by a name that only one entity has."""
    latest = latest_entities(spark, folder, "name")
    single = latest.groupBy("name").agg(F.min("katottg").alias("named"), F.count(F.lit(1)).alias("n")).where("n = 1").select("name", "named")
    rows = table(spark, folder, "hromada_portals").select("portal_id", "name", F.col("katottg").alias("code"))
    joined = rows.join(latest.select(F.col("katottg").alias("code"), F.col("katottg").alias("coded")), "code", "left").join(single, "name", "left")
    how = F.when(F.col("coded").isNotNull(), "code").when(F.col("named").isNotNull(), "name").otherwise("none")
    return joined.select("portal_id", F.coalesce("coded", "named").alias("katottg"), how.alias("how"))


@registry.add(
    "seed_resolution",
    f"""WITH {LATEST_SQL}, seeds AS (SELECT cand_id, a, a_katottg FROM known_curation_candidates),
    coded AS (SELECT katottg FROM latest), named AS (SELECT name, count(*) AS n, min(katottg) AS k FROM latest GROUP BY name),
    worded AS (SELECT split_part(trim(name), ' ', 1) AS w, count(*) AS n, min(katottg) AS k FROM latest GROUP BY w)
    SELECT cand_id, coalesce(c.katottg, CASE WHEN m.n = 1 THEN m.k END, CASE WHEN m.n IS NULL AND w.n = 1 THEN w.k END) AS katottg,
    CASE WHEN c.katottg IS NOT NULL THEN 'code' WHEN m.n = 1 THEN 'name' WHEN m.n > 1 THEN 'ambiguous' WHEN w.n = 1 THEN 'word' WHEN w.n > 1 THEN 'ambiguous' ELSE 'none' END AS stage
    FROM seeds s LEFT JOIN coded c ON c.katottg = s.a_katottg LEFT JOIN named m ON m.name = s.a LEFT JOIN worded w ON w.w = split_part(trim(s.a), ' ', 1)""",
)
def seed_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds by exact code, exact name, then first word; more than one hit is ambiguous."""
    latest = latest_entities(spark, folder, "name")
    once = lambda key, n, k: latest.groupBy(key).agg(F.count(F.lit(1)).alias(n), F.min("katottg").alias(k))
    named = once(F.col("name").alias("a"), "names", "by_name")
    worded = once(X.first_word(F.col("name")).alias("word"), "words", "by_word")
    seeds = table(spark, folder, "known_curation_candidates").select("cand_id", "a", "a_katottg", X.first_word(F.col("a")).alias("word"))
    coded = latest.select(F.col("katottg").alias("a_katottg"), F.col("katottg").alias("by_code"))
    joined = seeds.join(coded, "a_katottg", "left").join(named, "a", "left").join(worded, "word", "left")
    stage = (
        F.when(F.col("by_code").isNotNull(), "code").when(F.col("names") == 1, "name").when(F.col("names") > 1, "ambiguous")
        .when(F.col("words") == 1, "word").when(F.col("words") > 1, "ambiguous").otherwise("none")
    )
    code = F.coalesce("by_code", F.when(F.col("names") == 1, F.col("by_name")), F.when(F.col("names").isNull() & (F.col("words") == 1), F.col("by_word")))
    return joined.select("cand_id", code.alias("katottg"), stage.alias("stage"))


@registry.add(
    "name_order",
    f"WITH {LATEST_SQL} SELECT katottg, name, CAST(row_number() OVER (ORDER BY name COLLATE uk, katottg) AS BIGINT) AS place FROM latest",
)
def name_order(spark: SparkSession, folder: str) -> DataFrame:
    """All names in the order of the Ukrainian alphabet, with their places."""
    latest = latest_entities(spark, folder, "name").select("katottg", "name")
    return global_rank(latest, [F.collate("name", "uk"), F.col("katottg")], "place")


@registry.add(
    "sector_histogram",
    f"""WITH {LATEST_SQL} SELECT oblast, sector, CAST(n AS BIGINT) AS n, CAST(rn AS INTEGER) AS place FROM (
      SELECT oblast, sector, count(*) AS n, row_number() OVER (PARTITION BY oblast ORDER BY count(*) DESC, sector) AS rn FROM (
        SELECT oblast, unnest(list_distinct(sectors)) AS sector FROM latest) GROUP BY oblast, sector) WHERE rn <= 5""",
)
def sector_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """The five commonest sectors of each region, ties by name."""
    counted = (
        latest_entities(spark, folder, "oblast", "sectors")
        .select("oblast", F.explode(F.array_distinct("sectors")).alias("sector"))
        .groupBy("oblast", "sector")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("oblast").orderBy(F.desc("n"), "sector"))
    return counted.withColumn("place", place).where("place <= 5")


@registry.add(
    "sector_totals",
    f"""WITH {LATEST_SQL}, counted AS (SELECT sector, count(*) AS n FROM (SELECT unnest(list_distinct(sectors)) AS sector FROM latest) GROUP BY sector),
    pinned AS (SELECT unnest(['Спадщина', 'Ремесла', 'Космос']) AS sector)
    SELECT * FROM (SELECT sector, CAST(n AS BIGINT) AS n FROM counted ORDER BY n DESC, sector LIMIT 16)
    UNION SELECT p.sector, CAST(coalesce(n, 0) AS BIGINT) FROM pinned p LEFT JOIN counted USING (sector)""",
)
def sector_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The sixteen commonest sectors, and three pinned ones even if nobody has them."""
    counted = latest_entities(spark, folder, "sectors").select(F.explode(F.array_distinct("sectors")).alias("sector")).groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    pinned = spark.createDataFrame([("Спадщина",), ("Ремесла",), ("Космос",)], "sector string")
    top = counted.orderBy(F.desc("n"), "sector").limit(16)
    return top.union(pinned.join(counted, "sector", "left").select("sector", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))).distinct()


@registry.add(
    "shared_sectors",
    f"""WITH {LATEST_SQL} SELECT oblast, list_sort(list_distinct(flatten(list(sectors)))) AS all_sectors, CAST(max(len(list_distinct(sectors))) AS INTEGER) AS most,
    CAST(count(*) FILTER (len(list_intersect(sectors, ['Дороги', 'Медицина'])) = 2) AS BIGINT) AS with_both FROM latest GROUP BY oblast""",
)
def shared_sectors(spark: SparkSession, folder: str) -> DataFrame:
    """Union of the sectors of a region, the most of one entity, and entities with two given ones."""
    both = F.size(F.array_intersect("sectors", F.array(F.lit("Дороги"), F.lit("Медицина")))) == 2
    rows = latest_entities(spark, folder, "oblast", "sectors").select("oblast", F.array_distinct("sectors").alias("own"), both.alias("both"))
    # collect_set of the exploded sectors is bounded by the number of sectors
    unions = rows.select("oblast", F.explode_outer("own").alias("s")).groupBy("oblast").agg(F.array_sort(F.collect_set("s")).alias("all_sectors"))
    sizes = rows.groupBy("oblast").agg(F.max(F.size("own")).alias("most"), F.count_if("both").alias("with_both"))
    return unions.join(sizes, "oblast")
