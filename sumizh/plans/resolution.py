"""Queries that resolve names, codes and addresses against a list, in stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.functions import names as N
from sumizh.functions import text as X
from sumizh.operators.ranking import first_of
from sumizh.plans.entities import LATEST_SQL, latest_entities
from sumizh.plans.registry import registry
from sumizh.sources.tables import table

#: Letters that a beginning must have to count as one.
LEAST = 5
_WORD_SQL = "split_part(regexp_replace(trim(translate(lower(name), '’ʼ`´', ''''''''''), ' '), '\\s+', ' ', 'g'), ' ', 1)"
_PORTALS_SQL = f"portals AS (SELECT portal_id, oblast, {_WORD_SQL} AS word FROM hromada_portals WHERE name IS NOT NULL)"
_LISTED_SQL = f"{LATEST_SQL}, listed AS (SELECT katottg, oblast, name, {_WORD_SQL} AS word FROM latest)"


def _word(name: str = "name") -> Column:
    return X.first_word(X.normal_name(F.col(name)))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    return latest_entities(spark, folder, "name", "oblast").withColumn("word", _word())


def beginnings(word: Column, least: int = LEAST) -> Column:
    """All beginnings of a word that are shorter than it and have so many letters at least."""
    return F.when(F.length(word) > least, F.transform(F.sequence(F.lit(least), F.length(word) - 1), lambda n: F.left(word, n))).otherwise(F.array().cast("array<string>"))


def beginning_pairs(left: DataFrame, right: DataFrame, word: str) -> DataFrame:
    """Rows of two tables whose words are equal, or one of which begins with the other.

    A word meets its equals, then the beginnings of either side meet the whole words of
    the other: three joins on equality, and no comparison of all with all.
    """
    keyed_l, keyed_r = left.withColumnRenamed(word, "l_word"), right.withColumnRenamed(word, "r_word")
    equal = keyed_l.withColumn("key", F.col("l_word")).join(keyed_r.withColumn("key", F.col("r_word")), "key").withColumn("how", F.lit("equal"))
    longer = keyed_l.withColumn("key", F.explode(beginnings(F.col("l_word")))).join(keyed_r.withColumn("key", F.col("r_word")), "key").withColumn("how", F.lit("longer"))
    shorter = keyed_l.withColumn("key", F.col("l_word")).where(F.length("l_word") >= LEAST).join(keyed_r.withColumn("key", F.explode(beginnings(F.col("r_word")))), "key").withColumn("how", F.lit("shorter"))
    return equal.unionByName(longer).unionByName(shorter).drop("key")


@registry.add(
    "prefix_resolution",
    f"""WITH {_LISTED_SQL}, {_PORTALS_SQL}, met AS (SELECT portal_id, katottg, p.word = l.word AS same, p.oblast = l.oblast AS near FROM portals p JOIN listed l ON p.word = l.word
      OR (length(l.word) >= {LEAST} AND starts_with(p.word, l.word)) OR (length(p.word) >= {LEAST} AND starts_with(l.word, p.word))),
    counted AS (SELECT portal_id, count(DISTINCT katottg) FILTER (same AND near) AS a, count(DISTINCT katottg) FILTER (same) AS b, count(DISTINCT katottg) FILTER (near) AS c, count(DISTINCT katottg) AS d,
      min(katottg) FILTER (same AND near) AS ka, min(katottg) FILTER (same) AS kb, min(katottg) FILTER (near) AS kc, min(katottg) AS kd FROM met GROUP BY portal_id)
    SELECT portal_id, CASE WHEN a = 1 THEN ka WHEN b = 1 THEN kb WHEN c = 1 THEN kc WHEN d = 1 THEN kd END AS katottg,
    CASE WHEN a = 1 THEN 'name in region' WHEN b = 1 THEN 'name' WHEN c = 1 THEN 'beginning in region' WHEN d = 1 THEN 'beginning' WHEN d > 1 THEN 'ambiguous' ELSE 'none' END AS how FROM portals LEFT JOIN counted USING (portal_id)""",
)
def prefix_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Portals by equal first word, then by one word that begins the other, within the region first; only one hit counts."""
    portals = table(spark, folder, "hromada_portals").where("name IS NOT NULL").select("portal_id", "oblast", _word().alias("word"))
    met = beginning_pairs(portals, _listed(spark, folder).select("katottg", F.col("oblast").alias("at"), "word"), "word")
    same, near = F.col("how") == "equal", F.col("oblast") == F.col("at")
    steps = [("name in region", same & near), ("name", same), ("beginning in region", near), ("beginning", F.lit(True))]
    of = lambda c: F.when(c, F.col("katottg"))
    counted = met.groupBy("portal_id").agg(*(x for i, (_, c) in enumerate(steps) for x in (F.count_distinct(of(c)).alias(f"n{i}"), F.min(of(c)).alias(f"k{i}"))))
    joined = portals.select("portal_id").join(counted, "portal_id", "left")
    code = reduce(lambda c, i: c.when(F.col(f"n{i}") == 1, F.col(f"k{i}")), range(1, 4), F.when(F.col("n0") == 1, F.col("k0")))
    how = reduce(lambda c, i: c.when(F.col(f"n{i}") == 1, steps[i][0]), range(1, 4), F.when(F.col("n0") == 1, steps[0][0]))
    return joined.select("portal_id", code.alias("katottg"), how.when(F.col("n3") > 1, "ambiguous").otherwise("none").alias("how"))


# Ukrainian letters in the Latin transcription of official titles.
LATIN = dict(
    zip(
        "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя'",
        "a b v h g d e ie zh z y i i i k l m n o p r s t u f kh ts ch sh shch  iu ia ".split(" "),
    )
)
_LATIN_SQL = "word"
for _letter, _sound in LATIN.items():
    _LATIN_SQL = f"replace({_LATIN_SQL}, '{_letter * 2 if _letter == chr(39) else _letter}', '{_sound}')"


@registry.add(
    "latin_titles",
    f"""WITH {_LISTED_SQL}, t AS (SELECT katottg, oblast, {_LATIN_SQL} AS latin FROM listed), cards AS (SELECT card_id, lower(title) AS low FROM gisrr_cards WHERE NOT regexp_matches(title, '[А-Яа-яІіЇїЄєҐґ]')),
    words AS (SELECT DISTINCT card_id, unnest(regexp_extract_all(low, '[a-z]{{{LEAST},}}')) AS word FROM cards),
    met AS (SELECT w.card_id, t.katottg, CASE WHEN c.low = latin THEN 0 WHEN starts_with(c.low, latin || ' ') THEN 1 ELSE 2 END AS stage FROM words w JOIN t ON t.latin = w.word JOIN cards c ON c.card_id = w.card_id),
    best AS (SELECT card_id, stage, count(DISTINCT katottg) AS n, min(katottg) AS katottg, row_number() OVER (PARTITION BY card_id ORDER BY stage) AS r FROM met GROUP BY card_id, stage)
    SELECT c.card_id, CASE WHEN n = 1 THEN katottg END AS katottg, CASE WHEN n = 1 THEN ['equal', 'begins', 'within'][stage + 1] WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how
    FROM cards c LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.card_id = c.card_id""",
)
def latin_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles in Latin letters by the transcribed first word of a name: the whole title, its beginning, or a word within."""
    listed = _listed(spark, folder).select("katottg", N.transcribe(F.col("word"), LATIN).alias("key"))
    cards = table(spark, folder, "gisrr_cards").where(~F.col("title").rlike("[А-Яа-яІіЇїЄєҐґ]")).select("card_id", F.lower("title").alias("low"))
    words = cards.select("card_id", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(f"([a-z]{{{LEAST},}})"), 1))).alias("key"))
    stage = F.when(F.col("low") == F.col("key"), 0).when(F.startswith(F.col("low"), F.concat("key", F.lit(" "))), 1).otherwise(2)
    met = words.join(listed, "key").groupBy("card_id", stage.alias("stage")).agg(F.count_distinct("katottg").alias("n"), F.min("katottg").alias("katottg"))
    best = met.groupBy("card_id").agg(F.min(F.struct("stage", "n", "katottg")).alias("b")).select("card_id", "b.*")
    names = F.array(F.lit("equal"), F.lit("begins"), F.lit("within"))
    how = F.when(F.col("n") == 1, F.get(names, F.col("stage"))).when(F.col("n") > 1, "ambiguous").otherwise("none")
    return cards.select("card_id").join(best, "card_id", "left").select("card_id", F.when(F.col("n") == 1, F.col("katottg")).alias("katottg"), how.alias("how"))


#: Other spellings of regions, which are looked up first.
ALIASES = (("львівщина", "Львівська область"), ("київщина", "Київська область"))
_KIND_SQL = "CASE WHEN contains(lower(name), 'міськ') THEN 1 ELSE 0 END"


@registry.add(
    "staged_resolution",
    f"""WITH {_LISTED_SQL}, alias(low, region) AS (VALUES {", ".join(f"('{a}', '{r}')" for a, r in ALIASES)}),
    asked AS (SELECT growth_id, coalesce(region, oblast) AS oblast, {_WORD_SQL} AS word FROM corpus_growth_priority g LEFT JOIN alias ON low = lower(trim(g.oblast)) WHERE name IS NOT NULL),
    met AS (SELECT growth_id, katottg, a.oblast = l.oblast AS near, {_KIND_SQL.replace("name", "l.name")} AS town FROM asked a JOIN listed l USING (word)),
    counted AS (SELECT growth_id, count(*) FILTER (near) AS n0, min(katottg) FILTER (near) AS k0, count(*) AS n1, min(katottg) AS k1, count(*) FILTER (near AND town = 1) AS n2, min(katottg) FILTER (near AND town = 1) AS k2,
      count(*) FILTER (town = 1) AS n3, min(katottg) FILTER (town = 1) AS k3 FROM met GROUP BY growth_id)
    SELECT growth_id, CASE WHEN n0 = 1 THEN k0 WHEN n1 = 1 THEN k1 WHEN n2 = 1 THEN k2 WHEN n3 = 1 THEN k3 END AS katottg,
    CASE WHEN n0 = 1 THEN 'region' WHEN n1 = 1 THEN 'relaxed' WHEN n2 = 1 THEN 'town in region' WHEN n3 = 1 THEN 'town' WHEN n1 > 1 THEN 'ambiguous' ELSE 'none' END AS stage FROM asked LEFT JOIN counted USING (growth_id)""",
)
def staged_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Names by first word in stages: within the region (by alias), anywhere, then the only town of several; one hit settles."""
    aliases = spark.createDataFrame([*ALIASES], "low string, alias string")
    asked = table(spark, folder, "corpus_growth_priority").where("name IS NOT NULL").withColumn("low", F.lower(F.trim("oblast"))).join(F.broadcast(aliases), "low", "left")  # two rows
    asked = asked.select("growth_id", F.coalesce("alias", "oblast").alias("oblast"), _word().alias("word"))
    town = F.lower("name").contains("міськ")
    listed = _listed(spark, folder).select("katottg", F.col("oblast").alias("at"), "word", town.alias("town"))
    # by word and region first, so that a common word is counted, not multiplied
    of = lambda c: F.when(c, F.col("katottg"))
    regional = listed.groupBy("word", "at").agg(F.count(F.lit(1)).alias("n0"), F.min("katottg").alias("k0"), F.count(of(F.col("town"))).alias("n2"), F.min(of(F.col("town"))).alias("k2"))
    anywhere = listed.groupBy("word").agg(F.count(F.lit(1)).alias("n1"), F.min("katottg").alias("k1"), F.count(of(F.col("town"))).alias("n3"), F.min(of(F.col("town"))).alias("k3"))
    joined = asked.join(regional.withColumnRenamed("at", "oblast"), ["word", "oblast"], "left").join(anywhere, "word", "left")
    steps = ["region", "relaxed", "town in region", "town"]
    code = reduce(lambda c, i: c.when(F.col(f"n{i}") == 1, F.col(f"k{i}")), range(1, 4), F.when(F.col("n0") == 1, F.col("k0")))
    stage = reduce(lambda c, i: c.when(F.col(f"n{i}") == 1, steps[i]), range(1, 4), F.when(F.col("n0") == 1, steps[0]))
    return joined.select("growth_id", code.alias("katottg"), stage.when(F.col("n1") > 1, "ambiguous").otherwise("none").alias("stage"))


@registry.add(
    "two_key_match",
    f"""WITH {_LISTED_SQL}, full_key AS (SELECT name, oblast, min(katottg) AS k FROM latest GROUP BY 1, 2), loose AS (SELECT word, oblast, min(katottg) AS k FROM listed GROUP BY 1, 2),
    asked AS (SELECT id, name, oblast, {_WORD_SQL} AS word FROM hromadas_full30)
    SELECT id, coalesce(f.k, l.k) AS katottg, CASE WHEN f.k IS NOT NULL THEN 'exact' WHEN l.k IS NOT NULL THEN 'loose' ELSE 'none' END AS quality
    FROM asked a LEFT JOIN full_key f ON f.name = a.name AND f.oblast = a.oblast LEFT JOIN loose l ON l.word = a.word AND l.oblast = a.oblast""",
)
def two_key_match(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by whole name and region, else by first word and region, with the quality of the match."""
    listed = _listed(spark, folder)
    whole = listed.groupBy("name", "oblast").agg(F.min("katottg").alias("exact"))
    loose = listed.groupBy("word", "oblast").agg(F.min("katottg").alias("loose"))
    asked = table(spark, folder, "hromadas_full30").select("id", "name", "oblast", _word().alias("word"))
    joined = asked.join(whole, ["name", "oblast"], "left").join(loose, ["word", "oblast"], "left")
    quality = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "loose").otherwise("none")
    return joined.select("id", F.coalesce("exact", "loose").alias("katottg"), quality.alias("quality"))


@registry.add(
    "settlement_codes",
    """WITH s AS (SELECT code AS settlement, katottg AS entity, 1 AS p FROM (SELECT katottg, unnest(corpusneighbourcodes) AS code FROM corpus_growth_priority WHERE katottg IS NOT NULL) WHERE code <> ''
      UNION ALL SELECT katottg, katottg, 0 FROM corpus_growth_priority WHERE katottg <> '')
    SELECT settlement, min_by(entity, (p, entity)) AS entity, CAST(min(p) AS INTEGER) AS priority FROM s GROUP BY settlement""",
)
def settlement_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The entity of each code: itself if it is one, else the first that names it as a neighbour."""
    rows = table(spark, folder, "corpus_growth_priority").where("katottg IS NOT NULL")
    own = rows.where("katottg <> ''").select(F.col("katottg").alias("settlement"), F.col("katottg").alias("entity"), F.lit(0).alias("priority"))
    others = rows.select(F.explode("corpusneighbourcodes").alias("settlement"), F.col("katottg").alias("entity"), F.lit(1).alias("priority")).where("settlement <> ''")
    return first_of(own.unionByName(others), ["settlement"], [("priority", False), ("entity", False)], ["entity", "priority"])


@registry.add(
    "first_addresses",
    f"""WITH {LATEST_SQL}, first AS (SELECT katottg, min_by(portalurl, portal_id) AS url FROM hromada_portals WHERE katottg IS NOT NULL AND portalurl IS NOT NULL GROUP BY katottg)
    SELECT katottg, coalesce(url, 'none') AS url FROM latest LEFT JOIN first USING (katottg)""",
)
def first_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """The first address that the portals give for each entity."""
    urls = first_of(table(spark, folder, "hromada_portals").where("katottg IS NOT NULL AND portalurl IS NOT NULL"), ["katottg"], [("portal_id", False)], ["portalurl"])
    return latest_entities(spark, folder).join(urls, "katottg", "left").select("katottg", F.coalesce("portalurl", F.lit("none")).alias("url"))


@registry.add(
    "archived_addresses",
    r"""WITH u AS (SELECT portal_id, 'https://web.archive.org/web/2024' || lpad((portal_id % 1000)::VARCHAR, 10, '0') || CASE WHEN portal_id % 2 = 0 THEN 'if_' ELSE '' END || '/' || strategyurl AS url FROM hromada_portals WHERE portal_id % 3 <> 0
      UNION ALL SELECT portal_id, strategyurl FROM hromada_portals WHERE portal_id % 3 = 0), w AS (SELECT portal_id, coalesce(nullif(regexp_extract(url, '^https?://web\.archive\.org/web/[0-9]+(?:[a-z]{2}_)?/(.*)$', 1), ''), url) AS original, url FROM u)
    SELECT portal_id, original, url <> original AS archived, nullif(regexp_extract(lower(trim(original)), '^(?:https?://)?(?:www\.)?([^/?#:]+)', 1), '') AS host FROM w""",
)
def archived_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """The address in that of an archived copy, and its host; two in three addresses are given as archived ones."""
    rows = table(spark, folder, "hromada_portals")
    stamp = F.concat(F.lit("https://web.archive.org/web/2024"), F.lpad((F.col("portal_id") % 1000).cast("string"), 10, "0"), F.when(F.col("portal_id") % 2 == 0, "if_").otherwise(""), F.lit("/"))
    url = F.when(F.col("portal_id") % 3 != 0, F.concat(stamp, F.col("strategyurl"))).otherwise(F.col("strategyurl"))
    unwrapped = rows.select("portal_id", url.alias("url"), X.unarchived(url).alias("original"))
    return unwrapped.select("portal_id", "original", (F.col("url") != F.col("original")).alias("archived"), X.host(F.col("original")).alias("host"))


# Reasons for which a name is no entity, the first that fits.
SKIPS = (("district", "район"), ("enterprise", "водоканал|комунальн"), ("capital", "^(?:м\\. ?)?київ$"))


@registry.add(
    "skipped_names",
    f"""SELECT card_id, CASE {" ".join(f"WHEN regexp_matches(lower(trim(title)), '{p}') THEN '{n}'" for n, p in SKIPS)} ELSE 'kept' END AS reason FROM gisrr_cards""",
)
def skipped_names(spark: SparkSession, folder: str) -> DataFrame:
    """Why a title is no entity, by the first rule that fits."""
    low = F.lower(F.trim("title"))
    reason = reduce(lambda c, r: c.when(low.rlike(r[1]), r[0]), SKIPS[1:], F.when(low.rlike(SKIPS[0][1]), SKIPS[0][0]))
    return table(spark, folder, "gisrr_cards").select("card_id", reason.otherwise("kept").alias("reason"))


@registry.add(
    "release_universe",
    f"WITH {LATEST_SQL} SELECT portal_id FROM hromada_portals p WHERE CASE WHEN katottg IS NOT NULL THEN katottg IN (SELECT katottg FROM latest) ELSE NOT contains(lower(coalesce(oblast, '')), 'крим') END",
)
def release_universe(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the released entities; rows without a code stay unless their region is left out by name."""
    rows = table(spark, folder, "hromada_portals")
    coded = rows.join(latest_entities(spark, folder), "katottg", "left_semi").select("portal_id")
    return coded.unionByName(rows.where(F.col("katottg").isNull() & ~F.lower(F.coalesce("oblast", F.lit(""))).contains("крим")).select("portal_id"))


@registry.add(
    "staged_union",
    f"""WITH {LATEST_SQL}, registry AS (SELECT DISTINCT program AS name, lower(program) AS key, kind, since_year FROM donor_programs),
    strategy AS (SELECT key, min(name) AS name FROM (SELECT trim(p) AS name, lower(trim(p)) AS key FROM (SELECT unnest(string_split_regex(donorsprograms, '[,;]')) AS p FROM latest) WHERE trim(p) <> '') GROUP BY key),
    news AS (SELECT key, min(name) AS name FROM (SELECT regexp_extract(donorsprograms, '«([^«»]+)»', 1) AS name, lower(regexp_extract(donorsprograms, '«([^«»]+)»', 1)) AS key FROM hromadas WHERE contains(donorsprograms, '«')) WHERE key <> '' GROUP BY key)
    SELECT name, kind, since_year, 'registry' AS source FROM registry UNION ALL SELECT name, NULL, NULL, 'strategy' FROM strategy WHERE key NOT IN (SELECT key FROM registry)
    UNION ALL SELECT name, NULL, NULL, 'quoted' FROM news WHERE key NOT IN (SELECT key FROM registry) AND key NOT IN (SELECT key FROM strategy)""",
)
def staged_union(spark: SparkSession, folder: str) -> DataFrame:
    """Programmes of three sources, each once by a key of its own source; an earlier source goes before a later one."""
    listed = table(spark, folder, "donor_programs").select(F.col("program").alias("name"), "kind", "since_year").distinct().withColumn("key", F.lower("name"))
    typed = latest_entities(spark, folder, "donorsprograms").select(F.explode(X.programmes(F.col("donorsprograms"))).alias("name"))
    quoted = table(spark, folder, "hromadas").select(F.regexp_extract("donorsprograms", "«([^«»]+)»", 1).alias("name")).where("name <> ''")
    once = lambda d: d.withColumn("key", F.lower("name")).groupBy("key").agg(F.min("name").alias("name"))
    strategy = once(typed).join(listed.select("key"), "key", "left_anti")
    news = once(quoted).join(listed.select("key"), "key", "left_anti").join(strategy.select("key"), "key", "left_anti")
    plain = lambda d, s: d.select("name", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("since_year"), F.lit(s).alias("source"))
    return listed.select("name", "kind", "since_year", F.lit("registry").alias("source")).unionByName(plain(strategy, "strategy")).unionByName(plain(news, "quoted"))


@registry.add(
    "edge_agreements",
    """WITH g AS (SELECT least(a_katottg, b_katottg) AS a, greatest(a_katottg, b_katottg) AS b, oblast_a = oblast_b AS same, unnest(agreements) AS g FROM known_curation_candidates WHERE a_katottg <> b_katottg),
    each AS (SELECT a, b, bool_or(same) AS same, coalesce(g.n, g.title) AS ref, min(coalesce(g.date, '9')) AS d FROM g WHERE g IS NOT NULL AND coalesce(g.n, g.title) IS NOT NULL GROUP BY a, b, ref),
    edges AS (SELECT a, b, bool_or(same) AS same, CAST(count(*) AS BIGINT) AS n, list(ref ORDER BY d, ref)[1:3] AS first_refs FROM each GROUP BY a, b)
    SELECT a, b, same, n, first_refs FROM edges ORDER BY n DESC, same DESC, a, b LIMIT 40""",
)
def edge_agreements(spark: SparkSession, folder: str) -> DataFrame:
    """The forty links with most agreements, those within a region first if equal, with the three earliest of each."""
    rows = table(spark, folder, "known_curation_candidates").where("a_katottg <> b_katottg")
    each = rows.select(F.least("a_katottg", "b_katottg").alias("a"), F.greatest("a_katottg", "b_katottg").alias("b"), (F.col("oblast_a") == F.col("oblast_b")).alias("same"), F.explode("agreements").alias("g"))
    each = each.withColumn("ref", F.coalesce("g.n", "g.title")).where("ref IS NOT NULL").groupBy("a", "b", "ref").agg(F.bool_or("same").alias("same"), F.min(F.coalesce("g.date", F.lit("9"))).alias("d"))
    top = each.groupBy("a", "b").agg(F.bool_or("same").alias("same"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("same"), "a", "b").limit(40)
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("d", "ref"))
    first = each.join(F.broadcast(top.select("a", "b")), ["a", "b"]).withColumn("r", place).where("r <= 3")  # forty rows
    refs = first.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("r", "ref"))).alias("x"))
    return top.join(refs, ["a", "b"]).select("a", "b", "same", "n", F.col("x")["ref"].alias("first_refs"))


@registry.add(
    "region_proximity",
    f"""WITH {LATEST_SQL}, numbered AS (SELECT oblast, dense_rank() OVER (ORDER BY oblast) AS n FROM (SELECT DISTINCT oblast FROM latest)), adjacent AS (SELECT p.oblast AS x, q.oblast AS y FROM numbered p JOIN numbered q ON abs(p.n - q.n) = 1)
    SELECT cand_id, CASE WHEN oblast_a = oblast_b THEN 1.0::DOUBLE WHEN x IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS proximity,
    round(0.6::DOUBLE * goals_cosine + 0.4::DOUBLE * CASE WHEN oblast_a = oblast_b THEN 1.0 WHEN x IS NOT NULL THEN 0.5 ELSE 0.0 END, 6) AS score
    FROM known_curation_candidates LEFT JOIN adjacent ON x = oblast_a AND y = oblast_b""",
)
def region_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """One region 1, adjacent ones .5, others 0, and with the goals in one score; regions beside each other in the alphabet stand for adjacent ones."""
    regions = latest_entities(spark, folder, "oblast").select("oblast").distinct().withColumn("n", F.row_number().over(Window.orderBy("oblast")))  # a row for each region
    beside = regions.withColumn("n", F.explode(F.array(F.col("n") - 1, F.col("n") + 1))).withColumnRenamed("oblast", "oblast_a")
    adjacent = beside.join(regions.withColumnRenamed("oblast", "oblast_b"), "n").select("oblast_a", "oblast_b", F.lit(0.5).alias("half"))
    rows = table(spark, folder, "known_curation_candidates").join(adjacent, ["oblast_a", "oblast_b"], "left")
    proximity = F.when(F.col("oblast_a") == F.col("oblast_b"), 1.0).otherwise(F.coalesce("half", F.lit(0.0)))
    return rows.select("cand_id", proximity.alias("proximity"), F.round(0.6 * F.col("goals_cosine") + 0.4 * proximity, 6).alias("score"))
