"""Queries over lines of goals of two ends: closest pairs, near duplicates, explanations, themes."""

from __future__ import annotations

import difflib
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumizh.functions import text as X
from sumizh.plans.entities import LATEST_SQL, latest_entities
from sumizh.plans.registry import registry
from sumizh.sources.tables import table

# Stems that two lines must share, how alike they must be, what a common sector adds, pairs shown.
SHARED, LIKE, BONUS, SHOWN = 3, 0.18, 0.05, 3
#: Ratio from which two lines are near duplicates, and what both must exceed in length.
NEAR, LONG = 0.75, 20
#: Beginnings of words that say nothing.
STOPS = ("грома", "терит", "розви", "забез", "створ")
#: Stems by sector.
SECTORS = (("roads", "дорог|вулиц|міст"), ("water", "вод|каналіз"), ("health", "медиц|лікар|амбул"), ("culture", "культур|клуб|бібліот"), ("school", "школ|ліце|освіт"))

_CLEAN = "trim(regexp_replace(trim(regexp_replace(line, '^(?:Стратегічна ціль|Ціль)?\\s*[0-9]+(?:\\.[0-9]+)*[.:)]?\\s*', '')), '[ .;:-]+$', ''))"
_STEMS_SQL = f"list_distinct(list_filter(list_transform(regexp_extract_all(lower(body), '([\\p{{L}}]{{4,}})'), lambda w: left(w, 6)), lambda w: NOT regexp_matches(w, '^(?:{'|'.join(STOPS)})')))"
_SECTOR_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(body), '{p}') THEN '{n}' END" for n, p in SECTORS) + "], lambda s: s IS NOT NULL)"
_PREPARED_SQL = f"""{LATEST_SQL}, raw AS (SELECT katottg, unnest(list_distinct(list_filter(list_transform(string_split(goals, chr(10)), lambda x: trim(x, ' ' || chr(9) || '-•' || chr(13) || chr(10))), lambda x: length(x) > 15))) AS line FROM latest WHERE goals IS NOT NULL),
    clean AS (SELECT DISTINCT katottg, {_CLEAN} AS body FROM raw), ready AS (SELECT katottg, body, {_STEMS_SQL} AS stems, {_SECTOR_SQL} AS sectors FROM clean WHERE body <> ''),
    met AS (SELECT cand_id, x.body AS line_a, y.body AS line_b, len(list_intersect(x.stems, y.stems)) AS shared, len(list_distinct(x.stems || y.stems)) AS every, lower(x.body) = lower(y.body) AS same, len(list_intersect(x.sectors, y.sectors)) > 0 AS sector
      FROM known_curation_candidates c JOIN ready x ON x.katottg = a_katottg JOIN ready y ON y.katottg = b_katottg WHERE a_katottg <> b_katottg AND len(x.stems) >= {SHARED} AND len(y.stems) >= {SHARED}),
    rated AS (SELECT *, round(CASE WHEN same THEN 1.0 ELSE shared / every::DOUBLE END + CASE WHEN sector THEN {BONUS}::DOUBLE ELSE 0 END, 6) AS score FROM met WHERE shared >= {SHARED} AND (same OR shared / every::DOUBLE >= {LIKE}::DOUBLE)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, shared DESC, line_a, line_b) AS place FROM rated)"""


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    """(katottg, lines): the cleaned lines of the goals with their stems and sectors; one entity's lines are one row."""
    body = lambda line: F.trim(F.regexp_replace(X.clean_line(line), "[ .;:-]+$", ""))
    lines = F.array_distinct(F.transform(X.goal_lines(F.col("goals")), body))
    stems = lambda b: F.filter(X.word_stems(b), lambda w: ~w.rlike(f"^(?:{'|'.join(STOPS)})"))
    sectors = lambda b: F.array_compact(F.array(*(F.when(F.lower(b).rlike(p), n) for n, p in SECTORS)))
    ready = F.transform(F.filter(lines, lambda b: b != ""), lambda b: F.struct(b.alias("body"), stems(b).alias("stems"), sectors(b).alias("sectors")))
    return latest_entities(spark, folder, "goals").where("goals IS NOT NULL").select("katottg", ready.alias("lines"))


def line_pairs(a: Column, b: Column) -> Column:
    """All pairs of lines of two arrays that are alike enough, best first: (minus_score, minus_shared, line_a, line_b)."""

    def rated(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x["stems"], y["stems"]))
        same = F.lower(x["body"]) == F.lower(y["body"])
        like = shared / F.size(F.array_union(x["stems"], y["stems"]))
        score = F.round(F.when(same, 1.0).otherwise(like) + F.when(F.arrays_overlap(x["sectors"], y["sectors"]), BONUS).otherwise(0.0), 6)
        ok = (shared >= SHARED) & (same | (like >= LIKE))
        return F.when(ok, F.struct((-score).alias("minus_score"), (-shared).alias("minus_shared"), x["body"].alias("line_a"), y["body"].alias("line_b")))

    usable = lambda c: F.filter(c, lambda x: F.size(x["stems"]) >= SHARED)
    every = F.flatten(F.transform(usable(a), lambda x: F.transform(usable(b), lambda y: rated(x, y))))
    return F.array_sort(F.array_compact(every))


def _ends(spark: SparkSession, folder: str) -> DataFrame:
    lines = _prepared(spark, folder)
    side = lambda s: lines.select(F.col("katottg").alias(f"{s}_katottg"), F.col("lines").alias(f"{s}_lines"))
    rows = table(spark, folder, "known_curation_candidates").where("a_katottg <> b_katottg").select("cand_id", "a_katottg", "b_katottg")
    return rows.join(side("a"), "a_katottg").join(side("b"), "b_katottg")


@registry.add("closest_line_pairs", f"WITH {_PREPARED_SQL} SELECT cand_id, CAST(place AS INTEGER) AS place, line_a, line_b, score FROM placed WHERE place <= {SHOWN}")
def closest_line_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The three pairs of lines of both ends that share most stems; a common sector adds a little."""
    best = _ends(spark, folder).select("cand_id", F.posexplode(F.slice(line_pairs(F.col("a_lines"), F.col("b_lines")), 1, SHOWN)).alias("at", "p"))
    return best.select("cand_id", (F.col("at") + 1).alias("place"), "p.line_a", "p.line_b", (-F.col("p.minus_score")).alias("score"))


@registry.add(
    "overlap_reasons",
    f"""WITH {_PREPARED_SQL}, best AS (SELECT * FROM placed WHERE place = 1), sectors AS (SELECT katottg, list_sort(list_distinct(flatten(list(sectors)))) AS s FROM ready GROUP BY katottg)
    SELECT cand_id, list_intersect(x.s, y.s).list_sort() AS sectors, line_a, CASE WHEN lower(line_a) = lower(line_b) THEN 'same line' ELSE 'alike' END AS kind FROM best JOIN known_curation_candidates USING (cand_id) JOIN sectors x ON x.katottg = a_katottg JOIN sectors y ON y.katottg = b_katottg""",
)
def overlap_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why two ends are alike: the sectors of both, and their closest pair of lines."""
    of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.col(c)["sectors"])))
    rows = _ends(spark, folder).select("cand_id", F.array_sort(F.array_intersect(of("a_lines"), of("b_lines"))).alias("sectors"), F.get(line_pairs(F.col("a_lines"), F.col("b_lines")), F.lit(0)).alias("p"))
    kind = F.when(F.lower("p.line_a") == F.lower("p.line_b"), "same line").otherwise("alike")
    return rows.where("p IS NOT NULL").select("cand_id", "sectors", "p.line_a", kind.alias("kind"))


def closest_duplicate(a: list[str], b: list[str]) -> tuple[str, str, float] | None:
    """The pair of lines with the highest ratio of matching blocks above ``NEAR``; the first if equal."""
    best = None
    normal = lambda x: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", x.lower())).strip()
    left, right = ([(x, n) for x in lines if len(n := normal(x)) >= LONG] for lines in (a, b))
    matcher = difflib.SequenceMatcher(None)
    for y, ny in right:
        matcher.set_seq2(ny)
        for x, nx in left:
            matcher.set_seq1(nx)
            least = max(NEAR, best[2] if best else 0.0)
            if matcher.real_quick_ratio() > least and matcher.quick_ratio() > least and (ratio := matcher.ratio()) > least:
                best = (x, y, ratio)
    return best


@F.pandas_udf(T.StructType([T.StructField("line_a", T.StringType()), T.StructField("line_b", T.StringType()), T.StructField("ratio", T.DoubleType())]))
def _duplicate(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [closest_duplicate(list(x), list(y)) or (None, None, None) for x, y in zip(a, b)]
    return pd.DataFrame(found, columns=["line_a", "line_b", "ratio"])


@registry.add("near_duplicate_lines")
def near_duplicate_lines(spark: SparkSession, folder: str) -> DataFrame:
    """For each candidate the two lines that are nearly the same text, which speaks for a common template.

    The ratio of matching blocks isn't an edit distance, so that it needs Python.
    """
    lines = latest_entities(spark, folder, "goals").where("goals IS NOT NULL").select("katottg", X.goal_lines(F.col("goals")).alias("lines"))
    side = lambda s: lines.select(F.col("katottg").alias(f"{s}_katottg"), F.col("lines").alias(f"{s}_lines"))
    rows = table(spark, folder, "known_curation_candidates").where("a_katottg <> b_katottg").select("cand_id", "a_katottg", "b_katottg")
    ends = rows.join(side("a"), "a_katottg").join(side("b"), "b_katottg").select("cand_id", _duplicate("a_lines", "b_lines").alias("d"))
    return ends.where("d.ratio IS NOT NULL").select("cand_id", "d.line_a", "d.line_b", F.round("d.ratio", 6).alias("ratio"))


_KIND_SQL = "CASE WHEN regexp_matches(line, '^[0-9]+\\.[0-9]+') THEN 1 WHEN regexp_matches(line, '^(?:Стратегічна ціль|Ціль|[0-9]+\\.)') OR length(line) > 80 THEN 2 ELSE 3 END"


@registry.add(
    "record_subgoals",
    f"""WITH {LATEST_SQL}, l AS (SELECT katottg, unnest(kept) AS line, generate_subscripts(kept, 1) AS pos FROM (SELECT katottg, list_filter(list_transform(string_split(goals, chr(10)), lambda x: trim(x, ' ' || chr(9) || '-•' || chr(13) || chr(10))), lambda x: length(x) > 15) AS kept FROM latest)),
    k AS (SELECT *, {_KIND_SQL} AS kind FROM l)
    SELECT h.katottg, coalesce(CASE WHEN count(k.line) > 0 THEN list(k.line ORDER BY kind, pos) FILTER (k.line IS NOT NULL) END, [trim(any_value(h.goals))]) AS subgoals, CAST(count(*) FILTER (kind = 1) AS INTEGER) AS operational,
    CAST(count(*) FILTER (kind = 2) AS INTEGER) AS strategic FROM latest h LEFT JOIN k ON k.katottg = h.katottg WHERE trim(h.goals) <> '' GROUP BY h.katottg""",
)
def record_subgoals(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of an entity's goals, operational ones first, then strategic and other ones; the whole text where it has no line."""
    rows = latest_entities(spark, folder, "goals").where(F.trim("goals") != "").select("katottg", "goals", X.goal_lines(F.col("goals")).alias("lines"))
    of = lambda k: F.filter("lines", lambda x: X.line_kind(x) == k)
    parts = rows.select("katottg", "goals", of("operational").alias("o"), of("strategic").alias("s"), of("other").alias("r"))
    every = F.concat("o", "s", "r")
    return parts.select("katottg", F.when(F.size(every) > 0, every).otherwise(F.array(F.trim("goals"))).alias("subgoals"), F.size("o").alias("operational"), F.size("s").alias("strategic"))


# Themes of the tags of sectors, with points for each time one is met.
TAG_THEMES = (("Дороги", "transport"), ("Вода", "water"), ("Медицина", "health"), ("Освіта", "school"), ("Культура", "culture"))
POINTS = 8


@registry.add(
    "tag_themes",
    f"""WITH {LATEST_SQL}, m(tag, theme) AS (VALUES {", ".join(f"('{t}', '{n}')" for t, n in TAG_THEMES)}), tags AS (SELECT cand_id, unnest(coalesce(x.sectors, []) || coalesce(y.sectors, [])) AS tag
      FROM known_curation_candidates LEFT JOIN latest x ON x.katottg = a_katottg LEFT JOIN latest y ON y.katottg = b_katottg),
    points AS (SELECT cand_id, theme, {POINTS} * count(*) AS points FROM tags JOIN m USING (tag) GROUP BY 1, 2)
    SELECT cand_id, theme, CAST(points AS BIGINT) AS points FROM points QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY points DESC, theme) = 1""",
)
def tag_themes(spark: SparkSession, folder: str) -> DataFrame:
    """The theme that the tags of both ends speak for; each time a tag is met counts."""
    ends = latest_entities(spark, folder, "sectors")
    side = lambda s: ends.select(F.col("katottg").alias(f"{s}_katottg"), F.col("sectors").alias(f"s{s}"))
    rows = table(spark, folder, "known_curation_candidates").join(side("a"), "a_katottg", "left").join(side("b"), "b_katottg", "left")
    none = F.array().cast("array<string>")
    tags = F.concat(F.coalesce("sa", none), F.coalesce("sb", none))
    counts = rows.select("cand_id", F.explode(tags).alias("tag"))
    themes = F.create_map(*(F.lit(x) for pair in TAG_THEMES for x in pair))
    points = counts.withColumn("theme", F.try_element_at(themes, F.col("tag"))).where("theme IS NOT NULL").groupBy("cand_id", "theme").agg((POINTS * F.count(F.lit(1))).alias("points"))
    top = points.groupBy("cand_id").agg(F.min(F.struct((-F.col("points")).alias("minus"), "theme")).alias("t"))
    return top.select("cand_id", "t.theme", (-F.col("t.minus")).alias("points"))


# The first rule that fits gives the theme.
GUESSES = (("water", "вод|каналіз"), ("energy", "енерг|тепл"), ("health", "медиц|лікар"), ("school", "освіт|школ|ліце"), ("culture", "культур|клуб|бібліот"), ("transport", "дорог|транспорт|міст"), ("waste", "відход|сміт"), ("digital", "цифр"), ("economy", "економ|підприєм"))


@registry.add(
    "theme_guess",
    f"""SELECT row_id, CASE {" ".join(f"WHEN regexp_matches(lower(goals), '{p}') THEN '{n}'" for n, p in GUESSES)} ELSE 'other' END AS theme FROM hromadas WHERE goals IS NOT NULL""",
)
def theme_guess(spark: SparkSession, folder: str) -> DataFrame:
    """The theme of the goals by the first of nine rules that fits."""
    low = F.lower("goals")
    theme = reduce(lambda c, r: c.when(low.rlike(r[1]), r[0]), GUESSES[1:], F.when(low.rlike(GUESSES[0][1]), GUESSES[0][0])).otherwise("other")
    return table(spark, folder, "hromadas").where("goals IS NOT NULL").select("row_id", theme.alias("theme"))


_INTENT = "міжмуніцип|кооперац|співпрац|спільн"


@registry.add(
    "same_region_asks",
    f"""WITH {LATEST_SQL}, asks AS (SELECT katottg, row_id, oblast, name, list_sort(list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(goals), '{p}') THEN '{n}' END" for n, p in GUESSES)}], lambda t: t IS NOT NULL)) AS themes
      FROM latest WHERE regexp_matches(lower(goals), '{_INTENT}'))
    SELECT a.katottg AS asker, b.katottg AS partner, list_sort(list_intersect(a.themes, b.themes))[1] AS theme FROM asks a JOIN asks b ON a.oblast = b.oblast AND a.katottg <> b.katottg AND a.row_id % 100 = 0 AND len(list_intersect(a.themes, b.themes)) > 0""",
)
def same_region_asks(spark: SparkSession, folder: str) -> DataFrame:
    """Partners in one region that ask for cooperation too and share a theme, with the first theme shared.

    Askers are a query set, the entities whose row is divisible by 100; they meet the
    others by region and theme.
    """
    low = F.lower("goals")
    themes = F.array_sort(F.array_compact(F.array(*(F.when(low.rlike(p), n) for n, p in GUESSES))))
    asks = latest_entities(spark, folder, "row_id", "oblast", "goals").where(low.rlike(_INTENT)).select("katottg", "row_id", "oblast", F.explode(themes).alias("theme"))
    askers = asks.where("row_id % 100 = 0").select(F.col("katottg").alias("asker"), "oblast", "theme")
    met = askers.join(asks.select(F.col("katottg").alias("partner"), "oblast", "theme"), ["oblast", "theme"]).where("asker <> partner")
    return met.groupBy("asker", "partner").agg(F.min("theme").alias("theme"))


@registry.add(
    "endpoint_themes",
    f"""WITH {LATEST_SQL}, t AS (SELECT cand_id, lower(concat_ws(' ', x.goals, y.goals)) AS text, lower(x.goals) AS ga, lower(y.goals) AS gb FROM known_curation_candidates LEFT JOIN latest x ON x.katottg = a_katottg LEFT JOIN latest y ON y.katottg = b_katottg),
    hits AS (SELECT cand_id, text, list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in GUESSES)}], lambda t: t IS NOT NULL) AS themes, coalesce(regexp_matches(ga, '{dict(GUESSES)["transport"]}'), FALSE) AND coalesce(regexp_matches(gb, '{dict(GUESSES)["transport"]}'), FALSE) AS in_both FROM t)
    SELECT cand_id, coalesce(CASE WHEN in_both THEN 'transport' END, list_filter(themes, lambda t: t <> 'transport')[1], 'other') AS theme, NOT in_both AND list_contains(themes, 'transport') AS downgraded FROM hits""",
)
def endpoint_themes(spark: SparkSession, folder: str) -> DataFrame:
    """The theme of the goals of both ends together; one theme asks for both ends, else the next one is picked."""
    ends = latest_entities(spark, folder, "goals")
    side = lambda s: ends.select(F.col("katottg").alias(f"{s}_katottg"), F.lower("goals").alias(f"g{s}"))
    rows = table(spark, folder, "known_curation_candidates").select("cand_id", "a_katottg", "b_katottg").join(side("a"), "a_katottg", "left").join(side("b"), "b_katottg", "left")
    text, asks = F.concat_ws(" ", "ga", "gb"), dict(GUESSES)["transport"]
    themes = F.array_compact(F.array(*(F.when(text.rlike(p), n) for n, p in GUESSES)))
    both = F.coalesce(F.col("ga").rlike(asks), F.lit(False)) & F.coalesce(F.col("gb").rlike(asks), F.lit(False))
    hits = rows.select("cand_id", themes.alias("themes"), both.alias("both"))
    others = F.get(F.array_remove("themes", "transport"), F.lit(0))
    return hits.select("cand_id", F.coalesce(F.when(F.col("both"), "transport"), others, F.lit("other")).alias("theme"), (~F.col("both") & F.array_contains("themes", "transport")).alias("downgraded"))
