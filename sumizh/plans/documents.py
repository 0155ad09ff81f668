"""Queries over texts: rules, intents, TF-IDF, projects in JSON, names of programmes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.functions import text as X
from sumizh.operators.ranking import first_of
from sumizh.plans.entities import LATEST_SQL, latest_entities
from sumizh.plans.registry import registry
from sumizh.session import cut
from sumizh.sources.tables import table

# Rules are data: (theme, pattern of stems, weight), each pattern counted once per text.
THEMES = [
    ("water", "водогон|водовідвед|свердловин", 8),
    ("energy", "сонячн|котельн|теплопостач", 7),
    ("transport", "велодоріж|мост|перевез", 6),
    ("safety", "укритт|пожежн", 6),
    ("culture", "клуб|бібліотек|ремес", 5),
    ("services", "сервісн|цифров|облік", 4),
    ("youth", "молодіжн|шкільн|дитяч", 4),
]
# Forms by the first rule that fits a title.
FORMS = [("building", "будівництв|розбудов|облаштув"), ("repair", "ремонт|утеплен|розчищ"), ("running", "утриман|роботу|вивезен"), ("records", "архів|упорядк")]

_LOW = "lower(text)"
_THEMES_SQL = ", ".join(f"('{t}', '{p}', {w}, {i})" for i, (t, p, w) in enumerate(THEMES))


def theme_hits(text: Column) -> Column:
    """An array of (theme, weight, number) for the rules whose pattern stands in the text."""
    low = F.lower(text)
    rules = [F.when(low.rlike(p), F.struct(F.lit(t).alias("theme"), F.lit(w).alias("weight"), F.lit(i).alias("number"))) for i, (t, p, w) in enumerate(THEMES)]
    return F.array_compact(F.array(*rules))


@registry.add(
    "theme_scores",
    f"""WITH rules(theme, pattern, weight, number) AS (VALUES {_THEMES_SQL}) SELECT theme, CAST(count(*) AS BIGINT) AS documents, CAST(sum(weight) AS BIGINT) AS weight
    FROM documents JOIN rules ON regexp_matches({_LOW}, pattern) GROUP BY theme""",
)
def theme_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and weight of each theme."""
    hits = table(spark, folder, "documents").select(F.explode(theme_hits(F.col("text"))).alias("h")).select("h.*")
    return hits.groupBy("theme").agg(F.count(F.lit(1)).alias("documents"), F.sum("weight").alias("weight"))


@registry.add(
    "theme_pick",
    f"""WITH rules(theme, pattern, weight, number) AS (VALUES {_THEMES_SQL}), hits AS (SELECT doc_id, theme, weight, number FROM documents JOIN rules ON regexp_matches({_LOW}, pattern)),
    best AS (SELECT doc_id, theme, weight, sum(weight) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, number) AS r FROM hits)
    SELECT d.doc_id, coalesce(theme, 'other') AS theme, CAST(coalesce(weight, 0) AS INTEGER) AS weight, CASE WHEN total >= 15 THEN 'high' WHEN total >= 8 THEN 'medium' ELSE 'low' END AS confidence
    FROM documents d LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.doc_id = d.doc_id""",
)
def theme_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The heaviest theme of each document, the first rule if equal, and how sure it is."""
    hits = F.coalesce(theme_hits(F.col("text")), F.array())
    # the greatest weight, of these the smallest number
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["weight"].alias("weight"), (-h["number"]).alias("minus"), h["theme"].alias("theme"))))
    total = F.aggregate("hits", F.lit(0), lambda s, h: s + h["weight"])
    rows = table(spark, folder, "documents").select("doc_id", hits.alias("hits")).select("doc_id", best.alias("best"), total.alias("total"))
    confidence = F.when(F.col("total") >= 15, "high").when(F.col("total") >= 8, "medium").otherwise("low")
    return rows.select("doc_id", F.coalesce("best.theme", F.lit("other")).alias("theme"), F.coalesce("best.weight", F.lit(0)).alias("weight"), confidence.alias("confidence"))


_FORM_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{f}'" for f, p in FORMS) + " ELSE 'other' END"


@registry.add(
    "form_rules",
    f"""WITH titles AS (SELECT cand_id, a.title AS title, track FROM (SELECT cand_id, track, unnest(agreements) AS a FROM known_curation_candidates))
    SELECT {_FORM_SQL} AS form, CASE WHEN track = 'operational' THEN 'running first' ELSE 'as written' END AS advice, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT title) AS BIGINT) AS titles
    FROM titles WHERE title IS NOT NULL GROUP BY 1, 2""",
)
def form_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Titles by the first form rule that fits."""
    titles = table(spark, folder, "known_curation_candidates").select("track", F.explode("agreements").alias("a")).select("track", F.col("a.title").alias("title")).where("title IS NOT NULL")
    form = reduce(lambda c, r: c.when(F.lower("title").rlike(r[1]), r[0]), FORMS[1:], F.when(F.lower("title").rlike(FORMS[0][1]), FORMS[0][0])).otherwise("other")
    advice = F.when(F.col("track") == "operational", "running first").otherwise("as written")
    return titles.groupBy(form.alias("form"), advice.alias("advice")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("title").alias("titles"))


@registry.add(
    "form_prior",
    f"""WITH f AS (SELECT track, {_FORM_SQL} AS form, cand_id FROM (SELECT cand_id, track, a.title AS title FROM (SELECT cand_id, track, unnest(agreements) AS a FROM known_curation_candidates)) WHERE title IS NOT NULL),
    c AS (SELECT track, form, count(*) AS n, min(cand_id) AS seen FROM f GROUP BY track, form)
    SELECT track, form, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY track ORDER BY n DESC, seen, form) = 1""",
)
def form_prior(spark: SparkSession, folder: str) -> DataFrame:
    """The commonest form of each track; of equal ones that seen first, then the first by name."""
    titles = table(spark, folder, "known_curation_candidates").select("cand_id", "track", F.explode("agreements").alias("a")).select("cand_id", "track", F.col("a.title").alias("title")).where("title IS NOT NULL")
    form = reduce(lambda c, r: c.when(F.lower("title").rlike(r[1]), r[0]), FORMS[1:], F.when(F.lower("title").rlike(FORMS[0][1]), FORMS[0][0])).otherwise("other")
    counted = titles.groupBy("track", form.alias("form")).agg(F.count(F.lit(1)).alias("n"), F.min("cand_id").alias("seen"))
    place = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("n"), "seen", "form"))  # a few rows by track
    return counted.withColumn("place", place).where("place = 1").select("track", "form", "n")


_INTENT, _NEGATED = "спільн|разом|сусід", "відкладати не можна|не можуть"


@registry.add(
    "intent_lines",
    f"""WITH pieces AS (SELECT doc_id, trim(piece) AS piece, pos FROM (SELECT doc_id, unnest(s) AS piece, generate_subscripts(s, 1) AS pos FROM (
      SELECT doc_id, string_split_regex(text, '[\\n;•]') AS s FROM documents WHERE text IS NOT NULL)))
    SELECT doc_id, left(piece, 400) AS quote, CAST(pos AS INTEGER) AS pos FROM pieces WHERE length(piece) >= 20 AND regexp_matches(lower(piece), '{_INTENT}') AND NOT regexp_matches(lower(piece), '{_NEGATED}')
    QUALIFY row_number() OVER (PARTITION BY doc_id, lower(left(piece, 80)) ORDER BY pos) = 1""",
)
def intent_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of texts that speak of doing something together, without negated ones; of equal beginnings the first."""
    pieces = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "[\n;•]")).alias("at", "raw"))
    piece = pieces.select("doc_id", (F.col("at") + 1).alias("pos"), F.trim("raw").alias("piece"))
    kept = piece.where((F.length("piece") >= 20) & F.lower("piece").rlike(_INTENT) & ~F.lower("piece").rlike(_NEGATED))
    begin = kept.withColumns({"begin": F.lower(F.substring("piece", 1, 80)), "quote": F.substring("piece", 1, 400)})
    return first_of(begin, ["doc_id", "begin"], [("pos", False), ("quote", False)], ["quote", "pos"]).select("doc_id", "quote", "pos")


@registry.add(
    "named_neighbours",
    f"""WITH {LATEST_SQL}, named AS (SELECT split_part(trim(name), ' ', 1) AS word, count(DISTINCT katottg) AS entities FROM latest GROUP BY 1),
    said AS (SELECT doc_id, w AS word, count(*) AS times FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[А-ЯІЇЄҐ][а-яіїєґ’]+ської')), 'ої$', 'а') AS w FROM documents) GROUP BY doc_id, w)
    SELECT doc_id, word, CAST(times AS BIGINT) AS times, CAST(entities AS BIGINT) AS entities FROM said JOIN named USING (word)""",
)
def named_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that documents name, by the first word of the name."""
    named = latest_entities(spark, folder, "name").groupBy(X.first_word(F.col("name")).alias("word")).agg(F.count_distinct("katottg").alias("entities"))
    said = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([А-ЯІЇЄҐ][а-яіїєґ’]+ської)"), 1)).alias("raw"))
    said = said.select("doc_id", F.regexp_replace("raw", "ої$", "а").alias("word"))
    return said.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("times")).join(named, "word").select("doc_id", "word", "times", "entities")


_TOKENS_SQL = "regexp_extract_all(lower(goals), '[\\p{L}\\p{N}_]{2,}')"
_TFIDF_SQL = f"""t AS (SELECT id, unnest({_TOKENS_SQL}) AS w FROM hromadas_full30 WHERE trim(goals) <> ''), tf AS (SELECT id, w, count(*) AS tf FROM t GROUP BY id, w),
    n AS (SELECT count(DISTINCT id) AS n FROM t), df AS (SELECT w, ln((1 + (SELECT n FROM n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY w),
    raw AS (SELECT id, w, tf * idf AS x FROM tf JOIN df USING (w)), len AS (SELECT id, sqrt(sum(x * x)) AS len FROM raw GROUP BY id),
    v AS (SELECT id, w, x / len AS x FROM raw JOIN len USING (id))"""


def tfidf(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w, x): unit vectors of words of two letters or more, tf * (ln((1 + n) / (1 + df)) + 1)."""
    # read three times from here on, so it is written once
    counted = cut(rows.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("tf")))
    n = counted.agg(F.count_distinct(key).alias("n"))
    idf = counted.groupBy("w").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("w", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row
    raw = counted.join(idf, "w").select(key, "w", (F.col("tf") * F.col("idf")).alias("x"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return raw.join(length, key).select(key, "w", (F.col("x") / F.col("len")).alias("x"))


@registry.add(
    "tfidf_cosine",
    f"""WITH {_TFIDF_SQL} SELECT query, id, similarity, CAST(place AS INTEGER) AS place FROM (SELECT q.id AS query, r.id AS id, round(sum(q.x * r.x), 6) AS similarity,
      row_number() OVER (PARTITION BY q.id ORDER BY round(sum(q.x * r.x), 6) DESC, r.id) AS place
      FROM v q JOIN v r ON q.w = r.w AND q.id <> r.id WHERE q.id % 100 = 0 GROUP BY q.id, r.id) WHERE place <= 5""",
)
def tfidf_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """The five goals texts most like each query by TF-IDF; queries are ids divisible by 100, against all."""
    rows = table(spark, folder, "hromadas_full30").where(F.trim("goals") != "")
    vectors = cut(tfidf(rows, "id", "goals"))
    return sparse_search(vectors.where("id % 100 = 0"), vectors, 5)


#: Words of the queries that a block of queries holds about, and of the rows that one of rows does.
ENTRIES = 200_000


def _sparse_blocks(vectors: DataFrame, prefix: str) -> DataFrame:
    """Vectors (id, w, x) packed by hash of the id into blocks of about ``ENTRIES`` words: (block, ids, words, values)."""
    many = F.floor((F.col("_n") - 1) / ENTRIES) + 1
    counted = vectors.crossJoin(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    placed = counted.withColumn(f"{prefix}block", F.pmod(F.xxhash64("id"), many))
    packed = placed.groupBy(f"{prefix}block").agg(F.collect_list(F.struct("id", F.xxhash64("w").alias("w"), "x")).alias("e"))
    return packed.select(f"{prefix}block", *(F.col("e")[f].alias(f"{prefix}{f}") for f in ("id", "w", "x")))


def sparse_search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity, place): the ``k`` rows most like each query by the sum of products, those without a common word left out.

    Blocks of queries meet blocks of rows; within a pair the words of the queries are an
    inverted list that the rows are run through, and the best ``k`` of each query leave
    it.  A common word is no key, so that it makes no task larger than others.
    """

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q_id, q_w, q_x, r_id, r_w, r_x in zip(*(f[c] for c in ("q_id", "q_w", "q_x", "r_id", "r_w", "r_x"))):
                q_of, q_at = np.unique(q_id, return_inverse=True)
                r_of, r_at = np.unique(r_id, return_inverse=True)
                order = np.argsort(q_w, kind="stable")
                words, w_at, x_at = q_w[order], q_at[order], q_x[order]
                low, high = np.searchsorted(words, r_w, "left"), np.searchsorted(words, r_w, "right")
                out = []
                # rows a few at a time, so that the sums stay small
                step = max(1, 4_000_000 // len(q_of))
                by_row = np.argsort(r_at, kind="stable")
                ends = np.searchsorted(r_at[by_row], np.arange(0, len(r_of) + step, step))
                for part, (a, b) in enumerate(zip(ends, ends[1:])):
                    at = by_row[a:b]
                    at = at[high[at] > low[at]]
                    n = high[at] - low[at]
                    entry = np.repeat(low[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    first = part * step
                    cell = (np.repeat(r_at[at], n) - first) * len(q_of) + w_at[entry]
                    size = min(step, len(r_of) - first) * len(q_of)
                    sums = np.bincount(cell, weights=np.repeat(r_x[at], n) * x_at[entry], minlength=size)
                    met = np.flatnonzero(np.bincount(cell, minlength=size))
                    out.append(pd.DataFrame({"query": q_of[met % len(q_of)], "id": r_of[first + met // len(q_of)], "similarity": np.round(sums[met], 6)}))
                found = pd.concat(out)
                found = found[found["query"] != found["id"]].sort_values(["query", "similarity", "id"], ascending=[True, False, True])
                yield found.groupby("query").head(k)

    # of blocks, not rows
    best = _sparse_blocks(queries, "q_").crossJoin(_sparse_blocks(rows, "r_")).drop("q_block", "r_block").mapInPandas(multiply, "query bigint, id bigint, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return best.withColumn("place", place).where(F.col("place") <= k)


@registry.add(
    "stem_overlap",
    f"""WITH {LATEST_SQL}, s AS (SELECT katottg, list_distinct(list_transform(regexp_extract_all(lower(goals), '[\\p{{L}}]{{4,}}'), lambda w: left(w, 6))) AS stems FROM latest WHERE goals IS NOT NULL)
    SELECT cand_id, CAST(len(list_intersect(x.stems, y.stems)) AS INTEGER) AS shared, round(CASE WHEN len(x.stems) > 0 AND len(y.stems) > 0
      THEN len(list_intersect(x.stems, y.stems)) / len(list_distinct(x.stems || y.stems))::DOUBLE END, 6) AS overlap
    FROM known_curation_candidates c JOIN s x ON x.katottg = a_katottg JOIN s y ON y.katottg = b_katottg""",
)
def stem_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Word stems that the goals of both ends of a candidate share."""
    stems = latest_entities(spark, folder, "goals").where("goals IS NOT NULL").select("katottg", X.word_stems(F.col("goals")).alias("stems"))
    a, b = stems.select(F.col("katottg").alias("a_katottg"), F.col("stems").alias("sa")), stems.select(F.col("katottg").alias("b_katottg"), F.col("stems").alias("sb"))
    joined = table(spark, folder, "known_curation_candidates").select("cand_id", "a_katottg", "b_katottg").join(a, "a_katottg").join(b, "b_katottg")
    shared = F.size(F.array_intersect("sa", "sb"))
    overlap = F.when((F.size("sa") > 0) & (F.size("sb") > 0), shared / F.size(F.array_union("sa", "sb")))
    return joined.select("cand_id", shared.alias("shared"), F.round(overlap, 6).alias("overlap"))


@registry.add(
    "language_labels",
    """SELECT CASE WHEN lower(lang) IN ('uk', 'ua', 'ukr') THEN 'uk' WHEN lower(lang) IN ('de', 'ger') THEN 'de' ELSE coalesce(lower(lang), 'none') END AS language,
    CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (text IS NULL OR regexp_matches(text, '^[ \\t\\r\\n]*$')) AS BIGINT) AS blank, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY 1""",
)
def language_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by language, labels brought together."""
    low = F.lower("lang")
    language = F.when(low.isin("uk", "ua", "ukr"), "uk").when(low.isin("de", "ger"), "de").otherwise(F.coalesce(low, F.lit("none")))
    blank = F.count_if(F.col("text").isNull() | F.col("text").rlike(r"^[ \t\r\n]*\z"))
    rows = table(spark, folder, "documents").groupBy(language.alias("language"))
    return rows.agg(F.count(F.lit(1)).alias("n"), blank.alias("blank"), F.sum(F.length("text")).cast("bigint").alias("characters"))


@registry.add(
    "agreements_by_theme",
    """WITH a AS (SELECT trim(lower(primary_theme)) AS theme, unnest(agreements) AS g FROM known_curation_candidates WHERE trim(primary_theme) <> '')
    SELECT theme, CAST(count(DISTINCT coalesce(g.n, g.title)) AS BIGINT) AS agreements, CAST(count(*) AS BIGINT) AS mentions, min(substr(g.date, 1, 4)) AS first_year FROM a WHERE g IS NOT NULL GROUP BY theme""",
)
def agreements_by_theme(spark: SparkSession, folder: str) -> DataFrame:
    """Agreements of each theme by number, each once however many pairs it has."""
    rows = table(spark, folder, "known_curation_candidates").where(F.trim("primary_theme") != "")
    each = rows.select(F.trim(F.lower("primary_theme")).alias("theme"), F.explode("agreements").alias("g")).where("g IS NOT NULL")
    return each.groupBy("theme").agg(
        F.count_distinct(F.coalesce("g.n", "g.title")).alias("agreements"), F.count(F.lit(1)).alias("mentions"), F.min(F.substring("g.date", 1, 4)).alias("first_year")
    )



# every place where a part begins gets a mark, the inner words first, as places may follow each other
_MARKED_SQL = """regexp_replace(regexp_replace(regexp_replace(line, '(ціль\\s*[.:]?\\s*[0-9a-cа-я])', chr(1) || '\\1', 'gi'),
      '(стратегічн[\\p{L}\\p{N}_]*\\s+\\x01?(?:ціль|напрям)\\s*[.:]?\\s*[0-9a-cа-я])', chr(1) || '\\1', 'gi'), '(основний напрям\\s*[.:]?\\s*[0-9a-cа-я])', chr(1) || '\\1', 'gi')"""


def _clauses_sql(line: str) -> str:
    parts = f"list_filter(list_transform(string_split_regex({line}, '\\s+[-–—]\\s+|;\\s+'), lambda c: trim(c, ' ' || chr(9) || '-•,')), lambda c: length(c) > 20)"
    return f"CASE WHEN length({line}) > 120 AND len({parts}) >= 2 THEN {parts} ELSE [{line}] END"


@registry.add(
    "expanded_lines",
    f"""WITH raw AS (SELECT doc_id, unnest(kept) AS line, generate_subscripts(kept, 1) AS n FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || '-•' || chr(13) || chr(10))), lambda x: x <> '') AS kept FROM documents WHERE text IS NOT NULL)),
    marked AS (SELECT *, list_filter(string_split({_MARKED_SQL}, chr(1)), lambda x: trim(x) <> '') AS m FROM raw),
    parts AS (SELECT doc_id, n, CASE WHEN length(line) > 120 AND len(m) > 1 THEN flatten(list_transform(m, lambda x: {_clauses_sql("trim(x, ' ' || chr(9) || '-•,')")})) ELSE {_clauses_sql("line")} END AS p FROM marked),
    long AS (SELECT doc_id, list_filter(flatten(list(p ORDER BY n)), lambda x: length(x) > 15) AS lines FROM parts GROUP BY doc_id)
    SELECT doc_id, CAST(generate_subscripts(lines, 1) AS INTEGER) AS pos, unnest(lines) AS line FROM long""",
)
def expanded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents, long ones split at the words for a goal or into clauses."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", X.expanded_lines(F.col("text")).alias("lines"))
    return rows.select("doc_id", F.posexplode("lines").alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("pos"), "line")


_CUES = ("кошти", "завдяки", "програм", "project", "wymian")


@registry.add(
    "partner_mentions",
    f"""WITH RECURSIVE n AS (SELECT program, lower(program) AS low FROM donor_programs WHERE program <> ''),
    hits(doc_id, name, low, text, rest, pos) AS (
      SELECT doc_id, program, low, lower(text), substr(lower(text), strpos(lower(text), low) + length(low)), strpos(lower(text), low) FROM documents JOIN n ON strpos(lower(text), low) > 0
      UNION ALL SELECT doc_id, name, low, text, substr(rest, strpos(rest, low) + length(low)), length(text) - length(rest) + strpos(rest, low) FROM hits WHERE strpos(rest, low) > 0),
    near AS (SELECT *, substr(text, greatest(pos - 40, 1), pos + length(low) + 40 - greatest(pos - 40, 1)) AS near FROM hits)
    SELECT doc_id, CAST(pos AS INTEGER) AS "at", name, {"CASE " + " ".join(f"WHEN contains(near, '{c}') THEN '{c}'" for c in _CUES) + " END"} AS cue
    FROM near WHERE {" OR ".join(f"contains(near, '{c}')" for c in _CUES)}""",
)
def partner_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Known programmes that documents name, with a word for funding within forty characters.

    The list is a table and meets the documents as one: it is sent where its size allows, else spread.
    """
    names = table(spark, folder, "donor_programs").where("program <> ''").select(F.col("program").alias("name"), F.lower("program").alias("low"))
    texts = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("text"))
    return X.mentions(texts, "doc_id", "text", names, _CUES, 40)


@registry.add(
    "nested_agreements",
    """SELECT cand_id, CAST(len(agreements) AS INTEGER) AS n, list_transform(list_filter(agreements, lambda g: g.date IS NOT NULL)[1:25], lambda g, i: i::VARCHAR || '. ' || coalesce(g.title, '?')) AS dated,
    CAST(len(list_filter(agreements, lambda g: g IS NOT NULL AND g.date IS NULL)) AS INTEGER) AS undated, list_min(list_transform(list_filter(agreements, lambda g: g.date IS NOT NULL), lambda g: g.date)) AS first_date
    FROM known_curation_candidates WHERE agreements IS NOT NULL""",
)
def nested_agreements(spark: SparkSession, folder: str) -> DataFrame:
    """Nested lists split by a field, numbered anew and cut to what is shown, without leaving the row."""
    dated = F.filter("agreements", lambda g: g["date"].isNotNull())
    undated = F.filter("agreements", lambda g: g.isNotNull() & g["date"].isNull())
    rows = table(spark, folder, "known_curation_candidates").where("agreements IS NOT NULL").select("cand_id", F.size("agreements").alias("n"), dated.alias("d"), undated.alias("u"))
    numbered = F.transform(F.slice("d", 1, 25), lambda g, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(g["title"], F.lit("?"))))
    return rows.select("cand_id", "n", numbered.alias("dated"), F.size("u").alias("undated"), F.array_min(F.transform("d", lambda g: g["date"])).alias("first_date"))
