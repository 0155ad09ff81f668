"""Queries of the package over a data folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumizh.llm.bpe import decode_documents, encode_documents
from sumizh.llm.canon import map_values
from sumizh.llm.entities import match_entities
from sumizh.llm.garbled import find_garbled
from sumizh.llm.lookalikes import canonical_text, lookalike_kind, same_reading
from sumizh.llm.mix import mix, shares
from sumizh.llm.topn import top_n
from sumizh.sources.tables import table

#: Places kept for each group of matching_edges13 and of known_curation_candidates.
EDGES_N, CANDIDATES_N = 5, 2


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the two tables whose names read the same and are stored differently."""
    full, growth = table(spark, folder, "hromadas_full30"), table(spark, folder, "corpus_growth_priority")
    return same_reading(full, "id", "name", growth, "growth_id", "name").select(
        F.col("a_id").alias("full_id"), F.col("b_id").alias("growth_id")
    )


def p1_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every name of the two tables in its consistent form, with the kind of look-alike met."""
    full = table(spark, folder, "hromadas_full30").select(F.lit("hromadas_full30").alias("tab"), F.col("id").alias("item_id"), "name")
    growth = table(spark, folder, "corpus_growth_priority").select(
        F.lit("corpus_growth_priority").alias("tab"), F.col("growth_id").alias("item_id"), "name"
    )
    return full.unionAll(growth).withColumns({"canonical": canonical_text("name"), "kind": lookalike_kind("name")}).drop("name")


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of hromada_portals and gisrr_cards that describe one municipality, with a confidence."""
    portals = table(spark, folder, "hromada_portals").select(
        F.col("portal_id").alias("id"), F.col("name").alias("title"), F.col("oblast").alias("region"), F.lit(None).cast("string").alias("district"),
        F.col("population").alias("size"), F.col("portalurl").alias("url"), F.col("katottg").alias("code"),
    )
    cards = table(spark, folder, "gisrr_cards").select(
        F.col("card_id").alias("id"), "title", "region", "district", F.col("residents").alias("size"), F.col("site").alias("url"), F.lit(None).cast("string").alias("code")
    )
    return match_entities(portals, cards).select(F.col("left_id").alias("portal_id"), F.col("right_id").alias("card_id"), F.round("conf", 4).alias("conf"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_pairs(spark, folder).select("portal_id", "card_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The best edges of each name and the best candidates of each code, with places."""
    edges = top_n(
        table(spark, folder, "matching_edges13"),
        "a",
        [("goals_cosine", True), ("b", False), ("edge_id", False)],
        ["edge_id"],
        EDGES_N,
    )
    candidates = top_n(
        table(spark, folder, "known_curation_candidates"),
        "a_katottg",
        [("rank", False), ("cand_id", False)],
        ["cand_id"],
        CANDIDATES_N,
    )
    return edges.select(F.lit("matching_edges13").alias("tab"), F.col("edge_id").alias("item_id"), "place").unionAll(
        candidates.select(F.lit("known_curation_candidates").alias("tab"), F.col("cand_id").alias("item_id"), "place")
    )


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The texts chosen so that each source of mix_targets has its share, with their repeats."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the tokens that each source of mix_targets really reached."""
    return shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with characters that come from decoding with a wrong encoding."""
    return find_garbled(table(spark, folder, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The affected documents with their text as far as it can be restored."""
    return find_garbled(table(spark, folder, "documents"))


P4_SQL = f"""
SELECT 'matching_edges13' AS tab, edge_id AS item_id, CAST(rn AS INTEGER) AS place FROM (
  SELECT edge_id, row_number() OVER (PARTITION BY a ORDER BY goals_cosine DESC, b, edge_id) AS rn
  FROM matching_edges13 WHERE a IS NOT NULL AND goals_cosine IS NOT NULL AND NOT isnan(goals_cosine)
) WHERE rn <= {EDGES_N}
UNION ALL
SELECT 'known_curation_candidates' AS tab, cand_id AS item_id, CAST(rn AS INTEGER) AS place FROM (
  SELECT cand_id, row_number() OVER (PARTITION BY a_katottg ORDER BY rank, cand_id) AS rn
  FROM known_curation_candidates WHERE a_katottg IS NOT NULL AND rank IS NOT NULL
) WHERE rn <= {CANDIDATES_N}
"""


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed theme, form and title with its entry of the reference list."""
    candidates = table(spark, folder, "known_curation_candidates")
    themes = candidates.select("cand_id", F.lit("primary_theme").alias("field"), F.lit(0).alias("pos"), F.col("primary_theme").alias("text"))
    agreements = candidates.select("cand_id", F.posexplode("agreements").alias("at", "agreement")).select(
        "cand_id",
        (F.col("at") + 1).alias("pos"),
        F.explode(
            F.array(
                F.struct(F.lit("form").alias("field"), F.col("agreement.form").alias("text")),
                F.struct(F.lit("title").alias("field"), F.col("agreement.title").alias("text")),
            )
        ).alias("typed"),
    )
    values = themes.unionAll(agreements.select("cand_id", "typed.field", "pos", "typed.text"))
    return map_values(values, table(spark, folder, "canon_entries")).select("cand_id", "field", "pos", "ref_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document; empty and null texts give an empty list."""
    return encode_documents(table(spark, folder, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """For every document, whether its ids decode to the text as stored (null as empty)."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    decoded = decode_documents(encode_documents(documents, "doc_id", "text"), "doc_id", "ids")
    return documents.join(decoded.withColumnRenamed("text", "decoded"), "doc_id").select(
        "doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("restored")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_names": p1_names, "p2_found": p2_found, "p2_pairs": p2_pairs, "p4_found": p4_found, "p5_found": p5_found, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p6_roundtrip": "SELECT doc_id, TRUE AS restored FROM documents"}
