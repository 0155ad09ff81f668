"""Mixing of sources to target shares of the size in tokens, by systematic sampling.

1. Tokens of every text of a listed source are counted.  Texts, not rows, are what may
   be used a number of times: equal texts are one, of the row with the smallest id.
2. The total is the largest for which every source that has text can make up its share
   within its repeats: the least of max_repeats * tokens / share.
3. Within a source texts are put in classes of like size (``STEPS`` to each doubling) and
   these in order, longest first.  The texts of a class have the same expected copies: as
   near to share * total / tokens, at most max_repeats, as gives the class a whole number
   of uses, where what one class takes too much or too little is made up for by the next.
   So a text that is too long for its source's part is left to shorter ones, and the last
   classes, of the shortest texts, settle the sum.  The expected copies are summed up along
   that order, one random offset per source is added, and a text comes out once for each
   whole number that its stretch of the sum crosses.

The sum along a class is a rank times a number, and ranks come from the counts of
range partitions, so that a source with a third of all rows is no larger a task.

Defined results: null and empty texts have no tokens and are never chosen; rows whose
source is null or not listed aren't either; a listed source without text reaches 0 and
the others share the rest in proportion; without any text, or with shares of 0 only,
nothing is chosen; the same seed gives the same choice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sumizh.llm.bpe import TOKENIZER, count_tokens
from sumizh.session import cut, width

SEED = 20
#: Classes of size to each doubling.
STEPS = 4


def _checked(targets: DataFrame) -> DataFrame:
    return targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")


def usable_texts(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(hash, doc_id, source, tokens) of each different text that has tokens and a listed source."""
    rows = documents.select("doc_id", "source", "text").where("text IS NOT NULL AND text <> ''")
    listed = rows.join(_checked(targets).select("source"), "source", "left_semi")
    counted = count_tokens(listed.withColumn("hash", F.sha2("text", 256)), "text", tokenizer).drop("text")
    return counted.groupBy("hash").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("x")).select("hash", "x.*")


def plan(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: texts, tokens, and the expected copies of each text."""
    sizes = texts.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))
    joined = _checked(targets).join(sizes, "source", "left").fillna(0, ["texts", "tokens"])
    reach = F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))
    total = joined.agg(F.min(reach).alias("total"))
    copies = F.least(F.col("target_share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))
    return joined.crossJoin(F.broadcast(total)).select(  # one row
        "source",
        "target_share",
        "max_repeats",
        "texts",
        "tokens",
        "total",
        F.when(F.col("tokens") > 0, copies).otherwise(F.lit(0.0)).alias("expected"),
    )


def _class() -> Column:
    return F.floor(F.log2("tokens") * STEPS).cast("int")


def strata(texts: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, class, max_repeats, rate, before, first): expected copies of the texts of each class, their sum over the classes before, and the texts before."""
    sizes = texts.withColumn("class", _class()).groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("size"))
    rows = sizes.join(planned.select("source", "expected", "max_repeats"), "source")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("class", ascending=False, ignore_index=True)
        owed, uses = 0.0, []
        for n, size, expected, most in zip(f["n"], f["size"], f["expected"], f["max_repeats"]):
            wanted = expected * size + owed
            uses.append(int(min(max(round(wanted / (size / n)), 0), most * n)))
            owed = wanted - uses[-1] * size / n
        uses = pd.Series(uses, dtype="int64")
        return pd.DataFrame(
            {"source": f["source"], "class": f["class"], "max_repeats": f["max_repeats"], "rate": uses / f["n"], "before": uses.cumsum() - uses, "first": f["n"].cumsum() - f["n"]}
        )

    # a source has at most STEPS classes for each doubling of a text's length
    return rows.groupBy("source").applyInPandas(run, "source string, class int, max_repeats int, rate double, before bigint, first bigint")


def _in_order(texts: DataFrame) -> DataFrame:
    """``texts`` with their ``class`` and their ``rank`` from 0 within the source, longest class first."""
    order = ["source", F.desc("class"), "tokens", "hash"]
    ordered = cut(
        texts.withColumn("class", _class())
        .repartitionByRange(width(texts.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    # one row per partition and source
    stretches = ordered.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.withColumn("sooner", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("part", "source", "start", "sooner")
    return ordered.join(offsets, ["part", "source"]).withColumn("rank", F.col("sooner") + F.col("at") - F.col("start"))


def _offset() -> Column:
    """A random number between 0 and 1 for each source."""
    return (F.pmod(F.xxhash64("source", F.lit(SEED)), F.lit(1_000_003)) + 0.5) / 1_000_003


def _copies() -> Column:
    """Whole numbers that the text's stretch of the sum crosses; whole sums of classes before change nothing."""
    place = F.col("rank") - F.col("first")
    upto = F.floor(_offset() + F.col("rate") * (place + 1))
    return F.least((upto - F.floor(_offset() + F.col("rate") * place)).cast("int"), F.col("max_repeats").cast("int"))


def choose(texts: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copies) of the texts that are used at least once."""
    ranked = _in_order(texts).join(strata(texts, planned), ["source", "class"])
    return ranked.withColumn("copies", _copies()).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The chosen texts with their repeats."""
    texts = cut(usable_texts(documents, targets, tokenizer))
    return choose(texts, plan(texts, targets))


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """For each listed source what was wanted, what there is, and the share really reached."""
    texts = cut(usable_texts(documents, targets, tokenizer))
    planned = cut(plan(texts, targets))
    taken = (
        choose(texts, planned)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("texts_used"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"))
    )
    joined = planned.join(taken, "source", "left").fillna(0, ["texts_used", "most_copies", "tokens_used"])
    total = joined.agg(F.sum("tokens_used").alias("all_used"))
    share = F.when(F.col("all_used") > 0, F.col("tokens_used") / F.col("all_used")).otherwise(F.lit(0.0))
    return joined.crossJoin(F.broadcast(total)).select(  # one row
        "source", "target_share", "max_repeats", "texts", "tokens", "expected", "texts_used", "most_copies", "tokens_used", share.alias("actual_share")
    )
