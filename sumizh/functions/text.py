"""Text expressions: lines of goals, names, hosts.  All but the last, a search for names, stay on the JVM side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumizh.operators.ranking import global_rank

#: What is stripped from the ends of a line.
LINE_ENDS = " \t-•\r\n"


def goal_lines(goals: Column, least: int = 15) -> Column:
    """The lines of a text that are longer than ``least`` characters, stripped of marks at the ends."""
    lines = F.transform(F.split(goals, "\n"), lambda x: F.btrim(x, F.lit(LINE_ENDS)))
    return F.filter(lines, lambda x: F.length(x) > least)


def line_kind(line: Column) -> Column:
    """strategic, operational or other, by how a line is numbered or begins; what is neither is strategic if it is long."""
    return (
        F.when(line.rlike(r"^[0-9]+\.[0-9]+"), "operational")
        .when(line.rlike(r"^(?:Стратегічна ціль|Ціль|[0-9]+\.)"), "strategic")
        .when(F.length(line) > 80, "strategic")
        .otherwise("other")
    )


def line_number(line: Column) -> Column:
    """The number a line begins with, after the words for a goal; empty if there is none."""
    return F.regexp_extract(line, r"^(?:Стратегічна ціль |Ціль )?([0-9]+(?:\.[0-9]+)?)", 1)


def parent_number(line: Column) -> Column:
    """The first part of a two-part number; empty otherwise."""
    return F.regexp_extract(line, r"^([0-9]+)\.[0-9]+", 1)


def clean_line(line: Column) -> Column:
    """A line without its numbering and the words for a goal."""
    return F.trim(F.regexp_replace(line, r"^(?:Стратегічна ціль|Ціль)?\s*[0-9]+(?:\.[0-9]+)*[.:)]?\s*", ""))


def first_word(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), " "), 1)


def without_suffix(name: Column) -> Column:
    """A name without the words for its type and kind at the end."""
    return F.regexp_replace(name, r" (?:сільська|селищна|міська)? ?територіальна громада.*$", "")


def two_words(name: Column) -> Column:
    return F.array_join(F.slice(F.split(F.trim(name), " "), 1, 2), " ")


def normal_name(name: Column) -> Column:
    """Small letters, one apostrophe, single spaces."""
    return F.regexp_replace(F.trim(F.translate(F.lower(name), "’ʼ`´", "''''")), r"\s+", " ")


def host(url: Column) -> Column:
    """The host of an address, without www; null if there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^(?:https?://)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def unarchived(url: Column) -> Column:
    """The address that an archive's address holds; any other as it is."""
    found = F.regexp_extract(url, r"^https?://web\.archive\.org/web/[0-9]+(?:[a-z]{2}_)?/(.*)$", 1)
    return F.when(found != "", found).otherwise(url)


def homepage(url: Column) -> Column:
    """Scheme and host of a full address; null otherwise."""
    found = F.regexp_extract(F.trim(url), r"^(https?://[^/?#]+)", 1)
    return F.when(found != "", F.concat(found, F.lit("/")))


def slug(text: Column) -> Column:
    """A text that can be a file name."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^0-9a-zа-яіїєґ]+", "-"), F.lit("-"))


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word, with an ellipsis."""
    short = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(short, F.lit("…")))


def word_stems(text: Column, least: int = 4, keep: int = 6) -> Column:
    """Distinct beginnings of the longer words of a text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"([\p{{L}}]{{{least},}})"), 1)
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, keep)))


def programmes(text: Column) -> Column:
    """The plain reading of a list of programmes: parted by commas and semicolons."""
    return F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


#: Length from which a line is taken apart, what a clause must exceed, and what a line must.
LONG, CLAUSE, LEAST = 120, 20, 15
# Words for a goal, before its number or letter, and what parts clauses.
GOAL_WORDS = r"(?:Стратегічн[\p{L}\p{N}_]*\s+(?:ціль|напрям)|Основний напрям|Ціль)\s*[.:]?\s*[0-9A-CА-Яа-я]"
CLAUSE_ENDS = r"\s+[-–—]\s+|;\s+"
#: What is stripped from the ends of a part.
PART_ENDS = " \t-•,"


def expanded_lines(text: Column) -> Column:
    """The lines of a text, long ones taken apart: at the words for a goal, else into clauses if two at least are of use.

    A part that is still long is taken into clauses.  Only then are short lines left out.
    """

    def clauses(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(line, CLAUSE_ENDS), lambda x: F.btrim(x, F.lit(PART_ENDS))), lambda x: F.length(x) > CLAUSE)
        return F.when((F.length(line) > LONG) & (F.size(parts) >= 2), parts).otherwise(F.array(line))

    def expand(line: Column) -> Column:
        marked = F.filter(F.split(line, f"(?iu)(?={GOAL_WORDS})"), lambda x: F.trim(x) != "")
        parts = F.flatten(F.transform(marked, lambda x: clauses(F.btrim(x, F.lit(PART_ENDS)))))
        return F.when((F.length(line) > LONG) & (F.size(marked) > 1), parts).otherwise(clauses(line))

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(LINE_ENDS))), lambda x: x != "")
    return F.filter(F.flatten(F.transform(lines, expand)), lambda x: F.length(x) > LEAST)


#: Names of a list in one automaton; a longer list is searched by as many as it needs.
NAMES_AT_ONCE = 5_000


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, cues: Sequence[str], window: int) -> DataFrame:
    """(key, at, name, cue): where a text has a name (name, low) of a list, with the first cue within so many characters.

    The names are cut by rank into groups of ``NAMES_AT_ONCE``; each text is read once for
    each group, by one automaton for all of its names, so that a list of any length is
    searched whole.  A name's next mention begins after the end of the one before.
    """
    ranked = global_rank(names.distinct(), [F.col("low"), F.col("name")], "rank")
    groups = ranked.groupBy(F.floor((F.col("rank") - 1) / NAMES_AT_ONCE).alias("part")).agg(F.collect_list(F.struct("name", "low")).alias("names"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, ahocorasick.Automaton] = {}
        for f in frames:
            out = []
            for own, content, part, listed in zip(f[key], f[text], f["part"], f["names"]):
                if part not in known:
                    known.clear()
                    of: dict[str, list[str]] = {}
                    for x in listed:
                        of.setdefault(x["low"], []).append(x["name"])
                    known[part] = ahocorasick.Automaton()
                    for low, same in of.items():
                        known[part].add_word(low, (low, same))
                    known[part].make_automaton()
                free: dict[str, int] = {}
                for end, (low, same) in known[part].iter(content):
                    at = end - len(low) + 1
                    if at < free.get(low, 0):
                        continue
                    free[low] = end + 1
                    near = content[max(0, at - window) : end + 1 + window]
                    cue = next((c for c in cues if c in near), None)
                    if cue is not None:
                        out += [(own, at + 1, name, cue) for name in same]
            yield pd.DataFrame(out, columns=[key, "at", "name", "cue"])

    kind = texts.schema[key].dataType.simpleString()
    # of groups, not names: one for each NAMES_AT_ONCE
    return texts.crossJoin(groups).select(key, text, "part", "names").mapInPandas(run, f"{key} {kind}, at int, name string, cue string")
