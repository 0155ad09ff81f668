"""Mapping of freely typed values to the entries of a reference list.

Each distinct (field, text) is brought to one form and looked up once:

1. A multi-pattern automaton over the names and aliases of the field's entries finds
   the mentions in the text.  Of overlapping mentions the longest wins.  An alias may
   consist of parts that must all be there, such as the purpose and the title of an
   agreement.  If the mentions complete the aliases of one entry best, that is it.
2. Any other text is compared with the entries as a set of words.  Words are alike by
   edit distance (with swaps of neighbours), by a common stem, as an abbreviation or as
   initials; rarer words of the list weigh more.  The score of an entry is the weight
   of the words of an alias found in the text, or of the words of the text found in the
   entry, whichever is the greater.  The best entry is taken if it reaches
   ``LEAST`` and no other comes as near as ``MARGIN``.

What remains is reported as ``unmatched``.  Aliases come from the list itself: the
label, its aspects (parted by a slash) alone and in any order, the short label, the
quoted title with the purpose before it, and all of these in Latin transcription.

Defined results: null and blank texts are no case and give no row; a null element of a
list gives none either but counts as a place; very long texts are searched whole; equal
scores of two entries are ``unmatched``; rows under another id are rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumizh.llm.lookalikes import APOSTROPHE, Shapes, canonical
from sumizh.session import width

UNMATCHED = "unmatched"
#: Score that an entry must reach, and its distance from the next one.
LEAST, MARGIN = 0.55, 0.02
#: Entries of a reference list at most; every worker holds the list.
MOST_ENTRIES = 50_000

# The Latin transcription of Ukrainian letters.
LATIN = dict(
    zip(
        "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя" + APOSTROPHE,
        "a b v h g d e ie zh z y i i i k l m n o p r s t u f kh ts ch sh shch  iu ia ".split(" "),
    )
)
_LATIN = str.maketrans(LATIN)
_TO_LATIN = str.maketrans({s["Cyrillic"]: s["Latin"] for s in Shapes().spelled if "Cyrillic" in s and "Latin" in s})
_ASCII_LETTER = re.compile("[A-z]")
_ONLY_CYRILLIC = re.compile("[" + "".join(c for c in map(chr, range(0x400, 0x500)) if ord(c) not in _TO_LATIN) + "]")
_WORD = re.compile(r"[^\W_]+(?:’[^\W_]+)*\.?")


def simple(text: str) -> str:
    """Small letters of the consistent form; all in Latin letters if the text has none that only Cyrillic has."""
    form = canonical(text) or ""
    if _ASCII_LETTER.search(form) and not _ONLY_CYRILLIC.search(form):
        form = form.translate(_TO_LATIN)
    return form.lower()


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def phrase(text: str) -> str:
    """The words of a text between single spaces, with one at either end."""
    return " " + " ".join(w.rstrip(".") for w in words(text)) + " "


def transcribed(text: str) -> str:
    return text.translate(_LATIN)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours between two words; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def allowed(length: int) -> int:
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 10 else 3


_ALLOWED = np.array([allowed(n) for n in range(11)])


def alike(typed: str, listed: str) -> float:
    """How alike a typed word is to one of the list, from 0 to 1."""
    short = typed.endswith(".")
    typed = typed.rstrip(".")
    if typed == listed:
        return 1.0
    if short and len(typed) >= 2 and listed.startswith(typed):
        return 0.95
    most = allowed(max(len(typed), len(listed)))
    best = 0.0
    if most and (distance := edits(typed, listed, most)) <= most:
        best = 1.0 - 0.8 * distance / max(len(typed), len(listed))
    common = 0
    for x, y in zip(typed, listed):
        if x != y:
            break
        common += 1
    shorter = min(len(typed), len(listed))
    if common >= 4 and common >= 0.55 * shorter:
        best = max(best, 0.9 * min(1.0, 0.35 + 0.65 * common / shorter))
    if shorter >= 6 and (typed in listed or listed in typed):
        best = max(best, 0.7)
    return best


class Entries:
    """The entries of one field, ready for lookups."""

    def __init__(self, entries: Sequence[tuple[str, str, str | None]]) -> None:
        """``entries``: (ref_id, label, short label or None)."""
        self.refs = [ref for ref, _, _ in entries]
        labels = [simple(label) for _, label, _ in entries]
        stock = self._stock(labels)
        self.aliases: list[tuple[int, tuple[str, ...]]] = []
        vocabulary: dict[str, int] = {}
        alias_words: list[list[int]] = []
        for at, (label, (_, _, short)) in enumerate(zip(labels, entries)):
            for parts in self._aliases(label, simple(short) if short else None, stock):
                for form in dict.fromkeys((parts, tuple(map(transcribed, parts)))):
                    self.aliases.append((at, tuple(phrase(p) for p in form)))
                    ids = [vocabulary.setdefault(w.rstrip("."), len(vocabulary)) for p in form for w in words(p)]
                    alias_words.append(list(dict.fromkeys(ids)))
        self.vocabulary = list(vocabulary)
        n, m = len(entries), len(vocabulary)
        self.of_alias = np.array([at for at, _ in self.aliases], dtype=int)
        # inverted lists: the aliases and the entries that a word of the list is in
        in_alias: list[list[int]] = [[] for _ in range(m)]
        for i, ids in enumerate(alias_words):
            for v in ids:
                in_alias[v].append(i)
        self.alias_of = [np.array(i, dtype=int) for i in in_alias]
        in_entry: list[set[int]] = [set() for _ in range(m)]
        for (at, _), ids in zip(self.aliases, alias_words):
            for v in ids:
                in_entry[v].add(at)
        self.entry_of = [np.array(sorted(e), dtype=int) for e in in_entry]
        self.weight = np.log1p(n / np.maximum(1, [len(e) for e in in_entry]))
        self.rare = math.log1p(n)
        self.alias_weight = np.array([self.weight[ids].sum() for ids in alias_words])
        self.initials = self._initials(labels)
        self._index()
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.parts: dict[str, list[int]] = {}
        for i, (_, parts) in enumerate(self.aliases):
            for p in parts:
                self.parts.setdefault(p, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for p in self.parts:
            self.automaton.add_word(p, p)
        if self.parts:
            self.automaton.make_automaton()

    @staticmethod
    def _stock(labels: list[str]) -> list[str]:
        """Words with which every label of a longer list begins; they say nothing."""
        split = [words(x) for x in labels]
        common: list[str] = []
        for column in zip(*split):
            if len(set(column)) > 1 or len(labels) < 3:
                break
            common.append(column[0])
        return common

    @staticmethod
    def _aliases(label: str, short: str | None, stock: list[str]) -> list[tuple[str, ...]]:
        found: list[tuple[str, ...]] = []
        quoted = re.search(r"«([^»]+)»", label)
        if quoted:
            purpose = words(label[: quoted.start()] + " " + label[quoted.end() :])[len(stock) :]
            found.append((" ".join(purpose), quoted.group(1)))
        else:
            found.append((label,))
            aspects = [a.strip() for a in label.split("/")]
            if len(aspects) > 1:
                found += [(a,) for a in aspects if a] + [(b + " " + a,) for a in aspects for b in aspects if a != b]
        if short:
            found.append((short,))
        return [tuple(p for p in parts if words(p)) for parts in found if any(words(p) for p in parts)]

    @staticmethod
    def _initials(labels: list[str]) -> dict[str, set[str]]:
        """Initials of two or three neighbouring words, and the words they may stand for."""
        found: dict[str, set[str]] = {}
        for label in labels:
            w = words(label)
            for size in (2, 3):
                for i in range(len(w) - size + 1):
                    found.setdefault("".join(x[0] for x in w[i : i + size]), set()).update(w[i : i + size])
        return found

    def mentions(self, text: str) -> list[str]:
        """Patterns in the text; the longest of those that overlap, then the first."""
        if not self.parts:
            return []
        found = sorted((-len(p), end, p) for end, p in self.automaton.iter(text))
        taken: list[tuple[int, int]] = []
        out = []
        for minus, end, p in found:
            start = end + minus + 1
            # neighbours share the space between them
            if all(end <= s or start >= e for s, e in taken):
                taken.append((start, end))
                out.append(p)
        return out

    def by_mention(self, text: str) -> int | None:
        """The entry whose aliases the mentions complete; None if there is none or more than one."""
        found = set(self.mentions(text))
        if not found:
            return None
        score: dict[int, int] = {}
        for i in {i for p in found for i in self.parts[p]}:
            at, parts = self.aliases[i]
            if all(p in found for p in parts):
                score[at] = max(score.get(at, 0), sum(map(len, parts)))
        best = sorted(score.items(), key=lambda x: -x[1])
        return best[0][0] if best and (len(best) == 1 or best[1][1] < best[0][1]) else None

    def _index(self) -> None:
        """What tells quickly which words of the list a typed word may be alike to."""
        self.number = {v: i for i, v in enumerate(self.vocabulary)}
        self.length = np.array([len(v) for v in self.vocabulary], dtype=int)
        self.letters = np.zeros((len(self.vocabulary), 64), dtype="i2")
        self.begins: dict[str, list[int]] = {}
        self.parts_of: dict[str, list[int]] = {}
        for i, v in enumerate(self.vocabulary):
            self.letters[i] = self._counted(v)
            self.begins.setdefault(v[:4], []).append(i)
            for at in range(len(v) - 5):
                self.parts_of.setdefault(v[at : at + 6], []).append(i)
        self.sorted = sorted((v, i) for i, v in enumerate(self.vocabulary))

    @staticmethod
    def _counted(word: str) -> np.ndarray:
        return np.bincount([ord(c) % 64 for c in word], minlength=64)

    def _near(self, typed: str) -> set[int]:
        """All words of the list that ``alike`` may give more than 0, and few others."""
        short = typed.endswith(".")
        typed = typed.rstrip(".")
        found: set[int] = set()
        if typed in self.number:
            found.add(self.number[typed])
        if short and len(typed) >= 2:
            at = bisect_left(self.sorted, (typed, -1))
            while at < len(self.sorted) and self.sorted[at][0].startswith(typed):
                found.add(self.sorted[at][1])
                at += 1
        # each edit changes two counts of letters at most, and the length by one
        most = _ALLOWED[np.minimum(np.maximum(self.length, len(typed)), 10)]
        within = np.abs(self.length - len(typed)) <= most
        at = np.flatnonzero(within & (most > 0))
        at = at[np.abs(self.letters[at] - self._counted(typed)).sum(axis=1) <= 2 * most[at]]
        found.update(at.tolist())
        if len(typed) >= 4:
            found.update(self.begins.get(typed[:4], ()))
        for i in range(len(typed) - 5):
            found.update(self.parts_of.get(typed[i : i + 6], ()))
        return found

    def _similar(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(words of the list, how alike they are to a typed word), without those that aren't."""
        known = self._known.get(word)
        if known is None:
            if len(self._known) > 50_000:
                self._known.clear()
            expanded = {self.number[v.rstrip(".")] for v in self.initials.get(word.rstrip("."), ()) if v.rstrip(".") in self.number}
            met = sorted(self._near(word) | expanded)
            values = np.array([0.9 if v in expanded else alike(word, self.vocabulary[v]) for v in met], dtype="f4")
            known = self._known[word] = np.array(met, dtype=int)[values > 0], values[values > 0]
        return known

    def by_words(self, text: str) -> int | None:
        typed = list(dict.fromkeys(words(text)))
        if not typed or not self.refs:
            return None
        best: dict[int, float] = {}
        scores, within, weights = np.zeros(len(self.refs)), np.zeros(len(self.refs)), 0.0
        for word in typed:
            met, values = self._similar(word)
            for v, value in zip(met.tolist(), values.tolist()):
                best[v] = max(best.get(v, 0.0), value)
            top = float(values.max()) if len(values) else 0.0
            weight = self.weight[met[int(values.argmax())]] if top >= 0.5 else self.rare
            own = np.zeros(len(self.refs))
            for v, value in zip(met.tolist(), values.tolist()):
                np.maximum.at(own, self.entry_of[v], value)
            within += weight * own
            weights += weight
        held = np.zeros(len(self.aliases))
        for v, value in best.items():
            held[self.alias_of[v]] += self.weight[v] * value
        np.maximum.at(scores, self.of_alias, held / self.alias_weight)
        scores = np.maximum(scores, 0.95 * within / weights)
        order = np.argsort(-scores, kind="stable")
        top_at = order[0]
        if scores[top_at] < LEAST or len(order) > 1 and scores[top_at] - scores[order[1]] < MARGIN:
            return None
        return int(top_at)

    def find(self, text: str) -> str | None:
        """The ref_id of a text, ``unmatched``, or None for a blank text."""
        plain = simple(text)
        if not plain:
            return None
        at = self.by_mention(phrase(plain))
        if at is None:
            at = self.by_words(plain)
        return UNMATCHED if at is None else self.refs[at]


@lru_cache(maxsize=8)
def _lists(entries: tuple[tuple[str, str, str, str | None], ...]) -> dict[str, Entries]:
    fields: dict[str, list] = {}
    for field, ref, label, short in entries:
        fields.setdefault(field, []).append((ref, label, short))
    return {field: Entries(rows) for field, rows in fields.items()}


def collect_entries(entries: DataFrame) -> tuple[tuple[str, str, str, str | None], ...]:
    """(field, ref_id, label, short label) of the reference list, which is small and fixed."""
    rows = entries.select("field", "ref_id", "label", "short_label").orderBy("field", "ref_id").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    return tuple((r.field, r.ref_id, r.label, r.short_label) for r in rows if r.label)


def map_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """``values`` (field, text and any others) with their ``ref_id``; blank texts are left out."""
    listed = collect_entries(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _lists(listed)
        empty = Entries([])
        for batch in batches:
            refs = [lists.get(f, empty).find(t) for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(refs, pa.string())], names=["field", "text", "ref_id"])

    kept = values.where(F.col("text").isNotNull())
    # few bytes and much work: spread by a fixed number of partitions
    different = kept.select("field", "text").distinct().repartition(width(values.sparkSession), "field", "text")
    found = different.mapInArrow(run, "field string, text string, ref_id string")
    return kept.join(found.where(F.col("ref_id").isNotNull()), ["field", "text"])
