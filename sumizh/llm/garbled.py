"""Text decoded with a wrong character encoding: found, and restored where it can be.

A wrong reading is a substitution cipher: each letter was written as some bytes in the
encoding it was stored in, and those bytes are seen as other characters.  Which pair of
encodings met is unknown and differs from place to place.  The ciphers are learned from
the corpus, from nothing but its bigrams:

* language: how often a character follows another, counted over all documents, first
  without words of odd form, then also without words found to be garbled;
* places: words that the language makes very unlikely are put together with those of
  documents in which the same character is commonest among such words - as a rule the
  image of one frequent letter under one cipher.  What is kept of them is how often a
  unit follows another.  A unit is what one letter became: one character where both
  encodings use single bytes, two to four where the text was UTF-8;
* expectation-maximisation: for each place a mapping of units to letters under which its
  bigrams are likeliest, from several random starts, without any table of an encoding.
  Places whose text doesn't become likely language are dropped - a small place pays for
  its letters first, as few units can be read as any text - and places whose mappings
  agree are one cipher;
* then every unlikely word is given to its likeliest cipher or to none, which gives the
  share of each cipher in each source, and the mappings are learned once more over all
  these words, and for each source on its own, however few it has: a letter of its own
  must outweigh those of all sources.

What a cipher has learned too rarely to know is completed from public code pages: by the
pair of them that agrees with the letters learned.  Pairs that the corpus doesn't show
stay possible with a small share, as does UTF-8 read by single bytes.  ``tables=False``
leaves all code pages out and reads by learned letters only.  Letters are applied by
translate(), again and again while that helps, as text may have been misread more than
once.

A document is affected if a cipher made one of its words beyond doubt, or several of
them together - then its less certain words of that cipher are read so too - or if it has
a character that only a failed decoding leaves (U+FFFD, a C1 control).  The latter is the
exact check for what no letter can be learned for.  Where single bytes were read as other
ones, every word counts, likely or not: of all ways to cut the document into clean and
garbled places the best one decides, where each place pays once for the share of its
cipher and a repeated word counts once.

Defined results: null, empty and blank texts are not affected; very long texts are read
whole; repeated texts are each a row; rows whose source is null form a source of their
own.  A word of ASCII only isn't affected.
"""

from __future__ import annotations

import json
import logging
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from copy import copy
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumizh.session import cut, width

#: Characters of the models of all sources together up to which they are sent to every worker.
MOST_SENT = 8_000_000
#: Blocks of characters that bigrams tell apart; all others are one class.
BLOCKS = ((0x20, 0x7F), (0xA0, 0x180), (0x2C0, 0x2E0), (0x386, 0x3D0), (0x400, 0x4A0), (0x2010, 0x2040), (0x20A0, 0x20C0), (0x2110, 0x2130), (0x2200, 0x2270), (0x2500, 0x25A0))
#: Logarithm of the share of a cipher before anything is learned, and by how much a garbled reading must win.
FIRST_SHARE, MARGIN = -9.0, 2.0
#: By how much the words of a document together must win where single bytes were read as other single bytes.
#: Any letters can be read so, and a few odd ones may by chance read a little better.
SINGLE_MARGIN = 8.0
#: A word is looked at if one character follows another with less than this logarithm.
UNLIKELY = -6.0
#: A word is learned from if its characters follow each other with less than this logarithm on average.
VERY_UNLIKELY = -4.5
#: A cipher that many words share may have made its own steps likely; its characters are still rarer than usual by this.
RARE = 2.0
#: Units from which on a place needn't pay for the letters that its units are given, and a source's own letters needn't outweigh ``PRIOR``.
ENOUGH_UNITS = 300
#: Times that a letter must have been met, and the part of them it must make up, to count as learned.
MET, CLEAR = 3.0, 0.6
#: How far the text of a place may stay below the corpus, and how far it must rise, in logarithms for each character.
NEAR, RISE = 1.25, 1.5
#: Random starts of expectation-maximisation, its rounds, and uses of a letter that a source's own must outweigh.
STARTS, TURNS, PRIOR = 24, 60, 20.0
#: Characters that a learned letter can be: those that make up this share of the corpus.
SPOKEN = 5e-5

# Encodings that text is wrongly read with, and that it may have been stored in.
READ_AS = ("cp1251", "cp1252", "cp1250", "mac_roman", "mac_cyrillic", "cp866", "koi8_u", "koi8_r", "iso8859_5", "iso8859_2", "cp437", "cp852")
STORED_IN = ("utf_8", "cp1251", "koi8_u", "iso8859_5", "mac_cyrillic", "cp866", "cp1125", "cp1252", "cp1250", "iso8859_2", "mac_roman", "cp437", "cp852")

#: A character of class 3 of ``Alphabet``: one that no text here is written in.
_STRANGE = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in BLOCKS) + "\t\n\r\x7f-\xa0\ufffd\u2600-\u27bf\u200b-\u200f\U0001f300-\U0001faff]")
_C1 = re.compile(r"[\x80-\x84\x86-\x9f�]")
_ODD = re.compile(r"[a-zа-яёіїєґ][A-ZА-ЯЁІЇЄҐ]|[^\W\d_](?:[^\w\s’'ʼ.,:;!?()/&+\-–—\"«»“”„…]|[ª²³µ¹º¼½¾ƒˆ])[^\W\d_]")


class Alphabet:
    """Numbers for the classes of characters: 0 white space, 1 digits, 2 lost or control, 3 other, 4 pictures."""

    def __init__(self) -> None:
        self.of = np.full(0x110000, 3, dtype="u2")
        at = 5
        for low, high in BLOCKS:
            self.of[low:high] = np.arange(at, at + high - low)
            at += high - low
        self.size = at
        self.of[0x1F300:0x1FB00] = self.of[0x2600:0x27C0] = self.of[0x200B:0x2010] = 4
        for c in "\t\n\r \x85\xa0":
            self.of[ord(c)] = 0
        self.of[0x30:0x3A] = 1
        self.of[0x7F:0x85] = self.of[0x86:0xA0] = self.of[0xFFFD] = 2
        self.letters = "".join(chr(c) for low, high in BLOCKS for c in range(low, high))
        self.letter_codes = self.of[[ord(c) for c in self.letters]]

    def codes(self, text: str) -> np.ndarray:
        return self.of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


@lru_cache(maxsize=1)
def alphabet() -> Alphabet:
    return Alphabet()


class Language:
    """Logarithms of bigram shares, smoothed by those of single characters."""

    SMOOTH = 30.0

    def __init__(self, counts: np.ndarray) -> None:
        single = counts.sum(axis=0) + 0.02
        share = single / single.sum()
        total = counts.sum(axis=1, keepdims=True)
        self.log = np.log((counts + self.SMOOTH * share) / (total + self.SMOOTH)).astype("f4")
        self.share = np.log(share).astype("f4")

        self.usual = float((counts * self.log).sum() / max(counts.sum(), 1.0))
        self.usual_share = float((single * self.share).sum() / single.sum())

    def spoken(self) -> tuple[np.ndarray, list[str]]:
        """(classes, characters) beyond ASCII that the corpus is written in."""
        letters = alphabet()
        kept = [i for i, c in enumerate(letters.letters) if c >= "\x80" and self.share[letters.letter_codes[i]] > math.log(SPOKEN)]
        return letters.letter_codes[kept], [letters.letters[i] for i in kept]

    def unlikely(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least, mean) logarithm of a step of each word, and how much rarer than usual its characters are."""
        codes = alphabet().codes(" " + " ".join(words) + " ")
        steps = self.log[codes[:-1], codes[1:]]
        lengths = np.array([len(w) + 1 for w in words])
        starts = np.cumsum(lengths) - lengths
        rarity = self.usual_share - np.add.reduceat(self.share[codes[:-1]], starts, dtype="f8") / lengths
        return np.minimum.reduceat(steps, starts), np.add.reduceat(steps, starts, dtype="f8") / lengths, rarity

    def steps(self, word: str) -> np.ndarray:
        codes = alphabet().codes(f" {word} ")
        return self.log[codes[:-1], codes[1:]]

    def of_all(self, words: list[str]) -> np.ndarray:
        """The logarithm of each word's likelihood; the words are looked up together."""
        codes = alphabet().codes(" " + " ".join(words) + " ")
        steps = self.log[codes[:-1], codes[1:]]
        ends = np.cumsum([len(w) + 1 for w in words])
        sums = np.concatenate(([0.0], np.cumsum(steps, dtype="f8")))
        return sums[ends] - sums[ends - [len(w) + 1 for w in words]]


@lru_cache(maxsize=64)
def _table(encoding: str) -> dict[str, int]:
    """The character that each byte from 0x80 is read as; bytes without one stay C1 controls."""
    found = {}
    for byte in range(0x80, 0x100):
        try:
            c = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(byte)
        if ord(c) >= 0x80:
            found[c] = byte
    if encoding == "cp1252":
        found |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in found}
    return found


@lru_cache(maxsize=64)
def _units(read_as: str) -> tuple[frozenset[str], frozenset[str], re.Pattern]:
    """(first characters, others, pattern) of what one letter stored in UTF-8 becomes when it is read by single bytes."""
    table = _table(read_as)
    of_class = lambda low, high: "".join(re.escape(c) for c, b in table.items() if low <= b <= high)
    tail = f"[{of_class(0x80, 0xBF)}�]"
    pattern = f"[{of_class(0xC2, 0xDF)}]{tail}|[{of_class(0xE0, 0xEF)}]{tail}{tail}|[{of_class(0xF0, 0xF4)}]{tail}{tail}{tail}"
    return frozenset(c for c, b in table.items() if b >= 0xC2), frozenset(c for c, b in table.items() if b < 0xC0) | {"�"}, re.compile(pattern)


@lru_cache(maxsize=256)
def _given(name: str) -> dict[str, str]:
    """The letter that a pair of code pages ("stored>read") gives each single character."""
    stored_in, read_as = name.split(">")
    found = {}
    for c, byte in _table(read_as).items():
        try:
            found[c] = bytes([byte]).decode(stored_in)
        except UnicodeDecodeError:
            pass
    return found


PAIRS = tuple(f"{s}>{r}" for r in READ_AS for s in STORED_IN if r != s and s != "utf_8")
UTF8 = tuple(f"utf_8>{r}" for r in READ_AS)


_HIGH = sorted({c for r in READ_AS for c in _table(r) if ord(c) >= 0x2600} | {"�"})


class Cipher:
    """Text stored in one encoding and read as another, with its letters by unit."""

    def __init__(self, name: str, learned: dict[str, str] | None = None, own: dict[str, str] | None = None, pair: str | None = None, ruled: bool = True) -> None:
        """``own``: letters of one source; ``pair``: code pages that the letters agree with; ``ruled``: letters of UTF-8 are told by its rule."""
        self.name, self.pair = name, pair
        self.utf8 = name.startswith("utf_8>")
        self.ruled = ruled and self.utf8
        self.letters = {**(learned or {}), **(own or {})}
        if self.utf8:
            self.leads, self.tails, self.unit = _units(name.partition(">")[2])
            self.bytes_of = _table(name.partition(">")[2])
        else:
            if pair:  # all of it is known; what was learned fills its gaps
                self.letters |= _given(pair)
            self.domain = frozenset(self.letters) | (frozenset(_table(pair.partition(">")[2])) if pair else frozenset()) | {"�"}
            self.table = {ord(c): self.letters.get(c, "�") for c in self.domain}

    def letter(self, unit: str) -> str:
        if self.ruled and (found := self.by_rule(unit)):
            return found
        return self.letters.get(unit, "�")

    def by_rule(self, unit: str) -> str:
        """The letter that UTF-8 gives a unit; empty if none."""
        try:
            return bytes(self.bytes_of[c] for c in unit).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return ""

    def settled(self, unit: str) -> bool:
        """Whether a letter of one source would change nothing."""
        return bool(self.ruled and self.by_rule(unit)) or bool(self.pair and unit in _given(self.pair))

    def read(self, word: str, own: frozenset[str]) -> str | None:
        """The word as it was stored, as far as letters are known; ``own``: its characters beyond ASCII."""
        if self.utf8:
            if own.isdisjoint(self.tails) or own.isdisjoint(self.leads):
                return None
            found = self.unit.sub(lambda m: self.letter(m.group()), word)
        else:
            if not own <= self.domain:
                return None
            found = word.translate(self.table)
        return None if found == word else found

    def units(self, word: str) -> list[str]:
        """The word cut into units and other characters."""
        if not self.utf8:
            return [*word]
        out, at = [], 0
        for m in self.unit.finditer(word):
            out += [*word[at : m.start()], m.group()]
            at = m.end()
        return [*out, *word[at:]]


#: What a cipher of single bytes does to a character: no letter known, lost, moved; above ten bits of its class.
_FOREIGN, _LOST, _MOVED, _CLASS = 1 << 12, 1 << 11, 1 << 10, (1 << 10) - 1
#: Characters from here on have no place of their own but for those of code pages.
_TOP = 0x2600


class Gains:
    """By how much ciphers of single bytes read words better than they stand; what is known is kept for a while."""

    def __init__(self, language: Language, ciphers: list[Cipher], others: Gains | None = None, at: list[int] | None = None) -> None:
        """``others``: those of all ciphers, of which the ones in the columns ``at`` are replaced."""
        self.log, self.others, self.columns = language.log, others, at
        self.changes = [self._changes(c) for c in ciphers]
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(ciphers)), dtype="f4")

    @staticmethod
    def _changes(cipher: Cipher) -> np.ndarray:
        letters = alphabet()
        found = np.append(letters.of[:_TOP], letters.of[[*map(ord, _HIGH), 0x10FFFF]]).astype("u2")
        found[0x80:] |= _FOREIGN
        for c in cipher.domain:
            to = cipher.letters.get(c, "�")
            at = ord(c) if ord(c) < _TOP else _TOP + _HIGH.index(c) if c in _HIGH else None
            if at is not None:
                found[at] = letters.of[ord(to[0])] | (_MOVED if to != c else 0) | (_LOST if to == "�" != c else 0)
        return found

    def of(self, words: list[str]) -> np.ndarray:
        """For each word by how much each cipher reads it better than it stands, shares aside."""
        missing = [w for w in dict.fromkeys(words) if w not in self.at]
        if missing:
            if len(self.at) + len(missing) > 60_000:
                self.at, self.rows, missing = {}, self.rows[:0], [*dict.fromkeys(words)]
            self.at |= {w: len(self.at) + i for i, w in enumerate(missing)}
            self.rows = np.concatenate([self.rows, *(self._gains(missing[i : i + 20_000]) for i in range(0, len(missing), 20_000))])
        rows = self.rows[[self.at[w] for w in words]]
        if self.others is None:
            return rows
        every = self.others.of(words)  # a copy
        every[:, self.columns] = rows
        return every

    def _gains(self, words: list[str]) -> np.ndarray:
        text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        plain = alphabet().of[text]
        lengths = np.array([len(w) + 1 for w in words])
        starts = np.cumsum(lengths) - lengths
        log = self.log
        before = np.add.reduceat(log[plain[:-1], plain[1:]], starts, dtype="f8")
        # the place of a word's own characters is one after that of its first step
        odd = np.logical_or.reduceat(plain[1:] == 3, starts)
        clipped = np.minimum(text, _TOP + len(_HIGH))
        for at in np.flatnonzero(text >= _TOP):
            c = chr(text[at])
            clipped[at] = _TOP + (_HIGH.index(c) if c in _HIGH else len(_HIGH))
        out = np.full((len(words), len(self.changes)), -1e9, dtype="f4")
        for k, changes in enumerate(self.changes):
            found = changes[clipped]
            flags = np.bitwise_or.reduceat(found[1:], starts)
            at = np.flatnonzero((flags & (_FOREIGN | _MOVED)) == _MOVED)
            if not len(at):
                continue
            codes = found & _CLASS
            value = np.add.reduceat(log[codes[:-1], codes[1:]], starts, dtype="f8")[at] - before[at]
            strange = np.logical_or.reduceat(codes[1:] == 3, starts)[at] & ~odd[at]
            # a reading with characters that no text here is written in, or with more lost ones, is no text
            out[at, k] = np.where((value > 0) & (strange | ((flags[at] & _LOST) != 0)), -1e9, value)
        return out


class Mixture:
    """Clean words and ciphers with their shares, as one source has them."""

    def __init__(self, language: Language, ciphers: list[tuple[str, str | None, dict[str, str]]] = (), shares: dict[str, float] | None = None, tables: bool = True) -> None:
        self.language = language
        self.shares = shares or {}
        learned = [Cipher(name, letters, None, pair if tables else None, tables) for name, pair, letters in ciphers]
        met = {c.name for c in learned} | {pair for _, pair, _ in ciphers}
        self.utf8 = [c for c in learned if c.utf8] + ([Cipher(n) for n in UTF8 if n not in met] if tables else [])
        self.single = [c for c in learned if not c.utf8] + ([Cipher(n, pair=n) for n in PAIRS if n not in met] if tables else [])
        self.leads = frozenset().union(*(c.leads for c in self.utf8))
        self.paid = np.array([self.share(c.name) for c in self.single])
        self.found = Gains(language, self.single)
        self.tops: dict[str, float] = {}
        self.unpacked: dict[str, list[tuple[float, str, str, int]]] = {}
        self.known: dict[str, tuple[str, float, str, int] | None] = {}

    def of_source(self, shares: dict[str, float], own: dict[str, dict[str, str]]) -> Mixture:
        """The same ciphers with the shares of a source and the letters it has of its own."""
        other = copy(self)
        other.shares, other.known = shares, {}
        other.paid = np.array([other.share(c.name) for c in self.single])
        replaced = lambda c: Cipher(c.name, c.letters, own[c.name], c.pair, c.ruled) if c.name in own else c
        if any(c.name in own for c in self.utf8):
            other.utf8, other.unpacked = [replaced(c) for c in self.utf8], {}
        changed = [k for k, c in enumerate(self.single) if c.name in own]
        if changed:
            other.single, other.tops = [replaced(c) for c in self.single], {}
            other.found = Gains(self.language, [other.single[k] for k in changed], self.found, changed)
        return other

    def share(self, name: str) -> float:
        return self.shares.get(name, FIRST_SHARE)

    def gains(self, words: list[str]) -> np.ndarray:
        return self.found.of(words)

    def most(self, words: list[str]) -> list[float]:
        """For each word the most that any cipher gains, 0 at least."""
        if not self.single:
            return [0.0] * len(words)
        if len(self.tops) > 300_000:
            self.tops.clear()
        missing = [w for w in words if w not in self.tops]
        if missing:
            self.tops |= zip(missing, np.maximum(self.gains(missing).max(axis=1), 0.0).tolist())
        return [self.tops[w] for w in words]

    def _unpacked(self, word: str) -> list[tuple[float, str, str, int]]:
        """(by how much it is likelier, cipher, text, times misread) of each reading of a word by the UTF-8 ciphers."""
        found = self.unpacked.get(word)
        if found is None:
            texts: list[str] = [word]
            told: list[tuple[str, int]] = []
            own = frozenset(c for c in word if c >= "\x80")
            strange, lost = _STRANGE.search(word), word.count("�")
            for cipher in () if own.isdisjoint(self.leads) else self.utf8:
                # text that was misread several times makes sense only at the end
                turn, text = 1, cipher.read(word, own)
                while text is not None:
                    if text.count("�") <= lost and (strange or not _STRANGE.search(text)):
                        texts.append(text)
                        told.append((cipher.name, turn))
                    turn += 1
                    text = cipher.read(text, frozenset(c for c in text if c >= "\x80")) if turn <= 4 else None
            found = []
            if told:
                likely = self.language.of_all(texts)
                found = [(float(value), name, text, turn) for (name, turn), text, value in zip(told, texts[1:], likely[1:] - likely[0])]
            if len(self.unpacked) > 100_000:
                self.unpacked.clear()
            self.unpacked[word] = found
        return found

    def _best(self, words: list[str]) -> list[tuple[str, float, str, int] | None]:
        """For each word (cipher, margin over the clean reading, text, times misread) of the likeliest garbled reading, or None."""
        margins = self.gains(words) + self.paid if self.single else np.full((len(words), 1), -1e9)
        at, most = margins.argmax(axis=1), margins.max(axis=1)
        out: list = []
        for word, k, margin in zip(words, at.tolist(), most.tolist()):
            best = None
            if margin > MARGIN:
                cipher = self.single[k]
                best = (cipher.name, margin, cipher.read(word, frozenset(c for c in word if c >= "\x80")) or word, 1)
            for value, name, text, turn in self._unpacked(word):
                value += self.share(name)
                if value > MARGIN and (best is None or value > best[1]):
                    best = (name, value, text, turn)
            out.append(best)
        return out

    def suspicious(self, words: list[str]) -> list[str]:
        if not words:
            return []
        least, _, _ = self.language.unlikely(words)
        return [w for w, low in zip(words, least) if low < UNLIKELY and w.strip("\xa0")]

    def judge(self, words: Iterable[str]) -> dict[str, tuple[str, float, str, int]]:
        """The likeliest garbled reading of each word that has one, read again while another reading helps."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > 300_000:
            self.known.clear()
            fresh = [*words]
        self.known |= dict.fromkeys(fresh)
        odd = self.suspicious(fresh)
        found = {w: b for w, b in zip(odd, self._best(odd)) if b} if odd else {}
        open_ = dict(found)
        for _ in range(3):
            texts = self.suspicious([*dict.fromkeys(b[2] for b in open_.values() if not b[2].isascii())])
            if not texts:
                break
            again = {t: b for t, b in zip(texts, self._best(texts)) if b}
            open_ = {w: (b[0], b[1] + again[b[2]][1], again[b[2]][2], b[3] + again[b[2]][3]) for w, b in open_.items() if b[2] in again}
            found |= open_
        self.known |= found
        return {w: b for w in words if (b := self.known[w])}

    def together(self, words: list[str], explained: set[str]) -> tuple[Cipher, dict[str, str]] | None:
        """The cipher that the words of a document, in their order, speak for beyond doubt, and its readings."""
        if not self.single:
            return None
        # at most what the best cipher of each word gains
        if sum(map(self.tops.get, words, repeat(math.inf))) + float(self.paid.max()) <= SINGLE_MARGIN:
            return None
        order = [w for w in dict.fromkeys(words) if w not in explained and w.strip("\xa0")]
        if not order or sum(self.most(order)) + float(self.paid.max()) <= SINGLE_MARGIN:
            return None
        gains = self.gains(order)
        at = np.flatnonzero(np.maximum(gains, 0.0).sum(axis=0) + self.paid > SINGLE_MARGIN)
        if not len(at):
            return None
        share, row_of = self.paid[at], {w: gains[i, at] for i, w in enumerate(order)}
        clean, place, met = np.zeros(len(at)), np.full(len(at), -1e12), set(explained)
        for word in words:
            place = np.maximum(place, clean + share)
            if word not in met and word in row_of:
                place = place + row_of[word]
            met.add(word)
            clean = np.maximum(clean, place)
        best = int(clean.argmax())
        if clean[best] <= SINGLE_MARGIN:
            return None
        cipher = self.single[at[best]]
        return cipher, {w: cipher.read(w, frozenset(c for c in w if c >= "\x80")) or w for w, g in row_of.items() if g[best] > 0}


def _source(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def _words(text: str) -> list[str]:
    return [w for w in text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") if w]


def _pairs(words: list[str], times: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(pair, n) of the bigrams of some words, each word once or as often as ``times`` says."""
    if not words:
        return np.zeros(0, dtype="i8"), np.zeros(0)
    codes = alphabet().codes(" " + " ".join(words) + " ").astype("i8")
    at, back = np.unique(codes[:-1] * alphabet().size + codes[1:], return_inverse=True)
    steps = [len(w) + 1 for w in words]
    return at, np.bincount(back, weights=np.repeat(times if times is not None else np.ones(len(words)), steps)).astype("f8")


def count_bigrams(texts: DataFrame) -> DataFrame:
    """(pair, n): how often one class of characters follows another in words of usual form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = alphabet().size
        total = np.zeros(size * size)
        usual: dict[str, bool] = {}
        for batch in batches:
            met: Counter = Counter()
            for text in batch.column(0).to_pylist():
                met.update(_words(text))
            if len(usual) > 300_000:
                usual.clear()
            for word in met:
                if word not in usual:
                    usual[word] = word.isascii() or not (_ODD.search(word) or _C1.search(word))
            kept = [w for w in met if usual[w]]
            if kept:
                codes = alphabet().codes(" " + " ".join(kept) + " ").astype("i8")
                times = np.repeat([met[w] for w in kept], [len(w) + 1 for w in kept])
                total += np.bincount(codes[:-1] * size + codes[1:], weights=times, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["pair", "n"])

    return texts.mapInArrow(run, "pair bigint, n double").groupBy("pair").agg(F.sum("n").alias("n"))


def _language(rows) -> np.ndarray:
    size = alphabet().size
    counts = np.zeros(size * size)
    for r in rows:
        counts[r.pair] = r.n
    return counts.reshape(size, size)


def _forms(word: str, ciphers: list[Cipher]) -> tuple[str, ...]:
    """Which of the UTF-8 ciphers can have made a word whole."""
    own = {c for c in word if c >= "\x80"}
    return tuple(c.name for c in ciphers if not own.isdisjoint(c.leads) and c.unit.sub("", word).isascii())


def suspicious_words(documents: DataFrame, language) -> DataFrame:
    """(source, place, word, n): unlikely words, how often a source has them, and where the very unlikely ones are learned from.

    The place is the UTF-8 cipher that can have made most of them in the document, or the
    commonest character of those that none can have made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = language.value
        utf8 = [Cipher(n) for n in UTF8]
        kinds: dict[str, tuple[str, ...] | None] = {}  # None: usual, (): unlikely, else very unlikely: ciphers, or "?" for single bytes
        for batch in batches:
            texts = [(s, [w for w in _words(t) if not w.isascii()]) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if not t.isascii()]
            if len(kinds) > 300_000:
                kinds.clear()
            fresh = list({w for _, ws in texts for w in ws if w not in kinds})
            if fresh:
                for word, least, mean, rarity in zip(fresh, *lang.unlikely(fresh)):
                    if least >= UNLIKELY and rarity <= RARE or not word.strip("\xa0"):
                        kinds[word] = None
                    else:
                        kinds[word] = (_forms(word, utf8) or ("?",)) if mean < VERY_UNLIKELY or rarity > RARE else ()
            found: Counter = Counter()
            for source, in_text in texts:
                odd = [(w, k) for w in in_text if (k := kinds[w]) is not None]
                single = Counter(c for w, k in odd if k == ("?",) for c in w if c >= "\x80" and c != "�")
                place = min(single, key=lambda c: (-single[c], c)) if single else ""
                most = Counter(c for _, k in odd for c in k)
                found.update((source, place if k == ("?",) else max(k, key=lambda c: most[c], default=""), w) for w, k in odd)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k in found], pa.string()) for i in range(3)), pa.array([*found.values()], pa.int64())], names=["source", "place", "word", "n"]
            )

    return documents.mapInArrow(run, "source string, place string, word string, n bigint").groupBy("source", "place", "word").agg(F.sum("n").alias("n"))


FOLLOWS = "cipher string, source string, a string, b string, n double"


def _follows(cells: Iterable[tuple[str, str, list[str]]]) -> pa.RecordBatch:
    """``FOLLOWS``: how often a unit follows another, for (cipher, source, units of a word)."""
    sums: Counter = Counter()
    for cipher, source, units in cells:
        row = [" ", *units, " "]
        sums.update((cipher, source, a, b) for a, b in zip(row, row[1:]))
    keys = [*sums]
    return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([float(v) for v in sums.values()], pa.float64())], names=["cipher", "source", "a", "b", "n"])


def _places(words: DataFrame) -> DataFrame:
    """``FOLLOWS`` of the very unlikely words of each place, each word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        utf8 = {n: Cipher(n) for n in UTF8}
        for batch in batches:
            yield _follows((p, "", utf8[p].units(w) if p in utf8 else [*w]) for p, w in zip(*(c.to_pylist() for c in batch.columns)))

    return words.where("place <> ''").select("place", "word").distinct().mapInArrow(run, FOLLOWS).groupBy("cipher", "source", "a", "b").agg(F.sum("n").alias("n"))


def solve(a: list[str], b: list[str], n: np.ndarray, language: Language, start: dict[str, str] | None = None) -> tuple[list[str], list[str], np.ndarray, np.ndarray, float, float]:
    """(units, letters, times met, part of the times, likelihood of a step after, its rise) by expectation-maximisation.

    From how often unit b follows unit a: the letters under which the language makes these
    pairs likeliest.  ASCII stands for itself.  Starts at random, or from ``start``, whose
    letters then count as met ``PRIOR`` times.
    """
    letters = alphabet()
    spoken, characters = language.spoken()
    units = sorted({u for u in (*a, *b) if u >= "\x80"})
    at = {u: i for i, u in enumerate(units)}
    ascii_ = [chr(c) for c in range(0x20, 0x7F)]
    codes = letters.of[[ord(c) for c in ascii_]]
    inner, first, last = np.zeros((len(units), len(units))), np.zeros((len(ascii_), len(units))), np.zeros((len(units), len(ascii_)))
    for x, y, v in zip(a, b, n):
        if x in at and y in at:
            inner[at[x], at[y]] += v
        elif y in at and " " <= x < "\x7f":
            first[ord(x) - 0x20, at[y]] += v
        elif x in at and " " <= y < "\x7f":
            last[at[x], ord(y) - 0x20] += v
    inner, first, last = inner.astype("f4"), first.astype("f4"), last.astype("f4")
    log, share = language.log, language.share
    joint = np.exp(log[np.ix_(spoken, spoken)] + share[spoken][:, None])
    begin = np.exp(log[np.ix_(codes, spoken)] + share[codes][:, None])
    end = np.exp(log[np.ix_(spoken, codes)] + share[spoken][:, None])
    prior = np.full((len(spoken), len(units)), 1e-3 / len(units), dtype="f4")
    if start:
        of = {c: i for i, c in enumerate(characters)}
        for u, c in start.items():
            if u in at and c in of:
                prior[of[c], at[u]] += PRIOR

    def climb(e: np.ndarray, turns: int) -> tuple[float, np.ndarray]:
        total, met = 0.0, e
        for _ in range(turns):
            met, total = np.zeros_like(e), 0.0
            z = e.T @ joint @ e + np.float32(1e-30)
            r = inner / z
            met += e * (joint @ e @ r.T) + e * (joint.T @ e @ r)
            total += float((inner * np.log(z)).sum())
            z = begin @ e + np.float32(1e-30)
            met += e * (begin.T @ (first / z))
            total += float((first * np.log(z)).sum())
            z = e.T @ end + np.float32(1e-30)
            met += e * (end @ (last / z).T)
            total += float((last * np.log(z)).sum())
            e = met + prior
            e /= e.sum(axis=1, keepdims=True)
        return total, met

    of_counts = lambda met: (met + prior) / (met + prior).sum(axis=1, keepdims=True)
    if start:
        _, met = climb(of_counts(np.float32(1e-3)), TURNS // 3)
    else:
        rnd = np.random.default_rng(7)
        begun = [climb(rnd.dirichlet(np.full(len(units), 5.0), size=len(spoken)).astype("f4"), TURNS // 4) for _ in range(STARTS)]
        _, met = max((climb(of_counts(met), TURNS) for _, met in sorted(begun, key=lambda x: -x[0])[: STARTS // 6]), key=lambda x: x[0])
    # a pair is met from either side
    best, seen = met.argmax(axis=0), met.sum(axis=0)
    part = met.max(axis=0) / np.maximum(seen, 1e-9)
    to = {u: spoken[best[i]] for i, u in enumerate(units)} | dict(zip(ascii_, codes))
    stands = lambda x: to.get(x, letters.of[ord(x[0])]) if len(x) else 0
    own = lambda x, i: letters.of[ord(x[i])] if len(x) else 0
    total = max(float(np.sum(n)), 1.0)
    after = sum(v * log[stands(x), stands(y)] for x, y, v in zip(a, b, n)) / total
    # with the shares of the characters, as a cipher that many words share makes its own steps likely
    rise = sum(v * (log[stands(x), stands(y)] + share[stands(y)] - log[own(x, -1), own(y, 0)] - share[own(y, 0)]) for x, y, v in zip(a, b, n)) / total
    return units, [characters[i] for i in best], seen / 2.0, part, after, rise


LETTERS = "cipher string, source string, unit string, letter string, n double, part double, after double, rise double"


def _solved(follows: DataFrame, language, start: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``LETTERS`` of each (cipher, source), however few; a group is at most as large as there are pairs of units.

    Few bytes and much work, so that the groups are spread by a fixed number of partitions.
    """

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["a", "b"])
        units, letters, n, part, after, rise = solve(f["a"].tolist(), f["b"].tolist(), f["n"].to_numpy(), language.value, (start or {}).get(key[0]))
        return pd.DataFrame({"cipher": key[0], "source": key[1], "unit": units, "letter": letters, "n": n, "part": part, "after": after, "rise": rise})

    spread = follows.repartition(2 * width(follows.sparkSession), "cipher", "source")
    return spread.groupBy("cipher", "source").applyInPandas(run, LETTERS)


def _after(rows: list, language: Language) -> float:
    """How likely the text of a place became, in logarithms for each character.

    Few units can be read as any text: there what it takes to tell the letter of each unit is paid.
    """
    met = sum(r.n for r in rows)
    return rows[0].after - (len(rows) * math.log(max(len(language.spoken()[1]), 1)) / max(met, 1.0) if met < ENOUGH_UNITS else 0.0)


def _joined(rows: list, language: Language) -> tuple[dict[str, dict[str, str]], list[str]]:
    """Ciphers with their letters: places that became language, put together where their mappings agree; and these places."""
    places: dict[str, list] = defaultdict(list)
    for r in rows:
        places[r.cipher].append(r)
    after = {p: _after(rs, language) for p, rs in places.items()}
    ready = [(p, rs) for p, rs in places.items() if after[p] >= language.usual - NEAR and rs[0].rise >= RISE]
    votes: list[tuple[str, dict[str, Counter]]] = []
    taken = []
    for place, rs in sorted(ready, key=lambda x: (-after[x[0]], x[0])):
        own = {r.unit: r for r in rs if r.n >= MET / 2.0 and r.part >= CLEAR / 2.0}
        if sum(r.n for r in own.values() if r.unit == r.letter) > 0.95 * sum(r.n for r in own.values()):
            continue
        taken.append(place)
        for name, known in votes:
            shared = [r for u, r in own.items() if u in known]
            same = sum(r.n for r in shared if known[r.unit].most_common(1)[0][0] == r.letter)
            if name not in UTF8 and place not in UTF8 and same > 0.8 * sum(r.n for r in shared) > 0.4 * sum(r.n for r in own.values()):
                break
        else:
            known = {}
            votes.append((place, known))
        for u, r in own.items():
            known.setdefault(u, Counter())[r.letter] += r.n
    return {name: {u: c.most_common(1)[0][0] for u, c in known.items()} for name, known in votes}, taken


def _bigrams_of(words: DataFrame) -> np.ndarray:
    """How often words (word, n) of usual form have each bigram, as a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(w, n) for w, n in zip(*(c.to_pylist() for c in batch.columns)) if not (_ODD.search(w) or _C1.search(w))]
            codes = alphabet().codes(" " + " ".join(w for w, _ in kept) + " ").astype("i8")
            at, back = np.unique(codes[:-1] * alphabet().size + codes[1:], return_inverse=True)
            n = np.bincount(back, weights=np.repeat([n for _, n in kept], [len(w) + 1 for w, _ in kept])) if kept else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(at if kept else [], pa.int64()), pa.array(n, pa.float64())], names=["pair", "n"])

    return _language(words.select("word", "n").mapInArrow(run, "pair bigint, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect())


def _pair_of(rows: list, taken: set[str]) -> str | None:
    """The pair of code pages that agrees with nearly all of the letters learned by a cipher of single bytes."""
    total = sum(r.n for r in rows)
    scores = [(sum(r.n for r in rows if given.get(r.unit) == r.letter), n) for n in PAIRS if n not in taken and (given := _given(n))]
    score, pair = max(scores, default=(0.0, ""))
    return pair if score >= 0.93 * total > 0 else None


def _assigned(words: DataFrame, model) -> DataFrame:
    """``FOLLOWS`` of the words of each cipher by source, and with a blank first unit the words of each; pairs of garbled words for "language"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, ciphers = model.value
        mixture = Mixture(language, ciphers, {name: -3.0 for name, _, _ in ciphers}, tables=False)
        by_name = {c.name: c for c in mixture.utf8 + mixture.single}
        for batch in batches:
            rows = [*zip(*(c.to_pylist() for c in batch.columns))]
            read = mixture.judge({w for _, w, _ in rows})
            taken = [(read[w][0], s, w, n) for s, w, n in rows if w in read]
            yield _follows((c, s, by_name[c].units(w)) for c, s, w, _ in taken)
            usual = [(w, times) for _, _, w, times in taken if not _ODD.search(w) and not _C1.search(w)]
            at, n = _pairs([w for w, _ in usual], [times for _, times in usual])
            count = Counter()
            for c, s, _, times in taken:
                count[c, s] += times
            for s, _, times in rows:
                count["", s] += times
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["language"] * len(at) + [c for c, _ in count], pa.string()),
                    pa.array([""] * len(at) + [s for _, s in count], pa.string()),
                    pa.array([""] * (len(at) + len(count)), pa.string()),
                    pa.array([str(x) for x in at] + [""] * len(count), pa.string()),
                    pa.array([*n, *map(float, count.values())], pa.float64()),
                ],
                names=["cipher", "source", "a", "b", "n"],
            )

    return words.groupBy("source", "word").agg(F.sum("n").alias("n")).mapInArrow(run, FOLLOWS).groupBy("cipher", "source", "a", "b").agg(F.sum("n").alias("n"))


def learn(documents: DataFrame) -> tuple[Language, list[tuple[str, str | None, dict[str, str]]], DataFrame]:
    """(language, (cipher, code pages it agrees with, learned letters), (source, model)) from all of ``documents`` (source, text).

    To the driver come one number for each pair of classes of characters and the letters of
    each cipher; what belongs to single sources stays a table: ``model`` holds, as JSON, the
    logarithms of the shares of a source's ciphers and the letters it has of its own.
    """
    sc = documents.sparkSession.sparkContext
    counts = _language(count_bigrams(documents.select("text")).collect())
    language = Language(counts)
    sent = sc.broadcast(language)
    # few bytes and much work: spread by a fixed number, which isn't put together again
    words = cut(suspicious_words(documents, sent).repartition(2 * width(documents.sparkSession), "word"))
    ciphers, places = _joined(_solved(_places(words), sent).collect(), language)
    # what these places hold is no language
    if places:
        language = Language(np.maximum(counts - _bigrams_of(words.where(F.col("place").isin(places))), 0.0))
    follows = cut(_assigned(words, sc.broadcast((language, [(name, None, letters) for name, letters in ciphers.items()]))))
    garbled = np.zeros(counts.size)
    for r in follows.where("cipher = 'language'").collect():
        garbled[int(r.b)] = r.n
    language = Language(np.maximum(counts - garbled.reshape(counts.shape), 0.0))
    sent = sc.broadcast(language)
    pairs = follows.where("cipher NOT IN ('language', '') AND a <> ''")
    once_more = _solved(pairs.groupBy("cipher", "a", "b").agg(F.sum("n").alias("n")).withColumn("source", F.lit("")), sent, ciphers).where((F.col("n") >= MET) & (F.col("part") >= CLEAR))
    learned: dict[str, list] = defaultdict(list)
    for r in once_more.collect():
        learned[r.cipher].append(r)
    named: list[tuple[str, str | None, dict[str, str]]] = []
    for name in sorted(learned, key=lambda c: (-sum(r.n for r in learned[c]), c)):
        pair = None if name in UTF8 else _pair_of(learned[name], {p for _, p, _ in named if p})
        named.append((name, pair, {r.unit: r.letter for r in learned[name]}))
    logging.getLogger(__name__).info("letters learned: %s", {pair or name: len(letters) for name, pair, letters in named})
    own = _solved(pairs, sent, {name: letters for name, _, letters in named}).withColumn("units", F.sum("n").over(Window.partitionBy("cipher", "source")))
    own = own.where((F.col("n") >= MET) & (F.col("part") >= CLEAR) & ((F.col("units") >= ENOUGH_UNITS) | (F.col("n") > PRIOR))).select("cipher", "source", "unit", "letter")
    known = documents.sparkSession.createDataFrame([(c, u, x) for c, _, letters in named for u, x in letters.items()], "cipher string, unit string, usual string")
    differing = own.join(F.broadcast(known), ["cipher", "unit"], "left").where("usual IS NULL OR usual <> letter")  # at most the units of the ciphers
    letters = differing.groupBy("source").agg(F.collect_list(F.struct("cipher", "unit", "letter")).alias("letters"))
    totals = follows.where("cipher = ''").select("source", F.col("n").alias("total"))
    share = F.log((F.col("n") + 1e-3) / (F.col("total") + 1.0))
    met = follows.where("cipher NOT IN ('language', '') AND a = ''").join(totals, "source")
    shares = met.groupBy("source").agg(F.collect_list(F.struct("cipher", share.alias("share"))).alias("shares"))
    return language, named, shares.join(letters, "source", "left").select("source", F.to_json(F.struct("shares", "letters")).alias("model"))


def _finder(model, id_column: str, tables: bool):
    """What finds the affected of (id, source, text, model of the source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = Mixture(*model.value, tables=tables)
        known = {c.name: c for c in usual.utf8 + usual.single}
        mixtures: dict[str, Mixture] = {}

        def mixture_of(src: str, own: str | None) -> Mixture:
            of = json.loads(own) if own else {}
            shares = {x["cipher"]: x["share"] for x in of.get("shares", ())}
            letters: dict[str, dict[str, str]] = defaultdict(dict)
            for x in of.get("letters", ()):
                if not known[x["cipher"]].settled(x["unit"]):
                    letters[x["cipher"]][x["unit"]] = x["letter"]
            return usual.of_source(shares, letters)

        for batch in batches:
            ids, counts, texts = [], [], []
            by_source: dict[tuple, list] = defaultdict(list)
            for key, src, content, own in zip(*(c.to_pylist() for c in batch.columns)):
                if not content.isascii():
                    by_source[src, own].append((key, content))
            for (src, own), found_in in by_source.items():
                if src not in mixtures:
                    if len(mixtures) > 50:
                        mixtures.clear()
                    mixtures[src] = mixture_of(src, own)
                mixture = mixtures[src]
                at = {c.name: k for k, c in enumerate(mixture.single)}
                split = [[w for w in _words(content) if not w.isascii()] for _, content in found_in]
                every = sorted(set().union(*split))
                judged = mixture.judge(every)
                mixture.most([w for w in every if w.strip("\xa0")])
                for (key, content), in_order in zip(found_in, split):
                    words = set(in_order)
                    mine = {w: judged[w] for w in sorted(words & judged.keys())}
                    sure = {j[0] for j in mine.values() if j[1] > (MARGIN if j[0].startswith("utf_8>") else SINGLE_MARGIN)}
                    restored = {w: j[2] for w, j in mine.items() if j[0] in sure}
                    # words that another cipher reads as well are of the sure one
                    for k in sorted(at[name] for name in sure if name in at):
                        left = [w for w in words if w not in restored and w.strip("\xa0")]
                        better = [w for w, g in zip(left, mixture.gains(left)[:, k]) if g > 0] if left else []
                        restored |= {w: mixture.single[k].read(w, frozenset(c for c in w if c >= "\x80")) for w in better}
                    if more := mixture.together(in_order, {*restored}):
                        restored = more[1] | {w: j[2] for w, j in mine.items() if j[0] == more[0].name} | restored
                    lost = _C1.search(content)
                    found = sum(1 for w in words if w in restored or lost and _C1.search(w)) if restored or lost else 0
                    if found:
                        ids.append(key)
                        counts.append(found)
                        texts.append(re.sub(r"[^ \t\r\n]+", lambda m: restored.get(m.group(), m.group()), content))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], names=[id_column, "words", "restored"])

    return run


def find_garbled(documents: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", tables: bool = True) -> DataFrame:
    """(id, words, restored): affected documents, how many words are, and the text as far as it can be restored.

    ``words`` counts words with a garbled reading or a lost character; ``restored`` has
    U+FFFD where no letter is known.
    """
    rows = documents.select(F.col(id_column).alias("_id"), _source(source).alias("source"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    language, ciphers, models = learn(rows.select("source", "text"))
    model = documents.sparkSession.sparkContext.broadcast((language, ciphers))

    schema = T.StructType([T.StructField(id_column, T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("restored", T.StringType())])
    # a row for each source: sent to all where it is small, else joined by source
    models = cut(models)
    size = models.agg(F.coalesce(F.sum(F.length("model")), F.lit(0)).alias("n")).first().n
    return rows.join(F.broadcast(models) if size <= MOST_SENT else models, "source", "left").select("_id", "source", "text", "model").mapInArrow(_finder(model, id_column, tables), schema)
