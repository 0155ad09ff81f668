"""One consistent form for text that looks the same but is stored as other characters.

For each run of letters the scripts are resolved: every letter has the set of scripts
in which its shape can be written, and the sets are intersected along the run.

* One or more scripts remain: the run can be written in one script.  If its letters
  come from several, it is *mixed*; if they all come from one but another script can
  write the whole run too, it is a *whole-script* look-alike.  Either way it is spelled
  in the first remaining script of ``SCRIPTS``.
* No script remains: each letter is spelled in the first script that has its shape.

Both depend on shapes only, so runs that look the same come out the same.  Beside
that, what can't be seen is removed, any stretch of white space becomes one space
(none at the ends), apostrophes and hyphens become one sign each, forms that differ
in width or font lose that difference, and accents are composed with their letter.
Case, real letters (и and і, г and ґ), digits and other signs are kept apart.

Defined results: null stays null; an empty text, and one of which nothing can be seen,
give an empty text; very long texts are taken whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumizh.session import width

#: Scripts in which a run is spelled, the first one possible.
SCRIPTS = ("Cyrillic", "Latin", "Greek", "Armenian")

# Letters of one shape, written Cyrillic, Latin, Greek, Armenian ("." where
# the script has none), then letters of further scripts and variants with that shape.
SHAPES = """
А A Α . ᗅꓮᎪ
В B Β . ꓐᏴ
С C Ϲ . ꓚᏟⲤ
Е E Ε . ꓰᎬ
Н H Η . ꓧᎻⲎ
І I Ι . Ӏꓲⲓ
Ј J . . ꓙᎫ
К K Κ . ꓗᏦⲔ
М M Μ . ꓟᎷⲘ
О O Ο Օ ꓳⲞ
Р P Ρ . ꓑᏢⲢ
Ѕ S . Տ ꓢᏚ
Т T Τ . ꓔᎢⲦ
Х X Χ . ꓫⲬ
У Y Υ . ҮꓬⲨ
Ԛ Q . . .
Ԝ W . . ꓪᎳ
Ѵ V . . ꓦᏙ
. N Ν . ꓠⲚ
. Z Ζ . ꓜᏃⲌ
. L . . ꓡᏞ
. D . . ꓓᎠ
. R . . ꓣᎡᏒ
. G . . ꓖᏀ
. F . . ꓝ
. U . Ս ꓴ
а a α . ɑ
с c ϲ . ᴄⲥ
е e . . ℮
о o ο օ ᴏⲟ
р p ρ . ⲣ
х x . . .
у y . . .
і i . . .
ј j ϳ . .
ѕ s . . ꜱ
һ h . հ .
ԁ d . . .
ԛ q . զ .
ԝ w . . ᴡ
ѵ v ν . ᴠ
ӏ l . . .
. n . ո .
. u υ ս ᴜ
. g . ց ɡ
. z . . ᴢ
. f . ք .
к . κ . ĸᴋ
м . . . ᴍ
н . . . ʜ
т . . . ᴛ
в . . . ʙ
г . . . ᴦ
п . . . ᴨ
л . . . ᴫ
Г . Γ . Ⲅ
П . Π . Ⲡ
Ф . Φ . Ⲫ
Л . Λ . .
"""

# Signs that count as an apostrophe, and as a hyphen.
APOSTROPHES = "'’‘ʼ‛ʹʻʽˈˊˋ`´′‵＇｀՚׳΄᾽᾿ꞌ"
HYPHENS = "-‐‑‒–−﹣－⁃˗﹘֊"
APOSTROPHE, HYPHEN = "’", "-"

#: Compatibility forms that look like what they decompose to; others, such as №, stay.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>")
_BLANK = regex.compile(r"[\p{Z}\t\n\v\f\r\x85⠀ㅤﾠᅟᅠ]+")
_UNSEEN = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}]+")
_RUN = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_SCRIPT = {name: regex.compile(rf"\p{{Script={name}}}") for name in SCRIPTS}


class Shapes:
    """Letters by shape, from ``SHAPES``."""

    def __init__(self, table: str = SHAPES) -> None:
        self.of: dict[str, int] = {}
        self.spelled: list[dict[str, str]] = []
        for row in table.split("\n"):
            if row.strip():
                *letters, others = row.split()
                self.spelled.append({s: c for s, c in zip(SCRIPTS, letters) if c != "."})
                for c in [*letters, *others]:
                    if c != ".":
                        self.of[c] = len(self.spelled) - 1


_shapes = Shapes()


@lru_cache(maxsize=50_000)
def script_of(letter: str) -> str:
    for name, pattern in _SCRIPT.items():
        if pattern.match(letter):
            return name
    return "other"


@lru_cache(maxsize=50_000)
def _plain(c: str) -> str:
    """A character without the difference that its width or font makes."""
    if c in _shapes.of:
        return c
    form = unicodedata.decomposition(c)
    tag = form.partition(" ")[0]
    if tag in _SAME_LOOK or tag == "<compat>" and (0x2160 <= ord(c) <= 0x217F or 0xFB00 <= ord(c) <= 0xFB06 or 0x01C4 <= ord(c) <= 0x01CC):
        return unicodedata.normalize("NFKD", c)
    return c


@lru_cache(maxsize=50_000)
def spell(run: str) -> tuple[str, str]:
    """(consistent spelling, kind) of one run of letters; kind is plain, mixed, whole or none."""
    letters = unicodedata.normalize("NFD", run)
    possible: set[str] | None = None
    used: set[str] = set()
    for c in letters:
        if unicodedata.combining(c):
            continue
        shape = _shapes.of.get(c)
        own = script_of(c)
        used.add(own)
        scripts = set(_shapes.spelled[shape]) if shape is not None else {own}
        possible = scripts if possible is None else possible & scripts
    target = next((s for s in SCRIPTS if s in (possible or ())), None)
    out = []
    for c in letters:
        shape = _shapes.of.get(c)
        if shape is not None:
            spelled = _shapes.spelled[shape]
            c = spelled[target] if target in spelled else next(spelled[s] for s in SCRIPTS if s in spelled)
        out.append(c)
    kind = "none" if len(used) > 1 and target is None else "mixed" if len(used) > 1 else "whole" if target and target not in used else "plain"
    return unicodedata.normalize("NFC", "".join(out)), kind


_SIGNS = str.maketrans({**dict.fromkeys(APOSTROPHES, APOSTROPHE), **dict.fromkeys(HYPHENS, HYPHEN)})


def canonical(text: str | None) -> str | None:
    """The consistent form of a text; see the module's text."""
    if text is None:
        return None
    # runs of letters don't cross blanks, so that words, which recur, have their form on their own
    return " ".join(form for word in _BLANK.split(text) if word and (form := _of_word(word)))


@lru_cache(maxsize=50_000)
def _of_word(text: str) -> str:
    """The consistent form of a text without blanks."""
    if text.isascii() and text.isprintable() and not any(c.isalpha() for c in text):
        return text.translate(_SIGNS)
    text = _UNSEEN.sub("", text)
    text = text.translate(_SIGNS)
    text = "".join(c if c < "\x80" else _plain(c) for c in unicodedata.normalize("NFD", text))
    text = text.translate(_SIGNS)
    text = _RUN.sub(lambda m: spell(m.group())[0], text)
    return unicodedata.normalize("NFC", regex.sub(" +", " ", text).strip(" "))


def kinds(text: str | None) -> str | None:
    """The most telling kind of look-alike among the runs of a text."""
    if text is None:
        return None
    seen = _UNSEEN.sub("", text)
    found = {spell(m.group())[1] for m in _RUN.finditer("".join(_plain(c) for c in unicodedata.normalize("NFD", seen)))}
    return next((k for k in ("none", "mixed", "whole") if k in found), "plain")


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


#: As if not deterministic, so that a join's test for null isn't moved below distinct(), to a second call for every row.
@F.pandas_udf(T.StringType())
def _canonical_once(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


_canonical_once = _canonical_once.asNondeterministic()


@F.pandas_udf(T.StringType())
def lookalike_kind(texts: pd.Series) -> pd.Series:
    return texts.map(kinds, na_action="ignore")


def with_canonical(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """``df`` with the consistent form of ``column`` as ``out``."""
    return df.withColumn(out, canonical_text(F.col(column)))


def same_reading(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str) -> DataFrame:
    """Pairs of rows whose texts read the same and are stored as different strings.

    Texts are brought to their form once for each stored string, so that a name that
    fills a third of the table costs one call; pairs of equal strings are never built.
    """

    def forms(df: DataFrame, text: str) -> DataFrame:
        stored: Column = F.col(text)
        # few bytes and much work: spread by a fixed number of partitions
        texts = df.where(stored.isNotNull()).select(stored.alias("stored")).distinct().repartition(width(df.sparkSession), "stored")
        return texts.withColumn("canonical", _canonical_once(F.col("stored")))

    a = forms(left, left_text).select(F.col("stored").alias("a_text"), "canonical")
    b = forms(right, right_text).select(F.col("stored").alias("b_text"), "canonical")
    spellings = a.join(b, "canonical").where(F.col("a_text") != F.col("b_text")).select("a_text", "b_text")
    rows_a = left.select(F.col(left_id).alias("a_id"), F.col(left_text).alias("a_text"))
    rows_b = right.select(F.col(right_id).alias("b_id"), F.col(right_text).alias("b_text"))
    return spellings.join(rows_a, "a_text").join(rows_b, "b_text").select("a_id", "b_id")
