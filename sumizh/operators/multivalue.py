"""Several values in one field, one row each: dialects chosen by description length.

A *dialect* says how a field is written: as a JSON list, a numbered list, a bulleted
list, one whole value, or values between separators - one of every subset of the
separator kinds that stand in the field - with or without quoting.  Each reading of a
field costs

* the bits that name the dialect and its separators, and
* for each value v the bits of its code, log2(N / n_v), and its share of the bits
  that spell it once in the code book, SPELL * length(v) / n_v, where a separator
  within a value costs log2(N) more, as much as the border it could be,

where n_v is how often v is read in the whole table.  So without any evidence a field
is split at its separators, and a value that has one and is met alone stays whole.  The code book is counted over
all fields, first with every reading of a field having an equal share, then with the
cheapest readings of the first round.  Every field is parsed with its cheapest dialect.

All of this works on distinct fields with their counts; values meet their code lengths
in a join, so nothing has to fit on one machine, and a value that stands in a third of
the fields is one row of the code book.

Fixed names, given as ``whole``, are one value wherever they stand whole, so are texts
in quotation marks and in guillemets.

Defined results: a null, empty or blank field, and one of separators only, give no row;
empty pieces aren't counted; a value entered twice counts twice; a very long field is
read whole; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumizh.session import cut

#: Separator kinds; those that also stand inside names count only with space around them.
SEPARATORS = {
    "comma": r",",
    "ideographic": r"、",
    "semicolon": r";",
    "wide": r"；",
    "bar": r"\|",
    "slash": r"(?<=\s)/(?=\s)",
    "plus": r"(?<=\s)\+(?=\s)",
    "line": r"[\r\n]",
    "tab": r"\t",
    "and": r"(?<=\s)(?:та|і|й|and|und|oraz)(?=\s)",
}
#: Bits for a character of a value in the code book, for a dialect, and for a separator kind in it.
SPELL, DIALECT, KIND = 5.0, 4.0, 2.0

#: A piece of these only is empty.
MARKS = ",、;；|/+ \t\r\n\"•‣▪●*-–—[]\u00a0"

#: Signs that are a border unless values say otherwise; words for "and" are not.
_WITHIN = r"[,、;；|\r\n\t]|(?<=\s)[/+](?=\s)"

_BULLET = re.compile(r"(?:^|(?<=[\r\n]))\s*[•‣▪●*\-–—]\s+")
_NUMBER = re.compile(r"(?:^|(?<=\s))(\d{1,4})[.)]\s+")
_BEFORE = r"(?:^|[,、;；|\r\n\t\"\[(]|(?<!\S)[/+•\-–*]|(?<!\S)(?:та|і|й|and|und|oraz)|(?<!\S)\d{1,4}[.)])\s*"
_AFTER = r"(?=\s*(?:$|[,、;；|\r\n\t\"\])]|\s[/+](?:\s|$)|\s(?:та|і|й|and|und|oraz)\s|\s\d{1,4}[.)]\s))"


class Reader:
    """The readings of a field; ``whole`` are names that are one value where they stand whole."""

    def __init__(self, whole: Sequence[str]) -> None:
        names = "|".join(re.escape(w) for w in sorted(set(whole), key=lambda w: (-len(w), w)) if w)
        self.names = re.compile(rf"{_BEFORE}({names}){_AFTER}") if names else None
        self.kinds = {k: re.compile(p) for k, p in SEPARATORS.items()}

    def _kept(self, field: str, quotes: bool) -> list[tuple[int, int, str]]:
        """Stretches (start, end, value) that no separator splits; value is what they stand for."""
        kept: list[tuple[int, int, str]] = []
        at = 0
        while self.names and (m := self.names.search(field, at)):
            start, end = m.span(1)
            kept.append((start, end, m.group(1)))
            at = end
        for m in re.finditer(r"«[^«»]*»", field):
            kept.append((*m.span(), m.group()))
        if quotes:
            for m in re.finditer(r'(?:^|(?<=[,、;；|\r\n\t\s\[]))"((?:[^"]|"")*)"(?=\s*(?:$|[,、;；|\r\n\t\]]|\s[/+]|\s(?:та|і|й|and|und|oraz)\s))', field):
                kept.append((*m.span(), m.group(1).replace('""', '"')))
        kept.sort(key=lambda k: (k[0], -k[1]))
        out: list[tuple[int, int, str]] = []
        for k in kept:
            if not out or k[0] >= out[-1][1]:
                out.append(k)
            elif k[1] > out[-1][1]:
                out[-1] = (out[-1][0], k[1], field[out[-1][0] : k[1]])
        return out

    @staticmethod
    def _values(field: str, cuts: list[tuple[int, int]], kept: list[tuple[int, int, str]]) -> list[str]:
        """The pieces between ``cuts``; a piece that is one quoted stretch stands for its value."""
        enclosed = {(s, e): v for s, e, v in kept if field[s] == '"'}
        values, at = [], 0
        for start, end in [*cuts, (len(field), len(field))]:
            lo, hi = at, start
            while lo < hi and field[lo].isspace():
                lo += 1
            while hi > lo and field[hi - 1].isspace():
                hi -= 1
            value = enclosed.get((lo, hi), field[lo:hi]).strip()
            if value.strip(MARKS):
                values.append(value)
            at = end
        return values

    def readings(self, field: str) -> list[tuple[float, list[str]]]:
        """(bits of the dialect, values) of every reading, each list of values once, cheapest dialect first."""
        found: dict[tuple[str, ...], float] = {}

        def add(bits: float, values: list[str]) -> None:
            key = tuple(values)
            if values and bits < found.get(key, float("inf")):
                found[key] = bits

        text = field.strip()
        if text.startswith("[") and text.endswith("]"):
            try:
                listed = json.loads(text)
            except ValueError:
                listed = None
            if isinstance(listed, list) and all(isinstance(x, str) for x in listed):
                add(DIALECT, [x.strip() for x in listed if x.strip()])
                return [(bits, [*values]) for values, bits in found.items()]
        for quotes in (False, True) if '"' in field else (False,):
            kept = self._kept(field, quotes)
            # the cheapest reading of a field without any separator is the whole
            shift = DIALECT + (0.5 if quotes else 1.0 if '"' in field else 0.0)
            add(shift, self._values(field, [], kept))
            spans = [(s, e) for s, e, _ in kept]
            free = self._outside(spans)
            numbers, expected = [], 1
            for m in _NUMBER.finditer(field):
                if int(m.group(1)) == expected and free(m.start(1)):
                    numbers.append((m.start(), m.end()))
                    expected += 1
            if numbers and not field[: numbers[0][0]].strip():
                add(shift + KIND, self._values(field, numbers, kept))
            bullets = [m.span() for m in _BULLET.finditer(field) if free(m.end() - 1)]
            if bullets and not field[: bullets[0][0]].strip():
                add(shift + KIND, self._values(field, bullets, kept))
            present = {k: c for k, p in self.kinds.items() if (c := [m.span() for m in p.finditer(field) if free(m.start())])}
            for chosen in self._subsets([*present]):
                cuts = sorted(itertools.chain.from_iterable(present[k] for k in chosen))
                add(shift + KIND * len(chosen), self._values(field, cuts, kept))
        return [(bits, [*values]) for values, bits in sorted(found.items(), key=lambda x: (x[1], x[0]))]

    @staticmethod
    def _outside(spans: list[tuple[int, int]]):
        def free(position: int) -> bool:
            return not any(s <= position < e for s, e in spans)

        if len(spans) < 8:
            return free
        taken = bytearray(max(e for _, e in spans) + 1)
        for s, e in spans:
            taken[s:e] = b"\x01" * (e - s)
        return lambda position: position >= len(taken) or not taken[position]

    @staticmethod
    def _subsets(kinds: list[str]) -> Iterator[tuple[str, ...]]:
        for size in range(1, len(kinds) + 1):
            yield from itertools.combinations(kinds, size)


def _read(whole: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(whole)
        for batch in batches:
            cells, counts, numbers, bits, values, shares = [], [], [], [], [], []
            for cell, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = reader.readings(cell)
                for number, (cost, vals) in enumerate(found):
                    cells.append(cell)
                    counts.append(n)
                    numbers.append(number)
                    bits.append(cost)
                    values.append(vals)
                    shares.append(1.0 / len(found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cells, pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(numbers, pa.int32()),
                    pa.array(bits, pa.float64()),
                    pa.array(values, pa.list_(pa.string())),
                    pa.array(shares, pa.float64()),
                ],
                names=["cell", "n", "reading", "bits", "vals", "share"],
            )

    return run


def _code_book(readings: DataFrame, weight) -> DataFrame:
    """(val, code): the bits of each value that ``readings``, weighted, read."""
    counted = (
        readings.select(F.explode("vals").alias("val"), weight.alias("w")).groupBy("val").agg(F.sum("w").alias("uses"))
    )
    total = counted.agg(F.sum("uses").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(  # one row
        "val",
        (
            F.log2(F.col("total") / F.col("uses"))
            + (F.lit(SPELL) * F.length("val") + F.log2("total") * F.regexp_count("val", F.lit(_WITHIN))) / F.col("uses")
        ).alias("code"),
    )


def _cheapest(readings: DataFrame, book: DataFrame) -> DataFrame:
    """The reading of each cell that costs the fewest bits; the simpler dialect if equal."""
    costs = (
        readings.select("cell", "reading", "bits", F.explode("vals").alias("val"))
        .join(book, "val", "left")  # a value that no cheapest reading had is spelled out
        .groupBy("cell", "reading")
        .agg((F.first("bits") + F.sum(F.coalesce("code", F.lit(40.0) + F.lit(SPELL) * F.length("val") + 40 * F.regexp_count("val", F.lit(_WITHIN))))).alias("cost"))
    )
    best = costs.groupBy("cell").agg(F.min(F.struct(F.round("cost", 6).alias("cost"), "reading")).alias("best"))
    return readings.join(best.select("cell", F.col("best.reading").alias("reading")), ["cell", "reading"])


def split_values(df: DataFrame, id_column: str, column: str, whole: Sequence[str] = ()) -> DataFrame:
    """(id, pos, val): one row for each value in ``column``, ``pos`` from 1 within the field."""
    rows = df.select(F.col(id_column).alias("_id"), F.col(column).alias("cell")).where(F.col("cell").isNotNull())
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    readings = cut(
        cells.mapInArrow(_read([*whole]), "cell string, n bigint, reading int, bits double, vals array<string>, share double")
    )
    first = _cheapest(readings, _code_book(readings, F.col("n") * F.col("share")))
    final = _cheapest(readings, _code_book(first, F.col("n").cast("double")))
    exploded = rows.join(final.select("cell", "vals"), "cell").select("_id", F.posexplode("vals").alias("at", "val"))
    return exploded.select(F.col("_id").alias(id_column), (F.col("at") + 1).alias("pos"), "val")
