"""Records of two sources that describe the same thing, without a common key.

1. Each record is brought to fields that can be compared: the name's code (letters of
   either script in one transcription, endings and titles cut off), its type, region,
   district, size, the name and digits in its web address, and the digits of its code.
   Records with equal fields are one class, which is compared once.
2. *Sorted neighbourhood*: all classes of both sources are sorted by several composite
   keys at once (name and region, the name reversed, the name from its middle, the name
   in the address, region and size), each followed by size and digits, so that classes
   with an equal key lie beside those that are most alike.  The sorted list is cut by
   ranges of the keys, and a window slides over each part and over each border, so that
   no key, however common, makes a large task.  Within the window, classes of different
   sources are compared by weighted field similarities, which gives a confidence.  More
   than ``WINDOW`` classes of one name can't all meet in a window; for these, and only
   these, the classes of one name meet in a join as well, salted into blocks.
3. Classes of the first source with one code, or with one name, type, region and size,
   are one thing; likewise classes of the second taken for one name and region in one
   district.  Classes of the second whose region or district is not known belong to the
   thing of the second source that prefers the same partner and, where there is none, to
   one of their own for each preferred partner.  *One-to-one assignment* of things by an
   auction: things of the second source bid for those of the first, prices rise, until
   nobody gains by another bid, which brings the total confidence within ``STEP`` per
   thing of its maximum.  Pairs that have no rival need no auction.
4. Districts are known to the second source only.  Which part of a code stands for
   which district is counted over pairs of high confidence, and the confidence of every
   pair found is completed by it.

Defined results: records without a name are not matched; null fields count neither for
nor against; repeated rows and several records of one thing each give a pair; of equal
confidences one is preferred by a hash of the fields; an empty table gives no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sumizh.llm.canon import edits, simple, transcribed
from sumizh.session import cut, width

#: Classes that a class is compared with on either side, by sort key.
WINDOW = 12
#: Classes of a source with one name that a block holds about; it bounds tasks, not what is compared.
CELL = 256
#: Confidence that a pair must reach, and one that is certain enough to learn districts from.
LEAST, SURE = 0.62, 0.85
#: Least gain for which the auction goes on.
STEP = 0.01
#: Points of each field: for equality, for clear inequality.
WEIGHTS = {"name": (5.0, -9.0), "type": (0.7, -2.5), "region": (2.0, -5.0), "size": (2.0, -6.0), "address": (2.0, 0.0), "digits": (5.0, -5.0), "district": (1.5, -3.0)}

# Words of titles that are no part of a name, and what tells the type.
TITLES = (
    "територіальна територіальної територіальна територіальну громада громади громаді громад терторіальна рада ради виконавчий комітет стратегія стратегії розвитку план плану "
    "відновлення програма центром об’єднана об’єднаної року роки область області районна "
    "terytorialna territorialnaia terytorialnaia hromada gromada community council territorial strategy strategiia rozvytku plan vidnovlennia"
).split()
_LONGEST_TITLE = max(map(len, TITLES))
TYPES = (
    (r"сільс|сіл\.|silsk|центром у с\.|selsk(?:aia|a)\b", 1),
    (r"селищ|сел\.|selyshch|selisch|selishch|selysch|\bсмт\b|\bsmt\b", 2),
    (r"міськ|міс\.|misk|gorodsk|центром у м\.", 3),
)
_TYPE = [(re.compile(p), n) for p, n in TYPES]
_TYPE_WORD = re.compile(r"^(?:сільс|селищн|міськ|silsk|selyshchn|selischn|selishchn|selyschn|misk)\w*$|^(?:сіл|сел|міс|тер|смт|тг|отг|рр|обл|smt|otg)$")


_SHORT = re.compile(r"(?<!центром у )(?<![^\W\d_])([^\W\d_]{1,6})\.\s*(?=\w)")
_NUMBERED = re.compile(r"\([^)]*\d[^)]*\)")
_JOINED = re.compile(r"(?<=\w)[-–](?=\w)")
_TITLE_WORD = re.compile(r"[^\W\d_]+(?:’[^\W\d_]+)*")


@lru_cache(maxsize=50_000)
def code(text: str) -> str:
    """Letters of a word in one transcription in which the usual ones agree."""
    latin = re.sub(r"[^a-z]", "", transcribed(text).replace("’", "").replace("ь", ""))
    latin = latin.replace("shch", "sch").replace("y", "i").replace("zh", "z").replace("j", "z").replace("g", "h").replace("kh", "x").replace("ts", "c")
    return re.sub(r"(.)\1+", r"\1", latin)


def stem(word: str) -> str:
    """The code of an adjective without its ending."""
    found = code(word)
    cut_off = re.sub(r"(?<=.{4})(?:sk|ck|zk)(?:aia|oii|oi|oho|oe|oiu|a|e|i|o|u)?$", "", found)
    return cut_off if cut_off != found else re.sub(r"(?<=.{5})(?:aia|oi|a|e|i)$", "", found)


def name_of(title: str) -> tuple[str, str]:
    """(code of the name in a title, code of its abbreviated beginning): the longest word that is no word of titles."""
    plain = _JOINED.sub("", _NUMBERED.sub(" ", simple(title)))
    best = ""
    for word in _TITLE_WORD.findall(plain):
        if len(word) > len(best) and not _TYPE_WORD.match(word) and not _is_title(word):
            best = word
    short = next((m.group(1) for m in _SHORT.finditer(plain) if plain.startswith(best, m.end())), "") if best and "." in plain else ""
    return stem(best), code(short) if short and not _TYPE_WORD.match(short) else ""


@lru_cache(maxsize=50_000)
def _is_title(word: str) -> bool:
    if len(word) < 4:
        return True
    if len(word) > _LONGEST_TITLE + 2:
        return False
    return any(edits(word, t, 2 if len(t) > 7 else 1) <= (2 if len(t) > 7 else 1) for t in TITLES)


def type_of(title: str) -> int:
    plain = simple(title)
    return next((n for p, n in _TYPE if p.search(plain)), 0)


def place_of(text: str | None) -> str:
    """The code of a region or district without the words for these."""
    plain = re.sub(r"\b(?:область|області|обл|oblast|район|району|р-н|raion|rayon)\b\.?", " ", simple(text or ""))
    found = [w for w in re.findall(r"[^\W\d_]{4,}", plain) if edits(w, "область", 2) > 2 and edits(w, "район", 1) > 1]
    return code(found[0]) if found else ""


def address_of(url: str | None) -> tuple[str, str]:
    """(code of the name, digits) in the first part of a host; both empty for a shared host."""
    host = re.sub(r"^[a-z]+://", "", (url or "").strip().lower()).split("/")[0].split("#")[0].split("?")[0]
    host = re.sub(r"^www\.", "", host)
    if not host or "register" in host:
        return "", ""
    parts = [p for p in re.split(r"[-.]", host) if p not in ("rada", "otg", "hromada", "example", "gov", "ua", "com", "org", "www", "tg", "mr", "sr")]
    names = [p for p in parts if p.isalpha()]
    digits = [p for p in parts if p.isdigit()]
    return (stem(max(names, key=len)) if names else "", digits[0] if digits else "")


FIELDS = "name string, short string, type int, region string, district string, size bigint, address string, adigits string, kdigits string"


def _fields(rows: DataFrame) -> DataFrame:
    """``FIELDS`` of rows (id, title, region, district, size, url, code)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        region = lru_cache(maxsize=20_000)(place_of)
        for f in frames:
            address = [address_of(u) for u in f["url"]]
            names = [name_of(t) for t in f["title"]]
            yield pd.DataFrame(
                {
                    "id": f["id"],
                    "name": [n for n, _ in names],
                    "short": [a for _, a in names],
                    "type": [type_of(t) for t in f["title"]],
                    "region": [region(r) for r in f["region"]],
                    "district": [region(d) for d in f["district"]],
                    "size": f["size"].astype("Int64"),
                    "address": [a for a, _ in address],
                    "adigits": [d for _, d in address],
                    "kdigits": [re.sub(r"\D", "", simple(c)) if c else "" for c in f["code"]],
                }
            )

    typed = rows.select("id", *(F.col(c).cast("string").alias(c) for c in ("title", "region", "district")), F.col("size").cast("bigint").alias("size"), "url", "code")
    return typed.where("title IS NOT NULL").mapInPandas(run, f"id bigint, {FIELDS}").where("name <> ''")


def name_likeness(a: str, b: str) -> float:
    """1 for equal codes, falling with edits; 0 beyond three of them or a quarter of the name."""
    if a == b:
        return 1.0
    most = min(3, max(1, min(len(a), len(b)) // 4))
    distance = edits(a, b, most)
    return 0.0 if distance > most else 1.0 - 0.16 * distance


@lru_cache(maxsize=100_000)
def place_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 0.8 if edits(a, b, 2) <= (1 if min(len(a), len(b)) < 7 else 2) else 0.0


@lru_cache(maxsize=100_000)
def district_likeness(a: str, b: str) -> float:
    """Districts differ by few letters, so only equal ones are certain."""
    return 1.0 if a == b else 0.65 if edits(a, b, 1) == 1 else 0.0


def size_likeness(a: float, b: float) -> float:
    """1 for equal or rounded sizes, falling to 0 at two fifths of difference."""
    off = abs(a - b) / max(a, b, 1.0)
    return 1.0 if off <= 0.004 else 0.9 if off <= 0.02 or abs(a - b) <= 50 else max(0.0, 0.75 * (1.0 - off / 0.4))


def points(p, c) -> float | None:
    """Points of all fields but the district for two records to describe the same thing; None if names rule it out."""
    if c.short:
        likeness = 0.95 if p.name.startswith(c.short) and p.name.endswith(c.name) and len(p.name) > len(c.name) + 1 else 0.0
    else:
        likeness = name_likeness(p.name, c.name)
    beside = 0.0
    if c.address and len(c.address) >= 5:
        if p.name == c.address or p.name.startswith(c.address) or (p.address and p.address == c.address):
            beside = min(1.0, len(c.address) / 12)
        elif len(c.address) >= 10 and name_likeness(p.name, c.address) == 0.0:
            beside = -0.5
    if likeness == 0.0 and not (beside == 1.0 and p.name == c.address):
        return None
    if likeness == 0.0:
        likeness = 0.4 if edits(p.name, c.short + c.name, 5) <= 5 else 0.0
        if not likeness:
            return None
    yes, no = WEIGHTS["name"]
    total = yes * likeness + no * (1.0 - likeness)
    total += beside * WEIGHTS["address"][0]

    def add(field: str, value: float) -> None:
        nonlocal total
        total += WEIGHTS[field][0] * value + WEIGHTS[field][1] * (1.0 - value)

    if p.type and c.type:
        add("type", float(p.type == c.type))
    if p.region and c.region:
        add("region", place_likeness(p.region, c.region))
    if p.size > 0 and c.size > 0:
        add("size", size_likeness(p.size, c.size))
    ends = [d for d in (p.adigits, p.kdigits[-5:]) if d]
    if c.adigits and ends:
        add("digits", float(c.adigits in ends))
    return total


#: Points of a confidence of 1 beyond those of an even chance.
FULL = sum(WEIGHTS[f][0] for f in ("name", "region"))


def confidence(total: Column) -> Column:
    """How surely two records describe the same thing, from 0 to 1, from their points."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.5 * (total - 2.0) / FULL))


#: Points that a pair needs for ``LEAST``, and before its district is known.
ENOUGH = (2.0 * LEAST - 1.0) * FULL + 2.0 - 1e-9
ALMOST = ENOUGH - WEIGHTS["district"][0]


class Records:
    """Records in arrays, for comparing many pairs at once."""

    def __init__(self, f: pd.DataFrame) -> None:
        self.rows = f[RECORD].fillna({"size": 0})
        self.type, self.size = f["type"].to_numpy(), f["size"].fillna(0).to_numpy("f8")
        self.names, self.at = self._numbered(f["name"], f["address"], f["address"])
        self.name, self.address, _ = self.at
        self.regions, (self.region,) = self._numbered(f["region"])
        _, (self.adigits, self.kend) = self._numbered(f["adigits"], f["kdigits"].str[-5:])
        self.short = (f["short"] != "").to_numpy()
        self.length = np.array([len(n) for n in self.names])
        # how often each letter is in a word: a bound of the edits between two words
        every = np.frombuffer("".join(self.names).encode("latin-1", "replace"), dtype="u1").astype("i8") % 32
        self.letters = np.bincount(32 * np.repeat(np.arange(len(self.names)), self.length) + every, minlength=32 * len(self.names)).reshape(-1, 32)

    @staticmethod
    def _numbered(*columns: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
        """The different texts of the columns, the empty one first, and each column as their numbers."""
        codes, texts = pd.factorize(np.concatenate([[""], *(c.to_numpy(dtype=object) for c in columns)]))
        return texts, np.split(codes[1:], len(columns))

    def score(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, points) of the pairs of records i of the first source and j of the second that may be enough.

        What numbers can rule out is left out for many pairs at once: regions that are
        unlike, fields with which even equal names aren't enough, names with more
        different letters than edits are allowed.  The rest is compared one by one.
        """
        own, other = self.region[i], self.region[j]
        known = (own != 0) & (other != 0)
        near = own == other
        for k in np.flatnonzero(known & ~near):
            near[k] = place_likeness(self.regions[own[k]], self.regions[other[k]]) > 0
        most = np.full(len(i), WEIGHTS["name"][0])
        most += np.where(known, WEIGHTS["region"][0], 0.0)
        most += np.where(self.length[self.address[j]] >= 5, WEIGHTS["address"][0], 0.0)
        both = (self.type[i] != 0) & (self.type[j] != 0)
        most += np.where(both, np.where(self.type[i] == self.type[j], *WEIGHTS["type"]), 0.0)
        a, b = self.size[i], self.size[j]
        off = np.abs(a - b) / np.maximum(np.maximum(a, b), 1.0)
        size = np.where((off <= 0.02) | (np.abs(a - b) <= 50), 1.0, np.maximum(0.0, 0.75 * (1.0 - off / 0.4)))
        yes, no = WEIGHTS["size"]
        most += np.where((a > 0) & (b > 0), yes * size + no * (1.0 - size), 0.0)
        digits = self.adigits[j]
        told = (digits != 0) & ((self.adigits[i] != 0) | (self.kend[i] != 0))
        most += np.where(told, np.where((digits == self.adigits[i]) | (digits == self.kend[i]), *WEIGHTS["digits"]), 0.0)
        kept = (near | ~known) & (most >= ALMOST)
        i, j = i[kept], j[kept]
        x, y = self.name[i], self.name[j]
        shorter = np.minimum(self.length[x], self.length[y])
        allowed = np.minimum(3, np.maximum(1, shorter // 4))
        apart = np.abs(self.letters[x] - self.letters[y]).sum(axis=1)
        kept = (x == y) | self.short[j] | (x == self.address[j]) | ((apart <= 2 * allowed) & (np.abs(self.length[x] - self.length[y]) <= allowed))
        i, j = i[kept], j[kept]
        met = zip(self.rows.iloc[i].itertuples(index=False), self.rows.iloc[j].itertuples(index=False))
        found = np.array([np.nan if (v := points(p, c)) is None else v for p, c in met], dtype="f8")
        kept = found >= ALMOST
        return i[kept], j[kept], found[kept]


def _keys() -> F.Column:
    name, region = F.col("name"), F.col("region")
    key = lambda n, value: F.struct(F.lit(n).alias("k"), value.alias("key"))
    return F.array(
        key(0, F.concat_ws("|", name, region, F.col("type"))),
        key(1, F.concat_ws("|", F.reverse(name), region)),
        key(2, F.concat_ws("|", F.substring(name, 7, 60), F.substring(name, 1, 6), region)),
        key(3, F.when((F.col("src") == 1) & (F.length("address") >= 5), F.concat_ws("|", "address", region)).when(F.col("src") == 0, F.concat_ws("|", name, region))),
        key(4, F.when((region != "") & F.col("size").isNotNull(), F.concat_ws("|", region, F.lpad(F.col("size").cast("string"), 10, "0"), name))),
    )


def _sorted(classes: DataFrame) -> DataFrame:
    """All classes by all keys in one list, sorted by range partitions; ``part`` and ``at`` tell the place."""
    keyed = classes.withColumn("by", F.explode(_keys())).select("*", F.col("by.k").alias("k"), F.col("by.key").alias("key")).drop("by").where("key IS NOT NULL")
    order = ["k", "key", "size", "adigits", "src", "rid"]
    return cut(
        keyed.repartitionByRange(width(classes.sparkSession), *order)
        .sortWithinPartitions(*order)
        .drop("key")
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )


PAIRS = "p string, c string, points double, digits string, district string"
RECORD = ["name", "short", "type", "region", "size", "address", "adigits", "kdigits"]


def _scored(f: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """``PAIRS`` of the rows i of the first source and j of the second of a frame that may be enough."""
    i, j, found = Records(f).score(i, j)
    p, c = f.iloc[i], f.iloc[j]
    digits = np.where(p["kdigits"].str.len() == 17, p["kdigits"].str[:4], "")
    return pd.DataFrame({"p": p["rid"].to_numpy(), "c": c["rid"].to_numpy(), "points": found, "digits": digits, "district": c["district"].to_numpy()})


def _within(f: pd.DataFrame, crosses: np.ndarray | None = None) -> pd.DataFrame:
    """Pairs of different sources within the window; with ``crosses``, only those on either side of a border."""
    k, src = f["k"].to_numpy(), f["src"].to_numpy()
    place = None if crosses is None else f["rank"].to_numpy()
    left, right = [], []
    for d in range(1, min(len(f), WINDOW + 1)):
        met = (k[:-d] == k[d:]) & (src[:-d] != src[d:])
        if crosses is not None:
            met &= (crosses[:-d] != crosses[d:]) & (place[d:] - place[:-d] <= WINDOW)
        a = np.flatnonzero(met)
        left.append(np.where(src[a] == 0, a, a + d))
        right.append(np.where(src[a] == 0, a + d, a))
    if not left:
        return _scored(f, np.zeros(0, dtype=int), np.zeros(0, dtype=int))
    return _scored(f, np.concatenate(left), np.concatenate(right))


def _neighbours(classes: DataFrame) -> DataFrame:
    """``PAIRS`` of classes that come near each other in the sorted list."""
    ranked = _sorted(classes)

    def slide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: pd.DataFrame | None = None
        for f in frames:
            if len(f):
                joined = f if last is None else pd.concat([last, f], ignore_index=True)
                yield _within(joined)
                last = joined.tail(WINDOW)

    inside = ranked.mapInPandas(slide, PAIRS)
    # the rows beside each border between parts: a few for each
    counts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at")).where((F.col("at") < WINDOW) | (F.col("at") >= F.col("n") - WINDOW))
    stretch = lambda c: F.floor(F.col(c) / WINDOW)
    borders = starts.where("start > 0").select(F.col("start").alias("border"), stretch("start").alias("stretch"))
    near = placed.withColumn("stretch", F.explode(F.sequence(stretch("rank") - 1, stretch("rank") + 1)))
    beside = near.join(F.broadcast(borders), "stretch").where((F.col("rank") >= F.col("border") - WINDOW) & (F.col("rank") < F.col("border") + WINDOW))

    def over(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank", ignore_index=True)
        return _within(f, (f["rank"] >= f["border"]).to_numpy())

    return inside.unionAll(beside.groupBy("border").applyInPandas(over, PAIRS))


def _same_name(classes: DataFrame) -> DataFrame:
    """``PAIRS`` of classes of one name where these are too many to meet in a window, in blocks."""
    counted = classes.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *(F.ceil(F.count_if(F.col("src") == s) / CELL).cast("int").alias(f"{x}_cells") for s, x in enumerate("pc")))
    crowded = classes.join(counted.where(f"n > {WINDOW} AND p_cells > 0 AND c_cells > 0").drop("n"), "name")
    salt = F.abs(F.xxhash64("rid"))
    own = lambda cells: F.array((salt % F.col(cells)).cast("int"))
    every = lambda cells: F.sequence(F.lit(0), F.col(cells) - 1)
    spread = crowded.withColumn("p_cell", F.explode(F.when(F.col("src") == 0, own("p_cells")).otherwise(every("p_cells"))))
    spread = spread.withColumn("c_cell", F.explode(F.when(F.col("src") == 1, own("c_cells")).otherwise(every("c_cells"))))

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        p, c = (np.flatnonzero(f["src"].to_numpy() == s) for s in (0, 1))
        parts = [_scored(f, np.repeat(some, len(c)), np.tile(c, len(some))) for some in np.array_split(p, max(1, len(p) * len(c) // 100_000))]
        return pd.concat(parts)

    return spread.groupBy("name", "p_cell", "c_cell").applyInPandas(meet, PAIRS)


def _candidates(classes: DataFrame) -> DataFrame:
    found = _neighbours(classes).unionAll(_same_name(classes))
    return cut(found.groupBy("p", "c").agg(*(F.max(x).alias(x) for x in ("points", "digits", "district"))))


def _with_districts(pairs: DataFrame, districts) -> DataFrame:
    """(p, c, conf) of pairs that are enough, with the points of their districts."""

    @F.pandas_udf(T.DoubleType())
    def told(digits: pd.Series, district: pd.Series) -> pd.Series:
        yes, no = WEIGHTS["district"]

        @lru_cache(maxsize=50_000)
        def of(d: str, name: str) -> float:
            seen = districts.value.get(d)
            if not seen or not name:
                return 0.0
            value = max(share * district_likeness(known, name) for known, share in seen.items())
            return yes * value + no * (1.0 - value)

        return pd.Series([of(d, n) for d, n in zip(digits, district)], dtype="f8")

    total = pairs.withColumn("points", F.col("points") + told("digits", "district"))
    return total.where(F.col("points") >= ENOUGH).select("p", "c", confidence(F.col("points")).alias("conf"))


def _learn_districts(pairs: DataFrame) -> dict[str, dict[str, float]]:
    """Shares of the districts for each four digits of codes, from pairs that are sure; a bounded table."""
    counted = pairs.where((confidence(F.col("points")) >= SURE) & (F.col("digits") != "") & (F.col("district") != "")).groupBy("digits", "district").count()
    # at most 10,000 digits with their ten commonest districts
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("digits").orderBy(F.desc("count"), "district"))).where("r <= 10").collect()
    found: dict[str, dict[str, float]] = {}
    for r in top:
        found.setdefault(r.digits, {})[r.district] = float(r["count"])
    return {digits: {d: min(1.0, n / max(seen.values())) for d, n in seen.items() if n >= 0.2 * max(seen.values())} for digits, seen in found.items()}


def _spelled(district: F.Column, districts) -> F.Column:
    """A district in its usual spelling: the only learned one within two edits."""

    @F.pandas_udf(T.StringType())
    def nearest(values: pd.Series) -> pd.Series:
        known = {d for seen in districts.value.values() for d in seen}

        @lru_cache(maxsize=20_000)
        def find(value: str) -> str:
            if value in known or not value:
                return value
            near = [d for d in known if edits(value, d, 1) <= 1] or [d for d in known if edits(value, d, 2) <= 2]
            return near[0] if len(near) == 1 else ""

        return values.map(find)

    return nearest(district)


def _things(classes: DataFrame) -> DataFrame:
    """(p, thing): what the classes of the first source describe.

    A class without a whole code is the coded thing of its name, type, region and size,
    if there is only one; what is unknown on either side fits anything.  Coded things
    are counted for each choice of fields left out, so that no name becomes a product.
    """
    p = classes.where("src = 0").select(F.col("rid").alias("p"), "name", "type", "region", "size", "kdigits")
    coded = p.where("length(kdigits) = 17").withColumn("thing", F.concat(F.lit("k"), "kdigits"))
    plain = p.where("length(kdigits) <> 17")
    told = {"type": F.col("type") != 0, "region": F.col("region") != "", "size": F.col("size").isNotNull()}
    value = {f: F.coalesce(F.when(known, F.col(f).cast("string")), F.lit("?")) for f, known in told.items()}
    masked = lambda rows, options: reduce(lambda x, f: x.withColumn(f"m_{f}", F.explode(options(f))), told, rows)
    keys = ["name", *(f"m_{f}" for f in told)]
    # of the coded: as they are, and left out; of the others: the same value or unknown, or anything
    offered = masked(coded.select("name", "type", "region", "size", "thing").distinct(), lambda f: F.array(value[f], F.lit("*")))
    offered = offered.groupBy(*keys).agg(F.min("thing").alias("low"), F.max("thing").alias("high"))
    asked = masked(plain, lambda f: F.when(told[f], F.array(value[f], F.lit("?"))).otherwise(F.array(F.lit("*"))))
    found = asked.join(offered, keys).groupBy("p").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high").select("p", F.col("low").alias("found"))
    own = plain.join(found, "p", "left")
    return coded.select("p", "thing").unionAll(
        own.select("p", F.coalesce("found", F.concat_ws("|", F.lit("n"), "name", "type", "region", F.coalesce(F.col("size").cast("string"), F.lit("")))).alias("thing"))
    )


def _bidders(classes: DataFrame, pairs: DataFrame, things: DataFrame, districts) -> DataFrame:
    """(c, bidder): the things of the second source."""
    # the partner that a class prefers, and the name it is taken for
    best = pairs.join(things, "p").groupBy("c").agg(F.max(F.struct("conf", "thing", "p")).alias("b")).select("c", F.col("b.p").alias("p"), F.col("b.thing").alias("first"), "b.conf")
    named = best.join(classes.where("src = 0").select(F.col("rid").alias("p"), F.concat_ws("|", "name", "region").alias("taken_for")), "p")
    c = classes.where("src = 1").select(F.col("rid").alias("c"), "region", _spelled(F.col("district"), districts).alias("district")).join(named, "c")
    whole = c.where("region <> '' AND district <> ''").select("c", "first", "conf", F.concat_ws("|", "taken_for", "district").alias("bidder"))
    prefers = whole.groupBy("first").agg(F.max(F.struct("conf", "bidder")).alias("b")).select("first", F.col("b.bidder").alias("beside"))
    vague = c.where("region = '' OR district = ''").join(prefers, "first", "left")
    return whole.select("c", "bidder").unionAll(vague.select("c", F.coalesce("beside", F.concat(F.lit("#"), "first")).alias("bidder")))


def _auction(offers: DataFrame) -> DataFrame:
    """(bidder, thing) of the offers (bidder, thing, conf) that an auction settles, each at most once."""
    rivals = offers.withColumns({"bids": F.count(F.lit(1)).over(Window.partitionBy("thing")), "choices": F.count(F.lit(1)).over(Window.partitionBy("bidder"))})
    rivals = cut(rivals)
    alone = rivals.where("bids = 1 AND choices = 1").select("bidder", "thing")
    offers = cut(rivals.where("bids > 1 OR choices > 1").select("bidder", "thing", "conf"))
    state = offers.sparkSession.createDataFrame([], "thing string, bidder string, price double, round int")
    for turn in count(1):
        waiting = offers.join(state.select("bidder"), "bidder", "left_anti").join(state.select("thing", "price"), "thing", "left")
        gains = waiting.withColumns({"price": F.coalesce("price", F.lit(0.0)), "gain": F.col("conf") - F.coalesce("price", F.lit(0.0))}).where("gain > 0")
        order = Window.partitionBy("bidder").orderBy(F.desc("gain"), "thing")
        best = gains.withColumns({"r": F.row_number().over(order), "next": F.lead("gain", 1, 0.0).over(order)}).where("r = 1")
        bids = best.select("bidder", "thing", (F.col("price") + F.col("gain") - F.col("next") + STEP).alias("bid"))
        won = bids.groupBy("thing").agg(F.max(F.struct("bid", "bidder")).alias("w")).select("thing", F.struct(F.col("w.bidder").alias("bidder"), F.col("w.bid").alias("price"), F.lit(turn).alias("round")).alias("new"))
        held = state.select("thing", F.struct("bidder", "price", "round").alias("old"))
        state = cut(held.join(won, "thing", "full").select("thing", F.coalesce("new", "old").alias("s")).select("thing", "s.*"))
        if state.where(F.col("round") == turn).isEmpty():
            return alone.unionAll(state.select("bidder", "thing"))


def match_entities(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, conf): rows (id, title, region, district, size, url, code) of two sources that describe the same."""
    rows = _fields(left).withColumn("src", F.lit(0)).unionByName(_fields(right).withColumn("src", F.lit(1)))
    fields = ["src", "name", "short", "type", "region", "district", "size", "address", "adigits", "kdigits"]
    members = cut(rows.withColumn("rid", F.md5(F.to_json(F.struct(*fields)))))
    grouped = cut(members.select("rid", *fields).dropDuplicates(["rid"]))
    found = _candidates(grouped)
    districts = left.sparkSession.sparkContext.broadcast(_learn_districts(found))
    pairs = cut(_with_districts(found, districts))
    things = cut(_things(grouped))
    bidders = cut(_bidders(grouped, pairs, things, districts))
    offers = pairs.join(things, "p").join(bidders, "c").groupBy("bidder", "thing").agg(F.max("conf").alias("conf"))
    offers = cut(offers)
    settled = _auction(offers).join(offers, ["bidder", "thing"])
    # all rows of a thing with all rows of what it was settled with
    classes = settled.join(things, "thing").join(bidders, "bidder").select("p", "c", "conf")
    return (
        classes.join(members.where("src = 0").select(F.col("rid").alias("p"), F.col("id").alias("left_id")), "p")
        .join(members.where("src = 1").select(F.col("rid").alias("c"), F.col("id").alias("right_id")), "c")
        .select("left_id", "right_id", "conf")
    )
