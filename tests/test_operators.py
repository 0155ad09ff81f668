"""Operators against brute force on small tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumizh.functions import geo
from sumizh.functions import text as X
from sumizh.functions import vectors as V
from sumizh.functions.names import resolve, sequence_ratio, stems, transcribe
from sumizh.operators import alignment as A
from sumizh.operators.graph import components, triangles
from sumizh.operators.multivalue import Reader, split_values
from sumizh.operators.ranking import first_of, global_rank, nearest_rank

WHOLE = ["K+K Partners", "Школа; Дім", "Rivers, Lakes and Towns", "Дія|Разом", "MOST-2"]


def pieces(spark, fields, whole=WHOLE):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "id long, f string")
    found: dict[int, list] = {i: [] for i in range(len(fields))}
    for r in split_values(df, "id", "f", whole).orderBy("id", "pos").collect():
        assert r.pos == len(found[r.id]) + 1
        found[r.id].append(r.val)
    return [found[i] for i in range(len(fields))]


def test_packed_fields(spark):
    fields = [
        None, "", " \t", ";,", "MOST-2", "MOST-2;MOST-2", "MOST-2, Школа; Дім та Alpha", "1. Alpha\n2. K+K Partners", "1) Alpha 2) Beta 2023", "• Alpha\n- MOST-2",
        '["Alpha", "Beta \\"x\\""]', '"Rivers, Lakes and Towns"、Alpha', '"Fund ""Step"""\tAlpha', 'Fund "Step", Alpha', "Дія|Разом|Alpha", "Alpha / Beta + MOST-2", ";; Alpha ;  ", "«Alpha, Beta», MOST-2",
    ]
    wanted = [
        [], [], [], [], ["MOST-2"], ["MOST-2", "MOST-2"], ["MOST-2", "Школа; Дім", "Alpha"], ["Alpha", "K+K Partners"], ["Alpha", "Beta 2023"], ["Alpha", "MOST-2"],
        ["Alpha", 'Beta "x"'], ["Rivers, Lakes and Towns", "Alpha"], ['Fund "Step"', "Alpha"], ['Fund "Step"', "Alpha"], ["Дія|Разом", "Alpha"], ["Alpha", "Beta", "MOST-2"], ["Alpha"], ["«Alpha, Beta»", "MOST-2"],
    ]
    assert pieces(spark, fields) == wanted


def test_packed_fields_edges(spark):
    repeated = ["Alpha; Beta"] * 5 + ["Alpha"] * 30 + ["Beta"] * 30
    assert pieces(spark, repeated, [])[:5] == [["Alpha", "Beta"]] * 5
    long = ",".join(f"value{i}" for i in range(3000))
    assert [len(x) for x in pieces(spark, [long, "x"], [])] == [3000, 1]
    empty = spark.createDataFrame([], "id long, f string, cell string, vals int")
    assert split_values(empty, "id", "f").count() == 0
    clash = spark.createDataFrame([(1, "a,b", "z", 3)], "id long, f string, cell string, vals int")
    assert [tuple(r) for r in split_values(clash, "id", "f").orderBy("pos").collect()] == [(1, 1, "a"), (1, 2, "b")]


def test_mdl_keeps_a_common_whole(spark):
    """A value with a separator that stands alone often costs less as a whole."""
    fields = ["Home, Garden"] * 40 + ["Home, Garden; Alpha", "Alpha; Beta"] * 5
    found = pieces(spark, fields, [])
    assert found[0] == ["Home, Garden"] and found[40] == ["Home, Garden", "Alpha"]


def test_readings_are_distinct():
    reader = Reader(WHOLE)
    found = [tuple(v) for _, v in reader.readings('A, "B; C" | D')]
    assert len(found) == len(set(found)) and ("A", "B; C", "D") in found


def test_ranks(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, float("nan"), 1.0, 2.5, 2.5, 3.0, rnd.random()])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v double")
    ranked = {r.id: r.rank for r in global_rank(df.where("v IS NOT NULL AND NOT isnan(v)"), [F.desc("v"), F.asc("id")]).collect()}
    wanted = [i for _, i in sorted((-v, i) for i, v in rows if v is not None and v == v)]
    assert [i for i, _ in sorted(ranked.items(), key=lambda x: x[1])] == wanted
    values = sorted(v for _, v in rows if v is not None and v == v)
    k = min(max(round(0.9 * len(values)), 1), len(values))
    assert nearest_rank(df, "v", 90.0).first().value == values[k - 1]


@pytest.mark.parametrize("n", [1, 5, 9, 15, 16, 25])
def test_nearest_rank_is_half_even(spark, n):
    df = spark.createDataFrame([(float(i + 1),) for i in range(n)], "v double")
    assert nearest_rank(df, "v", 90.0).first().value == float(min(max(round(0.9 * n), 1), n))


def test_first_of(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), (None, 1, "n")], "k string, v int, w string")
    assert {(r.k, r.w) for r in first_of(df, ["k"], [("v", True)], ["w"]).collect()} == {("a", "y"), ("b", "z"), (None, "n")}


def test_components(spark):
    rnd = random.Random(2)
    edges = {tuple(sorted(rnd.sample(range(120), 2))) for _ in range(90)} | {(i, i + 1) for i in range(200, 260)}
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    found = {r.node: r.component for r in components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert found == {n: root(n) for n in parent}


def test_triangles(spark):
    rnd = random.Random(3)
    edges = {tuple(sorted(rnd.sample(range(25), 2))) for _ in range(110)}
    found = {tuple(r) for r in triangles(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert found == {(a, b, c) for a in range(25) for b in range(a, 25) for c in range(b, 25) if {(a, b), (b, c), (a, c)} <= edges}


def test_search(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    found = V.search(df.where("vec_id % 100 = 0"), df, "vec_id", "embedding", 3).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 1500, 100):
        like = np.round(u @ u[q], 6)
        order = [i for i in np.lexsort((np.arange(1500), -like)) if i != q][:3]
        assert [r.id for r in sorted((r for r in found if r["query"] == q), key=lambda r: r.place)] == order


def _blend(x: list[np.ndarray], shared: float = 0.9) -> dict[tuple[int, int], float]:
    """The similarity of every two owners, given their lines, written down plainly."""
    owner = np.repeat(range(len(x)), [len(m) for m in x])
    raw = np.concatenate(x)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-8)
    v, like = unit(raw - raw.mean(axis=0)), unit(raw) @ unit(raw).T
    w = np.array([1 / (1 + math.log1p(max(len({owner[j] for j in np.flatnonzero(like[i] >= shared)} - {owner[i]}) - 2, 0))) for i in range(len(raw))])
    found = {}
    for a in range(len(x)):
        for b in range(a + 1, len(x)):
            p, q = owner == a, owner == b
            m, k = v[p] @ v[q].T, min(p.sum(), q.sum())
            side = lambda best, u: np.average(np.sort(best)[::-1][:k], weights=u[np.argsort(-best, kind="stable")][:k])
            aligned = (side(m.max(axis=1), w[p]) + side(m.max(axis=0), w[q])) / 2
            centre = unit(np.average(v[p], axis=0, weights=w[p])) @ unit(np.average(v[q], axis=0, weights=w[q]))
            found[a, b] = max(0.0, 0.65 * aligned + 0.35 * centre)
    return found


def _owners(spark, x: list[np.ndarray], numbers: list[int]):
    rows = [(100 * n + i, n, [float(c) for c in v]) for n, m in zip(numbers, x) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id bigint, owner int, v array<double>")


def test_owner_similarity(spark, monkeypatch):
    """Owners far apart in number meet, lines in many blocks do too, shared lines weigh less, the mean is taken off first."""
    rnd = np.random.default_rng(4)
    x = [rnd.normal(size=(n, 6)) + 1.0 for n in (1, 3, 8, 20, 5, 2)]
    for m in x[1:]:
        m[0] = x[0][0] + 0.001 * rnd.normal(size=6)
    numbers = [0, 1, 2, 13, 30, 47]
    monkeypatch.setattr(A, "BLOCK", 7)
    found = {(r.a, r.b): r.similarity for r in A.owner_similarity(_owners(spark, x, numbers)).collect()}
    wanted = {(numbers[a], numbers[b]): v for (a, b), v in _blend(x).items()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-5 for k in wanted)


def test_focused_owners_are_more_alike_than_broad_ones(spark):
    e = np.linalg.qr(np.random.default_rng(0).normal(size=(8, 8)))[0]
    focused = [np.stack([e[0], 0.9 * e[0] + 0.1 * e[1]]), np.stack([e[0], 0.85 * e[0] + 0.15 * e[2]])]
    broad = [e[:6], np.stack([e[(i + 1) % 8] for i in range(6)])]
    found = {(r.a, r.b): r.similarity for r in A.owner_similarity(_owners(spark, focused + broad, [0, 1, 2, 3])).collect()}
    assert found[0, 1] > 0.2 and found[0, 1] > found[2, 3]


def test_kinds_of_lines_are_blended(spark):
    """.65 of the operational and .35 of the strategic where both owners have both; the operational alone; else all lines."""
    from sumizh.plans.vectors import line_kinds_blend

    rnd = np.random.default_rng(2)
    sets = [_owners(spark, [rnd.normal(size=(4, 5)) for _ in n], n) for n in ([1, 2, 3, 4], [1, 2, 3], [1, 2])]
    of = lambda d: {(r.a, r.b): r.similarity for r in A.owner_similarity(d).collect()}
    every, ops, strat = map(of, sets)
    found = {(r.a, r.b): (r.similarity, r.lines) for r in line_kinds_blend(*sets).collect()}
    assert found[1, 2] == (pytest.approx(0.65 * ops[1, 2] + 0.35 * strat[1, 2], abs=1e-6), "both")
    assert found[1, 3] == (ops[1, 3], "operational") and found[3, 4] == (every[3, 4], "all") and len(found) == 6


def test_near_score_by_hand(spark):
    from sumizh.plans.pairs import near_score

    cases = [(1.0, 0.5, 0.25, round(0.55 + 0.125 + 0.05, 3)), (0.9, None, None, 0.9), (0.9, 0.5, None, round((0.55 * 0.9 + 0.125) / 0.8, 3)), (0.8, 1.0, 1.0, None)]
    rows = spark.createDataFrame(cases, "geo double, sizes double, shared double, wanted double")
    assert all(r.found == r.wanted for r in rows.select("wanted", near_score(F.col("geo"), F.col("sizes"), F.col("shared")).alias("found")).collect())


def test_nearest_rank_by_hand(spark):
    from sumizh.operators.ranking import nearest_rank

    rnd = np.random.default_rng(8)
    for values in ([3.0], [1.0, 2.0, 2.0, 9.0, 10.0], list(np.round(rnd.normal(size=5001), 3))):
        ordered = sorted(values)
        wanted = ordered[min(max(round(0.9 * len(values)), 1), len(values)) - 1]
        assert [r.value for r in nearest_rank(spark.createDataFrame([(v,) for v in map(float, values)], "x double"), "x", 90.0).collect()] == [wanted]


def test_name_order_is_whole(spark, monkeypatch):
    from sumizh.plans import entities as E

    names = [f"{a}{b}" for a in "щґєабїгзьюя" for b in "ґгіїиєеяь" for _ in (0, 1)]
    df = spark.createDataFrame([(f"UA{i:04}", n) for i, n in enumerate(names)], "katottg string, name string")
    monkeypatch.setattr(E, "latest_entities", lambda *_: df)
    found = [(r.place, r.katottg) for r in E.name_order(spark, "").collect()]
    alphabet = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя"
    wanted = sorted(range(len(names)), key=lambda i: ([alphabet.index(c) for c in names[i]], i))
    assert sorted(found) == [(k, f"UA{i:04}") for k, i in enumerate(wanted, 1)] and len(found) > 100


def test_geo(spark):
    row = spark.range(1).select(
        geo.haversine_km(F.lit(50.45), F.lit(30.52), F.lit(49.84), F.lit(24.03)).alias("km"),
        *(geo.distance_score(F.lit(d).cast("double"), F.lit(s), F.lit(r)).alias(f"s{i}") for i, (d, s, r) in enumerate([(10, False, False), (200, True, True), (200, False, True), (None, True, True), (None, False, False)])),
        geo.in_ring(F.lit(1.0), F.lit(1.0), F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (3, 0), (0, 3)]))).alias("inside"),
        geo.in_ring(F.lit(2.0), F.lit(2.0), F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (3, 0), (0, 3)]))).alias("outside"),
    ).first()
    assert 465 < row.km < 472
    assert [row[f"s{i}"] for i in range(5)] == [1.0, 0.75, 0.45, 0.7, 0.0]
    assert row.inside and not row.outside


def test_text(spark):
    df = spark.createDataFrame([("Ціль 1: Розвиток сільських клубів\n  1.1. Ремонт дахів у селах\n• x\nНаша довга назва без числа",), (None,)], "t string")
    rows = df.select(F.explode_outer(X.goal_lines(F.col("t"))).alias("l")).select("l", X.line_kind(F.col("l")).alias("k"), X.line_number(F.col("l")).alias("n"), X.clean_line(F.col("l")).alias("c")).collect()
    assert [(r.k, r.n) for r in rows][:3] == [("strategic", "1"), ("operational", "1.1"), ("other", "")]
    assert rows[1].c == "Ремонт дахів у селах"
    row = spark.range(1).select(
        X.host(F.lit("HTTPS://www.Rada.example:80/a?b")).alias("h"), X.homepage(F.lit("https://rada.example/x")).alias("p"), X.slug(F.lit(" План 2024: Дії ")).alias("s"), X.clip(F.lit("one two three"), 9).alias("c"),
        X.without_suffix(F.lit("Ясна сільська територіальна громада")).alias("w"),
    ).first()
    assert tuple(row) == ("rada.example", "https://rada.example/", "план-2024-дії", "one two…", "Ясна")


def test_names(spark):
    row = spark.range(1).select(transcribe(F.lit("Щастя Їжак")).alias("t"), stems(F.lit("Тихівська")).alias("s")).first()
    assert row.t == "schtschastja jischak" and row.s == ["тихівська", "тихів"]
    names = spark.createDataFrame([(1, "Тихівська", "A"), (2, "Тихівська", "C"), (3, "Тихів", "B"), (4, "Нема", "A"), (5, None, None)], "id int, name string, region string")
    places = spark.createDataFrame([("p1", "Тихівська", "A"), ("p2", "Тихівська", "B")], "place string, name string, region string")
    assert {(r.id, r.place, r.how) for r in resolve(names, places).collect()} == {(1, "p1", "name_region"), (2, None, "none"), (3, "p2", "stem_region"), (4, None, "none"), (5, None, "none")}
    ratio = spark.createDataFrame([("abcd", "abce"), (None, "x")], "a string, b string").select(sequence_ratio("a", "b").alias("r")).collect()
    assert ratio[0].r == 0.75 and ratio[1].r is None


def test_long_lines(spark):
    """Cases worked out by hand."""
    long = "Стратегічна ціль 1: " + "розвиток сільських клубів і бібліотек, " * 3 + "Ціль 2: ремонт дахів у школах громади"
    clauses = "перша довга частина рядка без цифр; " * 4 + "коротко"
    rows = [
        (1, long, ["ціль 1: " + ("розвиток сільських клубів і бібліотек, " * 3).rstrip(" ,"), "Ціль 2: ремонт дахів у школах громади"]),
        (2, clauses, ["перша довга частина рядка без цифр"] * 4),
        (3, "коротка ціль; ще одна", ["коротка ціль; ще одна"]),
        (4, "коротко\n• " + "а" * 200, ["а" * 200]),
        (5, None, None),
        (6, "", []),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "id int, t string")
    assert {r.id: r.e for r in df.select("id", X.expanded_lines(F.col("t")).alias("e")).collect()} == {i: e for i, _, e in rows}


def test_line_kind_by_hand(spark):
    cases = [("1.2. " + "довгий рядок " * 8, "operational"), ("Ціль 1 " + "довгий " * 14, "strategic"), ("просто довгий рядок " * 5, "strategic"), ("просто рядок", "other"), ("3. Дороги", "strategic")]
    found = spark.createDataFrame(cases, "line string, kind string").select("kind", X.line_kind(F.col("line")).alias("found")).collect()
    assert all(r.kind == r.found for r in found)


def test_mentions(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Кошти програми «SOLARA»; потім SOLARA без слова" + " " * 60 + "SOLARA"), (2, None), (3, ""), (4, "кошти програма 1000")], "id int, t string")
    names = spark.createDataFrame([(f"Програма {i}", f"програма {i}") for i in range(1001)] + [("Solara", "solara")], "name string, low string")
    monkeypatch.setattr(X, "NAMES_AT_ONCE", 300)  # four groups; the last name counts as well as the first
    found = X.mentions(df.where("t IS NOT NULL").withColumn("t", F.lower("t")), "id", "t", names, ["кошти"], 40).collect()
    assert sorted(tuple(r) for r in found) == [(1, 17, "Solara", "кошти"), (1, 32, "Solara", "кошти"), *((4, 7, f"Програма {n}", "кошти") for n in (1, 10, 100, 1000))]


def test_cliques_of_four_take_their_triangles(spark):
    """A clique of four, a triangle that shares an edge with it, one that shares nothing, and five nodes that are all joined."""
    from itertools import combinations

    from sumizh.operators.graph import cliques4, maximal, triangles

    groups = ["abcd", "cde", "xyz", "pqrst"]
    pairs = sorted({p for g in groups for p in combinations(g, 2)})
    edges = spark.createDataFrame(pairs, "a string, b string")
    three = triangles(edges)
    found = {"".join(r.members) for r in maximal(three, cliques4(three, edges)).collect()}
    assert found == {"abcd", "cde", "xyz", *("".join(c) for c in combinations("pqrst", 4))}


def test_points_in_gaps_go_to_the_nearest(spark):
    from sumizh.plans.panels import nearest_area

    square = lambda x, y: [dict(x=a, y=b) for a, b in ((x, y), (x + 2.0, y), (x + 2.0, y + 2.0), (x, y + 2.0))]
    areas = spark.createDataFrame([("one", square(0.0, 0.0)), ("two", square(5.0, 0.0))], "area string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.5, 0.5), (3, 3.0, 1.0), (4, 4.5, 1.0), (5, -7.0, 9.0), (6, 3.5, 1.0)], "id int, x double, y double")
    found = {r.id: (r.area, r.how) for r in nearest_area(points, areas, "id").collect()}
    assert found == {1: ("one", "inside"), 2: ("two", "inside"), 3: ("one", "nearest"), 4: ("two", "nearest"), 5: ("one", "nearest"), 6: ("one", "nearest")}


def test_closest_duplicate_is_the_best_of_all():
    import difflib

    from sumizh.plans.lines import closest_duplicate

    a = ["Розвиток мережі сільських доріг громади", "коротко", "Ремонт дахів у школах і ліцеях громади"]
    b = ["Розвиток мережі сільських доріг громад", "Ремонт дахів у школах громади", "Зовсім інший рядок без спільного"]
    ratio = lambda x, y: difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio()
    best = max(((x, y, ratio(x, y)) for x in a for y in b if min(len(x), len(y)) >= 20), key=lambda t: t[2])
    assert closest_duplicate(a, b)[:2] == best[:2]
    assert closest_duplicate(a, ["щось геть інше про бюджет участі"]) is None and closest_duplicate([], b) is None


def test_word_vectors_meet_in_blocks(spark, monkeypatch):
    """A word that all rows have, several blocks on either side, and ties; against all products."""
    from sumizh.plans import documents as D

    rnd = np.random.default_rng(6)
    rows = [(i, w, round(float(rnd.uniform(0.1, 1.0)), 2)) for i in range(1, 301) for w in ["all", *rnd.choice(["u", "v", "w", "x", "y", "z"], size=3, replace=False)]]
    vectors = spark.createDataFrame(rows, "id bigint, w string, x double")
    monkeypatch.setattr(D, "ENTRIES", 150)
    found = {(r["query"], r.place): (r.id, r.similarity) for r in D.sparse_search(vectors.where("id % 100 = 0"), vectors, 5).collect()}
    of = {}
    for i, w, x in rows:
        of.setdefault(i, {})[w] = x
    for q in (100, 200, 300):
        like = sorted((-round(sum(v * of[i].get(w, 0.0) for w, v in of[q].items()), 6), i) for i in of if i != q)[:5]
        assert [(i, -v) for v, i in like] == [pytest.approx(found[q, k + 1]) for k in range(5)]


def test_more_than_six_kinds_of_separators(spark):
    """Programmes known from many fields, in one field with seven kinds of separators, of which two are within values."""
    names = ["Рівний Край", "Вода + Світло", "Дім / Сад", "Solara", "Обрій", "Крок", "Гай"]
    rows = [(i, f"{a}; {b}") for i, (a, b) in enumerate((a, b) for a in names for b in names if a != b)] * 3
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(1000, "Рівний Край, Вода + Світло; Дім / Сад | Solara\tОбрій\nКрок та Гай")]
    found = split_values(spark.createDataFrame(rows, "id long, t string"), "id", "t").where("id = 1000").orderBy("pos").collect()
    assert [r.val for r in found] == names
