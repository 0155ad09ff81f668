"""Distances, and scores that fall with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
#: (kilometres at most, score), the near ones first.
LADDER = ((15.0, 1.0), (40.0, 0.85), (80.0, 0.6), (150.0, 0.35))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rise, turn = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(rise), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(turn), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def distance_score(km: Column, same_district: Column, same_region: Column) -> Column:
    """The ladder where a distance is known; beyond it, and without one, what district and region say.

    Two places of one district beyond the ladder score .75, above its third step: the
    ladder isn't monotone, and is kept so.
    """
    score = None
    for most, value in LADDER:
        step = km <= most
        score = F.when(step, value) if score is None else score.when(step, value)
    far = F.when(same_district, 0.75).when(same_region, 0.45).otherwise(0.0)
    unknown = F.when(same_district, 0.7).when(same_region, 0.4).otherwise(0.0)
    return F.when(km.isNull(), unknown).otherwise(score.otherwise(far))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Is a point inside a ring, an array of struct(x, y)?  Crossings of a ray, odd is inside; edges by half."""
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda count, i: count
        + F.when(
            ((F.element_at(ring, i)["y"] > y) != (F.element_at(ring, i % n + 1)["y"] > y))
            & (
                x
                < (F.element_at(ring, i % n + 1)["x"] - F.element_at(ring, i)["x"])
                * (y - F.element_at(ring, i)["y"])
                / (F.element_at(ring, i % n + 1)["y"] - F.element_at(ring, i)["y"])
                + F.element_at(ring, i)["x"]
            ),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def from_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The distance of a point from the stretch between two others, which differ."""
    along = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (F.pow(bx - ax, 2) + F.pow(by - ay, 2))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt(F.pow(x - ax - along * (bx - ax), 2) + F.pow(y - ay - along * (by - ay), 2))
