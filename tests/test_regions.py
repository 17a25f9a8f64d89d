"""Areas as tables against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leadlattice.operators import areas, diagnostics, regions

OUTLINE = "area_id int, at int, lat double, lng double"


def star(rng, lat, lng, size, n):
    return [(lat + size * k * math.sin(2 * math.pi * i / n), lng + size * k * math.cos(2 * math.pi * i / n)) for i in range(n) for k in [rng.uniform(0.3, 1)]]


def holds(outline, lat, lng):
    inside = False
    for (y1, x1), (y2, x2) in zip(outline, [*outline[1:], outline[0]], strict=True):
        if (y1 > lat) != (y2 > lat) and lng < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def test_points_meet_the_areas_that_hold_them(spark):
    """Areas of very different sizes, one in another, one across the zero lines; a point without coordinates; an outline of two points."""
    rng = random.Random(2)
    outlines = {i: star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), 10 ** rng.uniform(-3, 0.5), rng.randint(3, 12)) for i in range(40)}
    outlines[40] = [(1.0, 1.0), (2.0, 2.0)]
    points = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(300)]
    points += [(300 + i, *(c + rng.uniform(-1e-3, 1e-3) for c in outlines[i][0])) for i in range(40)] + [(999, None, 1.0)]
    got = regions.points_in_areas(spark.createDataFrame(points, "id long, lat double, lng double"), spark.createDataFrame([(a, i, *p) for a, o in outlines.items() for i, p in enumerate(o)], OUTLINE)).collect()
    want = {(i, a) for i, lat, lng in points if lat is not None for a, o in outlines.items() if len(o) > 2 and holds(o, lat, lng)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 60
    assert regions.points_in_areas(spark.createDataFrame([], "id long, lat double, lng double"), spark.createDataFrame([], OUTLINE)).count() == 0


SQUARE = {"box": (True, ((44.0, 15.0), (44.0, 16.0), (45.0, 16.0), (45.0, 15.0)))}


def test_a_spike_between_samples_is_found(spark):
    """8 km beyond the border are allowed. An area that stays within touches; one with a spike of 0.2 km at its far side does not stay."""
    km = 1 / 111.32
    top = 45.0 + 7.9 * km
    flat = [(44.5, 15.4), (44.5, 15.6), (top, 15.6), (top, 15.4)]
    spike = [(44.5, 15.4), (44.5, 15.6), (top, 15.6), (top, 15.5005), (top + 0.2 * km, 15.5), (top, 15.4995), (top, 15.4)]
    out = [(50.0, 15.0), (50.0, 15.1), (50.1, 15.1)]
    around = [(43.0, 14.0), (43.0, 17.0), (46.0, 17.0), (46.0, 14.0)]
    corner = [(45.0 + 5 * km, 16.0 + 0.06), (45.0 + 5.2 * km, 16.0 + 0.06), (45.0 + 5.2 * km, 16.0 + 0.062)]
    still = [(44.5, 15.5), (44.5, 15.5), (44.5, 15.5)]
    shapes = [flat, spike, out, around, corner, still]
    got = areas.check_areas(spark.createDataFrame([(a, i, *p) for a, o in enumerate(shapes) for i, p in enumerate(o)], OUTLINE), regions=SQUARE).collect()
    assert {r["area_id"]: r["verdict"] for r in got} == {0: "inside", 1: "beyond", 2: "outside", 3: "outside", 4: "inside", 5: "inside"}
    assert {r["area_id"] for r in got if r["region"] == "box"} == {0, 1, 4, 5}


def test_the_share_outside_is_that_of_many_samples(spark):
    rng = random.Random(4)
    ring = [(rng.uniform(4, 10) * math.cos(a / 2), rng.uniform(4, 10) * math.sin(a / 2)) for a in range(12)]
    ways = [(i, *(rng.uniform(-15, 15) for _ in range(4))) for i in range(60)]
    got = {r["id"]: r["outside"] for r in regions.share_outside(spark.createDataFrame(ways, "id int, x1 double, y1 double, x2 double, y2 double"), ring, 1.5).collect()}

    def far(x, y):
        near = min(math.dist((x, y), (x1 + t * (x2 - x1), y1 + t * (y2 - y1))) for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True) for t in [max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / math.dist((x1, y1), (x2, y2)) ** 2))])
        return near > 1.5 and not holds([(b, a) for a, b in ring], y, x)

    for i, x1, y1, x2, y2 in ways:
        share = sum(far(x1 + (k + 0.5) / 400 * (x2 - x1), y1 + (k + 0.5) / 400 * (y2 - y1)) for k in range(400)) / 400
        assert abs(share - got[i]) < 0.02


def test_covers(spark):
    circles = spark.createDataFrame([(1, 43.5, 16.4, 10.0), (2, 60.0, 5.0, 1.0)], "area_id int, lat double, lng double, radius_km double")
    n = {r["area_id"]: r["count"] for r in regions.cover_circles(circles, 3.0).groupBy("area_id").count().collect()}
    assert n == {1: areas.cover_circle(spark, 43.5, 16.4, 10, 3).count(), 2: 1}
    square = ((43.0, 16.0), (43.0, 16.4), (43.3, 16.4), (43.3, 16.0))
    outlines = spark.createDataFrame([(7, i, *p) for i, p in enumerate(square)], OUTLINE)
    assert regions.cover_areas(outlines, 3.0).count() == areas.cover(spark, areas.Area.polygon(square), 3.0).count() == 36
    with pytest.raises(ValueError, match="too many cells"):
        regions.cover_areas(outlines, 0.01)
    with pytest.raises(ValueError, match="positive"):
        regions.cover_areas(outlines, 0.0)


def test_a_failed_search_loses_its_cell_only(spark):
    """Of four full quarters one fails: it is reported and not asked again, and no search runs twice."""
    asked = []

    def search(cells):
        asked.extend((round(r["lat"], 4), round(r["lng"], 4), r["depth"], r["query"]) for r in cells.collect())
        lost = (F.col("depth") == 1) & (F.col("lat") > 43.5) & (F.col("lng") > 16.4)
        return cells.select("*", F.concat_ws(":", F.round("lat", 4), F.round("lng", 4), "query").alias("source_id"), F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"), F.when(F.col("depth") < 2, 60).otherwise(3).alias("raw_count"), F.when(lost, "HTTP 503").alias("error"))

    one = spark.createDataFrame([(43.5, 16.4, 8.0, 0)], "lat double, lng double, half_side_km double, depth int")
    got = areas.sweep(one, spark.createDataFrame([("boat",)], "query string"), search, max_depth=3)
    assert len(asked) == len(set(asked)) == 1 + 4 + 12
    assert [r["error"] for r in got.failed.collect()] == ["HTTP 503"]
    assert got.places.count() == 1 + 3 + 12 and got.unresolved.count() == 0
    c = diagnostics.sweep_counters(got.searches, got.unresolved, got.failed).first()
    assert (c["searches"], c["calls"], c["raw_places"], c["deepest"], c["failed_searches"], c["unresolved_cells"]) == (16, 4 * 3 + 12, 4 * 60 + 36, 2, 1, 0)
