"""Search areas: covering cells, adaptive sweeps, permitted regions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.functions import geo
from leadlattice.operators import regions as region_joins
from leadlattice.staging import staged

#: Fixed value: places returned for a cell and query at most, and how far outside a border a region reaches.
RESULT_CAP, TOLERANCE_KM = 60, 8.0
#: Outlines of markets as (lat, lng), and whether they are open.
REGIONS = {
    "croatia": (True, (
        (45.60, 13.55), (45.52, 13.95), (45.60, 14.25), (45.48, 14.60), (45.45, 14.90), (45.50, 15.15), (45.62, 15.35), (45.72, 15.55), (45.88, 15.70), (46.05, 16.00),
        (46.22, 16.15), (46.38, 16.30), (46.54, 16.60), (46.48, 16.90), (46.32, 17.20), (46.10, 17.55), (45.98, 17.95), (45.92, 18.35), (46.02, 18.60), (46.18, 18.80),
        (45.92, 19.00), (45.78, 19.05), (45.48, 19.15), (45.20, 19.45), (45.10, 19.10), (45.15, 18.75), (45.05, 18.35), (45.10, 17.60), (45.20, 16.90), (45.00, 16.50),
        (44.85, 16.20), (44.55, 16.10), (44.25, 16.35), (43.95, 16.70), (43.65, 17.05), (43.45, 17.30), (43.20, 17.65), (42.95, 17.90), (42.75, 18.35), (42.55, 18.55),
        (42.35, 18.55), (42.30, 17.90), (42.60, 17.20), (42.85, 16.30), (43.10, 15.60), (43.60, 15.10), (44.20, 14.55), (44.60, 14.30), (44.62, 13.85), (44.68, 13.50),
        (45.10, 13.32), (45.45, 13.35),
    )),
    "serbia": (False, (
        (46.18, 19.10), (46.15, 20.30), (45.75, 21.05), (44.85, 22.70), (44.05, 22.60), (43.20, 22.98), (42.35, 22.55), (42.25, 21.60), (43.00, 20.35), (43.70, 19.20),
        (44.30, 19.10), (44.90, 19.00), (45.20, 19.45),
    )),
}


def local_ring(outline: tuple[tuple[float, float], ...]) -> tuple[list[tuple[float, float]], float, float]:
    """(ring in km, reference lat, reference lng) of an outline; fewer than three points are no area."""
    if len(outline) < 3:
        raise ValueError("an area needs at least three points")
    lat, lng = (sum(p[i] for p in outline) / len(outline) for i in (0, 1))
    across = geo.KM_PER_DEGREE * math.cos(math.radians(lat))
    return [((b - lng) * across, (a - lat) * geo.KM_PER_DEGREE) for a, b in outline], lat, lng


@dataclass(frozen=True)
class Area:
    """A ring in kilometres around a reference point."""

    ring: tuple[tuple[float, float], ...]
    lat: float
    lng: float

    @staticmethod
    def circle(lat: float, lng: float, radius_km: float) -> Area:
        return Area(tuple(geo.circle_ring(radius_km)), lat, lng)

    @staticmethod
    def polygon(points: tuple[tuple[float, float], ...]) -> Area:
        ring, lat, lng = local_ring(points)
        return Area(tuple(ring), lat, lng)

    @property
    def km2(self) -> float:
        return geo.ring_area(self.ring)

    def holds(self, lat: Column, lng: Column) -> Column:
        return geo.in_ring(*geo.to_km(lat, lng, self.lat, self.lng), self.ring)


def auto_half_side(km2: Column) -> Column:
    """Half the side of a cell by the size of the area."""
    return F.when(km2 <= 25, 1.5).when(km2 <= 120, 3.0).when(km2 <= 400, 4.0).otherwise(5.0)


def cell_shapes(cells: DataFrame) -> DataFrame:
    """Adds to cells the radius of their covering circle, their corners as north, south, east and west, which are the rectangle of a search."""
    dy, dx = F.col("half_side_km") / geo.KM_PER_DEGREE, F.col("half_side_km") / (F.lit(geo.KM_PER_DEGREE) * F.cos(F.radians("lat")))
    return cells.withColumn("radius_km", F.col("half_side_km") * math.sqrt(2) * geo.RADIUS_SLACK).withColumn("north", F.col("lat") + dy).withColumn("south", F.col("lat") - dy).withColumn("east", F.col("lng") + dx).withColumn("west", F.col("lng") - dx)


def cover(spark: SparkSession, area: Area, half_side_km: float, max_cells: int = 400) -> DataFrame:
    """(lat, lng, half_side_km, depth): the squares of a grid from the area's lower left corner that meet the area, which may be any polygon.

    A square meets it if an edge runs through the square (their boxes overlap and the square's corners are not all on one side of the
    edge), or if the square's centre is inside. The grid is bounded by max_cells, and so is its join with the edges.
    """
    if half_side_km <= 0:
        raise ValueError("cells need a positive size")
    xs, ys = [p[0] for p in area.ring], [p[1] for p in area.ring]
    nx, ny = (max(1, math.ceil((max(v) - min(v)) / (2 * half_side_km))) for v in (xs, ys))
    if nx * ny > 100 * max_cells:
        raise ValueError("the area needs too many cells")
    h = half_side_km
    grid = spark.range(nx * ny).withColumn("x", F.lit(min(xs)) + h * (2 * F.pmod("id", F.lit(nx)) + 1)).withColumn("y", F.lit(min(ys)) + h * (2 * F.expr(f"id div {nx}") + 1))
    edges = spark.createDataFrame(list(zip(*zip(*area.ring, strict=True), *zip(*[*area.ring[1:], area.ring[0]], strict=True), strict=True)), "x1 double, y1 double, x2 double, y2 double")
    side = lambda sx, sy: (F.col("x2") - F.col("x1")) * (F.col("y") + sy * h - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x") + sx * h - F.col("x1"))
    sides = [side(sx, sy) for sx in (-1, 1) for sy in (-1, 1)]
    boxes = (F.least("x1", "x2") <= F.col("x") + h) & (F.greatest("x1", "x2") >= F.col("x") - h) & (F.least("y1", "y2") <= F.col("y") + h) & (F.greatest("y1", "y2") >= F.col("y") - h)
    through = boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    crossed = grid.crossJoin(F.broadcast(edges)).where(through).select("id").distinct().withColumn("crossed", F.lit(True))
    cells = grid.join(crossed, "id", "left").where(F.coalesce("crossed", F.lit(False)) | geo.in_ring(F.col("x"), F.col("y"), area.ring))
    if cells.count() > max_cells:
        raise ValueError(f"the area needs more than {max_cells} cells")
    a, b = geo.from_km(F.col("x"), F.col("y"), area.lat, area.lng)
    return cells.select(a.alias("lat"), b.alias("lng"), F.lit(float(h)).alias("half_side_km"), F.lit(0).alias("depth"))


def circle_points(circles: DataFrame, segments: int = 256) -> DataFrame:
    """(area_id, at, lat, lng): the outline of circles (area_id, lat, lng, radius_km)."""
    turn = F.lit(2 * math.pi) * F.col("at") / segments
    d = circles.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    lat, lng = F.col("lat") + F.col("radius_km") * F.sin(turn) / geo.KM_PER_DEGREE, F.col("lng") + F.col("radius_km") * F.cos(turn) / (F.lit(geo.KM_PER_DEGREE) * F.cos(F.radians("lat")))
    return d.select("area_id", "at", lat.alias("lat"), lng.alias("lng"))


def check_areas(outlines: DataFrame, regions: dict = REGIONS, closed: tuple[str, ...] = (), tolerance_km: float = TOLERANCE_KM) -> DataFrame:
    """(area_id, verdict, region) of outlines (area_id, at, lat, lng): inside one open region with its tolerance, beyond it, or outside of all.

    An area is inside if its whole outline is, which is worked out edge by edge and not from samples. Among several regions the one
    that holds most of the outline's length is named, ties by name.
    """
    open_ = {name: outline for name, (on, outline) in regions.items() if on and name not in closed}
    if not open_:
        return outlines.select("area_id").distinct().select("area_id", F.lit("no region is open").alias("verdict"), F.lit(None).cast("string").alias("region"))
    told = None
    for name, outline in open_.items():
        ring, lat0, lng0 = local_ring(outline)
        x, y = geo.to_km(F.col("lat"), F.col("lng"), lat0, lng0)
        lines = region_joins.edges(outlines.select("area_id", "at", x.alias("x"), y.alias("y")), "x", "y")
        d = region_joins.share_outside(lines, ring, tolerance_km).withColumn("km", F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)))
        d = d.groupBy("area_id").agg(F.max("outside").alias("outside"), F.sum((1 - F.col("outside")) * F.col("km")).alias("km"), F.min("outside").alias("least")).withColumn("region", F.lit(name))
        told = d if told is None else told.unionByName(d)
    best = told.groupBy("area_id").agg(F.min(F.struct((-F.col("km")).alias("m"), "region", "outside", "least")).alias("b"))
    verdict = F.when(F.col("b.outside") <= 1e-12, "inside").when(F.col("b.least") < 1, "beyond").otherwise("outside")
    return best.select("area_id", verdict.alias("verdict"), F.when(verdict != "outside", F.col("b.region")).alias("region"))


def region_list(spark: SparkSession, regions: dict = REGIONS, closed: tuple[str, ...] = ()) -> DataFrame:
    """(region, enabled, outline): what a map shows of open and closed markets."""
    rows = [(name, on and name not in closed, [list(p) for p in outline] if on else None) for name, (on, outline) in regions.items()]
    return spark.createDataFrame(rows, "region string, enabled boolean, outline array<array<double>>")


def in_region(lat: Column, lng: Column, outline: tuple[tuple[float, float], ...], tolerance_km: float = TOLERANCE_KM) -> Column:
    ring, ref_lat, ref_lng = local_ring(outline)
    x, y = geo.to_km(lat, lng, ref_lat, ref_lng)
    return geo.in_tolerant_ring(x, y, ring, tolerance_km)


def permitted(points: DataFrame, regions: dict = REGIONS, closed: tuple[str, ...] = ()) -> DataFrame:
    """Adds region, the first open one that holds the point (lat, lng), or null; closing a market is enforced."""
    region = F.lit(None).cast("string")
    for name, (open_, outline) in reversed(regions.items()):
        if open_ and name not in closed:
            region = F.when(in_region(F.col("lat"), F.col("lng"), outline), name).otherwise(region)
    return points.withColumn("region", region)


def cover_circle(spark: SparkSession, lat: float, lng: float, radius_km: float, half_side_km: float, max_cells: int = 400) -> DataFrame:
    """(lat, lng, half_side_km, depth): the squares of a grid from the area's lower left corner that touch the circle, row by row."""
    if half_side_km <= 0:
        raise ValueError("cells need a positive size")
    n = math.ceil(radius_km / half_side_km)
    if n * n > 100 * max_cells:
        raise ValueError("the area needs too many cells")
    axis = spark.range(n)
    at = lambda c: F.lit(-radius_km) + F.lit(half_side_km) * (2 * F.col(c) + 1)
    grid = axis.toDF("j").crossJoin(F.broadcast(axis.toDF("i"))).withColumn("x", at("i")).withColumn("y", at("j"))
    gap = lambda c: F.greatest(F.lit(0.0), F.abs(c) - half_side_km)
    cells = grid.where(F.pow(gap(F.col("x")), 2) + F.pow(gap(F.col("y")), 2) <= radius_km**2)
    if cells.count() > max_cells:
        raise ValueError(f"the area needs more than {max_cells} cells")
    a, b = geo.from_km(F.col("x"), F.col("y"), lat, lng)
    return cells.select(a.alias("lat"), b.alias("lng"), F.lit(float(half_side_km)).alias("half_side_km"), F.lit(0).alias("depth"))


def subdivide(cells: DataFrame) -> DataFrame:
    """Each cell's four quarters: north-east, north-west, south-east, south-west."""
    half = F.col("half_side_km") / 2
    dy, dx = half / geo.KM_PER_DEGREE, half / (F.lit(geo.KM_PER_DEGREE) * F.cos(F.radians("lat")))
    quarters = F.array(*[F.struct((F.col("lat") + a * dy).alias("lat"), (F.col("lng") + b * dx).alias("lng")) for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))])
    return cells.select(F.explode(quarters).alias("q"), half.alias("half_side_km"), (F.col("depth") + 1).alias("depth")).select("q.*", "half_side_km", "depth")


@dataclass(frozen=True)
class Sweep:
    """What a sweep found: places, cells still full, cells whose search failed, and each search with its count."""

    places: DataFrame
    unresolved: DataFrame
    failed: DataFrame
    searches: DataFrame


def sweep(cells: DataFrame, queries: DataFrame, search: Callable[[DataFrame], DataFrame], max_depth: int = 3, max_cells: int = 400, area: Area | None = None) -> Sweep:
    """An adaptive sweep by rounds.

    `search` takes (lat, lng, half_side_km, depth, query) rows and returns them with the found rows' source_id, their own place (place_lat, place_lng, if
    an area trims them), raw_count, the number of results before any filter, and error where a search failed. A failed search loses that cell and query only: it is
    reported, its cell isn't quartered for it, and nothing it returned counts. Cells with a full result are quartered until the greatest depth; those still
    full, and those beyond `max_cells` in all, are reported. Each round is written before the next asks, so no search runs twice, and the loop
    on the driver has as many steps as depths. First found wins, by depth, then query and cell.
    """
    key = ["lat", "lng", "half_side_km", "depth", "query"]
    rounds, open_cells, unresolved = [], cells, None
    searched = cells.count()
    for depth in range(max_depth + 1):
        got = search(open_cells.crossJoin(F.broadcast(queries)))
        rounds.append(staged(got if "error" in got.columns else got.withColumn("error", F.lit(None).cast("string")), "round"))
        full = rounds[-1].where((F.col("raw_count") >= RESULT_CAP) & F.col("error").isNull()).select(*key[:4]).distinct()
        n = full.count()
        if not n or depth == max_depth or searched + 4 * n > max_cells:
            unresolved = full
            break
        searched += 4 * n
        open_cells = subdivide(full)
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    good = every.where("error is null")
    found = good.where(area.holds(F.col("place_lat"), F.col("place_lng"))) if area is not None else good
    places = found.where("source_id is not null").groupBy("source_id").agg(F.min_by(F.struct("depth", "query", "lat", "lng"), F.struct("depth", "query", "lat", "lng")).alias("f"))
    failed = every.where("error is not null").groupBy(*key).agg(F.min("error").alias("error"))
    return Sweep(places.select("source_id", "f.*"), unresolved, failed, good.groupBy(*key).agg(F.max("raw_count").alias("raw_count")))
