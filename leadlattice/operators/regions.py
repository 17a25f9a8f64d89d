"""Areas as tables of outlines (area_id, at, lat, lng): what holds which points, covering cells, and whether an area stays within a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.functions import geo
from leadlattice.functions.text import let

#: Cells across an area's longer side, at most, in its index.
ACROSS = 8


def edges(outlines: DataFrame, x: str = "lng", y: str = "lat") -> DataFrame:
    """(area_id, at, x1, y1, x2, y2): the edges of outlines, closed; an outline of fewer than three points is no area and has none."""
    order, whole = Window.partitionBy("area_id").orderBy("at"), Window.partitionBy("area_id")
    first = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(first))
    d = outlines.select("area_id", "at", F.col(x).alias("x1"), F.col(y).alias("y1"), after(x).alias("x2"), after(y).alias("y2"), F.count(F.lit(1)).over(whole).alias("n"))
    return d.where("n > 2").drop("n")


def _crossing(x: Column, y: Column) -> Column:
    """Whether the ray from a point to the right crosses an edge; touching its lower end counts, its upper end doesn't."""
    return ((F.col("y1") > y) != (F.col("y2") > y)) & F.coalesce(x < F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1")), F.lit(False))


def _through(x: Column, y: Column, h: Column) -> Column:
    """Whether an edge meets the square of half side h about a point: the boxes overlap, and not all corners lie on one side."""
    side = lambda a, b: (F.col("x2") - F.col("x1")) * (y + b * h - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x + a * h - F.col("x1"))
    sides = [side(a, b) for a in (-1, 1) for b in (-1, 1)]
    boxes = (F.least("x1", "x2") <= x + h) & (F.greatest("x1", "x2") >= x - h) & (F.least("y1", "y2") <= y + h) & (F.greatest("y1", "y2") >= y - h)
    return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _classed(cells: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """Cells (area_id, key, x, y, h) that meet their area: border says that an edge runs through, else the cell lies inside as a whole."""
    met = cells.join(lines, "area_id").groupBy("area_id", *key).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max(_through(F.col("x"), F.col("y"), F.col("h"))).alias("border"), (F.count_if(_crossing(F.col("x"), F.col("y"))) % 2 == 1).alias("inside"))
    return met.where("border or inside").drop("inside")


def indexed(outlines: DataFrame) -> DataFrame:
    """(area_id, level, cx, cy, border): each area's cells of 2^-level degrees, at the level at which few cross it."""
    lines = edges(outlines)
    box = lines.groupBy("area_id").agg(F.min("x1").alias("x0"), F.max("x1").alias("x9"), F.min("y1").alias("y0"), F.max("y1").alias("y9"))
    longer = F.greatest(F.col("x9") - F.col("x0"), F.col("y9") - F.col("y0"), F.lit(1e-6))
    d = box.withColumn("level", F.floor(F.log2(F.lit(float(ACROSS)) / longer)).cast("int")).withColumn("size", F.pow(F.lit(2.0), -F.col("level")))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.col("size")), F.floor(F.col(hi) / F.col("size"))))
    d = d.withColumn("cx", span("x0", "x9")).withColumn("cy", span("y0", "y9"))
    cells = d.select("area_id", "level", "cx", "cy", ((F.col("cx") + 0.5) * F.col("size")).alias("x"), ((F.col("cy") + 0.5) * F.col("size")).alias("y"), (F.col("size") / 2).alias("h"))
    return _classed(cells, lines, ["level", "cx", "cy"]).select("area_id", "level", "cx", "cy", "border")


def points_in_areas(points: DataFrame, outlines: DataFrame) -> DataFrame:
    """(id, area_id): the areas that hold each point (id, lat, lng); a point on a border belongs by the rule of rays to the right.

    Points meet cells of areas by equi-joins, one for each level at which some area is indexed, and only points in border cells look at edges. Points without coordinates are nowhere.
    """
    cells = indexed(outlines)
    levels = cells.select("level").distinct().agg(F.collect_set("level").alias("levels"))  # a level for each power of two of sizes
    placed = points.where("lat is not null and lng is not null").select("id", "lat", "lng").crossJoin(F.broadcast(levels)).withColumn("level", F.explode("levels"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), -F.col("level")))
    met = placed.select("id", "lat", "lng", "level", cell("lng").alias("cx"), cell("lat").alias("cy")).join(cells, ["level", "cx", "cy"])
    near = met.where("border").join(edges(outlines), "area_id").groupBy("id", "area_id").agg((F.count_if(_crossing(F.col("lng"), F.col("lat"))) % 2 == 1).alias("inside"))
    return met.where("not border").select("id", "area_id").unionByName(near.where("inside").select("id", "area_id")).distinct()


def cover_areas(outlines: DataFrame, half_side_km: float, max_cells: int = 400) -> DataFrame:
    """(area_id, lat, lng, half_side_km): squares of a grid from each area's lower left corner, in kilometres, that meet the area.

    An area whose grid would be too large is an error, which a count of all finds before any cell is made.
    """
    if half_side_km <= 0:
        raise ValueError("cells need a positive size")
    ref = outlines.groupBy("area_id").agg(F.avg("lat").alias("lat0"), F.avg("lng").alias("lng0"))
    across = F.lit(geo.KM_PER_DEGREE) * F.cos(F.radians("lat0"))
    plane = outlines.join(ref, "area_id").select("area_id", "at", ((F.col("lng") - F.col("lng0")) * across).alias("x"), ((F.col("lat") - F.col("lat0")) * geo.KM_PER_DEGREE).alias("y"))
    lines = edges(plane, "x", "y")
    h = F.lit(float(half_side_km))
    n = lambda lo, hi: F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / (2 * h))).cast("int")
    box = lines.groupBy("area_id").agg(F.min("x1").alias("x0"), F.max("x1").alias("x9"), F.min("y1").alias("y0"), F.max("y1").alias("y9")).withColumn("nx", n("x0", "x9")).withColumn("ny", n("y0", "y9"))
    if box.where(F.col("nx").cast("long") * F.col("ny") > 100 * max_cells).count():
        raise ValueError("an area needs too many cells")
    grid = box.withColumn("i", F.explode(F.expr("sequence(0, nx - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, ny - 1)")))
    cells = grid.select("area_id", "i", "j", (F.col("x0") + h * (2 * F.col("i") + 1)).alias("x"), (F.col("y0") + h * (2 * F.col("j") + 1)).alias("y"), h.alias("h"))
    met = _classed(cells, lines, ["i", "j"]).join(ref, "area_id")
    return met.select("area_id", (F.col("y") / geo.KM_PER_DEGREE + F.col("lat0")).alias("lat"), (F.col("x") / across + F.col("lng0")).alias("lng"), h.alias("half_side_km"))


def cover_circles(circles: DataFrame, half_side_km: float) -> DataFrame:
    """(area_id, lat, lng, half_side_km): squares of a grid from the lower left corner that touch each circle (area_id, lat, lng, radius_km)."""
    if half_side_km <= 0:
        raise ValueError("cells need a positive size")
    h, r = F.lit(float(half_side_km)), F.col("radius_km")
    steps = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(r / h)).cast("int") - 1)
    d = circles.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    d = d.withColumn("x", h * (2 * F.col("i") + 1) - r).withColumn("y", h * (2 * F.col("j") + 1) - r)
    gap = lambda c: F.greatest(F.lit(0.0), F.abs(c) - h)
    d = d.where(F.pow(gap("x"), 2) + F.pow(gap("y"), 2) <= F.pow(r, 2))
    return d.select("area_id", (F.col("lat") + F.col("y") / geo.KM_PER_DEGREE).alias("lat"), (F.col("lng") + F.col("x") / (F.lit(geo.KM_PER_DEGREE) * F.cos(F.radians("lat")))).alias("lng"), h.alias("half_side_km"))


def _near_span(e: Column, tolerance: float) -> Column:
    """(low, high): the part of the way from (x1, y1) to (x2, y2), 0 to 1, that is within the tolerance of edge e; null if none is.

    What is that near to an edge is convex, two discs and a strip, so its part of a straight way is one span.
    """
    ax, ay, dx, dy = F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square, length = dx * dx + dy * dy, F.sqrt(F.pow(e["bx"] - e["ax"], 2) + F.pow(e["by"] - e["ay"], 2))

    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def disc(px: Column, py: Column) -> Column:
        terms = F.struct((dx * (ax - px) + dy * (ay - py)).alias("b"), (F.pow(ax - px, 2) + F.pow(ay - py, 2) - tolerance * tolerance).alias("c"), square.alias("q"))

        def solved(v: Column) -> Column:
            root = F.when(v["b"] * v["b"] - v["q"] * v["c"] >= 0, F.sqrt(v["b"] * v["b"] - v["q"] * v["c"]))
            # A way of no length is near as a whole or not at all.
            still = lambda x: F.when(v["c"] <= 0, F.lit(x))
            return span(F.when(v["q"] == 0, still(0.0)).otherwise(F.try_divide(-v["b"] - root, v["q"])), F.when(v["q"] == 0, still(1.0)).otherwise(F.try_divide(-v["b"] + root, v["q"])))

        return let(terms, solved)

    def between(at: Column, step: Column, lo: Column, hi: Column) -> Column:
        def solved(v: Column) -> Column:
            still = F.when((v["at"] >= lo) & (v["at"] <= hi), True)
            one, two = F.try_divide(lo - v["at"], v["step"]), F.try_divide(hi - v["at"], v["step"])
            return span(F.when(v["step"] == 0, F.when(still, F.lit(float("-inf")))).otherwise(F.least(one, two)), F.when(v["step"] == 0, F.when(still, F.lit(float("inf")))).otherwise(F.greatest(one, two)))

        return let(F.struct(at.alias("at"), step.alias("step")), solved)

    def strip(v: Column) -> Column:
        along = between((ax - e["ax"]) * v["ux"] + (ay - e["ay"]) * v["uy"], dx * v["ux"] + dy * v["uy"], F.lit(0.0), v["len"])
        beside = between((ay - e["ay"]) * v["ux"] - (ax - e["ax"]) * v["uy"], dy * v["ux"] - dx * v["uy"], F.lit(-tolerance), F.lit(tolerance))

        def met(w: Column) -> Column:
            low, high = F.greatest(w["a"]["lo"], w["b"]["lo"]), F.least(w["a"]["hi"], w["b"]["hi"])
            return F.when(w["a"]["lo"].isNotNull() & w["b"]["lo"].isNotNull() & (low <= high), span(low, high))

        return let(F.struct(along.alias("a"), beside.alias("b")), met)

    side = let(length, lambda n: F.struct(F.try_divide(e["bx"] - e["ax"], n).alias("ux"), F.try_divide(e["by"] - e["ay"], n).alias("uy"), n.alias("len")))
    three = F.struct(disc(e["ax"], e["ay"]).alias("a"), disc(e["bx"], e["by"]).alias("b"), let(side, strip).alias("c"))

    def clipped(v: Column) -> Column:
        lows, highs = F.least(*[v[k]["lo"] for k in "abc"]), F.greatest(*[v[k]["hi"] for k in "abc"])
        return F.when(lows.isNotNull() & (F.greatest(F.lit(0.0), lows) <= F.least(F.lit(1.0), highs)), F.struct(F.greatest(F.lit(0.0), lows).alias("low"), F.least(F.lit(1.0), highs).alias("high")))

    return let(three, clipped)


def share_outside(lines: DataFrame, ring: list[tuple[float, float]], tolerance: float) -> DataFrame:
    """Adds outside: the share of each way (x1, y1, x2, y2) that is neither inside the ring nor within the tolerance of it, without sampling.

    Between the spans that are near some edge a way crosses none, so each gap is inside or outside as a whole, as its middle is.
    """
    rim = F.array(*[F.struct(F.lit(a).alias("ax"), F.lit(b).alias("ay"), F.lit(c).alias("bx"), F.lit(e).alias("by")) for (a, b), (c, e) in zip(ring, [*ring[1:], ring[0]], strict=True)])
    d = lines.withColumn("spans", F.array_sort(F.filter(F.transform(rim, lambda e: _near_span(e, tolerance)), lambda s: s.isNotNull())))
    gap = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<lo: DOUBLE, hi: DOUBLE>>)")
    walked = F.aggregate(
        "spans", F.struct(F.lit(0.0).alias("at"), none.alias("gaps")),
        lambda s, x: F.struct(F.greatest(s["at"], x["high"]).alias("at"), F.when(x["low"] > s["at"], F.concat(s["gaps"], F.array(gap(s["at"], x["low"])))).otherwise(s["gaps"]).alias("gaps")),
        lambda s: F.when(s["at"] < 1, F.concat(s["gaps"], F.array(gap(s["at"], F.lit(1.0))))).otherwise(s["gaps"]),
    )

    def held(g: Column) -> Column:
        mid = (g["lo"] + g["hi"]) / 2
        return geo.in_ring(F.col("x1") + mid * (F.col("x2") - F.col("x1")), F.col("y1") + mid * (F.col("y2") - F.col("y1")), ring)

    return d.withColumn("outside", F.aggregate(F.filter(walked, lambda g: ~held(g)), F.lit(0.0), lambda s, g: s + g["hi"] - g["lo"])).drop("spans")
