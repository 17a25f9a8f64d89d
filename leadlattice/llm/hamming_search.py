"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.llm.common import materialize

BITS = 64


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): bit i of the 64-bit code is 1 where component i is above 0.

    A vector that is null, not of 64 components, or holds null or non-finite components has no code and is left out.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) == BITS) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def _segments(n_codes: int, occupancy: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: so wide that a bucket holds about `occupancy` codes if they spread evenly."""
    width = min(22, max(6, round(math.log2(max(2, n_codes / occupancy)))))
    m = math.ceil(BITS / width)
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _part(code: Column, segment: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(code, segment[0]).bitwiseAND(F.lit((1 << segment[1]) - 1))


def _masks(width: int, radius: int) -> list[int]:
    """All words of `width` bits with `radius` ones, by the next-larger-word rule."""
    if radius == 0:
        return [0]
    out, x = [], (1 << radius) - 1
    while x < 1 << width:
        out.append(x)
        low = x & -x
        up = x + low
        x = up | ((x ^ up) // low >> 2)
    return out


def _mask_table(spark: SparkSession, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """(segment, mask) of every word with `radius` ones in each segment's width; a table, since there may be many."""
    words = [(s, x) for s, g in enumerate(segments) if radius <= g[1] for x in _masks(g[1], radius)]
    return spark.createDataFrame(pd.DataFrame(words, columns=["p_segment", "mask"], dtype="int64"), "p_segment int, mask long")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, occupancy: int = 16) -> DataFrame:
    """The k rows of codes (id, code) nearest to each row of queries (id, code) by Hamming distance, exactly.

    Returns query_id, rank (1 to k), neighbor_id, distance; ties go to the smaller id. A query that is itself
    among the codes finds itself. With fewer than k codes all are returned; with none, nothing.

    Codes are cut into m segments, and an index maps (segment, value) to codes. Round r probes all values at
    distance r from the query's own in every segment and verifies what it finds by the full distance. After
    round r every code within m * (r + 1) - 1 has been seen, since a farther segment distance in all m segments
    adds up to at least m * (r + 1). A query is done as soon as its kth distance is within that. Equal codes are
    one index entry with the k smallest ids, which are all that can be returned, so copies don't fill a bucket.
    The join itself applies the kth distance known so far, and a code is taken only from the first segment
    and round that reach it, so candidates are neither emitted nor shuffled twice.
    """
    index = materialize(
        codes.groupBy("code").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")), "codes"
    )
    ordered = Window.partitionBy("code").orderBy("id")
    members = codes.join(index.where("copies > 1").select("code"), "code").withColumn("n", F.row_number().over(ordered)).where(F.col("n") <= k)
    ids = materialize(members.select("code", "id").union(index.where("copies = 1").select("code", "first_id")), "members")
    n_codes, n_rows = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    segments = _segments(n_codes, occupancy)
    m, want = len(segments), min(k, n_rows)
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct()
    state = "query_id long, q long, neighbor_id long, distance int"
    spark = codes.sparkSession
    if not want:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int")

    entries = index.select(
        "code", "first_id", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _part(F.col("code"), g).alias("value")) for s, g in enumerate(segments)])).alias("e")
    ).select("code", "first_id", "e.*").hint("merge")  # neither probes nor entries have a bound, so neither is broadcast
    best, done, active = spark.createDataFrame([], state), None, materialize(asked.withColumn("bound", F.lit(BITS)), "active")
    for r in range(max(w for _, w in segments) + 1):
        own = F.element_at(F.array(*[_part(F.col("q"), g) for g in segments]), F.col("p_segment") + 1)
        asking = active.select("query_id", "q", "bound", F.explode(F.array(*[F.lit(s) for s in range(m)])).alias("p_segment"))
        # A segment has at most 22 bits, so 705,432 masks.
        probing = asking.join(F.broadcast(_mask_table(spark, segments, r)), "p_segment").withColumn("p_value", own.bitwiseXOR(F.col("mask")))
        apart = F.col("q").bitwiseXOR(F.col("code"))
        near = [F.bit_count(_part(apart, g)) for g in segments]
        first_here = F.lit(True)
        for s in range(m):
            mine = F.lit(True)
            for other in range(m):
                if other != s:
                    mine = mine & (near[other] >= r + (other < s))
            first_here = first_here & ((F.col("p_segment") != s) | mine)
        found = (
            probing.join(entries, (F.col("p_segment") == F.col("segment")) & (F.col("p_value") == F.col("value")) & (F.bit_count(apart) <= F.col("bound")) & first_here)
            .select("query_id", "q", "code", "first_id", F.bit_count(apart).cast("int").alias("distance"))
        )
        by_code = Window.partitionBy("query_id", "q").orderBy("distance", "first_id")
        kept = found.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k).join(ids, "code").select("query_id", "q", F.col("id").alias("neighbor_id"), "distance")
        nearest = Window.partitionBy("query_id", "q").orderBy("distance", "neighbor_id")
        best = materialize(best.union(kept).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).drop("n"), "best")
        sure = m * (r + 1) - 1
        bounds = best.groupBy("query_id", "q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth"))
        full = (F.col("n") >= want) & (F.col("kth") <= sure)
        over = best.join(bounds.where(full).select("query_id", "q"), ["query_id", "q"], "left_semi")
        done = over if done is None else done.union(over)
        active = materialize(
            active.drop("bound").join(bounds, ["query_id", "q"], "left").where(~F.coalesce(full, F.lit(False)))
            .select("query_id", "q", F.when(F.col("n") >= want, F.col("kth")).otherwise(BITS).alias("bound")), "active"
        )
        if active.isEmpty():
            break
        best = best.join(active.select("query_id", "q"), ["query_id", "q"], "left_semi")
    return done.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy("distance", "neighbor_id"))).select("query_id", "rank", "neighbor_id", "distance")
