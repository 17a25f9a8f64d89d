"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlattice.llm.common import materialize
from leadlattice.llm.components import connected_components

#: Least number of hash tables, and probed buckets per table and vector besides its own.
TABLES, PROBES = 8, 5
#: Tables are added until a pair at the threshold is missed by all of them no more often than this.
MISS = 2.5e-4
#: Two vectors of cosine 0.9 differ in 37 of 256 projected signs on average, with a deviation of 6: six deviations are allowed.
SIGN_WORDS, SIGN_DEVIATIONS = 4, 6
#: Radians by which an angle must clear the threshold's before it decides for a whole ball; rounding stays below 1e-7.
SLACK = 1e-6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform: a fast pseudorandom rotation."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def bucket_keys(x: np.ndarray, tables: int, per_table: int, probes: int) -> np.ndarray:
    """For each row, tables x (1 + probes) bucket keys, own ones first.

    A polytope hash is the signed axis nearest to the rotated vector. A table joins `per_table` of them. The probed
    buckets change one of them to its next best axes, in order of how little the projection falls.
    """
    n, d = x.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    ranks = min(d, max(2, math.ceil(probes / per_table) + 2))
    for t in range(tables):
        best, gap = [], []
        for j in range(per_table):
            y = rotate(x, 1000 * t + j)
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :ranks]
            value = np.take_along_axis(y, order, axis=1)
            best.append(2 * order + (value < 0))
            gap.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        own = np.zeros(n, np.int64)
        for b in best:
            own = own * (2 * d) + b[:, 0]
        out[:, t, 0] = own
        moves = np.concatenate([g[:, 1:] for g in gap], axis=1)
        keys = np.concatenate([own[:, None] + (b[:, 1:] - b[:, :1]) * (2 * d) ** (per_table - 1 - j) for j, b in enumerate(best)], axis=1)
        cheap = np.argsort(moves, axis=1, kind="stable")[:, :probes]
        out[:, t, 1:] = np.take_along_axis(keys, cheap, axis=1)
        out[:, t] = out[:, t] * tables + t
    return out


def tables_needed(width: int, per_table: int, threshold: float) -> int:
    """So many tables that a pair of exactly the threshold's cosine is missed with probability MISS at most, TABLES at least.

    How often one table finds such a pair is measured on random pairs; it depends on the width and on the hashes
    that a table joins, and tables find independently. Thresholds at which one table finds less than 1 % of pairs
    get the tables for 1 %.
    """
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = min(1.0, max(-1.0, threshold))
    a, b = (bucket_keys(v, TABLES, per_table, PROBES) for v in (x, cosine * x + math.sqrt(1 - cosine * cosine) * y))
    found = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).mean()
    return max(TABLES, math.ceil(math.log(MISS) / math.log1p(-min(0.99, max(0.01, found)))))


def _hashed(classes: DataFrame, tables: int, per_table: int) -> DataFrame:
    """(id, own keys, probed keys, sign words) of each class (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = np.stack([np.asarray(v, np.float64) for v in part.column(1).to_numpy(zero_copy_only=False)])
                width = 1 << max(6, (x.shape[1] - 1).bit_length())
                x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - x.shape[1])))
                keys = bucket_keys(x, tables, per_table, PROBES)
                bits = np.concatenate([rotate(x, 77_000 + w)[:, :64] > 0 for w in range(SIGN_WORDS)], axis=1)
                signs = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a).ravel()), a.shape[1]).cast(pa.list_(pa.int64())) for a in (keys[:, :, 0], keys[:, :, 1:].reshape(len(x), -1), signs)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["id", "own", "probed", "signs"])

    return classes.select("id", "v").mapInArrow(run, "id long, own array<long>, probed array<long>, signs array<long>")


def _cosine(one: Column, two: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot(one, two) / (F.sqrt(dot(one, one)) * F.sqrt(dot(two, two)))


def _angle(one: Column, two: Column) -> Column:
    return F.acos(F.least(F.greatest(_cosine(one, two), F.lit(-1.0)), F.lit(1.0)))


def _signs_apart(one: str, two: str) -> Column:
    return reduce(operator.add, [F.bit_count(F.col(one)[i].bitwiseXOR(F.col(two)[i])) for i in range(SIGN_WORDS)])


def _signs_allowed(angle: Column) -> Column:
    """The most signs in which two vectors at this angle differ: the mean and SIGN_DEVIATIONS deviations, rounded up."""
    share, words = F.least(angle / math.pi, F.lit(1.0)), 64 * SIGN_WORDS
    return F.ceil(share * words + SIGN_DEVIATIONS * F.sqrt(share * (1 - share) * words))


def _angle_of(threshold: float) -> float:
    return math.acos(min(1.0, max(-1.0, threshold)))


def _balls(classes: DataFrame, hashed: DataFrame, threshold: float) -> DataFrame:
    """(id, ball, n, turn) of each class: the pivot of its ball and its angle to it.

    The pivot of a bucket is its least id, a map-side combined aggregate. A class goes to the least pivot of its
    buckets that lies within half the threshold's angle, or else is its own ball. By the triangle inequality
    all members of a ball link. A pivot may itself belong to the ball of a lesser one.
    """
    half = (_angle_of(threshold) - SLACK) / 2
    own = hashed.select("id", "signs", F.explode("own").alias("key"))
    pivots = own.groupBy("key").agg(F.min(F.struct("id", "signs")).alias("p")).select("key", F.col("p.id").alias("ball"), F.col("p.signs").alias("signs_p"))
    near = own.join(pivots, "key").where((F.col("ball") < F.col("id")) & (_signs_apart("signs", "signs_p") <= _signs_allowed(F.lit(max(0.0, half))))).select("id", "ball").distinct()
    v, v_p = classes.select("id", "v"), classes.select(F.col("id").alias("ball"), F.col("v").alias("v_p"))
    inside = near.join(v, "id").join(v_p, "ball").withColumn("turn", _angle(F.col("v"), F.col("v_p"))).where(F.col("turn") <= half)
    chosen = inside.groupBy("id").agg(F.min("ball").alias("ball"), F.min_by("turn", "ball").alias("turn"))
    return classes.select("id", "n").join(chosen, "id", "left").select("id", F.coalesce("ball", "id").alias("ball"), "n", F.coalesce("turn", F.lit(0.0)).alias("turn"))


def _meetings(hashed: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b: balls of which one has a member's own bucket among the own and probed buckets of the other's."""
    stats = members.groupBy("ball").agg(F.max("turn").alias("turn"), F.count(F.lit(1)).alias("size"))
    about = stats.join(hashed.select(F.col("id").alias("ball"), "signs"), "ball")
    keys = materialize(hashed.select("id", "own", "probed").join(members.select("id", "ball"), "id").join(about, "ball"), "keys")

    def buckets(column: Column) -> DataFrame:
        # The buckets of one class differ; those of several are brought together before they meet others.
        lone, shared = (keys.where(c).select("ball", "signs", "turn", F.explode(column).alias("key")) for c in ("size = 1", "size > 1"))
        return lone.union(shared.distinct())

    asking = buckets(F.concat("own", "probed")).select("key", *[F.col(c).alias(f"{c}_a") for c in ("ball", "signs", "turn")])
    asked = buckets(F.col("own")).select("key", *[F.col(c).alias(f"{c}_b") for c in ("ball", "signs", "turn")])
    close = _signs_apart("signs_a", "signs_b") <= _signs_allowed(F.lit(_angle_of(threshold)) + F.col("turn_a") + F.col("turn_b"))
    pairs = asking.join(asked, "key").where((F.col("ball_a") != F.col("ball_b")) & close)
    return pairs.select(F.least("ball_a", "ball_b").alias("a"), F.greatest("ball_a", "ball_b").alias("b")).distinct()


def _ball_links(classes: DataFrame, members: DataFrame, balls: DataFrame, met: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The balls that link as wholes (a, b, n_a, n_b, first_a, first_b), and the links of single members of other balls
    that met (id_a, id_b, n_a, n_b, first_a, first_b)."""
    angle = _angle_of(threshold)
    side = balls.join(classes.select(F.col("id").alias("ball"), "v"), "ball")
    sides = [side.select(F.col("ball").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("v", "first", "n", "turn", "size")]) for s in "ab"]
    pairs = met.join(sides[0], "a").join(sides[1], "b").where(F.size("v_a") == F.size("v_b"))
    # A ball of one class that is its own pivot is that vector: the exact cosine decides.
    exact = F.expr("size_a = 1 and first_a = a and size_b = 1 and first_b = b")
    turn, reach = _angle(F.col("v_a"), F.col("v_b")), F.col("turn_a") + F.col("turn_b")
    verdict = (
        F.when(exact, F.when(_cosine(F.col("v_a"), F.col("v_b")) >= threshold, "all").otherwise("none"))
        .when(turn + reach <= angle - SLACK, "all").when(turn - reach > angle + SLACK, "none").otherwise("some")
    )
    pairs = materialize(pairs.select("a", "b", "n_a", "n_b", "first_a", "first_b", verdict.alias("verdict")).where("verdict <> 'none'"), "pairs")
    some = pairs.where("verdict = 'some'").select("a", "b", "first_a", "first_b")
    for s in "ab":
        some = some.join(members.select(F.col("ball").alias(s), F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}")), s)
    for s in "ab":
        some = some.join(classes.select(F.col("id").alias(f"id_{s}"), F.col("v").alias(f"v_{s}")), f"id_{s}")
    single = some.where(_cosine(F.col("v_a"), F.col("v_b")) >= threshold).select("id_a", "id_b", "n_a", "n_b", "first_a", "first_b")
    return pairs.where("verdict = 'all'"), materialize(single, "single")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, per_table: int | None = None) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two rows are linked if their cosine in double precision reaches the threshold. n_links counts the other rows
    linked directly; component_id is the smallest vec_id that links reach, itself included; kept marks it. A vector
    that is null, zero, or holds null or non-finite components links with nothing and is its own component. Vectors
    of different widths never link. Rows of equal vec_id are one node, whose links are those of all its rows. A null
    vec_id links with nothing. An empty table gives an empty one; further columns are ignored.

    Rows with equal vectors are one class, so copies cost one entry: each row links with the others of its class and
    with all rows of linked classes. Classes are hashed into several tables. Those within half the threshold's angle
    of a bucket's pivot are one ball, whose members all link with each other and are counted, not paired. Balls (most
    hold one class) meet if one's own bucket is among the other's own or probed ones. The join rejects balls whose
    projected sign bits are far apart; the exact angle of the pivots and the radii then show that all members link, or
    none, and where they show neither, the exact cosine of the full vectors decides member by member. The number of polytope hashes per table, if not given, follows the
    logarithm of the number of classes, so that buckets stay small; the number of tables follows from it, so that
    recall at the threshold is the same at every size.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    sound = sound & F.coalesce(F.exists(v, lambda x: x != 0.0), F.lit(False))
    clean = F.when(sound & F.col("vec_id").isNotNull(), F.transform(v, lambda x: x + F.lit(0.0)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), clean.alias("v"))
    classes = materialize(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n")), "classes")
    widths = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    if per_table is None:
        per_table = max(1, round(math.log(max(2, classes.count())) / math.log(2 * max([64, *widths]))))
    spark = vectors.sparkSession
    members, met = spark.createDataFrame([], "id long, ball long, n long, turn double"), spark.createDataFrame([], "a long, b long")
    for width in widths:
        tables = tables_needed(1 << max(6, (width - 1).bit_length()), per_table, threshold)
        of_width = classes.where(F.size("v") == width)
        hashed = materialize(_hashed(of_width, tables, per_table), "hashed")
        mine = materialize(_balls(of_width, hashed, threshold), "members")
        members, met = members.union(mine), met.union(_meetings(hashed, mine, threshold))
    balls = materialize(members.groupBy("ball").agg(F.min("id").alias("first"), F.sum("n").alias("n"), F.max("turn").alias("turn"), F.count(F.lit(1)).alias("size")), "balls")
    whole, single = _ball_links(classes, members, balls, met, threshold)
    by_ball = whole.select("a", "n_b").union(whole.select("b", "n_a")).toDF("ball", "n").groupBy("ball").agg(F.sum("n").alias("from_balls"))
    by_id = single.select("id_a", "n_b").union(single.select("id_b", "n_a")).toDF("id", "n").groupBy("id").agg(F.sum("n").alias("from_members"))
    comps = connected_components(whole.select("first_a", "first_b").union(single.select("first_a", "first_b")).toDF("a", "b"))
    per_ball = balls.select("ball", "first", F.col("n").alias("in_ball")).join(by_ball, "ball", "left").join(comps.withColumnRenamed("node", "first"), "first", "left")
    # The cosine of a vector with itself is 1 up to rounding, so copies link at any threshold that is not above that.
    copies = F.col("n") - 1 if threshold <= 1 - 1e-12 else F.lit(0)
    links = copies + F.col("in_ball") - F.col("n") + F.coalesce("from_balls", F.lit(0)) + F.coalesce("from_members", F.lit(0))
    about = members.join(per_ball, "ball").join(by_id, "id", "left").select("id", links.alias("links"), F.coalesce("component", "first").alias("component"))
    out = rows.join(classes.select("v", "id").join(about, "id"), "v", "left")
    per_node = out.groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    got = rows.select("vec_id").join(per_node, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return got.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
