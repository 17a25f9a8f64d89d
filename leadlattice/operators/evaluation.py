"""Measures of decisions against known truth, and sweeps over thresholds and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.operators.linkage import band

#: Minutes of a review, of a wasted call, and of a missed operator.
REVIEW_MINUTES, WASTED_MINUTES, MISSED_MINUTES = 3, 20, 240
#: Different values that a range of a quantile search holds about.
ROWS_PER_RANGE = 100_000


def outcomes(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds outcome to decisions (place_id, supplier_id, verdict) by truth (place_id, true_supplier)."""
    d = decisions.join(truth, "place_id", "left")
    known = F.col("true_supplier").isNotNull()
    return d.withColumn(
        "outcome",
        F.when(F.col("verdict") == "needs_review", "review")
        .when((F.col("verdict") == "existing") & known & (F.col("supplier_id") == F.col("true_supplier")), "true_positive")
        .when((F.col("verdict") == "existing") & known, "wrong_supplier")
        .when(F.col("verdict") == "existing", "false_positive")
        .when(known, "false_negative")
        .otherwise("true_negative"),
    )


def _ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den == 0, empty).otherwise(num / F.nullif(den, F.lit(0)))


def rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, review_rate and automation_rate to counts (tp, wrong, fp, fn, tn, review)."""
    tp, bad, fn = F.col("tp"), F.col("wrong") + F.col("fp"), F.col("fn") + F.col("wrong")
    total = F.col("tp") + F.col("wrong") + F.col("fp") + F.col("fn") + F.col("tn") + F.col("review")
    d = df.withColumn("precision", _ratio(tp, tp + bad, 1.0)).withColumn("recall", _ratio(tp, tp + fn, 1.0))
    both = F.col("precision") + F.col("recall")
    d = d.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))))
    return d.withColumn("review_rate", _ratio(F.col("review"), total, 0.0)).withColumn("automation_rate", 1 - F.col("review_rate"))


NAMES = {"tp": "true_positive", "wrong": "wrong_supplier", "fp": "false_positive", "fn": "false_negative", "tn": "true_negative", "review": "review"}


def confusion(judged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    counts = [F.count_if(F.col("outcome") == name).alias(short) for short, name in NAMES.items()]
    return rates(judged.groupBy(*by).agg(*counts) if by else judged.agg(*counts))


def examples(judged: DataFrame, most: int = 8) -> DataFrame:
    """(outcome, place_ids): the first places of each outcome by id; ranks stop at `most` before any shuffle."""
    d = judged.withColumn("n", F.row_number().over(Window.partitionBy("outcome").orderBy("place_id"))).where(F.col("n") <= most)
    return d.groupBy("outcome").agg(F.array_sort(F.collect_list("place_id")).alias("place_ids"))


def expected_verdicts(truth: DataFrame) -> DataFrame:
    """(place_id, true_supplier): the answer key of suppliers (supplier_id, place_id) with known truth."""
    return truth.where("place_id is not null").groupBy("place_id").agg(F.min("supplier_id").alias("true_supplier"))


def threshold_grid(spark: SparkSession, highs: list[float], lows: list[float]) -> DataFrame:
    """(seq, high, low) of all pairs with high above low."""
    rows = [(h, lo) for h in highs for lo in lows if h > lo]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, high double, low double")


def sweep(decisions: DataFrame, truth: DataFrame, grid: DataFrame) -> DataFrame:
    """Counts and rates for every pair of thresholds, from decisions (place_id, best_supplier, best_score, verdict, decided_by) that are worked out once.

    Hard keys and missing candidates do not depend on thresholds; the rest is banded again. The grid is a short
    literal, so the cross join multiplies rows by a fixed number that the aggregate folds at once.
    """
    d = decisions.crossJoin(F.broadcast(grid))
    hard = F.col("decided_by") == "hard_key"
    d = d.withColumn("verdict", F.when(hard, F.col("verdict")).otherwise(band(F.col("best_score"), F.col("high"), F.col("low")))).withColumn("supplier_id", F.col("best_supplier"))
    return confusion(outcomes(d, truth), by=("seq", "high", "low"))


def with_cost(swept: DataFrame, missed_minutes: Column | float = MISSED_MINUTES) -> DataFrame:
    """Adds minutes: reviews, wasted calls (existing operators taken as new) and missed operators (new ones taken as existing)."""
    return swept.withColumn("minutes", F.col("review") * REVIEW_MINUTES + F.col("fn") * WASTED_MINUTES + F.col("fp") * missed_minutes)


def cheapest(costed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The cheapest pair of thresholds, ties to the first of the grid."""
    return costed.groupBy(*by).agg(F.min_by(F.struct("high", "low", "minutes"), F.struct("minutes", "seq")).alias("b")).select(*by, "b.high", "b.low", "b.minutes")


def nearest_rank_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(p, value): the floor(p * n)-th smallest value from 0, exactly, without sorting all rows in one task.

    Values are counted per range of a sampled partitioning, more of them for more values; running counts name the range that
    holds each rank, and only those ranges are sorted.
    """
    spark = df.sparkSession
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    counts = v.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    parts = max(64, min(4096, counts.count() // ROWS_PER_RANGE))
    cuts = sorted(set(v.approxQuantile("v", [i / parts for i in range(1, parts)], 0.1 / parts) or [0.0]))
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
    bounds = F.array(*[F.lit(c) for c in cuts])
    # How many cuts are at or below the value, by halving.
    at = F.aggregate(steps, F.lit(0), lambda acc, s: F.when((acc + s <= len(cuts)) & (F.get(bounds, acc + s - 1) <= F.col("v")), acc + s).otherwise(acc))
    ranged = counts.withColumn("r", at)
    base = ranged.groupBy("r").agg(F.sum("n").alias("m"))
    base = base.withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("m").over(Window.partitionBy()))
    ps = spark.createDataFrame([(p,) for p in shares], "p double")
    rank = F.least(F.col("total") - 1, F.floor(F.col("p") * F.col("total")))
    # Only ranges that hold a rank are sorted. Both sides here have at most a few thousand rows.
    held = base.crossJoin(F.broadcast(ps)).withColumn("rank", rank).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
    asked = held.groupBy("r", "before").agg(F.collect_list(F.struct("p", "rank")).alias("asked"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.join(F.broadcast(asked), "r").withColumn("upto", upto).withColumn("one", F.explode("asked"))
    return placed.where((F.col("one.rank") >= F.col("upto") - F.col("n")) & (F.col("one.rank") < F.col("upto"))).select("one.p", F.col("v").alias("value"))
