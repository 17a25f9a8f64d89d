"""Ledgers of paid calls, estimates and unit economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: USD per 1000 calls and calls that are free, per kind of call.
RATES = {
    "places.text_search.enterprise": (35.00, 1000),
    "places.text_search.pro": (32.00, 5000),
    "places.text_search.ids_only": (0.00, 0),
    "places.details.enterprise": (20.00, 1000),
    "geocoding": (5.00, 10000),
}
#: What caching, batches and pounds cost.
CACHE_WRITE, CACHE_READ, BATCH, GBP = 1.25, 0.10, 0.50, 0.78
#: Fixed values of the sweep estimate.
PLACES_PER_CALL, CLASSIFY_USD, HEADROOM, CALL_SECONDS, CLASSIFY_SECONDS = 10.75, 0.0012, 1.6, 0.35, 0.12
#: Fixed values of the manual work that a sweep replaces.
MANUAL_HOURS, MANUAL_GBP_PER_HOUR = 7.5, 32.0


def rate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RATES.items()], "sku string, usd_per_1000 double, free long")


def unknown_skus(ledger: DataFrame, rates: DataFrame) -> DataFrame:
    return ledger.select("sku").distinct().join(rates, "sku", "left_anti")


def api_cost(ledger: DataFrame, rates: DataFrame) -> DataFrame:
    """(sku, calls, usd, usd_after_free) from events (sku, n). A sku without a rate is an error."""
    d = ledger.groupBy("sku").agg(F.sum("n").alias("calls")).join(F.broadcast(rates), "sku", "left")
    known = lambda c: F.when(F.col("usd_per_1000").isNull(), F.raise_error(F.concat(F.lit("no rate for sku "), F.col("sku"))).cast("double")).otherwise(c)
    paid = F.greatest(F.lit(0).cast("long"), F.col("calls") - F.col("free"))
    return d.select("sku", "calls", known(F.col("calls") * F.col("usd_per_1000") / 1000).alias("usd"), known(paid * F.col("usd_per_1000") / 1000).alias("usd_after_free"))


def token_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, calls, usd, cache_hit_rate) from events (model, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens, batched) and rates (model, usd_in, usd_out) per million tokens.

    One batched call makes the model batched. A model without a rate costs null, which sums skip.
    """
    kinds = ["input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens"]
    d = usage.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(k).alias(k) for k in kinds], F.bool_or("batched").alias("batched")).join(F.broadcast(rates), "model", "left")
    tokens = F.col("input_tokens") * F.col("usd_in") + F.col("cache_write_tokens") * F.col("usd_in") * CACHE_WRITE + F.col("cache_read_tokens") * F.col("usd_in") * CACHE_READ + F.col("output_tokens") * F.col("usd_out")
    usd = F.when(F.col("batched"), tokens / 1_000_000 * BATCH).otherwise(tokens / 1_000_000)
    all_in = F.col("input_tokens") + F.col("cache_write_tokens") + F.col("cache_read_tokens")
    hit = F.when(all_in == 0, 0.0).otherwise(F.col("cache_read_tokens") / F.nullif(all_in, F.lit(0)))
    return d.select("model", "calls", F.round(usd, 6).alias("usd"), F.round(hit, 3).alias("cache_hit_rate"))


def run_cost(apis: DataFrame, models: DataFrame) -> DataFrame:
    """One row: what a run costs in all, with and without the free allowance, in dollars and then in pounds, and its calls."""
    a = apis.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("usd_after_free"), F.lit(0.0)).alias("f"), F.coalesce(F.sum("calls"), F.lit(0)).alias("n"))
    m = models.agg(F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("m"), F.coalesce(F.sum("calls"), F.lit(0)).alias("k"))
    usd, paid = F.round(F.col("a") + F.col("m"), 6), F.round(F.col("f") + F.col("m"), 6)
    # Both sides are one row.
    return a.crossJoin(F.broadcast(m)).select(
        (F.col("n") + F.col("k")).alias("calls"), F.col("m").alias("model_usd"), usd.alias("usd"), F.round(usd * GBP, 6).alias("gbp"), paid.alias("usd_after_free"), F.round(paid * GBP, 6).alias("gbp_after_free"),
    )


def stage_economics(stages: DataFrame, operators: int) -> DataFrame:
    """Adds gbp, share of the total, and cost an operator to (stage, usd); what it replaces is manual work of MANUAL_HOURS."""
    every = F.sum("usd").over(Window.partitionBy())
    manual = MANUAL_HOURS * MANUAL_GBP_PER_HOUR
    return stages.select(
        "stage", "usd", F.round(F.col("usd") * GBP, 4).alias("gbp"), F.round(F.col("usd") / F.nullif(every, F.lit(0.0)), 4).alias("share"), F.round(F.col("usd") * GBP / max(1, operators), 6).alias("gbp_per_operator"),
        F.round(F.lit(manual) / max(1, operators), 6).alias("manual_gbp_per_operator"),
    )


def cents(c: Column) -> Column:
    """Rounded to cents by the binary value: 0.735 and 4.515, which are a little less in binary, go down."""
    up = F.floor(c * 100 + 0.5)
    return F.when(up / 100 - c > 0.005, up - 1).otherwise(up) / 100


def estimate_sweep(sweeps: DataFrame, pages: float = 1.8) -> DataFrame:
    """Adds calls, calls_max, usd, usd_max, gbp, gbp_max, seconds and seconds_max to (cells, queries)."""
    rate = RATES["places.text_search.enterprise"][0]
    d = sweeps.withColumn("calls", (F.col("cells") * F.col("queries") * F.lit(pages)).cast("int"))
    d = d.withColumn("calls_max", (F.col("calls") * F.lit(HEADROOM)).cast("int"))
    usd, usd_max = F.col("calls") * F.lit(rate) / 1000, F.col("calls_max") * F.lit(rate) / 1000 + F.col("calls_max") * F.lit(PLACES_PER_CALL) * F.lit(CLASSIFY_USD)
    seconds = lambda n: (n * F.lit(CALL_SECONDS) + n * F.lit(PLACES_PER_CALL) * F.lit(CLASSIFY_SECONDS)).cast("int")
    return (
        d.withColumn("usd", cents(usd)).withColumn("usd_max", cents(usd_max)).withColumn("gbp", cents(usd * GBP)).withColumn("gbp_max", cents(usd_max * GBP))
        .withColumn("seconds", seconds(F.col("calls"))).withColumn("seconds_max", seconds(F.col("calls_max")))
    )


def at_scale(stage_usd: DataFrame, scales: list[int]) -> DataFrame:
    """(destinations, usd, gbp, manual_gbp, ratio): stage costs of one destination (stage, usd) carried to many."""
    one = stage_usd.agg(F.sum("usd").alias("one"))
    n = stage_usd.sparkSession.createDataFrame([(x,) for x in scales], "destinations int")
    d = n.crossJoin(F.broadcast(one))
    manual = F.col("destinations") * F.lit(MANUAL_HOURS * MANUAL_GBP_PER_HOUR)
    gbp = F.col("one") * F.col("destinations") * GBP
    return d.select("destinations", F.round(F.col("one") * F.col("destinations"), 4).alias("usd"), F.round(gbp, 4).alias("gbp"), F.round(manual, 2).alias("manual_gbp"), F.round(manual / F.nullif(gbp, F.lit(0.0)), 1).alias("ratio"))
