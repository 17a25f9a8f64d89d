"""Lead scores on three axes, and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlattice.operators.market import DEFAULT_DEMAND, DEFAULT_SUPPLY, EQUILIBRIUM, SCALE_MAX

#: Fixed values.
WEIGHTS = {"quality": 0.35, "readiness": 0.35, "gap_fit": 0.30}
REVIEW_CAP, UNRATED = 400, 0.35
BOOKING = {"online_booking": 1.0, "enquiry_form": 0.6, "phone_or_email_only": 0.3, "unclear": 0.15}
BAND_A, BAND_B, SHARE_A, SHARE_B = 0.55, 0.42, 0.80, 0.55


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def component(name: str | Column, value: Column, weight: float, evidence: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), value.cast("double").alias("value"), F.lit(float(weight)).alias("weight"), evidence.cast("string").alias("evidence"))


def axis_score(components: Column) -> Column:
    """The weighted mean of the components' values, 0 without weight."""
    weight = F.aggregate(components, F.lit(0.0), lambda s, c: s + c["weight"])
    total = F.aggregate(components, F.lit(0.0), lambda s, c: s + c["value"] * c["weight"])
    return F.when(weight == 0, 0.0).otherwise(total / weight)


def quality(rating: Column, reviews: Column) -> Column:
    """Components of the quality axis. No rating is worth a fixed value; no reviews count as none."""
    n = F.coalesce(reviews, F.lit(0))
    rated = F.when(rating.isNull(), UNRATED).otherwise(clamp((rating - 3.5) / 1.5))
    volume = clamp(F.log10(1 + n) / F.log10(F.lit(1.0 + REVIEW_CAP)))
    return F.array(component("rating", rated, 0.6, F.concat_ws(" from ", rating.cast("string"), n.cast("string"))), component("review volume", volume, 0.4, F.concat(n.cast("string"), F.lit(" reviews"))))


def _given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def contactability(website: Column, phone: Column) -> Column:
    return F.array(component("website", _given(website).cast("double"), 0.2, F.coalesce(website, F.lit("none found"))), component("phone", _given(phone).cast("double"), 0.1, F.coalesce(phone, F.lit("none listed"))))


def readiness(website: Column, phone: Column, extract: Column) -> Column:
    """Six components. Without an extract the four that come from the website stay, at 0: what is absent counts as absent."""
    seen = extract.isNotNull()
    booking = F.lit(BOOKING["unclear"])
    for kind, value in BOOKING.items():
        booking = F.when(extract["booking"] == kind, value).otherwise(booking)
    languages = F.filter(extract["languages"], lambda x: F.coalesce(x != "", F.lit(False)))
    zero = lambda c: F.when(seen, c).otherwise(0.0)
    more = F.array(
        component("booking capability", zero(booking), 0.35, F.replace(extract["booking"], F.lit("_"), F.lit(" "))),
        component("languages sold in", zero(F.least(F.lit(1.0), F.greatest(F.size(languages), F.lit(0)) / 3)), 0.15, F.array_join(languages, ", ")),
        component("contactable by email", zero(_given(extract["contact_email"]).cast("double")), 0.1, extract["contact_email"]),
        component("sells on a marketplace already", zero((F.coalesce(F.size(extract["marketplace_presence"]), F.lit(0)) > 0).cast("double")), 0.1, F.array_join(extract["marketplace_presence"], ", ")),
    )
    return F.concat(contactability(website, phone), more)


def gap_value(demand: Column, supply: Column) -> Column:
    """Unmet share of what demand needs, weighted by the demand itself."""
    needed = F.lit(EQUILIBRIUM) * demand
    unmet = F.when(needed == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - supply / F.nullif(needed, F.lit(0.0))))
    return clamp(unmet * (demand / F.lit(float(SCALE_MAX))))


def gap_fit(leads: DataFrame, demand: DataFrame) -> DataFrame:
    """Adds gap_components and gap_fit to leads (id, destination, category, site_categories).

    A category looks up its cell, or the default. Without one (null, none, other) the mean of the site's real
    categories counts if the destination is known, else the default. Nothing is collected: cells come by a join on
    what each lead asks for.
    """
    real = F.filter(F.coalesce("site_categories", F.array().cast("array<string>")), lambda c: F.coalesce((c != "") & ~c.isin("none", "other"), F.lit(False)))
    own = F.coalesce((F.col("category") != "") & ~F.col("category").isin("none", "other"), F.lit(False))
    use_site = ~own & F.coalesce(F.col("destination") != "", F.lit(False)) & (F.size(real) > 0)
    asked = F.when(own, F.array("category")).when(use_site, real).otherwise(F.array(F.lit(None).cast("string")))
    each = leads.select("id", F.lower("destination").alias("destination"), own.alias("own"), F.posexplode(asked).alias("at", "category"))
    joined = each.join(demand, ["destination", "category"], "left")
    value = gap_value(F.coalesce("demand", F.lit(DEFAULT_DEMAND)).cast("double"), F.coalesce("supply", F.lit(DEFAULT_SUPPLY)).cast("double"))
    name = F.when(F.col("own") | F.col("category").isNull(), "unmet demand").otherwise(F.col("category"))
    made = joined.select("id", "at", component(name, value, 1.0, F.concat_ws("/", "destination", "category")).alias("c"))
    made = made.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("gap_components"))
    return leads.join(made, "id").withColumn("gap_fit", axis_score(F.col("gap_components")))


def composite(quality_score: Column, readiness_score: Column, gap: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    return quality_score * weights["quality"] + readiness_score * weights["readiness"] + gap * weights["gap_fit"]


def fixed_band(score: Column, a: Column | float = BAND_A, b: Column | float = BAND_B) -> Column:
    return F.when(score >= a, "A").when(score >= b, "B").otherwise("C")


def band_cutoffs(leads: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """One row (band_a, band_b, ceiling) from rounded axis scores: shares of the best that the axes reach together."""
    best = sum((F.max(F.round(axis, 4)) * w for axis, w in list(weights.items())[1:]), F.max(F.round("quality", 4)) * weights["quality"])
    c = leads.agg(F.count(F.lit(1)).alias("n"), best.alias("ceiling"))
    ok = F.col("ceiling") > 0
    return c.select(
        F.when(ok, F.round(F.col("ceiling") * SHARE_A, 4)).otherwise(BAND_A).alias("band_a"), F.when(ok, F.round(F.col("ceiling") * SHARE_B, 4)).otherwise(BAND_B).alias("band_b"),
        F.when(F.col("n") == 0, 1.0).when(ok, F.round("ceiling", 4)).otherwise(0.0).alias("ceiling"),
    )


def score_leads(leads: DataFrame, demand: DataFrame) -> DataFrame:
    """Adds the axes, composite and fixed band to leads (id, rating, review_count, website, phone, extract, destination, category, site_categories)."""
    d = gap_fit(leads, demand)
    d = d.withColumn("quality_components", quality(F.col("rating"), F.col("review_count"))).withColumn("readiness_components", readiness(F.col("website"), F.col("phone"), F.col("extract")))
    d = d.withColumn("quality", axis_score(F.col("quality_components"))).withColumn("readiness", axis_score(F.col("readiness_components")))
    d = d.withColumn("composite", composite(F.col("quality"), F.col("readiness"), F.col("gap_fit")))
    return d.withColumn("band", fixed_band(F.col("composite")))
