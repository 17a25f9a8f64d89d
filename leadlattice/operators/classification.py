"""Rule classification of places, audits, and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlattice.operators.market import QUERY_CATEGORIES

#: Listing types that rule a place out, that need a closer look, and that rule it in.
REJECT_TYPES = (
    "parking", "gas_station", "atm", "bank", "hospital", "pharmacy", "supermarket", "convenience_store", "car_repair", "car_wash", "post_office", "school",
    "primary_school", "secondary_school", "university", "police", "fire_station", "cemetery", "storage", "real_estate_agency", "insurance_agency", "dentist", "doctor",
    "shoe_store", "jewelry_store", "book_store", "hair_care", "beauty_salon", "shopping_mall",
)
AMBIGUOUS_TYPES = ("night_club", "bar", "restaurant", "lodging", "hotel", "campground", "rv_park", "gym", "clothing_store", "store")
ACCEPT_TYPES = ("tour_agency",)
ACCEPT_AUDIT, REJECT_AUDIT, LEAST_CONFIDENCE = 0.05, 0.20, 0.6


def _any(types: Column, of: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(t) for t in of])), F.lit(False))


def prefilter(places: DataFrame) -> DataFrame:
    """Adds rule_verdict, rule_confidence and rule_reason by types; null where a model must say. Doubtful types win over all."""
    t = F.col("types")
    reject = ~_any(t, AMBIGUOUS_TYPES) & _any(t, REJECT_TYPES)
    accept = ~_any(t, AMBIGUOUS_TYPES) & ~_any(t, REJECT_TYPES) & _any(t, ACCEPT_TYPES)
    first = F.array_min(F.array_intersect(t, F.array(*[F.lit(x) for x in REJECT_TYPES])))
    return (
        places.withColumn("rule_verdict", F.when(reject, "not_relevant").when(accept, "experience_operator"))
        .withColumn("rule_confidence", F.when(reject, 0.95).when(accept, 0.90))
        .withColumn("rule_reason", F.when(reject, F.concat(F.lit("listed as "), first)).when(accept, F.lit("listed as tour_agency")))
    )


def hash_uniform(c: Column) -> Column:
    """A number from 0 to 1 by the digest of a text, the same in any engine."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def sampled(key: Column, rate: Column | float, seed: int) -> Column:
    """A fixed pseudorandom share of keys, the same in every run and partitioning."""
    return hash_uniform(F.concat_ws(" ", key.cast("string"), F.lit(str(seed)))) < rate


def classify(places: DataFrame, model_answers: DataFrame, seed: int = 3) -> DataFrame:
    """Joins rules with a model's landed answers (id, verdict, confidence): verdict, confidence, decided_by, needs_review, audited, disagrees.

    Places without a rule need an answer; of others a share is audited. A missing answer counts as an operator of no
    confidence, for review.
    """
    d = prefilter(places)
    rate = F.when(F.col("rule_verdict") == "not_relevant", REJECT_AUDIT).otherwise(ACCEPT_AUDIT)
    d = d.withColumn("audited", F.col("rule_verdict").isNotNull() & sampled(F.col("id"), rate, seed))
    m = model_answers.select("id", F.col("verdict").alias("model_verdict"), F.col("confidence").alias("model_confidence"))
    d = d.join(m, "id", "left")
    ruled = F.col("rule_verdict").isNotNull()
    d = d.withColumn("verdict", F.coalesce("rule_verdict", "model_verdict", F.lit("experience_operator"))).withColumn("confidence", F.coalesce("rule_confidence", "model_confidence", F.lit(0.0)))
    d = d.withColumn("decided_by", F.when(ruled, "rule").otherwise("model")).withColumn("needs_review", ~ruled & (F.col("confidence") < LEAST_CONFIDENCE))
    return d.withColumn("disagrees", F.col("audited") & F.coalesce(F.col("model_verdict") != F.col("rule_verdict"), F.lit(False)))


def summary(classified: DataFrame) -> DataFrame:
    """One row: counts by verdict, the model's share, and how often audits agree (1 without audits)."""
    n = F.count(F.lit(1))
    audits = F.count_if(F.col("audited") & F.col("model_verdict").isNotNull())
    return classified.agg(
        n.alias("total"), F.count_if(F.col("verdict") == "experience_operator").alias("operators"), F.count_if(F.col("verdict") == "attraction_only").alias("attractions"),
        F.count_if(F.col("verdict") == "not_relevant").alias("not_relevant"), F.count_if("needs_review").alias("needs_review"),
        F.when(n == 0, 0.0).otherwise(F.count_if(F.col("decided_by") == "model") / F.nullif(n, F.lit(0))).alias("model_share"),
        F.when(audits == 0, 1.0).otherwise(1 - F.count_if("disagrees") / F.nullif(audits, F.lit(0))).alias("audit_agreement"),
    )


def resolve_category(answer: Column, query: Column) -> Column:
    """The classifier's own answer if it says something, else what the search term stands for, else null."""
    a = F.lower(F.trim(answer))
    terms = F.create_map(*[F.lit(x) for pair in QUERY_CATEGORIES.items() for x in pair])
    return F.when(a.isNotNull() & ~a.isin("", "other", "none", "unclear"), a).otherwise(F.try_element_at(terms, query))


def watched_rejects(classified: DataFrame, watch: tuple[str, ...], verdicts: tuple[str, ...] = ("not_relevant", "attraction_only")) -> DataFrame:
    """(verdict, decided_by, records, watched): of the records that were turned away, those of which a listing type is watched."""
    d = classified.where(F.col("verdict").isin(*verdicts))
    return d.groupBy("verdict", "decided_by").agg(F.count(F.lit(1)).alias("records"), F.count_if(_any(F.col("types"), watch)).alias("watched"))
