"""Supplier lists with known truth, made from places by fixed pseudorandom rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlattice.functions import text
from leadlattice.operators.classification import hash_uniform

LEGAL_TAIL = "(?i)\\s+(?:j?\\.?d\\.?o\\.?o\\.?|d\\.?d\\.?|obrt)\\s*$"


def uniform(salt: str, seed: int = 42) -> Column:
    """A number from 0 to 1 for each id and salt, the same in every run and partitioning."""
    return hash_uniform(F.concat_ws(" ", F.col("id").cast("string"), F.lit(salt), F.lit(str(seed))))


def synthetic_suppliers(places: DataFrame, seed: int = 42, seeded: float = 0.40, phantom: float = 0.15, hard: float = 0.10) -> DataFrame:
    """(supplier_id, place_id, kind, name, phone, website, address, lat, lng, corruptions) from places (id, name, ...).

    A share of places becomes suppliers with corrupted contact data (their truth is place_id), another phantoms that no
    place matches, another hard negatives that resemble a place and are not it. Every corruption is named.
    """
    u = lambda salt: uniform(salt, seed)
    role = F.when(u("role") < seeded, "seeded").when(u("role") < seeded + phantom, "phantom").when(u("role") < seeded + phantom + hard, "hard_negative")
    d = places.withColumn("kind", role).where("kind is not null")
    bare = F.regexp_replace("name", LEGAL_TAIL, "")
    abbreviated = F.regexp_replace("address", "(?i)\\bulica\\b", "ul.")
    marks = {
        "diacritics_stripped": u("strip") < 0.55, "legal_form": u("legal") < 0.35, "legal_form_removed": (u("legal") >= 0.35) & (u("unlegal") < 0.20) & (bare != F.col("name")), "ampersand": F.col("name").contains("&") & (u("amp") < 0.5), "transposed": (u("typo") < 0.12) & (F.length("name") > 3), "case": u("case") < 0.10, "truncated": (F.length("name") > 22) & (u("cut") < 0.08),
        "phone_missing": u("phone") < 0.15, "phone_stale": (u("phone") >= 0.15) & (u("phone") < 0.28), "phone_reformatted": (u("phone") >= 0.28) & (u("phone") < 0.75), "website_missing": u("site") < 0.14,
        "website_stale": (u("site") >= 0.14) & (u("site") < 0.24), "website_www": (u("site") >= 0.24) & (u("site") < 0.45), "website_subdomain": (u("site") >= 0.45) & (u("site") < 0.58),
        "address_abbreviated": u("address") < 0.30, "moved": (u("address") >= 0.30) & (u("address") < 0.42), "legal_name": u("entity") < 0.18,
    }
    d = d.withColumn("corruptions", F.filter(F.array(*[F.when(c & (F.col("kind") == "seeded"), name) for name, c in marks.items()]), lambda x: x.isNotNull()))
    has = lambda m: F.array_contains("corruptions", m)
    n = F.col("_name")
    at = (F.floor(u("place") * (F.length(n) - 1)) + 1).cast("int")
    # One step after the other; each is named by its mark.
    steps = [
        ("diacritics_stripped", text.fold_diacritics(n)), ("legal_form_removed", F.regexp_replace(n, LEGAL_TAIL, "")), ("ampersand", F.replace(n, F.lit("&"), F.lit("and"))),
        ("transposed", F.concat(F.substr(n, F.lit(1), at - 1), F.substr(n, at + 1, F.lit(1)), F.substr(n, at, F.lit(1)), F.substr(n, at + 2))), ("truncated", F.rtrim(F.substring(n, 1, 22))),
        ("case", F.when(u("upper") < 0.5, F.upper(n)).otherwise(F.lower(n))), ("legal_form", F.concat(n, F.lit(" d.o.o."))),
        ("legal_name", F.concat(F.lit("Ured "), F.floor(u("owner") * 1000).cast("string"), F.lit(" d.o.o."))),
    ]
    d = d.withColumn("_name", F.col("name"))
    for mark, changed in steps:
        d = d.withColumn("_name", F.when(has(mark), changed).otherwise(n))
    name = F.when(F.col("kind") == "phantom", F.concat(F.lit("Phantom "), F.col("id").cast("string"))).when(F.col("kind") == "hard_negative", F.concat(F.regexp_replace("name", "\\s+\\S+$", ""), F.lit(" Riva"))).otherwise(n)
    far = F.when(F.col("kind") == "hard_negative", 0.0135).when(has("moved"), 0.054).otherwise(0.0036)
    jitter = lambda c, salt: F.col(c) + (u(salt) - 0.5) * far
    return d.select(
        F.format_string("VS-%012d", F.col("id")).alias("supplier_id"), F.when(F.col("kind") == "seeded", F.col("id")).alias("place_id"), "kind", name.alias("name"),
        F.when(has("phone_missing") | (F.col("kind") != "seeded"), None).when(has("phone_stale"), F.concat(F.lit("+3852"), F.lpad(F.floor(u("digits") * 10_000_000).cast("string"), 7, "0")))
        .when(has("phone_reformatted"), F.regexp_replace("phone", "[ /-]", F.element_at(F.array(F.lit("-"), F.lit("/")), (F.floor(u("style") * 2) + 1).cast("int")))).otherwise(F.col("phone")).alias("phone"),
        F.when(has("website_missing") | (F.col("kind") != "seeded"), None).when(has("website_stale"), F.concat(F.lit("https://www.old"), F.floor(u("old") * 99).cast("string"), F.lit(".hr")))
        .when(has("website_www"), F.regexp_replace("website", "://(www\\.)?", "://www.")).when(has("website_subdomain"), F.regexp_replace("website", "://(www\\.)?", "://booking.")).otherwise(F.col("website")).alias("website"),
        F.when(has("address_abbreviated"), abbreviated).when(has("moved"), F.concat(F.lit("Nova ulica "), (F.floor(u("house") * 90) + 1).cast("string"), F.lit(", 21000 Split, Croatia"))).otherwise(F.col("address")).alias("address"), jitter("lat", "lat").alias("lat"), jitter("lng", "lng").alias("lng"), "corruptions",
    )


#: Shares of places without a website and without a phone, and ends of ratings.
NO_SITE, NO_PHONE, WORST, BEST = 0.22, 0.12, 3.2, 5.0
FIRST, SECOND, TOWNS = ("Adria", "Bura", "Maestral", "Sidro", "Galeb", "Val", "Jedro", "Otok"), ("Tours", "Charter", "Experience", "Kayak", "Wine", "Walks"), (("split", 43.5081, 16.4402), ("zadar", 44.1194, 15.2314), ("hvar", 43.1729, 16.4411))


def synthetic_places(spark: SparkSession, count: int = 200, seed: int = 11, spread: float = 0.05) -> DataFrame:
    return invented_places(spark.range(count), seed, spread)


def invented_places(ids: DataFrame, seed: int = 11, spread: float = 0.05) -> DataFrame:
    """For each id: (id, name, website, phone, rating, review_count, lat, lng, destination_id): invented places with unique names, some without a site or phone.

    Review counts are lognormal around 30, by the sum of twelve uniform numbers.
    """
    u = lambda salt: uniform(salt, seed)
    pick = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u(salt) * len(values)) + 1).cast("int"))
    normal = sum((u(f"n{i}") for i in range(1, 12)), u("n0")) - 6
    town = F.element_at(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("lat"), F.lit(b).alias("lng")) for n, a, b in TOWNS]), (F.floor(u("town") * len(TOWNS)) + 1).cast("int"))
    d = ids.withColumn("town", town)
    name = F.concat_ws(" ", pick(FIRST, "first"), pick(SECOND, "second"), F.col("id").cast("string"))
    return d.select(
        "id", name.alias("name"), F.when(u("site") >= NO_SITE, F.concat(F.lit("https://www.p"), F.col("id").cast("string"), F.lit(".hr"))).alias("website"),
        F.when(u("tel") >= NO_PHONE, F.concat(F.lit("+3852"), F.lpad(F.floor(u("digits") * 10_000_000).cast("string"), 7, "0"))).alias("phone"), (WORST + u("rating") * (BEST - WORST)).alias("rating"),
        F.round(F.exp(3.4 + 1.2 * normal)).cast("long").alias("review_count"), (F.col("town.lat") + (u("lat") * 2 - 1) * spread).alias("lat"), (F.col("town.lng") + (u("lng") * 2 - 1) * spread).alias("lng"), F.col("town.n").alias("destination_id"),
    )
