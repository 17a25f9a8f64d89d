"""Reports on a run: why pairs were missed, how alive an axis is, how well fields are covered, what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.functions import text


def miss_attribution(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """(cause, n): matched places that the answer key doesn't know, by what decided and its first signal."""
    missed = decisions.where("verdict = 'existing'").join(truth.select("place_id"), "place_id", "left_anti")
    return missed.groupBy(F.concat_ws(":", "decided_by", "signal").alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_names(places: DataFrame) -> DataFrame:
    """(name, n) of names, in lower case, that several places have."""
    return places.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.count_distinct("id").alias("n")).where("n > 1")


def band_settings(scored: DataFrame, settings: list[tuple[float, float]]) -> DataFrame:
    """(a, b, band_a, band_b, band_c): bands under several settings, in one pass over the leads."""
    counts = []
    for i, (a, b) in enumerate(settings):
        c = F.col("composite")
        counts += [F.count_if(c >= a).alias(f"a{i}"), F.count_if((c < a) & (c >= b)).alias(f"b{i}"), F.count_if(c < b).alias(f"c{i}")]
    one = scored.agg(*counts)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"a{i}").alias("band_a"), F.col(f"b{i}").alias("band_b"), F.col(f"c{i}").alias("band_c")) for i, (a, b) in enumerate(settings)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def axis_ceiling(scored: DataFrame) -> DataFrame:
    """One row: the best of each axis and what they add up to by weight."""
    best = scored.agg(*[F.round(F.max(a), 4).alias(a) for a in ("quality", "readiness", "gap_fit")])
    return best.withColumn("ceiling", F.round(F.col("quality") * 0.35 + F.col("readiness") * 0.35 + F.col("gap_fit") * 0.30, 4))


def axis_liveness(scored: DataFrame, axis: str, by: str) -> DataFrame:
    """One row: groups, different values of the axis among them, and whether it tells groups apart."""
    each = scored.groupBy(F.coalesce(by, F.lit("(unresolved)")).alias("g")).agg(F.round(F.max(axis), 3).alias("v"))
    return each.agg(F.count(F.lit(1)).alias("groups"), F.count_distinct("v").alias("values"), (F.count_distinct("v") > 1).alias("discriminates"))


def licence_position(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """(position, n, by_address) of places with a licence: what their register entry declares. Null is no declaration, not a no."""
    liability, insolvency = F.col("liability_insurance"), F.col("insolvency_protection")
    position = (
        F.when(liability & insolvency, "both declared").when(liability, "liability only").when(insolvency, "insolvency only")
        .when(liability.eqNullSafe(False) | insolvency.eqNullSafe(False), "neither declared").otherwise("no declaration held")
    )
    d = hits.join(entries.select("seq", "line_no", "liability_insurance", "insolvency_protection"), ["seq", "line_no"])
    return d.groupBy(position.alias("position")).agg(F.count(F.lit(1)).alias("n"), F.count_if("address_agreement").alias("by_address"))


def distinctive_words(idf: DataFrame, most: int = 10) -> DataFrame:
    """(rank, token, idf) of the rarest words, ties by token: a top-k."""
    top = idf.orderBy(F.desc("idf"), "token").limit(most)
    return top.select(F.row_number().over(Window.orderBy(F.desc("idf"), "token")).alias("rank"), "token", "idf")


def field_coverage(places: DataFrame, columns: tuple[str, ...] = ("website", "phone", "rating")) -> DataFrame:
    """(field, filled, n): how many places have each field. Empty texts and zeros don't count."""
    filled = {c: F.count_if(F.coalesce(~F.col(c).cast("string").isin("", "0", "0.0"), F.lit(False))) for c in columns}
    one = places.agg(F.count(F.lit(1)).alias("n"), *[v.alias(c) for c, v in filled.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), "n") for c in columns])).alias("r")).select("r.*")


def type_histogram(places: DataFrame, types: str = "types", most: int = 15) -> DataFrame:
    """(type, n) of the most frequent listing types, ties by name."""
    return places.select(F.explode(types).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(most)


def enrichment_summary(results: DataFrame) -> DataFrame:
    """One row of counters over results (website, error, pages, from_cache, booking): what was read and what was not, and why."""
    no_site = ~F.coalesce(F.col("website") != "", F.lit(False))
    error = F.when(no_site, "no website").otherwise(F.col("error"))
    read = error.isNull() & F.col("booking").isNotNull()
    blocked = F.coalesce(error.startswith("blocked"), F.lit(False))
    robots = F.coalesce(error == "blocked by robots.txt", F.lit(False))
    return results.agg(
        F.count(F.lit(1)).alias("operators"), F.count_if(read).alias("extracted"), F.count_if(no_site).alias("skipped_no_site"), F.count_if(robots).alias("blocked_by_robots"),
        F.count_if(blocked & ~robots).alias("blocked_by_site"), F.count_if(error.isNotNull() & ~no_site & ~blocked).alias("fetch_failures"),
        F.coalesce(F.sum(F.when(~no_site, F.col("pages"))), F.lit(0)).alias("pages_fetched"), F.count_if(~no_site & F.col("from_cache")).alias("cache_hits"),
    )


def booking_histogram(results: DataFrame) -> DataFrame:
    return results.where("error is null and booking is not null and website <> ''").groupBy("booking").agg(F.count(F.lit(1)).alias("n"))


def unreadable(results: DataFrame, status: str = "status") -> DataFrame:
    """(reason, n) of pages that could not be read."""
    return results.groupBy(text.why_unreadable(F.col(status)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def sweep_counters(searches: DataFrame, unresolved: DataFrame, failed: DataFrame, pages: int = 20) -> DataFrame:
    """One row on a sweep's searches (depth, raw_count), its full and its failed cells; a search asks for a page of results at a time, and once at least."""
    calls = F.greatest(F.lit(1), F.ceil(F.col("raw_count") / pages))
    one = searches.agg(F.count(F.lit(1)).alias("searches"), F.coalesce(F.sum(calls), F.lit(0)).alias("calls"), F.coalesce(F.sum("raw_count"), F.lit(0)).alias("raw_places"), F.max("depth").alias("deepest"))
    lost = failed.agg(F.count(F.lit(1)).alias("failed_searches"), F.count_distinct("error").alias("kinds_of_failure"))
    return one.crossJoin(unresolved.agg(F.count(F.lit(1)).alias("unresolved_cells"))).crossJoin(lost)  # one row each


def report(metrics: dict[str, DataFrame], name: Column | str, value: Column | str) -> DataFrame:
    """(section, name, value): several two-column tables as one report."""
    out = None
    for section, df in metrics.items():
        part = df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name") if isinstance(name, str) else name, F.col(value).cast("double").alias("value") if isinstance(value, str) else value)
        out = part if out is None else out.union(part)
    return out
