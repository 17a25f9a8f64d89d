"""The lead build: labels, gates, queues, logs, funnel, and the filters and tallies of a console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.functions import text
from leadlattice.operators.classification import resolve_category

#: Taxonomy paths of each category, the first of which is shown. A category without a path has none.
CATEGORY_PATHS = {
    "boat_tour": ("Tours, Sightseeing & Cruises/Cruises & Sailing", "Outdoor Activities/On the Water"),
    "water_sports": ("Outdoor Activities/On the Water",),
    "walking_tour": ("Tours, Sightseeing & Cruises/How to Get Around/Walking Tours", "Tours, Sightseeing & Cruises/Sightseeing Tours/City Tours"),
    "food_drink": ("Food & Drink",),
    "classes_workshops": ("Classes & Workshops",),
    "adventure": ("Outdoor Activities/Extreme Sports", "Tours, Sightseeing & Cruises/Sightseeing Tours/Adventure Tours"),
    "cultural": ("Art & Culture/Culture",),
    "day_trip": ("Tours, Sightseeing & Cruises/Tours by Duration/Day Trips",),
    "private_guide": ("Tours, Sightseeing & Cruises/Private and Luxury",),
    "transfer": ("Travel & Transportation Services/Transfers",),
    "other": (),
}
#: Answers that say nothing about a category.
NO_ANSWER = ("", "other", "none", "unclear")


def full_path(category: Column) -> Column:
    paths = F.create_map(*[F.lit(x) for c, p in CATEGORY_PATHS.items() if p for x in (c, p[0])])
    return F.try_element_at(paths, category)


def label(category: Column) -> Column:
    """The last part of a category's path, or the category's own name with spaces."""
    return F.coalesce(F.substring_index(full_path(category), "/", -1), F.replace(category, F.lit("_"), F.lit(" ")))


def breadcrumb(category: Column) -> Column:
    return F.replace(full_path(category), F.lit("/"), F.lit(" / "))


def top_level(category: Column) -> Column:
    return F.substring_index(full_path(category), "/", 1)


def unmapped_categories() -> list[str]:
    return [c for c, paths in CATEGORY_PATHS.items() if not paths and c != "other"]


def decorate(leads: DataFrame) -> DataFrame:
    """Adds to leads (answer, query, address, website, extract) what a reader of leads is shown.

    category, its labels and where it comes from: the classifier's answer, the search term, or, without either, the website, whose
    categories are then listed. marketplaces are in lower case; locality is the address's second-to-last part.
    """
    sells = F.filter(F.coalesce(F.col("extract.product_categories"), F.array().cast("array<string>")), lambda c: F.coalesce((c != "") & ~c.isin("none", "other"), F.lit(False)))
    d = leads.withColumn("category", resolve_category(F.col("answer"), F.lower("query")))
    said = F.coalesce(~F.lower("answer").isin(*NO_ANSWER), F.lit(False))
    by_site = F.col("category").isNull() & (F.size(sells) > 0)
    markets = F.transform(F.coalesce(F.col("extract.marketplace_presence"), F.array().cast("array<string>")), lambda m: F.lower(m))
    claims = lambda word: F.coalesce(F.exists("marketplaces", lambda m: m.contains(word)), F.lit(False))
    return (
        d.withColumn("viator_label", label(F.col("category"))).withColumn("viator_path", breadcrumb(F.col("category"))).withColumn("viator_top", top_level(F.col("category")))
        .withColumn("category_source", F.when(said, "classifier").when(by_site, "website").when(F.col("category").isNotNull(), "search term").otherwise("unresolved"))
        .withColumn("sells_categories", F.when(by_site, sells)).withColumn("viator_labels", F.transform("sells_categories", label))
        .withColumn("marketplaces", markets).withColumn("claims_viator", claims("viator")).withColumn("claims_tripadvisor", claims("tripadvisor"))
        .withColumn("no_website", ~F.coalesce(F.col("website") != "", F.lit(False))).withColumn("locality", text.locality(F.col("address")))
    )


def with_destination(places: DataFrame, demand: DataFrame, fold: bool = True) -> DataFrame:
    """Adds destination to places (id, address, destination_id): the given one, else the last part of the address that the demand table knows.

    With fold, parts are compared without accents, since the table's names have none. Parts meet the table in a join.
    """
    parts = F.transform(text.comma_parts(F.col("address")), lambda p: text.fold_diacritics(F.lower(p)) if fold else F.lower(p))
    known = demand.select(F.col("destination").alias("part")).distinct()
    met = places.select("id", F.posexplode(parts).alias("at", "part")).join(F.broadcast(known) if known.count() <= 100_000 else known, "part")
    last = met.groupBy("id").agg(F.max_by("part", "at").alias("_found"))
    return places.join(last, "id", "left").withColumn("destination", F.coalesce(F.nullif("destination_id", F.lit("")), "_found")).drop("_found")


def net_new(leads: DataFrame, decisions: DataFrame) -> DataFrame:
    """Leads (id) that matching calls new."""
    return leads.join(decisions.where("verdict = 'net_new'").select(F.col("place_id").alias("id")), "id", "left_semi")


def intruders(leads: DataFrame, decisions: DataFrame) -> DataFrame:
    """Leads (id) that matching doesn't call new."""
    return leads.join(decisions.where("verdict = 'net_new'").select(F.col("place_id").alias("id")), "id", "left_anti")


def assert_net_new(leads: DataFrame, decisions: DataFrame) -> None:
    """An error that names some of the leads, if any of them isn't new."""
    wrong = [str(r["id"]) for r in intruders(leads, decisions).select("id").orderBy("id").limit(6).collect()]
    if wrong:
        raise ValueError(f"leads that are not net-new: {', '.join(wrong[:5])}{' and more' if len(wrong) > 5 else ''}")


def funnel(discovered: DataFrame, operators: DataFrame, decisions: DataFrame, truth: DataFrame, leads: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One row of counts that add up: discovered, filtered, on file, new and in review, and how they compare with the answer key (place_id, true_supplier)."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    judged = decisions.join(truth.select("place_id", F.lit(True).alias("known")), "place_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    is_ = lambda verdict: F.col("verdict") == verdict
    counts = judged.agg(
        F.count_if(is_("existing")).alias("already_on_file"), F.count_if(is_("net_new")).alias("net_new"), F.count_if(is_("needs_review")).alias("needs_review"), F.count_if(~F.col("known")).alias("net_new_actual"),
        F.count_if(is_("net_new") & ~F.col("known")).alias("net_new_correct_in_leads"), F.count_if(is_("net_new") & F.col("known")).alias("existing_wrongly_in_leads"),
        F.count_if(is_("needs_review") & ~F.col("known")).alias("net_new_held_in_review"),
    )
    for df, name in ((discovered, "places_discovered"), (operators, "operators"), (leads, "leads_scored"), (suppliers, "suppliers_on_file")):
        counts = counts.crossJoin(n(df, name))  # one row each
    return counts.withColumn("not_relevant", F.col("places_discovered") - F.col("operators"))


def _pairs(decisions: DataFrame, places: DataFrame, suppliers: DataFrame) -> DataFrame:
    p = places.select(
        F.col("id").alias("place_id"), F.col("name").alias("discovered_name"), F.col("address").alias("discovered_address"), F.col("website").alias("discovered_website"), F.col("phone").alias("discovered_phone"),
        text.locality(F.col("address")).alias("locality"), *([resolve_category(F.col("answer"), F.lower("query")).alias("experience_type")] if "answer" in places.columns else []),
    )
    s = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), F.col("address").alias("supplier_address"), F.col("website").alias("supplier_website"), F.col("phone").alias("supplier_phone"))
    return decisions.join(p, "place_id").join(s, "supplier_id", "left")


def review_queue(decisions: DataFrame, places: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Pairs that a person decides, with both sides' contact data; a row is known by its place, not by its position."""
    return _pairs(decisions.where("verdict = 'needs_review'"), places, suppliers)


def match_log(decisions: DataFrame, places: DataFrame, suppliers: DataFrame, matched_on: str) -> DataFrame:
    """Pairs that were matched without a person, with the date. Readers order it by confidence, the least first, then place."""
    return _pairs(decisions.where("verdict = 'existing'"), places, suppliers).withColumn("matched_on", F.lit(matched_on))


def already_known(places: DataFrame, leads: DataFrame, review: DataFrame, matched: DataFrame) -> DataFrame:
    """Adds known_in and known_label to places (id): a lead (id, band), an entry in review (id) or a match (id, matched_on); of several the last of these counts."""
    seen = leads.select("id", F.lit(1).alias("p"), F.lit("leads").alias("known_in"), F.concat(F.lit("Already a lead, band "), F.coalesce("band", F.lit("?"))).alias("known_label"))
    seen = seen.union(review.select("id", F.lit(2), F.lit("review"), F.lit("Already awaiting human review")))
    seen = seen.union(matched.select("id", F.lit(3), F.lit("matched"), F.trim(F.concat(F.lit("Already a known supplier, matched "), F.coalesce("matched_on", F.lit(""))))))
    last = seen.groupBy("id").agg(F.max_by(F.struct("known_in", "known_label"), F.struct("p", "known_label")).alias("k"))
    return places.join(last, "id", "left").select(*places.columns, "k.known_in", "k.known_label")


def sweep_scores(scored: DataFrame) -> DataFrame:
    """Scores as a live sweep shows them: without the band, which is calibrated on enriched leads, and marked as not enriched."""
    return scored.drop("band").withColumn("enriched", F.lit(False))


def site_first(places: DataFrame, limit: int | None = None) -> DataFrame:
    """Places with a website before those without, each by id; the first `limit`, if given, by a top-k that no task sorts whole."""
    d = places.orderBy(~F.coalesce(F.col("website") != "", F.lit(False)), "id")
    return d.limit(limit) if limit is not None else d


def top_and_bottom(scored: DataFrame, top: int = 12, bottom: int = 4) -> DataFrame:
    """(place, rank, id, composite): the best and the last leads by composite, ties by id. Each end is a top-k."""
    best = scored.orderBy(F.desc("composite"), "id").limit(top).withColumn("place", F.lit("top"))
    last = scored.orderBy("composite", F.desc("id")).limit(bottom).withColumn("place", F.lit("bottom"))
    both = best.select("place", "id", "composite").union(last.select("place", "id", "composite"))
    order = Window.partitionBy("place").orderBy(F.when(F.col("place") == "top", -F.col("composite")).otherwise(F.col("composite")), F.when(F.col("place") == "top", F.col("id")).otherwise(-F.col("id")))
    return both.select("place", F.row_number().over(order).alias("rank"), "id", "composite")


def leads_page(scored: DataFrame, limit: int = 200) -> DataFrame:
    return scored.orderBy(F.desc("composite"), "id").limit(limit)


def filtered(leads: DataFrame, removed: DataFrame, locality: str | None = None, category: str | None = None) -> DataFrame:
    """Leads that pass the console's filters and were not removed (id)."""
    d = leads.join(removed.select("id"), "id", "left_anti")
    if locality:
        d = d.where(F.col("locality") == locality)
    return d.where(F.col("category") == category) if category else d


def filter_options(leads: DataFrame, columns: tuple[str, ...] = ("locality", "category")) -> DataFrame:
    """(field, value, n): the values that a filter offers, blanks left out."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("f")
    return leads.select(each).select("f.*").where("value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def tallies(leads: DataFrame) -> DataFrame:
    """One row: bands, leads on one marketplace and not on the other, leads in an open gap, and leads without a website."""
    return leads.agg(
        F.count(F.lit(1)).alias("leads"), *[F.count_if(F.col("band") == b).alias(f"band_{b.lower()}") for b in "ABC"], F.count_if(F.col("claims_tripadvisor") & ~F.col("claims_viator")).alias("tripadvisor_not_viator"),
        F.count_if(F.col("gap_fit") > 0).alias("in_a_gap"), F.count_if("no_website").alias("no_website"),
    )


def terms_by_category(terms: DataFrame) -> DataFrame:
    """(category, terms) of enabled search terms (term, category, enabled), in order."""
    return terms.where("enabled").groupBy("category").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def validate_terms(requested: DataFrame, terms: DataFrame, most: int = 3, by: str | None = None) -> DataFrame:
    """Adds canonical and accepted to requested (at, term): terms of the enabled list in any case, of which the first `most` count, of each request if a column `by` says which."""
    known = terms.where("enabled").select(F.lower("term").alias("key"), F.col("term").alias("canonical"))
    d = requested.withColumn("key", F.lower(F.trim("term"))).join(known, "key", "left")
    # A request is a short list; only terms that are on the list are numbered.
    order = (Window.partitionBy(by) if by else Window).orderBy("at")
    nth = F.when(F.col("canonical").isNotNull(), F.sum(F.col("canonical").isNotNull().cast("int")).over(order))
    return d.select(*([by] if by else []), "at", "term", "canonical", F.coalesce(nth <= most, F.lit(False)).alias("accepted"))
