"""Queries of the lead build, its reports, areas, landed sources and registers."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlattice import staging
from leadlattice.functions import numbers, text
from leadlattice.operators import areas, catalogue, classification, costs, diagnostics, evaluation, leads, linkage, market, regions, scoring, synthetic
from leadlattice.plans import views
from leadlattice.plans.views import table
from leadlattice.sources import files, landed, robots


def lead_decoration(spark: SparkSession, sf: str) -> DataFrame:
    d = leads.decorate(views.finds(spark, sf))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return d.select("id", "category", "viator_label", "viator_path", "viator_top", "category_source", joined("sells_categories"), joined("viator_labels"), joined("marketplaces"), "claims_viator", "claims_tripadvisor", "no_website", "locality")


def address_destination(spark: SparkSession, sf: str) -> DataFrame:
    return leads.with_destination(views.finds(spark, sf).withColumn("destination_id", F.expr("case when id % 25 = 0 then 'hvar' end")), market.demand_table(spark)).select("id", "destination")


def scored_finds(spark: SparkSession, sf: str) -> DataFrame:
    d = leads.decorate(views.finds(spark, sf).withColumn("destination_id", F.lit(None).cast("string")))
    d = leads.with_destination(d, market.demand_table(spark)).withColumn("site_categories", F.col("extract.product_categories"))
    return scoring.score_leads(d, market.demand_table(spark))


def find_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored_finds(spark, sf).select("id", *[F.round(c, 6).alias(c) for c in ("quality", "readiness", "gap_fit", "composite")], "band")


def warehouse_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.lead_rows(scored_finds(spark, sf), datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC))
    kept = [c for c in rows.columns if c not in ("evidence_json", "run_at", "run_date", "languages", "composite")]
    return rows.select(*kept, F.date_format("run_at", "yyyy-MM-dd HH:mm:ss").alias("run_at"), F.col("run_date").cast("string").alias("run_date"), F.array_join("languages", ",").alias("languages"), F.size(F.from_json("evidence_json", "map<string,string>")).alias("axes"))


def published_leads(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, of which the first is published twice: rows by run and band as the warehouse has them."""
    path, scored = staging.new_dir(spark), scored_finds(spark, sf)
    runs = [files.lead_rows(d, datetime(2026, 1, day, 3, 4, 5, tzinfo=UTC)) for day, d in ((2, scored), (2, scored), (3, scored.where("id % 3 = 0")))]
    for run in runs:
        files.append_leads(run.where("destination is not null"), f"{path}/leads")
    d = files.read_leads(spark, f"{path}/leads").groupBy("run_id", "run_date", "band").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place_source_id").alias("places"))
    return d.withColumn("run_date", F.col("run_date").cast("string"))


def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    d = views.finds(spark, sf).select("id", F.concat_ws('"', F.lit("a"), "name").alias("name"), "address", F.when(F.col("id") % 7 == 0, F.lit("two\nlines")).alias("note"), F.array(F.lit("x"), F.lit("y")).alias("tags"))
    return files.csv_lines(d)


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    q = leads.review_queue(views.verdicts(spark, sf), views.places(spark, sf), views.suppliers(spark, sf))
    return q.select("place_id", "discovered_name", "discovered_address", "discovered_website", "discovered_phone", "locality", "supplier_id", "supplier_name", "supplier_address", F.round("score", 4).alias("score"), F.round("confidence", 3).alias("confidence"))


def match_log(spark: SparkSession, sf: str) -> DataFrame:
    q = leads.match_log(views.verdicts(spark, sf), views.places(spark, sf), views.suppliers(spark, sf), "2026-01-02")
    return q.select("place_id", "supplier_id", "discovered_name", "supplier_name", "supplier_phone", "supplier_website", "decided_by", F.round("confidence", 3).alias("confidence"), "matched_on")


def funnel(spark: SparkSession, sf: str) -> DataFrame:
    d = views.verdicts(spark, sf)
    new = leads.net_new(views.places(spark, sf).select("id"), d)
    return leads.funnel(views.listings(spark, sf), views.places(spark, sf), d, views.truth(spark, sf), new, views.suppliers(spark, sf))


def lead_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Of places whose id is a multiple of 3, offered as leads: how many are new, and how many the gate turns away."""
    d, offered = views.verdicts(spark, sf), views.places(spark, sf).where("id % 3 = 0").select("id")
    counts = [f(offered, d).agg(F.count(F.lit(1)).alias(name)) for f, name in ((leads.net_new, "net_new"), (leads.intruders, "intruders"))]
    return counts[0].crossJoin(counts[1])


def already_known(spark: SparkSession, sf: str) -> DataFrame:
    p = views.finds(spark, sf).select("id")
    lead = p.where("id % 2 = 0").withColumn("band", F.expr("case when id % 3 = 0 then 'A' when id % 3 = 1 then 'B' end"))
    matched = p.where("id % 5 = 0").withColumn("matched_on", F.expr("case when id % 10 = 0 then '2026-01-02' end"))
    return leads.already_known(p, lead, p.where("id % 7 = 0"), matched)


def top_and_bottom(spark: SparkSession, sf: str) -> DataFrame:
    return leads.top_and_bottom(scored_finds(spark, sf).withColumn("composite", F.round("composite", 6)))


def leads_page(spark: SparkSession, sf: str) -> DataFrame:
    return leads.leads_page(scored_finds(spark, sf).withColumn("composite", F.round("composite", 6))).select("id", "composite")


def site_first(spark: SparkSession, sf: str) -> DataFrame:
    return leads.site_first(views.finds(spark, sf), 40).select("id", "website")


def console_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = leads.decorate(views.finds(spark, sf))
    return leads.filtered(d, d.where("id % 11 = 0"), locality="21000 Zadar").select("id", "locality", "category")


def filter_options(spark: SparkSession, sf: str) -> DataFrame:
    return leads.filter_options(leads.decorate(views.finds(spark, sf)))


def console_tallies(spark: SparkSession, sf: str) -> DataFrame:
    return leads.tallies(scored_finds(spark, sf))


def sweep_scores(spark: SparkSession, sf: str) -> DataFrame:
    return leads.sweep_scores(scored_finds(spark, sf)).select("id", F.round("composite", 6).alias("composite"), "enriched")


def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of eight terms, of which some are spelled otherwise, closed or unknown."""
    asked = table(spark, sf, "part").selectExpr("p_partkey div 8 as request", "p_partkey as at", "case when p_partkey % 7 = 0 then concat(p_name, 's') when p_partkey % 3 = 0 then concat(' ', upper(p_name), ' ') else p_name end as term")
    return leads.validate_terms(asked, _terms(spark, sf), by="request").select("request", "at", "term", "canonical", "accepted")


def terms_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return leads.terms_by_category(_terms(spark, sf)).select("category", F.array_join("terms", ",").alias("terms"))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Rules, audits and a model's landed answers for every find."""
    f = views.finds(spark, sf)
    answers = f.where("id % 6 <> 5").select("id", "verdict", F.expr("cast(id % 100 as double) / 100").alias("confidence"))
    return classification.classify(f.select("id", "types"), answers)


def classification_rows(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("id", "verdict", "confidence", "decided_by", "needs_review", "audited", "disagrees")


def classification_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = classification.summary(classified(spark, sf))
    return d.withColumns({c: F.round(c, 6) for c in ("model_share", "audit_agreement")})


def resolved_categories(spark: SparkSession, sf: str) -> DataFrame:
    f = views.finds(spark, sf).withColumn("category", classification.resolve_category(F.col("answer"), F.lower("query")))
    return f.groupBy(F.coalesce("category", F.lit("unresolved")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def watched_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return classification.watched_rejects(views.finds(spark, sf), ("tour_agency", "museum"))


def landed_classifications(spark: SparkSession, sf: str) -> DataFrame:
    """The last classification of each place, of those landed one after the other."""
    d = table(spark, sf, "events").selectExpr("user_id as place_id", "event_id as seq", "event_type as verdict")
    return files.last_wins(d, "place_id", "seq").select("place_id", "verdict")


def miss_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.miss_attribution(views.verdicts(spark, sf), views.truth(spark, sf))


def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.duplicate_names(views.finds(spark, sf))


def confusion_examples(spark: SparkSession, sf: str) -> DataFrame:
    d = evaluation.examples(evaluation.outcomes(views.verdicts(spark, sf), views.truth(spark, sf)), most=5)
    return d.select("outcome", F.array_join("place_ids", ",").alias("place_ids"))


def band_settings(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.band_settings(scored_finds(spark, sf).withColumn("composite", F.round("composite", 4)), [(0.65, 0.45), (0.55, 0.42), (0.52, 0.40)])


def axis_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.axis_ceiling(scored_finds(spark, sf))


def axis_liveness(spark: SparkSession, sf: str) -> DataFrame:
    cell = scoring.gap_value(F.coalesce("demand", F.lit(market.DEFAULT_DEMAND)).cast("double"), F.coalesce("supply", F.lit(market.DEFAULT_SUPPLY)).cast("double"))
    split = market.demand_table(spark).where("destination = 'split'").select("category", "demand", "supply")
    d = leads.decorate(views.finds(spark, sf)).join(F.broadcast(split), "category", "left").withColumn("gap_fit", cell)
    return diagnostics.axis_liveness(d, "gap_fit", "category")


def distinctive_words(spark: SparkSession, sf: str) -> DataFrame:
    k = views.finds(spark, sf).select(F.split(F.lower("name"), " ").alias("words"))
    return diagnostics.distinctive_words(linkage.idf_table(k, "words", linkage.corpus_size(k))).select("rank", "token", F.round("idf", 6).alias("idf"))


def generic_explained(spark: SparkSession, sf: str) -> DataFrame:
    k = views.finds(spark, sf).select("id", F.split(F.lower("name"), " ").alias("words"))
    return linkage.explain_generic(linkage.idf_table(k, "words", linkage.corpus_size(k)), k, "words").select("id", "generic")


def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.field_coverage(views.finds(spark, sf))


def type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.type_histogram(views.finds(spark, sf))


def _site_results(spark: SparkSession, sf: str) -> DataFrame:
    return views.finds(spark, sf).selectExpr(
        "id", "website", "extract.booking as booking", "id % 4 as pages", "id % 2 = 0 as from_cache", "element_at(array(202, 403, 404, 503, 200, 418), cast(id % 6 + 1 as int)) as status",
        "case id % 8 when 1 then 'blocked by robots.txt' when 2 then 'blocked: the site refuses our user agent' when 3 then 'page not found' when 4 then case when extract is null then 'empty' end else case when extract is null then 'empty' end end as error",
    )


def enrichment_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.enrichment_summary(_site_results(spark, sf))


def booking_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.booking_histogram(_site_results(spark, sf))


def unreadable_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.unreadable(_site_results(spark, sf))


def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    f = views.finds(spark, sf)
    made = text.describe(F.col("name"), F.col("types"), F.col("address"), F.col("website"), F.col("rating"), F.col("review_count"), F.col("query"))
    return f.select("id", F.sha2(made, 256).alias("text_sha256"))


def phone_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of customers of three countries, written in five ways; two in five are of no plan or of a wrong length."""
    tail = lambda k: f"lpad(cast(c_custkey * 7919 % {10**k} as string), {k}, '0')"
    kinds = [[("91", 7), ("1", 7), ("21", 6), ("96", 7), ("21", 4)], [("31", 6), ("1", 7), ("68", 6), ("99", 6), ("31", 8)], [("64", 7), ("11", 6), ("63", 6), ("99", 7), ("64", 3)]]
    pick = lambda xs, by: f"element_at(array({', '.join(xs)}), cast({by} + 1 as int))"
    national = pick([pick([f"concat('{a}', {tail(k)})" for a, k in row], "c_custkey % 5") for row in kinds], "c_custkey div 5 % 3")
    d = table(spark, sf, "customer").selectExpr("c_custkey", f"{national} as nat", pick(["'HR'", "'SI'", "'RS'"], "c_custkey div 5 % 3") + " as region", pick(["'385'", "'386'", "'381'"], "c_custkey div 5 % 3") + " as code")
    written = ["concat('+', code, ' ', substring(nat, 1, 2), ' ', substring(nat, 3))", "concat('00', code, nat)", "concat('0', substring(nat, 1, 2), '/', substring(nat, 3))", "concat('+', code, ' (0)', nat)", "concat(substring(nat, 1, 3), '-', substring(nat, 4))"]
    return numbers.numbered(d.selectExpr("c_custkey as id", pick(written, "c_custkey div 15 % 5") + " as phone", "region"), numbers.plan_table(spark))


def shared_phone_summary(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.shared_summary(linkage.with_keys(views.listings(spark, sf)), "e164")


def site_sample(spark: SparkSession, sf: str) -> DataFrame:
    items = leads.decorate(views.finds(spark, sf)).select("id", "website", F.col("viator_top").alias("tier"))
    return catalogue.stratified_sample(items, limit=500)


def taxonomy_children(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.children(_taxonomy(spark, sf))


def taxonomy_tops(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.covered_tops(_taxonomy(spark, sf), table(spark, sf, "part").where("p_size = 7 and p_type not like 'S%'").select(F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), "p_brand").alias("path")))


def _taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.taxonomy_nodes(table(spark, sf, "part").select(F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), "p_brand").alias("path")).distinct())


def _register(spark: SparkSession, sf: str, name: str = "p_name") -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey as seq", "concat('0', p_partkey % 9, '.2019.') as first_registered", f"case when p_partkey % 19 = 0 then ' ' else concat(upper({name}), ' j.d.o.o. za turizam') end as legal_name",
        "concat('Vukovarska ', p_partkey % 40 + 1, ', 10 000 Zagreb') as office",
        "case p_partkey % 4 when 0 then null when 1 then concat('Riva ', p_partkey % 50 + 1, ', 21 000 Split | Istra') when 2 then concat('Obala Lazareta ', p_partkey % 50 + 1, 'a, 23000 Zadar| Zadar,\\n \\n Put 4, 21 000 Split') else 'Trg bez broja' end as premises",
        "element_at(array('DA', 'ne', '-', null), cast(p_partkey % 4 + 1 as int)) as insured", "' Croatia osiguranje ' as insurer", "'01.01.2027.' as policy_expiry", "element_at(array('Da', null, 'NE'), cast(p_partkey % 3 + 1 as int)) as protected", "p_partkey % 23 <> 0 as complete",
    )


def register_entries(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.register_entries(_register(spark, sf))


#: A business's name of two words that many have, one that some have, and a made word of its family, of {} parts.
_FAMILY = "translate(concat(lpad(cast((p_partkey div {0}) * 7919 % 100003 as string), 5, '0'), lpad(cast((p_partkey div {0}) * 271 % 997 as string), 3, '0')), '0123456789', 'abdegkmnru')"
_FULL_NAME = "concat(p_name, ' ', lower(translate(p_brand, '#0123456789', 'xabdegkmnru')), ' ', {})"


def _licences(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Licences of a place for each part, by names weighted over both sides; in a third of the register's names a letter is lost."""
    part, family = table(spark, sf, "part"), _FAMILY.format(4)
    written = _FULL_NAME.format(f"case when p_partkey % 3 = 0 then concat(substring({family}, 1, 1), substring({family}, 3)) else {family} end")
    # Keys are made by long expressions and read several times.
    e = catalogue.register_entries(_register(spark, sf, written))
    e = staging.staged(e.select("seq", "line_no", "legal_name", "norm_name", "street", "liability_insurance", "insolvency_protection"), "entries")
    p = views.finds(spark, sf).select("id", "address").join(part.selectExpr("p_partkey as id", f"{_FULL_NAME.format(_FAMILY.format(3))} as name"), "id")
    p = staging.staged(staging.spread(p).select("id", text.normalise_name(F.col("name")).alias("norm_name"), text.street_key(F.col("address")).alias("street")), "places")
    words = p.select("norm_name").union(e.select("norm_name")).select(F.array_distinct(F.split("norm_name", " ")).alias("words"))
    return catalogue.find_licences(p, e, linkage.idf_table(words, "words", linkage.corpus_size(words))), e


def licences(spark: SparkSession, sf: str) -> DataFrame:
    return _licences(spark, sf)[0]


def licence_position(spark: SparkSession, sf: str) -> DataFrame:
    hits, entries = _licences(spark, sf)
    return diagnostics.licence_position(hits, entries)


def cell_shapes(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "supplier").selectExpr("s_suppkey as id", "43.0d + (s_suppkey % 50) / 20.0d as lat", "15.0d + (s_suppkey % 70) / 25.0d as lng", "1.5d + s_suppkey % 4 as half_side_km")
    return areas.cell_shapes(cells).select("id", *[F.round(c, 6).alias(c) for c in ("radius_km", "north", "south", "east", "west")], areas.auto_half_side(F.col("half_side_km") * 100).alias("auto_half_side"))


def _circles(spark: SparkSession, sf: str) -> DataFrame:
    """A circle for each supplier."""
    return table(spark, sf, "supplier").selectExpr("s_suppkey as area_id", "42.0d + (s_suppkey * 37 % 100) / 20.0d as lat", "13.0d + (s_suppkey * 53 % 100) / 12.0d as lng", "3.0d + s_suppkey % 9 as radius_km")


def _outlines(spark: SparkSession, sf: str) -> DataFrame:
    """A star of ten points for each supplier, deep or blunt."""
    d = areas.circle_points(_circles(spark, sf), segments=10)
    deep = F.when(F.col("at") % 2 == 1, F.expr("0.3d + (area_id % 4) / 5.0d")).otherwise(1.0)
    c = _circles(spark, sf).select("area_id", F.col("lat").alias("clat"), F.col("lng").alias("clng"))
    return d.join(c, "area_id").select("area_id", "at", (F.col("clat") + (F.col("lat") - F.col("clat")) * deep).alias("lat"), (F.col("clng") + (F.col("lng") - F.col("clng")) * deep).alias("lng"))


def cover_circle(spark: SparkSession, sf: str) -> DataFrame:
    return regions.cover_circles(_circles(spark, sf), 2.0).select("area_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "half_side_km")


def polygon_cover(spark: SparkSession, sf: str) -> DataFrame:
    return regions.cover_areas(_outlines(spark, sf), 1.5).select("area_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "half_side_km")


def points_in_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Which suppliers' areas, in degrees four times as wide, hold which listings."""
    wide = _outlines(spark, sf).join(_circles(spark, sf).select("area_id", F.col("lat").alias("clat"), F.col("lng").alias("clng")), "area_id")
    wide = wide.select("area_id", "at", (F.col("clat") + 4 * (F.col("lat") - F.col("clat"))).alias("lat"), (F.col("clng") + 4 * (F.col("lng") - F.col("clng"))).alias("lng"))
    return regions.points_in_areas(views.listings(spark, sf).selectExpr("id", "lat", "lng - 3 as lng"), wide)


def quadtree_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of quarters of a cell about each supplier."""
    cells = _circles(spark, sf).selectExpr("lat", "lng", "radius_km as half_side_km", "0 as depth")
    for _ in range(3):
        cells = areas.subdivide(cells)
    return cells.select(F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "half_side_km", "depth")


def sweep_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """What sweeps of each supplier's market would cost."""
    return costs.estimate_sweep(table(spark, sf, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey * 7 % 400 + 1 as int) as cells", "cast(s_nationkey % 5 + 1 as int) as queries"))


def at_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Costs by kind of event, a cent for each hundred of values, carried to more destinations."""
    stages = table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg((F.sum(F.expr("event_id % 1000")) / 1000000.0).cast("double").alias("usd"))
    return costs.at_scale(stages, [1, 10, 50, 200, 500])


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    """Search terms: each name of parts, by its smallest type, open unless its first part is large."""
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("term")).agg(F.min("p_type").alias("category"), (F.min_by("p_size", "p_partkey") <= 40).alias("enabled"))


def points_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    area = areas.Area.polygon(((43.4, 16.0), (46.0, 20.0), (60.0, 40.0), (50.0, 17.0)))
    return views.listings(spark, sf).where(area.holds(F.col("lat"), F.col("lng"))).select("id", F.lit(round(area.km2, 2)).alias("km2"))


def area_checks(spark: SparkSession, sf: str) -> DataFrame:
    return areas.check_areas(_outlines(spark, sf))


def _search(spark: SparkSession, sf: str):  # noqa: ANN202
    """A search over listings: what of them lies in a cell, the first 60 by id, with the cell's whole count."""
    points = views.listings(spark, sf).selectExpr("id as source_id", "lat as place_lat", "lng as place_lng")

    def search(asked: DataFrame) -> DataFrame:
        shaped = areas.cell_shapes(asked)
        d = shaped.join(points, (F.col("place_lat") >= F.col("south")) & (F.col("place_lat") < F.col("north")) & (F.col("place_lng") >= F.col("west")) & (F.col("place_lng") < F.col("east")), "left")
        cell = ["lat", "lng", "half_side_km", "depth", "query"]
        raw = d.groupBy(*cell).agg(F.least(F.count("source_id"), F.lit(areas.RESULT_CAP)).alias("raw_count"))
        return d.select(*cell, "source_id", "place_lat", "place_lng").join(raw, cell)

    return search


def _sweep(spark: SparkSession, sf: str) -> areas.Sweep:
    """A sweep of two cells, in which the searches of quarters east of 29 degrees fail."""
    cells = spark.createDataFrame([(53.4, 28.8, 1200.0, 0), (43.5, 16.5, 60.0, 0)], "lat double, lng double, half_side_km double, depth int")
    fails = F.when((F.col("depth") == 1) & (F.col("lng") > 29), F.concat(F.lit("HTTP "), F.when(F.col("lat") > 53, 503).otherwise(429)))
    whole = _search(spark, sf)
    return areas.sweep(cells, spark.createDataFrame([("boat tour",)], "query string"), lambda asked: whole(asked).withColumn("error", fails), max_depth=2)


def adaptive_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """How many listings the sweep finds at each depth, and the cells that stay full."""
    got = _sweep(spark, sf)
    return got.places.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("first_id")).union(got.unresolved.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(-1), "n", F.lit(-1).cast("long")))


def failed_searches(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf).failed.select(F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "depth", "query", "error")


def sweep_counters(spark: SparkSession, sf: str) -> DataFrame:
    got = _sweep(spark, sf)
    return diagnostics.sweep_counters(got.searches, got.unresolved, got.failed)


def report(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of a run in one: finds by band, by verdict and by booking, and the coverage of their fields."""
    finds, scored = views.finds(spark, sf), scored_finds(spark, sf)
    tables = {
        "bands": scored.groupBy(F.col("band").alias("name")).agg(F.count(F.lit(1)).alias("value")), "verdicts": finds.groupBy(F.col("verdict").alias("name")).agg(F.count(F.lit(1)).alias("value")),
        "booking": diagnostics.booking_histogram(_site_results(spark, sf)).toDF("name", "value"), "types": diagnostics.type_histogram(finds).toDF("name", "value"),
    }
    return diagnostics.report(tables, "name", "value")


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Landed attempts: two searches of several pages for each user, failures among them, bodies with places as JSON."""
    one = "concat('{\"id\": \"p', event_id, '\", \"displayName\": {\"text\": \" Op ', event_id, ' \"}, \"types\": [\"', element_at(array('tour_agency', 'bank', 'bar', 'lodging'), cast(event_id % 4 + 1 as int)), '\"]', case when event_id % 10 = 0 then '' else concat(', \"location\": {\"latitude\": ', 40 + event_id % 5, ', \"longitude\": 15}') end, case when event_id % 9 = 0 then ', \"businessStatus\": \"CLOSED_PERMANENTLY\"' else '' end, '}')"
    d = table(spark, sf, "events").selectExpr("concat('c', user_id % 60) as cell", "event_type as query", "event_id", f"{one} as body").withColumn("page", F.expr("cast(event_id % 4 as int)"))
    bodies = d.groupBy("cell", "query", "page").agg(F.concat(F.lit('{"places": ['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "body"))), lambda x: x["body"]), ", "), F.lit("]}")).alias("body"), F.min("event_id").alias("m"))
    tries = bodies.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.expr("cast(m % 3 + 1 as int)"))))
    last = F.col("attempt") == F.expr("m % 3 + 1")
    return tries.select("cell", "query", "page", F.col("attempt").cast("int").alias("attempt"), F.when(~last, F.expr("case when m % 2 = 0 then 429 else 503 end")).when(F.col("m") % 11 == 0, 404).otherwise(200).alias("status"), F.when(last, F.col("body")).alias("body"))


def landed_searches(spark: SparkSession, sf: str) -> DataFrame:
    return landed.search_counts(landed.answered(_attempts(spark, sf)), cap=20)


def landed_places(spark: SparkSession, sf: str) -> DataFrame:
    results = landed.search_results(landed.answered(_attempts(spark, sf)), cap=20).select("body", "query", F.lit("split").alias("destination_id"))
    return files.places_from_results(results).select("source_id", "name", "lat", F.array_join("categories", ",").alias("categories"))


def landed_ledger(spark: SparkSession, sf: str) -> DataFrame:
    a = _attempts(spark, sf)
    cost = costs.api_cost(landed.ledger(a), costs.rate_table(spark))
    return cost.crossJoin(landed.unanswered(a).agg(F.count(F.lit(1)).alias("unanswered"))).select("sku", "calls", F.round("usd", 4).alias("usd"), "unanswered")


def newest_register(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "part").selectExpr("concat('<a href=\"/docs/', lpad(cast(230101 + p_partkey * 37 % 20000 as string), 6, '0'), '_Popis_TA..xlsx\">list</a> <a href=\"/x.pdf\">x</a>') as html")
    return landed.newest_file(pages, 'href="([^"]*?\\d{6}_Popis_TA\\.*\\.xlsx[^"]*)"')


def not_landed(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return landed.not_landed(pages, "url", pages.where("page_id % 3 = 0").select(landed.cache_key("url").alias("key"))).select("page_id", "key")


#: Robots files by the number of letters of a host, modulo 3.
ROBOTS = (
    "User-agent: *\\nDisallow: /*/8 # eights\\nAllow: /*/82$\\nDisallow: /*?*ref=\\nAllow: /fr/\\n",
    "# of our own\\nUSER-AGENT: leadlattice\\nuser-agent: otherbot\\nDisallow: /en/\\nDisallow: /about\\n\\nUser-agent: *\\nDisallow: /\\n",
    "User-agent: *\\nDisallow:\\nUser-agent: leadlattice-images\\nDisallow: /\\n",
)


def _robots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf, "pages").select("page_id", "url", text.host(F.col("url")).alias("host"))
    body = F.expr("element_at(array({}), cast(length(host) % 3 + 1 as int))".format(", ".join(f"'{r}'" for r in ROBOTS)))
    return pages, robots.robot_rules(pages.select("host").distinct().withColumn("body", body), "leadlattice")


def robots_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return robots.allowed(*_robots(spark, sf))


def robots_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each site that a reader of sites would ask for next."""
    pages, rules = _robots(spark, sf)
    return robots.candidate_pages(pages.select("host").distinct(), rules)


def run_cost(spark: SparkSession, sf: str) -> DataFrame:
    skus = ", ".join(f"'{s}'" for s in costs.RATES)
    ledger = table(spark, sf, "events").select(F.expr(f"element_at(array({skus}), cast(user_id % 5 + 1 as int))").alias("sku"), F.lit(1).cast("long").alias("n"))
    usage = table(spark, sf, "events").selectExpr("event_type as model", "event_id % 997 as input_tokens", "event_id % 89 as output_tokens", "event_id % 13 as cache_write_tokens", "event_id % 211 as cache_read_tokens", "event_id % 5000 = 4999 as batched")
    return costs.run_cost(costs.api_cost(ledger, costs.rate_table(spark)), costs.token_cost(usage, views.model_rates(spark)))


def stage_economics(spark: SparkSession, sf: str) -> DataFrame:
    return costs.stage_economics(spark.sql("SELECT * FROM VALUES ('discover', 0.98d), ('classify', 0.3657d), ('enrich', 1.9639d) AS t(stage, usd)"), views.suppliers(spark, sf).count())


def expected_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.expected_verdicts(synthetic.synthetic_suppliers(views.listings(spark, sf)))


def synthetic_places(spark: SparkSession, sf: str) -> DataFrame:
    """An invented place for each supplier."""
    d = synthetic.invented_places(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id")))
    return d.select("id", "name", "website", "phone", F.round("rating", 1).alias("rating"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


ALL = [
    lead_decoration, address_destination, find_scores, warehouse_columns, published_leads, csv_export, review_queue, match_log, funnel, lead_gate, already_known, top_and_bottom, leads_page, site_first, console_filter, filter_options,
    console_tallies, sweep_scores, search_terms, terms_by_category, classification_rows, classification_summary, resolved_categories, watched_rejects, landed_classifications, miss_attribution, duplicate_names,
    confusion_examples, band_settings, axis_ceiling, axis_liveness, distinctive_words, generic_explained, field_coverage, type_histogram, enrichment_summary, booking_histogram, unreadable_reasons, descriptions, phone_numbers,
    shared_phone_summary, site_sample, taxonomy_children, taxonomy_tops, register_entries, licences, licence_position, cell_shapes, polygon_cover, cover_circle, quadtree_cells, sweep_estimate, at_scale, points_in_areas, points_in_polygon, area_checks, adaptive_sweep, failed_searches, sweep_counters, report, landed_searches,
    landed_places, landed_ledger, newest_register, not_landed, robots_verdicts, robots_candidates, run_cost, stage_economics, expected_verdicts, synthetic_places,
]
