import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from leadlattice.functions import geo
from leadlattice.operators import areas, catalogue, classification, costs, evaluation, market, scoring
from leadlattice.sources import files
from leadlattice.streaming import ingest

EXTRACT = "struct<booking:string,languages:array<string>,contact_email:string,marketplace_presence:array<string>>"


def test_geo(spark):
    km = lambda *x: spark.range(1).select(geo.haversine_km(*[F.lit(v) for v in x])).first()[0]
    assert abs(km(43.5081, 16.4402, 42.6507, 18.0944) - 164.73521747) < 1e-6
    assert abs(geo.ring_area(geo.circle_ring(10)) - 314.12772509) < 1e-6
    d = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.5, 1.05, 2.0)], "k double")
    assert [round(r[0], 4) for r in d.select(geo.geo_similarity(F.col("k"))).collect()] == [1, 1, 0.7895, 0.5, 0]
    assert [r[0] for r in spark.createDataFrame([(-0.03,), (0.06,)], "x double").select(geo.geo_cell(F.col("x"))).collect()] == [0, 1]


def test_regions(spark):
    points = [("Pula", 44.8666, 13.8496), ("Zagreb", 45.815, 15.9819), ("Dubrovnik", 42.6507, 18.0944), ("Sarajevo", 43.8563, 18.4131), ("Ljubljana", 46.0569, 14.5058), ("Venice", 45.4408, 12.3155)]
    df = spark.createDataFrame(points, "n string, lat double, lng double")
    got = {r["n"]: r["region"] for r in areas.permitted(df).collect()}
    assert [got[p[0]] for p in points] == ["croatia"] * 3 + [None] * 3
    assert {r["region"] for r in areas.permitted(df, closed=("croatia",)).collect()} == {None}
    with pytest.raises(ValueError, match="three points"):
        areas.local_ring(((1.0, 2.0),))


def test_cover_and_sweep(spark):
    cells = areas.cover_circle(spark, 43.5, 16.4, 10, 3)
    assert cells.count() == 15
    with pytest.raises(ValueError, match="more than"):
        areas.cover_circle(spark, 43.5, 16.4, 10, 3, max_cells=4)
    one = cells.limit(1)
    search = lambda c: c.select("*", F.concat("query", F.col("depth").cast("string")).alias("source_id"), F.when(F.col("depth") < 2, 60).otherwise(3).alias("raw_count"))
    swept = areas.sweep(one, spark.createDataFrame([("boat",), ("wine",)], "query string"), search, max_depth=3)
    found, rest = swept.places, swept.unresolved
    assert sorted(r["source_id"] for r in found.collect()) == ["boat0", "boat1", "boat2", "wine0", "wine1", "wine2"]
    assert rest.count() == 0
    full = areas.sweep(one, spark.createDataFrame([("boat",)], "query string"), search, max_depth=1).unresolved
    assert full.count() == 4


def test_quality_goldens(spark):
    cases = [(5.0, 3, 0.6925), (4.8, 400, 0.92), (4.6, 8000, 0.84), (4.9, 60, 0.8343), (3.4, 2000, 0.4), (None, 0, 0.21), (5.0, 1, 0.6463), (4.3, 400, 0.72)]
    d = spark.createDataFrame([c[:2] for c in cases], "r double, n long").select(scoring.axis_score(scoring.quality(F.col("r"), F.col("n"))).alias("s"))
    assert [round(r["s"], 4) for r in d.collect()] == [c[2] for c in cases]


def test_readiness_goldens(spark):
    rows = [("w", "p", ("online_booking", ["en", "hr"], "a@b", [])), ("w", "p", ("enquiry_form", ["en", "hr"], "a@b", [])), ("w", "p", ("phone_or_email_only", ["en", "hr"], "a@b", [])), ("w", "p", ("online_booking", ["en", "hr", "de"], "a@b", ["m"])), ("w", "p", None), ("", None, None)]
    d = spark.createDataFrame(rows, f"w string, p string, e {EXTRACT}").select(scoring.axis_score(scoring.readiness(F.col("w"), F.col("p"), F.col("e"))).alias("s"), scoring.axis_score(scoring.contactability(F.col("w"), F.col("p"))).alias("c"))
    got = d.collect()
    assert [round(r["s"], 4) for r in got] == [0.85, 0.71, 0.605, 1.0, 0.3, 0.0]
    assert [r["c"] for r in got[-2:]] == [1.0, 0.0]


def test_gap_goldens(spark):
    want = {("split", "food_drink"): 0.3767, ("split", "boat_tour"): 0.0, ("split", "adventure"): 0.1233, ("rovinj", "food_drink"): 0.4233, ("nowhere", "boat_tour"): 0.1}
    leads = spark.createDataFrame([(i, d, c, None) for i, (d, c) in enumerate(want)] + [(9, "split", "other", ["food_drink", "none", "adventure"]), (10, None, None, ["food_drink"])], "id long, destination string, category string, site_categories array<string>")
    got = {r["id"]: round(r["gap_fit"], 4) for r in scoring.gap_fit(leads, market.demand_table(spark)).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    assert (got[9], got[10]) == (0.25, 0.1)


def test_band_cutoffs(spark):
    axes = "quality double, readiness double, gap_fit double"
    assert tuple(scoring.band_cutoffs(spark.createDataFrame([], axes)).first()) == (0.55, 0.42, 1.0)
    assert tuple(scoring.band_cutoffs(spark.createDataFrame([(0.0, 0.0, 0.0)], axes)).first()) == (0.55, 0.42, 0.0)
    assert tuple(scoring.band_cutoffs(spark.createDataFrame([(1.0, 0.0, 0.0), (0.0, 1.0, 0.5)], axes)).first()) == (0.68, 0.4675, 0.85)


def test_evaluation(spark):
    d = spark.createDataFrame([(1, 11, "existing"), (2, 12, "existing"), (3, 13, "existing"), (4, None, "net_new"), (5, None, "net_new"), (6, 16, "needs_review")], "place_id long, supplier_id long, verdict string")
    truth = spark.createDataFrame([(1, 11), (2, 99), (4, 14), (6, 16)], "place_id long, true_supplier long")
    r = evaluation.confusion(evaluation.outcomes(d, truth)).first()
    assert [r[k] for k in evaluation.NAMES] == [1, 1, 1, 1, 1, 1]
    assert (round(r["precision"], 4), round(r["recall"], 4), round(r["review_rate"], 4)) == (0.3333, 0.3333, 0.1667)
    empty = evaluation.confusion(evaluation.outcomes(d.limit(0), truth)).first()
    assert (empty["precision"], empty["recall"], empty["review_rate"]) == (1.0, 1.0, 0.0)


def test_quantiles(spark):
    d = spark.range(1000).select((F.col("id") % 7).cast("double").alias("x"))
    values = sorted(float(i % 7) for i in range(1000))
    got = {r["p"]: r["value"] for r in evaluation.nearest_rank_quantiles(d, "x", [0.0, 0.33, 0.5, 0.999, 1.0]).collect()}
    assert got == {p: values[min(999, int(p * 1000))] for p in got}
    assert len(got) == 5


def test_classification(spark):
    p = spark.createDataFrame([(1, ["bar", "bank"]), (2, ["school", "bank"]), (3, ["tour_agency"]), (4, ["museum"]), (5, None)], "id long, types array<string>")
    m = spark.createDataFrame([(1, "experience_operator", 0.9), (4, "attraction_only", 0.5)], "id long, verdict string, confidence double")
    got = {r["id"]: (r["verdict"], r["decided_by"], r["needs_review"]) for r in classification.classify(p, m).collect()}
    assert got == {1: ("experience_operator", "model", False), 2: ("not_relevant", "rule", False), 3: ("experience_operator", "rule", False), 4: ("attraction_only", "model", True), 5: ("experience_operator", "model", True)}
    assert classification.summary(classification.classify(p, m)).first()["model_share"] == 0.6
    c = spark.createDataFrame([("other", "boat tour"), ("Cultural", None), (None, "unknown")], "a string, q string").select(classification.resolve_category(F.col("a"), F.col("q")))
    assert [r[0] for r in c.collect()] == ["boat_tour", "cultural", None]


def test_costs(spark):
    got = costs.estimate_sweep(spark.createDataFrame([(4, 3), (9, 1), (24, 3)], "cells int, queries int")).collect()
    assert [(r["calls"], r["calls_max"], r["usd"], r["usd_max"], r["gbp"], r["gbp_max"], r["seconds"], r["seconds_max"]) for r in got] == [
        (21, 33, 0.73, 1.58, 0.57, 1.23, 34, 54), (16, 25, 0.56, 1.2, 0.44, 0.93, 26, 41), (129, 206, 4.51, 9.87, 3.52, 7.7, 211, 337)]
    u = spark.createDataFrame([("m", 1_000_000, 0, 0, 0, False), ("b", 1_000_000, 0, 0, 0, True), ("c", 100, 0, 0, 900, False)], "model string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, batched boolean")
    t = {r["model"]: (r["usd"], r["cache_hit_rate"]) for r in costs.token_cost(u, spark.createDataFrame([(m, 3.0, 15.0) for m in "mbc"], "model string, usd_in double, usd_out double")).collect()}
    assert (t["m"][0], t["b"][0], t["c"][1]) == (3.0, 1.5, 0.9)
    assert costs.unknown_skus(spark.createDataFrame([("x",), ("geocoding",)], "sku string"), costs.rate_table(spark)).count() == 1


def test_catalogue(spark):
    nodes = catalogue.taxonomy_nodes(spark.createDataFrame([("# c",), ("",), ("A/B/C",), ("A/D",)], "path string"))
    assert sorted((r["path"], r["tier"], r["parent"]) for r in nodes.collect()) == [("A", 1, None), ("A/B", 2, "A"), ("A/B/C", 3, "A/B"), ("A/D", 2, "A")]
    items = spark.createDataFrame([(i, "big") for i in range(50)] + [(100 + i, "mid") for i in range(5)] + [(200 + i, None) for i in range(9)], "id long, tier string")
    got = catalogue.stratified_sample(items, 20).groupBy("tier").count().collect()
    assert {r["tier"]: r["count"] for r in got} == {"mid": 5, "unmapped": 3, "big": 12}
    reg = spark.createDataFrame([(1, "Vision d.o.o.", None, "Riva 3, 21 000 Split | Zadar\n Put 4, 21 000 Split", "DA", "-"), (2, " ", None, "x", None, None)], "seq long, legal_name string, office string, premises string, insured string, protected string")
    e = catalogue.register_entries(reg).orderBy("line_no").collect()
    assert [(r["premises"], r["town"], r["county"], r["liability_insurance"], r["insolvency_protection"]) for r in e] == [("Riva 3, 21 000 Split", "split", "zadarska", True, None), ("Put 4, 21 000 Split", "split", None, True, None)]


def test_licences(spark):
    entries = spark.createDataFrame([(1, 0, "Adriatic Vision", "adriatic vision", "riva|3"), (2, 0, "Water", "water", "riva|3")], "seq long, line_no int, legal_name string, norm_name string, street string")
    p = spark.createDataFrame([(1, "adriatic vision", "riva|3"), (2, "adriatic vision", None), (3, "holidays", "riva|3")], "id long, norm_name string, street string")
    got = catalogue.find_licences(p, entries).collect()
    assert sorted((r["place_id"], r["seq"], r["address_agreement"]) for r in got) == [(1, 1, True), (2, 1, False)]
    assert catalogue.find_licences(p, entries.limit(0)).count() == 0


def test_rate_limit(spark):
    rows = [("a", datetime(2026, 1, 1, 0, 0, s), i) for i, s in enumerate((0, 1, 2, 2, 10, 11))]
    got = catalogue.rate_limited(spark.createDataFrame(rows, "client string, at timestamp, id long"), seconds=10, most=3).orderBy("id").collect()
    assert [r["earlier"] for r in got] == [0, 1, 2, 3, 3, 3]


def test_files(spark, tmp_path):
    body = json.dumps({"id": "1", "displayName": {"text": " A "}, "location": {"latitude": 1.0, "longitude": 2.0}, "types": ["x"], "businessStatus": None})
    gone = json.dumps({"id": "2", "location": {"latitude": 1.0, "longitude": 2.0}, "businessStatus": "CLOSED_PERMANENTLY"})
    d = files.places_from_results(spark.createDataFrame([(body, "q", "split"), (gone, "q", "split"), ("{}", "q", "split")], "body string, query string, destination_id string"))
    assert [r["name"] for r in d.collect()] == ["A"]
    leads = spark.createDataFrame([(1, "n", 4.5, 10, "w", "p", ("online_booking", ["en", ""], None, []), "split", "boat_tour", None)], f"id long, name string, rating double, review_count long, website string, phone string, extract {EXTRACT}, destination string, category string, site_categories array<string>")
    rows = files.lead_rows(scoring.score_leads(leads, market.demand_table(spark)), datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC))
    path = str(tmp_path / "leads")
    files.append_leads(rows, path)
    files.append_leads(rows.withColumn("extra", F.lit(1)).withColumn("run_id", F.lit("20260102T040000Z")), path)
    told = lambda: sorted((r["run_id"], r["languages"], r["extra"] or 0) for r in files.read_leads(spark, path).collect())
    assert told() == [("20260102T030405Z", ["en"], 0), ("20260102T040000Z", ["en"], 1)]
    files.append_leads(rows, path)  # a rerun adds nothing, and leaves the other run
    assert told() == [("20260102T030405Z", ["en"], 0), ("20260102T040000Z", ["en"], 1)]
    with pytest.raises(ValueError, match="composite is string, not double"):
        files.append_leads(rows.withColumn("composite", F.lit("much")), path)
    with pytest.raises(ValueError, match="another date"):
        files.append_leads(rows.withColumn("run_date", F.lit("2026-02-02").cast("date")), path)
    assert len(told()) == 2
    back = files.read_leads(spark, path)
    assert json.loads(back.first()["evidence_json"])["quality"][0]["name"] == "rating"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda i, t: json.dumps({"source": "s", "source_id": i, "name": "n", "lat": 1.0, "lng": 2.0, "discovered_at": t})
    (src / "a.json").write_text("\n".join([line("1", "2026-01-01T00:00:00Z"), line("1", "2026-01-01T01:00:00Z"), line("2", "2026-01-01T00:00:00Z")]))
    q = ingest.once(ingest.read_place_stream(spark, str(src))).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["source_id"] for r in spark.table("once").collect()) == ["1", "2"]
