import json
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from leadlattice.functions import similarity, text
from leadlattice.operators import areas, catalogue, costs, evaluation, leads, market, synthetic
from leadlattice.plans import build
from leadlattice.sources import files, landed, settings


def test_only_places_of_no_use_are_excluded(spark):
    kinds = ["bar", "lodging", "restaurant", "hotel", "tour_agency", "parking", "school", "bank", "atm"]
    bodies = [(json.dumps({"id": k, "displayName": {"text": k}, "location": {"latitude": 1.0, "longitude": 2.0}, "types": [k, "x"]}), "q", None) for k in kinds]
    got = files.places_from_results(spark.createDataFrame(bodies, "body string, query string, destination_id string"))
    assert {r["source_id"] for r in got.collect()} == set(kinds[:5])


def test_unknown_skus_raise_and_unknown_models_are_skipped(spark):
    ledger = spark.createDataFrame([("geocoding", 3), ("new thing", 1)], "sku string, n long")
    with pytest.raises(Exception, match="no rate for sku new thing"):
        costs.api_cost(ledger, costs.rate_table(spark)).collect()
    u = spark.createDataFrame([("a", 1_000_000, 0, 0, 0, False), ("b", 5, 5, 5, 5, False)], "model string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, batched boolean")
    rates = spark.createDataFrame([("a", 3.0, 15.0)], "model string, usd_in double, usd_out double")
    assert {r["model"]: r["usd"] for r in costs.token_cost(u, rates).collect()} == {"a": 3.0, "b": None}


def test_suffixes(spark):
    urls = {"https://kayak.fr/x": "kayak.fr", "a.nl": "a.nl", "http://www.x.com.pl": "x.com.pl", "vis.tours": "vis.tours", "b.co.uk": "b.co.uk", "com.pl": None, "localhost": None, "host.local": None, "10.0.0.1": None, "not a url": None}
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["d"] for r in d.select("u", text.registrable_domain(F.col("u")).alias("d")).collect()} == urls
    table = spark.createDataFrame([("uk",), ("co.uk",), ("*.ck",), ("!www.ck",), ("pl",), ("com.pl",)], "suffix string")
    want = {"a.b.co.uk": "b.co.uk", "co.uk": None, "x.y.ck": "x.y.ck", "y.ck": None, "www.ck": "www.ck", "m.www.ck": "www.ck", "x.com.pl": "x.com.pl", "a.x.pl": "x.pl", "q.zz": None}
    got = text.registrable_domains(spark.createDataFrame([(u,) for u in want], "u string"), "u", table).collect()
    assert {r["u"]: r["domain"] for r in got} == want


def test_slug_takes_compatibility_forms_apart(spark):
    got = spark.createDataFrame([("Ｓplit  ŠIBENIK",), ("Đakovo Ǆ",), ("Ängelholm é",)], "v string").select(text.slug(F.col("v"))).collect()
    assert [r[0] for r in got] == ["split sibenik", "dakovo dz", "angelholm e"]


def indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
        row = new
    return 200 * row[-1] / (len(a) + len(b))


def test_similar_tokens_are_all_found(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(40)]
    near = [w[:i] + rng.choice("abcd") + w[i + rng.randint(0, 1) :] for w in base for i in (0, len(w) // 2, len(w))]
    one, two = sorted(set(base)), sorted(set(near))
    got = {(r["a"], r["b"]): r["ratio"] for r in similarity.similar_tokens(*(spark.createDataFrame([(w,) for w in v], "token string") for v in (one, two))).collect()}
    assert got == {(a, b): indel(a, b) for a in one for b in two if indel(a, b) >= 85}


def test_csv_for_spreadsheets(spark, tmp_path):
    d = spark.createDataFrame([(1, 'say "hi"', "a,b", ["x", "y"]), (2, None, "two\nlines", [])], "id long, name string, note string, tags array<string>").coalesce(1)
    files.write_csv(d, str(tmp_path / "out"), ["id", "name", "note", "tags"])
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert raw == '﻿id,name,note,tags\r\n1,"say ""hi""","a,b",x;y\r\n2,,"two\nlines",\r\n'.encode()


def test_rows_without_a_required_column_are_rejected(spark, tmp_path):
    rows = spark.sql("SELECT 'r' run_id, timestamp'2026-01-01' run_at, date'2026-01-01' run_date, CAST(null AS string) place_source_id, 'd' destination, 'A' band")
    with pytest.raises(ValueError, match="1 rows lack"):
        files.append_leads(rows, str(tmp_path / "leads"))
    assert not (tmp_path / "leads").exists()


def test_documents_and_last_wins(spark, tmp_path):
    counts = spark.createDataFrame([("leads", 3), ("review", 1)], "name string, n long")
    files.write_document({"counts": counts, "bands": counts.limit(1)}, str(tmp_path / "doc"))
    assert sorted(tuple(r) for r in files.read_document(spark, str(tmp_path / "doc"), "counts", "name string, n long").collect()) == [("leads", 3), ("review", 1)]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "verdict": "x", "at": 1}, {"id": "a", "verdict": "y", "at": 2}]))
    got = files.read_last_wins(spark, str(tmp_path / "c.json"), "id string, verdict string, at long", "id", "at").collect()
    assert [(r["id"], r["verdict"]) for r in got] == [("a", "y")]


def test_searches_as_a_source(spark, tmp_path):
    place = lambda i: {"id": f"p{i}"}
    rows = [{"cell": "c", "query": "q", "page": 0, "attempt": 1, "status": 503}, {"cell": "c", "query": "q", "page": 0, "attempt": 2, "status": 200, "body": json.dumps({"places": [place(i) for i in range(3)]})},
            {"cell": "c", "query": "q", "page": 1, "attempt": 1, "status": 403}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    landed.register(spark)
    d = spark.read.format("landed_searches").option("path", str(tmp_path)).load()
    assert landed.ledger(d).first()["n"] == 3
    good = landed.answered(d)
    assert [tuple(r) for r in landed.search_counts(good, cap=3).select("calls", "raw_count", "truncated").collect()] == [(1, 3, True)]
    assert [json.loads(r["body"])["id"] for r in landed.search_results(good, cap=2).orderBy("at").collect()] == ["p0", "p1"]
    assert [r["status"] for r in landed.unanswered(d).collect()] == [403]


def test_settings(spark):
    loc = settings.locale_of({"diacritics": {"č": "c", "đ": "d"}, "legal_suffixes": ["d.o.o.", "j.d.o.o.", "D.O.O."], "stopwords": ["Putnička"], "prefixes": ["vl."]})
    assert (loc.legal_forms, loc.prefixes, loc.stopwords, loc.accented) == (("jdoo", "doo"), ("vl",), ("putnicka",), "čđ")
    demand = settings.demand_of(spark, {"destinations": {"split": {"boat_tour": {"demand": 100, "supply": 74}}}})
    assert tuple(demand.first()) == ("split", "boat_tour", 100, 74)
    terms = settings.terms_of(spark, {"terms": [{"term": "Boat tour", "category": "boat_tour"}, {"term": "spa", "category": "other", "enabled": False}]})
    over = spark.createDataFrame([("spa", True, 1), ("spa", False, 2), ("Boat tour", False, 1)], "term string, enabled boolean, at long")
    assert {r["term"]: r["enabled"] for r in settings.overridden(terms, over).collect()} == {"Boat tour": False, "spa": False}
    assert settings.regions_of({"regions": [{"id": "x", "polygon": [[1, 2], [3, 4], [5, 6]]}]}) == {"x": (False, ((1.0, 2.0), (3.0, 4.0), (5.0, 6.0)))}


def test_gate_and_destinations(spark):
    d = spark.createDataFrame([(1, "net_new"), (2, "existing")], "place_id long, verdict string")
    offered = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    leads.assert_net_new(offered.where("id = 1"), d)
    with pytest.raises(ValueError, match="2, 3"):
        leads.assert_net_new(offered, d)
    p = spark.createDataFrame([(1, "Riva 1, 22000 Šibenik, Šibenik, Croatia", None), (2, "x, split, zadar, y", ""), (3, None, "hvar"), (4, "nowhere", None)], "id long, address string, destination_id string")
    assert {r["id"]: r["destination"] for r in leads.with_destination(p, market.demand_table(spark)).collect()} == {1: "sibenik", 2: "zadar", 3: "hvar", 4: None}


def test_areas(spark):
    square = areas.Area.polygon(((43.0, 16.0), (43.0, 16.4), (43.3, 16.4), (43.3, 16.0)))
    assert 1070 < square.km2 < 1100
    assert areas.cover(spark, square, 3.0).count() == 36
    with pytest.raises(ValueError, match="more than 10 cells"):
        areas.cover(spark, square, 3.0, max_cells=10)
    assert areas.check_areas(areas.circle_points(spark.createDataFrame([(1, 43.5, 16.4, 5.0)], "area_id int, lat double, lng double, radius_km double")), closed=("croatia",)).first()["verdict"] == "no region is open"


def test_sample_without_sites_and_short_register_rows(spark):
    items = spark.createDataFrame([(i, "t", None) for i in range(9)], "id long, tier string, website string")
    assert sorted(r["id"] for r in catalogue.stratified_sample(items, 4).collect()) == [0, 1, 2, 3]
    reg = spark.createDataFrame([(1, "A", "Riva 1", None, None, None, True), (2, "B", "Riva 2", None, None, None, False)], "seq long, legal_name string, office string, premises string, insured string, protected string, complete boolean")
    assert [r["seq"] for r in catalogue.register_entries(reg).collect()] == [1]


def test_licences_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["adriatic", "adriatik", "vision", "water", "island", "islands", "kayak", "charter", "sun", "blue"]
    names = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)]
    entries = spark.createDataFrame([(i, 0, n, n, None if i % 3 else f"riva|{i % 5}") for i, n in enumerate(names[:30])], "seq long, line_no int, legal_name string, norm_name string, street string")
    p = spark.createDataFrame([(i, n, None if i % 2 else f"riva|{i % 9}") for i, n in enumerate(names[30:])], "id long, norm_name string, street string")
    got = {r["place_id"]: (r["seq"], r["agreement"]) for r in catalogue.find_licences(p, entries).collect()}
    streets = {f"riva|{i % 5}" for i in range(30) if i % 3 == 0}

    def dice(a, b):
        left, total = sorted(b), 0.0
        for w in sorted(a):
            best = max(((indel(w, x), x) for x in left), key=lambda t: (t[0], [-ord(c) for c in t[1]]), default=None)
            if best and best[0] >= 85:
                left.remove(best[1])
                total += best[0] / 100
        return 2 * total / (len(a) + len(b))

    want = {}
    for i, n in enumerate(names[30:]):
        street = None if i % 2 else f"riva|{i % 9}"
        pool = [j for j in range(30) if street not in streets or (j % 3 == 0 and f"riva|{j % 5}" == street)]
        best = min(((-dice(n.split(), names[j].split()), j) for j in pool), default=None)
        if best and -best[0] >= 0.7:
            want[i] = (best[1], round(-best[0], 4))
    assert got == want


def test_supplier_lists_name_their_corruptions(spark):
    p = synthetic.synthetic_places(spark, 800).withColumn("address", F.lit("Ulica Kralja 1, 21000 Split, Croatia"))
    s = synthetic.synthetic_suppliers(p)
    rows = s.collect()
    assert {r["kind"] for r in rows} == {"seeded", "phantom", "hard_negative"}
    assert len({r["supplier_id"] for r in rows}) == len(rows)
    seen = {c for r in rows for c in r["corruptions"]}
    assert {"transposed", "phone_reformatted", "website_stale", "website_subdomain", "address_abbreviated", "moved", "legal_name", "case"} <= seen
    original = {r["id"]: r for r in p.collect()}
    for r in rows:
        if r["kind"] == "seeded" and r["corruptions"] == ["transposed"]:
            a, b = original[r["place_id"]]["name"], r["name"]
            assert sorted(a) == sorted(b)
            assert sum(x != y for x, y in zip(a, b, strict=True)) in (0, 2)
        assert ("phone_missing" not in r["corruptions"]) or r["phone"] is None
    assert sorted(r["place_id"] for r in evaluation.expected_verdicts(s).collect()) == sorted(r["place_id"] for r in rows if r["kind"] == "seeded")
    assert s.collect() == rows


def test_a_busy_client_is_limited_as_by_brute_force(spark):
    rng = random.Random(2)
    at = sorted(rng.uniform(-50, 400) for _ in range(300))
    d = spark.createDataFrame([("c", i, t) for i, t in enumerate(at)], "client string, id long, s double").select("client", "id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("at"))
    got = {r["id"]: r["earlier"] for r in catalogue.rate_limited(d, seconds=30, most=10).collect()}
    us = [int(t * 1_000_000) for t in at]
    assert got == {i: sum(1 for j, u in enumerate(us) if us[i] - 30_000_000 < u and (u, j) < (us[i], i)) for i in range(300)}


def test_pairwise_areas_of_cells(spark):
    cells = spark.createDataFrame([(43.0, 16.0, 2.0, 0)], "lat double, lng double, half_side_km double, depth int")
    r = areas.cell_shapes(cells).first()
    assert all(a < b for a, b in pairwise([r["south"], r["lat"], r["north"]]))
    assert abs(r["radius_km"] - 2.0 * 2**0.5 * 1.002) < 1e-9


def test_register_and_licences_are_dealt_and_made_once(spark, tmp_path):
    """A register in one small file is parsed on all cores, and licences don't parse it, or make keys, anew at every step."""
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    entries = build.register_entries(spark, str(tmp_path))
    assert entries.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    hits, entries = build._licences(spark, str(tmp_path))
    assert not any("part.parquet" in f for d in (hits, entries) for f in d.inputFiles())
