"""SQL for the queries of the lead build, written apart from them for a second engine: no part of the library's rules is imported."""

from __future__ import annotations

from leadlattice.plans.oracle import _DEMAND, MATCH_SQL, _ring_sql, d, lcs
from leadlattice.plans.views import KEYS_SQL

_TOWN = "(['Split', 'Zadar', 'Šibenik', 'Omiš', 'Korčula', 'Nowhere'])[p_partkey % 6 + 1]"
FIND_SQL = f"""find_v AS (
  SELECT p_partkey AS id, p_name AS name,
    CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'Riva ' || (p_partkey % 50 + 1) || ', 21000 ' || {_TOWN} || CASE WHEN p_partkey % 2 = 0 THEN ', ' || {_TOWN} ELSE '' END || ', Croatia' END AS address,
    CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN {_TOWN} ELSE '21000 ' || {_TOWN} END AS locality,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '021' END AS phone, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 21 = 1 THEN '' ELSE 'https://www.s' || p_partkey || '.hr' END AS website,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 10 END AS rating, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 500 END AS review_count,
    ([['parking', 'atm'], ['bar', 'bank'], ['tour_agency', 'point_of_interest'], ['museum'], ['tour_agency', 'school']])[p_partkey % 5 + 1] AS types,
    (['boat tour', 'Excursion', 'wine tasting', 'walking tour', 'things to do', 'unknown', NULL])[p_partkey % 7 + 1] AS query, (['boat_tour', 'Other', 'none', NULL, 'Food_Drink', 'unclear', 'cultural', 'adventure'])[p_partkey % 8 + 1] AS answer,
    CASE WHEN p_partkey % 10 < 6 THEN 'experience_operator' WHEN p_partkey % 10 < 8 THEN 'not_relevant' ELSE 'attraction_only' END AS verdict, CASE WHEN p_partkey % 4 = 0 THEN 'model' ELSE 'rule' END AS decided_by,
    p_partkey % 5 <> 0 AS extracted, CASE WHEN p_partkey % 5 <> 0 THEN (['online_booking', 'enquiry_form', 'phone_or_email_only', 'unclear'])[p_partkey % 4 + 1] END AS booking,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE (['en', 'en,hr', 'en,hr', 'en,hr,de'])[p_partkey % 5] END AS languages, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 6 = 0 THEN ['food_drink', 'adventure'] ELSE [] END AS sells,
    CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'viator.com,getyourguide' WHEN p_partkey % 7 = 1 THEN 'tripadvisor' ELSE '' END AS marketplaces
  FROM part
), cat_v AS (
  SELECT *, CASE WHEN answer IN ('boat_tour', 'Food_Drink', 'cultural', 'adventure') THEN lower(answer)
    ELSE CASE lower(query) WHEN 'boat tour' THEN 'boat_tour' WHEN 'excursion' THEN 'day_trip' WHEN 'wine tasting' THEN 'food_drink' WHEN 'walking tour' THEN 'walking_tour' WHEN 'things to do' THEN 'other' END END AS category
  FROM find_v
), path_v(category, path) AS (VALUES
  ('boat_tour', 'Tours, Sightseeing & Cruises/Cruises & Sailing'), ('day_trip', 'Tours, Sightseeing & Cruises/Tours by Duration/Day Trips'), ('food_drink', 'Food & Drink'), ('cultural', 'Art & Culture/Culture'),
  ('walking_tour', 'Tours, Sightseeing & Cruises/How to Get Around/Walking Tours'), ('adventure', 'Outdoor Activities/Extreme Sports')
), deco_v AS (
  SELECT c.*, CASE WHEN path IS NULL THEN replace(c.category, '_', ' ') ELSE string_split(path, '/')[-1] END AS viator_label, replace(path, '/', ' / ') AS viator_path, string_split(path, '/')[1] AS viator_top,
    CASE WHEN answer IN ('boat_tour', 'Food_Drink', 'cultural', 'adventure') THEN 'classifier' WHEN c.category IS NULL AND len(sells) > 0 THEN 'website' WHEN c.category IS NOT NULL THEN 'search term' ELSE 'unresolved' END AS category_source
  FROM cat_v c LEFT JOIN path_v p ON p.category = c.category
)"""
#: Scores of finds by the address's town. Only Split and, with accents off, the other towns of the demand table are known.
SCORE_SQL = f"""{FIND_SQL}, demand_v(destination, category, demand, supply) AS (VALUES {_DEMAND}), at_v AS (
  SELECT *, CASE WHEN address IS NOT NULL AND id % 2 = 0 AND id % 6 <> 5 THEN (['split', 'zadar', 'sibenik', 'omis', 'korcula'])[id % 6 + 1] END AS destination FROM deco_v
), asked_v AS (
  SELECT id, destination, CASE WHEN category IS NOT NULL AND category <> 'other' THEN [category] WHEN destination IS NOT NULL AND len(sells) > 0 THEN sells ELSE ['?'] END AS cats FROM at_v
), gap_v AS (
  SELECT a.id, avg(greatest(0, least(1, greatest(0, 1 - coalesce(supply, 9) / ({d(0.6)} * coalesce(demand, 25))) * coalesce(demand, 25) / {d(100)}))) AS gap_fit
  FROM (SELECT id, destination, unnest(cats) AS category FROM asked_v) a LEFT JOIN demand_v v ON v.destination = a.destination AND v.category = a.category GROUP BY a.id
), axes_v AS (
  SELECT v.*, gap_fit,
    {d(0.6)} * CASE WHEN rating IS NULL THEN {d(0.35)} ELSE greatest(0, least(1, (rating - {d(3.5)}) / {d(1.5)})) END + {d(0.4)} * greatest(0, least(1, log10(1 + coalesce(review_count, 0)) / log10({d(401)}))) AS quality,
    ({d(0.2)} * coalesce(website <> '', false)::INT + {d(0.1)} * coalesce(phone <> '', false)::INT + CASE WHEN extracted THEN {d(0.35)} * ([{d(1)}, {d(0.6)}, {d(0.3)}, {d(0.15)}])[id % 4 + 1] ELSE 0 END
      + CASE WHEN extracted THEN {d(0.15)} * least(1, ([1, 2, 2, 3])[id % 5] / {d(3)}) ELSE 0 END + CASE WHEN extracted THEN {d(0.1)} * (id % 2 = 0)::INT ELSE 0 END + CASE WHEN extracted THEN {d(0.1)} * (marketplaces <> '')::INT ELSE 0 END)
      / ({d(0.2)} + {d(0.1)} + {d(0.35)} + {d(0.15)} + {d(0.1)} + {d(0.1)}) AS readiness
  FROM at_v v JOIN gap_v USING (id)
), scored_v AS (SELECT *, {d(0.35)} * quality + {d(0.35)} * readiness + {d(0.3)} * gap_fit AS composite FROM axes_v),
banded_v AS (SELECT *, CASE WHEN composite >= {d(0.55)} THEN 'A' WHEN composite >= {d(0.42)} THEN 'B' ELSE 'C' END AS band FROM scored_v)"""
_CSV = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_U = "CAST(CAST('0x' || substr(md5({0} || ' ' || '{1}' || ' {2}'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296"


def u(salt: str, seed: int = 42, key: str = "id") -> str:
    return "(" + _U.format(key, salt, seed) + ")"


_DF = "tok_df AS (SELECT token, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part) GROUP BY token), all_n AS (SELECT greatest(count(*), 1) AS n FROM part)"
_SITE = f"""{FIND_SQL}, site_v AS (SELECT id, website, booking, id % 4 AS pages, id % 2 = 0 AS cached, coalesce(website, '') = '' AS no_site,
  CASE WHEN coalesce(website, '') = '' THEN 'no website' WHEN id % 8 = 1 THEN 'blocked by robots.txt' WHEN id % 8 = 2 THEN 'blocked: the site refuses our user agent' WHEN id % 8 = 3 THEN 'page not found' WHEN NOT extracted THEN 'empty' END AS error FROM find_v)"""
_REGISTER = r"""reg_v AS (
  SELECT p_partkey AS seq, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE upper(p_name) || ' j.d.o.o. za turizam' END AS legal_name, lower(p_name) || ' za' AS low,
    'Vukovarska ' || (p_partkey % 40 + 1) || ', 10 000 Zagreb' AS office,
    CASE p_partkey % 4 WHEN 0 THEN ['Vukovarska ' || (p_partkey % 40 + 1) || ', 10 000 Zagreb'] WHEN 1 THEN ['Riva ' || (p_partkey % 50 + 1) || ', 21 000 Split']
      WHEN 2 THEN ['Obala Lazareta ' || (p_partkey % 50 + 1) || 'a, 23000 Zadar', NULL, 'Put 4, 21 000 Split'] ELSE ['Trg bez broja'] END AS lines FROM part WHERE p_partkey % 23 <> 0 AND p_partkey % 19 <> 0
), line_v AS (SELECT *, unnest(lines) AS premises, unnest(range(len(lines))) AS line_no FROM reg_v), entry_v AS (
  SELECT seq, CAST(line_no AS INTEGER) AS line_no, legal_name, office AS registered_office, premises, CASE WHEN premises LIKE 'Vuk%' THEN 'zagreb' WHEN premises LIKE '%Zadar' THEN 'zadar' WHEN premises LIKE '%Split' THEN 'split' END AS town,
    CASE WHEN premises LIKE 'Riva%' THEN 'istarska' WHEN premises LIKE 'Obala%' THEN 'zadarska' END AS county, ([true, false, NULL, NULL])[seq % 4 + 1] AS liability_insurance, 'Croatia osiguranje' AS insurer, '01.01.2027.' AS policy_expiry,
    ([true, NULL, false])[seq % 3 + 1] AS insolvency_protection, '0' || (seq % 9) || '.2019.' AS first_registered, low AS norm_name,
    CASE WHEN premises LIKE 'Vuk%' THEN 'vukovarska|' || (seq % 40 + 1) WHEN premises LIKE 'Riva%' THEN 'riva|' || (seq % 50 + 1) WHEN premises LIKE 'Obala%' THEN 'lazareta|' || (seq % 50 + 1) END AS street
  FROM line_v WHERE premises IS NOT NULL
)"""
def _family(parts: int) -> str:
    digits = f"lpad(CAST((p_partkey // {parts}) * 7919 % 100003 AS VARCHAR), 5, '0') || lpad(CAST((p_partkey // {parts}) * 271 % 997 AS VARCHAR), 3, '0')"
    return f"translate({digits}, '0123456789', 'abdegkmnru')"


_BRANDED = "lower(p_name) || ' ' || lower(translate(p_brand, '#0123456789', 'xabdegkmnru')) || ' '"
_LICENCE = f"""{_REGISTER}, pl_v AS (SELECT p_partkey AS id, list_distinct(string_split({_BRANDED} || {_family(3)}, ' ')) AS w, CASE WHEN p_partkey % 9 <> 0 THEN 'riva|' || (p_partkey % 50 + 1) END AS street FROM part),
en_v AS (SELECT p_partkey, {_BRANDED} || CASE WHEN p_partkey % 3 = 0 THEN substr({_family(4)}, 1, 1) || substr({_family(4)}, 3) ELSE {_family(4)} END AS full_name FROM part),
ew_v AS (SELECT seq, line_no, street, upper(full_name) || ' j.d.o.o. za turizam' AS written, list_distinct(string_split(full_name || ' za', ' ')) AS w FROM entry_v JOIN en_v ON seq = p_partkey),
all_w AS (SELECT id, 0 AS line_no, 0 AS side, unnest(w) AS t FROM pl_v UNION ALL SELECT seq, line_no, 1, unnest(w) FROM ew_v), nn_v AS (SELECT (SELECT count(*) FROM pl_v) + (SELECT count(*) FROM ew_v) AS n),
wt_v AS (SELECT t, ln((n + 1) / {d('(1 + df)')}) AS wt FROM (SELECT t, count(*) AS df FROM all_w GROUP BY t), nn_v WHERE NOT (df >= 3 AND df / n > {d(0.1)})),
pt_v AS (SELECT id, t, wt FROM all_w JOIN wt_v USING (t) WHERE side = 0), et_v AS (SELECT id AS seq, line_no, t, wt FROM all_w JOIN wt_v USING (t) WHERE side = 1),
ptot_v AS (SELECT id, sum(wt) AS wt FROM pt_v GROUP BY id), etot_v AS (SELECT seq, line_no, sum(wt) AS wt FROM et_v GROUP BY ALL),
bag_v AS (SELECT side, t, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda x: length(t) - length(replace(t, x, ''))) AS bag FROM (SELECT DISTINCT side, t FROM all_w JOIN wt_v USING (t))),
like_v AS (SELECT * FROM (SELECT a.t AS a, b.t AS b, CASE WHEN a.t = b.t THEN {d(100)} ELSE {d(200)} * ({lcs('a.t', 'b.t')}) / (length(a.t) + length(b.t)) END AS r FROM bag_v a, bag_v b
  WHERE a.side = 0 AND b.side = 1 AND 200 * list_sum(list_transform(list_zip(a.bag, b.bag), lambda z: least(z[1], z[2]))) >= 85 * (length(a.t) + length(b.t))) WHERE r >= 85),
hits_v AS (SELECT p.id, e.seq, e.line_no, p.t, max(least(p.wt, e.wt) * r / 100) AS c FROM pt_v p JOIN like_v ON a = p.t JOIN et_v e ON e.t = b GROUP BY ALL),
shared_v AS (SELECT id, seq, line_no, sum(c) AS c FROM hits_v GROUP BY ALL),
pair_v AS (SELECT s.id, s.seq, s.line_no, written AS legal_name, least({d(1)}, 2 * s.c / (pw.wt + ew.wt)) AS agreement, p.street IN (SELECT street FROM entry_v WHERE street IS NOT NULL) AS met, coalesce(p.street = e.street, false) AS same
  FROM shared_v s JOIN pl_v p USING (id) JOIN ew_v e ON e.seq = s.seq AND e.line_no = s.line_no JOIN ptot_v pw ON pw.id = s.id JOIN etot_v ew ON ew.seq = s.seq AND ew.line_no = s.line_no),
hit_v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(agreement, 12) DESC, seq, line_no) AS rk FROM pair_v WHERE agreement >= {d(0.7)} AND (same OR NOT coalesce(met, false))) WHERE rk = 1)"""
_OUTLINE = ((43.55, 16.30), (43.55, 16.60), (43.45, 16.55), (43.48, 16.45), (43.44, 16.33))
_FIELD = ((43.4, 16.0), (46.0, 20.0), (60.0, 40.0), (50.0, 17.0))


def _edges(outline: tuple) -> str:
    """Edges of an outline in kilometres around the mean of its points, as a table expression."""
    points = ", ".join(f"({i}, {d(a)}, {d(b)})" for i, (a, b) in enumerate(outline))
    n = len(outline)
    return f"""pt_v(i, lat, lng) AS (VALUES {points}), ref_v AS (SELECT avg(lat) AS lat0, avg(lng) AS lng0 FROM pt_v), km_v AS (SELECT i, (lng - lng0) * {d(111.32)} * cos(radians(lat0)) AS x, (lat - lat0) * {d(111.32)} AS y FROM pt_v, ref_v),
edge_v AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM km_v a JOIN km_v b ON b.i = (a.i + 1) % {n})"""


_CIRCLES = f"circle_v AS (SELECT s_suppkey AS area_id, {d(42)} + CAST(s_suppkey * 37 % 100 AS DOUBLE) / 20 AS clat, {d(13)} + CAST(s_suppkey * 53 % 100 AS DOUBLE) / 12 AS clng, {d(3)} + s_suppkey % 9 AS r FROM supplier)"
#: A star of ten points about each supplier.
_STARS = f"""{_CIRCLES}, star_v AS (SELECT area_id, i, clat, clng, clat + k * r * sin(2 * pi() * i / 10) / {d(111.32)} AS lat, clng + k * r * cos(2 * pi() * i / 10) / ({d(111.32)} * cos(radians(clat))) AS lng
  FROM (SELECT *, CASE WHEN i % 2 = 1 THEN {d(0.3)} + CAST(area_id % 4 AS DOUBLE) / 5 ELSE {d(1)} END AS k FROM circle_v, range(10) t(i)))"""
_EDGE_SIDE = "(x2 - x1) * (y + ({1}) - y1) - (y2 - y1) * (x + ({0}) - x1)"
_SIDES = ", ".join(_EDGE_SIDE.format(a, b) for a in ("-1.5", "1.5") for b in ("-1.5", "1.5"))
_COVER = f"""{_STARS}, ref_v AS (SELECT area_id, avg(lat) AS lat0, avg(lng) AS lng0 FROM star_v GROUP BY 1), km_v AS (SELECT area_id, i, (lng - lng0) * {d(111.32)} * cos(radians(lat0)) AS x, (lat - lat0) * {d(111.32)} AS y FROM star_v JOIN ref_v USING (area_id)),
edge_v AS (SELECT a.area_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM km_v a JOIN km_v b ON b.area_id = a.area_id AND b.i = (a.i + 1) % 10), box_v AS (SELECT area_id, min(x) AS x0, min(y) AS y0, max(x) AS x9, max(y) AS y9 FROM km_v GROUP BY 1),
grid_v AS (SELECT area_id, i, j, x0 + {d(1.5)} * (2 * i + 1) AS x, y0 + {d(1.5)} * (2 * j + 1) AS y FROM box_v, range(20) a(i), range(20) b(j) WHERE x0 + 3 * i < x9 AND y0 + 3 * j < y9),
met_v AS (SELECT area_id, x, y, bool_or(least(x1, x2) <= x + 1.5 AND greatest(x1, x2) >= x - 1.5 AND least(y1, y2) <= y + 1.5 AND greatest(y1, y2) >= y - 1.5 AND least({_SIDES}) <= 0 AND greatest({_SIDES}) >= 0) AS crossed,
  sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM grid_v JOIN edge_v USING (area_id) GROUP BY area_id, x, y)"""
_CROATIA = (45.60, 13.55)


def _area_checks() -> str:
    from leadlattice.plans.oracle import _region_outline

    outline, lat0, lng0 = _region_outline()
    return f"""WITH e(x1, y1, x2, y2) AS (VALUES {_ring_sql(outline)}), {_STARS},
p AS (SELECT a.area_id, a.i * 200 + k AS i, a.lat + (b.lat - a.lat) * k / {d(200)} AS la, a.lng + (b.lng - a.lng) * k / {d(200)} AS ln FROM star_v a JOIN star_v b ON b.area_id = a.area_id AND b.i = (a.i + 1) % 10, range(200) t(k)),
q AS (SELECT area_id, i, (ln - {d(lng0)}) * {d(111.32)} * cos(radians({d(lat0)})) AS x, (la - {d(lat0)}) * {d(111.32)} AS y FROM p),
m AS (SELECT area_id, i, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) AS t FROM q, e),
r AS (SELECT area_id, i, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1 OR min(sqrt(power(x - x1 - t * (x2 - x1), 2) + power(y - y1 - t * (y2 - y1), 2))) <= 8 AS ok FROM m GROUP BY area_id, i)
SELECT area_id, CASE WHEN bool_and(ok) THEN 'inside' WHEN bool_or(ok) THEN 'beyond' ELSE 'outside' END AS verdict, CASE WHEN bool_or(ok) THEN 'croatia' END AS region FROM r GROUP BY area_id"""


_IN_CELL = f"k.lat >= c.lat - h / {d(111.32)} AND k.lat < c.lat + h / {d(111.32)} AND k.lng >= c.lng - h / ({d(111.32)} * cos(radians(c.lat))) AND k.lng < c.lng + h / ({d(111.32)} * cos(radians(c.lat)))"
_SWEPT = f"""WITH RECURSIVE {KEYS_SQL}, c(lat, lng, h, depth) AS (
  SELECT * FROM (VALUES ({d(53.4)}, {d(28.8)}, {d(1200)}, 0), ({d(43.5)}, {d(16.5)}, {d(60)}, 0)) v(lat, lng, h, depth)
  UNION ALL
  SELECT c.lat + a * h / 2 / {d(111.32)}, c.lng + b * h / 2 / ({d(111.32)} * cos(radians(c.lat))), h / 2, depth + 1 FROM c, (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) AS s(a, b)
  WHERE depth < 2 AND NOT (depth = 1 AND lng > 29) AND (SELECT count(*) FROM key_v k WHERE {_IN_CELL}) >= 60
), ask AS (SELECT *, depth = 1 AND lng > 29 AS lost FROM c), hit AS (SELECT c.lat, c.lng, c.h, c.depth, k.id FROM ask c LEFT JOIN key_v k ON {_IN_CELL} WHERE NOT lost),
first AS (SELECT id, min(depth) AS depth FROM hit WHERE id IS NOT NULL GROUP BY id), cell_v AS (SELECT lat, lng, h, depth, least(60, count(id)) AS n FROM hit GROUP BY ALL)"""
_SWEEP = f"""{_SWEPT}, full_v AS (SELECT * FROM cell_v WHERE depth = 2 AND n >= 60)
SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n, min(id) AS first_id FROM first GROUP BY depth UNION ALL SELECT -1, count(*), -1 FROM full_v HAVING count(*) > 0"""
_EVENT = "SELECT 'c' || (user_id % 60) AS cell, event_type AS query, event_id % 4 AS page, event_id AS e FROM events"
_PAGES = f"""ev AS ({_EVENT}), pg AS (SELECT cell, query, page, min(e) AS m, count(*) AS n FROM ev GROUP BY 1, 2, 3), good AS (SELECT * FROM pg WHERE m % 11 <> 0)"""
_SPLIT_GAP = f"greatest(0, least(1, greatest(0, 1 - coalesce(supply, 9) / ({d(0.6)} * coalesce(demand, 25))) * coalesce(demand, 25) / {d(100)}))"
_PLACES_AND_SUPPLIERS = "place_v p ON p.id = place_id JOIN supplier_v s ON s.id = best_supplier"
_SCORE = f"CASE WHEN hard IS NOT NULL THEN 1 ELSE round(best_score, 4) END"
_CONFIDENCE = f"round(CASE WHEN hard IS NOT NULL THEN {d(0.97)} WHEN verdict = 'existing' THEN least(1, {d(0.5)} + (best_score - {d(0.8)}) * 2) ELSE {d(0.5)} * (1 - abs(best_score - ({d(0.8)} + {d(0.65)}) / 2) / (({d(0.8)} - {d(0.65)}) / 2)) END, 3)"
_LOCALITY = "trim(string_split(p.address, ',')[-2])"
_STOPPED = "('tours','tour','travel','agency','excursions','adventure','adventures','experience','experiences','croatia')"

SQL = {
    "lead_decoration": f"WITH {FIND_SQL} SELECT id, category, viator_label, viator_path, viator_top, category_source, CASE WHEN category_source = 'website' THEN 'food_drink,adventure' END AS sells_categories, CASE WHEN category_source = 'website' THEN 'Food & Drink,Extreme Sports' END AS viator_labels, marketplaces, marketplaces LIKE '%viator%' AS claims_viator, marketplaces LIKE '%tripadvisor%' AS claims_tripadvisor, coalesce(website, '') = '' AS no_website, locality FROM deco_v",
    "address_destination": f"WITH {SCORE_SQL} SELECT id, CASE WHEN id % 25 = 0 THEN 'hvar' ELSE destination END AS destination FROM at_v",
    "find_scores": f"WITH {SCORE_SQL} SELECT id, round(quality, 6) AS quality, round(readiness, 6) AS readiness, round(gap_fit, 6) AS gap_fit, round(composite, 6) AS composite, band FROM banded_v",
    "warehouse_columns": f"WITH {SCORE_SQL} SELECT '20260102T030405Z' AS run_id, '2026-01-02 03:04:05' AS run_at, '2026-01-02' AS run_date, destination, CAST(id AS VARCHAR) AS place_source_id, name, website, phone, address, rating, review_count, band, round(quality, 4) AS quality, round(readiness, 4) AS readiness, round(gap_fit, 4) AS gap_fit, category, category_source, viator_top, viator_label, viator_path, booking, languages, 3 AS axes FROM banded_v",
    "phone_numbers": """WITH c AS (SELECT c_custkey AS id, c_custkey % 5 AS k, (['HR', 'SI', 'RS'])[c_custkey // 5 % 3 + 1] AS region, (['385', '386', '381'])[c_custkey // 5 % 3 + 1] AS code,
  (CASE c_custkey // 5 % 3 WHEN 0 THEN ['91', '1', '21'] WHEN 1 THEN ['31', '1', '68'] ELSE ['64', '11', '63'] END)[c_custkey % 5 + 1] AS head, (CASE c_custkey // 5 % 3 WHEN 0 THEN [7, 7, 6] WHEN 1 THEN [6, 7, 6] ELSE [7, 6, 6] END)[c_custkey % 5 + 1] AS n FROM customer)
SELECT id, CASE WHEN k < 3 THEN '+' || code || head || lpad(CAST(id * 7919 % CAST(power(10, n) AS BIGINT) AS VARCHAR), n, '0') END AS e164, CASE WHEN k < 3 THEN region END AS region FROM c""",
    "published_leads": f"WITH {SCORE_SQL}, r AS (SELECT '20260102T030405Z' AS run_id, '2026-01-02' AS run_date, band, id FROM banded_v WHERE destination IS NOT NULL UNION ALL SELECT '20260103T030405Z', '2026-01-03', band, id FROM banded_v WHERE destination IS NOT NULL AND id % 3 = 0) SELECT run_id, run_date, band, count(*) AS n, count(DISTINCT id) AS places FROM r GROUP BY ALL",
    "csv_export": f"WITH {FIND_SQL} SELECT id || ',' || {_CSV.format(chr(39) + 'a' + chr(34) + chr(39) + ' || name')} || ',' || CASE WHEN address IS NULL THEN '' ELSE '\"' || address || '\"' END || ',' || CASE WHEN id % 7 = 0 THEN '\"two' || chr(10) || 'lines\"' ELSE '' END || ',x;y' AS line FROM find_v",
    "review_queue": f"{MATCH_SQL} SELECT place_id, p.name AS discovered_name, p.address AS discovered_address, p.website AS discovered_website, p.phone AS discovered_phone, {_LOCALITY} AS locality, s.id AS supplier_id, s.name AS supplier_name, s.address AS supplier_address, {_SCORE} AS score, {_CONFIDENCE} AS confidence FROM decided_v JOIN {_PLACES_AND_SUPPLIERS} WHERE verdict = 'needs_review'",
    "match_log": f"{MATCH_SQL} SELECT place_id, s.id AS supplier_id, p.name AS discovered_name, s.name AS supplier_name, s.phone AS supplier_phone, s.website AS supplier_website, decided_by, {_CONFIDENCE} AS confidence, '2026-01-02' AS matched_on FROM decided_v JOIN {_PLACES_AND_SUPPLIERS} WHERE verdict = 'existing'",
    "funnel": f"""{MATCH_SQL}, j AS (SELECT verdict, true_supplier IS NOT NULL AS known FROM decided_v LEFT JOIN truth_v USING (place_id)) SELECT count(*) FILTER (verdict = 'existing') AS already_on_file, count(*) FILTER (verdict = 'net_new') AS net_new,
count(*) FILTER (verdict = 'needs_review') AS needs_review, count(*) FILTER (NOT known) AS net_new_actual, count(*) FILTER (verdict = 'net_new' AND NOT known) AS net_new_correct_in_leads, count(*) FILTER (verdict = 'net_new' AND known) AS existing_wrongly_in_leads,
count(*) FILTER (verdict = 'needs_review' AND NOT known) AS net_new_held_in_review, (SELECT count(*) FROM documents) AS places_discovered, count(*) AS operators, count(*) FILTER (verdict = 'net_new') AS leads_scored, (SELECT count(*) FROM supplier_v) AS suppliers_on_file, (SELECT count(*) FROM documents) - count(*) AS not_relevant FROM j""",
    "lead_gate": f"{MATCH_SQL} SELECT count(*) FILTER (verdict = 'net_new') AS net_new, count(*) FILTER (verdict <> 'net_new') AS intruders FROM decided_v WHERE place_id % 3 = 0",
    "already_known": "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'matched' WHEN p_partkey % 7 = 0 THEN 'review' WHEN p_partkey % 2 = 0 THEN 'leads' END AS known_in, CASE WHEN p_partkey % 10 = 0 THEN 'Already a known supplier, matched 2026-01-02' WHEN p_partkey % 5 = 0 THEN 'Already a known supplier, matched' WHEN p_partkey % 7 = 0 THEN 'Already awaiting human review' WHEN p_partkey % 2 = 0 THEN 'Already a lead, band ' || (['A', 'B', '?'])[p_partkey % 3 + 1] END AS known_label FROM part",
    "top_and_bottom": f"WITH {SCORE_SQL}, r AS (SELECT id, round(composite, 6) AS composite FROM scored_v), t AS (SELECT *, row_number() OVER (ORDER BY composite DESC, id) AS up, row_number() OVER (ORDER BY composite, id DESC) AS down FROM r) SELECT 'top' AS place, CAST(up AS INTEGER) AS rank, id, composite FROM t WHERE up <= 12 UNION ALL SELECT 'bottom', CAST(down AS INTEGER), id, composite FROM t WHERE down <= 4",
    "leads_page": f"WITH {SCORE_SQL} SELECT id, round(composite, 6) AS composite FROM scored_v ORDER BY round(composite, 6) DESC, id LIMIT 200",
    "site_first": f"WITH {FIND_SQL} SELECT id, website FROM find_v ORDER BY coalesce(website, '') = '', id LIMIT 40",
    "console_filter": f"WITH {FIND_SQL} SELECT id, locality, category FROM deco_v WHERE locality = '21000 Zadar' AND id % 11 <> 0",
    "filter_options": f"WITH {FIND_SQL}, f AS (SELECT 'locality' AS field, locality AS value FROM deco_v UNION ALL SELECT 'category', category FROM deco_v) SELECT field, value, count(*) AS n FROM f WHERE value <> '' GROUP BY 1, 2",
    "console_tallies": f"WITH {SCORE_SQL} SELECT count(*) AS leads, count(*) FILTER (band = 'A') AS band_a, count(*) FILTER (band = 'B') AS band_b, count(*) FILTER (band = 'C') AS band_c, count(*) FILTER (marketplaces = 'tripadvisor') AS tripadvisor_not_viator, count(*) FILTER (gap_fit > 0) AS in_a_gap, count(*) FILTER (coalesce(website, '') = '') AS no_website FROM banded_v",
    "sweep_scores": f"WITH {SCORE_SQL} SELECT id, round(composite, 6) AS composite, false AS enriched FROM scored_v",
    "search_terms": "WITH t AS (SELECT p_name AS term FROM part GROUP BY p_name HAVING arg_min(p_size, p_partkey) <= 40), a AS (SELECT p_partkey // 8 AS request, p_partkey AS nr, CASE WHEN p_partkey % 7 = 0 THEN p_name || 's' WHEN p_partkey % 3 = 0 THEN ' ' || upper(p_name) || ' ' ELSE p_name END AS term FROM part), j AS (SELECT a.*, t.term AS canonical FROM a LEFT JOIN t ON lower(trim(a.term)) = lower(t.term)) SELECT request, nr AS \"at\", term, canonical, canonical IS NOT NULL AND count(canonical) OVER (PARTITION BY request ORDER BY nr) <= 3 AS accepted FROM j",
    "terms_by_category": "SELECT category, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT p_name AS term, min(p_type) AS category FROM part GROUP BY p_name HAVING arg_min(p_size, p_partkey) <= 40) GROUP BY category",
    "classification_rows": f"""WITH {FIND_SQL}, c AS (SELECT id, CASE WHEN id % 5 IN (0, 4) THEN 'not_relevant' WHEN id % 5 = 2 THEN 'experience_operator' END AS ruled, CASE WHEN id % 6 <> 5 THEN verdict END AS said, CASE WHEN id % 6 <> 5 THEN CAST(id % 100 AS DOUBLE) / 100 END AS sure,
{u('3', 0).replace(" || ' ' || '3' || ' 0'", " || ' 3'")} AS draw FROM find_v), k AS (SELECT *, ruled IS NOT NULL AND draw < CASE WHEN ruled = 'not_relevant' THEN {d(0.2)} ELSE {d(0.05)} END AS audited FROM c)
SELECT id, coalesce(ruled, said, 'experience_operator') AS verdict, CASE WHEN ruled = 'not_relevant' THEN {d(0.95)} WHEN ruled IS NOT NULL THEN {d(0.9)} ELSE coalesce(sure, 0) END AS confidence, CASE WHEN ruled IS NULL THEN 'model' ELSE 'rule' END AS decided_by, ruled IS NULL AND coalesce(sure, 0) < {d(0.6)} AS needs_review, audited, audited AND coalesce(said <> ruled, false) AS disagrees FROM k""",
    "resolved_categories": f"WITH {FIND_SQL} SELECT coalesce(category, 'unresolved') AS category, count(*) AS n FROM cat_v GROUP BY 1",
    "watched_rejects": f"WITH {FIND_SQL} SELECT verdict, decided_by, count(*) AS records, count(*) FILTER (id % 5 IN (2, 3, 4)) AS watched FROM find_v WHERE verdict <> 'experience_operator' GROUP BY 1, 2",
    "landed_classifications": "SELECT user_id AS place_id, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 1",
    "miss_attribution": f"{MATCH_SQL} SELECT decided_by || ':' || CASE WHEN hard IS NULL THEN 'score' ELSE 'exact ' || (['domain', 'domain and name', 'phone and name', 'name and premises'])[hard] END AS cause, count(*) AS n FROM decided_v WHERE verdict = 'existing' AND place_id NOT IN (SELECT place_id FROM truth_v) GROUP BY 1",
    "duplicate_names": "SELECT lower(trim(p_name)) AS name, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1",
    "confusion_examples": f"""{MATCH_SQL}, o AS (SELECT place_id, CASE WHEN verdict = 'needs_review' THEN 'review' WHEN verdict = 'existing' AND best_supplier = true_supplier THEN 'true_positive' WHEN verdict = 'existing' AND true_supplier IS NOT NULL THEN 'wrong_supplier' WHEN verdict = 'existing' THEN 'false_positive'
WHEN true_supplier IS NOT NULL THEN 'false_negative' ELSE 'true_negative' END AS outcome FROM decided_v LEFT JOIN truth_v USING (place_id)), n AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY place_id) AS rk FROM o) SELECT outcome, string_agg(place_id, ',' ORDER BY place_id) AS place_ids FROM n WHERE rk <= 5 GROUP BY 1""",
    "band_settings": f"WITH {SCORE_SQL}, s(a, b) AS (VALUES ({d(0.65)}, {d(0.45)}), ({d(0.55)}, {d(0.42)}), ({d(0.52)}, {d(0.40)})) SELECT a, b, count(*) FILTER (round(composite, 4) >= a) AS band_a, count(*) FILTER (round(composite, 4) < a AND round(composite, 4) >= b) AS band_b, count(*) FILTER (round(composite, 4) < b) AS band_c FROM scored_v, s GROUP BY a, b",
    "axis_ceiling": f"WITH {SCORE_SQL}, m AS (SELECT round(max(quality), 4) AS quality, round(max(readiness), 4) AS readiness, round(max(gap_fit), 4) AS gap_fit FROM scored_v) SELECT *, round(quality * {d(0.35)} + readiness * {d(0.35)} + gap_fit * {d(0.3)}, 4) AS ceiling FROM m",
    "axis_liveness": f"WITH {FIND_SQL}, v(destination, category, demand, supply) AS (VALUES {_DEMAND}), g AS (SELECT coalesce(c.category, '(unresolved)') AS g, round(max({_SPLIT_GAP}), 3) AS x FROM cat_v c LEFT JOIN v ON v.destination = 'split' AND v.category = c.category GROUP BY 1) SELECT count(*) AS groups, count(DISTINCT x) AS values, count(DISTINCT x) > 1 AS discriminates FROM g",
    "distinctive_words": f"WITH {_DF}, i AS (SELECT token, ln((n + 1) / (1 + df)) AS idf, row_number() OVER (ORDER BY df, token) AS rank FROM tok_df, all_n) SELECT CAST(rank AS INTEGER) AS rank, token, round(idf, 6) AS idf FROM i WHERE rank <= 10",
    "generic_explained": f"WITH {_DF}, g AS (SELECT token FROM tok_df, all_n WHERE df >= 3 AND df / n > {d(0.1)}) SELECT p_partkey AS id, coalesce((SELECT string_agg(DISTINCT t, ', ' ORDER BY t) FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS t) WHERE t IN (SELECT token FROM g)), '') AS generic FROM part",
    "field_coverage": f"WITH {FIND_SQL} SELECT field, count(*) FILTER (v NOT IN ('', '0', '0.0')) AS filled, count(*) AS n FROM (SELECT 'website' AS field, website AS v FROM find_v UNION ALL SELECT 'phone', phone FROM find_v UNION ALL SELECT 'rating', CAST(rating AS VARCHAR) FROM find_v) GROUP BY 1",
    "type_histogram": f"WITH {FIND_SQL} SELECT type, count(*) AS n FROM (SELECT unnest(types) AS type FROM find_v) GROUP BY 1",
    "enrichment_summary": f"WITH {_SITE} SELECT count(*) AS operators, count(*) FILTER (error IS NULL AND booking IS NOT NULL) AS extracted, count(*) FILTER (no_site) AS skipped_no_site, count(*) FILTER (error = 'blocked by robots.txt') AS blocked_by_robots, count(*) FILTER (error LIKE 'blocked:%') AS blocked_by_site, count(*) FILTER (error IN ('page not found', 'empty')) AS fetch_failures, CAST(coalesce(sum(pages) FILTER (NOT no_site), 0) AS BIGINT) AS pages_fetched, count(*) FILTER (NOT no_site AND cached) AS cache_hits FROM site_v",
    "booking_histogram": f"WITH {_SITE} SELECT booking, count(*) AS n FROM site_v WHERE error IS NULL AND booking IS NOT NULL GROUP BY 1",
    "unreadable_reasons": "SELECT (['blocked by bot protection (HTTP 202)', 'blocked: the site refuses our user agent', 'page not found', 'the operator''s site is erroring (HTTP 503)', 'the page is not HTML', 'HTTP 418'])[p_partkey % 6 + 1] AS reason, count(*) AS n FROM part GROUP BY 1",
    "descriptions": f"WITH {FIND_SQL} SELECT id, sha256('Name: ' || name || chr(10) || 'Google categories: ' || array_to_string(types, ', ') || coalesce(chr(10) || 'Address: ' || address, '') || CASE WHEN website <> '' THEN chr(10) || 'Website: ' || website ELSE '' END || coalesce(chr(10) || 'Rating: ' || printf('%.1f', rating) || ' from ' || coalesce(review_count, 0) || ' reviews', '') || coalesce(chr(10) || 'Found by searching: ' || query, '')) AS text_sha256 FROM find_v",
    "shared_phone_summary": f"WITH {KEYS_SQL}, k AS (SELECT e164, count(*) AS n FROM key_v WHERE e164 IS NOT NULL GROUP BY 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS shared_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS affected, round(coalesce(sum(n) FILTER (n > 1), 0) / greatest(1, coalesce(sum(n), 0)), 4) AS affected_share FROM k",
    "site_sample": f"""WITH {FIND_SQL}, i AS (SELECT id, coalesce(viator_top, 'unmapped') AS tier FROM deco_v WHERE website <> ''), s AS (SELECT tier, count(*) AS n, min(id) AS f FROM i GROUP BY tier), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) = 1 AS dom FROM s),
w AS (SELECT *, CASE WHEN dom THEN 0 WHEN tier = 'unmapped' THEN least(3, n) ELSE n END AS want FROM t), b AS (SELECT *, coalesce(sum(want) OVER (ORDER BY n, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(want) OVER () AS every FROM w),
k AS (SELECT tier, CASE WHEN dom THEN 500 - least(500, every) ELSE greatest(0, least(want, 500 - bef)) END AS take FROM b), r AS (SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY id) AS rk FROM i) SELECT id, tier FROM r JOIN k USING (tier) WHERE rk <= take""",
    "taxonomy_children": "WITH p AS (SELECT DISTINCT string_split(replace(p_type, ' ', '/') || '/' || p_brand, '/') AS parts FROM part), n AS (SELECT DISTINCT parts[1:i] AS parts FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p)) SELECT array_to_string(a.parts, '/') AS path, count(b.parts) AS children FROM n a LEFT JOIN n b ON len(b.parts) = len(a.parts) + 1 AND b.parts[1:len(a.parts)] = a.parts GROUP BY 1",
    "taxonomy_tops": "SELECT string_split(p_type, ' ')[1] AS name, bool_or(p_size = 7 AND p_type NOT LIKE 'S%') AS covered FROM part GROUP BY 1",
    "register_entries": f"WITH {_REGISTER} SELECT seq, line_no, legal_name, registered_office, premises, town, county, liability_insurance, insurer, policy_expiry, insolvency_protection, first_registered, norm_name, street FROM entry_v",
    "licences": f"WITH {_LICENCE} SELECT id AS place_id, seq, line_no, legal_name, round(agreement, 4) AS agreement, same AS address_agreement FROM hit_v",
    "licence_position": f"WITH {_LICENCE} SELECT CASE WHEN liability_insurance AND insolvency_protection THEN 'both declared' WHEN liability_insurance THEN 'liability only' WHEN insolvency_protection THEN 'insolvency only' WHEN NOT liability_insurance OR NOT insolvency_protection THEN 'neither declared' ELSE 'no declaration held' END AS position, count(*) AS n, count(*) FILTER (same) AS by_address FROM hit_v h JOIN entry_v e ON e.seq = h.seq AND e.line_no = h.line_no GROUP BY 1",
    "cell_shapes": f"WITH c AS (SELECT s_suppkey AS id, {d(43)} + CAST(s_suppkey % 50 AS DOUBLE) / 20 AS lat, {d(15)} + CAST(s_suppkey % 70 AS DOUBLE) / 25 AS lng, {d(1.5)} + s_suppkey % 4 AS h FROM supplier) SELECT id, round(h * sqrt({d(2)}) * {d(1.002)}, 6) AS radius_km, round(lat + h / {d(111.32)}, 6) AS north, round(lat - h / {d(111.32)}, 6) AS south, round(lng + h / ({d(111.32)} * cos(radians(lat))), 6) AS east, round(lng - h / ({d(111.32)} * cos(radians(lat))), 6) AS west, CASE WHEN h = 1.5 THEN {d(4)} WHEN h = 2.5 THEN {d(4)} WHEN h = 3.5 THEN {d(4)} ELSE {d(5)} END AS auto_half_side FROM c",
    "polygon_cover": f"WITH {_COVER} SELECT area_id, round(y / {d(111.32)} + lat0, 6) AS lat, round(x / ({d(111.32)} * cos(radians(lat0))) + lng0, 6) AS lng, {d(1.5)} AS half_side_km FROM met_v JOIN ref_v USING (area_id) WHERE crossed OR inside",
    "cover_circle": f"WITH {_CIRCLES}, g AS (SELECT *, 2 * (2 * i + 1) - r AS x, 2 * (2 * j + 1) - r AS y FROM circle_v, range(8) a(i), range(8) b(j) WHERE 2 * i < r AND 2 * j < r) SELECT area_id, round(y / {d(111.32)} + clat, 6) AS lat, round(clng + x / ({d(111.32)} * cos(radians(clat))), 6) AS lng, {d(2)} AS half_side_km FROM g WHERE power(greatest(0, abs(x) - 2), 2) + power(greatest(0, abs(y) - 2), 2) <= r * r",
    "quadtree_cells": f"WITH RECURSIVE {_CIRCLES}, q AS (SELECT clat AS lat, clng AS lng, r AS half_side_km, 0 AS depth FROM circle_v UNION ALL SELECT lat + a * half_side_km / 2 / {d(111.32)}, lng + b * half_side_km / 2 / ({d(111.32)} * cos(radians(lat))), half_side_km / 2, depth + 1 FROM q, (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) AS s(a, b) WHERE depth < 3) SELECT round(lat, 6) AS lat, round(lng, 6) AS lng, half_side_km, depth FROM q WHERE depth = 3",
    "points_in_areas": f"WITH {KEYS_SQL}, {_STARS}, w AS (SELECT area_id, i, clat + 4 * (lat - clat) AS y, clng + 4 * (lng - clng) AS x FROM star_v), ed AS (SELECT a.area_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM w a JOIN w b ON b.area_id = a.area_id AND b.i = (a.i + 1) % 10) SELECT id, area_id FROM key_v, ed GROUP BY id, area_id HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lng - 3 < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1",
    "points_in_polygon": f"WITH {KEYS_SQL}, {_edges(_FIELD)}, a AS (SELECT round(abs(sum(x1 * y2 - x2 * y1)) / 2, 2) AS km2 FROM edge_v), q AS (SELECT id, (lng - lng0) * {d(111.32)} * cos(radians(lat0)) AS x, (lat - lat0) * {d(111.32)} AS y FROM key_v, ref_v), r AS (SELECT id, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM q, edge_v GROUP BY id) SELECT id, km2 FROM r, a WHERE inside",
    "area_checks": _area_checks(),
    "adaptive_sweep": _SWEEP,
    "failed_searches": f"{_SWEPT} SELECT round(lat, 6) AS lat, round(lng, 6) AS lng, CAST(depth AS INTEGER) AS depth, 'boat tour' AS query, CASE WHEN lat > 53 THEN 'HTTP 503' ELSE 'HTTP 429' END AS error FROM ask WHERE lost",
    "sweep_counters": f"{_SWEPT} SELECT count(*) AS searches, CAST(sum(greatest(1, ceil(n / {d(20)}))) AS BIGINT) AS calls, CAST(sum(n) AS BIGINT) AS raw_places, CAST(max(depth) AS INTEGER) AS deepest, count(*) FILTER (n >= 60 AND depth = 2) AS unresolved_cells, (SELECT count(*) FROM ask WHERE lost) AS failed_searches, (SELECT count(DISTINCT lat > 53) FROM ask WHERE lost) AS kinds_of_failure FROM cell_v",
    "report": f"""WITH {SCORE_SQL} SELECT 'bands' AS section, band AS name, CAST(count(*) AS DOUBLE) AS value FROM banded_v GROUP BY band UNION ALL SELECT 'verdicts', verdict, count(*) FROM find_v GROUP BY verdict UNION ALL SELECT 'types', t, count(*) FROM (SELECT unnest(types) AS t FROM find_v) GROUP BY t
UNION ALL SELECT 'booking', booking, count(*) FROM find_v WHERE coalesce(website, '') <> '' AND booking IS NOT NULL AND id % 8 NOT IN (1, 2, 3) GROUP BY booking""",
    "landed_searches": f"WITH {_PAGES} SELECT cell, query, count(*) AS calls, CAST(least(sum(n), 20) AS BIGINT) AS raw_count, sum(n) >= 20 AS truncated FROM good GROUP BY 1, 2",
    "landed_places": f"""WITH {_PAGES}, r AS (SELECT ev.*, row_number() OVER (PARTITION BY ev.cell, ev.query ORDER BY ev.page, e) AS rk FROM ev JOIN good g ON g.cell = ev.cell AND g.query = ev.query AND g.page = ev.page)
SELECT 'p' || e AS source_id, 'Op ' || e AS name, CAST(40 + e % 5 AS DOUBLE) AS lat, (['tour_agency', 'bank', 'bar', 'lodging'])[e % 4 + 1] AS categories FROM r WHERE rk <= 20 AND e % 10 <> 0 AND e % 9 <> 0 AND e % 4 <> 1""",
    "landed_ledger": f"WITH {_PAGES} SELECT 'places.text_search.enterprise' AS sku, CAST(sum(m % 3 + 1) AS BIGINT) AS calls, round(sum(m % 3 + 1) * {d(35)} / 1000, 4) AS usd, count(*) FILTER (m % 11 = 0) AS unanswered FROM pg",
    "newest_register": "SELECT '/docs/' || max(s) || '_Popis_TA..xlsx' AS url, max(s) AS stamp FROM (SELECT lpad(CAST(230101 + p_partkey * 37 % 20000 AS VARCHAR), 6, '0') AS s FROM part)",
    "not_landed": "SELECT page_id, substr(sha256(url), 1, 20) AS key FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)",
    "robots_verdicts": r"""WITH h AS (SELECT page_id, length(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))) % 3 AS k, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS path FROM pages),
v AS (SELECT page_id, CASE k WHEN 0 THEN CASE WHEN regexp_matches(path, '^/.*\?.*ref=') THEN '/*?*ref=' WHEN regexp_matches(path, '^/.*/82$') THEN '/*/82$' WHEN path LIKE '/fr/%' THEN '/fr/' WHEN regexp_matches(path, '^/.*/8') THEN '/*/8' END
  WHEN 1 THEN CASE WHEN path LIKE '/about%' THEN '/about' WHEN path LIKE '/en/%' THEN '/en/' END END AS pattern FROM h)
SELECT page_id, coalesce(pattern IN ('/*/82$', '/fr/'), true) AS allowed, pattern FROM v""",
    "robots_candidates": r"""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages), c(nr, path) AS (VALUES (0, '/'), (1, '/about'), (2, '/contact'), (3, '/tours'), (4, '/booking')),
r AS (SELECT host, path, CAST(row_number() OVER (PARTITION BY host ORDER BY nr) AS INTEGER) AS nth FROM h, c WHERE NOT (length(host) % 3 = 1 AND path = '/about'))
SELECT host, 'https://' || host || path AS url, nth FROM r WHERE nth <= 3""",
    "run_cost": f"""WITH r(k, rate, free) AS (VALUES (0, 35, 1000), (1, 32, 5000), (2, 0, 0), (3, 20, 1000), (4, 5, 10000)), a AS (SELECT count(*) AS n, rate, free FROM events JOIN r ON user_id % 5 = k GROUP BY k, rate, free), s AS (SELECT sum(n * {d('rate')} / 1000) AS a, sum(greatest(0, n - free) * {d('rate')} / 1000) AS f, CAST(sum(n) AS BIGINT) AS n FROM a),
m(model, ri, ro) AS (VALUES ('click', {d(3)}, {d(15)}), ('view', {d(1)}, {d(5)}), ('signup', {d(3)}, {d(15)}), ('purchase', {d(0.25)}, {d(1.25)})), t AS (SELECT event_type AS model, count(*) AS calls, sum(event_id % 997) AS i, sum(event_id % 89) AS o, sum(event_id % 13) AS w, sum(event_id % 211) AS r, bool_or(event_id % 5000 = 4999) AS b FROM events GROUP BY 1),
c AS (SELECT round(sum(round(CASE WHEN b THEN {d(0.5)} ELSE {d(1)} END * ((i * ri + w * ri * {d(1.25)} + r * ri * {d(0.1)} + o * ro) / {d(1000000)}), 6)), 6) AS m, CAST(sum(calls) AS BIGINT) AS k FROM t LEFT JOIN m USING (model)), z AS (SELECT n + k AS calls, m AS model_usd, round(a + m, 6) AS usd, round(f + m, 6) AS usd_after_free FROM s, c)
SELECT calls, model_usd, usd, round(usd * {d(0.78)}, 6) AS gbp, usd_after_free, round(usd_after_free * {d(0.78)}, 6) AS gbp_after_free FROM z""",
    "stage_economics": f"WITH s(stage, usd) AS (VALUES ('discover', {d(0.98)}), ('classify', {d(0.3657)}), ('enrich', {d(1.9639)})), o AS (SELECT count(*) AS n FROM documents WHERE doc_id % 2 = 1) SELECT stage, usd, round(usd * {d(0.78)}, 4) AS gbp, round(usd / sum(usd) OVER (), 4) AS share, round(usd * {d(0.78)} / n, 6) AS gbp_per_operator, round({d(240)} / n, 6) AS manual_gbp_per_operator FROM s, o",
    "expected_verdicts": f"SELECT doc_id AS place_id, 'VS-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS true_supplier FROM documents WHERE {u('role', key='doc_id')} < {d(0.4)}",
}
SQL["classification_summary"] = f"""WITH k AS ({SQL['classification_rows'].replace('audited, audited AND', 'audited, said, audited AND')}), a AS (SELECT count(*) FILTER (audited AND said IS NOT NULL) AS audits, count(*) FILTER (disagrees) AS bad, count(*) AS total, count(*) FILTER (decided_by = 'model') AS asked FROM k)
SELECT total, (SELECT count(*) FROM k WHERE verdict = 'experience_operator') AS operators, (SELECT count(*) FROM k WHERE verdict = 'attraction_only') AS attractions, (SELECT count(*) FROM k WHERE verdict = 'not_relevant') AS not_relevant, (SELECT count(*) FROM k WHERE needs_review) AS needs_review,
round(asked / {d('total')}, 6) AS model_share, CASE WHEN audits = 0 THEN {d(1)} ELSE round(1 - bad / {d('audits')}, 6) END AS audit_agreement FROM a"""
_MARKS = {
    "diacritics_stripped": f"{u('strip')} < 0.55", "legal_form": f"{u('legal')} < 0.35", "legal_form_removed": f"{u('legal')} >= 0.35 AND {u('unlegal')} < 0.20 AND name LIKE '% d.o.o.'", "ampersand": "name LIKE '%&%' AND " + u("amp") + " < 0.5",
    "transposed": f"{u('typo')} < 0.12 AND length(name) > 3", "case": f"{u('case')} < 0.10", "truncated": f"length(name) > 22 AND {u('cut')} < 0.08", "phone_missing": f"{u('phone')} < 0.15", "phone_stale": f"{u('phone')} >= 0.15 AND {u('phone')} < 0.28",
    "phone_reformatted": f"{u('phone')} >= 0.28 AND {u('phone')} < 0.75", "website_missing": f"{u('site')} < 0.14", "website_stale": f"{u('site')} >= 0.14 AND {u('site')} < 0.24", "website_www": f"{u('site')} >= 0.24 AND {u('site')} < 0.45",
    "website_subdomain": f"{u('site')} >= 0.45 AND {u('site')} < 0.58", "address_abbreviated": f"{u('address')} < 0.30", "moved": f"{u('address')} >= 0.30 AND {u('address')} < 0.42", "legal_name": f"{u('entity')} < 0.18",
}
SQL["corruption_histogram"] = f"WITH {KEYS_SQL}, s AS (SELECT * FROM key_v WHERE {u('role')} < 0.4), m AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS corruption FROM s WHERE {c}' for k, c in _MARKS.items())}) SELECT corruption, count(*) AS n FROM m GROUP BY 1"
_PICK = "([{0}])[CAST(floor({1} * {2}) AS INTEGER) + 1]"
SQL["synthetic_places"] = f"""WITH r AS (SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier), v AS (SELECT id, {_PICK.format("'Adria', 'Bura', 'Maestral', 'Sidro', 'Galeb', 'Val', 'Jedro', 'Otok'", u('first', 11), 8)} AS a, {_PICK.format("'Tours', 'Charter', 'Experience', 'Kayak', 'Wine', 'Walks'", u('second', 11), 6)} AS b,
CAST(floor({u('town', 11)} * 3) AS INTEGER) + 1 AS t FROM r) SELECT id, a || ' ' || b || ' ' || id AS name, CASE WHEN {u('site', 11)} >= {d(0.22)} THEN 'https://www.p' || id || '.hr' END AS website, CASE WHEN {u('tel', 11)} >= {d(0.12)} THEN '+3852' || lpad(CAST(CAST(floor({u('digits', 11)} * 10000000) AS BIGINT) AS VARCHAR), 7, '0') END AS phone,
round({d(3.2)} + {u('rating', 11)} * ({d(5)} - {d(3.2)}), 1) AS rating, round(([{d(43.5081)}, {d(44.1194)}, {d(43.1729)}])[t] + ({u('lat', 11)} * 2 - 1) * {d(0.05)}, 6) AS lat, round(([{d(16.4402)}, {d(15.2314)}, {d(16.4411)}])[t] + ({u('lng', 11)} * 2 - 1) * {d(0.05)}, 6) AS lng FROM v"""

#: Words of places and suppliers of which no more than 15 % of the letters are unmatched. Such words share a pair of neighbouring letters, or are equal.
_PAIRS_OF = "list_transform(range(1, greatest(1, length({0}))), lambda i: substr({0}, CAST(i AS INTEGER), 2))"


def _similar(name: str, tokens: str) -> str:
    return f"""{name}_a AS (SELECT DISTINCT token AS a, {_PAIRS_OF.format('token')} AS pa FROM {tokens} WHERE id % 2 = 0), {name}_b AS (SELECT DISTINCT token AS b, {_PAIRS_OF.format('token')} AS pb FROM {tokens} WHERE id % 2 = 1),
{name}_m AS MATERIALIZED (SELECT a, b FROM {name}_a JOIN {name}_b ON a <> b AND list_has_any(pa, pb) AND 200 * least(length(a), length(b)) >= 85 * (length(a) + length(b))),
{name} AS MATERIALIZED (SELECT a, b, {d(100)} AS ratio FROM {name}_a JOIN {name}_b ON a = b UNION ALL SELECT a, b, ratio FROM (SELECT a, b, {d(200)} * ({lcs('a', 'b')}) / (length(a) + length(b)) AS ratio FROM {name}_m) WHERE ratio >= 85)"""


def _greedy(name: str, tokens: str, like: str) -> str:
    """Of each pair of names or addresses the weight of its matches: the most telling word first takes the most similar one that is left."""
    return f"""{name}_e AS (SELECT pid, sid, x.token AS a, x.w AS aw, list({{'b': y.token, 'w': y.w, 'r': ratio}} ORDER BY ratio DESC, y.token) AS e
  FROM cand_v JOIN {tokens} x ON x.id = pid JOIN {like} l ON l.a = x.token JOIN {tokens} y ON y.id = sid AND y.token = l.b GROUP BY pid, sid, x.token, x.w),
{name} AS (SELECT pid, sid, list_reduce(list({{'aw': aw, 'e': e}} ORDER BY aw DESC, a), lambda acc, g: CASE WHEN len(list_filter(g.e, lambda t: NOT list_contains(acc.used, t.b))) = 0 THEN acc
  ELSE {{'s': acc.s + least(g.aw, list_filter(g.e, lambda t: NOT list_contains(acc.used, t.b))[1].w) * list_filter(g.e, lambda t: NOT list_contains(acc.used, t.b))[1].r / 100, 'used': list_append(acc.used, list_filter(g.e, lambda t: NOT list_contains(acc.used, t.b))[1].b)}} END,
  {{'s': {d(0)}, 'used': CAST([] AS VARCHAR[])}}).s AS w FROM {name}_e GROUP BY pid, sid)"""


def _fuzzy() -> str:
    exact = [f"{n} AS (SELECT pid, sid, sum(x.w) AS w FROM cand_v JOIN {t} x ON x.id = pid JOIN {t} y ON y.id = sid AND y.token = x.token GROUP BY 1, 2)" for n, t in (("nsh", "nt"), ("ash", "ads"))]
    made = [_similar("like_n", "nt") + ", " + _greedy("nsh", "nt", "like_n"), _similar("like_a", "ads") + ", " + _greedy("ash", "ads", "like_a")]
    sql = MATCH_SQL
    for old, new in zip(exact, made, strict=True):
        assert old in sql
        sql = sql.replace(old, new)
    return sql


SQL["match_verdicts_fuzzy"] = f"""{_fuzzy()}, second_w AS (SELECT pid, score FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY coalesce(hard, 9), score DESC, sid) AS rk FROM score_w) WHERE rk = 2)
SELECT place_id, CASE WHEN verdict <> 'net_new' THEN best_supplier END AS supplier_id, verdict, CASE WHEN nobody THEN 0 WHEN hard IS NOT NULL THEN 1 ELSE round(best_score, 4) END AS score,
  round(CASE WHEN nobody THEN {d(0.95)} WHEN hard IS NOT NULL THEN {d(0.97)} WHEN verdict = 'existing' THEN least(1, {d(0.5)} + (best_score - {d(0.8)}) * 2) WHEN verdict = 'net_new' THEN least(1, {d(0.5)} + ({d(0.65)} - best_score) * 2)
    ELSE {d(0.5)} * (1 - abs(best_score - ({d(0.8)} + {d(0.65)}) / 2) / (({d(0.8)} - {d(0.65)}) / 2)) END, 3) AS confidence, decided_by,
  CASE WHEN nobody THEN 'no candidates' WHEN hard IS NULL THEN 'score' ELSE 'exact ' || (['domain', 'domain and name', 'phone and name', 'name and premises'])[hard] END AS signal,
  CASE WHEN NOT nobody AND hard IS NULL THEN round(score, 4) END AS runner_up FROM decided_v LEFT JOIN second_w ON pid = place_id"""
