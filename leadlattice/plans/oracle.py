"""SQL for the registered queries, written apart from them for a second engine."""

from __future__ import annotations

from leadlattice.plans.views import KEYS_SQL

def d(x: object) -> str:
    return f"CAST({x} AS DOUBLE)"


def lcs(a: str, b: str) -> str:
    """The length of the longest common subsequence of two strings, a row of the table at a time."""
    step = f"lambda done, j: list_append(done, CASE WHEN substr({b}, CAST(j AS INTEGER), 1) = ch THEN r[j] + 1 ELSE greatest(done[j], r[j + 1]) END)"
    rows = f"list_reduce(string_split({a}, ''), lambda r, ch: list_reduce(range(1, length({b}) + 1), {step}, [CAST(0 AS BIGINT)]), list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT)))"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE {rows}[-1] END"


def _cents(x: str) -> str:
    up = f"floor(({x}) * 100 + {d(0.5)})"
    return f"(CASE WHEN {up} / 100 - ({x}) > {d(0.005)} THEN {up} - 1 ELSE {up} END) / 100"


#: Fixed values, written out here so that a slip in the library shows: demand and supply by destination and category.
_DEMAND = """('split', 'boat_tour', 100, 74), ('split', 'day_trip', 78, 41), ('split', 'food_drink', 61, 14), ('split', 'water_sports', 54, 26), ('split', 'walking_tour', 48, 33), ('split', 'adventure', 44, 19),
('split', 'cultural', 39, 27), ('split', 'private_guide', 31, 9), ('split', 'transfer', 29, 22), ('dubrovnik', 'walking_tour', 92, 68), ('dubrovnik', 'boat_tour', 84, 55), ('dubrovnik', 'day_trip', 71, 44),
('dubrovnik', 'cultural', 66, 51), ('dubrovnik', 'food_drink', 52, 11), ('dubrovnik', 'water_sports', 41, 18), ('dubrovnik', 'private_guide', 37, 12), ('dubrovnik', 'adventure', 24, 13), ('hvar', 'boat_tour', 88, 47),
('hvar', 'water_sports', 46, 15), ('hvar', 'food_drink', 43, 8), ('hvar', 'day_trip', 38, 21), ('hvar', 'walking_tour', 22, 12), ('zadar', 'day_trip', 64, 30), ('zadar', 'boat_tour', 57, 28),
('zadar', 'adventure', 49, 16), ('zadar', 'food_drink', 36, 7), ('zadar', 'walking_tour', 33, 19), ('sibenik', 'day_trip', 58, 24), ('sibenik', 'adventure', 47, 13), ('sibenik', 'boat_tour', 42, 20),
('sibenik', 'cultural', 29, 17), ('rovinj', 'food_drink', 69, 16), ('rovinj', 'walking_tour', 44, 26), ('rovinj', 'boat_tour', 41, 23), ('rovinj', 'cultural', 35, 21), ('pula', 'cultural', 63, 39),
('pula', 'day_trip', 45, 22), ('pula', 'food_drink', 42, 10), ('pula', 'adventure', 31, 14), ('zagreb', 'walking_tour', 71, 52), ('zagreb', 'food_drink', 66, 19), ('zagreb', 'cultural', 58, 40),
('zagreb', 'day_trip', 51, 33), ('korcula', 'food_drink', 54, 9), ('korcula', 'boat_tour', 47, 24), ('korcula', 'water_sports', 28, 11), ('omis', 'adventure', 76, 31), ('omis', 'water_sports', 52, 20),
('omis', 'boat_tour', 34, 18), ('trogir', 'boat_tour', 49, 27), ('trogir', 'walking_tour', 27, 16), ('makarska', 'water_sports', 45, 19), ('makarska', 'adventure', 38, 15), ('makarska', 'boat_tour', 36, 21)"""
_IDF = """, n_v AS (SELECT greatest(count(*), 1) AS n FROM key_v),
name_df AS (SELECT token, count(*) AS df FROM (SELECT unnest(name_set) AS token FROM key_v) GROUP BY token),
name_idf AS (SELECT token, df, ln((n + 1) / (1 + df)) AS idf, df >= 3 AND df / n > CAST(0.1 AS DOUBLE) AS is_generic FROM name_df, n_v),
addr_df AS (SELECT token, count(*) AS df FROM (SELECT unnest(address_set) AS token FROM supplier_v) GROUP BY token)"""
_CANDIDATES = """cand_v AS (
  SELECT p.id AS pid, s.id AS sid FROM place_v p JOIN supplier_v s ON p.domain = s.domain
  UNION SELECT p.id, s.id FROM place_v p JOIN supplier_v s ON p.e164 = s.e164
  UNION SELECT p.id, s.id FROM (SELECT id, unnest(name_set) AS t FROM place_v) p JOIN (SELECT id, unnest(name_set) AS t FROM supplier_v) s ON p.t = s.t
  UNION SELECT p.id, s.id FROM place_v p JOIN supplier_v s ON abs(p.cell_lat - s.cell_lat) <= 1 AND abs(p.cell_lng - s.cell_lng) <= 1
)"""
_HAVERSINE = "2 * CAST(6371.0088 AS DOUBLE) * asin(least(CAST(1 AS DOUBLE), sqrt(power(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin((radians({3}) - radians({1})) / 2), 2))))"
_NEAR = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - ({0} - CAST(0.1 AS DOUBLE)) / (CAST(2.0 AS DOUBLE) - CAST(0.1 AS DOUBLE))))"


#: The outline of the open market.
_OPEN_MARKET = (
    (45.60, 13.55), (45.52, 13.95), (45.60, 14.25), (45.48, 14.60), (45.45, 14.90), (45.50, 15.15), (45.62, 15.35), (45.72, 15.55), (45.88, 15.70), (46.05, 16.00),
    (46.22, 16.15), (46.38, 16.30), (46.54, 16.60), (46.48, 16.90), (46.32, 17.20), (46.10, 17.55), (45.98, 17.95), (45.92, 18.35), (46.02, 18.60), (46.18, 18.80),
    (45.92, 19.00), (45.78, 19.05), (45.48, 19.15), (45.20, 19.45), (45.10, 19.10), (45.15, 18.75), (45.05, 18.35), (45.10, 17.60), (45.20, 16.90), (45.00, 16.50),
    (44.85, 16.20), (44.55, 16.10), (44.25, 16.35), (43.95, 16.70), (43.65, 17.05), (43.45, 17.30), (43.20, 17.65), (42.95, 17.90), (42.75, 18.35), (42.55, 18.55),
    (42.35, 18.55), (42.30, 17.90), (42.60, 17.20), (42.85, 16.30), (43.10, 15.60), (43.60, 15.10), (44.20, 14.55), (44.60, 14.30), (44.62, 13.85), (44.68, 13.50),
    (45.10, 13.32), (45.45, 13.35),
)


def _ring_sql(outline: tuple) -> str:
    """Edges of an outline in the plane at the mean of its points, as rows."""
    n, (_, lat, lng) = len(outline), _region_outline()
    at = lambda p: (f"({d(p[1])} - {d(lng)}) * {d(111.32)} * cos(radians({d(lat)}))", f"({d(p[0])} - {d(lat)}) * {d(111.32)}")
    return ", ".join("(" + ", ".join((*at(outline[i]), *at(outline[(i + 1) % n]))) + ")" for i in range(n))


def _region_outline() -> tuple:
    return _OPEN_MARKET, sum(a for a, _ in _OPEN_MARKET) / len(_OPEN_MARKET), sum(b for _, b in _OPEN_MARKET) / len(_OPEN_MARKET)


def _region() -> str:
    outline, lat, lng = _region_outline()
    return f"""WITH {KEYS_SQL}, e(x1, y1, x2, y2) AS (VALUES {_ring_sql(outline)}),
pt AS (SELECT id, (lng - {d(lng)}) * {d(111.32)} * cos(radians({d(lat)})) AS x, (lat - {d(lat)}) * {d(111.32)} AS y FROM key_v),
m AS (SELECT id, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) AS t FROM pt, e),
r AS (SELECT id, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1
  OR min(sqrt(power(x - x1 - t * (x2 - x1), 2) + power(y - y1 - t * (y2 - y1), 2))) <= 8 AS ok FROM m GROUP BY id)
SELECT CASE WHEN ok THEN 'croatia' END AS region, count(*) AS n, min(id) AS first_id FROM r GROUP BY ok"""


_LEADS = f"""demand_v(destination, category, demand, supply) AS (VALUES {_DEMAND}),
rev AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
lead_v AS (
  SELECT s_suppkey AS id, CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE {d(3)} + CAST(s_suppkey * 37 % 100 AS DOUBLE) / 50 END AS rating, coalesce(n, 0) AS reviews, s_suppkey % 3 <> 0 AS site, s_suppkey % 4 <> 0 AS phone,
    s_suppkey % 5 <> 0 AS extracted, s_suppkey % 4 AS booking, CASE WHEN s_suppkey % 5 IN (1, 2) THEN s_suppkey % 5 WHEN s_suppkey % 5 = 3 THEN 2 ELSE 3 END AS languages, s_suppkey % 2 = 0 AS email, s_suppkey % 7 = 0 AS marketplace,
    (['split', 'dubrovnik', 'hvar', 'zadar', 'sibenik', 'rovinj', 'pula', 'zagreb', 'korcula', 'omis', 'trogir', 'makarska', 'plitvice'])[s_suppkey % 13 + 1] AS destination,
    (['boat_tour', 'day_trip', 'food_drink', 'water_sports', 'walking_tour', 'adventure', 'cultural', 'private_guide', 'transfer', 'other'])[s_suppkey % 10 + 1] AS category
  FROM supplier LEFT JOIN rev ON s_suppkey = l_suppkey
), want_v AS (
  SELECT id, destination, CASE WHEN category <> 'other' THEN [category] WHEN id % 20 = 9 THEN ['food_drink', 'adventure'] ELSE ['?'] END AS cats FROM lead_v
), gap_v AS (
  SELECT w.id, avg(greatest(0, least(1, greatest(0, 1 - coalesce(supply, 9) / ({d(0.6)} * coalesce(demand, 25))) * coalesce(demand, 25) / {d(100)}))) AS gap_fit
  FROM (SELECT id, destination, unnest(cats) AS category FROM want_v) w LEFT JOIN demand_v v USING (destination, category) GROUP BY w.id
), axis_v AS (
  SELECT id, destination, category,
    {d(0.6)} * CASE WHEN rating IS NULL THEN {d(0.35)} ELSE greatest(0, least(1, (rating - {d(3.5)}) / {d(1.5)})) END + {d(0.4)} * greatest(0, least(1, log10(1 + reviews) / log10({d(401)}))) AS quality,
    {d(0.2)} * site::INT + {d(0.1)} * phone::INT + CASE WHEN extracted THEN {d(0.35)} * ([{d(1)}, {d(0.6)}, {d(0.3)}, {d(0.15)}])[booking + 1] + {d(0.15)} * least(1, languages / {d(3)}) + {d(0.1)} * email::INT + {d(0.1)} * marketplace::INT ELSE 0 END AS readiness,
    gap_fit, extracted, languages
  FROM lead_v JOIN gap_v USING (id)
), scored_v AS (SELECT *, {d(0.35)} * quality + {d(0.35)} * readiness + {d(0.3)} * gap_fit AS composite FROM axis_v),
cut_v AS (SELECT {d(0.35)} * max(round(quality, 4)) + {d(0.35)} * max(round(readiness, 4)) + {d(0.3)} * max(round(gap_fit, 4)) AS ceiling FROM scored_v)"""
_TAX = "path_v AS (SELECT DISTINCT string_split(replace(p_type, ' ', '/') || '/' || p_brand, '/') AS parts, p_size FROM part), node_v AS (SELECT DISTINCT parts[1:i] AS parts FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM path_v))"
_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'),
  '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<svg\b.*?</svg\s*>|<iframe\b.*?</iframe\s*>', ' ', 'gsi'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g'))"""
_SKUS = "(VALUES ('places.text_search.enterprise', 35, 1000, 0), ('places.text_search.pro', 32, 5000, 1), ('places.text_search.ids_only', 0, 0, 2), ('places.details.enterprise', 20, 1000, 3), ('geocoding', 5, 10000, 4)) AS r(sku, rate, free, k)"

_SETS = """both_w AS (SELECT *, array_to_string(list_sort(list_intersect(pn, sn)), ' ') AS i, array_to_string(list_sort(list_filter(pn, lambda t: NOT list_contains(sn, t))), ' ') AS a,
    array_to_string(list_sort(list_filter(sn, lambda t: NOT list_contains(pn, t))), ' ') AS b FROM pair_w)"""
_LENGTHS = "(CASE WHEN i = '' THEN 0 ELSE length(i) + 1 END + length({}))"
_TOKEN_SET = f"""CASE WHEN i <> '' AND (a = '' OR b = '') THEN {d(100)}
  WHEN i = '' THEN {d(100)} * (1 - (length(a) + length(b) - 2 * ({lcs('a', 'b')})) / {d("(length(a) + length(b))")})
  ELSE greatest({d(100)} * (1 - (length(a) + length(b) - 2 * ({lcs('a', 'b')})) / {d(f"({_LENGTHS.format('a')} + {_LENGTHS.format('b')})")}),
    {d(100)} * (1 - (1 + length(a)) / {d(f"(length(i) + {_LENGTHS.format('a')})")}), {d(100)} * (1 - (1 + length(b)) / {d(f"(length(i) + {_LENGTHS.format('b')})")})) END / 100"""
#: Decisions about every place: best_w has the winner of each, decided_v the verdict.
MATCH_SQL = f"""WITH {KEYS_SQL}{_IDF}, {_CANDIDATES},
shared_v AS (SELECT domain FROM place_v WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) > 1 UNION SELECT domain FROM supplier_v WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
nt AS (SELECT id, token, idf AS w FROM (SELECT id, unnest(name_set) AS token FROM key_v) JOIN name_idf USING (token) WHERE NOT is_generic),
ads AS (SELECT id, token, ln((n + 1) / (1 + coalesce(df, 0))) AS w FROM (SELECT id, unnest(address_set) AS token FROM key_v) LEFT JOIN addr_df USING (token), n_v),
ntot AS (SELECT id, sum(w) AS w, count(*) AS c FROM nt GROUP BY id), atot AS (SELECT id, sum(w) AS w FROM ads GROUP BY id),
nsh AS (SELECT pid, sid, sum(x.w) AS w FROM cand_v JOIN nt x ON x.id = pid JOIN nt y ON y.id = sid AND y.token = x.token GROUP BY 1, 2),
ash AS (SELECT pid, sid, sum(x.w) AS w FROM cand_v JOIN ads x ON x.id = pid JOIN ads y ON y.id = sid AND y.token = x.token GROUP BY 1, 2),
pair_w AS (
  SELECT c.pid, c.sid, p.name_set AS pn, s.name_set AS sn, p.norm_name AS pk, s.norm_name AS sk, p.domain AS pd, s.domain AS sd, p.e164 AS pe, s.e164 AS se,
    coalesce(pt.c, 0) AS pc, coalesce(st.c, 0) AS sc, pt.w AS pw, st.w AS sw, coalesce(nsh.w, 0) AS nw, pa.w AS paw, sa.w AS saw, coalesce(ash.w, 0) AS aw, len(p.address_set) > 0 AND len(s.address_set) > 0 AS streets,
    p.domain IN (SELECT domain FROM shared_v) AS tenant, {_HAVERSINE.format('p.lat', 'p.lng', 's.lat', 's.lng')} AS km
  FROM cand_v c JOIN place_v p ON p.id = c.pid JOIN supplier_v s ON s.id = c.sid LEFT JOIN ntot pt ON pt.id = c.pid LEFT JOIN ntot st ON st.id = c.sid
    LEFT JOIN nsh ON nsh.pid = c.pid AND nsh.sid = c.sid LEFT JOIN ash ON ash.pid = c.pid AND ash.sid = c.sid LEFT JOIN atot pa ON pa.id = c.pid LEFT JOIN atot sa ON sa.id = c.sid
), {_SETS},
sets_w AS (SELECT *, CASE WHEN len(pn) = 0 OR len(sn) = 0 THEN 0 WHEN (pd = sd AND tenant) OR pe = se OR (pc = 0 AND sc = 0) THEN {_TOKEN_SET} END AS tsr FROM both_w),
sim_w AS (
  SELECT *, CASE WHEN len(pn) = 0 OR len(sn) = 0 THEN NULL WHEN pc > 0 AND sc > 0 THEN CASE WHEN pw = 0 OR sw = 0 THEN 0 ELSE least({d(1)}, 2 * nw / (pw + sw)) END
      WHEN pc = 0 AND sc = 0 THEN least({d(0.4)}, tsr) ELSE {d(0.2)} END AS name_sim,
    {_NEAR.format('km')} AS geo_sim, CASE WHEN streets THEN CASE WHEN paw = 0 OR saw = 0 THEN 0 ELSE least({d(1)}, 2 * aw / (paw + saw)) END END AS addr_sim,
    CASE WHEN pd = sd AND NOT tenant THEN 1 WHEN pd = sd AND tsr >= {d(0.7)} THEN 2 WHEN pe = se AND tsr >= {d(0.7)} THEN 3 WHEN pk <> '' AND pk = sk AND km <= {d(0.2)} THEN 4 END AS hard
  FROM sets_w
), raw_w AS (
  SELECT *, (coalesce(name_sim, 0) * {d(0.65)} + geo_sim * {d(0.2)} + coalesce(addr_sim, 0) * {d(0.15)}) / (CASE WHEN name_sim IS NULL THEN 0 ELSE {d(0.65)} END + {d(0.2)} + CASE WHEN addr_sim IS NULL THEN 0 ELSE {d(0.15)} END)
    - CASE WHEN pd <> sd THEN {d(0.2)} ELSE 0 END - CASE WHEN pe <> se THEN {d(0.12)} ELSE 0 END AS raw FROM sim_w
), score_w AS (SELECT *, greatest(0, least(1, CASE WHEN coalesce(name_sim, 0) < {d(0.45)} AND raw > {d(0.35)} THEN {d(0.35)} ELSE raw END)) AS score FROM raw_w),
best_w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY coalesce(hard, 9), score DESC, sid) AS rk FROM score_w) WHERE rk = 1),
decided_v AS (
  SELECT p.id AS place_id, sid AS best_supplier, score AS best_score, hard, sid IS NULL AS nobody,
    CASE WHEN sid IS NULL THEN 'net_new' WHEN hard IS NOT NULL OR score >= {d(0.8)} THEN 'existing' WHEN score <= {d(0.65)} THEN 'net_new' ELSE 'needs_review' END AS verdict,
    CASE WHEN sid IS NULL OR hard IS NOT NULL THEN 'hard_key' ELSE 'fuzzy_score' END AS decided_by
  FROM place_v p LEFT JOIN best_w ON pid = p.id
), truth_v AS (SELECT p.id AS place_id, min(s.id) AS true_supplier FROM place_v p JOIN supplier_v s ON p.norm_name = s.norm_name AND p.norm_name <> '' GROUP BY 1)"""
_OUTCOME = """CASE WHEN verdict = 'needs_review' THEN 'review' WHEN verdict = 'existing' AND true_supplier IS NULL THEN 'fp' WHEN verdict = 'existing' AND best_supplier = true_supplier THEN 'tp'
  WHEN verdict = 'existing' THEN 'wrong' WHEN true_supplier IS NULL THEN 'tn' ELSE 'fn' END"""
_COUNTS = ", ".join(f"count(*) FILTER (o = '{k}') AS {k}" for k in ("tp", "wrong", "fp", "fn", "tn", "review"))
_RATES = f"""p AS (SELECT *, CASE WHEN tp + wrong + fp = 0 THEN 1 ELSE tp / {d('tp + wrong + fp')} END AS precision, CASE WHEN tp + wrong + fn = 0 THEN 1 ELSE tp / {d('tp + wrong + fn')} END AS recall FROM c),
r AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, review / {d('tp + wrong + fp + fn + tn + review')} AS review_rate FROM p)"""
_GRID = f"""g AS (SELECT row_number() OVER (ORDER BY h, l) AS seq, {d('h')} AS high, {d('l')} AS low FROM (VALUES (0.76), (0.80), (0.84), (0.88), (0.90), (0.94)) a(h), (VALUES (0.55), (0.60), (0.65), (0.70), (0.75)) b(l) WHERE h > l),
j AS (SELECT seq, high, low, best_supplier, true_supplier, CASE WHEN decided_by = 'hard_key' THEN verdict WHEN best_score >= high THEN 'existing' WHEN best_score <= low THEN 'net_new' ELSE 'needs_review' END AS verdict
  FROM decided_v LEFT JOIN truth_v USING (place_id), g),
c AS (SELECT seq, high, low, {_COUNTS} FROM (SELECT *, {_OUTCOME} AS o FROM j) GROUP BY seq, high, low)"""

SQL = {
    "match_verdicts": f"""{MATCH_SQL} SELECT place_id, CASE WHEN verdict <> 'net_new' THEN best_supplier END AS supplier_id, verdict, CASE WHEN nobody THEN 0 WHEN hard IS NOT NULL THEN 1 ELSE round(best_score, 4) END AS score,
  round(CASE WHEN nobody THEN {d(0.95)} WHEN hard IS NOT NULL THEN {d(0.97)} WHEN verdict = 'existing' THEN least(1, {d(0.5)} + (best_score - {d(0.8)}) * 2) WHEN verdict = 'net_new' THEN least(1, {d(0.5)} + ({d(0.65)} - best_score) * 2)
    ELSE {d(0.5)} * (1 - abs(best_score - ({d(0.8)} + {d(0.65)}) / 2) / (({d(0.8)} - {d(0.65)}) / 2)) END, 3) AS confidence, decided_by,
  CASE WHEN nobody THEN 'no candidates' WHEN hard IS NULL THEN 'score' ELSE 'exact ' || (['domain', 'domain and name', 'phone and name', 'name and premises'])[hard] END AS signal FROM decided_v""",
    "token_lcs_ratio": f"WITH t AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token FROM part UNION SELECT lower(n_name) FROM nation) SELECT a, b, round({d(200)} * ({lcs('a', 'b')}) / (length(a) + length(b)), 6) AS ratio FROM (SELECT x.token AS a, y.token AS b FROM t x JOIN t y ON x.token < y.token)",
    "confusion": f"{MATCH_SQL}, c AS (SELECT {_COUNTS} FROM (SELECT *, {_OUTCOME} AS o FROM decided_v LEFT JOIN truth_v USING (place_id))), {_RATES} SELECT tp, wrong, fp, fn, tn, review, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(review_rate, 6) AS review_rate, round(1 - review_rate, 6) AS automation_rate FROM r",
    "threshold_sweep": f"{MATCH_SQL}, {_GRID}, {_RATES} SELECT high, low, tp, wrong, fp, fn, tn, review, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(review_rate, 6) AS review_rate FROM r",
    "threshold_grid_cost": f"{MATCH_SQL}, {_GRID}, m AS (SELECT *, review * 3 + fn * 20 + fp * 240 AS minutes FROM c) SELECT 240 AS missed_minutes, high, low, minutes FROM m ORDER BY minutes, seq LIMIT 1",
    "cost_sensitivity": f"{MATCH_SQL}, {_GRID}, m AS (SELECT *, review * 3 + fn * 20 + fp * x AS minutes FROM c, (VALUES (20), (60), (120), (240), (480)) v(x)) SELECT x AS missed_minutes, high, low, minutes FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY minutes, seq) AS rk FROM m) WHERE rk = 1",
    "decisions_by_stage": f"{MATCH_SQL} SELECT verdict || '/' || decided_by AS stage, count(*) AS n FROM decided_v GROUP BY 1",
    "name_key": f"WITH {KEYS_SQL} SELECT id, norm_name, domain, e164, array_to_string(address_set, ' ') AS address_words, cell_lat, cell_lng FROM key_v",
    "idf": f"WITH {KEYS_SQL}{_IDF} SELECT token, df, round(idf, 6) AS idf, is_generic FROM name_idf",
    "generic_tokens": "WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part) SELECT token, count(*) AS df FROM t GROUP BY token HAVING count(*) >= 3 AND count(*) / (SELECT count(*) FROM part) > CAST(0.1 AS DOUBLE)",
    "shared_domains": f"WITH {KEYS_SQL} SELECT domain FROM place_v WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) > 1 UNION SELECT domain FROM supplier_v WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "site_domains": r"WITH h AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages) SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain, count(*) AS pages, count(DISTINCT host) AS hosts FROM h GROUP BY 1",
    "block_candidates": f"WITH {KEYS_SQL}, {_CANDIDATES} SELECT pid AS place_id, sid AS supplier_id FROM cand_v",
    "lead_scores": f"WITH {_LEADS} SELECT id, round(quality, 4) AS quality, round(readiness, 4) AS readiness, round(gap_fit, 4) AS gap_fit, round(composite, 4) AS composite, CASE WHEN composite >= {d(0.55)} THEN 'A' WHEN composite >= {d(0.42)} THEN 'B' ELSE 'C' END AS band FROM scored_v",
    "band_cutoffs": f"WITH {_LEADS} SELECT round(ceiling * {d(0.8)}, 4) AS band_a, round(ceiling * {d(0.55)}, 4) AS band_b, round(ceiling, 4) AS ceiling FROM cut_v",
    "bands": f"WITH {_LEADS} SELECT CASE WHEN round(composite, 4) >= round(ceiling * {d(0.8)}, 4) THEN 'A' WHEN round(composite, 4) >= round(ceiling * {d(0.55)}, 4) THEN 'B' ELSE 'C' END AS band, count(*) AS n FROM scored_v, cut_v GROUP BY 1",
    "category_gaps": f"WITH {_LEADS} SELECT l.category, count(*) AS operators, round(max(greatest(0, least(1, greatest(0, 1 - coalesce(supply, 9) / ({d(0.6)} * coalesce(demand, 25))) * coalesce(demand, 25) / {d(100)}))), 3) AS gap_fit FROM lead_v l LEFT JOIN demand_v v ON v.destination = 'split' AND v.category = l.category GROUP BY 1",
    "rule_classification": f"SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'not_relevant' WHEN 2 THEN 'experience_operator' WHEN 4 THEN 'not_relevant' END AS rule_verdict, CASE p_partkey % 5 WHEN 0 THEN {d(0.95)} WHEN 2 THEN {d(0.9)} WHEN 4 THEN {d(0.95)} END AS rule_confidence, CASE p_partkey % 5 WHEN 0 THEN 'listed as atm' WHEN 2 THEN 'listed as tour_agency' WHEN 4 THEN 'listed as school' END AS rule_reason FROM part",
    "stratified_sample": """WITH i AS (SELECT p_partkey AS id, CASE WHEN p_size < 3 THEN 'unmapped' ELSE p_type END AS tier FROM part),
s AS (SELECT tier, count(*) AS n, min(id) AS f FROM i GROUP BY tier), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) = 1 AS dom FROM s),
w AS (SELECT *, CASE WHEN dom THEN 0 WHEN tier = 'unmapped' THEN least(3, n) ELSE n END AS want FROM t),
b AS (SELECT *, coalesce(sum(want) OVER (ORDER BY n, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(want) OVER () AS every FROM w),
k AS (SELECT tier, CASE WHEN dom THEN 1200 - least(1200, every) ELSE greatest(0, least(want, 1200 - bef)) END AS take FROM b),
r AS (SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY id) AS rk FROM i)
SELECT id, tier FROM r JOIN k USING (tier) WHERE rk <= take""",
    "nearest_rank_quantiles": "WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), p(p) AS (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) SELECT p, v AS value FROM p JOIN o ON i = least(n - 1, floor(p * n))",
    "first_wins": "SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "distance": f"WITH {KEYS_SQL}, k AS (SELECT id, {_HAVERSINE.format('lat', 'lng', d(43.5081), d(16.4402))} AS km FROM key_v) SELECT id, round(km, 4) AS km, round({_NEAR.format('km / 100')}, 4) AS near FROM k",
    "point_in_region": _region(),
    "html_text": f"SELECT page_id, sha256({_TEXT}) AS text_sha256 FROM pages",
    "site_text_cap": f"WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, html FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM h), t AS (SELECT host, n, {_TEXT} AS text FROM r WHERE n <= 3), j AS (SELECT host, count(*) AS n_pages, substr(string_agg(text, chr(10) || chr(10) ORDER BY n), 1, 12000) AS text FROM t WHERE text <> '' GROUP BY host) SELECT host, n_pages, length(text) AS n_chars, sha256(text) AS text_sha256 FROM j",
    "rate_limited": "WITH a AS (SELECT e.event_id AS id, (SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND (x.ts < e.ts AND x.ts > e.ts - INTERVAL 6 HOUR OR x.ts = e.ts AND x.event_id < e.event_id)) AS earlier FROM events e) SELECT id, earlier, earlier >= 2 AS limited FROM a",
    "api_cost": f"SELECT sku, count(*) AS calls, round(count(*) * {d('rate')} / 1000, 4) AS usd, round(greatest(0, count(*) - free) * {d('rate')} / 1000, 4) AS usd_after_free FROM events JOIN {_SKUS} ON user_id % 5 = k GROUP BY sku, rate, free",
    "token_cost": f"WITH m(model, ri, ro) AS (VALUES ('click', {d(3)}, {d(15)}), ('view', {d(1)}, {d(5)}), ('signup', {d(3)}, {d(15)}), ('purchase', {d(0.25)}, {d(1.25)})), t AS (SELECT event_type AS model, count(*) AS calls, sum(event_id % 997) AS i, sum(event_id % 89) AS o, sum(event_id % 13) AS w, sum(event_id % 211) AS r, bool_or(event_id % 5000 = 4999) AS b FROM events GROUP BY 1) SELECT model, calls, round(CASE WHEN b THEN {d(0.5)} ELSE {d(1)} END * ((i * ri + w * ri * {d(1.25)} + r * ri * {d(0.1)} + o * ro) / {d(1000000)}), 6) AS usd, round(r / {d('i + w + r')}, 3) AS cache_hit_rate FROM t LEFT JOIN m USING (model)",
    "sweep_estimate": f"WITH s AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7 % 400 + 1 AS INTEGER) AS cells, CAST(s_nationkey % 5 + 1 AS INTEGER) AS queries FROM supplier), c AS (SELECT *, CAST(trunc(cells * queries * {d(1.8)}) AS INTEGER) AS calls FROM s), m AS (SELECT *, CAST(trunc(calls * {d(1.6)}) AS INTEGER) AS calls_max FROM c), u AS (SELECT *, calls * {d(35)} / 1000 AS usd0, calls_max * {d(35)} / 1000 + calls_max * {d(10.75)} * {d(0.0012)} AS usd1 FROM m) SELECT id, cells, queries, calls, calls_max, {_cents('usd0')} AS usd, {_cents('usd1')} AS usd_max, {_cents(f'usd0 * {d(0.78)}')} AS gbp, {_cents(f'usd1 * {d(0.78)}')} AS gbp_max, CAST(trunc(calls * {d(0.35)} + calls * {d(10.75)} * {d(0.12)}) AS INTEGER) AS seconds, CAST(trunc(calls_max * {d(0.35)} + calls_max * {d(10.75)} * {d(0.12)}) AS INTEGER) AS seconds_max FROM u",
    "at_scale": f"WITH o AS (SELECT sum(event_id % 1000) / {d(1000000)} AS one FROM events), n(destinations) AS (VALUES (1), (10), (50), (200), (500)) SELECT destinations, round(one * destinations, 4) AS usd, round(one * destinations * {d(0.78)}, 4) AS gbp, round(destinations * {d(240)}, 2) AS manual_gbp, round(destinations * {d(240)} / (one * destinations * {d(0.78)}), 1) AS ratio FROM o, n",
    "taxonomy_prefixes": f"WITH {_TAX} SELECT array_to_string(parts, '/') AS path, parts[-1] AS name, CAST(len(parts) AS INTEGER) AS tier, CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], '/') END AS parent FROM node_v",
    "taxonomy_coverage": f"WITH {_TAX}, u AS (SELECT DISTINCT parts[1:i] AS parts FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM path_v WHERE p_size = 7)) SELECT CAST(len(n.parts) AS INTEGER) AS tier, count(*) AS nodes, count(u.parts) AS mapped FROM node_v n LEFT JOIN u ON n.parts = u.parts GROUP BY 1",
    "warehouse_rows": f"WITH {_LEADS} SELECT '20260102T030405Z' AS run_id, '2026-01-02' AS run_date, destination, CAST(id AS VARCHAR) AS place_source_id, round(composite, 4) AS composite, CASE WHEN composite >= {d(0.55)} THEN 'A' WHEN composite >= {d(0.42)} THEN 'B' ELSE 'C' END AS band, CASE WHEN NOT extracted THEN '' ELSE (['en', 'en,hr', 'en,hr,de'])[languages] END AS languages FROM scored_v",
    "shared_phones": f"WITH {KEYS_SQL} SELECT e164, count(*) AS n FROM key_v WHERE e164 IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
