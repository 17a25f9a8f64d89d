"""Relations that queries run on, made from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlattice import staging
from leadlattice.operators import linkage

#: A name's words, made from a digest of a whole text: two that very many names have, one that some have, and one that few have.
_WORDS = """concat(element_at(array('Adria', 'Blue', 'Kayak', 'Otok', 'Sunčani', 'Val', 'Charter', 'Vela'), cast(cast(conv(substring(h, 1, 1), 16, 10) as int) div 2 + 1 as int)), ' ',
  translate(substring(h, 2, 2), '0123456789abcdef', 'aborumitenčlšgdv'), 'ić ', translate(substring(h, 4, 3), '0123456789abcdef', 'aborumitenklsgdv'), 'a ', translate(substring(h, 7, 6), '0123456789abcdef', 'aborumitenklsgdv'))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A business listing for every document: a name from its whole text, alike for equal texts, and contact data from arithmetic on its id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h")).selectExpr("doc_id", f"{_WORDS} as words")
    return d.selectExpr(
        "doc_id as id",
        "case doc_id % 5 when 0 then concat(words, ' d.o.o.') when 1 then concat('Obrt ', words) when 2 then concat(words, ' Tours') else words end as name",
        """case when doc_id % 3 = 0 then null when doc_id % 11 = 0 then concat('https://op', (doc_id div 4) % 90, '.wixsite.com/x')
           when doc_id % 13 = 0 then 'https://www.facebook.com/page' else concat('http://www.biz', ((doc_id div 2) * 7) % 300, '.hr/en') end as website""",
        "case when doc_id % 4 = 3 then null else concat('021 345 ', lpad(cast(((doc_id div 2) * 37) % 1000 as string), 3, '0')) end as phone",
        """concat('Ulica ', element_at(split(concat(words, ' x'), ' '), 1), ' ', doc_id % 90 + 1, ', 21000 ',
           element_at(array('Split', 'Zadar', 'Pula', 'Zagreb', 'Hvar', 'Omis'), cast(doc_id % 6 + 1 as int)), ', Croatia') as address""",
        "cast(43.40 as double) + ((doc_id div 2) * 37 % 1000) / 50.0d as lat",
        "cast(16.30 as double) + ((doc_id div 2) * 91 % 1000) / 40.0d as lng",
    )


_PLANS: dict[tuple, DataFrame] = {}


def linked(spark: SparkSession, sf_dir: str, fuzzy: bool = False) -> DataFrame:
    """Decisions about every place. Many queries read them, so the plan is made once for each session and folder. Runners-up are told by the fuzzy ones alone."""
    key = (spark.sparkContext.applicationId, sf_dir, fuzzy)
    if key not in _PLANS:
        _PLANS[key] = linkage.link(places(spark, sf_dir), suppliers(spark, sf_dir), fuzzy=fuzzy, runner_up=fuzzy)
    return _PLANS[key]


#: The lowest limit of a verdict in any query: scores that are not above it are all of one verdict.
LEAST_LOW = 0.55


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as `linked` has them, but for scores up to LEAST_LOW, which are 0, with or without candidates: what is asked is on which side of limits they lie, and who was matched."""
    key, whole = (spark.sparkContext.applicationId, sf_dir, LEAST_LOW), (spark.sparkContext.applicationId, sf_dir, False)
    if key not in _PLANS and whole not in _PLANS:
        _PLANS[key] = linkage.link(places(spark, sf_dir), suppliers(spark, sf_dir), fuzzy=False, runner_up=False, above=LEAST_LOW)
    return _PLANS.get(key, _PLANS.get(whole))


def forget() -> None:
    """Lets go of plans that were kept, and of what was written for them."""
    _PLANS.clear()
    staging.release()


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, true_supplier): the first supplier of the same name."""
    p, s = (linkage.with_keys(x).where("norm_name <> ''") for x in (places(spark, sf_dir), suppliers(spark, sf_dir)))
    return p.join(s.groupBy("norm_name").agg(F.min("id").alias("true_supplier")), "norm_name").select(F.col("id").alias("place_id"), "true_supplier")


def finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered places with a classifier's answer and what was read on their websites, one for each part, by arithmetic on its key."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", "p_name as name",
        "case when p_partkey % 9 = 0 then null else concat('Riva ', p_partkey % 50 + 1, ', 21000 ', element_at(array('Split', 'Zadar', 'Šibenik', 'Omiš', 'Korčula', 'Nowhere'), cast(p_partkey % 6 + 1 as int)), case when p_partkey % 2 = 0 then concat(', ', element_at(array('Split', 'Zadar', 'Šibenik', 'Omiš', 'Korčula', 'Nowhere'), cast(p_partkey % 6 + 1 as int))) else '' end, ', Croatia') end as address",
        "case when p_partkey % 4 = 0 then null else '021' end as phone", "case when p_partkey % 3 = 0 then null when p_partkey % 21 = 1 then '' else concat('https://www.s', p_partkey, '.hr') end as website",
        "case when p_partkey % 17 = 0 then null else p_size / 10.0d end as rating", "case when p_partkey % 13 = 0 then null else p_partkey % 500 end as review_count",
        "element_at(array(array('parking', 'atm'), array('bar', 'bank'), array('tour_agency', 'point_of_interest'), array('museum'), array('tour_agency', 'school')), cast(p_partkey % 5 + 1 as int)) as types",
        "element_at(array('boat tour', 'Excursion', 'wine tasting', 'walking tour', 'things to do', 'unknown', null), cast(p_partkey % 7 + 1 as int)) as query",
        "element_at(array('boat_tour', 'Other', 'none', null, 'Food_Drink', 'unclear', 'cultural', 'adventure'), cast(p_partkey % 8 + 1 as int)) as answer",
        "case when p_partkey % 10 < 6 then 'experience_operator' when p_partkey % 10 < 8 then 'not_relevant' else 'attraction_only' end as verdict", "case when p_partkey % 4 = 0 then 'model' else 'rule' end as decided_by",
        """case when p_partkey % 5 = 0 then null else named_struct('booking', element_at(array('online_booking', 'enquiry_form', 'phone_or_email_only', 'unclear'), cast(p_partkey % 4 + 1 as int)),
          'languages', slice(array('en', 'hr', '', 'de'), 1, cast(p_partkey % 5 as int)), 'contact_email', case when p_partkey % 2 = 0 then 'a@b.hr' end,
          'product_categories', case p_partkey % 6 when 0 then array('food_drink', 'other', 'adventure') when 1 then array('none') else array() end,
          'marketplace_presence', case p_partkey % 7 when 0 then array('Viator.com', 'GetYourGuide') when 1 then array('TRIPADVISOR') else array() end) end as extract""",
    )


def model_rates(spark: SparkSession) -> DataFrame:
    """USD per million tokens in and out, by model; one model of the usage has no rate."""
    return spark.createDataFrame([("click", 3.0, 15.0), ("view", 1.0, 5.0), ("signup", 3.0, 15.0), ("purchase", 0.25, 1.25)], "model string, usd_in double, usd_out double")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).where("id % 2 = 0")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).where("id % 2 = 1")


#: The same, as common table expressions.
LISTINGS_SQL = r"""
words_v AS (
  SELECT doc_id, (['Adria', 'Blue', 'Kayak', 'Otok', 'Sunčani', 'Val', 'Charter', 'Vela'])[CAST('0x' || substr(h, 1, 1) AS INTEGER) // 2 + 1] || ' ' || translate(substr(h, 2, 2), '0123456789abcdef', 'aborumitenčlšgdv') || 'ić '
    || translate(substr(h, 4, 3), '0123456789abcdef', 'aborumitenklsgdv') || 'a ' || translate(substr(h, 7, 6), '0123456789abcdef', 'aborumitenklsgdv') AS words FROM (SELECT doc_id, md5(text) AS h FROM documents)
), listing_v AS (
  SELECT doc_id AS id,
    CASE doc_id % 5 WHEN 0 THEN words || ' d.o.o.' WHEN 1 THEN 'Obrt ' || words WHEN 2 THEN words || ' Tours' ELSE words END AS name,
    CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'https://op' || ((doc_id // 4) % 90) || '.wixsite.com/x'
      WHEN doc_id % 13 = 0 THEN 'https://www.facebook.com/page' ELSE 'http://www.biz' || (((doc_id // 2) * 7) % 300) || '.hr/en' END AS website,
    CASE WHEN doc_id % 4 = 3 THEN NULL ELSE '021 345 ' || lpad(CAST(((doc_id // 2) * 37) % 1000 AS VARCHAR), 3, '0') END AS phone,
    'Ulica ' || string_split(words || ' x', ' ')[1] || ' ' || (doc_id % 90 + 1) || ', 21000 ' ||
      (['Split', 'Zadar', 'Pula', 'Zagreb', 'Hvar', 'Omis'])[doc_id % 6 + 1] || ', Croatia' AS address,
    CAST(43.40 AS DOUBLE) + CAST((doc_id // 2) * 37 % 1000 AS DOUBLE) / CAST(50 AS DOUBLE) AS lat,
    CAST(16.30 AS DOUBLE) + CAST((doc_id // 2) * 91 % 1000 AS DOUBLE) / CAST(40 AS DOUBLE) AS lng
  FROM words_v
)"""

#: Fixed value: the closed lists that the SQL versions of keys need.
_FORMS, _HEADS = "('jdoo','doo','dd','jtd','kd','td','obrt','ustanova','zadruga')", "('jdoo','doo','dd','jtd','kd','td','obrt','ustanova','zadruga','vl','vlasnik')"
_STOP = "('tours','tour','travel','agency','agencija','putnicka','turizam','turisticka','excursions','izleti','adventure','adventures','experience','experiences','croatia','hrvatska','dmc')"
_KEY = r"lower(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g'))"

#: Keys of every listing, by other means than the Spark version: list functions over runs of tokens.
KEYS_SQL = (
    LISTINGS_SQL
    + rf""", tok_v AS (
  SELECT *, list_filter(string_split_regex(translate(coalesce(name, ''), 'čćđšžČĆĐŠŽ', 'ccdszCCDSZ'), '\s+'), lambda t: t <> '') AS raw FROM listing_v
), head_v AS (
  SELECT *, list_position(list_transform(raw, lambda t: {_KEY} IN {_HEADS}), false) AS head FROM tok_v
), cut_v AS (
  SELECT *, CASE WHEN coalesce(head, 0) = 0 THEN [] ELSE raw[head:] END AS rest FROM head_v
), tail_v AS (
  SELECT *, list_position(list_transform(list_reverse(rest), lambda t: {_KEY} IN {_FORMS}), false) AS tail FROM cut_v
), name_v AS (
  SELECT *, list_filter(list_transform(CASE WHEN coalesce(tail, 0) = 0 THEN [] ELSE rest[1:len(rest) - tail + 1] END,
    lambda t: replace({_KEY}, 'dj', 'd')), lambda t: t <> '' AND t NOT IN {_STOP}) AS name_words FROM tail_v
), key_v AS (
  SELECT id, name, website, phone, address, lat, lng, array_to_string(name_words, ' ') AS norm_name, list_sort(list_distinct(name_words)) AS name_set,
    CASE WHEN website LIKE 'https://op%' THEN regexp_extract(website, '//(op\d+\.wixsite\.com)', 1)
      WHEN website LIKE '%facebook%' THEN NULL ELSE regexp_extract(website, 'www\.(biz\d+\.hr)', 1) END AS domain,
    '+385' || substr(replace(phone, ' ', ''), 2) AS e164,
    list_sort(list_distinct(list_filter(list_transform(string_split_regex(replace(translate(lower(address), 'čćđšžČĆĐŠŽ', 'ccdszCCDSZ'), ',', ' '), '\s+'),
      lambda t: regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda t: length(t) > 2 AND NOT regexp_full_match(t, '\d+')))) AS address_set,
    CAST(trunc(lat / CAST(0.05 AS DOUBLE)) AS INTEGER) AS cell_lat, CAST(trunc(lng / CAST(0.05 AS DOUBLE)) AS INTEGER) AS cell_lng
  FROM name_v
), place_v AS (SELECT * FROM key_v WHERE id % 2 = 0), supplier_v AS (SELECT * FROM key_v WHERE id % 2 = 1)"""
)
