"""Places, registers and sites as files in, leads as files out."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = (
    "source string, source_id string, name string, lat double, lng double, address string, phone string, website string, rating double, review_count long, "
    "categories array<string>, destination_id string, discovered_at timestamp, raw map<string,string>"
)
API_PLACE = (
    "id string, displayName struct<text:string>, location struct<latitude:double,longitude:double>, formattedAddress string, internationalPhoneNumber string, websiteUri string, "
    "rating double, userRatingCount long, types array<string>, businessStatus string"
)
LEAD_COLUMNS = (
    "run_id string, run_at timestamp, run_date date, destination string, place_source_id string, name string, website string, phone string, address string, rating double, review_count long, "
    "band string, composite double, quality double, readiness double, gap_fit double, category string, category_source string, viator_top string, viator_label string, viator_path string, "
    "booking string, languages array<string>, evidence_json string"
)
#: Columns that every warehouse row has.
REQUIRED = ("run_id", "run_at", "run_date", "place_source_id")
#: Listing types that are left out when results are read.
EXCLUDED_TYPES = (
    "parking", "gas_station", "atm", "bank", "hospital", "pharmacy", "supermarket", "convenience_store", "car_repair", "car_wash", "post_office", "school",
    "primary_school", "secondary_school", "university", "police", "fire_station", "cemetery", "storage", "real_estate_agency", "insurance_agency", "dentist", "doctor",
)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLACE).option("multiLine", True).json(path)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Register rows landed as CSV with quoted line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def places_from_results(results: DataFrame, excluded: tuple[str, ...] = EXCLUDED_TYPES) -> DataFrame:
    """Typed places from landed API results (body JSON, query, destination_id): without coordinates, closed for good or of an excluded type they go."""
    r = results.select(F.from_json("body", API_PLACE).alias("p"), "query", "destination_id")
    types = F.array(*[F.lit(t) for t in excluded])
    keep = F.col("p.location.latitude").isNotNull() & F.col("p.location.longitude").isNotNull() & ~F.coalesce(F.arrays_overlap("p.types", types), F.lit(False)) & ~F.col("p.businessStatus").eqNullSafe("CLOSED_PERMANENTLY")
    return r.where(keep).select(
        F.lit("google_places").alias("source"), F.col("p.id").alias("source_id"), F.trim("p.displayName.text").alias("name"), F.col("p.location.latitude").alias("lat"),
        F.col("p.location.longitude").alias("lng"), F.col("p.formattedAddress").alias("address"), F.col("p.internationalPhoneNumber").alias("phone"), F.col("p.websiteUri").alias("website"),
        F.col("p.rating").alias("rating"), F.col("p.userRatingCount").alias("review_count"), F.col("p.types").alias("categories"), "destination_id",
        F.create_map(F.lit("matched_query"), "query", F.lit("business_status"), F.col("p.businessStatus")).alias("raw"),
    )


def lead_rows(leads: DataFrame, run_at: datetime | None = None) -> DataFrame:
    """Flat warehouse rows of scored and decorated leads: axis scores, languages without blanks, evidence as JSON, and the run's id and date in UTC."""
    at = (run_at or datetime.now(UTC)).astimezone(UTC)
    evidence = F.to_json(F.struct(F.col("quality_components").alias("quality"), F.col("readiness_components").alias("readiness"), F.col("gap_components").alias("gap_fit")))
    languages = F.filter(F.coalesce(F.col("extract.languages"), F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False)))
    made = {
        "run_id": F.lit(f"{at:%Y%m%dT%H%M%SZ}"), "run_at": F.lit(at).cast("timestamp"), "run_date": F.lit(at.date()), "place_source_id": F.col("id").cast("string"), "composite": F.round("composite", 4),
        "quality": F.round("quality", 4), "readiness": F.round("readiness", 4), "gap_fit": F.round("gap_fit", 4), "review_count": F.col("review_count").cast("long"), "booking": F.col("extract.booking"),
        "languages": languages, "evidence_json": evidence,
    }
    fields = [f.strip().split(" ", 1) for f in LEAD_COLUMNS.split(", ")]
    # Columns that leads don't have yet are null.
    given = lambda name, kind: F.col(name) if name in leads.columns else F.lit(None)
    return leads.select(*[made.get(name, given(name, kind)).cast(kind).alias(name) for name, kind in fields])


def _schema_at(spark: SparkSession, path: str) -> dict[str, str]:
    """Types by column of what is published at a path, of all its files; none where nothing is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return {}
    return dict(read_leads(spark, path).dtypes)


def append_leads(rows: DataFrame, path: str) -> None:
    """Publishes runs, each a partition of its date and id, clustered by destination and band; new columns join the schema of older files.

    A run that is published again replaces itself, so a rerun adds nothing, and other runs stay as they are. Rows without a required column, a column
    whose type is not that of older files, and a run id of another date are errors; nothing is written then.
    """
    spark = rows.sparkSession
    rejected = rows.where(" or ".join(f"{c} is null" for c in REQUIRED if c in rows.columns)).count()
    if rejected:
        raise ValueError(f"{rejected} rows lack one of {', '.join(REQUIRED)}")
    older, own = _schema_at(spark, path), dict(rows.dtypes)
    clashes = [f"{c} is {own[c]}, not {older[c]}" for c in sorted(own) if c in older and own[c] != older[c]]
    if clashes:
        raise ValueError("; ".join(clashes))
    if older:
        dated = rows.select("run_id", "run_date").distinct()  # a row for each run of this call
        known = read_leads(spark, path).select("run_id", F.col("run_date").alias("other")).distinct()
        moved = dated.join(known, "run_id").where("run_date <> other").count()
        if moved:
            raise ValueError(f"{moved} runs are published under another date")
    out = rows.sortWithinPartitions("run_date", "run_id", "destination", "band").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("run_date", "run_id").parquet(path)


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def csv_field(c: Column) -> Column:
    """A value as a CSV field: quoted where it holds a quote, comma or line break, with quotes doubled; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(line) of each row; arrays are joined by semicolons."""
    kinds = dict(df.dtypes)
    cells = [F.array_join(F.col(c), ";") if kinds[c].startswith("array") else F.col(c) for c in columns or df.columns]
    return df.select(F.concat_ws(",", *[csv_field(c) for c in cells]).alias("line"))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV as spreadsheets read it: a byte order mark and a header in every part, lines that end in carriage return and line feed."""
    columns = columns or df.columns
    header = "\ufeff" + ",".join(columns)

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = [header] * first + batch.column(0).to_pylist()
            first = False
            yield pa.RecordBatch.from_arrays([pa.array([x + "\r" for x in lines], pa.string())], ["value"])

    # The text writer ends each line with a line feed.
    csv_lines(df, columns).mapInArrow(with_header, "value string").write.mode("overwrite").text(path)


def read_last_wins(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON records of which the last of each key counts: classifications and scored leads are landed again and again."""
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return last_wins(d, key, order)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def write_document(parts: dict[str, DataFrame], path: str) -> None:
    """One JSON document a run: each part, such as counts or bands, as an array under its name. Parts are reports; leads and logs are tables of their own."""
    for name, df in parts.items():
        df.withColumn("part", F.lit(name)).select("part", F.to_json(F.struct(*df.columns)).alias("record")).write.mode("append").partitionBy("part").json(path)


def read_document(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A part of a document that write_document wrote; a missing document is an error of Spark's reader."""
    d = spark.read.schema("record string, part string").json(path).where(F.col("part") == name)
    return d.select(F.from_json("record", schema).alias("r")).select("r.*")
