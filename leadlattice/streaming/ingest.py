"""Places as a stream: each one once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadlattice.sources.files import PLACE


def read_place_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PLACE).json(path)


def once(places: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of each source_id within the time that late rows may take; state older than that is dropped."""
    return places.withWatermark("discovered_at", late).dropDuplicatesWithinWatermark(["source_id"])
