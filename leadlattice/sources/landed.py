"""What a connector has landed: attempts at paid calls, pages of results, registers, sites. Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Results of a page and of a search at most.
PAGE_SIZE, RESULT_CAP = 20, 60


def ledger(attempts: DataFrame, sku: str = "places.text_search.enterprise") -> DataFrame:
    """(sku, n): every attempt is billed, those that failed and were tried again as well."""
    return attempts.groupBy(F.lit(sku).alias("sku")).agg(F.count(F.lit(1)).alias("n"))


def answered(attempts: DataFrame, most: int = 4) -> DataFrame:
    """The first good answer to each request of (cell, query, page, attempt, status, body) within `most` attempts; errors other than 429 and 5xx end a request.

    The first attempt that ends a request decides, as an aggregate.
    """
    final = ~((F.col("status") == 429) | F.col("status").between(500, 599))
    ends = attempts.where(final & (F.col("attempt") <= most)).groupBy("cell", "query", "page").agg(F.min_by(F.struct("status", "body"), "attempt").alias("a"))
    return ends.where("a.status = 200").select("cell", "query", "page", "a.body")


def unanswered(attempts: DataFrame, most: int = 4) -> DataFrame:
    """(cell, query, page, status) of requests without a good answer, with the last status."""
    last = attempts.groupBy("cell", "query", "page").agg(F.max_by("status", "attempt").alias("status"))
    return last.join(answered(attempts, most).select("cell", "query", "page"), ["cell", "query", "page"], "left_anti")


def search_results(pages: DataFrame, cap: int = RESULT_CAP) -> DataFrame:
    """(cell, query, page, at, body) of every place of answered pages (a JSON array of places under `places`), at most `cap` of a search, in order."""
    each = pages.select("cell", "query", "page", F.posexplode(F.from_json(F.get_json_object("body", "$.places"), "array<string>")).alias("at", "body"))
    order = Window.partitionBy("cell", "query").orderBy("page", "at")
    return each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def search_counts(pages: DataFrame, cap: int = RESULT_CAP) -> DataFrame:
    """(cell, query, calls, raw_count, truncated) of each search. Whether it is cut off is told by all results, before any filter."""
    n = F.coalesce(F.json_array_length(F.get_json_object("body", "$.places")), F.lit(0))
    d = pages.groupBy("cell", "query").agg(F.count(F.lit(1)).alias("calls"), F.sum(n).cast("long").alias("found"))
    return d.select("cell", "query", "calls", F.least("found", F.lit(cap).cast("long")).alias("raw_count"), (F.col("found") >= cap).alias("truncated"))


def newest_file(index: DataFrame, pattern: str = '(?i)href="([^"]*?\\d{6}_[^"]*\\.xlsx[^"]*)"') -> DataFrame:
    """(url, stamp): of the links in pages (html) that name a file with a date of six digits, the one of the latest date; no row without one."""
    links = index.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("url"))
    stamped = links.withColumn("stamp", F.regexp_extract("url", "(\\d{6})_[^/]*$", 1)).where("stamp <> ''")
    return stamped.agg(F.max_by("url", F.struct("stamp", "url")).alias("url"), F.max("stamp").alias("stamp")).where("url is not null")


def cache_key(c: str) -> Column:
    """The key under which a site or file is landed."""
    return F.substring(F.sha2(c, 256), 1, 20)


def not_landed(wanted: DataFrame, url: str, landed: DataFrame) -> DataFrame:
    """Rows of wanted whose URL has no key among landed (key) yet."""
    return wanted.withColumn("key", cache_key(url)).join(landed.select("key"), "key", "left_anti")


class Searches(DataSource):
    """Landed searches as a source: spark.read.format("landed_searches").option("path", folder).load(). Each file of a cell and query is a partition.

    A connector implements the same schema and yields what it fetches; its retries belong inside the reader, since a task
    that Spark runs again would be billed twice.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_searches"

    def schema(self) -> str:
        return "cell string, query string, page int, attempt int, status int, body string"

    def reader(self, schema: StructType) -> SearchesReader:
        return SearchesReader(self.options.get("path", ""))


class OneFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SearchesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import pathlib

        return [OneFile(str(p)) for p in sorted(pathlib.Path(self.path).glob("*.jsonl"))]

    def read(self, partition: OneFile):  # noqa: ANN201
        import json

        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                r = json.loads(line)
                yield (r["cell"], r["query"], r["page"], r["attempt"], r["status"], r.get("body"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Searches)
