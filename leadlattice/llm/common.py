"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of every operator that counts or shingles words: maximal runs without these white space bytes.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets its own, and a cluster an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="leadlattice-")
    return _OWN_DIR[app]


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # the session may have ended before the interpreter
            _remove(spark, path)


def own_dir(spark: SparkSession) -> str:
    """A new folder in the shared one, removed when the interpreter ends, or by `released`."""
    path = f"{shared_dir(spark)}/leadlattice-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def released(path: str) -> None:
    """Removes a folder of `own_dir`, or one in it, that nothing will read again."""
    spark = next(s for s, p in _WRITTEN if path.startswith(p))
    _remove(spark, path)
    _WRITTEN[:] = [(s, p) for s, p in _WRITTEN if p != path]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, out: str, ties: Sequence[str] = (), chunks: int = 2048) -> DataFrame:
    """Adds `out`, the exclusive running sum of a whole-number weight within each key, without gathering a key in one task.

    The order is (hash of the order columns, order columns), one of many fixed ones. Rows are chunked by the
    hash, chunk totals are summed per key, and only rows of one chunk are sorted together. A key may hold
    any share of the rows. Rows equal in all order columns are interchangeable: `ties` put them in some order.
    """
    d = df.withColumn("_w", weight.cast("long")).withColumn("_chunk", F.pmod(F.xxhash64(*order, F.lit(17)), F.lit(chunks)).cast("int"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        d.groupBy(*keys, "_chunk").agg(F.sum("_w").alias("_total"))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"), F.coalesce(F.sum("_total").over(by_chunk), F.lit(0)).alias("_base"))
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn(out, F.coalesce(F.sum("_w").over(within), F.lit(0)))
    cond = [placed[k].eqNullSafe(base[f"_k_{k}"]) for k in keys] + [placed["_chunk"] == base["_k_chunk"]]
    return placed.join(base, cond).withColumn(out, F.col(out) + F.col("_base")).drop("_w", "_chunk", "_base", "_k_chunk", *[f"_k_{k}" for k in keys])


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; a written table that Spark joins as it sees fit otherwise."""
    df = materialize(df, "small")
    return F.broadcast(df) if df.count() <= most else df
