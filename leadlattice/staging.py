"""Steps that are written to the shared folder and read again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets one of its own, and a cluster an error."""
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
def release() -> None:
    """Removes all that was staged. Frames that read it can't be used any more; runs by itself at the end."""
    while _WRITTEN:
        with contextlib.suppress(Exception):  # the session may have ended before
            _remove(*_WRITTEN.pop())


def new_dir(spark: SparkSession) -> str:
    """A folder of its own in the shared one, removed at the end."""
    path = f"{shared_dir(spark)}/leadlattice-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores, by keys if there are any, for long work on each of its rows: a small file is read by few tasks, however many rows it has."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: what several steps read is worked out once, its lineage ends, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{new_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
