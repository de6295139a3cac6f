"""Tables that several later steps read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error elsewhere."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tallyspark.stage.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("tallyspark.stage.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: computed once, lineage cut."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*makers) -> list:
    """What these functions without arguments return, made side by side: jobs that do not wait for each other fill the cores."""
    here = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(makers)) as pool:
        return [x.result() for x in [pool.submit(here(m)) for m in makers]]


def small(df: DataFrame, most: int) -> DataFrame:
    """df (staged) with a broadcast hint if it has at most ``most`` rows; joins shuffle larger ones."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by columns to all shuffle partitions, which are not merged again however few bytes there are:
    for rows that cost much more to work on than to move."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def dealt(df: DataFrame, rows: int, *by: str, most: int = 250_000) -> DataFrame:
    """df dealt out by columns to as many partitions as leave about ``most`` of ``rows`` in each, so that what a task holds does
    not grow with the table; unchanged where the session's number of partitions does."""
    n = -(-rows // most)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


_sessions: dict = {}


def saved(source: DataFrame, name: str, make, fresh: bool = False):
    """What ``make()`` gives (staged tables), saved for as long as the application runs and the files behind ``source``
    stay as they are (paths, sizes, times of change); ``fresh`` makes it anew."""
    spark = source.sparkSession
    file = source.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct()
    state = file.agg(F.count("*"), F.expr("bit_xor(f)")).first()  # one row
    key = (spark.sparkContext.applicationId, name, *state)
    if fresh or key not in _sessions:
        _sessions[key] = make()
    return _sessions[key]
