"""Session helpers: table loading and the shared folder for cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a private one only where none is set (local tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        shared = tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the reliable checkpoint folder and read it from there, so a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it from there.

    Like ``cut``, but compressed and read by column. The files are deleted when Python ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _WRITTEN:
        atexit.register(clear_written, spark)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unwritten(df: DataFrame) -> None:
    """Delete the files of one frame of ``written`` before Python ends; the frame no longer works."""
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in [p for p in _WRITTEN if any(f.endswith(p.rsplit("/", 1)[1]) for f in paths)]:
        _WRITTEN.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_written(spark: SparkSession) -> None:
    """Delete the files of ``written``; frames that read them no longer work."""
    while _WRITTEN:
        path = _WRITTEN.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the shared folder's own clean-up takes over
            return


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_udf(kind: str) -> Callable:
    """A pandas UDF that is made when it is first used, since its type needs a session to be read."""

    def decorate(f: Callable) -> Callable:
        made: list = []

        @wraps(f)
        def call(*columns):
            from pyspark.sql.functions import pandas_udf

            if not made:
                made.append(pandas_udf(f, kind))
            return made[0](*columns)

        return call

    return decorate
