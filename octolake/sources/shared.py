"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables of this process that :func:`cut` wrote and :func:`drop` didn't delete yet.
_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it names none, a local one is made if all runs in this process (tests).

    On a cluster each executor would write to a disk of its own, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="octolake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it.

    The result has no lineage, so losing an executor costs a re-read of files and nothing else. Results are lazy, so
    files stay until :func:`drop`, :func:`drop_all` or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/octolake-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(drop_all)
    _WRITTEN[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._octolake_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.pop(path, None)


def drop(df: DataFrame | None) -> None:
    """Delete the files behind a DataFrame made by :func:`cut`; other DataFrames are left alone."""
    path = getattr(df, "_octolake_path", None)
    if path:
        _delete(df.sparkSession, path)


def drop_all() -> None:
    """Delete all tables that :func:`cut` wrote and nothing deleted; what was not collected or saved before is lost."""
    for path, spark in list(_WRITTEN.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its files are the cluster's to clear
            _WRITTEN.pop(path, None)
