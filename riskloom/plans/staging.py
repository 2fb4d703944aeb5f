"""Cut lineage with tables written to the folder that all executors share.

A staged table survives the loss of an executor: its files are in the shared
checkpoint folder, not on one machine.  The folder is ``spark.checkpoint.dir``
of the session, or the one given to ``setCheckpointDir``.  Only a session whose
master is local may go without one and then uses a temporary folder; on a
cluster a missing setting is an error.

Staged tables are deleted when the process ends, or at the end of a ``scope``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables of this application."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        given = sc._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {master} need a shared folder for staged tables")
        base = _LOCAL.setdefault("base", "file://" + tempfile.mkdtemp(prefix="riskloom-"))
    return f"{base.rstrip('/')}/riskloom-{sc.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _cleanup_at_exit(spark: SparkSession) -> None:
    key = spark.sparkContext.applicationId
    if key in _LOCAL:
        return
    _LOCAL[key] = "registered"

    def clean() -> None:
        try:
            _delete(spark, shared_dir(spark))
        except Exception:  # the session may be gone already; the folder's owner cleans up then
            pass

    atexit.register(clean)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside when the block ends: for long sessions, once a result is written."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for a staged table."""
    _cleanup_at_exit(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back (lineage is cut)."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
