"""Session helpers: table loading and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: list[str] = []
_written: list[DataFrame] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one Parquet table through Spark, so any store that Spark reaches works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where it is unset and Spark runs in one process, as in local tests, a local temporary folder
    takes its place and is removed when the process ends. On a cluster that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="lexiloom-"))
        atexit.register(shutil.rmtree, _local_scratch[0], ignore_errors=True)
    return f"file://{_local_scratch[0]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and rereads it.

    It cuts the lineage like ``checkpoint()``, but computes the rows once; a lost executor only
    costs a reread. Results read these tables lazily, so they stay until :func:`discard`,
    :func:`release` or the end of the process.
    """
    path = f"{scratch_dir(df.sparkSession)}/lexiloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    _written.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_lexiloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
        _written[:] = [t for t in _written if t._lexiloom_path != path]


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this session, once its results have been written."""
    for df in [t for t in _written if t.sparkSession is spark]:
        discard(df)


def _at_end() -> None:
    """Tables that are left when the process ends are of no use to any other."""
    with contextlib.suppress(Exception):  # the session may be gone by then
        for df in list(_written):
            if df.sparkSession._jsc.sc().isStopped():
                break
            discard(df)


atexit.register(_at_end)
