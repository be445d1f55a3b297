"""Work avoidance: a stage's result is kept under the digest of its name, version, settings and inputs."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame


def identity(name: str, version: str, config: dict, *inputs: str) -> str:
    """Digest of sorted-key JSON; equal inputs and settings give equal identities."""
    return hashlib.sha256(json.dumps({"name": name, "version": version, "config": config, "inputs": inputs}, sort_keys=True).encode()).hexdigest()


def run_steps(df: DataFrame, *steps) -> DataFrame:
    """Applies steps (functions, or (function, *arguments)) in order, as one lazy plan."""
    return reduce(lambda d, s: d.transform(s) if callable(s) else d.transform(s[0], *s[1:]), steps, df)


class StageCache:
    """Parquet tables in a shared folder, one directory an identity; a finished one is never written again."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _done(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def get(self, key: str, build) -> DataFrame:
        """The stage's table, built by ``build()`` unless a finished one exists."""
        path = f"{self.folder}/{key}"
        if not self._done(path):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
