"""A snapshot table in hash buckets: a batch rewrites the buckets it touches and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import scratch_dir, table


class BucketTable:
    """Copy-on-write table of items (item, content_hash, version, removed) below a shared path.

    A batch is written as ``data/epoch=N/bucket=K`` for the buckets that hold its items; the manifest
    ``manifest/epoch=N`` then names the epoch of every bucket, and is what makes a batch visible. So readers
    see whole batches, a batch delivered again changes nothing, and one that broke off is overwritten. The
    newest version of an item wins; at equal versions a removal, then the greatest hash. Removed items stay as
    tombstones, so that an older version that comes late does not bring them back, until :meth:`vacuum`.
    """

    def __init__(self, spark, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def epochs(self) -> list[int]:
        """The epochs that are visible, in order."""
        files, folder = self._files(f"{self.path}/manifest")
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        done = [n for n in names if n.startswith("epoch=") and files.exists(self._files(f"{self.path}/manifest/{n}/_SUCCESS")[1])]
        return sorted(int(n.partition("=")[2]) for n in done)

    def manifest(self) -> dict[int, int]:
        """The epoch that wrote each bucket: as many numbers as there are buckets."""
        done = self.epochs()
        return {r.bucket: r.written for r in self.spark.read.parquet(f"{self.path}/manifest/epoch={done[-1]}").collect()} if done else {}

    def _read(self, buckets) -> DataFrame | None:
        now = self.manifest()
        paths = [f"{self.path}/data/epoch={now[b]}/bucket={b}" for b in buckets if b in now]
        return self.spark.read.parquet(*paths) if paths else None

    def rows(self, tombstones: bool = False) -> DataFrame | None:
        """The snapshot; None before the first batch."""
        found = self._read(range(self.buckets))
        return found if found is None or tombstones else found.where("NOT removed").drop("removed")

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """Takes a batch (item, content_hash, version, removed) in; for ``foreachBatch``."""
        done = self.epochs()
        if done and done[-1] >= epoch:
            return
        bucket = F.pmod(F.xxhash64("item"), F.lit(self.buckets)).cast("int")
        rows = batch.select("item", "content_hash", "version", F.coalesce("removed", F.lit(False)).alias("removed"))
        touched = sorted(r.bucket for r in rows.select(bucket.alias("bucket")).distinct().collect())  # at most as many as buckets
        old, now = self._read(touched), self.manifest()
        if old is not None:
            rows = rows.unionByName(old)
        newest = rows.groupBy("item").agg(F.max(F.struct("version", "removed", "content_hash")).alias("m")).select("item", "m.content_hash", "m.version", "m.removed")
        if touched:
            newest.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/epoch={epoch}")
        now |= dict.fromkeys(touched, epoch)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/epoch={epoch}")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        self.merge(batch, epoch)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what only manifests before the last ``keep`` name. Readers of older ones must be done."""
        done = self.epochs()
        live = set()
        for e in done[-keep:]:
            live |= {(r.written, r.bucket) for r in self.spark.read.parquet(f"{self.path}/manifest/epoch={e}").collect()}
        for e in done[:-keep]:
            files, folder = self._files(f"{self.path}/manifest/epoch={e}")
            files.delete(folder, True)
        files, folder = self._files(f"{self.path}/data")
        for written in files.listStatus(folder) if files.exists(folder) else []:
            e = written.getPath().getName().partition("=")[2]
            for part in files.listStatus(written.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket=") and e.isdigit() and (int(e), int(name.partition("=")[2])) not in live:
                    files.delete(part.getPath(), True)


def q_refresh(spark, sf):
    """Orders as items in three batches: first states, later ones, and removals of every seventh customer's."""
    import uuid

    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderkey").alias("version"), F.lit(False).alias("removed"))
    gone = table(spark, sf, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("item"), F.lit(None).cast("string").alias("content_hash"), F.lit(2**40).alias("version"), F.lit(True).alias("removed"))
    kept = BucketTable(spark, f"{scratch_dir(spark)}/lexiloom-buckets-{uuid.uuid4().hex}", 16)
    for epoch, batch in enumerate((orders.where("version % 3 > 0"), gone, orders.where("version % 3 = 0"))):
        kept.merge(batch, epoch)
    return kept.rows()


QUERIES = {
    "refreshed_snapshot": (q_refresh, "SELECT o_custkey AS item, arg_max(o_orderstatus, o_orderkey) AS content_hash, max(o_orderkey) AS version FROM orders WHERE o_custkey % 7 > 0 GROUP BY 1"),
}
