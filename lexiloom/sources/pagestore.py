"""A Python data source over a store of pages: batch reads, and a stream that pages through it by a cursor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lexiloom.session import table

SCHEMA = "page_id long, url string, html string, position long"


@dataclass
class Stretch(InputPartition):
    """Rows [start, end) of a row group; ``first`` is its first row's position in the store."""

    file: str
    group: int
    start: int
    end: int
    first: int


def _open(path: str):
    """(file system, its path) of a local or remote path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Store:
    """The row groups of a Parquet table in order; only footers are read to know them."""

    def __init__(self, options):
        self.path = options["path"]

    def stretches(self, low: int = 0, high: int | None = None) -> list[Stretch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, path = _open(self.path)
        info = files.get_file_info(path)
        names = [path] if info.type == fs.FileType.File else sorted(f.path for f in files.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet"))
        out, at = [], 0
        for name in names:
            footer = pq.ParquetFile(name, filesystem=files).metadata
            for g in range(footer.num_row_groups):
                n = footer.row_group(g).num_rows
                start, end = max(low - at, 0), n if high is None else min(n, high - at)
                if start < end:
                    out.append(Stretch(name, g, start, end, at))
                at += n
        return out

    def size(self) -> int:
        return sum(s.end - s.start for s in self.stretches())

    def read(self, part: Stretch):
        """Record batches of a stretch; one row group is held at a time."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, _ = _open(self.path)
        with pq.ParquetFile(part.file, filesystem=files) as opened:
            rows = opened.read_row_group(part.group, columns=["page_id", "url", "html"]).slice(part.start, part.end - part.start)
        places = pa.array(range(part.first + part.start, part.first + part.end), pa.int64())
        yield from rows.append_column("position", places).to_batches()


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.store = _Store(options)

    def partitions(self) -> list[Stretch]:
        return self.store.stretches()

    def read(self, partition: Stretch) -> Iterator:
        yield from self.store.read(partition)


class _Stream(DataSourceStreamReader):
    """The offset is the cursor: how many pages have been handed on. Each trigger moves it by a page of the listing."""

    def __init__(self, options):
        self.store, self.step, self.cursor = _Store(options), int(options.get("pagesize", 1000)), 0

    def initialOffset(self) -> dict:
        return {"cursor": 0}

    def latestOffset(self) -> dict:
        self.cursor = min(self.store.size(), self.cursor + self.step)
        return {"cursor": self.cursor}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.cursor = max(self.cursor, end["cursor"])  # a restarted query goes on from its checkpoint
        return self.store.stretches(start["cursor"], end["cursor"])

    def read(self, partition: Stretch) -> Iterator:
        yield from self.store.read(partition)

    def commit(self, end: dict) -> None:
        pass


class PageStore(DataSource):
    """Format ``pagestore``: options ``path`` (a Parquet table with page_id, url, html) and ``pagesize``."""

    @classmethod
    def name(cls) -> str:
        return "pagestore"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PageStore)
    return spark.read.format("pagestore").option("path", path).load()


def stream_store(spark: SparkSession, path: str, pagesize: int = 1000) -> DataFrame:
    spark.dataSource.register(PageStore)
    return spark.readStream.format("pagestore").option("path", path).option("pagesize", pagesize).load()


def discovered(pages: DataFrame, known: DataFrame) -> DataFrame:
    """What a connector reports of each page: page_id, url, content_hash, outcome.

    ``known`` is (page_id, content_hash) of the last run. Outcomes: failed (no content), new, unchanged, changed.
    """
    rows = pages.select("page_id", "url", F.when(F.length("html") > 0, F.sha2("html", 256)).alias("content_hash"))
    last = known.select(F.col("page_id").alias("k_id"), F.col("content_hash").alias("k_hash"))
    outcome = F.when(F.col("content_hash").isNull(), "failed").when(F.col("k_id").isNull(), "new").when(F.col("k_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
    return rows.join(last, F.col("page_id") == F.col("k_id"), "left").withColumn("outcome", outcome).select("page_id", "url", "content_hash", "outcome")


def q_connector(spark, sf):
    """The pages through the data source, against a last run that knew another text of every third and nothing of every fifth."""
    known = table(spark, sf, "pages").where("page_id % 5 > 0").select("page_id", F.sha2(F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("."))).otherwise(F.col("html")), 256).alias("content_hash"))
    return discovered(open_store(spark, f"{sf}/pages.parquet"), known)


QUERIES = {
    "connector_items": (
        q_connector,
        "SELECT page_id, url, sha256(html) AS content_hash, CASE WHEN html = '' THEN 'failed' WHEN page_id % 5 = 0 THEN 'new' WHEN page_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome FROM pages",
    ),
}
