"""Fetched pages as a source: an archive in buckets by host, read by partitions that a filter on host prunes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .tables import stored

#: How an archive is cut, redirects that a fetch follows, and the least status that is a failure.
BUCKETS, PARTS, REDIRECTS, FAILED = 64, 4, 5, 400
FETCHED = "host string, url string, status int, location string, html string"
COLUMNS = [x.split()[0] for x in FETCHED.split(", ")]


def write_archive(pages: DataFrame, path: str) -> None:
    """pages (FETCHED) under path, in folders by a checksum of host; a host with very many pages is in PARTS files of its folder."""
    bucket = (F.crc32(F.coalesce("host", F.lit("")).cast("binary")) % BUCKETS).cast("int")
    rows = pages.select(*COLUMNS).withColumn("bucket", bucket)
    rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("url"), F.lit(PARTS))).write.mode("overwrite").partitionBy("bucket").parquet(path)


class ArchiveFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    """A partition a file; equality with hosts leaves those of their buckets. Rows are read in batches, columns all."""

    def __init__(self, path: str):
        self.path, self.hosts = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            hosts = {f.value} if isinstance(f, EqualTo) and f.attribute == ("host",) else set(f.value) if isinstance(f, In) and f.attribute == ("host",) else None
            if hosts is not None:
                self.hosts = hosts if self.hosts is None else self.hosts & hosts
            # Buckets hold other hosts too, so Spark tests all filters again.
            yield f

    def partitions(self) -> list[ArchiveFile]:
        system, root = pafs.FileSystem.from_uri(self.path)
        wanted = None if self.hosts is None else {f"bucket={zlib.crc32((h or '').encode()) % BUCKETS}" for h in self.hosts}
        files = [x.path for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith(".parquet")]
        return [ArchiveFile(x) for x in sorted(files) if wanted is None or x.rsplit("/", 2)[-2] in wanted]

    def read(self, partition: ArchiveFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # where no file is left, Spark asks once without one
            return
        system, _ = pafs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as file:
            yield from pq.ParquetFile(file).iter_batches(batch_size=256, columns=COLUMNS)


class ArchiveSource(DataSource):
    """spark.read.format("tarnkite_archive").load(path), for archives of write_archive() at a path that pyarrow can open."""

    @classmethod
    def name(cls) -> str:
        return "tarnkite_archive"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive at path, filters pushed down to its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tarnkite_archive").load(path)


def fetched(requests: DataFrame, web: DataFrame, most: int = REDIRECTS) -> DataFrame:
    """What a fetch of each request's url gives: the request with final, redirects, status, ok, html.

    web: an archive, one row for each url. Redirects are followed `most` times;
    status is that of the last answer, null where there was none; ok is for an
    answer below FAILED that leads nowhere further. Redirects are followed on
    narrow rows; html is read once, for what is found at last.
    """
    heads = stored(web.select(F.col("url").alias("final"), "status", "location"), "heads")
    front = requests.select(F.col("url").alias("_url"), F.col("url").alias("final")).distinct()
    done = []
    for k in range(most + 1):
        front = stored(front.join(heads, "final", "left").withColumn("redirects", F.lit(k)), "fetch")
        on = F.col("location").isNotNull() if k < most else F.lit(False)
        done.append(front.where(~on).select("_url", "final", "redirects", "status", "location"))
        front = front.where(on).select("_url", F.col("location").alias("final"))
        if k < most and front.isEmpty():
            break
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)
    ends = ends.withColumn("ok", F.coalesce((F.col("status") < FAILED) & F.col("location").isNull(), F.lit(False))).drop("location")
    ends = ends.join(web.select(F.col("url").alias("final"), "html"), "final", "left")
    return requests.join(ends, requests["url"] == ends["_url"]).drop("_url")
