"""A stored table with a key, into which batches are upserted: only the buckets that a batch touches are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stored

BUCKETS = 64


class BucketedTable:
    """Rows by key at a path, in folders by a hash of the key.

    A row holds, for each column, the last value that was given by the order
    column, and that order in a column beside it; so upserts of one log in any
    cut, and again after a failure, leave the same table. Batches that were
    finished are marked by their numbers and not done twice. New contents of the
    touched buckets are stored before the old ones are replaced.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, order, buckets
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema if f.name not in (key, order)]
        kinds = dict(spark.createDataFrame([], schema).dtypes)
        parts = [f"`{key}` {kinds[key]}", *(f"`{x}` {kinds[x]}, `{x}_at` {kinds[order]}" for x in self.columns), "_bucket int"]
        self.schema = ", ".join(parts)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{path}/{name}")
        self._fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _rows(self) -> DataFrame:
        if not self._fs.exists(self._at("rows")):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def table(self) -> DataFrame:
        """key and columns of all rows."""
        return self._rows().select(self.key, *self.columns)

    def upsert(self, log: DataFrame, batch: int | None = None) -> int:
        """Applies a log (key, order, columns; null: not given); for foreachBatch. Returns how many buckets were written."""
        if batch is not None and self._fs.exists(self._at(f"done/batch={batch}/_SUCCESS")):
            return 0
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        # The latest value of each column inside the batch, with its order: little is left to be merged.
        given = [F.when(F.col(x).isNotNull(), F.col(self.order)) for x in self.columns]
        latest = log.groupBy(self.key).agg(*(y for x, at in zip(self.columns, given, strict=True) for y in (F.max_by(x, at).alias(x), F.max(at).alias(f"{x}_at"))))
        latest = stored(latest.withColumn("_bucket", bucket), "upsert")
        touched = [r["_bucket"] for r in latest.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        old = self._rows().where(F.col("_bucket").isin(touched))
        both = old.unionByName(latest)
        newer = [y for x in self.columns for y in (F.max_by(x, f"{x}_at").alias(x), F.max(f"{x}_at").alias(f"{x}_at"))]
        new = stored(both.groupBy("_bucket", self.key).agg(*newer), "upsert")
        if touched:
            rows = new.repartition("_bucket").select(*(x.split()[0].strip("`") for x in self.schema.split(", ")))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")
        if batch is not None:
            self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/batch={batch}")
        return len(touched)

