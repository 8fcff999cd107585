"""Incremental loading: new files of a delivery folder become rows of a table, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.delivery import latest_delivery
from ..session import exists
from .heartbeats import watch

__all__ = ["count_by_window", "load_new", "merge_new", "read_merged", "watch"]


def _stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def load_new(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Appends what is new in folder to table and ends; run again, it goes on where it stopped."""
    return _stream(spark, folder, schema, files_per_batch).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_new(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, keys: list[str], columns: list[str], stamp: str = "loaded_at", buckets: int = 64, files_per_batch: int = 1000) -> StreamingQuery:
    """Like load_new, keeping one row per key, in buckets by key; see read_merged.

    A batch rewrites the buckets that its keys fall into, each as a new version beside the last, and
    then names the versions in force, so a reader never sees half of a batch and a batch that is
    repeated after a failure writes the same versions again. Versions out of force are dropped with
    the batch after the one that replaced them.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        held = _versions(spark, table, n - 1)
        new = batch.select(*keys, stamp, *columns).dropna(subset=keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        new = latest_delivery(new, ["bucket", *keys], [stamp, *columns], stamp)
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        old = [f"{table}/v{held[b]}/bucket={b}" for b in touched if b in held]
        if old:
            kept = spark.read.schema(new.drop("bucket").schema).option("basePath", table).parquet(*old)
            kept = kept.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).select(*new.columns)
            new = latest_delivery(new.unionByName(kept), ["bucket", *keys], [stamp, *columns], stamp)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v{n}")
        force = {**held, **dict.fromkeys(touched, n)}
        rows = spark.createDataFrame(sorted(force.items()), "bucket int, version int")
        rows.coalesce(1).write.mode("overwrite").json(f"{table}/_versions/{n}")
        before = _versions(spark, table, n - 2)
        for b, v in before.items():
            if held.get(b) != v:
                _drop(spark, f"{table}/v{v}/bucket={b}")

    return _stream(spark, folder, schema, files_per_batch).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _versions(spark: SparkSession, table: str, n: int) -> dict[int, int]:
    """The version in force of each bucket after batch n."""
    if n < 0 or not exists(spark, f"{table}/_versions/{n}/_SUCCESS"):
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version int").json(f"{table}/_versions/{n}").collect()}


def read_merged(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows in force of a table that merge_new keeps, in the given columns."""
    if not exists(spark, f"{table}/_versions"):
        return spark.createDataFrame([], schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_versions")
    batches = [int(f.getPath().getName()) for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    n = max((n for n in batches if exists(spark, f"{table}/_versions/{n}/_SUCCESS")), default=-1)
    paths = [f"{table}/v{v}/bucket={b}" for b, v in _versions(spark, table, n).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def count_by_window(events: DataFrame, key: str, stamp: str, length: str, late: str) -> DataFrame:
    """(window start, key, n): events per window, windows closing once the watermark has passed them."""
    source = events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)
    return source.groupBy(F.window(stamp, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
