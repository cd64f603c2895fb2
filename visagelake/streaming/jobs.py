"""Structured Streaming jobs: discovery, deduplication, merging and running counts."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visagelake.functions import paths
from visagelake.operators import sidecar

FAILURES_KEPT = "24 hours"


def table_stream(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_trigger: int = 10) -> DataFrame:
    """The Parquet files of a folder whose names fit a pattern, as a stream of their rows."""
    kind = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    return spark.readStream.schema(kind).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def discover(paths_stream: DataFrame) -> DataFrame:
    """Work items (job_id, path, at) of new paths that are images."""
    path = F.col("path")
    return paths_stream.where(paths.is_image(path)).select(paths.job_id("process", path).alias("job_id"), "path", F.col("at").cast("timestamp").alias("at"))


def once_per_path(jobs: DataFrame, within: str = FAILURES_KEPT) -> DataFrame:
    """Jobs without those whose id was seen within the watermark."""
    return jobs.withWatermark("at", within).dropDuplicatesWithinWatermark(["job_id"])


def once_per_day(jobs: DataFrame, within: str = "48 hours") -> DataFrame:
    """The first job of every id and day, with the day as a column; a path that comes again on another day is a new job.
    Days that lie as long as within before the latest one leave the state, and later jobs of theirs are dropped."""
    return jobs.withColumn("day", F.date_trunc("day", "at")).withWatermark("day", within).dropDuplicates(["job_id", "day"])


def running_counts(results: DataFrame) -> DataFrame:
    """Counts of job results by status, for the update or complete mode."""
    return results.groupBy("status").agg(F.count("*").alias("jobs"))


def live_failures(results: DataFrame, within: str = FAILURES_KEPT) -> DataFrame:
    """Failures per hour, kept as state until they are older than the watermark."""
    return results.where("status = 'failed'").withWatermark("at", within).groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("failures"))


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def manifests(spark: SparkSession, target: str) -> list[int]:
    """Batches whose manifest is there, ascending; two or three, as older ones are removed."""
    fs, at = filesystem(spark, f"{target}/manifest")
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in found if n.isdigit())


def manifest(spark: SparkSession, target: str, batch: int) -> dict[int, int]:
    """The current version of every bucket after a batch."""
    fs, at = filesystem(spark, f"{target}/manifest/{batch}")
    stream = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(b): v for b, v in json.loads(text).items()}


def write_manifest(spark: SparkSession, target: str, batch: int, versions: dict[int, int]) -> None:
    """Write a manifest aside and move it into place, so that readers see all of it or nothing."""
    fs, aside = filesystem(spark, f"{target}/manifest/.{batch}")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps(versions), "utf-8"))
    stream.close()
    final = filesystem(spark, f"{target}/manifest/{batch}")[1]
    fs.delete(final, False)
    fs.rename(aside, final)


def merged(spark: SparkSession, target: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """Entries of the table of merge_patches(), as of the last batch (before a batch), of all or some buckets; None without any.
    Only the folders that the manifest names are listed."""
    known = [b for b in manifests(spark, target) if before is None or b < before]
    versions = manifest(spark, target, known[-1]) if known else {}
    paths = [f"{target}/data/version={v}/bucket={b}" for b, v in versions.items() if buckets is None or b in buckets]
    return spark.read.option("basePath", f"{target}/data").parquet(*paths).drop("version") if paths else None


def merge_batch(batch: DataFrame, target: str, batch_id: int, buckets: int = 64) -> None:
    """Merge a batch of patch entries into the buckets of its documents: these are written anew as a version named by the
    batch, and a manifest names the current version of every bucket.

    A batch that is run again starts from the manifest before it and gives the same. Versions that neither this manifest nor the
    one before names are removed, so each bucket has two at most. Buckets of any size are written by as many tasks as
    their bytes need, under adaptive execution.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("scar_path"), F.lit(buckets)).cast("int")
    entries = sidecar.latest(batch).withColumn("bucket", bucket).persist()
    touched = [r.bucket for r in entries.select("bucket").distinct().collect()]  # so many buckets at most
    if touched:
        base = merged(spark, target, batch_id, touched)
        fresh = entries if base is None else sidecar.merge(base.drop("bucket"), entries.drop("bucket")).withColumn("bucket", bucket)
        fresh.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/version={batch_id}")
        *older, last = [-1, *(b for b in manifests(spark, target) if b < batch_id)]
        known = manifest(spark, target, last) if last >= 0 else {}
        versions = known | dict.fromkeys(touched, batch_id)
        write_manifest(spark, target, batch_id, versions)
        remove(spark, target, [b for b in older if b >= 0], known)
    entries.unpersist()


def remove(spark: SparkSession, target: str, batches: list[int], known: dict[int, int]) -> None:
    """Remove the manifests of these batches, and the versions of theirs that are not known any more."""
    for batch in batches:
        for b, v in manifest(spark, target, batch).items():
            if known.get(b) != v:
                fs, at = filesystem(spark, f"{target}/data/version={v}/bucket={b}")
                fs.delete(at, True)
                if fs.exists(at.getParent()) and not any(f.isDirectory() for f in fs.listStatus(at.getParent())):
                    fs.delete(at.getParent(), True)
        fs, at = filesystem(spark, f"{target}/manifest/{batch}")
        fs.delete(at, False)


def merge_patches(patches: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merge a stream of patch entries into the table below target, batch by batch; merged() reads it."""
    merge = lambda batch, batch_id: merge_batch(batch, target, batch_id, buckets)
    return patches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Run an append stream over all that is there into Parquet files at target."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    query.stop()
