"""Image files as tables, and the sinks of crops and documents."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visagelake.functions import paths
from visagelake.operators import sidecar


def discover(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, dir, stem, ext, scar_path, length, mtime) of the images below a root or of one file; contents are not
    read. A root that is missing gives no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if found:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length", F.col("modificationTime").alias("mtime"))
    else:
        files = spark.createDataFrame([], "path string, length long, mtime timestamp")
    path = F.col("path")
    return files.where(paths.is_image(path)).select("path", paths.dir_of(path).alias("dir"), paths.stem_of(path).alias("stem"), F.lower(paths.suffix_of(path)).alias("ext"), paths.sidecar_path(path).alias("scar_path"), "length", "mtime")


def load_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, height, width, data) of JPEG, PNG and BMP files as BGR bytes; undecodable files have nulls."""
    return spark.read.format("image").option("dropInvalid", "false").load(root).select(F.col("image.origin").alias("path"), *(F.when(F.col("image.nChannels") == 3, F.col(f"image.{c}")).alias(c) for c in ("height", "width", "data")))


def decode_images(files: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(path, height, width, data, error) of files (path, content) through a user's decoder; one that fails gives an error."""

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    image = decode(content)
                    rows.append((path, image.shape[0], image.shape[1], image.astype(np.uint8).tobytes(), None))
                except Exception as error:  # noqa: BLE001  a file that cannot be decoded is a row, not the end
                    rows.append((path, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "data", "error"]).astype({"height": "Int32", "width": "Int32"})

    return files.select("path", "content").mapInPandas(batches, "path string, height int, width int, data binary, error string")


def write_crops(crops: DataFrame, path: str, buckets: int = 64) -> None:
    """Crops as Parquet, partitioned by a hash bucket of the image; big buckets are written by several tasks, by their bytes."""
    crops.withColumn("bucket", F.pmod(F.xxhash64("media_id"), F.lit(buckets))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries (scar_path, entry_key, entry_value) of documents stored as JSON lines {scar_path, entries}."""
    docs = spark.read.schema("scar_path string, entries map<string,string>").json(path)
    return docs.select("scar_path", F.explode("entries").alias("entry_key", "entry_value"))


def write_documents(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Documents as Parquet, by hash bucket of their path; only the buckets that docs has are overwritten.
    Big buckets are written by several tasks, by their bytes."""
    bucketed = docs.withColumn("bucket", F.pmod(F.xxhash64("scar_path"), F.lit(buckets)))
    bucketed.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def save_entries(entries: DataFrame, table: str, path: str, buckets: int) -> None:
    """Merged entries as a table whose files are bucketed and sorted by document: joins with it and merges into it shuffle the
    other side only. Choose about one bucket for each 128 MB."""
    dealt = entries.repartition(buckets, "scar_path")
    dealt.write.bucketBy(buckets, "scar_path").sortBy("scar_path", "entry_key").option("path", path).mode("overwrite").saveAsTable(table)


def merge_stored(spark: SparkSession, table: str, patches: DataFrame, buckets: int) -> DataFrame:
    """Entries of a table of save_entries() with patches merged in; only the patches are shuffled, into the table's buckets."""
    return sidecar.merge(spark.table(table), patches.repartition(buckets, "scar_path"))
