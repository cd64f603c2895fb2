"""Intermediate tables in the shared folder of the cluster, which cut lineage and outlive lost executors."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a local one of our own on a local master (tests), and a
    failure on a cluster, whose executors would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="visagelake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back; the plan above it then starts at those files."""
    path = f"{folder(df.sparkSession)}/visagelake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by save() that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for directory in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(directory)
        path.getFileSystem(conf).delete(path, True)


#: Bytes of text up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcasting if it has at most so many rows and BROADCAST_BYTES of values, both counted; a larger
    table is shuffled."""
    text = F.coalesce(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns))))), F.lit(0))
    size = df.agg(F.count("*").alias("rows"), F.sum(text).alias("bytes")).first()
    return F.broadcast(df) if size.rows <= rows and (size.bytes or 0) <= BROADCAST_BYTES else df
