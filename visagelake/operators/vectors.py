"""Face embeddings: unit length, exact top-k similarity, core distances and stored indexes."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visagelake.operators import cells, tables

KEY = cells.KEY


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=vectors.copy(), where=norm > 0)


def normalize(faces: DataFrame) -> DataFrame:
    """Embeddings of unit length in double precision; zero vectors stay. Different lengths fail."""

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            if len(batch):
                batch["embedding"] = list(unit_rows(np.stack(batch["embedding"].to_numpy()).astype(np.float64)))
            yield batch

    named = faces.select(*KEY, F.col("embedding").cast("array<double>").alias("embedding"))
    return named.mapInPandas(batches, named.schema)


def require_one_dimension(faces: DataFrame) -> DataFrame:
    """faces, or a failure if their embeddings differ in length."""
    ends = faces.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if ends.a != ends.b:
        raise ValueError(f"embeddings have from {ends.a} to {ends.b} dimensions")
    return faces


def top_k(faces: DataFrame, k: int, block_rows: int = 2000) -> DataFrame:
    """(media_id, face_index, neighbour_media, neighbour_face, score, rank): the k most similar other faces of every face.

    faces must have unit vectors; pieces of about block_rows faces meet where their cells allow a neighbour among the k best,
    each face leaves a meeting with k candidates at most. Equal scores are ranked by key.
    """
    return cells.top_k(faces, k, block_rows)


def core_distance(faces: DataFrame, k: int = 2, block_rows: int = 2000) -> DataFrame:
    """(media_id, face_index, core): euclidean distance of unit vectors to the k-th other face; null with fewer."""
    return cores_of(faces, top_k(faces, k, block_rows), k)


def cores_of(faces: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """core_distance() of faces whose k most similar ones are known."""
    kth = near.where(F.col("rank") == k).select(*KEY, F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("core"))
    return faces.select(*KEY).join(kth, KEY, "left")


def stored(faces: DataFrame, centres: np.ndarray, embedding_tool: str, path: str, mode: str, block_rows: int) -> None:
    """Write unit vectors by cell, and what bounds each cell; the bounds come first, since wider ones do no harm."""
    rows = tables.save(cells.placed(faces, centres), "placed")
    bounds = tables.save(rows.groupBy("cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")), "bounds")
    bounds.coalesce(1).write.mode(mode).parquet(f"{path}/cells/embedding_tool={embedding_tool}")
    parts = F.broadcast(bounds.select("cell", F.ceil(F.col("n") / (50 * block_rows)).alias("parts")))  # CELLS rows
    dealt = rows.join(parts, "cell").join(faces, KEY).withColumn("part", F.pmod(F.xxhash64(*KEY), F.col("parts")))
    dealt.repartition("cell", "part").select(*KEY, "embedding", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors/embedding_tool={embedding_tool}")
    faces.select(F.col("media_id").alias("path"), "face_index").write.mode(mode).json(f"{path}/faces/embedding_tool={embedding_tool}")


def export_index(faces: DataFrame, embedding_tool: str, path: str, block_rows: int = 2000) -> None:
    """Write the index of an embedding tool below path: centres of its cells, unit vectors as Parquet by cell, bounds of
    the cells, and the faces they belong to as JSON. An index of the same tool is replaced, those of others stay."""
    kept = tables.save(normalize(require_one_dimension(faces)), "vectors")
    centres = cells.centres_of(kept, block_rows)
    table = faces.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres/embedding_tool={embedding_tool}")
    stored(kept, centres, embedding_tool, path, "overwrite", block_rows)


def centres_in(spark: SparkSession, embedding_tool: str, path: str) -> np.ndarray:
    found = spark.read.parquet(f"{path}/centres/embedding_tool={embedding_tool}").collect()  # cells.CELLS rows
    return np.array([r.centre for r in sorted(found)])


def append_index(faces: DataFrame, embedding_tool: str, path: str, block_rows: int = 2000) -> None:
    """Add faces to a stored index; its centres stay, so cells may grow wider. Faces that are there already are there twice then."""
    kept = tables.save(normalize(require_one_dimension(faces)), "vectors")
    stored(kept, centres_in(faces.sparkSession, embedding_tool, path), embedding_tool, path, "append", block_rows)


def search_index(faces: DataFrame, embedding_tool: str, path: str, k: int, block_rows: int = 2000) -> DataFrame:
    """(media_id, face_index, neighbour_media, neighbour_face, score, rank): the k most similar faces of a stored index for every
    face, exact, equal scores by key; one that is in the index finds itself. Cells that can hold no answer are not read; an
    empty index answers nothing."""
    spark = faces.sparkSession
    bounds = spark.read.parquet(f"{path}/cells/embedding_tool={embedding_tool}").groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    found = sorted(bounds.collect())  # cells.CELLS rows
    if not found:
        return spark.createDataFrame([], f"{cells.FOUND}, rank int")
    cell, lo, hi, n = (np.array(c) for c in zip(*found, strict=True))
    units = cells.Units(centres_in(spark, embedding_tool, path), cell, np.zeros(len(cell), dtype=np.int64), lo, hi, n, -(-n // block_rows))

    def rows_in(wanted: list[int]) -> DataFrame:
        kept = spark.read.parquet(f"{path}/vectors/embedding_tool={embedding_tool}").where(F.col("cell").isin(wanted))
        return kept.select(*KEY, cells.as_bytes("embedding").alias("packed"), F.col("cell").cast("int").alias("cell"))

    return cells.answered(normalize(faces), units, rows_in, k, block_rows)
