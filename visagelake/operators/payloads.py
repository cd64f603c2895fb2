"""Results per image: face counts, payloads of analysis tools, and records joined from detections and analyses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visagelake.functions import records


def face_count(faces: DataFrame) -> DataFrame:
    """(media_id, face_count): the most faces that one detector found."""
    return faces.groupBy("media_id", "tool").agg(F.count("*").alias("n")).groupBy("media_id").agg(F.max("n").alias("face_count"))


def payload(faces: DataFrame, fields: list[Column], model: str) -> DataFrame:
    """(media_id, tool, faces, face_count, model): face structs in the order of their index."""
    listed = F.array_sort(F.collect_list(F.struct("face_index", *fields)))
    return faces.groupBy("media_id", "tool").agg(listed.alias("faces"), F.count("*").alias("face_count"), F.lit(model).alias("model"))


def json_payload(payloads: DataFrame) -> DataFrame:
    """Payloads as JSON text."""
    return payloads.select("media_id", "tool", F.to_json(F.struct("faces", "face_count", "model")).alias("json"))


def valid_records(faces: DataFrame) -> DataFrame:
    """Faces with a box of four numbers; others are dropped."""
    return faces.where(records.valid_box(F.col("bbox"))).withColumn("bbox", records.box(F.col("bbox")))


def strict_records(faces: DataFrame) -> DataFrame:
    """All faces with status and error: a box with fewer than four numbers is an error row."""
    ok = records.valid_box(F.col("bbox"))
    return faces.withColumns({"status": F.when(ok, "ok").otherwise("error"), "error": F.when(~ok, "face bbox is missing or invalid"), "bbox": records.box(F.col("bbox"))})


POINTS = "array<array<double>>"


def optional(faces: DataFrame, name: str, kind: str) -> Column:
    """A column in a type, null where the table has none of that name."""
    return (F.col(name) if name in faces.columns else F.lit(None)).cast(kind)


def dense_columns(faces: DataFrame) -> list[str]:
    return sorted(c for c in faces.columns if c.startswith("landmark_"))


def detection_records(faces: DataFrame) -> DataFrame:
    """Keys with `bbox` (the first four numbers), `det_score` and `landmarks` (null for none) of detections, as sidecars keep them."""
    keys = [c for c in ("media_id", "tool", "face_index") if c in faces.columns]
    return faces.select(*keys, F.slice(F.col("bbox").cast("array<double>"), 1, 4).alias("bbox"), F.col("det_score").cast("double").alias("det_score"), optional(faces, "landmarks", POINTS).alias("landmarks"))


def sidecar_records(faces: DataFrame) -> DataFrame:
    """Annotation records of stored faces, with status and error: landmarks become key points unless they are missing or
    empty, a missing score is 0, and pose, gender, age, sex and landmark_* are carried as they are stored."""
    found = strict_records(faces)
    keys = [c for c in ("media_id", "tool", "face_index") if c in faces.columns]
    carried = [c for c in ("pose", "gender", "age", "sex") if c in faces.columns] + dense_columns(faces)
    kps = records.key_points(optional(faces, "landmarks", POINTS), optional(faces, "kps", POINTS))
    return found.select(*keys, "status", "error", "bbox", records.score(F.col("det_score")).alias("det_score"), kps.alias("kps"), *carried)


def detector_records(faces: DataFrame) -> DataFrame:
    """Annotation records of a detector's output, with status and error: the first three angles of a pose that has them,
    whole numbers for gender and age, and of landmark_* columns those that hold points."""
    found = strict_records(faces)
    keys = [c for c in ("media_id", "tool", "face_index") if c in faces.columns]
    points = [c for c in dense_columns(faces) if faces.schema[c].dataType.simpleString().startswith("array<array<")]
    dense = [F.when(F.size(c) > 0, F.col(c).cast(POINTS)).alias(c) for c in points]
    return found.select(
        *keys,
        "status",
        "error",
        "bbox",
        F.col("det_score").cast("double").alias("det_score"),
        optional(faces, "kps", POINTS).alias("kps"),
        records.pose(optional(faces, "pose", "array<double>")).alias("pose"),
        optional(faces, "gender", "int").alias("gender"),
        optional(faces, "age", "int").alias("age"),
        optional(faces, "sex", "string").alias("sex"),
        *dense,
    )


def faces_with_embeddings(faces: DataFrame, media: DataFrame) -> DataFrame:
    """Faces (media_id, face_index, ..) with the embedding at the same position of their image's list, null past its end."""
    return faces.join(explode_embeddings(media), ["media_id", "face_index"], "left")


def resolved(media: DataFrame, stored: DataFrame, detected: DataFrame, force: bool = False) -> DataFrame:
    """(media_id, faces, source): stored faces unless forced or missing, else detected ones; an error without either.

    Both tables have (media_id, faces array); a missing and an empty stored list are the same.
    """
    found = media.select("media_id").join(stored.select("media_id", F.col("faces").alias("s")), "media_id", "left").join(detected.select("media_id", F.col("faces").alias("d")), "media_id", "left")
    has = F.coalesce(F.size("s") > 0, F.lit(False)) & F.lit(not force)
    source = F.when(has, "sidecar").when(F.col("d").isNotNull(), "detect").otherwise("error")
    return found.select("media_id", F.when(has, F.col("s")).otherwise(F.col("d")).alias("faces"), source.alias("source"))


def explode_analyses(payloads: DataFrame) -> DataFrame:
    """Faces of payloads (media_id, faces array<struct<face_index, ..>>) with their index: the given one, else the
    position in the list."""
    one = payloads.select("media_id", F.posexplode("faces").alias("pos", "face"))
    return one.withColumn("face_index", F.coalesce(F.col("face.face_index"), F.col("pos"))).drop("pos")


def join_analyses(faces: DataFrame, analyses: DataFrame) -> DataFrame:
    """Faces with what was analysed for the same image and index."""
    return faces.join(analyses, ["media_id", "face_index"], "left")


def explode_embeddings(media: DataFrame) -> DataFrame:
    """(media_id, face_index, embedding) of media (media_id, embeddings array<array<float>>): positions count all
    elements, elements that are no lists are dropped."""
    return media.select("media_id", F.posexplode("embeddings").alias("face_index", "embedding")).where("embedding is not null")


def label_at(labels: Column, face_index: Column) -> Column:
    """Label of a face by position; null past the end."""
    return F.get(labels, face_index)
