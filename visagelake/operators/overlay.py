"""Overlay tables: geometry and panel texts of annotated images."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visagelake.functions import records


def geometry(faces: DataFrame) -> DataFrame:
    """(media_id, face_index, pixel box, colour) of faces (media_id, face_index, x1, y1, x2, y2)."""
    corners = {c: records.pixel(F.col(c)) for c in ("x1", "y1", "x2", "y2")}
    return faces.select("media_id", "face_index", *(v.alias("p" + c) for c, v in corners.items()), records.colour(F.col("face_index")).alias("colour"))


def two_places(v: Column) -> Column:
    """Number with two decimals, rounded from its binary value as the panel shows it; null for none and NaN."""
    return F.when(~F.isnan(v), F.call_function("format_number", v, F.lit("0.00")))


def signed_place(v: Column) -> Column:
    """Number with its sign and one decimal."""
    return F.when(~F.isnan(v), F.call_function("format_number", v, F.lit("+0.0;-0.0")))


def dense_points(points: Column) -> Column:
    """Whole pixels of the 106 dense landmarks, all grey."""
    return F.transform(points, lambda p: F.struct(records.pixel(p[0]).alias("x"), records.pixel(p[1]).alias("y"), F.array(*map(F.lit, records.DENSE_COLOUR)).alias("colour")))


def panel(sex: Column, age: Column, det_score: Column, pose: Column, label: Column) -> Column:
    """Text lines of a face's panel: sex and age, score, pose, cluster; missing ones are left out."""
    who = F.when(sex.isNotNull() & age.isNotNull(), F.concat_ws(" ", sex, age.cast("int"))).when(sex.isNotNull(), sex).when(age.isNotNull(), F.concat(F.lit("age "), age.cast("int")))
    turn = F.concat(F.lit("pose P:"), signed_place(F.get(pose, F.lit(0))), F.lit(" Y:"), signed_place(F.get(pose, F.lit(1))), F.lit(" R:"), signed_place(F.get(pose, F.lit(2))))
    cluster = F.when(label < 0, "cluster noise").when(label.isNotNull(), F.concat(F.lit("cluster "), label))
    return F.array_compact(F.array(who, F.concat(F.lit("det "), two_places(det_score)), F.when(F.size(pose) >= 3, turn), cluster))


def annotate_stats(results: DataFrame) -> DataFrame:
    """Counts of annotation results by status."""
    return results.agg(F.count("*").alias("discovered"), *(F.count_if(F.col("status") == s).alias(s) for s in ("written", "skipped", "errors")))
