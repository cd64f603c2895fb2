"""Column functions on face records: boxes, landmarks, scores and attributes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of landmark parts, colours by face (blue, green, red), and those of key points.
LANDMARK_PARTS = ("chin", "left_eyebrow", "right_eyebrow", "nose_bridge", "nose_tip", "left_eye", "right_eye", "top_lip", "bottom_lip")
COLOURS = ((0, 0, 255), (0, 255, 0), (255, 0, 0), (0, 255, 255), (255, 0, 255), (255, 255, 0))
GREEN_POINTS, DEFAULT_BUFFER, DEFAULT_SCORE, DENSE_COLOUR = (0, 3), 10.0, 0.5, (180, 180, 180)


def valid_box(bbox: Column) -> Column:
    return F.coalesce(F.size(bbox) >= 4, F.lit(False))


def box(bbox: Column) -> Column:
    """The first four numbers as doubles; null for shorter lists."""
    return F.when(valid_box(bbox), F.slice(bbox, 1, 4).cast("array<double>"))


def location_box(top: Column, right: Column, bottom: Column, left: Column) -> Column:
    """Box left, top, right, bottom of a location given as top, right, bottom, left."""
    return F.array(left, top, right, bottom).cast("array<double>")


def flat_landmarks(parts: Column) -> Column:
    """Points of a map of landmark parts in their fixed order; null without any point."""
    point = lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    listed = lambda m: F.flatten(F.array(*(F.coalesce(F.try_element_at(m, F.lit(k)), none) for k in LANDMARK_PARTS)))
    found = F.transform(F.array(parts), lambda m: F.transform(listed(m), point))  # a list of one, so that the map is made once
    return F.get(F.filter(found, lambda points: F.size(points) > 0), F.lit(0))


def key_points(landmarks: Column, kps: Column) -> Column:
    """Landmarks unless they are missing or empty, else key points."""
    return F.when(F.coalesce(F.size(landmarks) > 0, F.lit(False)), landmarks).otherwise(kps)


def score(det_score: Column) -> Column:
    return F.coalesce(det_score.cast("double"), F.lit(0.0))


def pose(values: Column) -> Column:
    """The first three angles; null for fewer."""
    return F.when(F.size(values) >= 3, F.slice(values, 1, 3).cast("array<double>"))


def dense_landmarks(fields: Column) -> Column:
    """Fields whose name begins with landmark_ and whose first entry is a point."""
    return F.map_filter(fields, lambda k, v: k.startswith("landmark_") & F.coalesce(F.size(F.get(v, F.lit(0))) > 0, F.lit(False)))


def sex(sex_label: Column, gender: Column) -> Column:
    """Given label, else M for gender 1 and F for any other."""
    return F.coalesce(F.when(sex_label != "", sex_label), F.when(gender == 1, "M").when(gender.isNotNull(), "F"))


def class_allowed(class_id: Column, wanted: str) -> Column:
    """Class filter: empty, all or * allow every class, else a comma list of ids."""
    text = wanted.strip().lower()
    ids = [int(x) for x in text.split(",") if x.strip()] if text not in ("", "all", "*") else []
    return class_id.isin(*ids) if ids else F.lit(True)


def pixel(value: Column) -> Column:
    """Nearest whole pixel, halves to even."""
    return F.bround(value, 0).cast("int")


def buffered(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pct: Column) -> Column:
    """Crop box: every side pushed out by pct per cent of the box's width or height, rounded (halves to even) and
    clamped to the image."""
    dx, dy = (x2 - x1) * pct / 100, (y2 - y1) * pct / 100
    keep = lambda v, top: F.greatest(F.lit(0), F.least(top.cast("int"), pixel(v)))
    return F.struct(keep(x1 - dx, width).alias("x1"), keep(y1 - dy, height).alias("y1"), keep(x2 + dx, width).alias("x2"), keep(y2 + dy, height).alias("y2"))


def colour(face_index: Column) -> Column:
    """Overlay colour of a face: six in turn."""
    return F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in COLOURS)), F.pmod(face_index, F.lit(len(COLOURS))) + 1)


def overlay_points(points: Column) -> Column:
    """Whole pixels of key points with their colour: the first and fourth green, others red."""

    def drawn(p: Column, i: Column) -> Column:
        return F.struct(pixel(p[0]).alias("x"), pixel(p[1]).alias("y"), F.when(i.isin(*GREEN_POINTS), "green").otherwise("red").alias("colour"))

    return F.transform(points, drawn)
