"""Column functions that decode model outputs into labels, scores and attributes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label lists in the order of the models' outputs.
EMOTIONS = ("neutral", "happiness", "surprise", "sadness", "anger", "disgust", "fear", "contempt")
RACES = ("White", "Black", "Latino_Hispanic", "East_Asian", "Southeast_Asian", "Indian", "Middle_Eastern")
LIVE_LABELS = ("real", "live", "0")
BLENDSHAPES = 52


def labels(names) -> Column:
    return F.array(*map(F.lit, names))


def argmax(scores: Column) -> Column:
    """Position from 0 of the first largest score; null for an empty list."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def label_of(scores: Column, names) -> Column:
    """Name of the largest score, its position as text past the names; null for an empty list."""
    best = argmax(scores)
    return F.coalesce(F.get(labels(names), best), best.cast("string"))


def score_map(scores: Column, names) -> Column:
    """Scores by name: as many names as there are scores, and no more scores than names."""
    n = F.least(F.size(scores), F.lit(len(names)))
    return F.map_from_arrays(F.slice(labels(names), F.lit(1), n), F.slice(scores.cast("array<double>"), F.lit(1), n))


def live_score(values: Column) -> Column:
    """Second of two or more values, else the first."""
    return F.when(F.size(values) >= 2, F.get(values, F.lit(1))).otherwise(F.get(values, F.lit(0))).cast("double")


def is_live(score: Column) -> Column:
    return score >= 0.5


def is_live_label(label: Column) -> Column:
    return F.lower(label).isin(*LIVE_LABELS)


def gaze(values: Column, pitch_first: bool) -> Column:
    """Struct yaw, pitch of the first two values in a tool's order; null for fewer."""
    a, b = F.get(values, F.lit(0)).cast("double"), F.get(values, F.lit(1)).cast("double")
    yaw, pitch = (b, a) if pitch_first else (a, b)
    return F.when(F.size(values) >= 2, F.struct(yaw.alias("yaw"), pitch.alias("pitch")))


def gaze_xy(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def parsing_labels(mask: Column) -> Column:
    """Sorted distinct whole numbers of a mask given as rows."""
    return F.array_sort(F.array_distinct(F.transform(F.flatten(mask), lambda v: v.cast("int"))))


def parsing_shape(mask: Column) -> Column:
    return F.array(F.size(mask), F.size(F.get(mask, F.lit(0))))


def action_units(fields: Column) -> Column:
    """Fields whose name begins with AU, as doubles."""
    return F.transform_values(F.map_filter(fields, lambda k, _: k.startswith("AU")), lambda _, v: v.cast("double"))


def first_value(values: Column) -> Column:
    return F.get(values, F.lit(0)).cast("double")


def valence_arousal(valence: Column, arousal: Column) -> Column:
    """Struct of the first elements of two outputs; an output that is empty gives null."""
    return F.struct(first_value(valence).alias("valence"), first_value(arousal).alias("arousal"))


def gaze_of(fields: Column) -> Column:
    """The gaze of a result, else its gaze_direction."""
    return F.coalesce(F.try_element_at(fields, F.lit("gaze")), F.try_element_at(fields, F.lit("gaze_direction")))


def emotion_columns(fields: Column) -> Column:
    """Scores of the known emotions among a result's fields."""
    return F.transform_values(F.map_filter(fields, lambda k, _: k.isin(*EMOTIONS)), lambda _, v: v.cast("double"))


def emotion_argmax(scores: Column) -> Column:
    """Name of the largest score of a map, ties by name; null for an empty map."""
    order = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.get(order, F.lit(0))["k"]


def blendshapes(names: Column, scores: Column) -> Column:
    """Map of blendshape scores."""
    n = F.least(F.size(names), F.size(scores))
    return F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(scores.cast("array<double>"), F.lit(1), n))


#: Schema of an attribute result, for from_json().
ATTRIBUTES = "struct<dominant_emotion: string, dominant_gender: string, dominant_race: string, age: double, emotion: map<string,double>, race: map<string,double>>"


def attributes(result: Column) -> Column:
    """Renamed attributes of a JSON result; of a list the first; null where it can't be read."""
    one = F.when(F.ltrim(result).startswith("["), F.get(F.from_json(result, f"array<{ATTRIBUTES}>"), F.lit(0))).otherwise(F.from_json(result, ATTRIBUTES))
    return F.struct(
        one["dominant_emotion"].alias("emotion_label"), one["dominant_gender"].alias("gender"), one["dominant_race"].alias("race_label"),
        one["age"].cast("int").alias("age"), one["emotion"].alias("emotion_scores"), one["race"].alias("race_scores"),
    )
