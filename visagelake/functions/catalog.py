"""The catalogue of tools, and the resolution of tool requests as column functions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tools by kind with their versions, groups, aliases and defaults.
DETECTION = {"scrfd": "1.1.0", "arcface": "1.1.0", "dlib_detect": "1.1.0", "dlib_embed": "1.1.0", "detectron2": "1.1.0"}
AGGREGATE = {"cluster": "1.1.0", "cluster_dlib": "1.1.0"}
ANALYSIS = {
    "emotiefflib": "1.1.0", "opencv_fer": "1.0.0", "mediapipe_blendshapes": "1.0.0", "fer_plus": "1.0.0", "libreface": "1.0.0", "openface3": "1.0.0",
    "py_feat": "1.0.0", "emonet": "1.0.0", "deepface": "1.0.0", "yakhyo_gaze": "1.0.0", "l2cs_net": "1.0.0", "fairface": "1.0.0", "bisenet": "1.0.0",
    "face_antispoof_onnx": "1.0.0", "face_anti_spoofing": "1.0.0", "uniface": "1.0.0", "inspireface": "1.0.0",
}
VERSIONS = DETECTION | AGGREGATE | ANALYSIS
ALIASES = {"hdbscan": "cluster", "hdbscan_dlib": "cluster_dlib"}
GROUPS = {
    "insightface": ["scrfd", "arcface"],
    "face_recognition": ["dlib_detect", "dlib_embed"],
    "detectron2": ["detectron2"],
    "expression": ["emotiefflib", "opencv_fer", "mediapipe_blendshapes", "fer_plus"],
    "emotion": ["emotiefflib", "opencv_fer", "fer_plus", "deepface", "emonet"],
    "au": ["libreface", "openface3", "py_feat"],
    "gaze": ["yakhyo_gaze", "l2cs_net", "libreface", "openface3", "uniface"],
    "blendshapes": ["mediapipe_blendshapes"],
    "attributes": ["fairface", "deepface"],
    "parsing": ["bisenet", "uniface"],
    "liveness": ["face_antispoof_onnx", "face_anti_spoofing", "uniface", "inspireface"],
    "face_analysis": ["emotiefflib", "opencv_fer", "mediapipe_blendshapes"],
    "all_analysis": sorted(ANALYSIS),
}
DEFAULTS = ["scrfd", "arcface", "dlib_detect", "dlib_embed", "detectron2"]
CLUSTER_OF = {"arcface": "cluster", "dlib_embed": "cluster_dlib"}
#: What must run before a tool; every analysis tool works on crops of scrfd faces.
NEEDS = {"arcface": "scrfd", "dlib_embed": "dlib_detect"} | dict.fromkeys(ANALYSIS, "scrfd")
BACKENDS = {"scrfd": "insightface", "arcface": "insightface", "dlib_detect": "face_recognition", "dlib_embed": "face_recognition", "detectron2": "detectron2"} | dict.fromkeys(ANALYSIS, "analysis")


def words(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def tools_table(spark: SparkSession) -> DataFrame:
    """(tool, kind, backend_group, version, needs): 24 rows."""
    kinds = [(DETECTION, "detection"), (AGGREGATE, "aggregate"), (ANALYSIS, "analysis")]
    rows = [(t, kind, BACKENDS.get(t), v, NEEDS.get(t)) for tools, kind in kinds for t, v in tools.items()]
    return spark.createDataFrame(rows, "tool string, kind string, backend_group string, version string, needs string")


def replaced(names: Column, old: str, new: str) -> Column:
    return F.transform(names, lambda t: F.when(t == old, new).otherwise(t))


def normalized(requested: Column) -> Column:
    """Names trimmed, in lower case, aliases replaced; empty ones dropped, the first of equal ones kept."""
    names = F.transform(requested, lambda t: F.lower(F.trim(t)))
    for alias, name in ALIASES.items():
        names = replaced(names, alias, name)
    return F.array_distinct(F.filter(names, lambda t: t != ""))


def expanded(requested: Column) -> Column:
    """Normalised names with groups replaced by their tools."""

    def tools(name: Column) -> Column:
        out = F.array(name)
        for group, members in GROUPS.items():
            out = F.when(name == group, words(members)).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(normalized(requested), tools)))


def unknown(requested: Column) -> Column:
    """Names that are in no part of the catalogue."""
    return F.array_except(expanded(requested), words(sorted(VERSIONS)))


def of_kind(tools: Column, kind: str) -> Column:
    """Tools of a kind (detection, analysis, aggregate), in their given order."""
    members = {"detection": DETECTION, "analysis": ANALYSIS, "aggregate": AGGREGATE}[kind]
    return F.array_intersect(tools, words(list(members)))


def with_dependencies(tools: Column) -> Column:
    """Per-image tools and all that they need: detection tools in their fixed order, then analysis tools as given."""
    needed = F.array_union(tools, F.array_compact(F.transform(tools, lambda t: F.try_element_at(F.create_map(*[F.lit(x) for kv in NEEDS.items() for x in kv]), t))))
    return F.array_union(F.array_intersect(words(DEFAULTS), needed), of_kind(tools, "analysis"))


def per_image(requested: Column) -> Column:
    """Per-image tools of a request of tool names; the defaults where it asks for nothing known, or only unknown names."""
    names = normalized(requested)
    found = with_dependencies(names)
    return F.when((F.size(found) == 0) & (F.size(of_kind(names, "aggregate")) == 0), words(DEFAULTS)).otherwise(found)


def embedding_source(requested: Column, given: Column) -> Column:
    """Embeddings to cluster: dlib_embed for cluster_dlib, else the given ones, else arcface; null if unknown."""
    name = F.lower(F.trim(given))
    chosen = F.when(F.coalesce(given, F.lit("")) == "", "arcface").when(name.isin(*CLUSTER_OF), name)
    return F.when(F.array_contains(normalized(requested), "cluster_dlib"), "dlib_embed").otherwise(chosen)


def cluster_tool(embeddings: Column) -> Column:
    """Name of the cluster tool for an embedding tool; null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CLUSTER_OF.items() for x in kv]), embeddings)


def available(plan: DataFrame, availability: DataFrame) -> DataFrame:
    """Plan rows (.., tool, explicit) with `status`: run, skip where an implicit tool has an issue, error where an
    explicit one has; availability has (tool, issue), of several issues of a tool the first in order counts."""
    issues = availability.groupBy("tool").agg(F.min("issue").alias("issue"))
    found = plan.join(issues, "tool", "left")
    return found.withColumn("status", F.when(F.col("issue").isNull(), "run").when(F.col("explicit"), "error").otherwise("skip"))
