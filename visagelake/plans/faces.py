"""Queries on face records, decoded model outputs, embeddings, overlays, hooks and streams."""

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visagelake.functions import decode, paths, records
from visagelake.operators import analytics, clustering, inference, overlay, payloads, sidecar, tables, vectors
from visagelake.plans.views import duck, view
from visagelake.sources import media
from visagelake.streaming import jobs, ledger

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = duck(sql, *views) if views else sql
        return f

    return add


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with a box list, that of every tenth cut short."""
    full = F.array("x1", "y1", "x2", "y2")
    return view(spark, sf_dir, "faces").withColumn("bbox", F.when(F.col("y1") % 10 == 0, F.slice(full, 1, 3)).otherwise(full))


@query("SELECT media_id, tool, face_index, x1, y1, x2, y2 FROM faces WHERE y1 % 10 <> 0", "faces")
def valid_boxes(spark, sf_dir):
    b = F.col("bbox")
    return payloads.valid_records(boxes(spark, sf_dir)).select("media_id", "tool", "face_index", b[0].alias("x1"), b[1].alias("y1"), b[2].alias("x2"), b[3].alias("y2"))


@query("SELECT media_id, tool, face_index, CASE WHEN y1 % 10 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN y1 % 10 = 0 THEN 'face bbox is missing or invalid' END AS error FROM faces", "faces")
def strict_boxes(spark, sf_dir):
    return payloads.strict_records(boxes(spark, sf_dir)).select("media_id", "tool", "face_index", "status", "error")


@query(
    "SELECT media_id, tool, face_index, det_score, CASE WHEN age % 2 = 0 THEN 'given' WHEN gender = 1 THEN 'M' ELSE 'F' END AS sex, CASE WHEN age >= 45 THEN 3 ELSE 2 END AS n_points, CAST(gender AS INT) AS gender FROM faces WHERE det_score >= 0.5",
    "faces",
)
def face_records(spark, sf_dir):
    point = lambda a: F.array(F.col(a), F.col(a) + 1)
    faces = view(spark, sf_dir, "faces").where(records.score(F.col("det_score")) >= records.DEFAULT_SCORE)
    landmarks = F.when(F.col("age") >= 45, F.array(point("x1"), point("y1"), point("x2"))).otherwise(F.array().cast("array<array<double>>"))
    kps = records.key_points(landmarks, F.array(point("x1"), point("y1")))
    sex = records.sex(F.when(F.col("age") % 2 == 0, "given"), F.col("gender"))
    return faces.select("media_id", "tool", "face_index", records.score(F.col("det_score")).alias("det_score"), sex.alias("sex"), F.size(kps).alias("n_points"), "gender")


@query("SELECT media_id, tool, face_index, det_score FROM faces WHERE det_score >= 0.7 AND gender IN (0, 2)", "faces")
def score_filter(spark, sf_dir):
    faces = view(spark, sf_dir, "faces")
    return faces.where((F.col("det_score") >= 0.7) & records.class_allowed(F.col("gender"), "0, 2")).select("media_id", "tool", "face_index", "det_score")


@query(
    ", n AS (SELECT media_id, count(*) FILTER (tool = 'scrfd') AS s, count(*) FILTER (tool = 'dlib_detect') AS d FROM faces GROUP BY 1)"
    " SELECT m.media_id, CASE WHEN coalesce(s, 0) > 0 THEN 'sidecar' WHEN coalesce(d, 0) > 0 THEN 'detect' ELSE 'error' END AS source, CASE WHEN coalesce(s, 0) > 0 THEN s ELSE coalesce(d, 0) END AS n_faces FROM media m LEFT JOIN n ON n.media_id = m.media_id",
    "media", "faces",
)
def resolved_records(spark, sf_dir):
    faces = view(spark, sf_dir, "faces")
    of = lambda tool: faces.where(F.col("tool") == tool).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("face_index", "x1", "y1", "x2", "y2"))).alias("faces"))
    out = payloads.resolved(view(spark, sf_dir, "media"), of("scrfd"), of("dlib_detect"))
    return out.select("media_id", "source", F.coalesce(F.size("faces"), F.lit(0)).cast("long").alias("n_faces"))


@query("SELECT media_id, tool, face_index, y1 AS left_, x1 AS top, y2 AS right_, x2 AS bottom, 1.0::DOUBLE AS det_score FROM faces WHERE tool = 'dlib_detect'", "faces")
def dlib_locations(spark, sf_dir):
    b = records.location_box(F.col("x1"), F.col("y2"), F.col("x2"), F.col("y1"))
    faces = view(spark, sf_dir, "faces").where("tool = 'dlib_detect'").withColumn("b", b)
    return faces.select("media_id", "tool", "face_index", F.col("b")[0].alias("left_"), F.col("b")[1].alias("top"), F.col("b")[2].alias("right_"), F.col("b")[3].alias("bottom"), F.lit(1.0).alias("det_score"))


@query("SELECT media_id, tool, face_index, CASE WHEN age % 3 = 0 THEN NULL ELSE list_transform([x2, x1, y1], lambda v: [v, v + 1])::VARCHAR END AS points FROM faces", "faces")
def flat_landmarks(spark, sf_dir):
    point = lambda c: F.array(F.struct(F.col(c).alias("x"), (F.col(c) + 1).alias("y")))
    parts = F.create_map(F.lit("top_lip"), F.array().cast("array<struct<x:double,y:double>>"), F.lit("bottom_lip"), point("y1"), F.lit("chin"), point("x2"), F.lit("nose_tip"), point("x1"))
    none = F.create_map(F.lit("unknown"), point("x1"))
    points = records.flat_landmarks(F.when(F.col("age") % 3 == 0, none).otherwise(parts))
    return view(spark, sf_dir, "faces").select("media_id", "tool", "face_index", points.cast("string").alias("points"))


def half_even(x: str) -> str:
    return f"CAST(CASE WHEN abs(({x}) - trunc({x})) = 0.5 THEN 2 * round(({x}) / 2) ELSE round({x}) END AS INT)"


def clamped(x: str, top: int) -> str:
    return f"greatest(0, least({top}, {half_even(x)}))"


@query(
    f"SELECT media_id, tool, face_index, pct, {clamped('x1 - (x2 - x1) * pct / 100', 500)} AS cx1, {clamped('y1 - (y2 - y1) * pct / 100', 400)} AS cy1, {clamped('x2 + (x2 - x1) * pct / 100', 500)} AS cx2,"
    f" {clamped('y2 + (y2 - y1) * pct / 100', 400)} AS cy2 FROM faces, (VALUES (0.0::DOUBLE), (10.0), (20.0)) v(pct)",
    "faces",
)
def crop_boxes(spark, sf_dir):
    faces = view(spark, sf_dir, "faces").withColumn("pct", F.explode(F.array(F.lit(0.0), F.lit(records.DEFAULT_BUFFER), F.lit(20.0))))
    box = records.buffered(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(500), F.lit(400), F.col("pct"))
    return faces.withColumn("c", box).select("media_id", "tool", "face_index", "pct", *(F.col(f"c.{k}").alias(f"c{k}") for k in ("x1", "y1", "x2", "y2")))


@query("SELECT media_id, tool, min_by(x1, face_index) AS x1, min_by(det_score, face_index) AS det_score FROM faces GROUP BY 1, 2", "faces")
def first_faces(spark, sf_dir):
    return view(spark, sf_dir, "faces").where("face_index = 0").select("media_id", "tool", "x1", "det_score")


@query("SELECT media_id, max(n) AS face_count FROM (SELECT media_id, tool, count(*) AS n FROM faces GROUP BY 1, 2) GROUP BY 1", "faces")
def face_count(spark, sf_dir):
    return payloads.face_count(view(spark, sf_dir, "faces"))


@query("SELECT media_id, tool, '{\"faces\":[' || string_agg('{\"face_index\":' || face_index || ',\"age\":' || age || '}', ',' ORDER BY face_index) || '],\"face_count\":' || count(*) || ',\"model\":\"m\"}' AS json FROM faces GROUP BY 1, 2", "faces")
def face_payload(spark, sf_dir):
    return payloads.json_payload(payloads.payload(view(spark, sf_dir, "faces"), [F.col("age")], "m"))


@query("SELECT f.media_id, f.face_index, f.x1, g.age FROM faces f LEFT JOIN faces g ON g.media_id = f.media_id AND g.face_index = f.face_index AND g.tool = 'dlib_detect' WHERE f.tool = 'scrfd'", "faces")
def joined_analyses(spark, sf_dir):
    faces = view(spark, sf_dir, "faces")
    listed = payloads.payload(faces.where("tool = 'dlib_detect'"), [F.col("age")], "m")
    position_only = F.transform("faces", lambda f, i: F.struct(F.when(i % 2 == 0, f["face_index"]).alias("face_index"), f["age"].alias("age")))
    analysed = payloads.explode_analyses(listed.withColumn("faces", position_only)).select("media_id", "face_index", "face.age")
    return payloads.join_analyses(faces.where("tool = 'scrfd'").select("media_id", "face_index", "x1"), analysed)


def scores(n: int) -> F.Column:
    return F.slice("embedding", 1, n)


BEST = "list_position(embedding[1:{n}], list_max(embedding[1:{n}])) - 1"


@query(
    f"SELECT media_id, face_index, ['neutral','happiness','surprise','sadness','anger','disgust','fear','contempt'][{BEST.format(n=8)} + 1] AS emotion,"
    f" coalesce(['White','Black','Latino_Hispanic','East_Asian','Southeast_Asian','Indian','Middle_Eastern'][{BEST.format(n=9)} + 1], CAST({BEST.format(n=9)} AS VARCHAR)) AS race,"
    " round(embedding[2]::DOUBLE, 5) AS happiness, 7::BIGINT AS n_race_scores FROM embedded",
    "embedded",
)
def label_decode(spark, sf_dir):
    emotion = decode.score_map(scores(8), decode.EMOTIONS)
    return view(spark, sf_dir, "embedded").select(
        "media_id", "face_index", decode.label_of(scores(8), decode.EMOTIONS).alias("emotion"), decode.label_of(scores(9), decode.RACES).alias("race"),
        F.round(emotion["happiness"], 5).alias("happiness"), F.size(decode.score_map(scores(9), decode.RACES)).cast("long").alias("n_race_scores"),
    )


@query(
    "SELECT media_id, face_index, round((CASE WHEN face_index = 0 THEN embedding[1] ELSE embedding[2] END)::DOUBLE * 3, 5) AS score, (CASE WHEN face_index = 0 THEN embedding[1] ELSE embedding[2] END)::DOUBLE * 3 >= 0.5 AS is_live, face_index = 1 AS label_live FROM embedded",
    "embedded",
)
def liveness(spark, sf_dir):
    values = F.transform(F.when(F.col("face_index") == 0, scores(1)).otherwise(scores(2)), lambda v: v.cast("double") * 3)
    live = decode.live_score(values)
    label = F.when(F.col("face_index") == 1, "REAL").otherwise("spoof")
    return view(spark, sf_dir, "embedded").select("media_id", "face_index", F.round(live, 5).alias("score"), decode.is_live(live).alias("is_live"), decode.is_live_label(label).alias("label_live"))


@query(
    "SELECT media_id, face_index, CASE WHEN face_index < 2 THEN round(embedding[CASE WHEN face_index = 0 THEN 1 ELSE 2 END]::DOUBLE, 5) END AS yaw, CASE WHEN face_index < 2 THEN round(embedding[CASE WHEN face_index = 0 THEN 2 ELSE 1 END]::DOUBLE, 5) END AS pitch, round(embedding[3]::DOUBLE, 5) AS x FROM embedded",
    "embedded",
)
def gaze(spark, sf_dir):
    g = F.when(F.col("face_index") == 0, decode.gaze(scores(3), False)).when(F.col("face_index") == 1, decode.gaze(scores(3), True)).otherwise(decode.gaze(scores(1), True))
    e = view(spark, sf_dir, "embedded").withColumn("g", g).withColumn("p", decode.gaze_xy(F.col("embedding")[2], F.col("embedding")[3]))
    return e.select("media_id", "face_index", F.round("g.yaw", 5).alias("yaw"), F.round("g.pitch", 5).alias("pitch"), F.round("p.x", 5).alias("x"))


@query("SELECT media_id, face_index, list_sort(list_distinct(list_transform(embedding[1:8], lambda v: CAST(trunc(v * 20) AS INT))))::VARCHAR AS labels, '[2, 4]' AS shape FROM embedded", "embedded")
def parsing_labels(spark, sf_dir):
    rows = F.transform(scores(8), lambda v: F.expr("1") * (v * F.lit(20).cast("float")))
    mask = F.array(F.slice(rows, 1, 4), F.slice(rows, 5, 4))
    return view(spark, sf_dir, "embedded").select("media_id", "face_index", decode.parsing_labels(mask).cast("string").alias("labels"), decode.parsing_shape(mask).cast("string").alias("shape"))


@query(f", d AS (SELECT ['neutral','happiness','surprise','sadness','anger','disgust','fear','contempt'][{BEST.format(n=8)} + 1] AS label, list_max(embedding[1:8])::DOUBLE AS score FROM embedded) SELECT label, count(*) AS faces, round(avg(score), 4) AS mean_score FROM d GROUP BY 1", "embedded")
def analysis_summary(spark, sf_dir):
    decoded = view(spark, sf_dir, "embedded").select(decode.label_of(scores(8), decode.EMOTIONS).alias("label"), F.array_max(scores(8)).cast("double").alias("score"))
    return analytics.label_counts(decoded)


@query(
    "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'happy' END AS emotion_label, CAST(json_extract_string(props, '$.k') AS INT) AS age, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS au12, 1::BIGINT AS n_units FROM events"
)
def attribute_decode(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    one = F.concat(F.lit('{"age": '), k, F.when(F.col("user_id") % 2 == 0, F.lit(', "dominant_emotion": "happy"}')).otherwise(F.lit("}")))
    result = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    units = decode.action_units(F.create_map(F.lit("AU12"), k, F.lit("other"), F.lit("1")))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("a", decode.attributes(result))
    return events.select("event_id", "a.emotion_label", "a.age", units["AU12"].alias("au12"), F.size(units).cast("long").alias("n_units"))


@query("SELECT media_id, face_index, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first, 1.0::DOUBLE AS norm FROM embedded", "embedded")
def normalized_vectors(spark, sf_dir):
    unit = vectors.normalize(view(spark, sf_dir, "embedded"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    return unit.select("media_id", "face_index", F.round(F.col("embedding")[0], 5).alias("first"), F.round(norm, 6).alias("norm"))


UNIT = ", unit AS (SELECT media_id, face_index, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embedded), pairs AS (SELECT a.media_id, a.face_index, b.media_id AS neighbour_media, b.face_index AS neighbour_face, list_inner_product(a.e, b.e) AS score FROM unit a JOIN unit b ON (a.media_id, a.face_index) <> (b.media_id, b.face_index)), top AS (SELECT *, row_number() OVER (PARTITION BY media_id, face_index ORDER BY score DESC, neighbour_media, neighbour_face) AS rank FROM pairs)\n"


@query(UNIT + "SELECT media_id, face_index, neighbour_media, neighbour_face, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM top WHERE rank <= 5", "embedded")
def top_k_similar(spark, sf_dir):
    unit = tables.save(vectors.normalize(view(spark, sf_dir, "embedded")), "unit")
    return vectors.top_k(unit, 5).withColumn("score", F.round("score", 4))


@query(UNIT + "SELECT media_id, face_index, round(sqrt(greatest(2 - 2 * score, 0)), 4) AS core FROM top WHERE rank = 2", "embedded")
def core_distance(spark, sf_dir):
    unit = tables.save(vectors.normalize(view(spark, sf_dir, "embedded")), "unit")
    return vectors.core_distance(unit, 2).withColumn("core", F.round("core", 4))


@query(", e AS (SELECT media_id, list(embedding ORDER BY face_index) AS l FROM embedded GROUP BY 1), x AS (SELECT media_id, unnest(range(len(l))) AS i, l FROM e) SELECT media_id, CAST(i AS INT) AS face_index, round(l[i + 1][1]::DOUBLE, 5) AS first FROM x WHERE i <> 1", "embedded")
def exploded_embeddings(spark, sf_dir):
    lists = view(spark, sf_dir, "embedded").groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("face_index", "embedding"))), lambda x: F.when(x["face_index"] != 1, x["embedding"])).alias("embeddings"))
    return payloads.explode_embeddings(lists).select("media_id", "face_index", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query()
def cluster_labels(spark, sf_dir):
    return clustering.cluster_faces(view(spark, sf_dir, "embedded"))


@query(
    ", g AS (SELECT cluster_label, count(*) AS n, min((media_id, face_index)) AS first FROM embedded GROUP BY 1), l AS (SELECT cluster_label, row_number() OVER (ORDER BY first) - 1 AS label FROM g WHERE n > 1)"
    " SELECT media_id, face_index, CAST(coalesce(label, -1) AS INT) AS label FROM embedded e LEFT JOIN l ON l.cluster_label = e.cluster_label",
    "embedded",
)
def cluster_planted(spark, sf_dir):
    """Clusters of faces whose vectors are those of their identities: every identity of two faces or more is one."""
    faces = view(spark, sf_dir, "embedded")
    axis = F.transform(F.sequence(F.lit(-1), F.lit(14)), lambda i: F.when(i == F.col("cluster_label"), 1.0).otherwise(0.0))
    return clustering.cluster_faces(faces.select("media_id", "face_index", axis.alias("embedding")), block_rows=200, level_edges=4)


@query()
def cluster_summary_live(spark, sf_dir):
    faces = view(spark, sf_dir, "embedded")
    labels = clustering.cluster_faces(faces)
    found = clustering.labels_to_faces(faces.drop("cluster_label"), labels).withColumnRenamed("label", "cluster_label")
    return analytics.cluster_summary(found, "arcface", F.size("embedding"))


@query("SELECT media_id, string_agg(cluster_label, ',' ORDER BY face_index) AS labels, count(DISTINCT cluster_label) FILTER (cluster_label <> -1) AS num_clusters FROM embedded GROUP BY 1", "embedded")
def labels_by_image(spark, sf_dir):
    found = analytics.labels_by_image(view(spark, sf_dir, "embedded"))
    return found.select("media_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), F.col("num_clusters").cast("long").alias("num_clusters"))


@query(
    ", i AS (SELECT '/photos/' || media_id || '.scar' AS scar_path, '[' || string_agg(cluster_label, ',' ORDER BY face_index) || ']' AS labels, CAST(count(DISTINCT cluster_label) FILTER (cluster_label <> -1) AS VARCHAR) AS n FROM embedded GROUP BY media_id)"
    " SELECT scar_path, unnest(['face.cluster.version', 'face.cluster.processed_at', 'face.cluster.labels', 'face.cluster.num_clusters']) AS entry_key, unnest(['1.1.0', '2024-01-01T00:00:00+00:00', labels, n]) AS entry_value FROM i",
    "embedded",
)
def label_writeback(spark, sf_dir):
    faces = view(spark, sf_dir, "embedded").withColumn("scar_path", F.concat(F.lit("/photos/"), "media_id", F.lit(".scar")))
    return analytics.label_entries(faces, "arcface", F.lit("2024-01-01").cast("timestamp"), F.lit(0)).select("scar_path", "entry_key", "entry_value")


@query("SELECT media_id, tool, face_index, CASE WHEN face_index = 0 THEN 7 WHEN face_index = 1 THEN -1 END AS label FROM faces", "faces")
def labels_by_position(spark, sf_dir):
    return view(spark, sf_dir, "faces").select("media_id", "tool", "face_index", payloads.label_at(F.array(F.lit(7), F.lit(-1)), F.col("face_index")).alias("label"))


@query("SELECT 'ok' AS status, count(*) AS faces, max(len(embedding)) AS embedding_dim, count(DISTINCT cluster_label) FILTER (cluster_label <> -1) AS clusters, count(DISTINCT media_id) AS updated_sidecars, 'arcface' AS embedding_tool FROM embedded", "embedded")
def cluster_summary(spark, sf_dir):
    return analytics.cluster_summary(view(spark, sf_dir, "embedded"), "arcface", F.size("embedding"))


@query("SELECT cluster_label, count(*) AS faces, count(DISTINCT media_id) AS photos, min(media_id) AS first_photo, max(media_id) AS last_photo, round(count(*) / (SELECT count(*) FROM embedded), 6) AS share FROM embedded GROUP BY 1", "embedded")
def identity_stats(spark, sf_dir):
    return analytics.identities(view(spark, sf_dir, "embedded"))


@query("SELECT cluster_label, count(*) AS faces, count(DISTINCT media_id) AS photos FROM embedded WHERE cluster_label <> -1 GROUP BY 1 ORDER BY faces DESC, cluster_label LIMIT 3", "embedded")
def largest_identities(spark, sf_dir):
    return analytics.largest_identities(view(spark, sf_dir, "embedded"), 3).select("cluster_label", "faces", "photos")


COLOUR = "[[0, 0, 255], [0, 255, 0], [255, 0, 0], [0, 255, 255], [255, 0, 255], [255, 255, 0]][face_index % 6 + 1]::VARCHAR"


@query(f"SELECT media_id, face_index, {half_even('x1')} AS px1, {half_even('y1')} AS py1, {half_even('x2')} AS px2, {half_even('y2')} AS py2, {COLOUR} AS colour FROM faces", "faces")
def overlay_geometry(spark, sf_dir):
    return overlay.geometry(view(spark, sf_dir, "faces")).withColumn("colour", F.col("colour").cast("string"))


@query(f"SELECT media_id, tool, face_index, i, {half_even('[x1, y1, x2, y2][i + 1]')} AS x, CASE WHEN i IN (0, 3) THEN 'green' ELSE 'red' END AS colour FROM faces, (VALUES (0), (1), (2), (3)) v(i)", "faces")
def overlay_points(spark, sf_dir):
    points = records.overlay_points(F.array(*(F.array(F.col(c), F.col(c)) for c in ("x1", "y1", "x2", "y2"))))
    return view(spark, sf_dir, "faces").select("media_id", "tool", "face_index", F.posexplode(points).alias("i", "p")).select("media_id", "tool", "face_index", "i", "p.x", "p.colour")


@query(
    "SELECT media_id, tool, face_index, CASE WHEN gender = 1 THEN 'M ' ELSE 'F ' END || age || '|det ' || format('{:.2f}', det_score) || CASE WHEN age % 2 = 0 THEN '|pose P:' || format('{:+.1f}', x1 / 7) || ' Y:' || format('{:+.1f}', -y1 / 7) || ' R:' || format('{:+.1f}', 0.25::DOUBLE) ELSE '' END"
    " || CASE WHEN face_index = 0 THEN '|cluster noise' WHEN face_index = 1 THEN '|cluster 1' ELSE '' END AS lines FROM faces",
    "faces",
)
def panel_lines(spark, sf_dir):
    pose = records.pose(F.when(F.col("age") % 2 == 0, F.array(F.col("x1") / 7, -F.col("y1") / 7, F.lit(0.25))).otherwise(F.array(F.col("x1"))))
    label = F.when(F.col("face_index") == 0, -1).when(F.col("face_index") == 1, 1)
    lines = overlay.panel(records.sex(F.lit(None).cast("string"), F.col("gender")), F.col("age"), F.col("det_score"), pose, label)
    return view(spark, sf_dir, "faces").select("media_id", "tool", "face_index", F.array_join(lines, "|").alias("lines"))


@query("SELECT count(*) AS discovered, count(*) FILTER (media_id % 3 = 1) AS written, count(*) FILTER (media_id % 3 = 0) AS skipped, count(*) FILTER (media_id % 3 = 2) AS errors FROM media", "media")
def annotate_stats(spark, sf_dir):
    status = F.when(F.col("media_id") % 3 == 0, "skipped").when(F.col("media_id") % 3 == 1, "written").otherwise("errors")
    return overlay.annotate_stats(view(spark, sf_dir, "media").withColumn("status", status))


def little_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 image for every embedding, its bytes from 48 components; every eleventh is broken."""
    bytes_of = F.array_join(F.transform(F.slice("embedding", 1, 48), lambda v: F.lpad(F.hex((F.abs(v) * 255).cast("int") % 256), 2, "0")), "")
    data = F.unhex(F.when(F.col("vec_id") % 11 == 0, F.lit("00")).otherwise(bytes_of))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("media_id"), F.lit(4).alias("height"), F.lit(4).alias("width"), data.alias("data"))


def bright_detector():
    """A stand-in for a model: the box of pixels brighter than the mean."""

    def detect(image: np.ndarray) -> list[dict]:
        y, x = np.nonzero(image.sum(axis=2) > image.sum(axis=2).mean())
        return [{"bbox": [x.min(), y.min(), x.max() + 1, y.max() + 1], "det_score": len(x) / 16}] if len(x) else []

    return detect


IMAGES = """
WITH img AS (SELECT vec_id AS media_id, list_transform(range(1, 49), lambda i: CAST(trunc(abs(embedding[i]) * 255) AS INT) % 256) AS b FROM embeddings WHERE vec_id % 11 <> 0),
px AS (SELECT media_id, b, list_transform(range(16), lambda p: b[3 * p + 1] + b[3 * p + 2] + b[3 * p + 3]) AS s FROM img),
means AS (SELECT *, list_sum(s) / 16.0 AS m FROM px),
bright AS (SELECT media_id, b, list_filter(range(16), lambda p: s[p + 1] > m) AS q FROM means),
det AS (SELECT media_id, b, list_min(list_transform(q, lambda p: p % 4))::DOUBLE AS x1, list_min(list_transform(q, lambda p: p // 4))::DOUBLE AS y1,
        list_max(list_transform(q, lambda p: p % 4))::DOUBLE + 1 AS x2, list_max(list_transform(q, lambda p: p // 4))::DOUBLE + 1 AS y2, len(q) / 16.0::DOUBLE AS det_score FROM bright WHERE len(q) > 0),
crop AS (SELECT *, """ + ", ".join(f"{clamped(x, 4)} AS c{n}" for n, x in (("x1", "x1 - (x2 - x1) * 10 / 100"), ("y1", "y1 - (y2 - y1) * 10 / 100"), ("x2", "x2 + (x2 - x1) * 10 / 100"), ("y2", "y2 + (y2 - y1) * 10 / 100"))) + """ FROM det),
cut AS (SELECT *, 12 * cy1 + 3 * cx1 AS first, 12 * (cy2 - 1) + 3 * (cx2 - 1) AS last FROM crop)
"""


@query(
    IMAGES + "SELECT media_id, 0 AS face_index, x1, y1, x2, y2, det_score, 'ok' AS status, NULL AS error FROM det UNION ALL"
    " SELECT vec_id, NULL, NULL, NULL, NULL, NULL, NULL, 'error', 'ValueError: cannot reshape array of size 1 into shape (4,4,3)' FROM embeddings WHERE vec_id % 11 = 0"
)
def detect_hook(spark, sf_dir):
    found = inference.detect_faces(little_images(spark, sf_dir), bright_detector)
    return found.select("media_id", "face_index", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), "det_score", "status", "error")


def little_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = little_images(spark, sf_dir)
    found = inference.detect_faces(images, bright_detector).where("status = 'ok'")
    b = F.col("bbox")
    boxed = found.select("media_id", "face_index", "bbox").join(images, "media_id").withColumn("crop", records.buffered(b[0], b[1], b[2], b[3], F.col("width"), F.col("height"), F.lit(records.DEFAULT_BUFFER)))
    return inference.crop_faces(boxed)


@query(
    IMAGES + "SELECT media_id, 0 AS face_index, cy2 - cy1 AS crop_h, cx2 - cx1 AS crop_w, array_to_string(list_transform(range((cy2 - cy1) * (cx2 - cx1) * 3),"
    " lambda k: printf('%02X', b[12 * (cy1 + k // (3 * (cx2 - cx1))) + 3 * cx1 + k % (3 * (cx2 - cx1)) + 1])), '') AS crop, 'ok' AS status FROM cut"
)
def crop_hook(spark, sf_dir):
    return little_crops(spark, sf_dir).withColumn("crop", F.hex("crop")).drop("error")


def crops_sink(spark, sf_dir):
    at = f"{tables.folder(spark)}/visagelake/crops-{uuid.uuid4().hex}"
    media.write_crops(little_crops(spark, sf_dir), at, 8)
    return spark.read.parquet(at)


@query(IMAGES + "SELECT media_id, 0 AS face_index, (cy2 - cy1) * (cx2 - cx1) * 3 AS n_bytes FROM cut")
def crop_table(spark, sf_dir):
    return crops_sink(spark, sf_dir).select("media_id", "face_index", F.octet_length("crop").alias("n_bytes"))


def form_sql(tool: str) -> str:
    """First value of the first channel and last one of the last, of a tool's input: those of the crop's corner pixels."""
    _, channels, scale, norm = inference.PREPROCESS[tool]
    if channels == "gray":
        first, last = (f"(0.114 * b[{k} + 1] + 0.587 * b[{k} + 2] + 0.299 * b[{k} + 3]) / {scale}" for k in ("first", "last"))
    else:
        (m, d) = norm or ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
        first, last = f"(b[first + 3] / {scale} - {m[0]}) / {d[0]}", f"(b[last + 1] / {scale} - {m[2]}) / {d[2]}"
    return f"SELECT media_id, 0 AS face_index, '{tool}' AS tool, round({first}, 3)::DOUBLE AS first, round({last}, 3)::DOUBLE AS last, 'ok' AS status FROM cut"


@query(IMAGES + " UNION ALL ".join(map(form_sql, inference.PREPROCESS)))
def preprocess_batch(spark, sf_dir):
    found = tables.save(little_crops(spark, sf_dir), "found")
    crops = tables.save(inference.dealt(found), "crops")
    tables.drop(found)
    corners = lambda: lambda x: np.stack([x[:, 0, 0, 0], x[:, -1, -1, -1]], axis=1)
    out = None
    for tool in inference.PREPROCESS:
        one = inference.analyze_crops(crops, tool, corners).withColumn("tool", F.lit(tool))
        out = one if out is None else out.unionByName(one)
    return out.select("media_id", "face_index", "tool", F.round(F.col("scores")[0], 3).alias("first"), F.round(F.col("scores")[1], 3).alias("last"), "status")


@query(
    IMAGES + ", v AS (SELECT media_id, b[first + 1] + 1.0::DOUBLE AS p, b[first + 2] + 1.0::DOUBLE AS q, b[first + 3] + 1.0::DOUBLE AS r FROM cut)"
    " SELECT media_id, 0 AS face_index, round(p / sqrt(p * p + q * q + r * r), 4) AS e0, round(q / sqrt(p * p + q * q + r * r), 4) AS e1, round(r / sqrt(p * p + q * q + r * r), 4) AS e2, 'ok' AS status FROM v"
)
def embed_hook(spark, sf_dir):
    found = inference.embed_crops(little_crops(spark, sf_dir), lambda: lambda x: x[:, 0, 0, :] + 1)
    return found.select("media_id", "face_index", *(F.round(F.col("embedding")[i], 4).alias(f"e{i}") for i in range(3)), "status")


def points_of(*columns: str) -> F.Column:
    return F.array(*(F.array(F.col(c), F.col(c) + 1) for c in columns))


@query("SELECT media_id, tool, face_index, x1, y1, x2, y2, det_score, CASE WHEN age % 2 = 0 THEN 2 END AS n_points FROM faces", "faces")
def detection_records(spark, sf_dir):
    faces = view(spark, sf_dir, "faces").withColumns({"bbox": F.array("x1", "y1", "x2", "y2", F.lit(99.0)), "landmarks": F.when(F.col("age") % 2 == 0, points_of("x1", "y1"))})
    b = F.col("bbox")
    out = payloads.detection_records(faces)
    return out.select("media_id", "tool", "face_index", *(b[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), "det_score", F.when(F.col("landmarks").isNotNull(), F.size("landmarks")).alias("n_points"))


@query(
    "SELECT media_id, tool, face_index, CASE WHEN y1 % 10 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN y1 % 10 = 0 THEN NULL ELSE y2 END AS y2, CASE WHEN age % 4 = 0 THEN 0.0 ELSE det_score END AS det_score,"
    " CASE WHEN age >= 45 THEN x2 ELSE y1 END AS k0, x1 AS turn, gender, age, 'F' AS sex, y2 AS dense FROM faces",
    "faces",
)
def sidecar_records(spark, sf_dir):
    made = {
        "det_score": F.when(F.col("age") % 4 != 0, F.col("det_score")), "kps": points_of("y1", "x1"), "pose": F.array("x1", "y1", "x2"), "sex": F.lit("F"), "landmark_2d_106": points_of("y2", "x2"),
        "landmarks": F.when(F.col("age") >= 45, points_of("x2")).when(F.col("age") % 2 == 0, F.array().cast("array<array<double>>")),
    }
    out = payloads.sidecar_records(boxes(spark, sf_dir).withColumns(made))
    return out.select("media_id", "tool", "face_index", "status", F.get("bbox", F.lit(3)).alias("y2"), "det_score", F.col("kps")[0][0].alias("k0"), F.col("pose")[0].alias("turn"), "gender", "age", "sex", F.col("landmark_2d_106")[0][0].alias("dense"))


@query(
    "SELECT media_id, tool, face_index, CASE WHEN y1 % 10 = 0 THEN 'error' ELSE 'ok' END AS status, det_score, CASE WHEN age % 2 = 0 THEN x2 END AS turn, gender, age, NULL::VARCHAR AS sex, CASE WHEN age % 3 = 0 THEN 2 END AS n_dense FROM faces",
    "faces",
)
def detector_records(spark, sf_dir):
    made = {
        "pose": F.when(F.col("age") % 2 == 0, F.array("x1", "y1", "x2", "y2")).otherwise(F.array("x1", "y1")), "gender": F.col("gender").cast("double"), "age": F.col("age") + 0.6,
        "landmark_3d_68": F.when(F.col("age") % 3 == 0, points_of("y2", "x2")).otherwise(F.array().cast("array<array<double>>")), "landmark_scores": F.array("x1"),
    }
    out = payloads.detector_records(boxes(spark, sf_dir).withColumns(made))
    assert "landmark_scores" not in out.columns
    return out.select("media_id", "tool", "face_index", "status", "det_score", F.col("pose")[2].alias("turn"), "gender", "age", "sex", F.when(F.size("landmark_3d_68") > 0, F.size("landmark_3d_68")).alias("n_dense"))


@query(
    ", f AS (SELECT media_id, face_index FROM embedded UNION ALL SELECT DISTINCT media_id, 7 FROM embedded)"
    " SELECT f.media_id, f.face_index, round(embedding[1]::DOUBLE, 5) AS first FROM f LEFT JOIN embedded e ON e.media_id = f.media_id AND e.face_index = f.face_index",
    "embedded",
)
def faces_with_embeddings(spark, sf_dir):
    found = view(spark, sf_dir, "embedded")
    lists = found.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("face_index", "embedding"))), lambda x: x["embedding"]).alias("embeddings"))
    faces = found.select("media_id", "face_index").unionByName(found.select("media_id", F.lit(7).alias("face_index")).distinct())
    return payloads.faces_with_embeddings(faces, lists).select("media_id", "face_index", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("SELECT media_id, face_index, CASE WHEN face_index = 1 THEN -1 ELSE cluster_label END AS label FROM embedded", "embedded")
def labels_to_faces(spark, sf_dir):
    found = view(spark, sf_dir, "embedded")
    labels = found.where("face_index <> 1").select("media_id", "face_index", F.col("cluster_label").alias("label"))
    return clustering.labels_to_faces(found.select("media_id", "face_index"), labels)


@query(f"SELECT media_id, tool, face_index, i, {half_even('[x1, y2][i + 1]')} AS x, '[180, 180, 180]' AS colour FROM faces, (VALUES (0), (1)) v(i)", "faces")
def overlay_dense(spark, sf_dir):
    dense = overlay.dense_points(points_of("x1", "y2"))
    return view(spark, sf_dir, "faces").select("media_id", "tool", "face_index", F.posexplode(dense).alias("i", "p")).select("media_id", "tool", "face_index", "i", "p.x", F.col("p.colour").cast("string").alias("colour"))


@query(", d AS (SELECT unnest(['neutral','happiness','surprise','sadness','anger','disgust','fear','contempt']) AS label, unnest(embedding[1:8])::DOUBLE AS score FROM embedded) SELECT label, count(*) AS faces, round(avg(score), 4) AS mean_score FROM d GROUP BY 1", "embedded")
def label_means(spark, sf_dir):
    return analytics.score_means(view(spark, sf_dir, "embedded").select(decode.score_map(scores(8), decode.EMOTIONS).alias("scores")))


@query(
    ", l AS (SELECT 'tool' || face_index AS tool, CASE WHEN media_id % 5 <> 0 THEN embedding[2]::DOUBLE * 3 >= 0.5 END AS live FROM embedded)"
    " SELECT tool, count(*) AS faces, count(*) FILTER (live) AS live, round(count(*) FILTER (live) / count(*), 6) AS live_share FROM l WHERE live IS NOT NULL GROUP BY 1",
    "embedded",
)
def live_share(spark, sf_dir):
    live = decode.is_live(decode.live_score(F.transform(scores(2), lambda v: v.cast("double") * 3)))
    return analytics.live_share(view(spark, sf_dir, "embedded").select(F.concat(F.lit("tool"), "face_index").alias("tool"), F.when(F.col("media_id") % 5 != 0, live).alias("is_live")))


@query(
    "SELECT media_id, face_index, CASE WHEN face_index > 0 THEN round(embedding[1]::DOUBLE, 5) END AS valence, round(embedding[3]::DOUBLE, 5) AS arousal, CASE WHEN face_index = 0 THEN 'a' ELSE 'b' END AS gaze,"
    " CASE WHEN embedding[1] >= embedding[2] THEN 'anger' ELSE 'fear' END AS emotion, 2 AS n_emotions, CASE WHEN face_index = 2 THEN 1 ELSE 2 END AS n_shapes FROM embedded",
    "embedded",
)
def multi_outputs(spark, sf_dir):
    e = F.col("embedding")
    both = decode.valence_arousal(F.when(F.col("face_index") > 0, scores(2)).otherwise(F.array().cast("array<float>")), F.slice("embedding", 3, 1))
    fields = F.when(F.col("face_index") == 0, F.create_map(F.lit("gaze"), F.lit("a"), F.lit("gaze_direction"), F.lit("b"))).otherwise(F.create_map(F.lit("gaze_direction"), F.lit("b")))
    emotions = decode.emotion_columns(F.create_map(F.lit("anger"), e[0], F.lit("fear"), e[1], F.lit("AU01"), e[2]))
    shapes = decode.blendshapes(F.array(F.lit("jawOpen"), F.lit("smile")), F.when(F.col("face_index") == 2, scores(1)).otherwise(scores(5)))
    found = view(spark, sf_dir, "embedded").withColumns({"both": both, "emotions": emotions, "shapes": shapes, "gaze": decode.gaze_of(fields)})
    return found.select(
        "media_id", "face_index", F.round("both.valence", 5).alias("valence"), F.round("both.arousal", 5).alias("arousal"), "gaze", decode.emotion_argmax(F.col("emotions")).alias("emotion"),
        F.size("emotions").alias("n_emotions"), F.size("shapes").alias("n_shapes"),
    )


@query("SELECT media_id, face_index, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first, 'arcface' AS embedding_tool FROM embedded", "embedded")
def index_export(spark, sf_dir):
    at = f"{tables.folder(spark)}/visagelake/index-{uuid.uuid4().hex}"
    vectors.export_index(view(spark, sf_dir, "embedded"), "arcface", at)
    faces = spark.read.json(f"{at}/faces").select(F.col("path").alias("media_id"), F.col("face_index").cast("int").alias("face_index"))
    return spark.read.parquet(f"{at}/vectors").join(faces, ["media_id", "face_index"]).select("media_id", "face_index", F.round(F.col("embedding")[0], 5).alias("first"), "embedding_tool")


@query(
    ", unit AS (SELECT media_id, face_index, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embedded),"
    " top AS (SELECT a.media_id, a.face_index, b.media_id AS neighbour_media, b.face_index AS neighbour_face, list_inner_product(a.e, b.e) AS score, row_number() OVER (PARTITION BY a.media_id, a.face_index ORDER BY list_inner_product(a.e, b.e) DESC, b.media_id, b.face_index) AS rank"
    " FROM unit a JOIN unit b ON a.media_id % 4 = 3 AND b.media_id % 4 <> 3) SELECT media_id, face_index, neighbour_media, neighbour_face, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM top WHERE rank <= 5",
    "embedded",
)
def index_search(spark, sf_dir):
    """Half of the faces stored as an index, a quarter appended, and the rest searched for in it."""
    at = f"{tables.folder(spark)}/visagelake/index-{uuid.uuid4().hex}"
    faces = view(spark, sf_dir, "embedded")
    vectors.export_index(faces.where("media_id % 4 < 2"), "arcface", at)
    vectors.append_index(faces.where("media_id % 4 = 2"), "arcface", at)
    return vectors.search_index(faces.where("media_id % 4 = 3"), "arcface", at, 5).withColumn("score", F.round("score", 4))


def finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Rows of an append stream that ran over all that is there."""
    at = f"{tables.folder(spark)}/visagelake/stream-{uuid.uuid4().hex}"
    jobs.finish(stream, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/photos/u"), F.col("user_id"), F.when(F.col("event_type") == "view", ".txt").otherwise(".jpg"))
    return jobs.table_stream(spark, sf_dir, "events.parquet").select(path.alias("path"), F.col("ts").alias("at"))


@query("SELECT 'process-' || substr(sha256('/photos/u' || user_id || '.jpg'), 1, 24) AS job_id, '/photos/u' || user_id || '.jpg' AS path FROM events WHERE event_type <> 'view'")
def stream_discovery(spark, sf_dir):
    return finished(spark, jobs.discover(event_paths(spark, sf_dir))).select("job_id", "path")


@query("SELECT DISTINCT 'process-' || substr(sha256('/photos/u' || user_id || '.jpg'), 1, 24) AS job_id FROM events WHERE event_type <> 'view'")
def stream_dedupe(spark, sf_dir):
    return finished(spark, jobs.once_per_path(jobs.discover(event_paths(spark, sf_dir)))).select("job_id")


@query("SELECT DISTINCT 'process-' || substr(sha256('/photos/u' || user_id || '.jpg'), 1, 24) AS job_id, date_trunc('day', ts) AS day FROM events WHERE event_type <> 'view'")
def stream_daily_jobs(spark, sf_dir):
    return finished(spark, jobs.once_per_day(jobs.discover(event_paths(spark, sf_dir)))).select("job_id", "day")


@query("SELECT CASE WHEN event_type = 'click' THEN 'failed' ELSE 'ok' END AS status, count(*) AS jobs FROM events GROUP BY 1")
def stream_stats(spark, sf_dir):
    at = f"{tables.folder(spark)}/visagelake/stream-{uuid.uuid4().hex}"
    results = jobs.table_stream(spark, sf_dir, "events.parquet").select(F.when(F.col("event_type") == "click", "failed").otherwise("ok").alias("status"))
    written = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")
    run = jobs.running_counts(results).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(written).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query(", latest AS (SELECT scar_path, entry_key, entry_value, seq FROM entries QUALIFY row_number() OVER (PARTITION BY scar_path, entry_key ORDER BY written_at DESC, seq DESC) = 1) SELECT * FROM latest", "entries")
def stream_merge(spark, sf_dir):
    at = f"{tables.folder(spark)}/visagelake/stream-{uuid.uuid4().hex}"
    view(spark, sf_dir, "entries").repartitionByRange(4, "written_at").write.parquet(f"{at}/in")
    run = jobs.merge_patches(jobs.table_stream(spark, f"{at}/in", files_per_trigger=1), f"{at}/out", f"{at}/checkpoint")
    run.awaitTermination()
    return jobs.merged(spark, f"{at}/out").select("scar_path", "entry_key", "entry_value", "seq")


@query(
    ", last AS (SELECT job, status, ended_at FROM (SELECT event_id % 400 AS job, CASE WHEN event_type = 'click' THEN 'failed' WHEN event_type = 'view' THEN 'skipped' ELSE 'ok' END AS status, ts AS ended_at, event_id FROM events)"
    " QUALIFY row_number() OVER (PARTITION BY job ORDER BY ended_at DESC, event_id DESC) = 1)"
    " SELECT status, count(*) AS jobs FROM last WHERE status <> 'failed' OR epoch_ms(ended_at) + 86400000 > (SELECT epoch_ms(max(ts)) FROM events) GROUP BY 1",
    "jobs",
)
def live_jobs(spark, sf_dir):
    """Jobs by their last status, results coming in two parts: failures that are retried or a day old count no more."""
    at = f"{tables.folder(spark)}/visagelake/stream-{uuid.uuid4().hex}"
    status = F.when(F.col("event_type") == "click", "failed").when(F.col("event_type") == "view", "skipped").otherwise("ok")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("job-"), F.col("event_id") % 400).alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    for part in ("day(at) <= 15", "day(at) > 15"):
        events.where(part).write.mode("append").parquet(f"{at}/in")
        ledger.run(ledger.changes(jobs.table_stream(spark, f"{at}/in", files_per_trigger=1_000_000)), f"{at}/out", f"{at}/checkpoint")
    return ledger.live_counts(spark.read.parquet(f"{at}/out"))
