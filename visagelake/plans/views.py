"""Domain views over the driver's tables: one SQL text for Spark and DuckDB."""

from pyspark.sql import DataFrame, SparkSession

MEDIA = """
SELECT o_orderkey AS media_id,
       concat('/photos/', CAST(year(o_orderdate) + 10 AS STRING), '/album_', CAST(o_custkey % 50 AS STRING)) AS dir,
       concat('/photos/', CAST(year(o_orderdate) + 10 AS STRING), '/album_', CAST(o_custkey % 50 AS STRING), '/img_', CAST(o_orderkey AS STRING), '.v1',
              CASE WHEN o_orderkey % 17 = 0 THEN '.txt' WHEN o_orderkey % 4 = 0 THEN '.jpg' WHEN o_orderkey % 4 = 1 THEN '.JPG' WHEN o_orderkey % 4 = 2 THEN '.png' ELSE '.heic' END) AS path,
       o_orderdate AS mtime
FROM {orders}"""

FACES = """
SELECT l_orderkey AS media_id, CASE l_returnflag WHEN 'A' THEN 'scrfd' WHEN 'N' THEN 'dlib_detect' ELSE 'detectron2' END AS tool,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS face_index,
       l_quantity * 10 AS x1, CAST(l_suppkey % 400 AS DOUBLE) AS y1, l_quantity * 10 + 20 + l_linenumber * 7.5e0 AS x2, CAST(l_suppkey % 400 AS DOUBLE) + 30 + l_linenumber * 5 AS y2,
       0.5e0 + l_discount * 5 AS det_score, CAST(l_suppkey % 90 AS INT) AS age, CAST(l_partkey % 3 AS INT) AS gender
FROM {lineitem}"""

ENTRIES = """
SELECT concat('/photos/u', CAST(user_id AS STRING), '.scar') AS scar_path,
       CASE event_type WHEN 'click' THEN 'face.scrfd.version' WHEN 'view' THEN 'face.scrfd.faces' WHEN 'signup' THEN 'face.arcface.version' WHEN 'purchase' THEN 'pose.yolo.model' ELSE 'face.cluster.labels' END AS entry_key,
       props AS entry_value, ts AS written_at, event_id AS seq
FROM {events}"""

COVERAGE = """
SELECT d.doc_id AS media_id, concat('/photos/', d.source, '/', CAST(d.doc_id AS STRING), '.', d.lang) AS path,
       l.doc_id IS NOT NULL AS has_sidecar, coalesce(l.quality, 0) AS has_scrfd, coalesce(l.toxic, 0) AS has_arcface
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""

EMBEDDED = "SELECT CAST(floor(vec_id / 3) AS BIGINT) AS media_id, CAST(vec_id % 3 AS INT) AS face_index, embedding, label - 1 AS cluster_label FROM {embeddings}"

JOBS = """
SELECT concat('job-', CAST(event_id AS STRING)) AS job_id, CASE WHEN event_type = 'click' THEN 'failed' WHEN event_type = 'view' THEN 'skipped' ELSE 'ok' END AS status,
       CAST(user_id % 5 AS INT) AS face_count, ts AS ended_at
FROM {events}"""

REQUESTS = """
SELECT user_id, CASE event_type WHEN 'click' THEN ' SCRFD ' WHEN 'view' THEN 'expression' WHEN 'signup' THEN 'HDBSCAN' WHEN 'purchase' THEN 'face_recognition' ELSE 'nothing_known' END AS request
FROM {events}"""

VIEWS = {
    "media": (MEDIA, ["orders"]), "faces": (FACES, ["lineitem"]), "entries": (ENTRIES, ["events"]), "coverage": (COVERAGE, ["documents", "labels"]),
    "embedded": (EMBEDDED, ["embeddings"]), "jobs": (JOBS, ["events"]), "requests": (REQUESTS, ["events"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def duck(sql: str, *names: str) -> str:
    """DuckDB SQL with views in front; sql may begin with a comma and further views."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0].format(**{t: t for t in VIEWS[n][1]}).strip()})" for n in names) + "\n" + sql
