"""Queries on media, sidecars, plans and statistics."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visagelake.functions import catalog, paths
from visagelake.operators import analytics, discover, sidecar, sketches, tables, typed
from visagelake.plans.views import duck, view
from visagelake.sources import media as files
from visagelake.sources import sidecars

QUERIES, ORACLE = {}, {}
IS_IMAGE = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN (" + ", ".join(f"'{e}'" for e in paths.IMAGE_EXTENSIONS) + ")"
SCAR = "regexp_replace(path, '([^/])\\.[^./]+$', '\\1') || '.scar'"


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = duck(sql, *views) if views else sql
        return f

    return add


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.images(view(spark, sf_dir, "media"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.face_counts(images(spark, sf_dir), view(spark, sf_dir, "faces"))


COUNTS = f", counts AS (SELECT m.*, coalesce(n, 0) AS n_faces FROM (SELECT * FROM media WHERE {IS_IMAGE}) m LEFT JOIN (SELECT media_id, count(*) AS n FROM faces GROUP BY 1) f ON f.media_id = m.media_id)\n"


@query(COUNTS + "SELECT n_faces, count(*) AS images FROM counts GROUP BY 1", "media", "faces")
def faces_per_photo(spark, sf_dir):
    return analytics.faces_per_photo(counts(spark, sf_dir))


@query(
    COUNTS + "SELECT CAST(regexp_extract(path, '/(20[0-9]{2})/', 1) AS INT) AS year, count(*) AS images, count(*) FILTER (n_faces > 0) AS with_faces, CAST(sum(n_faces) AS BIGINT) AS faces,"
    " round(count(*) FILTER (n_faces > 0) / count(*), 6) AS coverage, round(sum(n_faces) / count(*), 6) AS avg_faces FROM counts GROUP BY 1",
    "media", "faces",
)
def year_breakdown(spark, sf_dir):
    return analytics.by_year(counts(spark, sf_dir), paths.year_of(F.col("path")))


@query(COUNTS + "SELECT dir, count(*) AS images, CAST(sum(n_faces) AS BIGINT) AS faces, max(n_faces) AS most, round(sum(n_faces) / count(*), 6) AS avg_faces FROM counts GROUP BY 1", "media", "faces")
def directory_stats(spark, sf_dir):
    return analytics.directory_stats(counts(spark, sf_dir))


@query(COUNTS + "SELECT dir, quantile_cont(n_faces, 0.25) AS q25, quantile_cont(n_faces, 0.5) AS q50, quantile_cont(n_faces, 0.75) AS q75 FROM counts GROUP BY 1", "media", "faces")
def directory_quantiles(spark, sf_dir):
    return analytics.quantiles(counts(spark, sf_dir), ["dir"])


@query("SELECT CAST(year(mtime) AS INT) AS year, tool, count(*) AS faces, count(DISTINCT media.media_id) AS images FROM media JOIN faces ON faces.media_id = media.media_id GROUP BY CUBE (1, 2)", "media", "faces")
def year_tool_cube(spark, sf_dir):
    joined = view(spark, sf_dir, "media").join(view(spark, sf_dir, "faces"), "media_id")
    return analytics.year_tool_cube(joined.withColumn("year", F.year("mtime")))


@query("SELECT count(*) AS images, count(*) FILTER (has_sidecar) AS sidecars, round(count(*) FILTER (has_sidecar) / greatest(count(*), 1), 6) AS coverage, CAST(sum(has_scrfd) AS BIGINT) AS scrfd_images, CAST(sum(has_arcface) AS BIGINT) AS arcface_images FROM coverage", "coverage")
def collection_overview(spark, sf_dir):
    return analytics.overview(view(spark, sf_dir, "coverage"))


@query(f"SELECT media_id, path FROM media WHERE {IS_IMAGE} ORDER BY path", "media")
def discovered_sorted(spark, sf_dir):
    return images(spark, sf_dir).select("media_id", "path").orderBy("path")


PENDING = f", pending AS (SELECT m.*, s.media_id IS NULL AS pending FROM (SELECT * FROM media WHERE {IS_IMAGE}) m LEFT JOIN (SELECT DISTINCT media_id FROM faces WHERE tool = 'scrfd') s ON s.media_id = m.media_id)\n"


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = view(spark, sf_dir, "faces").where("tool = 'scrfd'").select("media_id", F.lit(True).alias("done")).distinct()
    return images(spark, sf_dir).join(done, "media_id", "left").withColumn("pending", F.col("done").isNull())


@query(PENDING + "SELECT dir, count(*) AS discovered, count(*) FILTER (pending) AS enqueued, count(*) FILTER (NOT pending) AS skipped FROM pending GROUP BY 1", "media", "faces")
def scan_stats(spark, sf_dir):
    return discover.scan_stats(pending(spark, sf_dir), F.col("pending"))


@query(
    PENDING + "SELECT split_part(ltrim(dir, '/'), '/', 1) AS part1, split_part(ltrim(dir, '/'), '/', 2) AS part2, split_part(ltrim(dir, '/'), '/', 3) AS part3,"
    " count(*) AS discovered, count(*) FILTER (pending) AS enqueued, count(*) FILTER (NOT pending) AS skipped FROM pending GROUP BY ROLLUP (1, 2, 3)",
    "media", "faces",
)
def scan_stats_rollup(spark, sf_dir):
    return discover.scan_stats_rollup(pending(spark, sf_dir), F.col("pending"), 3)


@query("SELECT regexp_extract(d, '^(.*)/[^/]*$', 1) AS dir, count(*) AS subdirs FROM (SELECT DISTINCT dir AS d FROM media) GROUP BY 1", "media")
def subdirectories(spark, sf_dir):
    return discover.subdirectories(view(spark, sf_dir, "media"))


def done_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = F.array_compact(F.array(F.when(F.col("has_scrfd") == 1, "scrfd"), F.when(F.col("has_arcface") == 1, "arcface")))
    return view(spark, sf_dir, "coverage").select("media_id", paths.sidecar_path(F.col("path")).alias("scar_path"), F.explode(tools).alias("tool"))


PLAN = ", plan AS (SELECT media_id, path, 'scrfd' AS tool FROM coverage WHERE has_scrfd = 0 UNION ALL SELECT media_id, path, 'arcface' FROM coverage WHERE has_arcface = 0 UNION ALL SELECT media_id, path, t FROM coverage, (VALUES ('dlib_detect'), ('detectron2')) v(t))\n"


def plan(spark: SparkSession, sf_dir: str, force: bool = False) -> DataFrame:
    tools = catalog.tools_table(spark).where(F.col("tool").isin("scrfd", "arcface", "dlib_detect", "detectron2"))
    return discover.work_plan(view(spark, sf_dir, "coverage"), tools, done_tools(spark, sf_dir), force)


@query(PLAN + "SELECT * FROM plan", "coverage")
def work_plan(spark, sf_dir):
    return plan(spark, sf_dir)


@query("SELECT media_id, path, t AS tool FROM coverage, (VALUES ('scrfd'), ('arcface'), ('dlib_detect'), ('detectron2')) v(t)", "coverage")
def work_plan_forced(spark, sf_dir):
    return plan(spark, sf_dir, force=True)


@query(
    PLAN + "SELECT media_id, CASE WHEN tool IN ('scrfd', 'arcface') THEN 'insightface' WHEN tool = 'dlib_detect' THEN 'face_recognition' ELSE 'detectron2' END AS backend_group, string_agg(tool, ',' ORDER BY tool) AS tools FROM plan GROUP BY 1, 2",
    "coverage",
)
def backend_jobs(spark, sf_dir):
    return discover.backend_jobs(plan(spark, sf_dir)).withColumn("tools", F.array_join("tools", ","))


@query("SELECT media_id, path FROM coverage WHERE NOT has_sidecar", "coverage")
def coverage_gaps(spark, sf_dir):
    all_ = view(spark, sf_dir, "coverage")
    return analytics.coverage_gaps(all_, all_.where("has_sidecar")).select("media_id", "path")


@query("SELECT media_id, path FROM coverage WHERE has_scrfd = 1", "coverage")
def covered_images(spark, sf_dir):
    return analytics.covered(view(spark, sf_dir, "coverage"), done_tools(spark, sf_dir).where("tool = 'scrfd'")).select("media_id", "path")


@query(
    "SELECT 'scrfd' AS tool, CAST(sum(has_scrfd) AS BIGINT) AS with_tool, CAST(count(*) - sum(has_scrfd) AS BIGINT) AS without_tool FROM coverage UNION ALL"
    " SELECT 'arcface', CAST(sum(has_arcface) AS BIGINT), CAST(count(*) - sum(has_arcface) AS BIGINT) FROM coverage UNION ALL SELECT 'cluster', 0, count(*) FROM coverage",
    "coverage",
)
def tool_coverage(spark, sf_dir):
    return analytics.tool_coverage(view(spark, sf_dir, "coverage"), done_tools(spark, sf_dir), ["scrfd", "arcface", "cluster"])


@query(f"SELECT media_id, {SCAR} AS scar_path, dir, regexp_extract(path, '([^/]*)\\.[^./]+$', 1) AS stem, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM media", "media")
def sidecar_paths(spark, sf_dir):
    p = F.col("path")
    return view(spark, sf_dir, "media").select("media_id", paths.sidecar_path(p).alias("scar_path"), paths.dir_of(p).alias("dir"), paths.stem_of(p).alias("stem"), F.lower(paths.suffix_of(p)).alias("ext"))


@query("SELECT page_id, regexp_replace(url, '([^/])\\.[^./]+$', '\\1') || '.scar' AS scar_path FROM pages")
def url_sidecar_paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", paths.sidecar_path(F.col("url")).alias("scar_path"))


ANNOTATED = "regexp_replace(path, '\\.[^./]+$', '') || '_scrfd' || CASE WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.heic', '.heif') THEN '.jpg' ELSE regexp_extract(path, '(\\.[^./]+)$', 1) END"


@query(f"SELECT media_id, {ANNOTATED} AS output FROM media", "media")
def annotated_paths(spark, sf_dir):
    return view(spark, sf_dir, "media").select("media_id", paths.annotated_path(F.col("path")).alias("output"))


@query("SELECT media_id, 'process-' || substr(sha256(path), 1, 24) AS job_id FROM media", "media")
def job_ids(spark, sf_dir):
    return view(spark, sf_dir, "media").select("media_id", paths.job_id("process", F.col("path")).alias("job_id"))


@query(f", own AS (SELECT DISTINCT {SCAR} AS scar_path FROM media) SELECT o.scar_path, m.path FROM own o LEFT JOIN (SELECT {SCAR} AS scar_path, path FROM media WHERE {IS_IMAGE}) m ON m.scar_path = o.scar_path", "media")
def media_for_sidecar(spark, sf_dir):
    media = view(spark, sf_dir, "media")
    named = F.when(F.col("media_id") % 2 == 0, F.create_map(F.lit("_media.basename"), paths.name_of(F.col("path")))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return sidecar.media_of_sidecar(media.select(paths.sidecar_path(F.col("path")).alias("scar_path"), named.alias("entries")), media)


@query(f"SELECT media_id, {SCAR} AS scar_path, media_id % 2 = 0 AS stored, regexp_extract(path, '([^/]*)$', 1) AS basename FROM media WHERE {IS_IMAGE}", "media")
def media_documents(spark, sf_dir):
    media = images(spark, sf_dir)
    docs = media.where("media_id % 2 = 0").select(paths.sidecar_path(F.col("path")).alias("scar_path"), F.create_map(F.lit("_media.basename"), paths.name_of(F.col("path")), F.lit("face.scrfd.version"), F.lit("1.1.0")).alias("entries"))
    out = sidecar.with_documents(media, docs)
    return out.select("media_id", "scar_path", sidecar.has_tool(F.col("entries"), "scrfd").alias("stored"), F.try_element_at("entries", F.lit("_media.basename")).alias("basename"))


LATEST = ", latest AS (SELECT scar_path, entry_key, entry_value, written_at, seq FROM entries QUALIFY row_number() OVER (PARTITION BY scar_path, entry_key ORDER BY written_at DESC, seq DESC) = 1)\n"


@query(LATEST + "SELECT scar_path, entry_key, entry_value, seq FROM latest", "entries")
def merge_entries(spark, sf_dir):
    log = view(spark, sf_dir, "entries")
    faces, others = log.where("entry_key like 'face.%'"), log.where("entry_key not like 'face.%'")
    return sidecar.merge(others, faces.where("seq % 2 = 0"), faces.where("seq % 2 = 1")).select("scar_path", "entry_key", "entry_value", "seq")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecar.documents(sidecar.latest(view(spark, sf_dir, "entries")))


@query("SELECT scar_path, coalesce(string_agg(DISTINCT split_part(entry_key, '.', 2), ',' ORDER BY split_part(entry_key, '.', 2)) FILTER (entry_key LIKE 'face.%'), '') AS tools, bool_or(entry_key = 'face.scrfd.version') AS processed FROM entries GROUP BY 1", "entries")
def tools_present(spark, sf_dir):
    e = F.col("entries")
    return documents(spark, sf_dir).select("scar_path", F.array_join(sidecar.tools_of(e), ",").alias("tools"), sidecar.has_tool(e, "scrfd").alias("processed"))


@query(LATEST + "SELECT scar_path, max(entry_value) FILTER (entry_key = 'face.scrfd.version') AS version, max(entry_value) FILTER (entry_key = 'face.scrfd.faces') AS faces, count(*) FILTER (entry_key LIKE 'face.scrfd.%') AS n_fields FROM latest GROUP BY 1", "entries")
def tool_section(spark, sf_dir):
    part = sidecar.section(F.col("entries"), "scrfd")
    return documents(spark, sf_dir).select("scar_path", sidecar.read_field(F.col("entries"), "scrfd", "version").alias("version"), F.try_element_at(part, F.lit("faces")).alias("faces"), F.size(part).cast("long").alias("n_fields"))


@query(
    LATEST + ", f AS (SELECT scar_path, split_part(entry_key, '.', 2) AS tool, string_agg(to_json(split_part(entry_key, '.', 3)) || ':' || to_json(entry_value), ',' ORDER BY entry_key) AS j FROM latest WHERE entry_key LIKE 'face.%' GROUP BY 1, 2)"
    " SELECT scar_path, '{\"sidecar\":' || to_json(scar_path) || ',\"tools\":{' || string_agg(to_json(tool) || ':{' || j || '}', ',' ORDER BY tool) || '}}' AS json FROM f GROUP BY 1",
    "entries",
)
def inspect_json(spark, sf_dir):
    return sidecar.inspect_json(sidecar.latest(view(spark, sf_dir, "entries")))


@query(LATEST + "SELECT scar_path, split_part(entry_key, '.', 2) AS tool, split_part(entry_key, '.', 3) AS field, CASE WHEN entry_key = 'face.scrfd.faces' THEN '2 item(s)' ELSE entry_value END AS shown FROM latest WHERE entry_key LIKE 'face.%'", "entries")
def inspect_summary(spark, sf_dir):
    log = sidecar.latest(view(spark, sf_dir, "entries"))
    listed = log.withColumn("entry_value", F.when(F.col("entry_key") == "face.scrfd.faces", F.concat(F.lit("["), "entry_value", F.lit(","), "entry_value", F.lit("]"))).otherwise(F.col("entry_value")))
    return sidecar.inspect_summary(listed)


@query(
    ", r AS (SELECT media_id, path, mtime FROM media) SELECT " + SCAR + " AS scar_path, unnest(['face.scrfd.version', 'face.scrfd.processed_at', 'face.scrfd.media_id']) AS entry_key,"
    " unnest(['1.1.0', strftime(mtime, '%Y-%m-%dT%H:%M:%S') || '+00:00', CAST(media_id AS VARCHAR)]) AS entry_value FROM r",
    "media",
)
def tool_patches(spark, sf_dir):
    media = view(spark, sf_dir, "media").withColumn("scar_path", paths.sidecar_path(F.col("path")))
    return sidecar.tool_patch(media, "scrfd", ["media_id"], F.col("mtime"), F.col("media_id")).select("scar_path", "entry_key", "entry_value")


def members_case(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{g}' THEN {m!r}" for g, m in catalog.GROUPS.items()) + f" ELSE [{column}] END"


@query(
    ", n AS (SELECT user_id, lower(trim(request)) AS t FROM requests), a AS (SELECT user_id, CASE t WHEN 'hdbscan' THEN 'cluster' ELSE t END AS t FROM n),"
    f" x AS (SELECT DISTINCT user_id, unnest({members_case('t')}) AS t FROM a)"
    ", k AS (SELECT user_id, t, t IN (" + ", ".join(f"'{t}'" for t in catalog.VERSIONS) + ") AS known, t IN (" + ", ".join(f"'{t}'" for t in catalog.ANALYSIS) + ") AS analysis FROM x)"
    " SELECT user_id, string_agg(t, ',' ORDER BY t) AS expanded, coalesce(string_agg(t, ',' ORDER BY t) FILTER (NOT known), '') AS unknown, count(*) FILTER (analysis) AS n_analysis,"
    " bool_or(t = 'scrfd' OR analysis) AS runs_scrfd, bool_or(t = 'dlib_embed') AS runs_dlib FROM k GROUP BY 1",
    "requests",
)
def tool_requests(spark, sf_dir):
    asked = view(spark, sf_dir, "requests").groupBy("user_id").agg(F.array_sort(F.collect_set("request")).alias("request"))
    tools = catalog.expanded(F.col("request"))
    deps = catalog.with_dependencies(F.col("tools"))
    return asked.withColumn("tools", tools).select(
        "user_id",
        F.array_join(F.array_sort("tools"), ",").alias("expanded"),
        F.array_join(F.array_sort(catalog.unknown(F.col("request"))), ",").alias("unknown"),
        F.size(catalog.of_kind(F.col("tools"), "analysis")).cast("long").alias("n_analysis"),
        F.array_contains(deps, "scrfd").alias("runs_scrfd"),
        F.array_contains(deps, "dlib_embed").alias("runs_dlib"),
    )


@query(
    "SELECT media_id, path, tool, media_id % 2 = 0 AS explicit, CASE WHEN tool <> 'detectron2' THEN 'run' WHEN media_id % 2 = 0 THEN 'error' ELSE 'skip' END AS status FROM plan".join([PLAN, ""]), "coverage"
)
def tool_availability(spark, sf_dir):
    issues = catalog.tools_table(spark).select("tool", F.when(F.col("tool") == "detectron2", "no runtime").alias("issue"))
    return catalog.available(plan(spark, sf_dir).withColumn("explicit", F.col("media_id") % 2 == 0), issues).drop("issue")


@query(f"SELECT media_id, path FROM media WHERE {IS_IMAGE} AND media_id % 3 <> 0", "media")
def annotate_plan(spark, sf_dir):
    found = images(spark, sf_dir)
    outputs = found.where("media_id % 3 = 0").select(paths.annotated_path(F.col("path")).alias("path"))
    return discover.without_outputs(found, outputs).select("media_id", "path")


@query("SELECT count(*) AS jobs, count(*) FILTER (status = 'ok') AS processed, CAST(sum(CASE WHEN status = 'ok' THEN face_count ELSE 0 END) AS BIGINT) AS faces, count(*) FILTER (status = 'failed') AS failed FROM jobs", "jobs")
def job_summary(spark, sf_dir):
    return analytics.job_summary(view(spark, sf_dir, "jobs"))


@query("SELECT job_id, status, face_count FROM jobs WHERE status = 'failed' AND ended_at > (SELECT max(ended_at) FROM jobs) - INTERVAL 1 DAY ORDER BY ended_at DESC, job_id LIMIT 10", "jobs")
def recent_failures(spark, sf_dir):
    jobs = view(spark, sf_dir, "jobs").withColumn("at", F.col("ended_at").cast("timestamp"))
    now = jobs.agg(F.max("at")).first()[0]
    return analytics.recent_failures(jobs, F.lit(now)).select("job_id", "status", "face_count")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{tables.folder(spark)}/visagelake/{name}-{uuid.uuid4().hex}"


@query(
    ", d AS (SELECT DISTINCT media_id, tool FROM faces UNION SELECT media_id, 'arcface' FROM media WHERE media_id % 5 = 0), t AS (SELECT count(*) AS images, count(*) FILTER (media_id % 3 = 0) AS sidecars FROM media),"
    " p AS (SELECT tool, count(*) AS tool_images FROM d SEMI JOIN media USING (media_id) GROUP BY 1), f AS (SELECT tool, count(*) AS n FROM faces SEMI JOIN media USING (media_id) GROUP BY 1)"
    " SELECT p.tool, images, sidecars, round(sidecars / images, 6) AS coverage, tool_images, coalesce(n, 0) AS faces, round(coalesce(n, 0) / tool_images, 6) AS avg_faces FROM p LEFT JOIN f ON f.tool = p.tool, t",
    "media", "faces",
)
def tool_overview(spark, sf_dir):
    media, faces = view(spark, sf_dir, "media").withColumn("has_sidecar", F.col("media_id") % 3 == 0), view(spark, sf_dir, "faces")
    done = faces.select("media_id", "tool").unionByName(media.where("media_id % 5 = 0").select("media_id", F.lit("arcface").alias("tool")))
    return analytics.tool_overview(media, done, faces)


@query(
    ", n AS (SELECT user_id, event_id, lower(trim(CASE event_type WHEN 'click' THEN ' SCRFD ' WHEN 'view' THEN 'expression' WHEN 'signup' THEN 'HDBSCAN' WHEN 'purchase' THEN 'face_recognition' ELSE 'nothing_known' END)) AS t FROM events),"
    " f AS (SELECT user_id, CASE t WHEN 'hdbscan' THEN 'cluster' ELSE t END AS t, min(event_id) AS since FROM n GROUP BY 1, 2) SELECT user_id, string_agg(t, ',' ORDER BY since) AS tools FROM f GROUP BY 1",
    "media",
)
def ordered_requests(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    asked = F.when(F.col("event_type") == "click", " SCRFD ").when(F.col("event_type") == "view", "expression").when(F.col("event_type") == "signup", "HDBSCAN").when(F.col("event_type") == "purchase", "face_recognition").otherwise("nothing_known")
    listed = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", asked.alias("t")))).alias("l"))
    return listed.select("user_id", F.array_join(catalog.normalized(F.col("l")["t"]), ",").alias("tools"))


@query(
    "SELECT event_id, CASE WHEN event_type = 'click' THEN 'dlib_embed' WHEN user_id % 4 = 0 THEN 'arcface' WHEN user_id % 4 = 1 THEN 'dlib_embed' WHEN user_id % 4 = 2 THEN 'arcface' END AS source,"
    " CASE WHEN event_type = 'click' OR user_id % 4 = 1 THEN 'cluster_dlib' WHEN user_id % 4 IN (0, 2) THEN 'cluster' END AS cluster FROM events"
)
def embedding_choice(spark, sf_dir):
    given = F.when(F.col("user_id") % 4 == 0, "").when(F.col("user_id") % 4 == 1, " DLIB_embed").when(F.col("user_id") % 4 == 2, "ArcFace").otherwise("other")
    source = catalog.embedding_source(F.array(F.when(F.col("event_type") == "click", "HDBSCAN_dlib").otherwise("cluster")), given)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("source", source).select("event_id", "source", catalog.cluster_tool(F.col("source")).alias("cluster"))


@query(LATEST + "SELECT scar_path, entry_key, entry_value FROM latest", "entries")
def stored_documents(spark, sf_dir):
    at = scratch(spark, "documents")
    documents(spark, sf_dir).write.json(at)
    return files.read_entries(spark, at)


@query(LATEST + "SELECT scar_path, CASE WHEN scar_path LIKE '%1.scar' THEN 1 ELSE count(*) END AS n FROM latest GROUP BY scar_path", "entries")
def rewritten_buckets(spark, sf_dir):
    at, docs = scratch(spark, "buckets"), documents(spark, sf_dir)
    files.write_documents(docs, at, 8)
    stored = spark.read.parquet(at)
    again = docs.join(stored.where("scar_path like '%1.scar'").select(F.col("bucket").alias("touched")).distinct(), F.pmod(F.xxhash64("scar_path"), F.lit(8)) == F.col("touched")).drop("touched")
    cut = F.when(F.col("scar_path").like("%1.scar"), F.map_from_entries(F.slice(F.map_entries("entries"), 1, 1))).otherwise(F.col("entries"))
    files.write_documents(tables.save(again.withColumn("entries", cut), "again"), at, 8)
    return spark.read.parquet(at).select("scar_path", F.size("entries").cast("long").alias("n"))


@query("SELECT job_id, status, face_count FROM jobs WHERE status <> 'skipped'", "jobs")
def job_results(spark, sf_dir):
    at, jobs = scratch(spark, "results"), view(spark, sf_dir, "jobs")
    for status in ("ok", "failed"):
        analytics.write_results(jobs.where(F.col("status") == status), at)
    return spark.read.parquet(at).select("job_id", "status", "face_count")


@query(
    ", latest AS (SELECT scar_path, entry_key, entry_value FROM entries QUALIFY row_number() OVER (PARTITION BY scar_path, entry_key ORDER BY written_at DESC, seq DESC) = 1),"
    " n AS (SELECT scar_path, count(*) AS n_entries, max(entry_value) FILTER (entry_key = 'face.scrfd.version') AS version FROM latest GROUP BY 1)"
    " SELECT u.user_id, coalesce(n_entries, 1) AS n_entries, version FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN n ON n.scar_path = '/photos/u' || u.user_id || '.scar'",
    "entries",
)
def bucketed_documents(spark, sf_dir):
    """Half of the entries stored by bucket, the others merged in, and the documents joined to their images."""
    name = f"entries_{uuid.uuid4().hex}"
    entries = view(spark, sf_dir, "entries")
    files.save_entries(sidecar.latest(entries.where("seq % 2 = 0")), name, f"{tables.folder(spark)}/visagelake/{name}", 8)
    docs = sidecar.documents(files.merge_stored(spark, name, entries.where("seq % 2 = 1"), 8))
    media = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.concat(F.lit("/photos/u"), "user_id", F.lit(".jpg")).alias("path")).distinct()
    found = sidecar.with_documents(media, docs)
    return found.select("user_id", F.size("entries").cast("long").alias("n_entries"), sidecar.read_field(F.col("entries"), "scrfd", "version").alias("version"))


RANKS = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


@query(
    COUNTS + "SELECT year(mtime) AS year, count(*) AS images, count(DISTINCT media_id) AS exact, true AS distinct_close, true AS q25_close, true AS q50_close, true AS q75_close FROM counts GROUP BY GROUPING SETS ((1), ())",
    "media", "faces",
)
def sketched_statistics(spark, sf_dir):
    """Sketches stored per directory and year, merged for every year and for all, beside the exact answers that they must be close to."""
    exact = tables.save(counts(spark, sf_dir).select("media_id", "dir", F.year("mtime").alias("year"), "n_faces"), "counts")
    stored = tables.save(sketches.sketched(exact, ["dir", "year"]), "sketches")
    years = exact.unionByName(exact.withColumn("year", F.lit(None).cast("int"))).withColumn("year", F.coalesce("year", F.lit(0)))
    estimated = tables.save(sketches.estimates(sketches.merged(stored, ["year"]).unionByName(sketches.merged(stored, []).withColumn("year", F.lit(0))), RANKS), "estimates")
    shares = sketches.rank_range(years, estimated, ["year"], RANKS)
    found = years.groupBy("year").agg(F.countDistinct("media_id").alias("exact")).join(estimated, "year").join(shares, "year")
    close = [((F.col(f"{n}_below") <= r + sketches.RANK_ERROR) & (F.col(f"{n}_up_to") >= r - sketches.RANK_ERROR)).alias(f"{n}_close") for n, r in RANKS.items()]
    near = (F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), sketches.COUNT_ERROR * F.col("exact"))).alias("distinct_close")
    return found.select(F.nullif("year", F.lit(0)).alias("year"), "images", "exact", near, *close)


def typed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed entries, lists of faces among them: half stored, the others merged in."""
    log = view(spark, sf_dir, "entries")
    listed = log.withColumn("entry_value", F.when(F.col("entry_key") == "face.scrfd.faces", F.concat(F.lit("["), "entry_value", F.lit(","), "entry_value", F.lit("]"))).otherwise(F.col("entry_value")))
    stored = tables.save(sidecar.latest(typed.typed(listed.where("seq % 2 = 0"))), "typed")
    return sidecar.merge(stored, typed.typed(listed.where("seq % 2 = 1")))


@query(
    LATEST + "SELECT scar_path, max(CAST(json_extract(entry_value, '$.k') AS BIGINT)) FILTER (entry_key = 'face.scrfd.version') AS version_k, max(CAST(json_extract(entry_value, '$.k') AS BIGINT)) FILTER (entry_key = 'face.scrfd.faces') AS second_face_k,"
    " CAST(NULL AS BIGINT) AS other_kind, count(*) AS n FROM latest GROUP BY 1",
    "entries",
)
def typed_section(spark, sf_dir):
    e = F.col("entries")
    docs = sidecar.documents(typed_entries(spark, sf_dir))
    return docs.select(
        "scar_path", typed.field(e, "scrfd", "version", "$.k", "bigint").alias("version_k"), typed.field(e, "scrfd", "faces", "$[1].k", "bigint").alias("second_face_k"),
        typed.field(e, "scrfd", "faces", "$.k", "bigint").alias("other_kind"), F.size(e).cast("long").alias("n"),
    )


@query(LATEST + "SELECT scar_path, split_part(entry_key, '.', 2) AS tool, split_part(entry_key, '.', 3) AS field, CASE WHEN entry_key = 'face.scrfd.faces' THEN '2 item(s)' ELSE replace(entry_value, ': ', ':') END AS shown FROM latest WHERE entry_key LIKE 'face.%'", "entries")
def typed_summary(spark, sf_dir):
    return typed.inspect_summary(typed_entries(spark, sf_dir))


@query("SELECT DISTINCT entry_key, CASE WHEN entry_key = 'face.scrfd.faces' THEN 'ARRAY<OBJECT<k: BIGINT>>' ELSE 'OBJECT<k: BIGINT>' END AS kind FROM entries", "entries")
def entry_kinds(spark, sf_dir):
    return typed.kinds(typed_entries(spark, sf_dir))


@query(LATEST + "SELECT scar_path, entry_key, entry_value FROM latest WHERE entry_key LIKE 'face.scrfd.%'", "entries")
def sidecar_files(spark, sf_dir):
    """Documents as files, and the fields of one tool read from them by the data source."""
    at = scratch(spark, "files")
    docs = documents(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("scar_path"), F.lit(8)).cast("string"))
    sidecars.register(spark)
    sidecars.write_files(docs, at, "part")
    read = spark.read.format("sidecars").load(at).where("tool = 'scrfd' and entry_key like 'face.%'")
    return read.select(F.concat(F.lit("/photos/"), F.element_at(F.split("scar_path", "/"), -1)).alias("scar_path"), "entry_key", "entry_value")
