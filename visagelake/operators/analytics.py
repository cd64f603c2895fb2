"""Statistics of a collection: coverage, faces per photo, years, tools and identities."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visagelake.functions import catalog
from visagelake.operators import sidecar


def face_counts(media: DataFrame, faces: DataFrame) -> DataFrame:
    """Media with n_faces, 0 without any; faces has (media_id)."""
    counts = faces.groupBy("media_id").agg(F.count("*").alias("n"))
    return media.join(counts, "media_id", "left").withColumn("n_faces", F.coalesce("n", F.lit(0))).drop("n")


def faces_per_photo(counts: DataFrame) -> DataFrame:
    """Histogram of n_faces."""
    return counts.groupBy("n_faces").agg(F.count("*").alias("images"))


def directory_stats(counts: DataFrame) -> DataFrame:
    return counts.groupBy("dir").agg(F.count("*").alias("images"), F.sum("n_faces").alias("faces"), F.max("n_faces").alias("most"), F.round(F.avg("n_faces"), 6).alias("avg_faces"))


def quantiles(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact quartiles of n_faces; it has few distinct values, which bound the state of the aggregate."""
    q = F.percentile("n_faces", [0.25, 0.5, 0.75])
    return counts.groupBy(*(by or [])).agg(q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"))


def by_year(counts: DataFrame, year: Column) -> DataFrame:
    """Images, those with faces, faces, and their ratios per year."""
    return counts.withColumn("year", year).where("year is not null").groupBy("year").agg(
        F.count("*").alias("images"),
        F.count_if(F.col("n_faces") > 0).alias("with_faces"),
        F.sum("n_faces").alias("faces"),
        F.round(F.count_if(F.col("n_faces") > 0) / F.count("*"), 6).alias("coverage"),
        F.round(F.sum("n_faces") / F.count("*"), 6).alias("avg_faces"),
    )


def year_tool_cube(faces: DataFrame) -> DataFrame:
    """Faces per year and tool, with all subtotals (nulls)."""
    return faces.cube("year", "tool").agg(F.count("*").alias("faces"), F.countDistinct("media_id").alias("images"))


def overview(coverage: DataFrame) -> DataFrame:
    """Images, sidecars, and tool coverage of a table with has_sidecar, has_scrfd and has_arcface."""
    return coverage.agg(
        F.count("*").alias("images"),
        F.count_if("has_sidecar").alias("sidecars"),
        F.round(F.count_if("has_sidecar") / F.greatest(F.count("*"), F.lit(1)), 6).alias("coverage"),
        F.sum("has_scrfd").alias("scrfd_images"),
        F.sum("has_arcface").alias("arcface_images"),
    )


def tool_overview(media: DataFrame, done: DataFrame, faces: DataFrame) -> DataFrame:
    """A row for every tool in done (media_id, tool): images, those with a sidecar and their share, images the tool has
    processed, its faces (media_id, tool), and faces per processed image. Images outside of media do not count."""
    own = media.select("media_id").distinct()
    total = media.agg(F.count("*").alias("images"), F.count_if("has_sidecar").alias("sidecars"))
    processed = done.select("media_id", "tool").distinct().join(own, "media_id", "left_semi").groupBy("tool").agg(F.count("*").alias("tool_images"))
    found = faces.join(own, "media_id", "left_semi").groupBy("tool").agg(F.count("*").alias("faces"))
    out = processed.join(found, "tool", "left").join(F.broadcast(total))  # one row
    n = F.coalesce("faces", F.lit(0))
    return out.select(
        "tool", "images", "sidecars", F.round(F.col("sidecars") / F.greatest("images", F.lit(1)), 6).alias("coverage"), "tool_images", n.alias("faces"), F.round(n / F.col("tool_images"), 6).alias("avg_faces")
    )


def tool_coverage(media: DataFrame, done: DataFrame, tools: list[str]) -> DataFrame:
    """Images with and without each tool: counts of the done pairs against one count of images, no pairing of images
    with tools. Pairs of images that are not in media do not count."""
    total = media.agg(F.count("*").alias("images"))
    own = done.select("media_id", "tool").distinct().join(media.select("media_id"), "media_id", "left_semi")
    per = own.where(F.col("tool").isin(*tools)).groupBy("tool").agg(F.count("*").alias("n"))
    names = media.sparkSession.createDataFrame([(t,) for t in tools], "tool string")
    return names.join(per, "tool", "left").join(F.broadcast(total)).select("tool", F.coalesce("n", F.lit(0)).alias("with_tool"), (F.col("images") - F.coalesce("n", F.lit(0))).alias("without_tool"))


def coverage_gaps(media: DataFrame, done: DataFrame) -> DataFrame:
    """Media without a row in done."""
    return media.join(done.select("media_id"), "media_id", "left_anti")


def covered(media: DataFrame, done: DataFrame) -> DataFrame:
    return media.join(done.select("media_id"), "media_id", "left_semi")


def identities(labelled: DataFrame) -> DataFrame:
    """Faces, photos, share of all faces, and first and last photo of every cluster; noise is the cluster -1."""
    per = labelled.groupBy("cluster_label").agg(
        F.count("*").alias("faces"), F.countDistinct("media_id").alias("photos"), F.min("media_id").alias("first_photo"), F.max("media_id").alias("last_photo")
    )
    total = labelled.agg(F.count("*").alias("all"))
    return per.join(F.broadcast(total)).withColumn("share", F.round(F.col("faces") / F.col("all"), 6)).drop("all")


def largest_identities(labelled: DataFrame, k: int) -> DataFrame:
    """The k largest clusters, noise left out."""
    return identities(labelled.where("cluster_label <> -1")).orderBy(F.desc("faces"), "cluster_label").limit(k)


def labels_by_image(labelled: DataFrame) -> DataFrame:
    """(media_id, labels in the order of faces, num_clusters without noise)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("face_index", "cluster_label"))), lambda x: x["cluster_label"])
    grouped = labelled.groupBy("media_id").agg(ordered.alias("labels"))
    return grouped.withColumn("num_clusters", F.size(F.array_except(F.array_distinct("labels"), F.array(F.lit(-1)))))


def label_entries(labelled: DataFrame, embedding_tool: str, at: Column, seq: Column) -> DataFrame:
    """Patch entries that write the labels of (scar_path, face_index, cluster_label) back: the list in the order of faces
    and the number of clusters, under the cluster tool of the embeddings."""
    images = labels_by_image(labelled.select(F.col("scar_path").alias("media_id"), "face_index", "cluster_label")).select(F.col("media_id").alias("scar_path"), F.to_json("labels").alias("labels"), "num_clusters")
    return sidecar.tool_patch(images, catalog.CLUSTER_OF[embedding_tool], ["labels", "num_clusters"], at, seq)


def cluster_summary(labelled: DataFrame, embedding_tool: str, dim: Column) -> DataFrame:
    """One row: status, faces, embedding_dim, clusters without noise, updated_sidecars, tool."""
    return labelled.agg(
        F.count("*").alias("faces"), F.max(dim).alias("embedding_dim"), F.countDistinct(F.when(F.col("cluster_label") != -1, F.col("cluster_label"))).alias("clusters"), F.countDistinct("media_id").alias("updated_sidecars")
    ).select(F.when(F.col("faces") > 0, "ok").otherwise("no_embeddings").alias("status"), "faces", "embedding_dim", "clusters", "updated_sidecars", F.lit(embedding_tool).alias("embedding_tool"))


def label_counts(decoded: DataFrame) -> DataFrame:
    """Faces per dominant label, with the mean of their best score."""
    return decoded.groupBy("label").agg(F.count("*").alias("faces"), F.round(F.avg("score"), 4).alias("mean_score"))


def score_means(decoded: DataFrame) -> DataFrame:
    """Mean of every label's score over all faces that have one, from maps of scores by label."""
    return decoded.select(F.explode("scores").alias("label", "score")).groupBy("label").agg(F.count("score").alias("faces"), F.round(F.avg("score"), 4).alias("mean_score"))


def live_share(decoded: DataFrame) -> DataFrame:
    """Faces with a verdict, live ones, and their share, per tool; null verdicts do not count."""
    live = F.count_if("is_live")
    return decoded.where("is_live is not null").groupBy("tool").agg(F.count("*").alias("faces"), live.alias("live"), F.round(live / F.count("*"), 6).alias("live_share"))


def job_summary(jobs: DataFrame) -> DataFrame:
    """Jobs by status, and processed ones with their faces."""
    return jobs.agg(
        F.count("*").alias("jobs"), F.count_if(F.col("status") == "ok").alias("processed"), F.sum(F.when(F.col("status") == "ok", F.col("face_count")).otherwise(0)).alias("faces"), F.count_if(F.col("status") == "failed").alias("failed")
    )


def recent_failures(jobs: DataFrame, now: Column, limit: int = 10, keep_seconds: int = 86400) -> DataFrame:
    """The newest failures of the last day, so many at most."""
    age = now.cast("long") - F.col("at").cast("long")
    return jobs.where((F.col("status") == "failed") & (age < keep_seconds) & (age >= 0)).orderBy(F.desc("at"), "job_id").limit(limit)


def write_results(jobs: DataFrame, path: str) -> None:
    """Append job results to a table of Parquet files."""
    jobs.write.mode("append").parquet(path)
