"""Discovery of images and the plan of the work that is still missing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visagelake.functions import catalog, paths


def images(files: DataFrame, exclude_outputs: bool = False) -> DataFrame:
    """Rows of a table of paths that are images; exclude_outputs also leaves out annotated ones."""
    found = files.where(paths.is_image(F.col("path")))
    return found.where(~paths.is_annotated(F.col("path"))) if exclude_outputs else found


def work_plan(media: DataFrame, tools: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """(media_id, path, tool) still to run: every image with every tool, without what is done.

    done has (scar_path, tool); images of one stem share a sidecar and so are done together. Images meet the list of
    what their sidecar has, so the shuffle does not grow with the number of tools.
    """
    wanted = tools.agg(F.array_sort(F.collect_set("tool")).alias("wanted"))  # one row, a name for each tool of the catalogue or the request
    images_ = media.select("media_id", "path", paths.sidecar_path(F.col("path")).alias("scar_path"))
    if not force:
        has = done.groupBy("scar_path").agg(F.collect_set("tool").alias("has"))
        images_ = images_.join(has, "scar_path", "left")
    open_ = F.col("wanted") if force else F.array_except("wanted", F.coalesce("has", F.array().cast("array<string>")))
    return images_.crossJoin(F.broadcast(wanted)).select("media_id", "path", F.explode(open_).alias("tool"))


def backend_jobs(plan: DataFrame) -> DataFrame:
    """(media_id, backend_group, tools) of a plan: a job per image and group of tools."""
    group = F.create_map(*[F.lit(x) for kv in catalog.BACKENDS.items() for x in kv])
    return plan.withColumn("backend_group", group[F.col("tool")]).where("backend_group is not null").groupBy("media_id", "backend_group").agg(F.array_sort(F.collect_set("tool")).alias("tools"))


def scan_stats(media: DataFrame, pending: Column) -> DataFrame:
    """Images discovered, enqueued and skipped per directory."""
    return media.groupBy("dir").agg(F.count("*").alias("discovered"), F.count_if(pending).alias("enqueued"), F.count_if(~pending).alias("skipped"))


def scan_stats_rollup(media: DataFrame, pending: Column, parts: int) -> DataFrame:
    """The same for every ancestor directory down to so many parts, and for the whole tree (all parts null)."""
    names = [f"part{i}" for i in range(1, parts + 1)]
    cut = F.split(F.ltrim(F.col("dir"), F.lit("/")), "/")
    split = media.withColumns({n: F.get(cut, F.lit(i)) for i, n in enumerate(names)}).withColumn("pending", pending)
    return split.rollup(*names).agg(F.count("*").alias("discovered"), F.count_if("pending").alias("enqueued"), F.count_if(~F.col("pending")).alias("skipped"))


def subdirectories(media: DataFrame) -> DataFrame:
    """(dir, subdirs): directories right below each one."""
    below = media.select("dir").distinct().select(paths.dir_of(F.col("dir")).alias("dir"), F.col("dir").alias("sub"))
    return below.groupBy("dir").agg(F.countDistinct("sub").alias("subdirs"))


def without_outputs(media: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Images whose annotated image is not among outputs (path)."""
    if force:
        return media
    made = outputs.select(F.col("path").alias("output")).distinct()
    return media.withColumn("output", paths.annotated_path(F.col("path"))).join(made, "output", "left_anti").drop("output")
