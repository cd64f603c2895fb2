"""Sidecar documents: entries (scar_path, entry_key, entry_value, written_at, seq) merged per image, and views of them."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visagelake.functions import catalog, paths

KEY = ["scar_path", "entry_key"]


def latest(entries: DataFrame) -> DataFrame:
    """The last value of every key of every document: by time, then sequence. Partial aggregation, no sort of the log."""
    last = F.max_by(F.struct("entry_value", "written_at", "seq"), F.struct("written_at", "seq")).alias("last")
    return entries.groupBy(*KEY).agg(last).select(*KEY, "last.entry_value", "last.written_at", "last.seq")


def merge(base: DataFrame, *patches: DataFrame) -> DataFrame:
    """Base entries with patches of any namespaces merged in; keys that no patch names stay."""
    return latest(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [base, *patches]))


def tool_patch(results: DataFrame, tool: str, fields: list[str], at: Column, seq: Column) -> DataFrame:
    """Patch rows of a tool's results (scar_path, fields..): its version, the time, and every field as text."""
    values = [("version", F.lit(catalog.VERSIONS[tool])), ("processed_at", paths.iso_utc(at)), *((f, F.col(f).cast("string")) for f in fields)]
    pairs = F.array(*(F.struct(paths.tool_key(tool, f).alias("k"), v.alias("v")) for f, v in values))
    return results.select("scar_path", F.explode(pairs).alias("p"), at.alias("written_at"), seq.alias("seq")).select(
        "scar_path", F.col("p.k").alias("entry_key"), F.col("p.v").alias("entry_value"), "written_at", "seq"
    )


def documents(entries: DataFrame) -> DataFrame:
    """(scar_path, entries map) of merged entries."""
    return entries.groupBy("scar_path").agg(F.map_from_entries(F.collect_list(F.struct("entry_key", "entry_value"))).alias("entries"))


def with_documents(media: DataFrame, docs: DataFrame) -> DataFrame:
    """Media (path) with their documents; those without one get the default document that names the image."""
    default = F.create_map(F.lit("_media.basename"), paths.name_of(F.col("path")))
    return media.withColumn("scar_path", paths.sidecar_path(F.col("path"))).join(docs, "scar_path", "left").withColumn("entries", F.coalesce("entries", default))


def has_tool(entries: Column, tool: str) -> Column:
    """Whether a tool has run, with or without faces: its version is there."""
    return F.map_contains_key(entries, f"{paths.KEY_PREFIX}{tool}.version")


def read_field(entries: Column, tool: str, field: str) -> Column:
    return F.try_element_at(entries, F.lit(f"{paths.KEY_PREFIX}{tool}.{field}"))


def section(entries: Column, tool: str) -> Column:
    """A tool's fields, without the prefix."""
    prefix = f"{paths.KEY_PREFIX}{tool}."
    return F.transform_keys(F.map_filter(entries, lambda k, _: k.startswith(prefix)), lambda k, _: F.substring(k, len(prefix) + 1, 1 << 20))


def tools_of(entries: Column) -> Column:
    """Sorted names of the tools with a field."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.map_keys(entries), paths.key_tool))))


def by_tool(entries: DataFrame) -> DataFrame:
    """Entries of tools with their tool and field."""
    key = F.col("entry_key")
    return entries.withColumns({"tool": paths.key_tool(key), "field": paths.key_field(key)}).where("tool is not null")


def inspect_json(entries: DataFrame) -> DataFrame:
    """(scar_path, json): the sidecar's path and the fields of its tools, both sorted."""
    fields = by_tool(entries).groupBy("scar_path", "tool").agg(F.array_sort(F.collect_list(F.struct("field", "entry_value"))).alias("f"))
    listed = fields.groupBy("scar_path").agg(F.array_sort(F.collect_list(F.struct("tool", "f"))).alias("t"))
    tools = listed.select("scar_path", F.map_from_entries(F.transform("t", lambda t: F.struct(t["tool"], F.map_from_entries(t["f"])))).alias("tools"))
    return tools.select("scar_path", F.to_json(F.struct(F.col("scar_path").alias("sidecar"), "tools")).alias("json"))


def inspect_summary(entries: DataFrame) -> DataFrame:
    """(scar_path, tool, field, shown): lists of embeddings and faces as counts, anything else as its value."""
    items = F.json_array_length("entry_value")
    shown = F.when(F.col("field").isin("embeddings", "faces") & items.isNotNull(), F.concat(items, F.lit(" item(s)"))).otherwise(F.col("entry_value"))
    return by_tool(entries).select("scar_path", "tool", "field", shown.alias("shown"))


def media_of_sidecar(docs: DataFrame, media: DataFrame) -> DataFrame:
    """(scar_path, path) of each document's image: the one it names in its directory, else the first of its stem in
    the order of extensions; null without either."""
    own = docs.select("scar_path", F.concat_ws("/", paths.dir_of(F.col("scar_path")), F.try_element_at("entries", F.lit("_media.basename"))).alias("named"))
    suffix = F.lower(paths.suffix_of(F.col("path")))
    rank = F.array_position(F.array(*map(F.lit, paths.IMAGE_EXTENSIONS)), suffix)
    images = media.where(paths.is_image(F.col("path"))).select("path", rank.alias("rank"), paths.sidecar_path(F.col("path")).alias("scar_path"))
    stems = images.groupBy("scar_path").agg(F.min(F.struct("rank", "path")).alias("first"))
    named = images.select(F.col("path").alias("named"), F.col("path").alias("exact")).distinct()
    return own.join(named, "named", "left").join(stems, "scar_path", "left").select("scar_path", F.coalesce("exact", "first.path").alias("path"))
