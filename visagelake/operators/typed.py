"""Typed entries: values as VARIANT in place of JSON text, kept by merges and stored tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visagelake.operators import sidecar


def typed(entries: DataFrame) -> DataFrame:
    """Entries whose values are variants: what is JSON as its own type, any other text as a string, null as null."""
    value = F.col("entry_value")
    return entries.withColumn("entry_value", F.coalesce(F.try_parse_json(value), value.cast("variant")))


def field(entries: Column, tool: str, name: str, path: str, kind: str) -> Column:
    """A value inside a tool's field by path and type; null where the field or path is missing or is of another kind."""
    return F.try_variant_get(sidecar.read_field(entries, tool, name), path, kind)


def kinds(entries: DataFrame) -> DataFrame:
    """(entry_key, kind): the schema that the values of each key have in common."""
    return entries.groupBy("entry_key").agg(F.schema_of_variant_agg("entry_value").alias("kind"))


def inspect_summary(entries: DataFrame) -> DataFrame:
    """sidecar.inspect_summary() of typed entries: lists of embeddings and faces by their length, others as text."""
    value = F.col("entry_value")
    items = F.size(F.try_variant_get(value, "$", "array<variant>"))
    shown = F.when(F.col("field").isin("embeddings", "faces") & items.isNotNull(), F.concat(items, F.lit(" item(s)"))).otherwise(F.try_variant_get(value, "$", "string"))
    return sidecar.by_tool(entries).select("scar_path", "tool", "field", shown.alias("shown"))
