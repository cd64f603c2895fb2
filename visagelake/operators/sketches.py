"""Sketches of faces per photo and of images, kept per group and merged for any coarser one without reading images again."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameters: quantiles within RANK_ERROR of the rank, distinct counts within COUNT_ERROR (three standard errors).
KLL_K, RANK_ERROR = 200, 0.0265
HLL_LG_K, COUNT_ERROR = 12, 0.05


def sketched(counts: DataFrame, by: list[str], value: str = "n_faces", of: str = "media_id") -> DataFrame:
    """(by.., images, values, ids): rows per group, a quantile sketch of value and a distinct-count sketch of the ids.

    Partial aggregates build the sketches on the map side, so that a hot group ships one sketch a task. Null values and
    ids are in neither sketch; a group of nulls alone has empty sketches. A null group is a group.
    """
    return counts.groupBy(*by).agg(
        F.count("*").alias("images"), F.kll_sketch_agg_bigint(F.col(value).cast("long"), KLL_K).alias("values"), F.hll_sketch_agg(F.col(of), HLL_LG_K).alias("ids")
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of sketched() merged into coarser groups; by may be empty."""
    return sketches.groupBy(*by).agg(F.sum("images").alias("images"), F.kll_merge_agg_bigint("values", KLL_K).alias("values"), F.hll_union_agg("ids").alias("ids"))


def estimates(sketches: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """Sketches with `distinct` and a column of the value at each named rank; null where nothing was sketched."""
    some = F.kll_sketch_get_n_bigint("values") > 0
    at = {name: F.when(some, F.kll_sketch_get_quantile_bigint("values", F.lit(float(rank)))) for name, rank in ranks.items()}
    return sketches.withColumns({"distinct": F.hll_sketch_estimate("ids"), **at}).drop("values", "ids")


def rank_range(counts: DataFrame, estimated: DataFrame, by: list[str], ranks: dict[str, float], value: str = "n_faces") -> DataFrame:
    """(by.., <name>_below, <name>_up_to): exact shares of values below, and not above, each estimated quantile, with which an
    estimate can be held against its bound."""
    joined = counts.join(estimated.select(*by, *ranks), by)
    shares = [F.avg((F.col(value) < F.col(n)).cast("int")).alias(f"{n}_below") for n in ranks] + [F.avg((F.col(value) <= F.col(n)).cast("int")).alias(f"{n}_up_to") for n in ranks]
    return joined.groupBy(*by).agg(*shares)
