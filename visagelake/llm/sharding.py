"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Equal texts have one place on the ring. Every shard owns `vnodes` places; a key belongs to the first one clockwise.
No shard takes more than its share of the rows: keys that find it full go on clockwise to the next shard with room,
so counts differ by one at most while only the overflow moves. Where the loads go is settled on counts per arc of the
ring (shards x vnodes rows, whatever the input); rows are numbered inside arcs, large arcs in several parts.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visagelake.operators import tables

#: The ring has this many cells; a cell's keys share an arc.
CELLS = 1 << 16


def cell(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 48).cast("int")


def ring(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; where two share a cell, the one with the lower shard has it."""
    nodes = spark.range(shards * vnodes).select(
        cell(F.concat_ws(":", F.lit("node"), F.col("id"))).alias("cell"), F.floor(F.col("id") / vnodes).cast("int").alias("shard")
    )
    return sorted((r.cell, r.shard) for r in nodes.groupBy("cell").agg(F.min("shard").alias("shard")).collect())


def place(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Settle the loads: pieces (arc, from rank, to rank, shard, first slot).

    Arcs offer their rows to their own shard in ring order; what is left over then goes on clockwise, again in
    ring order. Every split of an arc fills a shard, so there are fewer than arcs + shards pieces.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    pieces, left = [], []

    def put(arc: int, lo: int, hi: int, shard: int) -> int:
        take = min(room[shard] - used[shard], hi - lo)
        if take > 0:
            pieces.append((arc, lo, lo + take, shard, used[shard]))
            used[shard] += take
        return lo + max(take, 0)

    for arc, (_, shard) in enumerate(nodes):
        n = counts.get(arc, 0)
        if (lo := put(arc, 0, n, shard)) < n:
            left.append((arc, lo, n))
    for arc, lo, hi in left:
        for step in range(1, len(nodes) + 1):
            if (lo := put(arc, lo, hi, nodes[(arc + step) % len(nodes)][1])) == hi:
                break
        for shard in range(shards):  # a shard whose virtual nodes all lost their cells
            lo = put(arc, lo, hi, shard)
    return pieces


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A bounded table of numbers settled on the driver, read by the JVM."""
    fields = [f.split() for f in schema.split(", ")]
    text = json.dumps([dict(zip((n for n, _ in fields), r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{n}: {t}' for n, t in fields)}>>")))


def arcs_of(spark: SparkSession, nodes: list[tuple[int, int]]) -> DataFrame:
    """(cell, arc) for all CELLS cells: the arc that ends at the first virtual node at the cell or clockwise after it."""
    ends = table(spark, [(c, 1) for c, _ in nodes], "cell int, ends int")
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(F.broadcast(ends), "cell", "left")
    passed = F.sum(F.coalesce("ends", F.lit(0))).over(Window.orderBy("cell")) - F.coalesce("ends", F.lit(0))
    return cells.select("cell", (passed % len(nodes)).cast("int").alias("arc"))


def assign(docs: DataFrame, shards: int = 40, vnodes: int = 64, part_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards 0 to shards - 1 for all rows, counts at most one apart.

    Returns (id_col, size, text_crc32, law, shard, slot, grown_shard), one row per input row; size is the bytes of the
    text plus 16, slots are gapless from 0 in a shard, grown_shard is null (the law is `rows`, not `key`). A null text
    counts as an empty one, a null id is placed like any other, and other columns are not carried. Rows of one id and
    text are dealt as one with a count, and get slots of their own. Ties on the ring go by id, then size. part_rows: rows
    of an arc that are numbered together, about; larger arcs are dealt by id, and a row that repeats more often is
    written out in runs of so many.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("key"),
    )
    rows = tables.save(rows.groupBy("id", "size", "crc", "key").agg(F.count("*").alias("copies")).withColumn("cell", F.shiftrightunsigned("key", 48).cast("int")), "ring")
    nodes = ring(spark, shards, vnodes)
    placed = rows.join(F.broadcast(tables.save(arcs_of(spark, nodes), "cells")), "cell")  # CELLS rows
    counts = tables.save(placed.groupBy("arc").agg(F.sum("copies").alias("n")), "arcs")  # shards x vnodes rows
    pieces = table(spark, place({r.arc: r.n for r in counts.collect()}, nodes, shards), "arc int, lo bigint, hi bigint, shard int, first bigint")
    parts = counts.select("arc", F.ceil(F.col("n") / part_rows).alias("parts"))
    dealt = placed.join(F.broadcast(parts), "arc").withColumn("part", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int"))
    before = dealt.groupBy("arc", "part").agg(F.sum("copies").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("arc").orderBy("part")) - F.col("n")
    )
    order = Window.partitionBy("arc", "part").orderBy("key", "id", "size", "crc")
    inside = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    ranked = dealt.withColumn("inside", inside).join(before.drop("n"), ["arc", "part"]).withColumn("from", F.col("before") + F.col("inside"))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / part_rows)))
    many = ranked.where(F.col("copies") > 1).withColumn("run", run).repartition("key", "id", "run")
    until = F.least(F.col("copies"), (F.col("run") + 1) * part_rows) - 1
    many = many.withColumn("copy", F.explode(F.sequence(F.col("run") * part_rows, until))).withColumn("rank", F.col("from") + F.col("copy"))
    kept = ("id", "size", "crc", "arc", "rank")
    ranked = ranked.where(F.col("copies") == 1).withColumn("rank", F.col("from")).select(*kept).unionByName(many.select(*kept))
    within = (F.col("d.arc") == F.col("p.arc")) & (F.col("d.rank") >= F.col("p.lo")) & (F.col("d.rank") < F.col("p.hi"))
    return ranked.alias("d").join(F.broadcast(pieces.alias("p")), within).select(  # fewer than shards x (vnodes + 1) rows
        F.col("d.id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
