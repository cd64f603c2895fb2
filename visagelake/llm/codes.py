"""Codes of embeddings: vectors of whole numbers cut into parts, each part named by the nearest entry of its codebook.

The codebooks are settled in rounds over all vectors. A task finds the nearest entry of every part by equal averages:
entries are sorted by the sum of their components, the search begins at the part's own sum and goes outward to both
sides, and a side ends once the squared gap of the sums, divided by the dimension, exceeds the best distance so far,
since no entry beyond can be nearer (Cauchy-Schwarz). Only sums and counts per entry leave a task.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visagelake.llm._arrow import slices
from visagelake.operators import tables

SCALE = 4096
#: Largest size of a component; distances and sums then fit 64 bits.
LARGEST = 1 << 14
#: Components handled together.
TOGETHER = 1 << 20
#: Labels up to which their errors are broadcast; beyond, rows and labels meet in so many pieces a label.
LABELS, PIECES = 100_000, 32


def whole(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the vectors without null, infinite or undefined components, as whole numbers."""
    vector = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", finite)).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row, the lower one of equals, and its squared distance."""
    n, width = parts.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    ranked, own = sums[order], parts.sum(axis=1)
    best = np.full(n, np.iinfo(np.int64).max // max(width, 1))
    index = np.full(n, len(entries))
    start = np.searchsorted(ranked, own)

    def look(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of these rows, compare those that the entry at their place can still serve; true for those."""
        gap = own[rows] - ranked[places]
        near = gap * gap <= best[rows] * width
        rows, picks = rows[near], order[places[near]]
        apart = parts[rows] - entries[picks]
        distance = (apart * apart).sum(axis=1)
        better = (distance < best[rows]) | (distance == best[rows]) & (picks < index[rows])
        best[rows[better]], index[rows[better]] = distance[better], picks[better]
        return near

    below, above = np.flatnonzero(start > 0), np.flatnonzero(start < len(entries))
    step = 0
    while len(below) or len(above):
        below = below[look(below, start[below] - 1 - step)]
        above = above[look(above, start[above] + step)]
        step += 1
        below, above = below[start[below] > step], above[start[above] + step < len(entries)]
    return index, best


def vectors_of(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def averaged(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) with every entry that is nearest to some part replaced by those parts' average."""
    parts, many, width = books.shape

    def totals(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, many, width), dtype=np.int64), np.zeros((parts, many), dtype=np.int64)
        for batch in (part for whole in found for part in slices(whole, 0, TOGETHER)):
            v = vectors_of(batch.column(0))
            for p in range(parts):
                own = v[:, p * width : (p + 1) * width]
                index, _ = nearest(own, books[p])
                np.add.at(sums[p], index, own)
                counts[p] += np.bincount(index, minlength=many)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = rows.select("v").mapInArrow(totals, "part bigint, entry bigint, n bigint, sums array<bigint>")
    added = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # a row an entry
        out[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(width)]
    return out


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of rows (id, label, v)."""
    parts, _, width = books.shape

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 2, TOGETHER)):
            v = vectors_of(batch.column(2))
            index, error = np.zeros((len(v), parts), dtype=np.uint8), np.zeros(len(v), dtype=np.int64)
            for p in range(parts):
                index[:, p], distance = nearest(v[:, p * width : (p + 1) * width], books[p])
                error += distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.tobytes().hex() for i in index]), pa.array(error)], names=["id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.select("id", "label", "v").mapInArrow(batches, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def with_label_error(found: DataFrame) -> DataFrame:
    """found with the sum of error over the rows of its label, null being a label as well; a label of any size is summed
    before it is sent, and its rows are not brought together."""
    sums = tables.save(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= LABELS:
        return found.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    piece: Column = F.pmod(F.xxhash64("id", "code"), F.lit(PIECES))
    dealt = sums.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    return found.join(dealt, F.col("label").eqNullSafe(F.col("of")) & (piece == F.col("piece"))).drop("of", "piece")


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes of all vectors: (id_col, code, error, label_error, codebooks_sha256), one row per vector that is kept.

    Rows whose vector is null or has a null, infinite or undefined component are left out. Codebooks start from the
    vectors of the smallest ids, equal ids by vector, null ids last; fewer vectors than entries give fewer entries. Ties go to
    the lower entry; equal vectors have equal codes. A null id is coded like any other; null labels are one label. An
    empty table has no rows; other columns are not carried. Vectors of different lengths, of a length that the parts do
    not divide, or with components beyond LARGEST fail, as their codes would have no meaning. At most 256 entries.
    """
    rows = tables.save(whole(embeddings, id_col, vector_col, label_col), "vectors")
    found = rows.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.max(F.greatest(-F.array_min("v"), F.array_max("v"))).alias("most")).first()
    if found.a != found.b or (found.a or 0) % parts or (found.most or 0) > LARGEST * SCALE or entries > 256:
        raise ValueError(f"{found.a} to {found.b} components of up to {found.most} / {SCALE} cannot be coded in {parts} parts of {entries} entries")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    width = (found.a or 0) // parts
    books = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), parts, width).swapaxes(0, 1)
    for _ in range(rounds if first else 0):
        books = averaged(rows, books)
    out = with_label_error(tables.save(coded(rows, books), "codes"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL of compress() for the embeddings table."""
    apart = f"CAST(list_sum(list_transform(p.x, lambda v, i: (v - b.x[i]) * (v - b.x[i]))) AS BIGINT) * {entries} + b.entry"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.row, p.part, p.x, min({apart}) AS best FROM p JOIN b{r} b ON b.part = p.part GROUP BY p.row, p.part, p.x)")
        if r < rounds:
            steps.append(
                f"u{r} AS (SELECT part, best % {entries} AS entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{r}),\n"
                f"n{r} AS (SELECT part, entry, list(c ORDER BY i) AS x FROM (SELECT part, entry, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS c FROM u{r} GROUP BY part, entry, i) GROUP BY part, entry),\n"
                f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN n{r} n ON n.part = b.part AND n.entry = b.entry)"
            )
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, vec_id, label, v FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT row, part, v[CAST(part * len(v) // {parts} + 1 AS BIGINT) : CAST((part + 1) * len(v) // {parts} AS BIGINT)] AS x FROM k, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {entries}),
{", ".join(steps)},
c AS (SELECT row, string_agg(lower(printf('%02x', best % {entries})), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
d AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) AS digest FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM k JOIN c ON c.row = k.row, d"""
