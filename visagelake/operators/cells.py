"""Exact nearest neighbours of unit vectors by cells.

Every vector belongs to the nearest of at most CELLS centres and lies at a known distance from it. A cell with many
vectors is cut into RINGS by that distance; a unit is a cell or a ring of one, and big units are dealt into pieces of
bounded size. All distances of a unit's vectors to a point lie between the unit's nearest and farthest, by the triangle
inequality: a face meets its own piece first, and then only those units that could hold a nearer neighbour than its k-th.
Faces ask in blocks, about BLOCKS of them while a block's vectors take BLOCK_BYTES at most: a task keeps a block and the best
of each of its faces, and the other faces pass by in batches, each sent once to a block. What is shuffled so grows as the
faces do, up to BLOCKS * BLOCK_BYTES of vectors. The centres come from a bounded sample; they decide how much is skipped, never what is found.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from visagelake.operators import tables

KEY = ["media_id", "face_index"]
#: Bounds of what the driver and every task hold: centres, rings of a cell, and sampled vectors a cell.
CELLS, RINGS, SAMPLE = 1024, 16, 16
#: Distances closer than this count as equal when units are skipped; rounding stays far below.
SLACK = 1e-6
#: Rows of a batch whose distances to all units are held at once.
BATCH = 256
#: Blocks of asking faces, bytes of a block's vectors, and slices of the answers that each block meets in tasks of their own.
BLOCKS, BLOCK_BYTES, SLICES = 16, 32 << 20, 4
#: Asking and answering faces whose similarities are held at once, and pairs of them that are scored again.
ASKING, ANSWERS, AGAIN = 4096, 2048, 50_000


@dataclass
class Units:
    """Bounds of all units, CELLS * RINGS at most: cell and ring, nearest and farthest vector from the centre, rows, pieces."""

    centres: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(u, int(c), int(r), int(p)) for u, (c, r, p) in enumerate(zip(self.cell, self.ring, self.pieces, strict=True))]
        return spark.createDataFrame(rows, "unit int, cell int, ring int, pieces int")

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """Least distance of every vector to the vectors of every unit."""
        to = distances(vectors, self.centres)[:, self.cell]
        return np.maximum(np.maximum(to - self.hi, self.lo - to), 0)


def distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (vectors**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * vectors @ centres.T
    return np.sqrt(np.maximum(squared, 0))


def centres_of(faces: DataFrame, block_rows: int, rounds: int = 5) -> np.ndarray:
    """Up to CELLS centres, one for about block_rows faces: k-means on SAMPLE faces a cell, taken by hash of their key."""
    total = faces.count()
    many = min(CELLS, max(1, total // block_rows))
    want = many * SAMPLE
    taken = faces.where(F.pmod(F.xxhash64(*KEY, F.lit(1)), F.lit(max(total, 1))) < want).select("embedding").limit(2 * want)
    x = np.array([r.embedding for r in taken.collect()], dtype=np.float64)
    if many == 1 or len(x) <= many:
        return x[:many] if len(x) else np.zeros((1, 1))
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), many, replace=False)]
    for _ in range(rounds):
        own = distances(x, centres).argmin(axis=1)
        for c in np.unique(own):
            centres[c] = x[own == c].mean(axis=0)
    return centres


def packed(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """Vectors of a column of bytes, or of lists."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    return np.frombuffer(b"".join(values.to_pylist()), dtype=np.float64).reshape(len(values), -1)


@F.pandas_udf(T.BinaryType())
def as_bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.asarray(v, dtype=np.float64).tobytes())


def placed(faces: DataFrame, centres: np.ndarray) -> DataFrame:
    """(media_id, face_index, packed, cell, r): faces with the nearest centre and its distance; vectors as bytes, read back by packed()."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if batch.num_rows:
                x = packed(batch, 2)
                to = distances(x, centres)
                cell = to.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x]), pa.array(cell.astype(np.int32)), pa.array(to[np.arange(len(x)), cell])], names=[*KEY, "packed", "cell", "r"])

    return faces.select(*KEY, "embedding").mapInArrow(batches, "media_id bigint, face_index int, packed binary, cell int, r double")


def ringed(rows: DataFrame, block_rows: int) -> DataFrame:
    """rows (cell, r) with their ring: cells of several times block_rows rows are cut at quantiles."""
    cuts = F.percentile_approx("r", [k / RINGS for k in range(1, RINGS)], 1000)
    found = rows.groupBy("cell").agg(cuts.alias("cuts"), F.least(F.lit(RINGS), F.greatest(F.lit(1), F.floor(F.count("*") / block_rows))).alias("rings"))
    ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("r"))) * F.col("rings") / RINGS).cast("int")
    return rows.join(F.broadcast(tables.save(found, "cuts")), "cell").withColumn("ring", ring).drop("cuts", "rings")  # CELLS rows


def units_of(ringed_rows: DataFrame, centres: np.ndarray, block_rows: int) -> Units:
    """The units of rows (cell, ring, r)."""
    found = ringed_rows.groupBy("cell", "ring").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).collect()  # CELLS * RINGS rows
    found.sort(key=lambda r: (r.cell, r.ring))
    column = lambda name, kind: np.array([r[name] for r in found], dtype=kind)
    n = column("n", np.int64)
    return Units(centres, column("cell", np.int64), column("ring", np.int64), column("lo", float), column("hi", float), n, -(-n // block_rows))


def dealt(ringed_rows: DataFrame, units: Units) -> DataFrame:
    """rows with their unit and piece."""
    table = F.broadcast(units.table(ringed_rows.sparkSession))  # CELLS * RINGS rows
    return ringed_rows.join(table, ["cell", "ring"]).withColumn("piece", F.pmod(F.xxhash64(*KEY), F.col("pieces")).cast("int")).drop("pieces")


FOUND = "media_id bigint, face_index int, neighbour_media bigint, neighbour_face int, score double"


def best(k: int):
    """The k most similar faces for every face of a group that asks (role 0) among those that answer (role 1). Equal scores go by
    key; scores below what a face has already found k times are left out."""

    def meet(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        media, face, least, role = (part.column(c).to_numpy() for c in (*KEY, "least", "role"))
        x = np.frombuffer(b"".join(part.column("packed").to_pylist()), dtype=np.float64).reshape(part.num_rows, -1)
        held = Held(k, alike=False)
        held.ask(media[role == 0], face[role == 0], x[role == 0], least[role == 0])
        held.answer(media[role == 1], face[role == 1], x[role == 1])
        return pa.Table.from_batches([held.found()])

    return meet


class Held:
    """Asking faces with the best answers that they have met so far."""

    def __init__(self, k: int, alike: bool) -> None:
        self.k, self.alike, self.given, self.met = k, alike, [], 0

    def ask(self, media: np.ndarray, face: np.ndarray, x: np.ndarray, least: np.ndarray) -> None:
        self.given.append((media, face, x, least))

    def begin(self) -> None:
        self.media, self.face, self.x, self.least = (np.concatenate(c) for c in zip(*self.given, strict=True))
        self.given = []
        self.near = self.x.astype(np.float32)
        #: Of single precision, both vectors and their product rounded.
        self.slack = SLACK + 2.5e-7 * (self.x.shape[1] + 8)
        self.best = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def answer(self, media: np.ndarray, face: np.ndarray, y: np.ndarray, centre: np.ndarray | None = None, lo: float = 0.0, hi: float = 0.0) -> None:
        """Meet faces, of a unit if its centre is given: those that ask and can find no better ones in it are left out."""
        if self.given:
            self.begin()
        if not len(media) or not hasattr(self, "x"):
            return
        asking = np.arange(len(self.x))
        if centre is not None:
            to = distances(self.x, centre[None])[:, 0]
            asking = np.flatnonzero(np.maximum(to - hi, lo - to) <= np.sqrt(np.maximum(2 - 2 * self.least, 0)) + SLACK)
        for some in (asking[at : at + ASKING] for at in range(0, len(asking), ASKING)):
            for at in range(0, len(media), ANSWERS):
                self.compare(some, media[at : at + ANSWERS], face[at : at + ANSWERS], y[at : at + ANSWERS])

    def compare(self, some: np.ndarray, media: np.ndarray, face: np.ndarray, y: np.ndarray) -> None:
        self.met += len(some) * len(y)
        scores = self.near[some] @ y.astype(np.float32).T
        least = self.least[some] - self.slack
        hits = scores >= least[:, None].astype(np.float32)
        if len(y) > self.k + 1 and np.count_nonzero(hits) > 4 * (self.k + 1) * len(some):
            kth = np.partition(scores, len(y) - self.k - 1, axis=1)[:, len(y) - self.k - 1]  # one may be the face itself
            hits = scores >= np.maximum(kth - 2 * self.slack, least)[:, None].astype(np.float32)
        i, j = np.nonzero(hits)
        i = some[i]
        if self.alike:
            other = (self.media[i] != media[j]) | (self.face[i] != face[j])
            i, j = i[other], j[other]
        for at in range(0, len(i), AGAIN):
            self.keep(i[at : at + AGAIN], media[j[at : at + AGAIN]], face[j[at : at + AGAIN]], (self.x[i[at : at + AGAIN]] * y[j[at : at + AGAIN]]).sum(axis=1))

    def keep(self, i: np.ndarray, media: np.ndarray, face: np.ndarray, score: np.ndarray) -> None:
        """Add answers (face i, key, exact score) and keep the k best of those faces."""
        good = score >= self.least[i] - SLACK
        touched = np.zeros(len(self.x), dtype=bool)
        touched[i[good]] = True
        if not touched.any():
            return
        old = touched[self.best[0]]
        i, score, media, face = (np.concatenate([a[old], b[good]]) for a, b in zip(self.best, (i, score, media, face), strict=True))
        order = np.lexsort((face, media, -score, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        full = i[place == self.k - 1]
        self.least[full] = np.maximum(self.least[full], score[order][place == self.k - 1])
        kept = order[place < self.k]
        self.best = tuple(np.concatenate([a[~old], b]) for a, b in zip(self.best, (i[place < self.k], score[kept], media[kept], face[kept]), strict=True))

    def found(self) -> pa.RecordBatch:
        if self.given:
            self.begin()
        if not hasattr(self, "x"):
            return pa.RecordBatch.from_pydict({"media_id": pa.array([], pa.int64()), "face_index": pa.array([], pa.int32()), "neighbour_media": pa.array([], pa.int64()), "neighbour_face": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})
        i, score, media, face = self.best
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.media[i], self.face[i].astype(np.int32), media, face.astype(np.int32), score)], names=["media_id", "face_index", "neighbour_media", "neighbour_face", "score"])


def own_least(k: int):
    """The rows of a piece with the k-th best similarity to others of their piece, -1 where there are fewer."""

    def work(part: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(part.column("packed").to_pylist()), dtype=np.float64).reshape(part.num_rows, -1)
        least = np.full(len(x), -1.0)
        for at in range(0, len(x) if len(x) > k else 0, BATCH):
            scores = x[at : at + BATCH] @ x.T
            scores[np.arange(len(scores)), at + np.arange(len(scores))] = -np.inf
            least[at : at + BATCH] = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
        return part.append_column("least", pa.array(least - SLACK))

    return work


def meet(asking: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Neighbours for asking (key, packed, least, block, unit, piece) among rows (key, packed, unit, piece): the faces of a block
    and the rows of a piece make a group; pieces are sent once to each block that asks for them."""
    pairs = asking.select("block", "unit", "piece").distinct()
    answers = rows.join(pairs, ["unit", "piece"]).select(*KEY, "packed", F.lit(0.0).alias("least"), "block", "unit", "piece", F.lit(1).alias("role"))
    both = asking.select(*KEY, "packed", "least", "block", "unit", "piece", F.lit(0).alias("role")).unionByName(answers)
    return both.groupBy("block", "unit", "piece").applyInArrow(best(k), FOUND)


def aimed(asking: DataFrame, units: Units) -> DataFrame:
    """(block, unit): the units that may hold a face more similar than least to one of a block, of asking (packed, least, block)."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for batch in (whole.slice(k, BATCH) for k in range(0, whole.num_rows, BATCH)):
                reach = np.sqrt(np.maximum(2 - 2 * batch.column(1).to_numpy(), 0)) + SLACK
                row, unit = np.nonzero(units.bounds(packed(batch, 0)) <= reach[:, None])
                pairs = np.unique(np.stack([batch.column(2).to_numpy()[row], unit]), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["block", "unit"])

    return asking.select("packed", "least", "block").mapInArrow(batches, "block int, unit int").distinct()


def blocks_of(rows: int, components: int, block_rows: int) -> int:
    return max(1, min(BLOCKS, -(-rows // block_rows)), -(-rows * components * 8 // BLOCK_BYTES))


def few_equal(rows: DataFrame, most: int) -> DataFrame:
    """rows (key, packed, ..) without those that follow on `most` others of an equal vector, in the order of keys. Each task leaves out its own
    before vectors are shuffled, so that no task gets all rows of a frequent one."""
    place = F.row_number().over(Window.partitionBy("packed").orderBy(*KEY))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def meeting(asking: DataFrame, rows_of: Callable[[DataFrame], DataFrame], units: Units, blocks: int, k: int, alike: bool = True, count: bool = False) -> DataFrame:
    """Neighbours for asking (key, packed, least, block) among rows_of(pairs), rows (key, packed, unit) of the units of pairs: candidates
    that hold the k best, or (met) how many pairs each task compared. alike: faces of one key are the same, and don't find themselves. Of equal
    vectors only the first k + 1 answer: the others can be among the k best of no face. Tasks are groups of a block and a slice of the answers, sorted so that the block comes first."""
    pairs = tables.small(tables.save(aimed(asking, units), "aims"), 1_000_000)
    part = lambda at: (F.col("block") * SLICES + at).cast("int").alias("group")
    answers = few_equal(rows_of(pairs).select(*KEY, "packed", "unit"), k + 1).join(pairs, "unit").select(part(F.pmod(F.xxhash64(*KEY, F.lit(2)), F.lit(SLICES))), "unit", *KEY, "packed", F.lit(0.0).alias("least"))
    asked = asking.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).select(part(F.col("at")), F.lit(-1).alias("unit"), *KEY, "packed", "least")
    sent = asked.unionByName(answers).repartitionById(blocks * SLICES, F.col("group")).sortWithinPartitions("group", "unit")

    def out(held: Held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held.met])], names=["met"]) if count else held.found()

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        for batch in found:
            if not batch.num_rows:
                continue
            group, unit, media, face = (batch.column(c).to_numpy() for c in range(4))
            x, least = packed(batch, 4), batch.column(5).to_numpy()
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(unit) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(group)], strict=True):
                if group[a] != now:
                    if held is not None:
                        yield out(held)
                    held, now = Held(k, alike), group[a]
                if unit[a] < 0:
                    held.ask(media[a:b], face[a:b], x[a:b], least[a:b])
                else:
                    u = unit[a]
                    held.answer(media[a:b], face[a:b], x[a:b], units.centres[units.cell[u]], units.lo[u], units.hi[u])
        if held is not None:
            yield out(held)

    return sent.mapInArrow(batches, "met bigint" if count else FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "neighbour_media", "neighbour_face"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def least_of(found: DataFrame, k: int) -> DataFrame:
    """(key, least): the k-th best score found so far; faces with fewer have none."""
    return found.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).drop("n")


def prepared(faces: DataFrame, block_rows: int) -> tuple[DataFrame, Units]:
    """Faces as rows (key, packed, r, unit, piece), and the bounds of the units; few faces are one piece."""
    if faces.count() <= block_rows:
        rows = faces.select(*KEY, as_bytes("embedding").alias("packed"), F.lit(0.0).alias("r"), F.lit(0).alias("unit"), F.lit(0).alias("piece"))
        one = np.zeros(1, dtype=np.int64)
        return tables.save(rows, "dealt"), Units(np.zeros((1, 1)), one, one, np.zeros(1), np.full(1, 2.0), one, one + 1)
    centres = centres_of(faces, block_rows)
    rows = ringed(tables.save(placed(faces, centres), "placed"), block_rows)
    units = units_of(rows, centres, block_rows)
    return tables.save(dealt(rows, units).select(*KEY, "packed", "r", "unit", "piece"), "dealt"), units


def asking_of(faces: DataFrame, k: int, block_rows: int) -> tuple[DataFrame, Units, int]:
    """Rows (key, packed, unit, piece, least, block) that have met their own piece, the units, and the number of blocks."""
    rows, units = prepared(faces, block_rows)
    total = int(units.rows.sum())
    one = rows.select("packed").first()
    size = len(one.packed) // 8 if one else 1
    if units.centres.shape[1] != size:  # few faces are one piece, without a centre
        units.centres = np.zeros((1, size))
    blocks = blocks_of(total, size, block_rows)
    before = np.cumsum(units.rows) - units.rows
    places = faces.sparkSession.createDataFrame([(u, int(b), int(n), int(p)) for u, (b, n, p) in enumerate(zip(before, units.rows, units.pieces, strict=True))], "unit int, before bigint, held bigint, pieces bigint")
    block = F.least(F.lit(blocks - 1), F.floor((F.col("before") + F.col("piece") * F.col("held") / F.col("pieces")) * blocks / max(1, total))).cast("int")
    met = rows.select(*KEY, "packed", "unit", "piece").groupBy("unit", "piece").applyInArrow(own_least(k), "media_id bigint, face_index int, packed binary, unit int, piece int, least double")
    return tables.save(met.join(F.broadcast(places), "unit").select(*KEY, "packed", "unit", "piece", "least", block.alias("block")), "first"), units, blocks


def neighbours(faces: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Candidates that hold the k nearest others of every face."""
    rows, units, blocks = asking_of(faces, k, block_rows)
    return meeting(rows, lambda _: rows, units, blocks, k)


def first_aims(asking: DataFrame, units: Units) -> DataFrame:
    """asking (key, packed, ..) with the unit that begins nearest, and one of its pieces."""
    names = asking.columns
    at = names.index("packed")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for batch in (whole.slice(k, BATCH) for k in range(0, whole.num_rows, BATCH)):
                unit = units.bounds(packed(batch, at)).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit), pa.array(units.pieces[unit])], names=[*names, "unit", "pieces"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asking.schema)
    found = asking.mapInArrow(batches, f"{kind}, unit int, pieces bigint")
    return found.withColumn("piece", F.pmod(F.xxhash64(*KEY), F.col("pieces")).cast("int")).drop("pieces")


def answered(asking: DataFrame, units: Units, rows_in, k: int, block_rows: int) -> DataFrame:
    """The k most similar stored faces for every asking face (key, embedding). rows_in(cells) gives the stored faces (key, packed,
    cell) of some cells; only the cells that may hold an answer are read."""
    spark = asking.sparkSession
    own = tables.save(placed(asking, units.centres), "asking")
    counts = sorted(tuple(r) for r in own.groupBy("cell").count().collect())  # CELLS rows
    total = sum(n for _, n in counts)
    blocks = blocks_of(total, units.centres.shape[1], block_rows)
    before, places = 0, []
    for cell, n in counts:
        places.append((cell, before, n, -(-n // block_rows)))
        before += n
    spread = F.pmod(F.xxhash64(*KEY, F.lit(3)), F.lit(1024)) / 1024
    far = F.floor((F.col("before") + spread * F.col("held")) * blocks / max(1, total)).cast("int")
    block = F.concat_ws("-", "cell", F.pmod(F.xxhash64(*KEY), F.col("blocks")))
    own = own.join(F.broadcast(spark.createDataFrame(places, "cell int, before bigint, held bigint, blocks bigint")), "cell").select(*KEY, "packed", block.alias("block"), far.alias("far"))
    aims = tables.save(first_aims(own, units), "aims")

    def rows(targets: DataFrame) -> DataFrame:
        needed = [r.unit for r in targets.select("unit").distinct().collect()]  # CELLS * RINGS at most
        stored = rows_in(sorted({int(units.cell[u]) for u in needed}))
        return stored.join(F.broadcast(units.table(spark).drop("ring")), "cell").withColumn("piece", F.pmod(F.xxhash64(*KEY), F.col("pieces")).cast("int")).select(*KEY, "packed", "unit", "piece")

    first = tables.save(meet(aims.withColumn("least", F.lit(-1.0)), rows(aims), k), "first")
    met = aims.join(least_of(first, k), KEY, "left").select(*KEY, "packed", F.coalesce("least", F.lit(-1.0)).alias("least"), F.col("far").alias("block"))
    return ranked(meeting(tables.save(met, "met"), rows, units, blocks, k, alike=False), k)


def top_k(faces: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(media_id, face_index, neighbour_media, neighbour_face, score, rank): the k most similar other faces of every face."""
    return ranked(neighbours(faces, k, block_rows), k)


def met_share(faces: DataFrame, k: int, block_rows: int) -> float:
    """Share of all pairs of different faces whose similarity top_k() computes."""
    rows, units, blocks = asking_of(faces, k, block_rows)
    sizes = rows.groupBy("unit", "piece").agg(F.count("*").alias("n"))
    met = (sizes.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0) + (meeting(rows, lambda _: rows, units, blocks, k, count=True).agg(F.sum("met")).first()[0] or 0)
    n = rows.count()
    return met / max(1, n * (n - 1))
