"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every text gets its set of word shingles, a digest of the set and a signature of `coordinates` minima. Texts with
   one set are one class, represented by their smallest id.
2. A pair of the least similarity agrees in `matches` coordinates but for a chance of RISK, so it meets in the posting
   list of one of its coordinates - matches + 1 rarest (coordinate, value) pairs: only this prefix is posted. How rare
   a pair is comes from a sketch of fixed size over all documents.
3. Posting lists count the collisions of whole signatures, skip pairs that are joined already, and keep those above
   the match threshold; each list gives a spanning forest of them, never its pairs. Long lists are dealt into blocks,
   and blocks meet in pairs.
4. The loose clusters that these forests make are confirmed on full shingle sets, in blocks of bounded size, and the
   links that hold are joined to components.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visagelake.operators import tables
from visagelake.llm._arrow import slices
from visagelake.operators.graph import components

#: Chance that a pair at the least similarity falls below the match threshold.
RISK = 1e-9
#: Buckets of the sketch of coordinate frequencies; rows of a posting block; shingles of a confirmation block.
SKETCH, LIST_ROWS, SET_SHINGLES = 1 << 16, 1000, 200_000
TOGETHER = 1_000_000
#: Hash buckets of ids that keep most texts without a loose partner out of the shuffle for the confirmation.
MEMBER_BUCKETS = 1 << 20
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text: words between ASCII white space, A-Z in lower case; a
    shorter text is one shingle as a whole, one without words has none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], dtype=np.uint64)
    size = len(h) - words + 1
    if size < 1:
        return mixed(np.array([(h * constants(len(h), 17)).sum() + np.uint64(len(h))], dtype=np.uint64))
    by = constants(words, 5)
    return np.unique(mixed(sum(h[k : k + size] * by[k] for k in range(words))))


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """Minima of the shingles under as many hash functions, as 32-bit numbers."""
    turn, by = constants(coordinates, 101)[:, None], constants(coordinates, 202)[:, None]
    least = np.full(coordinates, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[None, at : at + 2048] ^ turn) * by).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def match_threshold(coordinates: int, percent: int) -> int:
    """The largest t such that a pair of this similarity agrees in fewer than t coordinates with chance RISK at most."""
    p, below, t = percent / 100, 0.0, 0
    while t < coordinates:
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > RISK:
            break
        t += 1
    return max(t, 1)


def tokens(signatures: np.ndarray) -> np.ndarray:
    """64-bit names of the (coordinate, value) pairs of signatures (rows x coordinates)."""
    return mixed(signatures.astype(np.uint64) + (np.arange(1, signatures.shape[1] + 1, dtype=np.uint64) << np.uint64(32)))


def signed(docs: DataFrame, id_col: str, text_col: str, words: int, coordinates: int) -> DataFrame:
    """(id, n, digest, sig) of whole texts; a text without words has a null digest and signature."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 1, TOGETHER)):
            sets = [shingles(t or "", words) for t in batch.column(1).to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            sigs = pa.array([signature(s, coordinates).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), digests, sigs], names=["id", "n", "digest", "sig"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(batches, f"id {source.schema['id'].dataType.simpleString()}, n bigint, digest binary, sig binary")


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equal length from a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def frequencies(classes: DataFrame) -> np.ndarray:
    """How many classes have a (coordinate, value) pair of each sketch bucket: SKETCH numbers, over all of them."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in found:
            if len(batch):
                total += np.bincount((tokens(matrix(batch.column(0), np.uint32)) >> np.uint64(48)).astype(np.int64).ravel(), minlength=SKETCH)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    counted = classes.select("sig").mapInArrow(batches, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SKETCH, dtype=np.int64)
    for r in counted:
        out[r.bucket] = r.n
    return out


def postings(classes: DataFrame, prefix: int) -> DataFrame:
    """(key, rep) for the rarest pairs of every class; one order of all pairs, by frequency and then name."""
    spark = classes.sparkSession
    counts = spark.sparkContext.broadcast(frequencies(classes))  # SKETCH numbers

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if len(batch):
                names = tokens(matrix(batch.column(1), np.uint32))
                order = (np.minimum(counts.value[(names >> np.uint64(48)).astype(np.int64)], (1 << 30) - 1) << 33) | (names & np.uint64((1 << 33) - 1)).astype(np.int64)
                first = np.argpartition(order, prefix - 1, axis=1)[:, :prefix] if prefix < order.shape[1] else np.tile(np.arange(order.shape[1]), (len(order), 1))
                keys = np.take_along_axis(names, first, axis=1).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(np.repeat(np.arange(len(order)), first.shape[1])))], names=["key", "rep"])

    kind = classes.schema["rep"].dataType.simpleString()
    return classes.select("rep", "sig").mapInArrow(batches, f"key bigint, rep {kind}")


def blocks(df: DataFrame, parts: F.Column, by: str) -> DataFrame:
    """Deal the members of a group into blocks, and every block to its meetings (lo, hi) with all blocks of the group."""
    own = F.pmod(F.xxhash64(by), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("lo"), F.greatest(x, F.col("own")).alias("hi")))
    return df.withColumn("parts", F.greatest(parts.cast("long"), F.lit(1))).withColumn("own", own).withColumn("meeting", F.explode(pairs)).select("*", "meeting.lo", "meeting.hi").drop("parts", "own", "meeting")


def grouped(found: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, with where groups begin and end; keys: leading columns that name the group."""
    held: list[pa.RecordBatch] = []

    def ready(tables: list[pa.RecordBatch], last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        table = pa.Table.from_batches(tables).combine_chunks()
        differ = np.zeros(max(len(table) - 1, 0), dtype=bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            differ |= column[1:] != column[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(differ) + 1, [len(table)]))
        if not last:
            cuts = cuts[:-1]
        return table, cuts, table.slice(int(cuts[-1]))

    for batch in found:
        if len(batch):
            table, cuts, rest = ready([*held, batch], False)
            if len(cuts) > 1:
                yield table, cuts
            held = rest.to_batches()
    if held:
        table, cuts, _ = ready(held, True)
        yield table, cuts


def forest(n: int, joined: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component numbers 0..n-1 (smallest member) when joined(i, others) tells which others are linked to i; pairs that are in one component
    already are skipped."""
    of = np.arange(n)
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        others = others[of[others] != of[i]]
        if len(others) and len(hit := others[joined(i, others)]):
            group = np.unique(np.append(of[hit], of[i]))
            of[np.isin(of, group)] = group[0]
    return of


def loose_edges(posted: DataFrame, matches: int, percent: int) -> DataFrame:
    """Edges (a, b) of spanning forests over the pairs of each posting block that agree in enough coordinates."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in grouped(found, 3):
            size = table.column("n").to_numpy()
            sig = matrix(table.column("sig").combine_chunks(), np.uint8)
            start, length = cuts[:-1], np.diff(cuts)
            pairs = start[length == 2]
            same = (sig[pairs] == sig[pairs + 1]).sum(axis=1) >= matches
            same &= 100 * np.minimum(size[pairs], size[pairs + 1]) >= percent * np.maximum(size[pairs], size[pairs + 1])
            left, right = [pairs[same]], [pairs[same] + 1]
            for at, n in zip(start[length > 2].tolist(), length[length > 2].tolist(), strict=True):
                own, sizes = sig[at : at + n], size[at : at + n]

                def alike(i: int, others: np.ndarray, own=own, sizes=sizes) -> np.ndarray:
                    fits = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
                    return fits & ((own[others] == own[i]).sum(axis=1) >= matches)

                of = forest(n, alike)
                member = np.flatnonzero(of != np.arange(n))
                left.append(at + of[member])
                right.append(at + member)
            reps = table.column("rep").combine_chunks()
            a, b = reps.take(pa.array(np.concatenate(left))), reps.take(pa.array(np.concatenate(right)))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    kind = posted.schema["rep"].dataType.simpleString()
    return posted.select("key", "lo", "hi", "rep", "n", "sig").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(batches, f"a {kind}, b {kind}")


def confirmed_edges(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of spanning forests over the pairs of each block whose full sets are similar enough."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in grouped(found, 3):
            reps = table.column("rep").combine_chunks()
            left, right = [], []
            for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if end - at < 2:
                    continue
                raw = table.column("set").slice(at, end - at).to_pylist()
                n = np.array([len(x) // 8 for x in raw])
                names, ids = np.unique(np.frombuffer(b"".join(raw), dtype=np.uint64), return_inverse=True)
                ends = np.cumsum(n)
                begins = ends - n
                marked = np.zeros(len(names), dtype=bool)

                def alike(i: int, others: np.ndarray, n=n, ids=ids, begins=begins, ends=ends, marked=marked) -> np.ndarray:
                    out = np.zeros(len(others), dtype=bool)
                    fit = np.flatnonzero(100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
                    if len(fit):
                        own, some = ids[begins[i] : ends[i]], others[fit]
                        marked[own] = True
                        first = np.cumsum(n[some]) - n[some]
                        places = np.arange(int(n[some].sum())) + np.repeat(begins[some] - first, n[some])
                        shared = np.add.reduceat(marked[ids[places]].astype(np.int64), first)
                        marked[own] = False
                        out[fit] = 100 * shared >= percent * (n[some] + n[i] - shared)
                    return out

                of = forest(end - at, alike)
                member = np.flatnonzero(of != np.arange(end - at))
                left.append(at + of[member])
                right.append(at + member)
            if left:
                yield pa.RecordBatch.from_arrays([reps.take(pa.array(np.concatenate(x))) for x in (left, right)], names=["a", "b"])

    kind = sets.schema["rep"].dataType.simpleString()
    return sets.select("cluster", "lo", "hi", "rep", "set").repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(batches, f"a {kind}, b {kind}")


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """texts (rep, cluster, lo, hi, digest, text) with their shingles, where these are those of the digest."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 5, TOGETHER)):
            sets = [shingles(t or "", words).tobytes() for t in batch.column(5).to_pylist()]
            own = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, batch.column(4).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=["rep", "cluster", "lo", "hi", "set"]).filter(own)

    kind = texts.schema["rep"].dataType.simpleString()
    return texts.select("rep", "cluster", "lo", "hi", "digest", "text").mapInArrow(batches, f"rep {kind}, cluster {kind}, lo bigint, hi bigint, set binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Returns (id_col, n_shingles, component_id, kept), one row per input row; kept marks the document with the smallest
    id of its component. A null or empty text, or one without words, has an empty set and is linked with nothing. A null id
    is linked with nothing, its component is null and it is kept. Repeated rows are in one component; rows with one id
    and different texts link what each of them links. Other columns are not carried, so none can clash.
    """
    rows = tables.save(signed(docs, id_col, text_col, words, coordinates), "signatures")
    classes = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = tables.save(classes, "classes")
    matches = match_threshold(coordinates, percent)
    posted = postings(classes, coordinates - matches + 1)
    lists = posted.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    low_bytes = F.expr(f"concat({', '.join(f'substring(sig, {4 * k + 1}, 1)' for k in range(coordinates))})")
    shared = posted.join(lists, "key").join(classes.select("rep", "n", low_bytes.alias("sig")), "rep")
    loose = components(loose_edges(blocks(shared, F.ceil(F.col("rows") / LIST_ROWS), "rep"), matches, percent))
    members = classes.select("rep", "digest", "n").join(loose.withColumnsRenamed({"node": "rep", "component": "cluster"}), "rep")
    members = tables.save(members, "members")
    weights = members.groupBy("cluster").agg(F.sum("n").alias("all"))
    dealt = blocks(members.join(weights, "cluster"), F.ceil(F.col("all") / SET_SHINGLES), "digest")
    bucket = lambda: F.pmod(F.xxhash64("rep"), F.lit(MEMBER_BUCKETS))
    likely = F.broadcast(members.select(bucket().alias("bucket")).distinct())  # MEMBER_BUCKETS rows at most
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text")).withColumn("bucket", bucket())
    texts = texts.join(likely, "bucket", "left_semi").join(dealt.hint("merge"), "rep")
    linked = components(confirmed_edges(sets_of(texts, words), percent))
    named = classes.select("digest", "rep").join(linked.withColumnsRenamed({"node": "rep", "component": "found"}), "rep", "left")
    named = named.select("digest", F.coalesce("found", "rep").alias("component"))
    out = rows.drop("sig").join(named, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 200_000, **options) -> DataFrame:
    """docs, with all columns, without the rows that near_duplicates() does not keep; of repeated rows all stay or all go."""
    gone = tables.save(near_duplicates(docs, id_col=id_col, **options).where(~F.col("kept")).select(id_col).distinct(), "copies")
    return docs.join(tables.small(gone, broadcast_rows), id_col, "left_anti").select(docs.columns)


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
posts AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM posts a JOIN posts b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * k >= 85 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
found AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept FROM sets s LEFT JOIN found f ON f.doc_id = s.doc_id
"""
