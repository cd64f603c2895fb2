"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Texts become counts of hashed character bigrams, of trigrams of character classes, and of word statistics. A truncated
singular value decomposition of a bounded sample of labelled texts gives latent vectors; those of the sample are
broadcast (`sample` rows at most), and every document's cosine with all of them is computed in exact blocks. The
nearest vote with their labels, weighted by similarity and by how strongly the sample thins their class.
"""

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visagelake.llm._arrow import slices

BIGRAMS, CLASSES, STATISTICS = 2048, 1024, 8
BLOCK = 256
TOGETHER = 1_000_000  # bytes of text handled together
SYMBOLS = b"#*$%&|<>@^~=+_{}[]\\/"


def class_table() -> np.ndarray:
    """Character class of every byte: letters of either case, digits, white space and other bytes share one each;
    punctuation keeps a class per character."""
    table = np.arange(256, dtype=np.int64)
    for start, end, kind in ((97, 123, 97), (65, 91, 65), (48, 58, 48), (128, 256, 97), (0, 33, 32)):
        table[start:end] = kind
    return table


CLASS_OF = class_table()
SYMBOL_OF = np.isin(np.arange(256), np.frombuffer(SYMBOLS, dtype=np.uint8))


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.sqrt((v * v).sum(dtype=np.float64))), 1e-9)


def features(text: str) -> np.ndarray:
    """Feature vector of a whole text: three blocks of unit length; zero for a text without words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    out = np.zeros(BIGRAMS + CLASSES + STATISTICS, dtype=np.float32)
    if not words:
        return out
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    pairs = (b[:-1] * 257 + b[1:]) * 2654435761 % 4294967291 % BIGRAMS
    out[:BIGRAMS] = unit(np.log1p(np.bincount(pairs, minlength=BIGRAMS)))
    kinds = CLASS_OF[b]
    threes = ((kinds[:-2] * 257 + kinds[1:-1]) * 257 + kinds[2:]) * 2654435761 % 4294967291 % CLASSES
    out[BIGRAMS : BIGRAMS + CLASSES] = unit(np.log1p(np.bincount(threes, minlength=CLASSES)))
    n, lines = len(words), raw.split(b"\n")
    letters = max(1, int(((kinds == 97) | (kinds == 65)).sum()))
    out[BIGRAMS + CLASSES :] = unit(
        np.array(
            [
                0.5,
                (kinds == 65).sum() / letters,
                (kinds == 48).sum() / len(b) * 4,
                SYMBOL_OF[b].sum() / n,
                sum(x == y for x, y in zip(words, words[1:], strict=False)) / n * 2,
                1 - len(set(words)) / n,
                1 - len(set(lines)) / len(lines),
                min(2.0, len(b) / n / 16),
            ]
        )
    )
    return out


class Model(NamedTuple):
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    neighbours: int


def fit(rows: np.ndarray, labels: np.ndarray, class_rows: dict[int, int], dimensions: int, neighbours: int) -> Model:
    """Latent axes of the sample by randomised subspace iteration with a fixed seed, and the sample's vectors."""
    mean = rows.mean(axis=0)
    centred = rows - mean
    k = max(1, min(dimensions, min(centred.shape) - 1))
    basis = np.random.default_rng(7).standard_normal((centred.shape[1], k + 8)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(centred.T @ (centred @ basis))
    _, spread, turn = np.linalg.svd(centred @ basis, full_matrices=False)
    axes = (basis @ turn.T)[:, :k].astype(np.float32)
    vectors = centred @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    drawn = {c: max(1, int((labels == c).sum())) for c in (0, 1)}
    weights = np.array([class_rows.get(int(c), 1) / drawn[int(c)] for c in labels], dtype=np.float32)
    return Model(mean, axes, vectors.astype(np.float32), labels.astype(np.float32), weights, min(neighbours, len(labels)))


def vote(model: Model, texts: list[str]) -> np.ndarray:
    """Scores of texts, in blocks; 0 for a text without words."""
    out = np.zeros(len(texts))
    for at in range(0, len(texts), BLOCK):
        rows = np.stack([features(t) for t in texts[at : at + BLOCK]])
        some = rows.any(axis=1)
        latent = (rows - model.mean) @ model.axes
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        cosine = latent @ model.vectors.T
        near = np.argpartition(-cosine, model.neighbours - 1, axis=1)[:, : model.neighbours]
        strength = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3).astype(np.float64) ** 4 * model.weights[near]
        out[at : at + BLOCK] = np.where(some, (strength * model.labels[near]).sum(axis=1) / strength.sum(axis=1), 0.0)
    return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, dimensions: int = 48, neighbours: int = 25) -> Model | None:
    """Model from labelled rows outside the held-out fold; None without any.

    sample: labelled rows learnt from at most, half of them per class, drawn by a hash of the id. Null ids or labels
    are not learnt from; of rows with one id the lowest label counts.
    """
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    counts = {r.label: r.n for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counts:
        return None
    drawn = [told.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for c in sorted(counts)]
    picked = drawn[0] if len(drawn) == 1 else drawn[0].unionByName(drawn[1])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # sample rows

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = [features(t or "").astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], names=["doc_id", "row", "label"])

    made = texts.mapInArrow(batches, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, row binary, label {texts.schema['label'].dataType.simpleString()}")
    found = sorted({r.doc_id: (r.doc_id, bytes(r.row), r.label) for r in made.collect()}.values())
    found = [x for x in found if any(x[1])]
    if not found:
        return None
    rows = np.stack([np.frombuffer(x[1], dtype=np.float16) for x in found]).astype(np.float32)
    return fit(rows, np.array([x[2] for x in found]), counts, dimensions, neighbours)


def scorer(docs: DataFrame, model: Model | None) -> Callable[[list[str]], np.ndarray]:
    """A function for tasks that scores texts; without a model every text with words gets 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str | None]) -> np.ndarray:
        texts = [t or "" for t in texts]
        return vote(shared.value, texts) if shared.value is not None else np.array([0.5 * bool(t.split()) for t in texts])

    return score


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores of whole texts.

    Returns (doc_id, held_out, score, predicted), one row per input row; other columns are not carried. A null or
    empty text, or one without words, scores 0. A null id is not held out; equal texts score alike.
    """
    score = scorer(docs, train(docs, labels, **options))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 1, TOGETHER)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = source.mapInArrow(batches, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of docs, with all columns, whose text scores 0.5 or more."""
    score = scorer(docs, train(docs, labels, **options))
    where = docs.columns.index("text")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, where, TOGETHER)):
            yield batch.filter(pa.array(score(batch.column(where).to_pylist()) >= 0.5))

    return docs.mapInArrow(batches, docs.schema)
