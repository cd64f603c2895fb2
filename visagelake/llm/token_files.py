"""Token ids of documents as ORC files in ascending order of document id.

Documents are dealt into ranges of ids, sorted and encoded there, and every range is written as one file: integer
run-length encoding of ids, counts and offsets, a row index every `stride` documents and Bloom filters on the document id.
A row keeps how many ids of its file lie before it; the totals of the files, read from two columns, give the rest of every
offset. Spark splits the files by stripe, and a search for document ids skips stripes and row groups by their statistics
and Bloom filters.
"""

import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from visagelake.llm import _arrow, bpe
from visagelake.operators import tables

#: Words, and pieces of them, kept per Python worker: so many recent ones, and as many older ones.
KEPT = 400_000
#: Longer words are encoded each time.
LONGEST = 64
#: Bytes of text, or ids, handled together.
TOGETHER = 1_000_000
#: Characters below this are letters, digits or marks in every version of Unicode alike.
SETTLED = "ɐ"
MARKS = set("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")
TOKEN_ID = attrgetter("id")
#: Parts of a file up to which their totals are broadcast.
PARTS = 1_000_000


class Aged(dict):
    """Results of a function by argument; of those not asked for lately only about `most` stay."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Whole(Exception):
    """A text that can't be cut at its spaces."""


class Encoder:
    """Ids of the tokenizers library for whole texts, by words.

    A byte-level tokenizer splits texts into pieces before it merges anything, and a space before another character
    than white space always begins a piece. Texts are therefore cut there, and the ids of every word are kept. The pieces
    of a word come from the library, or for common letters from the pattern of these vocabularies; their ids come
    from the library's model. Texts with special tokens or runs of white space at a space, and all texts of tokenizers of
    another make, are encoded whole.
    """

    def __init__(self, path: str, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        before = self.library.pre_tokenizer
        self.by_words = self.library.normalizer is None and type(before).__name__ == "ByteLevel" and not before.add_prefix_space and before.use_regex
        self.pattern = regex.compile(bpe.PATTERN)
        self.letters = {b: ord(c) for b, c in enumerate(bpe.byte_letters()) if b != ord(c)}
        self.model = self.library.model
        self.pieces, self.words = Aged(self.piece, kept), Aged(self.word, kept)

    def whole(self, text: str) -> bytes:
        return array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of one piece."""
        rest = piece[1:]
        if rest.isascii() and rest.isalnum() and " " <= piece[0] <= "~":
            spelled = "Ġ" + rest if piece[0] == " " else piece
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array("i", map(TOKEN_ID, self.model.tokenize(spelled))).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word with the space before it. Letters alone are one piece, and a mark at the end is another."""
        if word.isalpha() and (word.isascii() or max(word) < SETTLED):
            return self.piece(" " + word)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return self.words[word[:-1]] + self.pieces[word[-1]]
        if not word or word[0].isspace():
            raise Whole
        return self.cut(" " + word)

    def cut(self, text: str) -> bytes:
        """Ids of a text, or word, by its pieces."""
        if not text.replace("\n", "").isprintable() or not text.isascii() and max(text) >= SETTLED:
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Packed 32-bit ids of a text."""
        if not self.by_words or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return self.cut(first) + b"".join(map(self.words.__getitem__, rest))
        except Whole:
            return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once per Python worker."""
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, target: str, end_id: int = 0, stripe_bytes: int = 16 << 20, stride: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Token ids of whole texts as ORC files below target: (part, doc_id, before, n_tokens, ids), in ascending order of id.

    A null or empty text has the end id only; a null id comes first; rows of one id go by their text, and repeated rows
    are written each. An empty table gives a file without rows. Texts of any length are one row. Other columns are not written,
    so none can clash. before: ids in the same part that come before; part: position of the file's range of ids.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, end = encoder(tokenizer).encode, 0, np.int32(end_id).tobytes()
        for batch in (part for whole in found for part in _arrow.slices(whole, 2, TOGETHER)):
            packed = [encode(t) + end for t in batch.column(2).to_pylist()]
            sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
            ends = before + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - sizes), pa.array(sizes), bpe.id_lists(packed)], names=["part", "doc_id", "before", "n_tokens", "ids"])
            before = int(ends[-1])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    made = ordered.mapInArrow(batches, f"part int, doc_id {ordered.schema['doc_id'].dataType.simpleString()}, before bigint, n_tokens bigint, ids array<int>")
    made.write.options(**{"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": stride}).orc(target)


def read(spark: SparkSession, target: str, ids: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files, of all documents or of some ids: stripes and row groups without them
    are skipped. start: ids of all documents before, counted from the whole files' offsets either way."""
    rows = spark.read.orc(target)
    return placed(rows if ids is None else rows.where(F.col("doc_id").isin(ids)), target).select("doc_id", "start", "n_tokens", "ids")


def placed(rows: DataFrame, target: str) -> DataFrame:
    """rows (part, before, ...) with start in place of both; reads the totals of the parts from two columns."""
    totals = rows.sparkSession.read.orc(target).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offset = F.sum("total").over(Window.orderBy("part")) - F.col("total")  # a row a file
    offsets = tables.save(totals.select("part", offset.alias("offset")), "offsets")
    return rows.join(tables.small(offsets, PARTS), "part").withColumn("start", F.col("offset") + F.col("before")).drop("part", "before", "offset")


def digests(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files' ids."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in _arrow.slices(whole, 3, TOGETHER)):
            ids = batch.column(3)
            at = ids.offsets.to_numpy()
            packed = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["part", "doc_id", "before", "n_tokens", "ids_crc32"])

    rows = spark.read.orc(target).select("part", "doc_id", "before", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return placed(rows.mapInArrow(batches, f"part int, doc_id {kind}, before bigint, n_tokens bigint, ids_crc32 bigint"), target).select("doc_id", "start", "n_tokens", "ids_crc32")
