"""Byte-level BPE encoding and decoding with a pair occurrence index.

Encoding works on one Arrow batch of a partition at a time. The distinct pre-tokens of the batch are laid out
in one flat symbol list; an index maps every mergeable pair to all its positions there. Active ranks are taken
in ascending order from a heap, all positions of the rank's pair are merged left to right, and only the lists of
the pairs next to a merge are updated. Results are kept per pre-token in a cache of bounded size.
"""

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visagelake.llm._arrow import slices

#: Pre-token pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept per Python worker before the cache starts anew.
CACHE_WORDS = 60_000
#: No symbol: merged away, or past the end of a word.
NONE = -1
#: Bytes of text, or ids, handled together; bounds the memory of the occurrence index.
TOGETHER = 2_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in printable:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


def apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of the places of a pair of equal symbols, those that are merged: leftmost first, none inside another."""
    kept, taken = [], -1
    for i, j in zip(places.tolist(), after[places].tolist(), strict=True):
        if i != taken:
            kept.append(i)
            taken = j
    return np.array(kept, dtype=places.dtype)


class Vocabulary:
    """Ids, merge ranks and token bytes of a tokenizer file, with the encoder over them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.start = np.array([ids[c] for c in letters], dtype=np.int64)
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        self.pair_of = [ids[left] << 32 | ids[right] for left, right in merges]
        self.made = [ids[left + right] for left, right in merges]
        pairs = np.array(self.pair_of, dtype=np.int64)
        self.ranks = np.append(np.argsort(pairs, kind="stable"), 0)
        self.keys = np.append(pairs[self.ranks[:-1]], np.iinfo(np.int64).max)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special tokens are pieces of their own."""
        if self.split is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out = []
        for part in self.split.split(text):
            out += [part] if part in self.special else self.words.findall(part)
        return out

    def learn(self, fresh: list[str]) -> None:
        """Encode pre-tokens into the cache, as packed 32-bit ids."""
        words = [word.encode("utf-8", "surrogatepass") for word in fresh]
        if not words:
            return
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        symbols = np.empty(n + 1, dtype=np.int64)
        symbols[:n] = self.start[np.frombuffer(b"".join(words), dtype=np.uint8)]
        symbols[n] = NONE  # what the ends of words point to
        after = np.arange(1, n + 2)
        after[ends - 1] = n
        before = np.arange(-1, n)
        before[ends - sizes] = n
        keys, ranks, made_by = self.keys, self.ranks, self.made
        where: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(positions: np.ndarray) -> None:
            pair = symbols[positions] << 32 | symbols[after[positions]]
            at = np.searchsorted(keys, pair)
            hit = keys[at] == pair
            rank, positions = ranks[at[hit]], positions[hit]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, positions = rank[order], positions[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, places in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True):
                if r in where:
                    where[r].append(places)
                else:
                    where[r] = [places]
                    heapq.heappush(heap, r)

        note(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            left, right, made = self.pair_of[rank] >> 32, self.pair_of[rank] & 0xFFFFFFFF, made_by[rank]
            found = where.pop(rank)
            places = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            places = places[(symbols[places] == left) & (symbols[after[places]] == right)]
            if left == right and len(places) > 1:
                places = apart(places, after)
            if not len(places):
                continue
            gone = after[places]
            symbols[places], symbols[gone] = made, NONE
            after[places] = further = after[gone]
            before[further] = places
            symbols[n], after[n] = NONE, n
            note(np.concatenate((before[places], places)))
        for word, one in zip(fresh, np.split(symbols[:n].astype(np.int32), ends[:-1]), strict=True):
            self.cache[word] = one[one >= 0].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids of each text."""
        split = [self.pieces(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        for token, i in self.special.items():
            self.cache[token] = np.int32(i).tobytes()
        self.learn(list({w for words in split for w in words if w not in self.cache}))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per Python worker."""
    return Vocabulary(path)


def id_lists(packed: list[bytes]) -> pa.ListArray:
    """Arrow lists of packed 32-bit ids."""
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts.

    Returns (id_col, token_ids array<int>), one row per input row; other columns are not carried, so none can
    clash. A null or empty text has an empty array; a null id stays null; repeated rows are encoded again.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in (part for whole in found for part in slices(whole, 1, TOGETHER)):
            packed = vocab.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(packed)], names=["id", "token_ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = source.mapInArrow(batches, f"id {source.schema['id'].dataType.simpleString()}, token_ids array<int>")
    return made.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Texts of token ids, special tokens written out.

    Returns (id_col, ids_col, decoded string), one row per input row. A null array is decoded as an empty one;
    an id outside the vocabulary fails the job.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in (part for whole in found for part in slices(whole, 1, TOGETHER)):
            lists = batch.column(1)
            texts = [vocab.decode(lists[i].values.to_numpy(zero_copy_only=False).tolist() if lists[i].is_valid else []) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["id", "token_ids", "decoded"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("token_ids"))
    made = source.mapInArrow(batches, f"id {source.schema['id'].dataType.simpleString()}, token_ids array<int>, decoded string")
    return made.withColumnsRenamed({"id": id_col, "token_ids": ids_col})


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode() of encode() in one pass, which keeps one vocabulary and one cache in memory for a task, not two.

    Returns (id_col, token_ids, decoded), one row per input row, with the results that the two give for odd rows.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in (part for whole in found for part in slices(whole, 1, TOGETHER)):
            packed = vocab.encode([t or "" for t in batch.column(1).to_pylist()])
            texts = [vocab.decode(np.frombuffer(p, dtype=np.int32).tolist()) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(packed), pa.array(texts, pa.string())], names=["id", "token_ids", "decoded"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = source.mapInArrow(batches, f"id {source.schema['id'].dataType.simpleString()}, token_ids array<int>, decoded string")
    return made.withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """Count and digests of what encode() and decode() returned, and the columns in more."""
    return decoded.select(
        F.col(id_col),
        *more,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
