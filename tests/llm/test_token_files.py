import glob
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from visagelake.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  two  spaces \n\n\tend ", "word \nnext", "line\n next\r\n two", "Grüße <|endoftext|> naïve", "don't we'll I'M 12345 %%%&&& é ñandú", "x\x1fy \x85z q ­", "日本語 テキスト 🙂🙂 Ωmega",
    "x" * 5000, "a b " * 20000, "\x00\x7f  z", " lead", "tab\tand space", "Ġ Ċ ½ ² ª ǅ ɐ", "the quick brown fox", "the quick brown fox",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, rows, end_id=0):
    """(doc_id, start, n_tokens, crc32) by a plain loop; null ids first."""
    out, start = [], 0
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_equals_library(spark, library, tmp_path):
    rows = [(i, t, "p", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(None, "null id", "p", 1), *rows[::-1]], "doc_id long, text string, part string, start int").repartition(3)
    token_files.write(docs, PATH, str(tmp_path / "a"))
    got = sorted(map(tuple, token_files.digests(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert got == wanted(library, [(None, "null id"), *(r[:2] for r in rows)])


def test_repeated_ids_fill_the_offsets(spark, library, tmp_path):
    docs = spark.createDataFrame([(i % 3 or None, f"text {i % 40}") for i in range(300)], "doc_id long, text string")
    token_files.write(docs, PATH, str(tmp_path / "a"), end_id=7)
    got = sorted(map(tuple, token_files.digests(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda i: i or 0)
    starts = np.cumsum([0] + [r[2] for r in got])
    assert [r[1] for r in got] == starts[:-1].tolist()
    one = {(i, c) for i, _, _, c in wanted(library, [(r.doc_id, r.text) for r in docs.collect()], 7)}
    assert {(r[0], r[3]) for r in got} == one


def test_documents_equal_library(spark, library, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    token_files.write(docs, PATH, str(tmp_path / "a"))
    got = sorted(map(tuple, token_files.digests(spark, str(tmp_path / "a")).collect()))
    assert got == wanted(library, sorted((r.doc_id, r.text) for r in docs.collect()))


def test_no_rows(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "a"))
    assert token_files.digests(spark, str(tmp_path / "a")).collect() == []


def test_stripes_indexes_and_pruning(spark, tmp_path):
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.hash("id", F.lit(k)) for k in range(12))).alias("text"))
    token_files.write(docs, PATH, str(tmp_path / "a"), stripe_bytes=64 << 10, stride=1000)
    files = sorted(glob.glob(str(tmp_path / "a" / "*.orc")))
    found = [orc.ORCFile(f) for f in files]
    assert max(f.nstripes for f in found) > 1 and {f.row_index_stride for f in found} == {1000} and {str(f.file_version) for f in found} == {"0.12"}
    ids = pa.concat_tables([f.read() for f in found])["doc_id"].to_pylist()
    assert ids == sorted(ids) and len(ids) == 20_000
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    assert spark.read.orc(str(tmp_path / "a")).rdd.getNumPartitions() > len(files)
    spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    want = {r.doc_id: r for r in token_files.read(spark, str(tmp_path / "a")).where("doc_id in (20000, 31002)").collect()}
    some = token_files.read(spark, str(tmp_path / "a"), [20000, 31002, 31003])
    assert {r.doc_id: r for r in some.collect()} == want and len(want) == 2

    def scanned(ids):
        rows = spark.read.orc(str(tmp_path / "a")).where(F.col("doc_id").isin(ids))
        rows.collect()
        nodes = [rows._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            if node.metrics().contains("numFiles"):
                return node.metrics().apply("numOutputRows").value()
            nodes += [node.children().apply(k) for k in range(node.children().size())] + ([node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [])

    assert scanned([20000, 31002]) <= 2 * 1000  # a row group for each of the two ids
    assert scanned([20001]) == 0  # inside a row group's range, but in no Bloom filter


def test_other_tokenizers_are_encoded_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    other = token_files.Encoder(path)
    assert not other.by_words
    text = "The  Quick brown"
    assert other.encode(text) == array("i", Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids).tobytes()


def test_few_kept_words_change_nothing(library):
    small = token_files.Encoder(PATH, kept=5)
    for text in [t for t in TEXTS if t]:
        assert small.encode(text) == array("i", library.encode(text, add_special_tokens=False).ids).tobytes()
