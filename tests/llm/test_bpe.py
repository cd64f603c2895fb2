import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from visagelake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  two  spaces \n\n\tend ", "aaaa aaaaa aaaaaaaaa", "Grüße <|endoftext|> naïve<|endoftext|>", "don't we'll I'M 12345 %%%&&& é",
    "日本語テキスト 🙂🙂", "x" * 5000, "the quick brown fox " * 2000, "\x00\x7f  z", "<|endoftext", "the quick brown fox",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (3, TEXTS[3], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, decoded string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.token_ids, r.decoded) for r in out.collect())
    want = sorted(((r[0] if r[0] is not None else -1), (ids := library.encode(r[1] or "", add_special_tokens=False).ids), library.decode(ids, skip_special_tokens=False)) for r in rows)
    assert got == want
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.token_ids, r.decoded) for r in bpe.encode_and_decode(docs, PATH).collect()) == got
    one = {r.doc_id: r for r in bpe.digests(out).collect()}[3]
    ids = library.encode(TEXTS[3], add_special_tokens=False).ids
    assert (one.n_tokens, one.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_documents_equal_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    got = {r.doc_id: (r.token_ids, r.decoded) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(got[r.doc_id][1] == r.text for r in docs.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH)).collect() == []
