import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_neardup import plain_set

SF = "/root/testdata/sf0.001"
BASE = [(1, "A first clean text about lakes and boats. " * 3, "en", "s"), (2, None, "en", "s"), (None, "A text without an id that is kept by all the stages.", None, None), (3, "", "en", None), (1, "A first clean text about lakes and boats. " * 3, "en", "s")]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs.collect(), (docs := spark.createDataFrame((df := stage(spark, docs, SF)).collect(), df.schema)).collect()))
    return out


def test_each_stage_against_brute_force(spark, stages):
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    before, after = ({r.doc_id for r in x} for x in stages[0])
    assert not after & bad and good & before <= after

    sets = {r.doc_id: plain_set(r.text, 5) for r in stages[1][0]}
    at = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                x, y = sorted((at[i], at[j]))
                at = {k: x if v == y else v for k, v in at.items()}
    assert {r.doc_id for r in stages[1][1]} == {i for i in at if at[i] == i}

    squeeze = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [squeeze(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in stages[2][0] if any(i in squeeze(r.text) for i in items)}
    assert {r.doc_id for r in stages[2][0]} - {r.doc_id for r in stages[2][1]} == leaked

    texts = {r.doc_id: r.text for r in stages[3][1]}
    assert texts.keys() == {r.doc_id for r in stages[3][0]}
    assert not any(re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", t) for t in texts.values())
    for r in stages[3][0]:
        assert re.fullmatch(".*".join(map(re.escape, texts[r.doc_id].split("[SECRET]"))), r.text, re.DOTALL)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.token_ids for r in stages[4][1]} == {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in stages[4][0]}


def test_odd_rows_and_extra_columns(spark):
    rows = [(*r, len(r[1] or ""), "more", 1) for r in BASE]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, kept int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
