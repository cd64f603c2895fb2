import itertools
import random

import duckdb
import numpy as np
import pytest

from visagelake.llm import neardup


def plain_set(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, percent):
    sets = [(i, plain_set(t, words)) for i, t in rows if i is not None]
    at = {i: i for i, _ in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            at[y] = x
    return {i: root(i) for i in at}


def noisy(rng, base, share):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) if rng.random() < share else w for w in base)


@pytest.mark.parametrize(("words", "percent", "list_rows", "set_shingles"), [(3, 85, 1000, 200_000), (5, 80, 4, 500)])
def test_components_against_brute_force(spark, monkeypatch, words, percent, list_rows, set_shingles):
    monkeypatch.setattr(neardup, "LIST_ROWS", list_rows)
    monkeypatch.setattr(neardup, "SET_SHINGLES", set_shingles)
    rng = random.Random(words)
    rows = [(5, None), (6, ""), (7, " \t"), (8, "Two words"), (9, "two  WORDS"), (10, "É two"), (11, "é two"), (None, "null id text here"), (12, "w " * 60000), (13, "w " * 50000)]
    for g in range(6):
        base = [f"word{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 250))]
        rows += [(1000 * (g + 1) + k, noisy(rng, base, rng.choice([0, 0.005, 0.01, 0.03, 0.06]))) for k in range(25)]
    rows += rows[-3:]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, kept int, digest string")
    got = neardup.near_duplicates(docs, words=words, percent=percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, words, percent)
    sizes = {i: len(plain_set(t, words)) for i, t in rows}
    for r in got:
        assert r.n_shingles == sizes[r.doc_id]
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    kept = neardup.keep_first(docs, words=words, percent=percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, *(i for i, c in want.items() if i == c)}


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, n_shingles, component_id, kept from ({neardup.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in neardup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), words=3, percent=85).collect()) == want


def test_signature_estimates():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    close = np.mean([(neardup.signature(h[k : k + 900], 64) == neardup.signature(h[k + 100 : k + 1000], 64)).mean() for k in range(0, 2000, 50)])
    assert abs(close - 0.8) < 0.03
    assert neardup.match_threshold(64, 85) in range(28, 40)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == []
