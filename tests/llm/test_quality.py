import zlib

import numpy as np

from visagelake.llm import quality


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    told = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    unseen = [(r.predicted, told[r.doc_id]) for r in rows if r.held_out and r.doc_id in told]
    for label in (0, 1):
        own = [p == q for p, q in unseen if q == label]
        assert own and np.mean(own) >= 0.9, (label, np.mean(own))


def test_exact_cosines_against_brute_force():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["one", "two", "THREE!!", "4%%%"], 30)) for _ in range(600)]
    rows = np.stack([quality.features(t) for t in texts[:50]])
    model = quality.fit(rows, np.arange(50) % 2, {0: 100, 1: 300}, 16, 7)
    got = quality.vote(model, texts)
    for t, score in zip(texts, got):
        v = (quality.features(t) - model.mean) @ model.axes
        c = model.vectors @ (v / np.linalg.norm(v))
        near = sorted(range(50), key=lambda i: -c[i])[:7]
        w = np.maximum(c[near], 1e-3) ** 4 * model.weights[near]
        assert abs(score - (w * model.labels[near]).sum() / w.sum()) < 1e-3


def test_odd_rows(spark):
    rows = [(1, "some good text", "x"), (2, None, "x"), (3, "", "x"), (None, "text", "x"), (4, " \n ", "x"), (5, "word " * 100000, "x"), (1, "some good text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (5, None, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.score) for r in quality.classify(docs, labels).collect()]
    assert len(got) == 7 and [s for i, s in got if i in (2, 3, 4)] == [0.0] * 3
    assert len({s for i, s in got if i == 1}) == 1
    none = quality.classify(docs, labels.limit(0)).collect()
    assert sorted(r.score for r in none) == [0.0] * 3 + [0.5] * 4
    assert quality.classify(docs.limit(0), labels).collect() == []
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 4
