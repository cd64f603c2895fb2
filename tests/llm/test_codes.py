import hashlib
import math

import numpy as np
import pytest

from tests import oracle
from visagelake.llm import codes


def plain(rows, parts=8, entries=16, rounds=6):
    """Rows of compress() for (vec_id, vector, label), by plain loops over all entries."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def assigned(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(assigned(p, cut(v, p))[1], []).append(cut(v, p))
            fresh.append([[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])])
        books = fresh
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [assigned(p, cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    return sorted(((i, c, e, sum(r[2] for r in out if r[3] == label), digest) for i, c, e, label in out), key=str)


def compressed(spark, rows, **options):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, v int").repartition(3)
    return sorted(map(tuple, codes.compress(table, **options).collect()), key=str)


def vectors(n, dim, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in v] for v in rng.standard_normal((n, dim)) * spread]


def test_equals_plain_loops(spark):
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors(150, 16))]
    rows += [(500 - i, [round(2 * x) / 4 for x in v], 7) for i, v in enumerate(vectors(60, 16, 1))]  # ties
    rows += [(None, rows[0][1], 1), (3, rows[5][1], None), (4, None, 1), (9, [float("nan")] * 16, 1), (9, [float("inf")] + [0.0] * 15, 1), (9, [None] + [0.0] * 15, None)]
    assert compressed(spark, rows) == plain(rows)


def test_equal_vectors_labels_without_bound_and_few_entries(spark, monkeypatch):
    rows = [(i, [0.25] * 8, i % 5) for i in range(40)] + [(90 + i, v, None) for i, v in enumerate(vectors(3, 8))]
    want = plain(rows)
    assert compressed(spark, rows) == want
    monkeypatch.setattr(codes, "LABELS", 2)
    assert compressed(spark, rows) == want
    few = rows[-2:]
    assert compressed(spark, few) == plain(few)
    assert compressed(spark, rows, parts=2, entries=5, rounds=2) == plain(rows, 2, 5, 2)


def test_none_and_impossible(spark):
    assert compressed(spark, []) == [] and compressed(spark, [(1, None, 1)]) == []
    for bad in ([[1.0] * 8, [1.0] * 16], [[1.0] * 9], [[1e30] * 8]):
        with pytest.raises(ValueError, match="components"):
            compressed(spark, [(i, v, 1) for i, v in enumerate(bad)])


@pytest.mark.parametrize("width", [1, 2, 8])
def test_nearest_equals_all_distances(width):
    rng = np.random.default_rng(width)
    for spread in (2, 50, 5000):
        parts, entries = rng.integers(-spread, spread, (400, width)), rng.integers(-spread, spread, (16, width))
        all_of = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        index, distance = codes.nearest(parts, entries)
        assert (index == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()


def test_embeddings_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.rows_of_spark(codes.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))) == oracle.rows_of_duck(oracle.connect(sf), codes.oracle())
