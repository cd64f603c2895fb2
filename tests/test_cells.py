import numpy as np
import pytest

from visagelake.operators import cells, vectors

KIND = "media_id long, face_index int, embedding array<double>"


def identities(seed, groups, size, dim=16, spread=0.05):
    rng = np.random.default_rng(seed)
    return np.concatenate([c + rng.standard_normal((size, dim)) * spread for c in rng.standard_normal((groups, dim))])


def unit_faces(spark, x):
    return vectors.normalize(spark.createDataFrame([(i // 3, i % 3, [float(v) for v in row]) for i, row in enumerate(x)], KIND))


def all_pairs(x, k):
    """(face, neighbour, rank) of every face by the whole matrix of similarities, equal ones by number."""
    u = vectors.unit_rows(np.asarray(x, dtype=float))
    scores = np.round(u @ u.T, 12)
    np.fill_diagonal(scores, -np.inf)
    order = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    return {(i, int(j), r + 1) for i, row in enumerate(order) for r, j in enumerate(row)}


def found(df):
    return {(r.media_id * 3 + r.face_index, r.neighbour_media * 3 + r.neighbour_face, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize(("k", "block_rows"), [(1, 9), (4, 30), (7, 1000)])
def test_equals_all_pairs(spark, k, block_rows):
    x = np.concatenate([identities(1, 9, 14), np.random.default_rng(2).standard_normal((20, 16))])
    assert found(vectors.top_k(unit_faces(spark, x), k, block_rows)) == all_pairs(x, k)


def test_one_hot_cell_is_cut_into_rings_and_pieces(spark):
    x = np.concatenate([identities(3, 1, 200, spread=0.3), identities(4, 5, 6)])
    faces = unit_faces(spark, x)
    centres = cells.centres_of(faces, 40)
    rows = cells.ringed(cells.placed(faces, centres), 40)
    units = cells.units_of(rows, centres, 40)
    sizes = [r["count"] for r in cells.dealt(rows, units).groupBy("unit", "piece").count().collect()]
    assert sum(sizes) == len(x) and max(sizes) <= 80
    assert found(vectors.top_k(faces, 3, 40)) == all_pairs(x, 3)


def test_equal_vectors_and_too_few(spark):
    x = np.repeat(np.eye(4)[:2], 30, axis=0)
    got = found(vectors.top_k(unit_faces(spark, x), 3, 10))
    assert got == all_pairs(x, 3)
    assert found(vectors.top_k(unit_faces(spark, np.eye(3)), 5, 1)) == all_pairs(np.eye(3), 5)
    assert vectors.top_k(unit_faces(spark, np.eye(3)).limit(0), 5).collect() == []


def test_few_of_equal_vectors_answer(spark):
    equal = np.repeat(np.eye(4)[:3], 400, axis=0)
    faces = unit_faces(spark, equal[np.random.default_rng(7).permutation(len(equal))])
    assert cells.met_share(faces, 2, 50) < 0.06  # their own pieces; a third of all pairs is of equal vectors
    x = np.concatenate([identities(8, 3, 20), np.repeat(identities(9, 2, 1), 70, axis=0), identities(10, 4, 15)])
    x = x[np.random.default_rng(11).permutation(len(x))]
    assert found(vectors.top_k(unit_faces(spark, x), 4, 12)) == all_pairs(x, 4)
    packed = unit_faces(spark, x).select(*cells.KEY, cells.as_bytes("embedding").alias("packed"))
    kept = cells.few_equal(packed, 5)
    assert kept.count() == len(x) - 2 * 65 and "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_identities_skip_most_pairs(spark):
    faces = unit_faces(spark, identities(5, 40, 50, dim=32, spread=0.02))
    assert cells.met_share(faces, 5, 50) < 0.25


def test_bounds_hold(spark):
    x = vectors.unit_rows(identities(6, 12, 20))
    faces = unit_faces(spark, x)
    centres = cells.centres_of(faces, 15)
    rows = cells.ringed(cells.placed(faces, centres), 15)
    units = cells.units_of(rows, centres, 15)
    unit = {r.media_id * 3 + r.face_index: r.unit for r in cells.dealt(rows, units).collect()}
    apart = cells.distances(x, x)
    bounds = units.bounds(x)
    assert all(bounds[i, unit[j]] <= apart[i, j] + cells.SLACK for i in range(len(x)) for j in range(len(x)))


def test_faces_are_sent_to_few_blocks(spark):
    assert [cells.blocks_of(n, 64, 2000) for n in (1, 4_000, 100_000, 1_000_000)] == [1, 2, 16, 16]
    assert cells.blocks_of(10_000_000, 64, 2000) * cells.BLOCK_BYTES >= 10_000_000 * 64 * 8
    rows, units, blocks = cells.asking_of(unit_faces(spark, identities(7, 30, 20)), 3, 10)
    sizes = [r["count"] for r in rows.groupBy("block").count().collect()]
    assert units.pieces.sum() > 16 and len(sizes) <= blocks == cells.BLOCKS and sum(sizes) == 600 and max(sizes) <= 150


def test_equal_scores_go_by_key_in_every_block(spark, monkeypatch):
    monkeypatch.setattr(cells, "ANSWERS", 7)
    monkeypatch.setattr(cells, "ASKING", 11)
    monkeypatch.setattr(cells, "AGAIN", 13)
    x = np.tile(np.random.default_rng(3).standard_normal((6, 64)), (25, 1))
    held = cells.Held(4, alike=True)
    u = vectors.unit_rows(x)
    keys = np.arange(len(u))
    held.ask(keys // 3, keys % 3, u, np.full(len(u), -1.0))
    for some in np.array_split(np.random.default_rng(4).permutation(len(u)), 5):
        held.answer(some // 3, some % 3, u[some])
    out = held.found().to_pylist()
    got = {(r["media_id"] * 3 + r["face_index"], r["neighbour_media"] * 3 + r["neighbour_face"]) for r in out}
    assert got == {(i, j) for i in range(len(u)) for j in [j for j in range(i % 6, len(u), 6) if j != i][:4]}
