import numpy as np
import pytest
from pyspark.sql import functions as F

from visagelake.operators import clustering, vectors


def brute(x, k=2):
    """Top-down condensed tree over a dense tree of mutual reachability; label sets of the chosen clusters."""
    n = len(x)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    core = np.sort(d + np.where(np.eye(n), np.inf, 0), axis=1)[:, k - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, edges = {0}, []
    while len(inside) < n:
        w, i, j = min((reach[i, j], i, j) for i in inside for j in range(n) if j not in inside)
        edges.append((w, i, j))
        inside.add(j)
    edges.sort(reverse=True)

    def side(points, links, start):
        seen, todo = {start}, [start]
        while todo:
            a = todo.pop()
            for _, i, j in links:
                for u, v in ((i, j), (j, i)):
                    if u == a and v in points and v not in seen:
                        seen.add(v)
                        todo.append(v)
        return seen

    def grow(points, links, birth):
        """Stability and chosen clusters of the cluster born with these points."""
        stability, now, links = 0.0, set(points), list(links)
        while links:
            w, i, j = links.pop(0)
            density = 1 / max(w, 1e-9)
            a, b = side(now, links, i), side(now, links, j)
            if len(a) >= 2 and len(b) >= 2:
                stability += len(now) * (density - birth)
                parts = [grow(s, [e for e in links if e[1] in s], density) for s in (a, b)]
                below = sum(p[0] for p in parts)
                return (stability, [points]) if stability >= below else (below, parts[0][1] + parts[1][1])
            for s in (a, b):
                if len(s) == 1:
                    stability += density - birth
                    now -= s
        return stability, [points]

    now, links = set(range(n)), list(edges)
    while links:  # the root is no cluster
        w, i, j = links.pop(0)
        a, b = side(now, links, i), side(now, links, j)
        if len(a) >= 2 and len(b) >= 2:
            return {frozenset(c) for s in (a, b) for c in grow(s, [e for e in links if e[1] in s], 1 / w)[1]}
        for s in (a, b):
            if len(s) == 1:
                now -= s
    return set()


def blobs(seed, groups, size, noise):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 16))
    points = [c + rng.standard_normal((size, 16)) * rng.choice([0.05, 0.2]) for c in centres]
    return np.concatenate([*points, rng.standard_normal((noise, 16))])


def faces_of(spark, x):
    return spark.createDataFrame([(i // 3, i % 3, [float(v) for v in row]) for i, row in enumerate(x)], "media_id long, face_index int, embedding array<double>")


@pytest.mark.parametrize(("block_rows", "level_edges"), [(1500, 200_000), (12, 9)])
def test_equals_brute_force(spark, block_rows, level_edges):
    x = blobs(4, 4, 7, 6)
    got = {}
    for r in clustering.cluster_faces(faces_of(spark, x), block_rows=block_rows, level_edges=level_edges).collect():
        got.setdefault(r.label, set()).add(r.media_id * 3 + r.face_index)
    found = {frozenset(v) for k, v in got.items() if k >= 0}
    assert found == brute(x)
    firsts = [min(got[k]) for k in sorted(got) if k >= 0]
    assert firsts == sorted(firsts) and sorted(k for k in got if k >= 0) == list(range(len(firsts)))


def test_equal_vectors_as_one_node_change_nothing(spark, monkeypatch):
    x = np.concatenate([np.repeat(blobs(9, 1, 1, 0), 20, axis=0), blobs(4, 3, 7, 5), np.repeat(blobs(11, 1, 1, 0), 2, axis=0)])
    labels = lambda: {(r.media_id, r.face_index): r.label for r in clustering.cluster_faces(faces_of(spark, x), block_rows=12, level_edges=30).collect()}
    got = labels()
    assert len({got[i // 3, i % 3] for i in range(20)}) == 1 and got[0, 0] == 0
    apart = lambda keyed: (keyed.select("node", F.col("node").alias("rep")).limit(0), keyed.withColumn("size", F.lit(1).cast("long")))
    monkeypatch.setattr(clustering, "contracted", apart)
    assert labels() == got


def test_small_and_equal(spark):
    one = faces_of(spark, np.ones((1, 4)))
    assert [r.label for r in clustering.cluster_faces(one).collect()] == [-1]
    assert clustering.cluster_faces(one.limit(0)).collect() == []
    x = np.repeat(np.eye(4)[:2], 4, axis=0)
    labels = {r.media_id * 3 + r.face_index: r.label for r in clustering.cluster_faces(faces_of(spark, x)).collect()}
    assert [labels[i] for i in range(8)] == [0] * 4 + [1] * 4
    with pytest.raises(ValueError, match="dimensions"):
        clustering.cluster_faces(spark.createDataFrame([(1, 0, [1.0]), (1, 1, [1.0, 2.0])], "media_id long, face_index int, embedding array<double>"))


def graph_tree(x, core):
    """Weight of the minimum spanning tree of mutual reachability over all pairs."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    best, left, total = reach[0].copy(), set(range(1, len(x))), 0.0
    while left:
        j = min(left, key=lambda i: best[i])
        total += best[j]
        left.remove(j)
        best = np.minimum(best, reach[j])
    return total


def test_rounds_and_one_task_pick_the_same_tree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 60, 400), rng.integers(60, 120, 400), rng.integers(0, 9, 400), strict=True)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "a long, b long, w double")
    once = sorted(map(tuple, clustering.minimum_spanning_tree(edges).collect()))
    monkeypatch.setattr(clustering, "FEW", 10)
    assert sorted(map(tuple, clustering.minimum_spanning_tree(edges).collect())) == once
    named = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    many = sorted(map(tuple, clustering.joined(named).collect()))
    monkeypatch.setattr(clustering, "FEW", 1000)
    assert sorted(map(tuple, clustering.joined(named).collect())) == many


@pytest.mark.parametrize(("x", "block_rows"), [(blobs(2, 8, 12, 0), 12), (blobs(7, 3, 30, 20), 15), (np.concatenate([blobs(5, 1, 150, 0), np.repeat(np.eye(16)[:3], 2, axis=0)]), 20)])
def test_edges_hold_the_tree_of_all(spark, x, block_rows):
    unit = vectors.normalize(faces_of(spark, x)).withColumn("node", F.col("media_id") * 3 + F.col("face_index"))
    cores = vectors.core_distance(unit, 2, block_rows)
    tree = clustering.minimum_spanning_tree(clustering.spanning_edges(unit, cores, block_rows))
    found = {r.media_id * 3 + r.face_index: r.core for r in cores.collect()}
    want = graph_tree(vectors.unit_rows(x), np.array([found[i] for i in range(len(x))]))
    edges = tree.collect()
    assert len(edges) == len(x) - 1 and sum(r.w for r in edges) == pytest.approx(want)


def first_tree(node, x, core):
    """The edges (a, b, w) of the minimum spanning tree over all pairs that come first in the order of (w, a, b)."""
    pairs = []
    for i in range(len(x)):
        w = np.maximum(np.maximum(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), core), core[i])
        pairs += [(float(w[j]), min(node[i], node[j]), max(node[i], node[j])) for j in range(i)]
    part, tree = {k: k for k in node}, []
    for w, a, b in sorted(pairs):
        one, other = part[a], part[b]
        if one != other:
            part = {k: one if p == other else p for k, p in part.items()}
            tree.append((a, b, w))
    return sorted(tree)


@pytest.mark.parametrize(("block_rows", "last", "few"), [(1500, 4000, 100_000), (23, 10, 40)])
def test_the_first_tree_is_found_whatever_the_blocks(spark, monkeypatch, block_rows, last, few):
    x = np.concatenate([blobs(3, 4, 20, 40), np.repeat(np.eye(16)[:2], 2, axis=0)])
    unit = vectors.normalize(faces_of(spark, x)).withColumn("node", (F.col("media_id") * 3 + F.col("face_index")) * 37 % 1009)
    cores = vectors.core_distance(unit, 2, 1500).localCheckpoint()
    monkeypatch.setattr(clustering, "LAST", last)
    monkeypatch.setattr(clustering, "FEW", few)
    got = clustering.minimum_spanning_tree(clustering.spanning_edges(unit, cores, block_rows)).collect()
    rows = unit.join(cores, vectors.KEY).collect()
    want = first_tree([r.node for r in rows], np.array([r.embedding for r in rows]), np.array([r.core for r in rows]))
    assert sorted(map(tuple, got)) == want


def test_edges_grow_as_faces_do(spark):
    for n in (400, 800):
        unit = vectors.normalize(faces_of(spark, np.random.default_rng(n).standard_normal((n, 64)))).withColumn("node", F.col("media_id") * 3 + F.col("face_index"))
        cores = vectors.core_distance(unit, 2, 50).localCheckpoint()
        assert clustering.spanning_edges(unit, cores, 50).count() < 3 * n


def test_bottlenecks_of_the_order(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = {(k - 1 - int(rng.integers(0, min(k, 9))), k): float(rng.integers(1, 30)) for k in range(1, 90)} | {(int(a), int(a + b)): float(w) for a, b, w in zip(rng.integers(0, 60, 60), rng.integers(1, 30, 60), rng.integers(1, 30, 60), strict=True)}
    most = np.full((90, 90), np.inf)
    for (a, b), w in edges.items():
        most[a, b] = most[b, a] = min(w, most[a, b])
    for k in range(90):
        most = np.minimum(most, np.maximum(most[:, k][:, None], most[k]))
    table = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w double")
    for few in (1000, 25):
        monkeypatch.setattr(clustering, "FEW", few)
        found = sorted(clustering.in_order(spark.range(90).select(F.col("id").alias("node")), table).collect(), key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(90))
        for i in range(90):
            for j in range(i + 1, 90):
                assert max(r.joins for r in found[i + 1 : j + 1]) == most[found[i].node, found[j].node]


def test_forest_keeps_the_first_edges():
    rng = np.random.default_rng(2)
    node = rng.permutation(50)
    a, b = rng.integers(0, 50, 600), rng.integers(0, 50, 600)
    a, b = a[a != b], b[a != b]
    w = rng.integers(0, 6, len(a)).astype(float)
    at, want = list(range(50)), []
    for k in sorted(range(len(a)), key=lambda k: (w[k], min(node[a[k]], node[b[k]]), max(node[a[k]], node[b[k]]))):
        i, j = at[a[k]], at[b[k]]
        if i != j:
            at = [i if v == j else v for v in at]
            want.append((w[k], *sorted((node[a[k]], node[b[k]]))))
    got = clustering.forest(a, b, w, node)
    assert sorted((w[k], *sorted((node[a[k]], node[b[k]]))) for k in got) == sorted(want)


def test_identities_need_few_trees_of_two_pieces(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.standard_normal((40, 8)) * 0.01 for c in rng.standard_normal((12, 8))])
    unit = vectors.normalize(faces_of(spark, x)).withColumn("node", F.col("media_id") * 3 + F.col("face_index"))
    met, whole = clustering.met_share(unit, vectors.core_distance(unit, 2, 40), 40)
    assert met < 0.7 and whole < 0.2


def test_equal_distances_fill_levels_exactly(spark):
    tree = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.5).alias("w"))
    sizes = {r.level: r["count"] for r in clustering.leveled(tree, 300).groupBy("level").count().collect()}
    assert sizes == {k: 300 if k < 33 else 100 for k in range(34)}
    x = np.concatenate([np.eye(24), np.repeat(np.eye(24)[:4], 2, axis=0) + 0.01 * np.eye(24)[:8]])
    labels = lambda most: {(r.media_id, r.face_index): r.label for r in clustering.cluster_faces(faces_of(spark, x), level_edges=most).collect()}
    assert labels(7) == labels(1000)


def test_block_size_does_not_change_neighbours(spark):
    unit = vectors.normalize(faces_of(spark, blobs(1, 3, 10, 5)))
    want = sorted(tuple(r)[:4] + (r["rank"],) for r in vectors.top_k(unit, 4).collect())
    assert sorted(tuple(r)[:4] + (r["rank"],) for r in vectors.top_k(unit, 4, block_rows=7).collect()) == want


def test_collection_entries_and_summary(spark):
    x = np.repeat(np.eye(4)[:2], 4, axis=0)
    faces = faces_of(spark, x).withColumn("scar_path", F.concat(F.lit("p"), "media_id"))
    entries, summary = clustering.cluster_collection(faces, "dlib_embed", F.lit("2024-01-01").cast("timestamp"), F.lit(1))
    got = {(r.scar_path, r.entry_key): r.entry_value for r in entries.collect()}
    assert got["p1", "face.cluster_dlib.labels"] == "[0,1,1]" and got["p1", "face.cluster_dlib.num_clusters"] == "2"
    assert tuple(summary.first()) == ("ok", 8, 4, 2, 3, "dlib_embed")
    entries, summary = clustering.cluster_collection(faces.limit(0), "arcface", F.lit("2024-01-01").cast("timestamp"), F.lit(1))
    assert entries.collect() == [] and summary.first().status == "no_embeddings"


def test_export(spark, tmp_path):
    vectors.export_index(faces_of(spark, np.eye(3)), "arcface", str(tmp_path))
    vectors.export_index(faces_of(spark, np.eye(2)), "dlib_embed", str(tmp_path))
    assert spark.read.json(str(tmp_path / "faces")).groupBy("embedding_tool").count().orderBy("embedding_tool").collect() == [("arcface", 3), ("dlib_embed", 2)]
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 5


def test_stored_index_answers_as_all_pairs(spark, tmp_path):
    x = np.concatenate([blobs(3, 10, 20, 0), np.random.default_rng(1).standard_normal((10, 16))])
    faces = faces_of(spark, x)
    part = F.pmod("media_id", F.lit(4))
    vectors.export_index(faces.where(part < 2), "arcface", str(tmp_path), 15)
    vectors.append_index(faces.where(part == 2), "arcface", str(tmp_path), 15)
    asking = faces.where(part == 3)
    got = {(r.media_id * 3 + r.face_index, r.neighbour_media * 3 + r.neighbour_face, r["rank"]) for r in vectors.search_index(asking, "arcface", str(tmp_path), 4, 15).collect()}
    u = vectors.unit_rows(x)
    kept = np.array([i for i in range(len(x)) if i // 3 % 4 < 3])
    want = set()
    for i in range(len(x)):
        if i // 3 % 4 == 3:
            want |= {(i, int(j), r + 1) for r, j in enumerate(kept[np.argsort(-(u[kept] @ u[i]), kind="stable")[:4]])}
    assert got == want
    assert vectors.search_index(asking.limit(0), "arcface", str(tmp_path), 4, 15).collect() == []
    itself = vectors.search_index(faces.where("media_id = 0"), "arcface", str(tmp_path), 1, 15).collect()
    assert all((r.media_id, r.face_index) == (r.neighbour_media, r.neighbour_face) for r in itself) and len(itself) == 3
    vectors.export_index(faces.limit(0), "empty", str(tmp_path), 15)
    assert vectors.search_index(asking, "empty", str(tmp_path), 4, 15).collect() == []


def test_search_reads_only_some_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.standard_normal((40, 8)) * 0.01 for c in rng.standard_normal((10, 8))])
    vectors.export_index(faces_of(spark, x), "arcface", str(tmp_path), 40)
    found = vectors.search_index(faces_of(spark, x[:3]), "arcface", str(tmp_path), 3, 40)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    cells = {r.cell for r in spark.read.parquet(str(tmp_path / "vectors" / "embedding_tool=arcface")).select("cell").distinct().collect()}
    assert len(cells) > 4 and "cell" in plan and found.count() == 9
