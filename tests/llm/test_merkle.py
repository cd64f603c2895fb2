import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests import oracle
from visagelake.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root of nodes, and the siblings (before, after) of each on its way up, by plain loops."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            first = at[i] // 3 * 3
            path.append(("".join(nodes[first : at[i]]), "".join(nodes[at[i] + 1 : first + 3])))
            at[i] //= 3
        nodes = [h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def wanted(rows):
    """Rows of audit() for (doc_id, text, lang, source, n_chars)."""
    of = {}
    for i, text, lang, source, n in rows:
        of.setdefault(source, []).append((i, leaf(i, source, lang, n, text), text, lang, n))
    order = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for s in order:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        low[s] = climb([r[1] for r in of[s]])
    root, paths = climb([low[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (i, own, text, lang, n), path in zip(of[s], low[s][1], strict=True):
            proof = path + paths[k]
            node = own
            if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and text is not None:
                node = leaf(i, s, lang, n, text.replace("\n", ""))
            for before, after in proof:
                node = h(before + node + after)
            out.append((i, own, low[s][0], root, h("".join(b + a for b, a in proof)), node, node == root))
    return sorted(out, key=str)


KIND = "doc_id long, text string, lang string, source string, n_chars long, tree string, proof int"


def audited(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)
    return sorted(map(tuple, merkle.audit(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 2}, {"a": 9, "b": 10, "": 1}, {"hot": 700, "b": 81, "c": 82, "d": 243, "é": 5, None: 27}])
def test_equals_plain_loops(spark, sizes):
    rng = random.Random(3)
    ids = rng.sample(range(10**6), sum(sizes.values()))
    rows = [(ids.pop(), rng.choice([None, "", "a\nb", "é\n", "x" * 3000, f"t{rng.random()}"]), rng.choice(["de", None]), s, rng.choice([None, 7])) for s, n in sizes.items() for _ in range(n)]
    assert audited(spark, rows) == wanted(rows)


def test_many_sources_and_repeated_rows(spark):
    rows = [(i % 40 or None, "a\nb" if i % 3 else None, "de", f"s{i % 100}", 1) for i in range(450)] + [(5, "same\n", "de", "hot", None)] * 300
    got = audited(spark, rows)
    assert got == wanted(rows)
    assert {r[-1] for r in got if r[0] is None} == {True} and False in {r[-1] for r in got}


def test_no_rows(spark):
    assert audited(spark, []) == []


def test_every_change_is_seen(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "de", f"s{i % 4}", i) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.manifest(docs)
    rows = found.select("root", merkle.fold(found.leaf, found.proof).alias("same"), merkle.fold(F.sha2("leaf", 256), found.proof).alias("changed")).collect()
    assert len(rows) == 200 and len({r.root for r in rows}) == 1
    assert all(r.same == r.root != r.changed for r in rows)


def test_documents_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = oracle.rows_of_spark(merkle.audit(spark.read.parquet(f"{sf}/documents.parquet")))
    assert got == oracle.rows_of_duck(oracle.connect(sf), merkle.ORACLE)
