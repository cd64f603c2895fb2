import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import xxhash

from visagelake.llm import sharding


def check(rows, want, shards):
    assert len(rows) == len(want)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in want)
    counts = Counter(r.shard for r in rows)
    sizes = [counts[s] for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}


def test_laws_on_hot_text(spark):
    want = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)] + [(None, "x"), (None, None), (5, ""), (7, "é" * 50000), (7, "é" * 50000), (7, "é" * 50000)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in want], "doc_id long, text string, shard string, slot int")
    check(sharding.assign(docs, shards=7, vnodes=16, part_rows=100).collect(), want, 7)


def test_documents_and_movement(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = [(r.doc_id, r.text) for r in docs.collect()]
    many = docs.unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "concat(text, 'a') as text", "lang", "source", "n_chars")).unionByName(docs.selectExpr("doc_id + 2000 as doc_id", "concat(text, 'b') as text", "lang", "source", "n_chars"))
    check(sharding.assign(docs).collect(), want, 40)
    eight, nine = ({r.doc_id: r.shard for r in sharding.assign(many, shards=k).collect()} for k in (8, 9))
    assert sum(eight[i] != nine[i] for i in eight) < 0.4 * len(eight)


def test_few_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    check(sharding.assign(docs).collect(), [(1, "a"), (2, "a")], 40)
    assert sharding.assign(docs.limit(0)).collect() == []


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_ring(rows, shards, vnodes, part_rows):
    """The ring one row after another: the rows of an arc by part, key and id; each goes to the arc's shard, or waits if
    that is full; those that wait go on clockwise, arc by arc."""
    hashed = lambda text: xxhash.xxh64_intdigest(text.encode(), seed=42)
    nodes = {}
    for k in range(shards * vnodes):
        cell = hashed(f"node:{k}") >> 48
        nodes[cell] = min(nodes.get(cell, shards), k // vnodes)
    cells = sorted(nodes)
    arc_of = {i: bisect_left(cells, hashed(t or "") >> 48) % len(cells) for i, t in rows}
    sizes = Counter(arc_of.values())
    part = lambda i, t: signed(xxhash.xxh64_intdigest(hashed(t or "").to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42))) % -(-sizes[arc_of[i]] // part_rows)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    shard, waiting = {}, []
    for i, t in sorted(rows, key=lambda r: (arc_of[r[0]], part(*r), signed(hashed(r[1] or "")), r[0])):
        own = nodes[cells[arc_of[i]]]
        if room[own]:
            room[own] -= 1
            shard[i] = own
        else:
            waiting.append(i)
    for i in waiting:
        for step in range(1, len(cells) + 1):
            other = nodes[cells[(arc_of[i] + step) % len(cells)]]
            if room[other]:
                room[other] -= 1
                shard[i] = other
                break
    return shard


def test_every_row_against_a_plain_ring(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}" if i % 7 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.assign(docs, shards=7, vnodes=16, part_rows=100).collect()}
    assert got == plain_ring(rows, 7, 16, 100)


def test_repeated_rows_are_split(spark):
    want = [(1, "copy")] * 2500 + [(i, f"text {i}") for i in range(500)] + [(None, None)] * 3
    docs = spark.createDataFrame(want, "doc_id long, text string")
    check(sharding.assign(docs, shards=5, vnodes=8, part_rows=100).collect(), want, 5)


def test_movement(spark):
    """What moves: with one more shard little beyond its fair part, and without some rows little at all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    at = lambda df, k: {r.doc_id: r.shard for r in sharding.assign(df, shards=k).collect()}
    forty, more, fewer = at(docs, 40), at(docs, 41), at(docs.where("doc_id % 100 <> 7"), 40)
    assert sum(forty[i] != more[i] for i in forty) <= 0.25 * len(forty)
    assert sum(forty[i] != fewer[i] for i in fewer) <= 0.15 * len(fewer)
