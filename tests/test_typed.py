from pyspark.sql import functions as F

from visagelake.operators import sidecar, sketches, typed

KIND = "scar_path string, entry_key string, entry_value string, written_at timestamp, seq long"


def test_values_keep_their_types(spark):
    rows = [("s", "face.a.n", "1.5", None, 1), ("s", "face.a.t", "1.5.0", None, 1), ("s", "face.a.z", None, None, 1), ("s", "face.a.l", '[1, "x"]', None, 1), ("s", "face.a.e", "", None, 1), ("s", "face.a.j", "null", None, 1)]
    entries = typed.typed(spark.createDataFrame(rows, KIND))
    kind = {r.entry_key[-1]: r.kind for r in typed.kinds(entries).collect()}
    assert kind["n"].startswith("DECIMAL") and kind["t"] == "STRING" and kind["l"].startswith("ARRAY") and kind["e"] == "STRING"
    e = F.col("entries")
    one = sidecar.documents(sidecar.latest(entries)).select(
        typed.field(e, "a", "n", "$", "double").alias("n"), typed.field(e, "a", "l", "$[1]", "string").alias("x"), typed.field(e, "a", "l", "$[1]", "int").alias("wrong"), typed.field(e, "a", "none", "$", "int").alias("none")
    ).first()
    assert (one.n, one.x, one.wrong, one.none) == (1.5, "x", None, None)
    shown = {r.field: r.shown for r in typed.inspect_summary(entries).collect()}
    assert shown == {"n": "1.5", "t": "1.5.0", "z": None, "l": '[1,"x"]', "e": "", "j": None}


def test_sketches_merge_within_their_bounds(spark):
    counts = spark.range(60_000).select(F.col("id").alias("media_id"), (F.col("id") % 7).alias("g"), (F.col("id") % 11).alias("h"), F.when(F.col("id") % 11 != 10, (F.col("id") * 7919) % 10_007).alias("n_faces"))
    stored = sketches.sketched(counts, ["g", "h"])
    ranks = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    for by in (["g"], ["h"]):
        estimated = sketches.estimates(sketches.merged(stored, by), ranks)
        rows = {r[by[0]]: r for r in estimated.collect()}
        exact = {r[by[0]]: r for r in counts.groupBy(*by).agg(F.count("*").alias("n")).collect()}
        assert rows.keys() == exact.keys()
        for key, row in rows.items():
            assert row.images == exact[key].n and abs(row["distinct"] - row.images) <= sketches.COUNT_ERROR * row.images
        shares = sketches.rank_range(counts, estimated, by, ranks)
        for row in shares.collect():
            for name, rank in ranks.items():
                if row[f"{name}_below"] is not None:
                    assert row[f"{name}_below"] <= rank + sketches.RANK_ERROR and row[f"{name}_up_to"] >= rank - sketches.RANK_ERROR
        if by == ["h"]:
            assert rows[10].q50 is None and rows[10].images == exact[10].n
    assert not sketches.sketched(counts.limit(0), ["g"]).collect()
