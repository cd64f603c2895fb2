import datetime
import re

from visagelake.operators import sidecar
from visagelake.sources import media

AT = datetime.datetime(2024, 1, 1)
KIND = "scar_path string, entry_key string, entry_value string, written_at timestamp, seq long"


def exchanges(df):
    """Lines of the plan with an exchange, and those with a scan of buckets."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [x for x in lines if "Exchange" in x], [x for x in lines if "Bucketed: true" in x]


def test_only_the_other_side_is_shuffled(spark, tmp_path):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(f"/p{k % 9}.scar", f"face.t{k % 4}.version", str(k), AT + datetime.timedelta(minutes=k), k) for k in range(60)]
    entries = spark.createDataFrame(rows, KIND)
    media.save_entries(sidecar.latest(entries.where("seq < 40")), "stored_by_bucket", str(tmp_path / "stored"), 6)
    merged = media.merge_stored(spark, "stored_by_bucket", entries.where("seq >= 40"), 6)
    moved, scans = exchanges(merged)
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0] and len(scans) == 1
    want = sidecar.latest(entries)
    assert sorted(map(tuple, merged.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    images = spark.createDataFrame([(f"/p{k}.jpg",) for k in range(12)], "path string")
    joined = sidecar.with_documents(images, sidecar.documents(spark.table("stored_by_bucket")))
    moved, scans = exchanges(joined)
    assert len(moved) == 1 and re.search(r"hashpartitioning\(scar_path#\d+, 6\)", moved[0]) and len(scans) == 1
    assert {r.path: len(r.entries) for r in joined.collect()} == {f"/p{k}.jpg": 4 if k < 9 else 1 for k in range(12)}
    spark.sql("drop table stored_by_bucket")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
