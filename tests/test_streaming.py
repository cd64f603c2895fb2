import datetime

import pytest

from visagelake.operators import sidecar
from visagelake.streaming import jobs, ledger

AT = datetime.datetime(2024, 1, 1)


def files(spark, rows, kind, folder):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(folder))
    return folder


def test_duplicates_within_the_watermark(spark, tmp_path):
    rows = [[("/a.jpg", AT), ("/a.jpg", AT + datetime.timedelta(hours=1)), ("/b.txt", AT)], [("/a.jpg", AT + datetime.timedelta(hours=2)), ("/c.png", AT)]]
    files(spark, rows, "path string, at timestamp", tmp_path / "in")
    stream = jobs.once_per_path(jobs.discover(jobs.table_stream(spark, str(tmp_path / "in"), files_per_trigger=1)))
    jobs.finish(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["/a.jpg", "/c.png"]


def test_one_job_a_day_and_state_that_shrinks(spark, tmp_path):
    at = lambda hours: AT + datetime.timedelta(hours=hours)
    days = [[("/a.jpg", at(1)), ("/a.jpg", at(2)), ("/b.png", at(3))], [("/a.jpg", at(24 * 4)), ("/b.txt", at(24 * 4))], [("/a.jpg", at(24 * 4 + 1)), ("/c.jpg", at(24 * 4 + 2)), ("/late.jpg", at(5))]]
    files(spark, days[:1], "path string, at timestamp", tmp_path / "in")
    stream = jobs.once_per_day(jobs.discover(jobs.table_stream(spark, str(tmp_path / "in"), files_per_trigger=1)))
    kept = []
    for n in range(len(days)):
        if n:
            files(spark, days[n : n + 1], "path string, at timestamp", tmp_path / "in")
        run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
        kept.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.path, r.day) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("/a.jpg", AT), ("/a.jpg", at(24 * 4)), ("/b.png", AT), ("/c.jpg", at(24 * 4))]
    assert kept == [2, 1, 2]  # the first day's ids are gone


def test_failures_leave_the_state(spark, tmp_path):
    rows = [[("failed", AT), ("ok", AT), ("failed", AT + datetime.timedelta(minutes=5))], [("failed", AT + datetime.timedelta(days=3))]]
    files(spark, rows, "status string, at timestamp", tmp_path / "in")
    stream = jobs.live_failures(jobs.table_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    jobs.finish(stream.select("failures"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [r.failures for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_merge_again_is_the_same(spark, tmp_path):
    kind = "scar_path string, entry_key string, entry_value string, written_at timestamp, seq long"
    rows = [[("s", "face.a.x", "1", AT, 1), ("s", "pose.y", "1", AT, 2)], [("s", "face.a.x", "2", AT, 3), ("t", "k", "1", AT, 4)]]
    files(spark, rows, kind, tmp_path / "in")
    for again in range(2):
        run = jobs.merge_patches(jobs.table_stream(spark, str(tmp_path / "in"), files_per_trigger=1), str(tmp_path / "out"), str(tmp_path / f"check{again}"))
        run.awaitTermination()
    last = jobs.merged(spark, str(tmp_path / "out"))
    want = sidecar.latest(spark.createDataFrame([r for part in rows for r in part], kind))
    assert sorted(map(tuple, last.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


KIND = "scar_path string, entry_key string, entry_value string, written_at timestamp, seq long"


def test_versions_and_manifests_stay_few(spark, tmp_path):
    target, seen = str(tmp_path / "out"), []
    for batch in range(12):
        rows = [(f"s{(batch * 7 + k) % 5}", f"k{k}", str(batch), AT + datetime.timedelta(hours=batch), batch * 10 + k) for k in range(1 + batch % 3)]
        seen += rows
        jobs.merge_batch(spark.createDataFrame(rows, KIND), target, batch, buckets=3)
        if batch % 5 == 4:  # the batch is run again
            jobs.merge_batch(spark.createDataFrame(rows, KIND), target, batch, buckets=3)
        assert len(list((tmp_path / "out" / "data").glob("version=*/bucket=*"))) <= 2 * 3
        assert len([f for f in (tmp_path / "out" / "manifest").iterdir() if f.name.isdigit()]) <= 2
        want = sidecar.latest(spark.createDataFrame(seen, KIND))
        assert sorted(map(tuple, jobs.merged(spark, target).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    jobs.merge_batch(spark.createDataFrame([], KIND), target, 12, buckets=3)
    assert jobs.manifests(spark, target)[-1] == 11 and jobs.merged(spark, str(tmp_path / "none")) is None


def test_a_batch_that_failed_before_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    one, two = ([("s", "k", str(v), AT + datetime.timedelta(hours=v), v)] for v in (1, 2))
    jobs.merge_batch(spark.createDataFrame(one, KIND), target, 0)
    with monkeypatch.context() as broken, pytest.raises(OSError, match="lost"):
        broken.setattr(jobs, "write_manifest", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        jobs.merge_batch(spark.createDataFrame(two, KIND), target, 1)
    assert [r.entry_value for r in jobs.merged(spark, target).collect()] == ["1"]
    jobs.merge_batch(spark.createDataFrame(two, KIND), target, 1)
    assert [r.entry_value for r in jobs.merged(spark, target).collect()] == ["2"]


def test_live_jobs_go_up_and_down(spark, tmp_path):
    hour = lambda h: AT + datetime.timedelta(hours=h)
    kind = "job_id string, status string, at timestamp, seq long"
    parts = [
        [("a", "failed", hour(0), 1), ("b", "failed", hour(0), 2), ("c", "ok", hour(0), 3), ("c", "failed", hour(0), 2), (None, "ok", hour(0), 4), ("e", None, hour(0), 4)],
        [("a", "ok", hour(2), 5), ("d", "failed", hour(2), None)],
        [("f", "ok", hour(25), 6)],
    ]
    want = [{"failed": 2, "ok": 1}, {"failed": 2, "ok": 2}, {"failed": 1, "ok": 3}]
    target = str(tmp_path / "out")
    for n, part in enumerate(parts):
        files(spark, [part], kind, tmp_path / "in")
        ledger.run(ledger.changes(jobs.table_stream(spark, str(tmp_path / "in"))), target, str(tmp_path / "check"))
        assert {r.status: r.jobs for r in ledger.live_counts(spark.read.parquet(target)).collect()} == want[n]
