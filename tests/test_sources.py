import json
import os

from pyspark.sql import functions as F

from visagelake.sources import sidecars


def tree(root):
    docs = {
        "a.scar": {"_media.basename": "a.jpg", "face.scrfd.version": "1"},
        "x/b.scar": {"face.scrfd.faces": [{"n": 1}], "face.arcface.version": None, "pose.yolo.model": "m"},
        "x/deep/c.SCAR": {"face.scrfd.version": "2"}, "y/d.scar": {}, "y/e.txt": {"face.scrfd.version": "3"},
    }
    for name, doc in docs.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(json.dumps(doc))
    (root / "y/broken.scar").write_text("{")
    (root / "y/list.scar").write_text("[1]")


def names(df):
    return sorted((os.path.basename(r.scar_path), r.entry_key or r.error.split(":")[0], r.entry_value) for r in df.collect())


def test_files_are_read_and_conditions_pushed(spark, tmp_path):
    tree(tmp_path)
    sidecars.register(spark)
    for depth in (0, 1, 5):
        read = spark.read.format("sidecars").option("depth", depth).load(str(tmp_path))
        assert names(read) == sorted([
            ("a.scar", "_media.basename", "a.jpg"), ("a.scar", "face.scrfd.version", "1"), ("b.scar", "face.scrfd.faces", '[{"n":1}]'), ("b.scar", "face.arcface.version", None),
            ("b.scar", "pose.yolo.model", "m"), ("c.SCAR", "face.scrfd.version", "2"), ("broken.scar", "JSONDecodeError", None), ("list.scar", "ValueError", None),
        ], key=str)
    assert names(read.where("tool = 'scrfd'")) == [("a.scar", "face.scrfd.version", "1"), ("b.scar", "face.scrfd.faces", '[{"n":1}]'), ("c.SCAR", "face.scrfd.version", "2")]
    assert names(read.where("tool in ('arcface', 'none') and entry_key like 'face.%'")) == [("b.scar", "face.arcface.version", None)]
    assert names(read.where(F.col("scar_path").startswith(f"{tmp_path}/x/d"))) == [("c.SCAR", "face.scrfd.version", "2")]
    assert names(read.where(F.col("scar_path") == f"{tmp_path}/a.scar").where("length(entry_key) > 16")) == [("a.scar", "face.scrfd.version", "1")]
    assert names(spark.read.format("sidecars").load(str(tmp_path / "a.scar"))) == [("a.scar", "_media.basename", "a.jpg"), ("a.scar", "face.scrfd.version", "1")]
    assert not spark.read.format("sidecars").load(str(tmp_path / "none")).collect()


def test_pruned_folders_are_not_read(spark, tmp_path):
    tree(tmp_path)
    one = sidecars.SidecarReader({"path": str(tmp_path), "depth": "2"})
    left = list(one.pushFilters([sidecars.StringStartsWith(("scar_path",), f"{tmp_path}/x/"), sidecars.EqualTo(("entry_value",), "1"), sidecars.EqualTo(("tool",), "scrfd")]))
    assert [f.attribute for f in left] == [("entry_value",)]
    assert {os.path.relpath(p.path, tmp_path) for p in one.partitions()} == {".", "x", "x/deep"}
    sidecars.register(spark)
    plan = spark.read.format("sidecars").load(str(tmp_path)).where("tool = 'scrfd' and entry_key like 'face.%'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0], plan  # nothing is left to be filtered after the scan


def test_new_files_as_a_stream(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    tree(root)
    sidecars.register(spark)

    def go():
        stream = spark.readStream.format("sidecars").option("settle", 0).load(str(root))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination()
        return names(spark.read.parquet(out))

    first = go()
    assert len(first) == 8
    (root / "x/new.scar").write_text('{"k": true}')
    assert go() == sorted([*first, ("new.scar", "k", "true")], key=str)
    assert len(go()) == 9


def test_written_files_read_back(spark, tmp_path):
    sidecars.register(spark)
    docs = spark.createDataFrame([("/p/a.scar", {"k": "v", "n": None}, "0"), ("/p/b.scar", {}, "1")], "scar_path string, entries map<string,string>, part string")
    sidecars.write_files(docs, f"file://{tmp_path}", "part")
    assert names(spark.read.format("sidecars").load(f"file://{tmp_path}")) == [("a.scar", "k", "v"), ("a.scar", "n", None)]
