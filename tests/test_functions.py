import datetime
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from visagelake.functions import catalog, decode, paths, records
from visagelake.operators import discover, inference, overlay, sidecar, tables
from visagelake.sources import media


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return row[0] if len(columns) == 1 else row


def test_paths(spark):
    names = ["/p/photo.jpg", "/p/20260502_101833.140.jpg", "/p/x.scar", "/p/x.SCAR", "/p/.hidden", "/p/none", "photo.heic", "/p.q/file", "/p/a.", None]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select("path", paths.sidecar_path(F.col("path")).alias("s"), paths.annotated_path(F.col("path")).alias("a"), paths.is_image(F.col("path")).alias("i")).collect()
    got = {r.path: (r.s, r.a, r.i) for r in rows}
    assert got["/p/photo.jpg"] == ("/p/photo.scar", "/p/photo_scrfd.jpg", True)
    assert got["/p/20260502_101833.140.jpg"][0] == "/p/20260502_101833.140.scar"
    assert got["/p/x.scar"][0] == "/p/x.scar" and got["/p/x.SCAR"][0] == "/p/x.SCAR"
    assert got["/p/.hidden"] == ("/p/.hidden.scar", "/p/.hidden_scrfd", False) and got["/p/none"][0] == "/p/none.scar"
    assert got["photo.heic"][1] == "photo_scrfd.jpg" and got["/p.q/file"][0] == "/p.q/file.scar" and got[None] == (None, None, None)
    at = F.lit(datetime.datetime(2026, 5, 2, 10, 18, 33, 140000))
    assert one(spark, t=paths.iso_utc(at)) == "2026-05-02T10:18:33+00:00"
    assert one(spark, y=paths.year_of(F.lit("/a/2019/b.jpg")), n=paths.year_of(F.lit("/a/1999/b.jpg"))) == (2019, None)
    assert one(spark, a=paths.key_tool(F.lit("face.scrfd.faces.x")), b=paths.key_field(F.lit("face.scrfd.faces.x")), c=paths.key_tool(F.lit("face.version")), d=paths.key_tool(F.lit("pose.yolo.x"))) == ("scrfd", "faces.x", None, None)


def test_requests(spark):
    ask = lambda f, *t: one(spark, x=f(F.array(*map(F.lit, t)) if t else F.array().cast("array<string>")))
    assert ask(catalog.expanded, "face_recognition") == ["dlib_detect", "dlib_embed"]
    assert ask(catalog.with_dependencies, "dlib_embed") == ["dlib_detect", "dlib_embed"]
    assert ask(catalog.with_dependencies, "arcface") == ["scrfd", "arcface"]
    assert ask(catalog.per_image, "detectron2") == ["detectron2"]
    assert "cluster_dlib" in ask(catalog.expanded, "face_recognition", "hdbscan_dlib")
    assert ask(catalog.unknown, "not_a_tool", "scrfd") == ["not_a_tool"]
    assert ask(catalog.per_image) == catalog.DEFAULTS and ask(catalog.per_image, "hdbscan") == []
    assert ask(catalog.normalized, " SCRFD", "", "scrfd", "HDBSCAN") == ["scrfd", "cluster"]
    assert ask(catalog.per_image, "opencv_fer", "scrfd") == ["scrfd", "opencv_fer"]
    assert len(ask(catalog.expanded, "all_analysis")) == 17 and len(catalog.VERSIONS) == 24
    assert catalog.tools_table(spark).count() == 24
    source = lambda given, *t: one(spark, x=catalog.embedding_source(F.array(*map(F.lit, t)), F.lit(given)))
    assert (source("", "cluster"), source(" Dlib_Embed", "cluster"), source("arcface", "hdbscan_dlib"), source("other", "cluster")) == ("arcface", "dlib_embed", "dlib_embed", None)
    assert one(spark, x=catalog.cluster_tool(F.lit("dlib_embed"))) == "cluster_dlib"


def test_records(spark):
    assert one(spark, b=records.location_box(*(F.lit(v) for v in (10, 100, 90, 20)))) == [20.0, 10.0, 100.0, 90.0]
    points = F.from_json(F.lit('{"left_eyebrow": [{"x": 3, "y": 4}], "chin": [{"x": 1, "y": 2}]}'), "map<string,array<struct<x:int,y:int>>>")
    assert one(spark, p=records.flat_landmarks(points)) == [[1.0, 2.0], [3.0, 4.0]]
    assert one(spark, a=records.pixel(F.lit(0.5)), b=records.pixel(F.lit(1.5)), c=records.pixel(F.lit(-2.5))) == (0, 2, -2)
    assert one(spark, a=records.valid_box(F.array(F.lit(1), F.lit(2), F.lit(3))), b=records.valid_box(F.lit(None).cast("array<int>"))) == (False, False)
    assert one(spark, s=records.sex(F.lit(None).cast("string"), F.lit(1)), t=records.sex(F.lit("x"), F.lit(1)), u=records.sex(F.lit(None).cast("string"), F.lit(None).cast("int"))) == ("M", "x", None)


def test_decode(spark):
    scores = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<double>")
    assert one(spark, a=decode.label_of(scores(0.1, 0.9, 0.9), decode.EMOTIONS)) == "happiness"
    assert one(spark, a=decode.label_of(scores(*[0.0] * 8, 1.0), decode.RACES), b=decode.label_of(scores(), decode.RACES)) == ("8", None)
    assert one(spark, a=decode.score_map(scores(0.5, 0.25), decode.RACES)) == {"White": 0.5, "Black": 0.25}
    assert one(spark, a=decode.live_score(scores(0.2)), b=decode.live_score(scores(0.2, 0.7))) == (0.2, 0.7)
    assert tuple(one(spark, a=decode.gaze(scores(1.0, 2.0), False))) == (1.0, 2.0) and tuple(one(spark, a=decode.gaze(scores(1.0, 2.0), True))) == (2.0, 1.0)
    assert one(spark, a=decode.attributes(F.lit("not json"))).age is None
    assert tuple(one(spark, a=decode.valence_arousal(scores(0.5, 1.0), scores()))) == (0.5, None)
    fields = lambda **kw: F.create_map(*[F.lit(x) for kv in kw.items() for x in kv])
    assert one(spark, a=decode.gaze_of(fields(gaze_direction="g", other="o"))) == "g" and one(spark, a=decode.gaze_of(fields(gaze="a", gaze_direction="g"))) == "a"
    assert one(spark, a=decode.emotion_columns(fields(anger="0.5", x="1"))) == {"anger": 0.5} and one(spark, a=decode.action_units(fields(AU01="2", x="1"))) == {"AU01": 2.0}
    assert one(spark, a=decode.emotion_argmax(decode.emotion_columns(fields(fear="0.7", anger="0.7", disgust="0.1")))) == "anger"
    assert one(spark, a=decode.blendshapes(F.array(F.lit("a"), F.lit("b")), scores(0.5))) == {"a": 0.5}
    assert one(spark, a=decode.parsing_labels(F.array(scores(3.0, 1.9), scores(1.0, 0.0)))) == [0, 1, 3]


def test_documents_merge_in_any_order(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [("s", f"k{i % 7}", str(i), at + datetime.timedelta(seconds=i // 3), i) for i in range(60)]
    kind = "scar_path string, entry_key string, entry_value string, written_at timestamp, seq long"
    want = sorted(map(tuple, sidecar.latest(spark.createDataFrame(rows, kind)).collect()))
    parts = [spark.createDataFrame(rows[i::4][::-1], kind) for i in range(4)]
    assert sorted(map(tuple, sidecar.merge(parts[3], *parts[:3]).collect())) == want
    assert sorted(map(tuple, sidecar.merge(sidecar.merge(parts[0], parts[1]), parts[2], parts[3]).collect())) == want


def test_hooks_isolate_rows(spark):
    image = np.arange(48, dtype=np.uint8).tobytes()
    images = spark.createDataFrame([(1, 4, 4, image), (2, 4, 4, b"xx"), (3, 2, 2, bytes(12))], "media_id long, height int, width int, data binary")

    def build():
        def detect(a):
            if not a.any():
                raise RuntimeError("dark")
            return [{"bbox": [1, 1, 3, 9]}, {"bbox": [2, 2, 2, 4], "det_score": 0.5}]

        return detect

    found = inference.detect_faces(images, build)
    got = sorted((r.media_id, r.face_index, r.status) for r in found.where("status = 'ok'").collect())
    assert got == [(1, 0, "ok"), (1, 1, "ok")]
    assert {r.media_id: r.error.split(":")[0] for r in found.where("status = 'error'").collect()} == {2: "ValueError", 3: "RuntimeError"}
    boxed = found.where("status = 'ok'").join(images, "media_id").withColumn("crop", F.expr("named_struct('x1', int(bbox[0]), 'y1', int(bbox[1]), 'x2', int(bbox[2]), 'y2', int(bbox[3]))"))
    crops = inference.crop_faces(boxed).collect()
    assert [(c.face_index, c.crop_h, c.crop_w) for c in crops] == [(0, 3, 2)]
    assert inference.preprocessed(np.full((3, 2, 3), 255, dtype=np.uint8), "opencv_fer").shape == (3, 112, 112)
    assert np.allclose(inference.preprocessed(np.full((3, 2, 3), 255, dtype=np.uint8), "opencv_fer"), 1.0)
    assert inference.preprocessed(np.zeros((5, 5, 3), dtype=np.uint8), "fer_plus").shape == (1, 64, 64)


def test_sources(spark, tmp_path):
    for name in ("a.JPG", "b.txt", "sub/c.heic", "sub/deep/d.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: sorted(r.stem + r.ext for r in df.collect())
    assert names(media.discover(spark, str(tmp_path))) == ["a.jpg", "c.heic", "d.png"]
    assert names(media.discover(spark, str(tmp_path), recursive=False)) == ["a.jpg"]
    assert names(media.discover(spark, str(tmp_path / "missing"))) == [] and names(media.discover(spark, str(tmp_path / "a.JPG"))) == ["a.jpg"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))

    def decoder(content):
        raise ValueError("cannot decode")

    assert {r.error for r in media.decode_images(files, decoder).collect()} == {"ValueError: cannot decode"}
    docs = spark.createDataFrame([("s1", {"face.scrfd.version": "1"}), ("s2", {"a": "b"})], "scar_path string, entries map<string,string>")
    media.write_documents(docs, str(tmp_path / "docs"), 4)
    media.write_documents(docs.where("scar_path = 's1'").withColumn("entries", F.create_map(F.lit("a"), F.lit("new"))), str(tmp_path / "docs"), 4)
    back = {r.scar_path: r.entries for r in spark.read.parquet(str(tmp_path / "docs")).collect()}
    assert back["s1"] == {"a": "new"}


def test_no_tool_of_a_plan_is_lost(spark):
    media = spark.createDataFrame([(1, "/p/a.jpg"), (2, "/p/b.jpg")], "media_id long, path string")
    tools = spark.createDataFrame([(f"tool{i:02d}",) for i in range(40)] * 2, "tool string")
    done = spark.createDataFrame([("/p/a.scar", "tool00"), ("/p/a.scar", "other"), ("/p/c.scar", "tool01")], "scar_path string, tool string")
    plan = discover.work_plan(media, tools, done)
    assert {(r.media_id, r.tool) for r in plan.collect()} == {(m, f"tool{i:02d}") for m in (1, 2) for i in range(40)} - {(1, "tool00")} and plan.count() == 79
    assert discover.work_plan(media, tools, done, force=True).count() == 80 and discover.work_plan(media, tools.limit(0), done).count() == 0
    issues = spark.createDataFrame([(f"tool{i:02d}", "broken") for i in range(40)] + [("tool00", "also")], "tool string, issue string")
    checked = catalog.available(plan.withColumn("explicit", F.lit(False)), issues)
    assert checked.where("status = 'skip'").count() == 79 == checked.count()


def png(width, height, rgb):
    raw = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_image_files_through_the_hooks(spark, tmp_path):
    for name, rgb in (("a.png", (10, 20, 30)), ("b.png", (200, 100, 0))):
        (tmp_path / name).write_bytes(png(6, 4, rgb))
    (tmp_path / "broken.png").write_bytes(b"no image")
    found = media.discover(spark, str(tmp_path))
    assert sorted(r.stem for r in found.collect()) == ["a", "b", "broken"] and media.discover(spark, str(tmp_path / "none")).count() == 0
    images = media.load_images(spark, str(tmp_path)).withColumn("media_id", F.ascii(F.element_at(F.split("path", "/"), -1)).cast("long"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.collect()}
    assert (rows["a.png"].height, rows["a.png"].width, bytes(rows["a.png"].data[:3])) == (4, 6, bytes((30, 20, 10))) and rows["b.png"].data[0] == 0
    boxed = images.where("data is not null").select("media_id", F.lit(0).alias("face_index"), F.struct(*(F.lit(v).alias(k) for k, v in (("x1", 0), ("y1", 0), ("x2", 3), ("y2", 2)))).alias("crop"), "height", "width", "data")
    torn = boxed.limit(1).withColumns({"media_id": F.lit(7).cast("long"), "data": F.lit(b"x")})
    crops = inference.crop_faces(boxed.unionByName(torn))
    assert sorted((r.media_id, r.status) for r in crops.collect()) == [(7, "error"), (97, "ok"), (98, "ok")]

    def model(x):
        if (x[:, 0, 0, 0] > 0.7).any():
            raise RuntimeError("too red")
        return x.mean(axis=(2, 3))

    scores = {r.media_id: r for r in inference.analyze_crops(crops, "emonet", lambda: model).collect()}
    assert [scores[k].status for k in (7, 97, 98)] == ["error", "ok", "error"] and "too red" in scores[98].error
    assert [round(v, 3) for v in scores[97].scores] == [0.039, 0.078, 0.118]
    units = {r.media_id: r for r in inference.embed_crops(crops, lambda: lambda x: x.mean(axis=(1, 2))).collect()}
    assert units[7].status == "error" and abs(sum(v * v for v in units[98].embedding) - 1) < 1e-6


def test_landmark_maps_are_made_once(spark):
    rows = [(1, {"nose_tip": [(1.0, 2.0)], "chin": [(3.0, 4.0), (5.0, 6.0)], "other": [(9.0, 9.0)]}), (2, {}), (3, None), (4, {"chin": []})]
    df = spark.createDataFrame(rows, "id long, parts map<string, array<struct<x: double, y: double>>>")
    assert [r.p for r in df.select("id", records.flat_landmarks(F.col("parts")).alias("p")).orderBy("id").collect()] == [[[3.0, 4.0], [5.0, 6.0], [1.0, 2.0]], None, None, None]
    made = F.create_map(F.lit("made"), F.array().cast("array<struct<x: double, y: double>>"))
    assert df.select(records.flat_landmarks(made).alias("p"))._jdf.queryExecution().analyzed().toString().count("map(made") == 1


def test_few_prepared_crops_are_held_at_once():
    held, most = [0], []
    crops = pd.DataFrame({"crop_h": [1] * 200, "crop_w": [1] * 200, "crop": [bytes([k % 250, 1, 2]) for k in range(200)]})

    def prepare(image):
        held[0] += 1
        most.append(held[0])
        return np.full((1 << 18,), image[0, 0, 0], dtype=np.float32)  # 1 MiB

    def model(x):
        held[0] -= len(x)
        return x[:, :1]

    got = list(inference.run_together(crops, prepare, model))
    assert [(i, v[0], e) for i, v, e in got] == [(k, k % 250, None) for k in range(200)]
    assert max(most) <= inference.MODEL_ROWS + 1


def test_inputs_of_all_groups_lie_in_the_same_memory(spark):
    sizes = [(4, 4), (3, 2), (9, 70), (1, 1), (200, 33)]
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, (*sizes[k % 5], 3)).astype(np.uint8) for k in range(90)]
    rows = [(k, 0, x.shape[0], x.shape[1], bytearray(x.tobytes() if k % 7 else b"0")) for k, x in enumerate(images)]
    crops = spark.createDataFrame(rows, "media_id long, face_index int, crop_h int, crop_w int, crop binary").coalesce(1)
    model = lambda: lambda x: np.stack([x[:, 0, 0, 0], x[:, -1, -1, -1], np.full(len(x), x.__array_interface__["data"][0] % 2**52)], axis=1).astype(np.float64)
    got = {r.media_id: r for r in inference.analyze_crops(crops, "fairface", model).collect()}
    assert all(got[k].status == ("ok" if k % 7 else "error") for k in range(90)) and len({got[k].scores[2] for k in range(90) if k % 7}) == 1
    for k in range(1, 7):
        want = inference.preprocessed(images[k], "fairface")
        assert np.allclose(got[k].scores[:2], [want[0, 0, 0], want[-1, -1, -1]])
    vectors = {r.media_id: r.embedding for r in inference.embed_crops(crops, lambda: lambda x: x[:, 5, 7, :]).collect() if r.status == "ok"}
    for k, v in vectors.items():
        want = inference.resized(images[k], 112)[5, 7].astype(np.float64)
        assert np.allclose(v, want / np.linalg.norm(want))


def test_a_model_may_write_into_its_inputs():
    crops = pd.DataFrame({"crop_h": [1] * 9, "crop_w": [1] * 9, "crop": [bytes([k, k, k]) for k in range(9)]})

    def model(x):
        x += 1
        if (x == 6).any():
            raise ValueError("five")
        return x[:, :1, 0, 0]

    def prepare(image, out):
        out[:] = image[0, 0, 0]
        return out

    got = list(inference.run_together(crops, prepare, model, np.empty((4, 1, 2, 2), dtype=np.float32)))
    assert [(i, None if v is None else v[0], e) for i, v, e in got] == [(k, None, "ValueError: five") if k == 5 else (k, k + 1, None) for k in range(9)]


def test_crops_are_dealt_by_rows(spark):
    crops = spark.range(0, 1700, 1, 1).withColumn("crop", F.lit(b"x"))
    sizes = [r.n for r in inference.dealt(crops).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1700 and len(sizes) == 4 and max(sizes) <= inference.TASK_ROWS


def test_preprocessing_against_loops():
    image = np.random.default_rng(3).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    for tool, (size, channels, scale, norm) in inference.PREPROCESS.items():
        got = inference.preprocessed(image, tool)
        assert got.shape == ((1 if channels == "gray" else 3), size, size) and got.dtype == np.float32
        for i, j in ((0, 0), (size // 3, size // 2), (size - 1, size - 2)):
            y, x = min(max((i + 0.5) * 5 / size - 0.5, 0), 4), min(max((j + 0.5) * 7 / size - 0.5, 0), 6)
            y0, x0 = int(y), int(x)
            pixel = [0.0, 0.0, 0.0]
            for a, b, share in ((y0, x0, (1 - y + y0) * (1 - x + x0)), (y0, x0 + 1, (1 - y + y0) * (x - x0)), (y0 + 1, x0, (y - y0) * (1 - x + x0)), (y0 + 1, x0 + 1, (y - y0) * (x - x0))):
                if share > 0:
                    pixel = [p + share * float(v) for p, v in zip(pixel, image[a, b])]
            blue, green, red = pixel
            want = [(0.114 * blue + 0.587 * green + 0.299 * red) / scale] if channels == "gray" else [red / scale, green / scale, blue / scale]
            if norm:
                want = [(v - m) / d for v, m, d in zip(want, *norm)]
            assert np.allclose(got[:, i, j], want, atol=1e-3)


def test_panel_numbers_round_as_written(spark):
    values = [0.125, 0.375, 2.675, -0.04, 0.0, 1234567.891, -0.05, 0.25, 1e-9, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(overlay.two_places(F.col("v")), overlay.signed_place(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(None, None) if v is None else (f"{v:.2f}", f"{v:+.1f}") for v in values]


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().toString()
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "a long, b string")
    assert "ResolvedHint" in plan(tables.small(df, 50)) or "broadcast" in plan(tables.small(df, 50))
    assert tables.small(df, 49) is df
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 1000)
    assert tables.small(df, 50) is df
