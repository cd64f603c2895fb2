"""Hooks for user models: detectors, embedders and crop analysers over images, with crops and preprocessing.

Images are rows (media_id, height, width, data) of row-major BGR bytes. Hooks run on iterators of batches, a model is
built once per Python worker, and a failing row becomes a row with status `error` while the others go on.
"""

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from visagelake.operators.vectors import unit_rows

# Input size, channels, scale, mean and deviation of each model.
IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
PREPROCESS = {
    "opencv_fer": (112, "rgb", 255.0, ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))),
    "fer_plus": (64, "gray", 1.0, None),
    "fairface": (224, "rgb", 255.0, IMAGENET),
    "bisenet": (512, "rgb", 255.0, IMAGENET),
    "yakhyo_gaze": (448, "rgb", 255.0, IMAGENET),
    "face_antispoof_onnx": (80, "rgb", 255.0, None),
    "emonet": (256, "rgb", 255.0, None),
}
DETECTED = "media_id bigint, face_index int, bbox array<double>, det_score double, landmarks array<array<double>>, status string, error string"
CROPS = "media_id bigint, face_index int, crop_h int, crop_w int, crop binary, status string, error string"
#: Crops that a model gets together, and bytes of their prepared inputs.
MODEL_ROWS, MODEL_BYTES = 32, 32 << 20
#: Crops of a task: what models take goes by crops, however few bytes they have.
TASK_ROWS = 500
#: Rows or columns of a resized crop that are made together, of at most twice as many of the crop.
BAND = 32


def pixels(height: int, width: int, data: bytes) -> np.ndarray:
    """Image array of a row; fails where the bytes don't fit the size."""
    return np.frombuffer(data, dtype=np.uint8).reshape(int(height), int(width), 3)


def detect_faces(images: DataFrame, build: Callable[[], Callable[[np.ndarray], list[dict]]]) -> DataFrame:
    """One row per face found by the detector that build() makes; an image that fails gives one error row, one without
    faces none."""

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = build()
        for batch in found:
            rows = []
            for r in batch.itertuples():
                try:
                    faces = detect(pixels(r.height, r.width, r.data))
                    rows += [(r.media_id, i, [float(v) for v in f["bbox"][:4]], float(f.get("det_score", 0.0)), f.get("landmarks"), "ok", None) for i, f in enumerate(faces)]
                except Exception as error:  # noqa: BLE001  any fault of a user's model is the row's
                    rows.append((r.media_id, None, None, None, None, "error", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["media_id", "face_index", "bbox", "det_score", "landmarks", "status", "error"]).astype({"face_index": "Int32"})

    return images.select("media_id", "height", "width", "data").mapInPandas(batches, DETECTED)


def crop_faces(faces: DataFrame) -> DataFrame:
    """Pixels of crop boxes: faces have (media_id, face_index, crop struct<x1,y1,x2,y2>, height, width, data). Boxes are clamped to the image and
    empty crops dropped; an image that cannot be read gives an error row for each of its faces."""

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            rows = []
            for r in batch.itertuples():
                try:
                    crop = pixels(r.height, r.width, r.data)[max(0, r.y1) : max(0, r.y2), max(0, r.x1) : max(0, r.x2)]
                    if crop.size:
                        rows.append((r.media_id, r.face_index, crop.shape[0], crop.shape[1], crop.tobytes(), "ok", None))
                except Exception as error:  # noqa: BLE001  a broken image is its faces' fault alone
                    rows.append((r.media_id, r.face_index, None, None, None, "error", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["media_id", "face_index", "crop_h", "crop_w", "crop", "status", "error"]).astype({"crop_h": "Int32", "crop_w": "Int32"})

    return faces.select("media_id", "face_index", "crop.x1", "crop.y1", "crop.x2", "crop.y2", "height", "width", "data").mapInPandas(batches, CROPS)


def dealt(crops: DataFrame) -> DataFrame:
    """crops, a stored table, over tasks of about TASK_ROWS rows; Spark would put as many in a task as their bytes allow."""
    return crops.repartition(max(1, -(-crops.count() // TASK_ROWS)))


@functools.lru_cache(maxsize=64)
def shares(n: int, size: int) -> tuple[np.ndarray, list[tuple[slice, slice, np.ndarray]]]:
    """The pixels among n that a line of size pixels is made of (bilinear, pixel centres aligned), and the line in bands: where each
    lies, which of these pixels it needs, 2 * BAND at most, and their shares."""
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, n - 1)
    need = np.unique(np.concatenate([low, high]))
    i, j, part = np.searchsorted(need, low), np.searchsorted(need, high), at - low
    step = size if len(need) <= 2 * BAND else BAND
    bands = []
    for band in (slice(k, min(k + step, size)) for k in range(0, size, step)):
        of = slice(i[band][0], j[band][-1] + 1)
        share = np.zeros((band.stop - band.start, of.stop - of.start), dtype=np.float32)
        row = np.arange(len(share))
        share[row, i[band] - of.start] += 1 - part[band]
        share[row, j[band] - of.start] += part[band]
        bands.append((band, of, share))
    return need, bands


def stretched(image: np.ndarray, mix: np.ndarray, shift: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Bilinear resize to the square out (channels first), which is filled: its channels are those of the image times mix, plus shift."""
    (rows, down), (columns, across) = (shares(n, out.shape[-1]) for n in image.shape[:2])
    for band, of, share in down:
        some = image[rows[of]].take(columns, axis=1).astype(np.float32) @ mix + shift
        some = np.ascontiguousarray(some.transpose(2, 0, 1))
        wide = np.empty((len(out), share.shape[1], out.shape[-1]), dtype=np.float32)
        for part, need, shared in across:
            np.matmul(some[:, :, need], shared.T, out=wide[:, :, part])
        np.matmul(share, wide, out=out[:, band])
    return out


def resized(image: np.ndarray, size: int, out: np.ndarray | None = None) -> np.ndarray:
    """Bilinear resize to a square, pixel centres aligned, float32; out may be given."""
    channels = image.shape[2]
    found = stretched(image, np.eye(channels, dtype=np.float32), np.zeros(channels, dtype=np.float32), np.empty((channels, size, size), dtype=np.float32)).transpose(1, 2, 0)
    if out is None:
        return found
    out[:] = found
    return out


def input_shape(tool: str) -> tuple[int, int, int]:
    size, channels, _, _ = PREPROCESS[tool]
    return (1 if channels == "gray" else 3), size, size


def preprocessed(image: np.ndarray, tool: str, out: np.ndarray | None = None) -> np.ndarray:
    """Model input of a BGR crop: channels first, float32; out may be given."""
    _, channels, scale, norm = PREPROCESS[tool]
    mean, deviation = (np.array(v) for v in (norm or ((0.0,), (1.0,))))
    mix = np.array([[0.114], [0.587], [0.299]]) if channels == "gray" else np.eye(3)[::-1]
    filled = np.empty(input_shape(tool), dtype=np.float32) if out is None else out
    return stretched(image, (mix / (scale * deviation)).astype(np.float32), (-mean / deviation).astype(np.float32), filled)


def run_together(crops: pd.DataFrame, prepare: Callable[..., np.ndarray], model: Callable[[np.ndarray], np.ndarray], room: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
    """(row, output, error) of crops in groups of MODEL_ROWS and MODEL_BYTES of input at most, prepared one group at a time; where a
    group fails, its crops run one by one, so that only the faulty ones give errors. room, if given, takes the inputs of one group after
    the other: prepare(image, out) fills a place of it, and prepare(image) makes an array else."""
    group: list[tuple[int, np.ndarray, np.ndarray]] = []
    most, held = MODEL_ROWS if room is None else len(room), 0
    for i, r in enumerate(crops.itertuples()):
        if len(group) == most:
            yield from run_group(group, prepare, model, room)
            group, held = [], 0
        try:
            image = pixels(r.crop_h, r.crop_w, r.crop)
            one = prepare(image) if room is None else prepare(image, room[len(group)])
        except Exception as error:  # noqa: BLE001  any fault of a crop is the row's
            yield i, None, f"{type(error).__name__}: {error}"
            continue
        if group and room is None and held + one.nbytes > MODEL_BYTES:
            yield from run_group(group, prepare, model, room)
            group, held = [], 0
        group.append((i, image, one))
        held += one.nbytes
    if group:
        yield from run_group(group, prepare, model, room)


def run_group(group: list[tuple[int, np.ndarray, np.ndarray]], prepare: Callable[..., np.ndarray], model: Callable[[np.ndarray], np.ndarray], room: np.ndarray | None) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
    try:
        out = np.array(model(np.stack([x for *_, x in group]) if room is None else room[: len(group)]), dtype=np.float64).reshape(len(group), -1)
        yield from ((i, v, None) for (i, *_), v in zip(group, out, strict=True))
    except Exception:  # noqa: BLE001  found again, and told, one by one
        for i, image, x in group:
            try:
                given = x if room is None else prepare(image, room[0])  # the model may have written into it
                yield i, np.array(model(given[None]), dtype=np.float64).reshape(-1), None
            except Exception as error:  # noqa: BLE001  any fault of a user's model is the row's
                yield i, None, f"{type(error).__name__}: {error}"


def model_rows(crops: DataFrame, output: str, shape: tuple[int, int, int], prepare: Callable[[np.ndarray, np.ndarray], np.ndarray], build: Callable[[], Callable[[np.ndarray], np.ndarray]], finish=lambda v: v) -> DataFrame:
    """(media_id, face_index, output, status, error) of the model that build() makes once a task. Inputs have one shape; all groups of a
    task use the same memory, so that no page of it is made twice."""

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        room = np.empty((max(1, min(MODEL_ROWS, MODEL_BYTES // (4 * math.prod(shape)))), *shape), dtype=np.float32)
        for batch in found:
            media, face = batch["media_id"].to_numpy(), batch["face_index"].to_numpy()
            rows = [(media[i], face[i], None if v is None else finish(v).tolist(), "ok" if e is None else "error", e) for i, v, e in run_together(batch, prepare, model, room)]
            yield pd.DataFrame(rows, columns=["media_id", "face_index", output, "status", "error"])

    return crops.select("media_id", "face_index", "crop_h", "crop_w", "crop").mapInPandas(batches, f"media_id bigint, face_index int, {output} array<double>, status string, error string")


def analyze_crops(crops: DataFrame, tool: str, build: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(media_id, face_index, scores, status, error): raw outputs of the model that build() makes, on crops preprocessed for
    a tool. The model gets a stack of crops, whose memory is used again for the next, and gives as many rows of scores."""
    return model_rows(crops, "scores", input_shape(tool), lambda image, out: preprocessed(image, tool, out), build)


def embed_crops(crops: DataFrame, build: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int = 112) -> DataFrame:
    """(media_id, face_index, embedding, status, error): unit vectors of the model that build() makes, in the order of faces. The
    model gets a stack of crops resized to a square (BGR, float32), whose memory is used again for the next, and gives as many rows."""
    return model_rows(crops, "embedding", (size, size, 3), lambda image, out: resized(image, size, out), build, lambda v: unit_rows(v[None])[0])
