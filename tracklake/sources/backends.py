"""Video and models are plugged in: what an engine needs of them, how rows pass through them, and the errors where they're missing."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class VideoReader(Protocol):
    fps: float

    def frames(self, max_frames: int | None = None) -> Iterator[np.ndarray]: ...


class Detector(Protocol):
    def detect(self, frame: np.ndarray, confidence: float, size: int, classes: list[int] | None) -> list[tuple[float, float, float, float, float, int]]: ...


class Encoder(Protocol):
    dimension: int

    def __call__(self, frame: np.ndarray, boxes: np.ndarray) -> np.ndarray: ...


class MissingBackend(RuntimeError):
    """A codec or model that is not installed."""


def open_video(path: str) -> VideoReader:
    """Uncompressed AVI files are read here; others need a codec library."""
    from .video import open_raw

    if path.lower().endswith(".avi"):
        return open_raw(path)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    raise MissingBackend("reading compressed video needs a codec library; none is installed")


def weights_file(path: str, fetch: Callable[[str], None] | None = None) -> str:
    """A model's weights: the file itself, or, where it is missing, what fetch puts there."""
    if not os.path.exists(path):
        if fetch is None:
            raise FileNotFoundError(path)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        fetch(path)
        if not os.path.exists(path):
            raise MissingBackend(f"no weights were put at {path}")
    return path


def matching_weights(checkpoint: dict, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Of a checkpoint (or its state_dict) the arrays that a model takes by name, "module." left out, and shape."""
    state = checkpoint.get("state_dict", checkpoint)
    named = {k.removeprefix("module."): v for k, v in state.items()}
    out = {k: v for k, v in named.items() if k in shapes and tuple(v.shape) == tuple(shapes[k])}
    if not out:
        raise RuntimeError("no array of the checkpoint matches the model by name and shape")
    return out


def embed(encoder: Encoder, frame: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Unit vectors of boxes, cut to the frame; zeros for a box that is empty then."""
    boxes = np.asarray(boxes, float).reshape(-1, 4)
    h, w = frame.shape[:2]
    low = np.stack([np.clip(np.floor(boxes[:, k]), 0, most - 1) for k, most in ((0, w), (1, h))], axis=1)
    high = np.stack([np.clip(np.ceil(boxes[:, k]), 0, most) for k, most in ((2, w), (3, h))], axis=1)
    good = np.flatnonzero((high > low).all(axis=1))
    out = np.zeros((len(boxes), encoder.dimension), np.float32)
    if len(good):
        v = np.asarray(encoder(frame, np.concatenate([low, high], axis=1)[good].astype(int)), float)
        out[good] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return out


def detect(frames: DataFrame, detector: Detector, confidence: float = 0.3, size: int = 640, classes: list[int] | None = None) -> DataFrame:
    """raw(camera_id, frame_index, boxes) of frames as sources.video gives them: threshold, size and classes go to the detector."""
    from ..operators.detections import RAW_BOX
    from ..operators.images import frame_of

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [detector.detect(frame_of(h, w, p), confidence, size, classes) for h, w, p in zip(pdf.height, pdf.width, pdf.pixels, strict=True)]
            names = ("x1", "y1", "x2", "y2", "confidence", "class_id")
            boxes = [[dict(zip(names, (*map(float, b[:5]), int(b[5])), strict=True)) for b in f] for f in found]
            yield pd.DataFrame({"camera_id": pdf.camera_id, "frame_index": pdf.frame_index, "boxes": boxes})

    return frames.mapInPandas(run, f"camera_id string, frame_index bigint, boxes array<{RAW_BOX}>")


def features(frames: DataFrame, detections: DataFrame, encoder: Encoder) -> DataFrame:
    """camera_id, frame_index, det_ord, embedding of every detection; a detection of a frame that is not there is an error."""
    from ..operators.images import frame_of

    box = F.struct("det_ord", "x1", "y1", "x2", "y2")
    listed = detections.groupBy("camera_id", "frame_index").agg(F.array_sort(F.collect_list(box)).alias("found"))
    rows = listed.join(frames, ["camera_id", "frame_index"], "left")
    rows = rows.where(F.when(F.col("pixels").isNull(), F.raise_error(F.lit("a detection's frame is missing")).cast("boolean")).otherwise(F.lit(True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for camera, index, h, w, p, found in zip(pdf.camera_id, pdf.frame_index, pdf.height, pdf.width, pdf.pixels, pdf.found, strict=True):
                v = embed(encoder, frame_of(h, w, p), np.array([[b[c] for c in ("x1", "y1", "x2", "y2")] for b in found]))
                yield pd.DataFrame({"camera_id": camera, "frame_index": index, "det_ord": [b["det_ord"] for b in found], "embedding": list(v)})

    return rows.select("camera_id", "frame_index", "height", "width", "pixels", "found").mapInPandas(run, "camera_id string, frame_index bigint, det_ord int, embedding array<float>")
