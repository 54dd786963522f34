"""Uncompressed video as tables: AVI files of 24-bit frames, read by ranges of frames and written a camera a file.

Frames are of one size, so a task seeks to its own. Other containers need a codec library (backends.open_video).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.images import FRAMES, frame_of, gray
from ..operators.runs import spans, whole_runs


@dataclass(frozen=True)
class RawVideo:
    path: str
    fps: float
    width: int
    height: int
    places: tuple[int, ...]

    def frame(self, index: int) -> np.ndarray:
        row = -(-self.width * 3 // 4) * 4
        with open(self.path, "rb") as f:
            f.seek(self.places[index])
            rows = np.frombuffer(f.read(row * self.height), np.uint8).reshape(self.height, row)
        return rows[::-1, : self.width * 3].reshape(self.height, self.width, 3)  # rows are stored from the bottom up

    def frames(self, max_frames: int | None = None) -> Iterator[np.ndarray]:
        for k in range(len(self.places) if max_frames is None else min(max_frames, len(self.places))):
            yield self.frame(k)


def open_raw(path: str) -> RawVideo:
    """Reads the headers; pixels are read frame by frame."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    fps, size, places = 0.0, None, []
    with open(path, "rb") as f:
        head = f.read(12)
        if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"AVI ":
            raise RuntimeError(f"not an AVI file: {path}")
        end = os.fstat(f.fileno()).st_size
        while f.tell() + 8 <= end:
            name, length = struct.unpack("<4sI", f.read(8))
            at = f.tell()
            if name == b"LIST":
                f.read(4)  # its chunks follow
                continue
            if name == b"strh" and f.read(4) == b"vids":
                f.seek(at + 20)
                scale, rate = struct.unpack("<II", f.read(8))
                fps = rate / scale if scale else 0.0
            elif name == b"strf" and size is None:
                _, width, height, _, bits, kind = struct.unpack("<IiiHHI", f.read(20))
                if bits != 24 or kind:
                    raise RuntimeError(f"not an uncompressed video: {path}")
                size = width, height
            elif name == b"00db":
                places.append(at)
            f.seek(at + length + length % 2)
    if size is None:
        raise RuntimeError(f"no video in {path}")
    return RawVideo(path, fps, *size, tuple(places))


def save_raw(frames: Iterable[np.ndarray], path: str, fps: float = 25.0) -> int:
    """Writes frames, gray ones as colour, at a whole number of frames a second; returns how many."""
    rate, count, places = int(fps), 0, []
    folder = os.path.dirname(path)
    if folder:
        os.makedirs(folder, exist_ok=True)
    try:
        f = open(path, "wb")  # noqa: SIM115
    except OSError as e:
        raise RuntimeError(f"can't write {path}") from e
    with f:
        width = height = row = 0
        for frame in frames:
            frame = np.repeat(frame[..., None], 3, axis=2) if frame.ndim == 2 else np.repeat(frame, 3, axis=2) if frame.shape[2] == 1 else frame
            if not count:
                height, width = frame.shape[:2]
                row = -(-width * 3 // 4) * 4
                f.write(b"\0" * HEADER)
            places.append(f.tell() - HEADER + 4)
            rows = np.zeros((height, row), np.uint8)
            rows[:, : width * 3] = frame[::-1].reshape(height, -1)
            f.write(struct.pack("<4sI", b"00db", rows.size))
            f.write(rows.tobytes())
            count += 1
        if not count:
            f.write(b"\0" * HEADER)
        body = f.tell()
        f.write(struct.pack("<4sI", b"idx1", 16 * count))
        for at in places:
            f.write(struct.pack("<4sIII", b"00db", 0x10, at, row * height))
        total = f.tell()
        if total >= 1 << 32:
            raise RuntimeError(f"{path} is beyond the 4 GB of its format")
        f.seek(0)
        f.write(_header(rate, width, height, row * height, count, total, body))
    return count


def _header(rate: int, width: int, height: int, size: int, count: int, total: int, body: int) -> bytes:
    main = struct.pack("<4sI14I", b"avih", 56, 1_000_000 // max(1, rate), size * rate, 0, 0x10, count, 0, 1, size, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4sI4s4sIHHIIIIIIiI4H", b"strh", 56, b"vids", b"DIB ", 0, 0, 0, 0, 1, rate, 0, count, size, -1, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    form = struct.pack("<4sIIiiHHIIiiII", b"strf", 40, 40, width, height, 1, 24, 0, size, 0, 0, 0, 0)
    inner = struct.pack("<4sI4s", b"LIST", 4 + len(stream) + len(form), b"strl") + stream + form
    heads = struct.pack("<4sI4s", b"LIST", 4 + len(main) + len(inner), b"hdrl") + main + inner
    out = struct.pack("<4sI4s", b"RIFF", total - 8, b"AVI ") + heads
    return out + struct.pack("<4sI4s", b"LIST", body - len(out) - 8, b"movi")


HEADER = len(_header(1, 0, 0, 0, 0, 8, 1000))


def scan(spark: SparkSession, path: str, camera_id: str, max_frames: int | None = None, to_gray: bool = False) -> DataFrame:
    """A file's frames as rows; only those below max_frames (none for 0) are read. The file must be at one path for all tasks."""
    video = open_raw(path)
    n = len(video.places) if max_frames is None else max(0, min(max_frames, len(video.places)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf.id:
                frame = video.frame(int(k))
                out = gray(frame) if to_gray else frame
                yield pd.DataFrame({"camera_id": [camera_id], "fps": [video.fps], "frame_index": [k], "height": [video.height], "width": [video.width], "pixels": [out.tobytes()]})

    return spark.range(n).mapInPandas(run, FRAMES)


def write(frames: DataFrame, folder: str, fps: float | None = None) -> DataFrame:
    """A file a camera, its frames in order; at their own rate unless one is given. Gives camera_id, path and the number of
    frames as each task has written them, so it runs when the result is read. The folder must be one for all tasks."""
    rows = frames.select(*(c.split()[0] for c in FRAMES.split(", "))).repartition("camera_id").sortWithinPartitions("camera_id", "frame_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[tuple[str, float, np.ndarray]]:
            for pdf in whole_runs(batches, "camera_id", "frame_index"):
                for lo, hi in spans(pdf.camera_id.to_numpy()):
                    for k in range(lo, hi):
                        yield pdf.camera_id[k], pdf.fps[k], frame_of(pdf.height[k], pdf.width[k], pdf.pixels[k])

        todo = each()
        ahead = next(todo, None)
        while ahead is not None:
            camera, rate, _ = ahead

            def one() -> Iterator[np.ndarray]:
                nonlocal ahead
                while ahead is not None and ahead[0] == camera:  # noqa: B023
                    yield ahead[2]
                    ahead = next(todo, None)

            path = f"{folder}/{camera}.avi"
            count = save_raw(one(), f"{path}.part", rate if fps is None else fps)
            os.replace(f"{path}.part", path)  # a task that is run twice leaves one whole file
            yield pd.DataFrame({"camera_id": [camera], "path": [path], "frames": [count]})

    return rows.mapInPandas(run, "camera_id string, path string, frames bigint")


def probe(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """camera_id, path, fps, frames, width, height of files by camera, from their headers."""
    rows = [(c, p, v.fps, len(v.places), v.width, v.height) for c, p in sorted(paths.items()) for v in [open_raw(p)]]
    return spark.createDataFrame(rows, "camera_id string, path string, fps double, frames long, width int, height int")


def produce(frames: DataFrame, detections: DataFrame, folder: str, fps: float | None = None, tracked: bool = False, confidence: bool = True, glyph=None) -> DataFrame:
    """Frames with their detections or tracks drawn, as files. Frames and the detections' frames are paired by place,
    as far as both go."""
    from ..functions import geometry as geo
    from ..operators.detections import zip_frames
    from ..operators.images import DETECTED, annotate

    pairs = zip_frames(frames, detections)
    kept = frames.join(pairs.select("camera_id", F.col("left_frame").alias("frame_index")), ["camera_id", "frame_index"], "left_semi")
    rows = detections.join(pairs.select("camera_id", "place", F.col("right_frame").alias("frame_index")), ["camera_id", "frame_index"]).where("x1 IS NOT NULL")
    name, track = F.col("class_name"), F.col("track_id") if "track_id" in detections.columns else F.lit(None).cast("bigint")
    color = geo.team_color(name) if tracked else F.array(*map(F.lit, DETECTED))
    text = geo.caption(name, track, F.col("confidence")) if tracked else geo.two_places(F.col("confidence")) if confidence else F.lit(None).cast("string")
    boxes = rows.select("camera_id", "place", "det_ord", *geo.int_box(), color.alias("color"), text.alias("caption"))
    return write(annotate(kept, boxes, glyph), folder, fps)
