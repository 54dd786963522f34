"""Binary masks as arrays or as rows of on-pixels: morphology, components, blobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ellipse(size: int) -> np.ndarray:
    r = size // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    half = np.round(r * np.sqrt(np.maximum(0, (r * r - y * y) / max(1, r * r))))
    return np.abs(x) <= half


def _slide(mask: np.ndarray, kernel: np.ndarray, grow: bool) -> np.ndarray:
    r = kernel.shape[0] // 2
    wide = np.pad(mask.astype(bool), r, constant_values=not grow)
    out = np.zeros_like(mask, bool) if grow else np.ones_like(mask, bool)
    for dy, dx in np.argwhere(kernel):
        part = wide[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
        out = out | part if grow else out & part
    return out


def open_close(mask: np.ndarray, opening: int = 7, closing: int = 11) -> np.ndarray:
    """Opening takes out specks, closing fills gaps; masks are 0/255."""
    a, b = ellipse(opening), ellipse(closing)
    opened = _slide(_slide(mask > 0, a, False), a, True)
    return np.where(_slide(_slide(opened, b, True), b, False), 255, 0).astype(np.uint8)


def label(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected on-pixels, in order of their first pixel by row. Pixels are sorted by row, each is
    joined to its four neighbours that come before, and every one takes the least root until nothing changes."""
    order = np.lexsort((x, y))
    xs, ys = x[order].astype(np.int64), y[order].astype(np.int64)
    wide = int(xs.max(initial=0) - xs.min(initial=0)) + 3
    key = (ys - ys.min(initial=0)) * wide + xs - xs.min(initial=0) + 1
    left, right = [], []
    for step in (1, wide - 1, wide, wide + 1):
        at = np.searchsorted(key, key - step)
        found = np.flatnonzero(key[np.minimum(at, len(key) - 1)] == key - step) if len(key) else at
        left.append(found)
        right.append(at[found])
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(key))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    out = np.empty(len(key), np.int64)
    out[order] = np.unique(root, return_inverse=True)[1] + 1
    return out


def components(pixels: DataFrame) -> DataFrame:
    """pixels(frame_index, x, y) with the component's label; frames are independent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates()
        return pdf.assign(label=label(pdf.x.to_numpy(), pdf.y.to_numpy()))

    return pixels.select("frame_index", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).groupBy("frame_index").applyInPandas(run, "frame_index bigint, x bigint, y bigint, label bigint")


def blobs(labelled: DataFrame) -> DataFrame:
    return labelled.where("label > 0").groupBy("frame_index", "label").agg(
        F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.count("*").alias("area")
    )


def by_area(found: DataFrame, least: int = 500, most: int = 10000) -> DataFrame:
    return found.where(F.col("area").between(least, most))


def refine(labelled: DataFrame, least: int = 500, most: int = 10000) -> DataFrame:
    """The pixels of the blobs whose area is within bounds; a frame's blobs are few against its pixels."""
    kept = by_area(blobs(labelled), least, most).select("frame_index", "label")
    return labelled.join(kept, ["frame_index", "label"], "left_semi")


def without_shadows(value: Column) -> Column:
    return F.when(value == 127, F.lit(0)).otherwise(value)


def opened_closed(pixels: DataFrame, width: int, height: int | None = None, opening: int = 7, closing: int = 11) -> DataFrame:
    """open_close on rows of on-pixels, frame by frame; without a height, down to a frame's last on-pixel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((height or int(pdf.y.max()) + 1, width), np.uint8)
        mask[pdf.y, pdf.x] = 255
        y, x = np.nonzero(open_close(mask, opening, closing))
        return pd.DataFrame({"frame_index": pdf.frame_index.iloc[0], "x": x, "y": y})

    rows = pixels.select("frame_index", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    return rows.groupBy("frame_index").applyInPandas(run, "frame_index bigint, x bigint, y bigint")


def to_detections(found: DataFrame, camera_id: str, source: str = "mog2") -> DataFrame:
    """Blobs as detections of full confidence and no class."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("frame_index").orderBy("label")) - 1
    left, top = F.col("left").cast("double"), F.col("top").cast("double")
    return found.select(
        F.lit(source).alias("source"), F.lit(camera_id).alias("camera_id"), "frame_index", place.cast("int").alias("det_ord"),
        left.alias("x1"), top.alias("y1"), (left + F.col("width")).alias("x2"), (top + F.col("height")).alias("y2"),
        F.lit(1.0).alias("confidence"), F.lit(None).cast("int").alias("class_id"), F.lit(None).cast("string").alias("class_name"),
    )
