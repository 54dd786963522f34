"""Kernels on frames, arrays of (height, width, 3) bytes in the order blue, green, red, and their use on rows of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .masks import label, open_close
from .runs import spans, whole_runs

FRAMES = "camera_id string, fps double, frame_index bigint, height int, width int, pixels binary"
DETECTED, THICKNESS = (0, 255, 0), 2


def gray(frame: np.ndarray) -> np.ndarray:
    """BT.601 luminance."""
    return np.clip(np.rint(frame @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8)


# --- contrast

#: sRGB to CIE XYZ (D65), rows X, Y, Z over red, green, blue, and the white point.
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(frame: np.ndarray) -> np.ndarray:
    c = frame[..., ::-1] / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ XYZ.T / WHITE
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    t = np.where(f**3 > 216 / 24389, f**3, (116 * f - 16) * 27 / 24389) * WHITE
    linear = np.clip(t @ np.linalg.inv(XYZ).T, 0, 1)
    c = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(c[..., ::-1] * 255), 0, 255).astype(np.uint8)


def equalise(channel: np.ndarray, clip: float = 6.0, tiles: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Contrast-limited adaptive equalisation of bytes: each tile's histogram is clipped, what is clipped is spread over
    all values, and a pixel's value comes from the four tiles around it, by distance. Edges are mirrored to whole tiles."""
    height, width = channel.shape
    th, tw = -(-height // tiles[0]), -(-width // tiles[1])
    wide = np.pad(channel, ((0, th * tiles[0] - height), (0, tw * tiles[1] - width)), mode="symmetric")
    blocks = wide.reshape(tiles[0], th, tiles[1], tw).swapaxes(1, 2).reshape(tiles[0] * tiles[1], th * tw)
    counts = np.zeros((len(blocks), 256), np.int64)
    np.add.at(counts, (np.arange(len(blocks))[:, None], blocks), 1)
    if clip > 0:
        most = max(1, int(clip * th * tw / 256))
        over = np.maximum(counts - most, 0).sum(axis=1)
        counts = np.minimum(counts, most) + (over // 256)[:, None]
        for k, rest in enumerate(over % 256):
            if rest:
                counts[k, np.arange(0, 256, max(1, 256 // rest))[:rest]] += 1
    table = np.clip(np.rint(np.cumsum(counts, axis=1) * (255.0 / (th * tw))), 0, 255).reshape(*tiles, 256)

    def around(n: int, size: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, count - 1), np.clip(low + 1, 0, count - 1), at - low

    y0, y1, fy = around(height, th, tiles[0])
    x0, x1, fx = around(width, tw, tiles[1])
    fy, fx = fy[:, None], fx[None, :]
    value = lambda ys, xs: table[ys[:, None], xs[None, :], channel]
    out = (value(y0, x0) * (1 - fx) + value(y0, x1) * fx) * (1 - fy) + (value(y1, x0) * (1 - fx) + value(y1, x1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def normalise_illumination(frame: np.ndarray, clip: float = 6.0, tiles: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Equalises lightness; colour stays."""
    lab = to_lab(frame)
    lightness = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.uint8)
    lab[..., 0] = equalise(lightness, clip, tiles) / 2.55
    return from_lab(lab)


# --- motion


@dataclass
class Background:
    """A mixture of up to MODES Gaussians a pixel, sorted by weight, whose number adapts (Zivkovic 2004). step() gives
    255 for foreground, 127 for shadow and 0."""

    history: int = 1000
    threshold: float = 25.0
    rate: float = -1.0
    shadows: bool = False
    frames: int = 0
    weight: np.ndarray = field(default=None, repr=False)
    mean: np.ndarray = field(default=None, repr=False)
    var: np.ndarray = field(default=None, repr=False)

    MODES, SHARE, FIT, FIRST, LEAST, MOST, COMPLEXITY, DARK = 5, 0.9, 9.0, 15.0, 4.0, 75.0, 0.05, 0.5

    def step(self, frame: np.ndarray) -> np.ndarray:
        shape, x = frame.shape[:2], frame.reshape(-1, 3).astype(float)
        if self.weight is None:
            n = len(x)
            self.weight, self.mean, self.var = np.zeros((self.MODES, n)), np.zeros((self.MODES, n, 3)), np.zeros((self.MODES, n))
        self.frames += 1
        a = self.rate if self.rate >= 0 else 1.0 / min(2 * self.frames, self.history)
        w, had = self.weight, self.weight > 0
        far = ((x[None] - self.mean) ** 2).sum(axis=2)
        aged = np.where(had, (1 - a) * w - a * self.COMPLEXITY, 0.0)
        before = np.cumsum(aged, axis=0) - aged
        behind = had & (before < self.SHARE)
        near = had & (far < self.FIT * self.var)
        fit = near & (np.cumsum(near, axis=0) == 1)  # the first that fits
        # Only modes up to the one that fits are looked at.
        looked = np.cumsum(fit, axis=0) - fit == 0
        back = (behind & looked & (far < self.threshold * self.var)).any(axis=0)
        mask = np.where(back, 0, 255).astype(np.uint8)
        if self.shadows:
            mask[~back & self._shadow(x, behind)] = 127
        aged = np.where(fit, aged + a, aged)
        k = np.where(fit, a / np.maximum(aged, 1e-12), 0.0)
        self.mean += k[..., None] * (x[None] - self.mean)
        self.var = np.where(fit, np.clip(self.var + k * (far - self.var), self.LEAST, self.MOST), self.var)
        aged = np.where(aged < a * self.COMPLEXITY, 0.0, aged)
        aged /= np.maximum(aged.sum(axis=0), 1e-12)
        new = np.flatnonzero(~fit.any(axis=0))
        if len(new):
            spot = np.minimum((aged[:, new] > 0).sum(axis=0), self.MODES - 1)  # the first free mode, else the lightest
            alone = spot == 0
            aged[:, new] = np.where(alone, 0.0, aged[:, new] * (1 - a))
            aged[spot, new] = np.where(alone, 1.0, a)
            self.mean[spot, new], self.var[spot, new] = x[new], self.FIRST
            aged[:, new] /= aged[:, new].sum(axis=0)
        order = np.argsort(-aged, axis=0, kind="stable")
        self.weight = np.take_along_axis(aged, order, axis=0)
        self.var = np.take_along_axis(self.var, order, axis=0)
        self.mean = np.take_along_axis(self.mean, order[..., None], axis=0)
        return mask.reshape(shape)

    def _shadow(self, x: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """A background colour made darker, by a factor from DARK to 1."""
        size = (self.mean**2).sum(axis=2)
        share = np.divide((x[None] * self.mean).sum(axis=2), size, out=np.zeros_like(size), where=size > 0)
        off = ((share[..., None] * self.mean - x[None]) ** 2).sum(axis=2)
        return (behind & (share >= self.DARK) & (share <= 1) & (off < self.threshold * self.var * share**2)).any(axis=0)


def keep_blobs(mask: np.ndarray, least: int, most: int) -> np.ndarray:
    y, x = np.nonzero(mask)
    names = label(x, y)
    size = np.bincount(names, minlength=1)
    out = np.zeros_like(mask)
    good = (size[names] >= least) & (size[names] <= most)
    out[y[good], x[good]] = 255
    return out


# --- drawing


def draw_box(frame: np.ndarray, box: tuple[int, int, int, int], color: tuple[int, int, int], thickness: int = THICKNESS) -> None:
    """A rectangle's outline, centred on the box's edges, as far as it is inside the frame."""
    x1, y1, x2, y2 = box
    out, rest = thickness // 2, thickness - thickness // 2 - 1
    at = lambda lo, hi, most: slice(max(0, lo), max(0, min(most, hi + 1)))
    h, w = frame.shape[:2]
    for y in (y1, y2):
        frame[at(y - out, y + rest, h), at(x1 - out, x2 + rest, w)] = color
    for x in (x1, x2):
        frame[at(y1 - out, y2 + rest, h), at(x - out, x + rest, w)] = color


def draw_strip(frame: np.ndarray, x: int, y: int, text: str, color: tuple[int, int, int], glyph: Callable[[str], np.ndarray] | None = None) -> None:
    """A filled strip above (x, y), as wide as the text; glyph gives the mask of a text, if there is a font to write with."""
    shape = glyph(text) if glyph else np.zeros((10, 9 * len(text)), bool)
    top, (h, w) = y - shape.shape[0] - 6, frame.shape[:2]
    frame[max(0, top) : max(0, min(h, y + 1)), max(0, x) : max(0, min(w, x + shape.shape[1] + 5))] = color
    light = color[2] * 0.299 + color[1] * 0.587 + color[0] * 0.114 > 128
    ys, xs = np.nonzero(shape)
    ys, xs = ys + y - 4 - shape.shape[0], xs + x + 2
    inside = (ys >= 0) & (ys < h) & (xs >= 0) & (xs < w)
    frame[ys[inside], xs[inside]] = (0, 0, 0) if light else (255, 255, 255)


# --- on rows


def frame_of(height: int, width: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, -1)


def on_frames(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Frames under a kernel that takes them one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(pixels=[kernel(frame_of(h, w, p)).tobytes() for h, w, p in zip(pdf.height, pdf.width, pdf.pixels, strict=True)])

    return frames.select(*(c.split()[0] for c in FRAMES.split(", "))).mapInPandas(run, FRAMES)


def moving_masks(
    frames: DataFrame, warm_up: int = 10, opening: int = 7, closing: int = 11, least: int = 1500, most: int = 200000, equal: bool = True, **options: object
) -> DataFrame:
    """Masks of what moves: lightness equalised, background subtracted, shadows out, specks out and gaps filled, blobs
    by area; the first warm_up frames are blank. A camera's frames come in order and only its background is held."""
    rows = frames.select(*(c.split()[0] for c in FRAMES.split(", "))).repartition("camera_id").sortWithinPartitions("camera_id", "frame_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, model, count = None, None, 0
        for pdf in whole_runs(batches, "camera_id", "frame_index"):
            out = []
            for lo, hi in spans(pdf.camera_id.to_numpy()):
                if pdf.camera_id[lo] != now:
                    now, model, count = pdf.camera_id[lo], Background(**options), 0
                for k in range(lo, hi):
                    frame = frame_of(pdf.height[k], pdf.width[k], pdf.pixels[k])
                    mask = model.step(normalise_illumination(frame) if equal else frame)
                    mask = keep_blobs(open_close(np.where(mask == 127, 0, mask), opening, closing), least, most)
                    out.append((np.zeros_like(mask) if count < warm_up else mask).tobytes())
                    count += 1
            yield pdf.assign(pixels=out)

    return rows.mapInPandas(run, FRAMES)


def on_pixels(masks: DataFrame) -> DataFrame:
    """camera_id, frame_index, x, y of the pixels that are on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(len(pdf)):
                y, x = np.nonzero(frame_of(pdf.height[k], pdf.width[k], pdf.pixels[k])[..., 0])
                yield pd.DataFrame({"camera_id": pdf.camera_id[k], "frame_index": pdf.frame_index[k], "x": x, "y": y})

    return masks.select(*(c.split()[0] for c in FRAMES.split(", "))).mapInPandas(run, "camera_id string, frame_index bigint, x bigint, y bigint")


def annotate(frames: DataFrame, boxes: DataFrame, glyph: Callable[[str], np.ndarray] | None = None) -> DataFrame:
    """Frames with their boxes drawn: boxes(camera_id, place, x1, y1, x2, y2 int, color array<int>, caption), place being
    the frame's position. Frames and boxes meet by place, frames without boxes stay as they are."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_index")) - 1
    listed = boxes.groupBy("camera_id", "place").agg(F.array_sort(F.collect_list(F.struct("det_ord", "x1", "y1", "x2", "y2", "color", "caption"))).alias("boxes"))
    rows = frames.withColumn("place", place).join(listed, ["camera_id", "place"], "left").drop("place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, w, p, found in zip(pdf.height, pdf.width, pdf.pixels, pdf.boxes, strict=True):
                frame = frame_of(h, w, p).copy()
                for b in found if found is not None else []:
                    color = tuple(int(c) for c in b["color"])
                    draw_box(frame, (b["x1"], b["y1"], b["x2"], b["y2"]), color)
                    if b["caption"] is not None:
                        draw_strip(frame, b["x1"], b["y1"], b["caption"], color, glyph)
                out.append(frame.tobytes())
            yield pdf.drop(columns="boxes").assign(pixels=out)

    return rows.select(*(c.split()[0] for c in FRAMES.split(", ")), "boxes").mapInPandas(run, FRAMES)
