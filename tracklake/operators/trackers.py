"""Online trackers: motion only, and motion with appearance.

The constant-velocity filter of a box (centre, aspect, height) falls apart into four filters of
a position and a velocity, coupled only by the height that scales their noise, so all tracks
are predicted and updated as arrays. A tracker's state is a plain object with one
step(boxes, features); batch and streaming wrap the same step. The unit of parallelism is the
camera: frames of one camera are inherently sequential, and stream through its task a batch at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import COORDS, EPSILON
from .assignment import gated, sparse
from .runs import spans, whole_runs

KEY = ["camera_id", "frame_index", "det_ord"]
#: Noise per unit of height, of positions and velocities; and the aspect's own.
POSITION, VELOCITY = 1 / 20, 1 / 160


def _noise(height: np.ndarray, scale: float, aspect: float) -> np.ndarray:
    out = np.repeat((height * scale)[:, None], 4, axis=1)
    out[:, 2] = aspect
    return out


class Kalman:
    """Filters of n boxes: p, v (n, 4) and their covariances pp, pv, vv (n, 4)."""

    def __init__(self, z: np.ndarray):
        z = np.asarray(z, float).reshape(-1, 4)
        self.p, self.v = z.copy(), np.zeros_like(z)
        self.pp, self.pv, self.vv = _noise(z[:, 3], 2 * POSITION, 1e-2) ** 2, np.zeros_like(z), _noise(z[:, 3], 10 * VELOCITY, 1e-5) ** 2

    def take(self, other: Kalman | None, keep: np.ndarray) -> None:
        for name in ("p", "v", "pp", "pv", "vv"):
            mine = getattr(self, name)[keep]
            setattr(self, name, mine if other is None else np.concatenate([mine, getattr(other, name)]))

    def predict(self) -> None:
        h = self.p[:, 3].copy()
        self.p = self.p + self.v
        self.pp = self.pp + 2 * self.pv + self.vv + _noise(h, POSITION, 1e-2) ** 2
        self.pv = self.pv + self.vv
        self.vv = self.vv + _noise(h, VELOCITY, 1e-5) ** 2

    def update(self, at: np.ndarray, z: np.ndarray) -> None:
        total = self.pp[at] + _noise(self.p[at, 3], POSITION, 1e-1) ** 2
        kp, kv, gap = self.pp[at] / total, self.pv[at] / total, z - self.p[at]
        self.p[at] += kp * gap
        self.v[at] += kv * gap
        self.pp[at] -= kp * kp * total
        self.pv[at] -= kp * kv * total
        self.vv[at] -= kv * kv * total

    def boxes(self) -> np.ndarray:
        w, h = self.p[:, 2] * self.p[:, 3], self.p[:, 3]
        return np.stack([self.p[:, 0] - w / 2, self.p[:, 1] - h / 2, self.p[:, 0] + w / 2, self.p[:, 1] + h / 2], axis=1)


def measure(boxes: np.ndarray) -> np.ndarray:
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    return np.stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w / np.maximum(h, 1e-6), h], axis=1)


def iou_matrix(a: np.ndarray, b: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    side = lambda k: np.maximum(np.minimum(a[:, None, k + 2], b[None, :, k + 2]) - np.maximum(a[:, None, k], b[None, :, k]), 0)
    both = side(0) * side(1)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - both + epsilon
    return np.divide(both, union, out=np.zeros_like(both), where=union != 0)


@dataclass
class Looks:
    """The galleries of all tracks. A vector that many hold (an empty crop's, a class's) is kept once, and met once
    by a detection; others cost a slot each."""

    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    held: list[int] = field(default_factory=list)
    free: list[int] = field(default_factory=list)
    slots: dict[int, int] = field(default_factory=dict)

    def add(self, features: np.ndarray) -> list[int]:
        """A slot for each vector, held once more than before."""
        if not self.held:
            self.vectors = np.empty((0, features.shape[1]))
        text, width = features.tobytes(), features.shape[1] * features.itemsize
        out, now = [], {}
        for n, f in enumerate(features):
            own = text[n * width : (n + 1) * width]
            k = now.get(own)
            if k is not None:
                self.held[k] += 1
                out.append(k)
                continue
            key = crc32(own)
            k = self.slots.get(key)
            if k is None or self.vectors[k].tobytes() != own:
                if not self.free:
                    size = len(self.held)
                    self.vectors = np.concatenate([self.vectors, np.empty((max(64, size), features.shape[1]))])
                    self.free = list(range(len(self.vectors) - 1, size - 1, -1))
                    self.held += [0] * (len(self.vectors) - size)
                slot = self.free.pop()
                self.vectors[slot] = f
                if k is None:
                    self.slots[key] = slot
                k = slot
            self.held[k] += 1
            now[own] = k
            out.append(k)
        return out

    def drop(self, slots: Iterable[int]) -> None:
        for k in slots:
            self.held[k] -= 1
            if not self.held[k]:
                key = crc32(self.vectors[k])
                if self.slots.get(key) == k:
                    del self.slots[key]
                self.free.append(k)

    def unlike(self, galleries: list[dict[int, int]], seen: list[int]) -> np.ndarray:
        """Least cosine distance of each gallery (none is empty) to each of the slots seen."""
        at = np.fromiter(chain.from_iterable(galleries), int)
        (rows, row), (columns, column) = (np.unique(x, return_inverse=True) for x in (at, np.array(seen)))
        near = self.vectors[rows] @ self.vectors[columns].T
        begins = np.cumsum([0, *(len(g) for g in galleries[:-1])])
        return 1.0 - np.maximum.reduceat(near[row], begins, axis=0)[:, column]


#: Distances of some tracks' predicted boxes to some detections: only what is asked for is computed.
Far = Callable[[list[int], list[int]], np.ndarray]


@dataclass
class Tracker:
    """max_appearance None: motion only. double_spawn: a detection matched to a tentative track
    starts a track of its own as well (how the motion-only tracker behaves)."""

    max_iou_distance: float = 0.8
    max_age: int = 60
    n_init: int = 2
    max_appearance: float | None = None
    budget: int = 100
    double_spawn: bool = True
    next_id: int = 1
    filter: Kalman = field(default_factory=lambda: Kalman(np.empty((0, 4))))
    ids: list[int] = field(default_factory=list)
    hits: list[int] = field(default_factory=list)
    stale: list[int] = field(default_factory=list)
    confirmed: list[bool] = field(default_factory=list)
    looks: Looks = field(default_factory=Looks)
    gallery: list[deque[int]] = field(default_factory=list)
    shown: list[dict[int, int]] = field(default_factory=list)

    def step(self, boxes: np.ndarray, features: np.ndarray | None = None) -> list[tuple[int, int]]:
        """One frame: (detection, track id) of its matches, confirmed tracks first."""
        boxes = np.asarray(boxes, float).reshape(-1, 4)
        self.filter.predict()
        self.stale = [s + 1 for s in self.stale]
        sure = [k for k, c in enumerate(self.confirmed) if c]
        unsure = [k for k, c in enumerate(self.confirmed) if not c]
        predicted = self.filter.boxes()
        far = lambda t, d: 1.0 - iou_matrix(predicted[t], boxes[d])
        free = list(range(len(boxes)))
        seen = None if features is None else self.looks.add(np.asarray(features, float)) if free else []
        if self.max_appearance is None:
            first = self._by_motion(far, sure, free)
        else:
            first = self._by_appearance(far, sure, free, seen)
        free = self._left(free, first)
        second = self._by_motion(far, unsure, free)
        matches = first + second
        z = measure(boxes)
        if matches:
            t, d = (np.array(x) for x in zip(*matches, strict=True))
            self.filter.update(t, z[d])
        for t, d in matches:
            self.hits[t] += 1
            self.stale[t] = 0
            self.confirmed[t] = self.confirmed[t] or self.hits[t] >= self.n_init
            if seen is not None:
                self._show(t, seen[d])
        matched = {t for t, _ in matches}
        out = [(d, self.ids[t]) for t, d in matches]
        keep = [k for k in range(len(self.ids)) if k in matched or (self.confirmed[k] and self.stale[k] <= self.max_age)]
        new = free if self.double_spawn else self._left(free, second)
        self._replace(keep, z[new], [seen[d] for d in new] if seen is not None else None)
        if seen is not None:
            self.looks.drop(seen)
        return out

    @staticmethod
    def _left(free: list[int], matches: list[tuple[int, int]]) -> list[int]:
        taken = {d for _, d in matches}
        return [d for d in free if d not in taken]

    def _by_motion(self, far: Far, tracks: list[int], free: list[int]) -> list[tuple[int, int]]:
        if not tracks or not free:
            return []
        part = far(tracks, free)
        return [(tracks[r], free[c]) for r, c in gated(part, part <= self.max_iou_distance, self.max_iou_distance)]

    def _by_appearance(self, far: Far, tracks: list[int], free: list[int], seen: list[int]) -> list[tuple[int, int]]:
        """Tracks seen last come first: a level for each frame since. The last frame's tracks meet all detections; the
        older ones only what those leave, all levels' pairs at once, from which each level takes its own."""
        out: list[tuple[int, int]] = []
        stale = self.stale
        tracks = [t for t in tracks if self.shown[t] and stale[t] <= self.max_age]
        youngest = min((stale[t] for t in tracks), default=0)
        for some in ([t for t in tracks if stale[t] == youngest], [t for t in tracks if stale[t] != youngest]):
            pairs = self._alike(far, some, free, seen)
            levels: dict[int, list[tuple[int, int, float]]] = {youngest: pairs}
            if some and stale[some[0]] != youngest:
                levels = {}
                for pair in pairs:
                    levels.setdefault(stale[pair[0]], []).append(pair)
            taken: set[int] = set()
            for age in sorted(levels):
                found = sparse([x for x in levels[age] if x[1] not in taken] if taken else levels[age])
                taken.update(d for _, d in found)
                out += found
            free = [d for d in free if d not in taken]
        return out

    def _alike(self, far: Far, tracks: list[int], free: list[int], seen: list[int]) -> list[tuple[int, int, float]]:
        """Pairs (track, detection, distance of their looks) within both limits."""
        if not tracks or not free:
            return []
        close = far(tracks, free) <= self.max_iou_distance
        some = np.flatnonzero(close.any(axis=1))
        if not len(some):
            return []
        unlike = self.looks.unlike([self.shown[tracks[k]] for k in some], [seen[d] for d in free])
        r, c = np.nonzero(close[some] & (unlike <= self.max_appearance))
        return list(zip(np.array(tracks)[some[r]].tolist(), np.array(free)[c].tolist(), unlike[r, c].tolist(), strict=True))

    def _show(self, t: int, slot: int) -> None:
        """The slot joins a track's gallery, and what the budget leaves no place for goes."""
        gallery, shown = self.gallery[t], self.shown[t]
        gallery.append(slot)
        self.looks.held[slot] += 1
        shown[slot] = shown.get(slot, 0) + 1
        if self.budget and len(gallery) > self.budget:
            old = gallery.popleft()
            shown[old] -= 1
            if not shown[old]:
                del shown[old]
            self.looks.drop([old])

    def _replace(self, keep: list[int], z: np.ndarray, slots: list[int] | None) -> None:
        self.filter.take(Kalman(z), np.array(keep, int))
        n = len(z)
        for k in set(range(len(self.ids))).difference(keep):
            self.looks.drop(self.gallery[k])
        self.ids = [self.ids[k] for k in keep] + list(range(self.next_id, self.next_id + n))
        self.hits = [self.hits[k] for k in keep] + [1] * n
        self.stale = [self.stale[k] for k in keep] + [0] * n
        self.confirmed = [self.confirmed[k] for k in keep] + [False] * n
        self.gallery = [self.gallery[k] for k in keep] + [deque() for _ in range(n)]
        self.shown = [self.shown[k] for k in keep] + [{} for _ in range(n)]
        for k, slot in enumerate(slots or [], len(keep)):
            self._show(k, slot)
        self.next_id += n


def sort_tracker(**options: object) -> Tracker:
    return Tracker(**options)


def deep_sort_tracker(**options: object) -> Tracker:
    return Tracker(**{"max_appearance": 0.2, "double_spawn": False, **options})


RESULT = f"camera_id string, frame_index bigint, det_ord int, emit_ord int, {', '.join(f'{c} double' for c in COORDS)}, confidence double, class_id int, class_name string, track_id bigint"


def advance(tracker: Tracker, rows: pd.DataFrame) -> pd.DataFrame:
    """Runs a camera's rows (frames without detections have a null det_ord) in frame order."""
    rows = rows.sort_values(["frame_index", "det_ord"], kind="stable", na_position="first").reset_index(drop=True)
    boxes, seen = rows[list(COORDS)].to_numpy(float), rows.det_ord.notna().to_numpy()
    features = rows.embedding.to_list() if "embedding" in rows else None
    take, place, tracks = [], [], []
    for lo, hi in spans(rows.frame_index.to_numpy()):
        at = lo + np.flatnonzero(seen[lo:hi])
        looks = None if features is None else np.stack([features[k] for k in at]).astype(float) if len(at) else np.empty((0, 1))
        for k, (d, track) in enumerate(tracker.step(boxes[at], looks)):
            take.append(at[d])
            place.append(k)
            tracks.append(track)
    out = rows.iloc[take].assign(emit_ord=place, track_id=tracks)
    return out[[c.split()[0] for c in RESULT.split(", ")]]


def frame_rows(detections: DataFrame, frames: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Detections of all frames, a row with nulls for a frame that has none. A detection without an
    embedding has that of an empty crop, all zeros: it is like nothing, and moves with its box alone."""
    if features is not None:
        detections = _with_embedding(detections, features)
    return frames.select("camera_id", "frame_index").distinct().join(detections, ["camera_id", "frame_index"], "left")


def _with_embedding(detections: DataFrame, features: DataFrame) -> DataFrame:
    size = features.select(F.size("embedding").alias("n")).first()
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size["n"] if size else 1)
    own = features.select(*KEY, F.col("embedding").cast("array<float>").alias("embedding"))
    return detections.join(own, KEY, "left").withColumn("embedding", F.coalesce("embedding", zeros))


def track(detections: DataFrame, frames: DataFrame, features: DataFrame | None = None, **options: object) -> DataFrame:
    """Matched detections with their track_id; emit_ord is their order within the frame. Features have an embedding by
    camera_id, frame_index and det_ord; or they are a small table (an embedding of each class, say) by other columns
    of the detections, which goes to each task as it is, so that no detection carries a copy through shuffle and sort.
    Frames go along as rows without a detection, ahead of their detections; what is in no such frame is left out."""
    make = sort_tracker if features is None else deep_sort_tracker
    looks, by = None, []
    if features is not None and set(KEY) <= set(features.columns):
        detections = _with_embedding(detections, features)
    elif features is not None:
        by = [c for c in features.columns if c != "embedding"]
        own = features.dropna().select(*(F.col(c).cast(detections.schema[c].dataType).alias(c) for c in by), "embedding")
        looks = {r[0]: np.array(r[1], np.float32) for r in own.select(F.to_json(F.struct(*by)), "embedding").collect()}
    columns = [*COORDS, "confidence", "class_id", "class_name", *(["embedding"] if features is not None and looks is None else [])]
    carried = [F.to_json(F.struct(*by)).alias("_look")] if by else []
    there = "camera_id IS NOT NULL AND frame_index IS NOT NULL"
    found = detections.where(f"{there} AND det_ord IS NOT NULL").select(*KEY, *columns, *carried)
    listed = frames.where(there).select("camera_id", "frame_index").distinct()
    # By range and of a fixed number: two of a few cameras often share a hash's partition, and small partitions are joined; both would wait for each other.
    n = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.unionByName(listed, allowMissingColumns=True).repartitionByRange(n, "camera_id").sortWithinPartitions(*KEY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracker = None, None
        zeros = np.zeros(len(next(iter(looks.values()))) if looks else 1, np.float32)
        for pdf in whole_runs(batches, "camera_id", "frame_index"):
            if looks is not None:
                pdf["embedding"] = [looks.get(x, zeros) for x in pdf.pop("_look")]
            for lo, hi in spans(pdf.camera_id.to_numpy()):
                if pdf.camera_id.iloc[lo] != now:
                    now, tracker = pdf.camera_id.iloc[lo], make(**options)
                some = pdf.iloc[lo:hi]
                if some.det_ord.isna().sum() < some.frame_index.nunique():
                    some = some[some.det_ord.isna().groupby(some.frame_index).transform("any")]
                yield advance(tracker, some)

    return rows.mapInPandas(run, RESULT)


def kalman_path(tracks: DataFrame) -> DataFrame:
    """The filtered box of each track after each of its detections, predicted one step between them. All tracks
    of a batch are filtered together, detection by detection."""
    names = ["cx", "cy", "a", "h", "vx", "vy", "va", "vh"]
    rows = tracks.select("camera_id", "track_id", "frame_index", *COORDS).repartition("camera_id", "track_id").sortWithinPartitions("camera_id", "track_id", "frame_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(batches, "camera_id", "track_id"):
            z, out = measure(pdf[list(COORDS)].to_numpy(float)), np.empty((len(pdf), 8))
            first = np.array([lo for lo, _ in spans(pd.factorize(pd.MultiIndex.from_frame(pdf[["camera_id", "track_id"]]))[0])])
            length = np.diff([*first, len(pdf)])
            state = Kalman(z[first])
            for k in range(int(length.max())):
                alive = np.flatnonzero(length > k)
                if k:
                    state.take(None, alive)
                    first, length, alive = first[alive], length[alive], np.arange(len(alive))
                    state.predict()
                    state.update(alive, z[first + k])
                out[first + k] = np.concatenate([state.p, state.v], axis=1)
            yield pd.concat([pdf[["camera_id", "track_id", "frame_index"]], pd.DataFrame(out, columns=names)], axis=1)

    return rows.mapInPandas(
        run, "camera_id string, track_id bigint, frame_index bigint, cx double, cy double, a double, h double, vx double, vy double, va double, vh double"
    )
