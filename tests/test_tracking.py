import itertools
import os

import duckdb
import numpy as np
import pytest

from tracklake import catalogue
from tracklake.operators import evaluation, trackers
from tracklake.operators.assignment import assign, gated, sparse
from tracklake.operators.masks import label, open_close
from tracklake.plans.views import view

SF = "/root/testdata/sf0.001"
BOX = np.array([[10.0, 10, 50, 90]])


def test_assignment_is_optimal():
    random = np.random.default_rng(3)
    for n, m in itertools.product((1, 2, 3, 4), repeat=2):
        cost = random.random((n, m))
        if n <= m:
            best = min(sum(cost[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(cost[r, c] for c, r in enumerate(p)) for p in itertools.permutations(range(n), m))
        assert abs(sum(cost[r, c] for r, c in assign(cost)) - best) < 1e-12


def test_matched_tentative_detection_spawns_again():
    t = trackers.sort_tracker()
    far = np.array([[200.0, 200, 240, 280]])
    assert t.step(BOX) == []
    assert t.step(BOX) == [(0, 1)]
    assert t.step(BOX) == [(0, 1)]
    t.step(np.concatenate([BOX, far]))
    assert (1, 3) in t.step(np.concatenate([BOX, far]))
    u = trackers.sort_tracker(double_spawn=False)
    for boxes in (BOX, BOX, BOX, np.concatenate([BOX, far])):
        u.step(boxes)
    assert (1, 2) in u.step(np.concatenate([BOX, far]))


def test_lost_tracks_live_for_max_age():
    none = np.empty((0, 4))
    for gap, same in ((3, True), (4, False)):
        t = trackers.sort_tracker(max_age=3, double_spawn=False)
        t.step(BOX), t.step(BOX)
        for _ in range(gap):
            t.step(none)
        assert (t.step(BOX) == [(0, 1)]) is same


def test_appearance_gates():
    a, b = np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]])
    t = trackers.deep_sort_tracker()
    t.step(BOX, a)
    assert t.step(BOX, a) == [(0, 1)]
    assert t.step(BOX, b) == []
    assert t.step(BOX, a) == [(0, 1)]


def test_allowed_pairs_are_assigned_as_on_the_whole_matrix():
    random = np.random.default_rng(4)
    for k in range(600):
        n, m = random.integers(1, 13, 2)
        cost, allowed = random.random((n, m)) * 0.4 - 0.1, random.random((n, m)) < random.random()
        cost = np.round(cost, 1) if k % 2 else cost
        got = sparse([(int(r), int(c), float(cost[r, c])) for r, c in zip(*np.nonzero(allowed), strict=True)])
        want = gated(cost, allowed, 0.3)
        assert got == sorted(got) and all(allowed[r, c] for r, c in got)
        assert len({r for r, _ in got}) == len({c for _, c in got}) == len(got) == len(want)
        assert abs(sum(cost[r, c] for r, c in got) - sum(cost[r, c] for r, c in want)) < 1e-8


class PlainCascade(trackers.Tracker):
    """Level by level, on whole matrices, from galleries that are lists."""

    def step(self, boxes, features=None):
        self.now = features
        out = super().step(boxes, features)
        own = self.__dict__.setdefault("own", {})
        for d, i in out:
            own[i] = [*own[i], features[d]][-self.budget :]
        for i in self.ids[len(self.ids) - sum(h == 1 and s == 0 for h, s in zip(self.hits, self.stale, strict=True)) :]:
            own.setdefault(i, [self.vector(self.gallery[self.ids.index(i)][0])])
        return out

    def vector(self, slot):
        return self.looks.vectors[slot].copy()

    def _by_appearance(self, far, tracks, free, seen):
        out = []
        for age in sorted({self.stale[t] for t in tracks}):
            level = [t for t in tracks if self.stale[t] == age]
            if age > self.max_age or not free:
                break
            unlike = np.array([(1.0 - np.stack(self.own[self.ids[t]]) @ self.now[free].T).min(axis=0) for t in level])
            allowed = (far(level, free) <= self.max_iou_distance) & (unlike <= self.max_appearance)
            found = [(level[r], free[c]) for r, c in gated(unlike, allowed, self.max_appearance)]
            out += found
            free = self._left(free, found)
        return out


def test_cascade_equals_a_plain_one():
    for seed in range(3):
        random, matches = np.random.default_rng(seed), 0
        options = {"budget": 1 + 3 * seed, "max_age": 4 + 6 * seed}
        t, plain = trackers.deep_sort_tracker(**options), PlainCascade(max_appearance=0.2, double_spawn=False, **options)
        look, at = random.normal(size=(30, 16)), random.random((30, 2)) * 300
        for frame in range(80):
            at += random.normal(size=at.shape) * 2
            on = np.flatnonzero(random.random(30) < (0.0 if frame % 29 == 28 else 0.4 if frame % 7 == 0 else 0.9))
            box = np.concatenate([at[on], at[on] + [40, 90] + random.random((len(on), 2)) * 5], axis=1)
            features = look[on] + random.normal(size=(len(on), 16)) * 0.5
            features /= np.linalg.norm(features, axis=1, keepdims=True)
            got = t.step(box, features)
            assert got == plain.step(box, features)
            matches += len(got)
            assert sum(t.looks.held) == sum(map(len, t.gallery)) and max(map(len, t.gallery)) <= t.budget
        assert matches > 1000


def test_a_look_that_many_share_is_held_once():
    t, look = trackers.deep_sort_tracker(), np.eye(4)
    for _ in range(30):
        box = np.concatenate([BOX + 200 * k for k in range(20)])
        t.step(box, look[np.arange(20) % 4])
    assert sum(map(len, t.gallery)) == 600 and sum(h > 0 for h in t.looks.held) == 4


def test_looks_of_a_class_are_those_of_its_detections(spark):
    """A small table of looks by a column gives what an embedding for each detection gives, each camera in a task of its own."""
    from pyspark.sql import functions as F

    det = view(spark, SF, "det").where("det_ord < 12").withColumn("shirt", F.when(F.col("class_id") < 9, F.col("class_id")))
    frames = det.select("camera_id", "frame_index").where("frame_index <> 1").unionByName(spark.range(9, 11).selectExpr("'cam_1' AS camera_id", "id AS frame_index"))
    looks = spark.createDataFrame([(k, [float(j == k) for j in range(8)]) for k in range(8)] + [(None, [1.0] * 8)], "shirt long, embedding array<float>")
    each = det.join(looks, "shirt").select("camera_id", "frame_index", "det_ord", "embedding")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = trackers.track(det, frames, looks).withColumn("task", F.spark_partition_id()).collect()
        want = trackers.track(det, frames, each).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda rows: sorted((r.camera_id, r.frame_index, r.det_ord, r.track_id, r.emit_ord, r.x1) for r in rows)
    assert got and key(got) == key(want) and 1 not in {r.frame_index for r in got}
    assert len({r.task for r in got}) == len({r.camera_id for r in got}) == 3


def test_masks():
    assert label(np.array([0, 1, 5]), np.array([0, 1, 0])).tolist() == [1, 1, 2]
    mask = np.zeros((40, 40), np.uint8)
    mask[10:30, 10:30] = 255
    mask[2, 2] = 255
    out = open_close(mask)
    assert out[2, 2] == 0 and out[20, 20] == 255


def test_streaming_equals_batch(spark, tmp_path):
    from tracklake.streaming.trackers import track_stream

    det = view(spark, SF, "det").where("det_ord < 5")
    rows = trackers.frame_rows(det, det.select("camera_id", "frame_index").distinct())
    rows = rows.select("camera_id", "frame_index", "det_ord", "x1", "y1", "x2", "y2", "confidence", "class_id", "class_name")
    rows.write.parquet(str(tmp_path / "in"))
    stream = track_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = trackers.track(det, det)
    key = lambda df: sorted(map(tuple, df.select("camera_id", "frame_index", "det_ord", "track_id").collect()))
    assert key(spark.sql("SELECT * FROM tracked")) == key(batch)


def test_tracker_queries_take_every_detection(spark):
    det = view(spark, SF, "det").toPandas().sort_values(["frame_index", "det_ord"])
    want = set()
    for camera, rows in det.groupby("camera_id"):
        t = trackers.sort_tracker()
        for frame, found in rows.groupby("frame_index"):
            boxes = found[["x1", "y1", "x2", "y2"]].to_numpy()
            want |= {(camera, frame, int(found.det_ord.iloc[d]), track) for d, track in t.step(boxes)}
    got = catalogue.queries()["sort_tracks"](spark, SF).collect()
    assert {(r.camera_id, r.frame_index, r.det_ord, r.track_id) for r in got} == want
    assert max(r.det_ord for r in got) > 100
    assert max(r.det_ord for r in catalogue.queries()["deepsort_tracks"](spark, SF).collect()) > 100


def test_truth_against_itself_is_perfect(spark):
    gt = view(spark, SF, "gt").where("gt_pos < 10")
    same = gt.selectExpr("camera_id", "frame_index", "det_ord", "x1", "y1", "x2", "y2", "CAST(det_ord AS BIGINT) AS track_id")
    for r in evaluation.identity_metrics(gt, same).collect():
        assert r.idf1 == 1
    for r in evaluation.hota(gt, same).collect():
        assert abs(r.hota - 1) < 1e-9


@pytest.mark.parametrize("name", ["nms_class_independent", "resolve_labels", "coco_to_gt", "detection_metrics", "team_caption", "connected_components"])
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = db.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    rows = lambda x: sorted(str([round(float(v), 6) if isinstance(v, float) else str(v) for v in r]) for r in x[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
