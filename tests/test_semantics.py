"""Golden cases, worked by hand, and properties; every query with SQL against it."""

import itertools
import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake import catalogue
from tracklake.functions import geometry as geo
from tracklake.operators import appearance, detections, evaluation, images, labels, masks, trackers
from tracklake.plans.views import view
from tracklake.sources import annotations, backends, video
from tracklake.streaming.trackers import track_stream

SF = "/root/testdata/sf0.001"
BOX = "camera_id string, frame_index long, gt_pos long, det_ord int, x1 double, y1 double, x2 double, y2 double, class_name string, track_id long"


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return out


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_every_query_matches_its_sql(spark, db, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), db.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(str([round(float(v), 6) if isinstance(v, float) else str(v) for v in r]) for r in x[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_views_grow_with_the_tables(spark):
    for name in ("gt", "pred", "tracked", "det"):
        small, large = (view(spark, f"/root/testdata/{sf}", name).count() for sf in ("sf0.001", "sf0.01"))
        assert large > 9 * small


# --- the accumulator


def boxes(spark, truth, predicted):
    at = {"a": 0, "b": 1, "far": 1000, "near": 4, "nearer": 2}
    place = lambda x: (float(at.get(x, x)), 0.0, float(at.get(x, x)) + 20, 40.0)
    gt = [("c", 5 * f, f, k, *place(x), name, None) for f, row in enumerate(truth) for k, (name, x) in enumerate(row)]
    pr = [("c", 5 * f, f, k, *place(x), "-", name) for f, row in enumerate(predicted) for k, (name, x) in enumerate(row)]
    return spark.createDataFrame(gt, BOX), spark.createDataFrame(pr, BOX).drop("gt_pos")


def events(gt, pred, **options):
    return sorted((r.gt_pos, r.event, r.truth or "", r.predicted or "") for r in evaluation.mot_events(gt, pred, **options).collect())


def test_a_prediction_is_kept_by_one_truth(spark):
    """A was last matched to 7, then B was: with both in a frame, 7 goes to A, which comes first, and B is free for 8."""
    gt, pred = boxes(spark, [[("A", 0)], [("B", 0)], [("A", 0), ("B", 2)]], [[(7, 0)], [(7, 0)], [(7, 0), (8, 2)]])
    assert events(gt, pred) == [(0, "MATCH", "A", "7"), (1, "MATCH", "B", "7"), (2, "MATCH", "A", "7"), (2, "SWITCH", "B", "8")]
    gt, pred = boxes(spark, [[("A", 0)], [("B", 0)], [("A", 0), ("B", 2)]], [[(7, 0)], [(7, 0)], [(7, 0)]])
    assert events(gt, pred) == [(0, "MATCH", "A", "7"), (1, "MATCH", "B", "7"), (2, "MATCH", "A", "7"), (2, "MISS", "B", "")]


def test_kept_pairs_come_before_better_ones(spark):
    gt, pred = boxes(spark, [[("A", 0)], [("A", 0)]], [[(1, 4)], [(1, 4), (2, 0)]])
    assert events(gt, pred) == [(0, "MATCH", "A", "1"), (1, "FP", "", "2"), (1, "MATCH", "A", "1")]
    gt, pred = boxes(spark, [[("A", 0)], [("A", 0)]], [[(1, 4)], [(2, 0)]])
    assert events(gt, pred) == [(0, "MATCH", "A", "1"), (1, "SWITCH", "A", "2")]


def test_sequential_detection_metrics_count_switches_as_detected(spark):
    """By places in the lists: in the second frame the truth's box is the second of the list, a switch, which is no tp."""
    gt, pred = boxes(spark, [[("A", 0)], [("A", 0)]], [[(1, 0)], [(2, 1000), (1, 0)]])
    assert events(gt, pred, identities=False) == [(0, "MATCH", "0", "0"), (1, "FP", "", "0"), (1, "SWITCH", "0", "1")]
    r = evaluation.detection_metrics(gt, pred, sequential=True).first()
    assert (r.tp, r.fp, r.fn, r.recall, r.mean_iou) == (1, 1, 0, 1.0, 1.0) and abs(r.precision - 2 / 3) < 1e-12
    r = evaluation.detection_metrics(gt, pred).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 0)


def test_contended_boxes_are_assigned_as_by_brute_force(spark):
    dice = np.random.default_rng(5)
    gt, pred = [], []
    for f in range(60):
        for k in range(dice.integers(1, 5)):
            x = float(dice.integers(0, 30))
            gt.append(("c", 5 * f, f, k, x, 0.0, x + 20, 40.0, f"n{k}", None))
        for k in range(dice.integers(0, 5)):
            x = float(dice.integers(0, 30))
            pred.append(("c", 5 * f, f, k, x, 0.0, x + 20, 40.0, "-", k))
    g, p = spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX).drop("gt_pos")
    got = {}
    for r in evaluation.matches(evaluation.overlaps(g, p)).collect():
        got.setdefault(r.gt_pos, []).append((r.gt_ord, r.pred_ord, r.iou))
    iou = lambda a, b: max(0.0, min(a[6], b[6]) - max(a[4], b[4])) / (40 - max(0.0, min(a[6], b[6]) - max(a[4], b[4])))
    for f in range(60):
        a, b = [x for x in gt if x[2] == f], [x for x in pred if x[2] == f]
        best = (0, 0.0)
        for n in range(min(len(a), len(b)) + 1):
            for rows, columns in itertools.product(itertools.combinations(range(len(a)), n), itertools.permutations(range(len(b)), n)):
                near = [iou(a[r], b[c]) for r, c in zip(rows, columns, strict=True)]
                if all(x >= 0.5 for x in near):
                    best = max(best, (n, round(sum(near), 9)))
        mine = got.get(f, [])
        assert (len(mine), round(sum(x for *_, x in mine), 9)) == best
        assert len({r for r, *_ in mine}) == len({c for _, c, _ in mine}) == len(mine)


# --- the filter and the trackers


def test_kalman_first_steps():
    """One box of height 40: noise by twentieths and 160ths of it."""
    k = trackers.Kalman(np.array([[100.0, 50.0, 0.5, 40.0]]))
    assert np.allclose(k.pp[0], [16, 16, 1e-4, 16]) and np.allclose(k.vv[0], [6.25, 6.25, 1e-10, 6.25])
    k.predict()
    assert np.allclose(k.pp[0], [26.25, 26.25, 2e-4 + 1e-10, 26.25]) and np.allclose(k.pv[0, 0], 6.25) and np.allclose(k.vv[0, 0], 6.3125)
    k.update(np.array([0]), np.array([[110.0, 50.0, 0.5, 40.0]]))
    gain = 26.25 / 30.25
    assert np.allclose(k.p[0, 0], 100 + 10 * gain) and np.allclose(k.v[0, 0], 10 * 6.25 / 30.25) and np.allclose(k.pp[0, 0], 26.25 - gain**2 * 30.25)


def test_detections_without_an_embedding_stay(spark):
    box = (0.0, 0.0, 20.0, 40.0)
    rows = [("c", f, 0, *box, 0.9, 1, "x") for f in range(4)]
    det = spark.createDataFrame(rows, "camera_id string, frame_index long, det_ord int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, class_name string")
    looks = spark.createDataFrame([("c", 0, 0, [1.0, 0.0])], "camera_id string, frame_index long, det_ord int, embedding array<float>")
    got = trackers.frame_rows(det, det.select("camera_id", "frame_index"), looks).orderBy("frame_index").collect()
    assert [list(r.embedding) for r in got] == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    # Tentative tracks go by motion; a confirmed one is never like a zero vector.
    assert [(r.frame_index, r.track_id) for r in trackers.track(det, det.select("camera_id", "frame_index"), looks).orderBy("frame_index").collect()] == [(1, 1), (3, 2)]


def test_streams_wait_for_frames_out_of_order(spark, tmp_path):
    det = view(spark, SF, "det").where("det_ord < 4")
    columns = ["camera_id", "frame_index", "det_ord", "x1", "y1", "x2", "y2", "confidence", "class_id", "class_name"]
    many = None
    for k in range(4):  # the view has three frames a camera: twelve, then
        part = det.withColumn("frame_index", F.col("frame_index") + 3 * k)
        many = part if many is None else many.unionByName(part)
    rows = trackers.frame_rows(many, many.select("camera_id", "frame_index")).select(*columns)
    rows.limit(0).write.parquet(str(tmp_path / "in"))
    for frame in (1, 0, 3, 2, 5, 4, 7, 6, 9, 8, 11, 10, 0, 40, 41):  # frame 0 once more, late
        part = rows.where(F.col("frame_index") == frame)
        if frame > 11:
            part = rows.where("frame_index = 0").withColumn("frame_index", F.lit(frame).cast("long"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = track_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), lateness=4)
    query = stream.writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda found: sorted((r.camera_id, r.frame_index, r.det_ord, r.track_id) for r in found if r.frame_index < 12)
    assert key(spark.sql("SELECT * FROM ordered").collect()) == key(trackers.track(many, many).collect())


def test_galleries_by_frame(spark):
    schema = "camera_id string, frame_index long, track_id long, embedding array<double>"
    gallery = spark.createDataFrame([("c", 0, 1, [1.0, 0.0]), ("c", 0, 1, [0.6, 0.8]), ("c", 1, 2, [0.0, 1.0])], schema)
    queries = spark.createDataFrame([("c", 0, 10, [0.0, 1.0])], schema.replace("track_id", "query_id"))
    tracks = spark.createDataFrame([("c", 0, 1), ("c", 0, 2)], "camera_id string, frame_index long, track_id long")
    got = {r.track_id: round(r.distance, 9) for r in appearance.appearance_cost(gallery, queries, tracks).collect()}
    assert got == {1: 0.2, 2: 1.0}


# --- sources


def coco(path, category=1):
    data = {
        "categories": [{"id": 1, "name": "Red_1"}, {"id": 2, "name": "Ball"}],
        "images": [{"id": k, "file_name": f"out{c}_frame_{f:04d}_jpg.x.jpg"} for k, (c, f) in enumerate([(2, 7), (2, 9), (13, 3)])] + [{"id": 9, "file_name": "other_frame_1.jpg"}],
        "annotations": [{"image_id": i, "category_id": c, "bbox": [1.0, 2.0, 3.0, 4.0]} for i, c in ((0, 1), (0, 2), (1, category), (2, 2), (9, 1), (77, 1))],
    }
    path.write_text(json.dumps(data))


def test_annotations_are_written_a_camera_at_a_time(spark, tmp_path):
    coco(tmp_path / "_annotations.coco.json")
    truth = annotations.coco_to_truth(*annotations.read_coco(spark, str(tmp_path / "_annotations.coco.json")))
    target = str(tmp_path / "out")
    assert annotations.write_sequences(truth.where("camera_id = 'cam_2'"), target) == ["cam_2"]
    assert annotations.write_sequences(truth.withColumn("x1", F.lit(99.0)), target) == ["cam_13"]
    assert annotations.copy_annotations(str(tmp_path), target) == []
    back = {(r.camera_id, r.gt_pos, r.frame_index, r.det_ord): (r.x1, r.x2, r.confidence, r.class_name, r.track_id) for r in annotations.read_sequences(spark, target).collect()}
    assert back == {
        ("cam_2", 0, 0, 0): (1.0, 4.0, 1.0, "Red_1", 1), ("cam_2", 0, 0, 1): (1.0, 4.0, 1.0, "Ball", 2),
        ("cam_2", 1, 2, 0): (1.0, 4.0, 1.0, "Red_1", 1), ("cam_13", 0, 0, 0): (99.0, 4.0, 1.0, "Ball", 1),
    }
    (tmp_path / "plain").mkdir()
    with pytest.raises(FileNotFoundError):
        annotations.copy_annotations(str(tmp_path / "plain"), target)
    with pytest.raises(FileNotFoundError):
        annotations.copy_annotations(str(tmp_path / "plain"), target, coco=False)
    (tmp_path / "plain" / "a.json").write_text("{}")
    assert annotations.copy_annotations(str(tmp_path / "plain"), target, coco=False) == ["a.json"] and os.path.exists(f"{target}/a.json")


def test_a_camera_is_a_file_of_frames_and_never_a_row(spark, tmp_path):
    row = "camera_id string, frame_index long, det_ord int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, class_name string, track_id long"
    truth = [(c, 3 * f, d, 1.0 * d, 2.0, 3.0, 4.0, 1.0, d, f'"{d}', None) for c in ("a b", "cam_2") for f in range(50) for d in range(3)]
    rows = spark.createDataFrame(truth, row).repartition(7, "x1")
    frames = annotations.nested(rows).collect()
    assert len(frames) == 100 and all([d.class_id for d in f.detections] == [0, 1, 2] for f in frames)
    target = str(tmp_path / "out")
    assert annotations.write_sequences(rows, target, source="s", fps=12.5) == ["a b", "cam_2"]
    assert sorted(os.listdir(target)) == ["camera_id=a b", "camera_id=cam_2"]
    for camera in ("a b", "cam_2"):
        files = [f for f in os.listdir(f"{target}/camera_id={camera}") if not f.startswith(".")]
        assert len(files) == 1 and files[0].endswith(".json")
        with open(f"{target}/camera_id={camera}/{files[0]}") as f:
            lines = f.read().splitlines()
        document = json.loads("".join(lines))
        assert len(lines) == 50 and document["source"] == "s" and document["fps"] == 12.5
        assert [f["frame_index"] for f in document["frames"]] == [3 * f for f in range(50)]
        assert document["frames"][7]["detections"][2] == {"bbox": {"x1": 2.0, "y1": 2.0, "x2": 3.0, "y2": 4.0}, "confidence": 1.0, "class_id": 2, "class_name": '"2'}
    back = annotations.read_sequences(spark, target).collect()
    assert sorted((r.camera_id, r.frame_index, r.det_ord) for r in back) == sorted(r[:3] for r in truth)
    plan = catalogue.queries()["gt_json_nested"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1, "frames are gathered, cameras are not"


def test_a_missing_category_is_an_error(spark, tmp_path):
    coco(tmp_path / "x.json", category=5)
    truth = annotations.coco_to_truth(*annotations.read_coco(spark, str(tmp_path / "x.json")))
    with pytest.raises(Exception, match="unknown category 5"):
        truth.select("camera_id").collect()


def test_detector_rows_round_as_exact_values_do(spark):
    values = [0.0625, 0.0635, 0.0005, 0.0015, 0.1235, 0.9995, 2.675, 1.0, 0.3333333, float(np.float32(0.7005))]
    rows = spark.createDataFrame([("c", 0, [(0.0, 0.0, 1.0, 1.0, v, 0) for v in values])], f"camera_id string, frame_index long, boxes array<{detections.RAW_BOX}>")
    got = detections.from_detector(rows, {0: "Ball"}).orderBy("det_ord").collect()
    assert [r.confidence for r in got] == [round(v, 3) for v in values] and got[0].class_name == "Ball" and got[0].source == "yolo"
    with pytest.raises(Exception, match="no name for class 0"):
        detections.from_detector(rows, {1: "x"}).collect()


def test_team_colors(spark):
    names = {"Ball": (0, 255, 255), "Red_11_x": (0, 0, 255), "White_2": (255, 255, 255), "Refree_1": (0, 165, 255), "referee_3": (0, 165, 255), "Coach": (128, 128, 128)}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", geo.team_color(F.col("n")).alias("c"), geo.jersey(F.col("n")).alias("j")).collect()
    assert {r.n: tuple(r.c) for r in rows} == names
    assert {r.n: r.j for r in rows} == {"Ball": "", "Red_11_x": "11_x", "White_2": "2", "Refree_1": "1", "referee_3": "3", "Coach": "Coach"}


# --- video and masks


def clip(n=6, h=48, w=50):
    dice = np.random.default_rng(2)
    return [dice.integers(0, 256, (h, w, 3)).astype(np.uint8) for _ in range(n)]


def test_video_round_trip(spark, tmp_path):
    frames, path = clip(), str(tmp_path / "a" / "cam_1.avi")
    assert video.save_raw(frames, path, 25.9) == 6
    rows = video.scan(spark, path, "cam_1").orderBy("frame_index").collect()
    assert all((images.frame_of(r.height, r.width, r.pixels) == f).all() for r, f in zip(rows, frames, strict=True)) and {r.fps for r in rows} == {25.0}
    assert video.scan(spark, path, "c", 2).count() == 2 and video.scan(spark, path, "c", 0).count() == 0 and video.scan(spark, path, "c", 99).count() == 6
    one = video.scan(spark, path, "c", 1, to_gray=True).first()
    assert (images.frame_of(one.height, one.width, one.pixels)[..., 0] == images.gray(frames[0])).all()
    two = video.scan(spark, path, "cam_1").unionByName(video.scan(spark, path, "cam_2", 3)).repartition(5)
    done = sorted(map(tuple, video.write(two, str(tmp_path / "out"), 10).collect()))
    assert done == [("cam_1", f"{tmp_path}/out/cam_1.avi", 6), ("cam_2", f"{tmp_path}/out/cam_2.avi", 3)]
    back = backends.open_video(f"{tmp_path}/out/cam_2.avi")
    assert [(f == g).all() for f, g in zip(back.frames(), frames, strict=False)] == [True] * 3 and back.fps == 10.0
    assert video.probe(spark, {"cam_1": path}).first()[2:] == (25.0, 6, 50, 48)
    for bad, error in (("none.avi", FileNotFoundError), ("none.mp4", FileNotFoundError), ("bad.avi", RuntimeError), ("bad.mp4", backends.MissingBackend)):
        if bad.startswith("bad"):
            (tmp_path / bad).write_bytes(b"not a video at all")
        with pytest.raises(error):
            backends.open_video(str(tmp_path / bad))
    with pytest.raises(RuntimeError):
        video.save_raw(frames, str(tmp_path))


def test_videos_with_boxes(spark, tmp_path):
    path = str(tmp_path / "c.avi")
    video.save_raw([np.zeros((40, 60, 3), np.uint8)] * 4, path)
    schema = "camera_id string, frame_index long, det_ord int, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string, track_id long"
    found = spark.createDataFrame([("c", f, 0, 10.9, 20.2, 30.0, 35.0, 0.5, "White_4", 3) for f in (10, 11, 12)], schema)
    done = video.produce(video.scan(spark, path, "c"), found, str(tmp_path / "out"), tracked=True).collect()
    assert [r.frames for r in done] == [3]  # as far as both go
    frame = backends.open_video(f"{tmp_path}/out/c.avi").frame(0)
    white = (frame == 255).all(axis=2)
    assert white[20, 10:31].all() and white[20:36, 10].all() and not white[25, 15] and white[15, 12]
    plain = video.produce(video.scan(spark, path, "c"), found.drop("track_id"), str(tmp_path / "plain"), confidence=False).collect()
    frame = backends.open_video(plain[0].path).frame(0)
    assert (frame[20, 15] == (0, 255, 0)).all() and not frame[15, 12].any()


def test_moving_block_is_found(spark, tmp_path):
    dice, frames = np.random.default_rng(1), []
    for k in range(115):
        f = np.clip(np.full((60, 90, 3), 90) + dice.integers(-2, 3, (60, 90, 3)), 0, 255).astype(np.uint8)
        if k >= 100:
            f[20:44, 4 * (k - 100) : 4 * (k - 100) + 20] = 220
        frames.append(f)
    path = str(tmp_path / "m.avi")
    video.save_raw(frames, path)
    found = images.moving_masks(video.scan(spark, path, "cam_1").repartition(4), warm_up=10, opening=3, closing=5, least=100, most=2000, equal=False)
    blobs = masks.blobs(masks.components(images.on_pixels(found)))
    rows = {r.frame_index: r for r in masks.to_detections(blobs, "cam_1").collect()}
    assert set(rows) == set(range(100, 115))
    for k, r in rows.items():
        assert abs(r.x1 - 4 * (k - 100)) <= 1 and abs(r.x2 - 4 * (k - 100) - 20) <= 1 and (r.y1, r.y2) == (20.0, 44.0) and r.confidence == 1.0 and r.class_name is None


def test_shadows_and_forgetting():
    model = images.Background(shadows=True, history=50)
    still = np.full((4, 4, 3), 100, np.uint8)
    for _ in range(40):
        mask = model.step(still)
    assert not mask.any()
    dark, bright = still.copy(), still.copy()
    dark[0, 0], bright[0, 0] = 70, 250
    assert model.step(dark)[0, 0] == 127 and model.step(bright)[0, 0] == 255
    for _ in range(60):
        mask = model.step(bright)
    assert not mask.any()  # what stays becomes background


def test_contrast():
    flat = np.full((64, 64), 100, np.uint8)
    assert len(np.unique(images.equalise(flat))) == 1
    ramp = np.tile(np.arange(100, 132, dtype=np.uint8).repeat(2), (64, 1))
    out = images.equalise(ramp, clip=40.0, tiles=(1, 1))
    assert (np.diff(out[0].astype(int)) >= 0).all() and int(out.max()) - int(out.min()) > 200
    assert int(images.equalise(ramp, clip=1.0, tiles=(1, 1)).max()) - int(images.equalise(ramp, clip=1.0, tiles=(1, 1)).min()) < 100
    frame = clip(1)[0]
    assert np.abs(images.from_lab(images.to_lab(frame)).astype(int) - frame).max() <= 1
    assert images.normalise_illumination(frame).shape == frame.shape


def test_labels_of_a_spiral_and_of_noise():
    dice = np.random.default_rng(8)
    for grid in (dice.random((40, 50)) < 0.4, np.ones((30, 30), bool), np.zeros((3, 3), bool)):
        y, x = np.nonzero(grid)
        got, seen = masks.label(x, y), {}
        at = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(x, y, strict=True))}
        for k in range(len(x)):  # in order of rows: a flood from each pixel not yet reached
            if k in seen:
                continue
            todo, name = [k], len(set(seen.values())) + 1
            while todo:
                p = todo.pop()
                if p not in seen:
                    seen[p] = name
                    todo += [at[q] for q in ((x[p] + dx, y[p] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)) if q in at]
        assert got.tolist() == [seen[k] for k in range(len(x))]


# --- models


def test_detector_and_encoder_plug_in(spark, tmp_path):
    class Mean:
        dimension = 3

        def __call__(self, frame, boxes):
            return [frame[y1:y2, x1:x2].mean(axis=(0, 1)) for x1, y1, x2, y2 in boxes]

    class Bright:
        def detect(self, frame, confidence, size, classes):
            y, x = np.nonzero(frame[..., 0] > 200)
            return [(x.min(), y.min(), x.max() + 1, y.max() + 1, 0.87654, 1)] if len(x) and confidence < 0.8 else []

    frames = [np.zeros((30, 40, 3), np.uint8) for _ in range(3)]
    for k, f in enumerate(frames[:2]):
        f[5:15, 5 + k : 20 + k] = (250, 10, 10)
    path = str(tmp_path / "d.avi")
    video.save_raw(frames, path)
    rows = video.scan(spark, path, "c")
    found = detections.from_detector(backends.detect(rows, Bright()), {1: "Red_1"}, "bright").orderBy("frame_index")
    got = found.collect()
    assert [(r.frame_index, r.x1, r.y2, r.confidence, r.source) for r in got] == [(0, 5.0, 15.0, 0.877, "bright"), (1, 6.0, 15.0, 0.877, "bright")]
    outside = found.where("frame_index = 0").withColumns({"det_ord": F.lit(1), "x1": F.lit(50.0), "x2": F.lit(60.0)})
    looks = {(r.frame_index, r.det_ord): r.embedding for r in backends.features(rows, found.unionByName(outside), Mean()).collect()}
    assert looks[0, 1] == [0.0, 0.0, 0.0] and abs(np.linalg.norm(looks[0, 0]) - 1) < 1e-6 and len(looks) == 3
    with pytest.raises(Exception, match="frame is missing"):
        backends.features(rows.where("frame_index > 0"), found, Mean()).collect()


def test_weights(tmp_path):
    path = str(tmp_path / "m" / "w.pt")
    with pytest.raises(FileNotFoundError):
        backends.weights_file(path)
    assert backends.weights_file(path, lambda p: open(p, "w").close()) == path == backends.weights_file(path)
    state = {"state_dict": {"module.a": np.ones(3), "b": np.ones(2), "c": np.ones(1)}}
    assert list(backends.matching_weights(state, {"a": (3,), "b": (5,)})) == ["a"]
    with pytest.raises(RuntimeError):
        backends.matching_weights(state, {"z": (1,)})


def test_merging_needs_the_same_frames(spark):
    det = view(spark, SF, "det")
    frames = det.select(F.lit("x").alias("source"), "camera_id", "frame_index").distinct()
    assert detections.merge_detections(det, det, frames=[frames, frames]).count() == 2 * det.count()
    for other in (frames.where("frame_index > 0"), frames.withColumn("source", F.lit("y"))):
        with pytest.raises(ValueError):
            detections.merge_detections(det, det, frames=[frames, other])


def test_suppression_is_idempotent(spark):
    once = detections.nms(view(spark, SF, "det"))
    twice = detections.nms(once)
    key = lambda df: sorted(map(tuple, df.select("camera_id", "frame_index", "det_ord").collect()))
    assert key(once) == key(twice)


def test_labels_are_claimed_across_batches(spark):
    """Against a plain loop, with batches of two rows, so that claims outlive a batch."""
    random = np.random.default_rng(3)
    rows = [(f"cam_{c}", int(t), int(f), int(o), str(random.choice(["Ball", "Red_1", "Red_2", "White_3"])), float(random.integers(1, 9)) / 10)
            for c in range(2) for t in range(9) for f, o in zip(random.choice(40, 5, replace=False), range(t * 5, t * 5 + 5), strict=True)]
    df = spark.createDataFrame(rows, "camera_id string, track_id long, frame_index long, det_ord int, class_name string, confidence double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r.camera_id, r.track_id): r.stable_name for r in labels.stable_labels(labels.votes(df)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for camera in ("cam_0", "cam_1"):
        tracks = []
        for t in range(9):
            own = [r for r in rows if r[:2] == (camera, t)]
            votes = {}
            for r in own:
                total, first = votes.get(r[4], (0, (r[2], r[3])))
                votes[r[4]] = (total + round(r[5] * 1000), min(first, (r[2], r[3])))
            ranked = sorted(votes, key=lambda x: (-votes[x][0], votes[x][1]))
            tracks.append(((-votes[ranked[0]][0], -len(own), min((r[2], r[3]) for r in own)), t, ranked))
        claimed = set()
        for _, t, ranked in sorted(tracks):
            want[camera, t] = next((x for x in ranked if x == "Ball" or x not in claimed), ranked[0])
            claimed |= {want[camera, t]} - {"Ball"}
    assert got == want


def test_frames_have_a_place_by_camera(spark):
    rows = spark.createDataFrame([("a", 9, 0), ("a", 9, 1), ("a", 3, 0), ("b", 5, 0), ("b", None, 0)], "camera_id string, frame_index long, det_ord int")
    got = {(r.camera_id, r.frame_index, r.det_ord): r.gt_pos for r in annotations.with_place(rows).collect()}
    assert got == {("a", 3, 0): 0, ("a", 9, 0): 1, ("a", 9, 1): 1, ("b", 5, 0): 0, ("b", None, 0): None}


def test_a_camera_begins_with_its_first_annotated_image(spark):
    """Images without annotations, of unknown cameras or of other cameras don't count."""
    categories = spark.createDataFrame([(0, "Ball")], "id int, name string")
    pictures = spark.createDataFrame([(1, "out2_frame_00002_x.jpg"), (2, "out2_frame_00007_x.jpg"), (3, "out3_frame_00004_x.jpg"), (4, "foo_frame_00001_x.jpg")], "id long, file_name string")
    found = spark.createDataFrame([(2, 0, 1.0, 1.0, 2.0, 2.0, 0), (3, 0, 1.0, 1.0, 2.0, 2.0, 1), (4, 0, 1.0, 1.0, 2.0, 2.0, 2)], "image_id long, category_id int, x double, y double, w double, h double, ord long")
    got = {(r.camera_id, r.frame_index) for r in annotations.coco_to_truth(categories, pictures, found).collect()}
    assert got == {("cam_2", 0), ("cam_3", 0)}
