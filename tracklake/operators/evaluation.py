"""Detections and tracks against sparse ground truth.

Ground-truth frames align by position: the k-th annotated frame of a camera meets the
prediction frame k * stride; predictions elsewhere are not judged. Overlaps are joined by
(camera, frame) with the box predicate as the residual of the equi-join. A pair whose boxes overlap
nothing else is assigned as it is; what is left to Python are the one-to-one assignments of frames where
boxes contend, of a camera's identities, and the accumulator, which goes through a camera's frames in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import iou
from ..schema import COORDS
from .assignment import assign, gated
from .runs import spans, whole_runs
from .trackers import iou_matrix

ALPHAS = [k / 20 for k in range(1, 20)]
STRIDE, THRESHOLD = 5, 0.5


def frame_pairs(truth: DataFrame, predictions: DataFrame, stride: int = STRIDE) -> DataFrame:
    """camera_id, gt_pos, frame_index, n_truth, n_predicted of each annotated frame."""
    a = truth.groupBy("camera_id", "gt_pos").agg(F.count("*").alias("n_truth")).withColumn("frame_index", F.col("gt_pos") * stride)
    b = predictions.groupBy("camera_id", "frame_index").agg(F.count("*").alias("n_predicted"))
    return a.join(b, ["camera_id", "frame_index"], "left").select("camera_id", "gt_pos", "frame_index", "n_truth", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"))


def on_truth(predictions: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The predictions of frames that an annotated frame may meet, with its gt_pos."""
    return predictions.where(F.col("frame_index") % stride == 0).withColumn("gt_pos", (F.col("frame_index") / stride).cast("bigint"))


def overlaps(truth: DataFrame, predictions: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Pairs of boxes of a frame that overlap: camera_id, gt_pos, gt_ord, class_name, pred_ord, track_id, iou."""
    a = truth.select("camera_id", "gt_pos", F.col("det_ord").alias("gt_ord"), "class_name", *(F.col(c).alias(f"g{c}") for c in COORDS))
    b = on_truth(predictions, stride).select("camera_id", "gt_pos", F.col("det_ord").alias("pred_ord"), "track_id", *(F.col(c).alias(f"p{c}") for c in COORDS))
    side = lambda k: [F.col(k + c) for c in COORDS]
    pairs = a.join(b, ["camera_id", "gt_pos"]).withColumn("iou", iou(side("g"), side("p"), 0.0))
    return pairs.where("iou > 0").select("camera_id", "gt_pos", "gt_ord", "class_name", "pred_ord", "track_id", "iou")


def _assigned(pairs: DataFrame, assign_frame: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The one-to-one pairs of each frame: those that contend with no other as they are, the rest by assign_frame."""
    frame = ["camera_id", "gt_pos"]
    alone = (F.count("*").over(Window.partitionBy(*frame, "gt_ord")) == 1) & (F.count("*").over(Window.partitionBy(*frame, "pred_ord")) == 1)
    marked = pairs.withColumn("_alone", alone)
    rest = marked.where("NOT _alone").drop("_alone").groupBy(*frame).applyInPandas(assign_frame, pairs.schema)
    return marked.where("_alone").drop("_alone").unionByName(rest)


def matches(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The assignment of each frame: most pairs at the threshold or above, then the largest overlap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = np.unique(pdf.gt_ord), np.unique(pdf.pred_ord)
        far = np.full((len(rows), len(columns)), 2.0)
        far[np.searchsorted(rows, pdf.gt_ord), np.searchsorted(columns, pdf.pred_ord)] = 1 - pdf["iou"]
        hit = pd.DataFrame([(rows[r], columns[c]) for r, c in gated(far, far <= 1, 1.0)], columns=["gt_ord", "pred_ord"])
        return pdf.merge(hit, on=["gt_ord", "pred_ord"])

    return _assigned(pairs.where(1 - F.col("iou") <= F.lit(1 - threshold + 1e-12)), run)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def frame_events(truth: DataFrame, predictions: DataFrame, threshold: float = THRESHOLD, stride: int = STRIDE) -> DataFrame:
    """camera_id, gt_pos, tp, fp, fn of each annotated frame, assigned by itself."""
    hit = matches(overlaps(truth, predictions, stride), threshold).groupBy("camera_id", "gt_pos").agg(F.count("*").alias("tp"))
    rows = frame_pairs(truth, predictions, stride).join(hit, ["camera_id", "gt_pos"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return rows.select("camera_id", "gt_pos", "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"))


def detection_metrics(truth: DataFrame, predictions: DataFrame, threshold: float = THRESHOLD, stride: int = STRIDE, sequential: bool = False) -> DataFrame:
    """By camera: tp, fp, fn, precision, recall, f1, mean_iou; each frame assigned by itself, or, sequential, by the
    accumulator with places in the frames' lists as identities, where a switch is detected but no tp."""
    if sequential:
        events = mot_events(truth, predictions, threshold, stride, identities=False)
        of = lambda *kinds: F.sum(F.col("event").isin(*kinds).cast("long"))
        rows = events.groupBy("camera_id").agg(of("MATCH").alias("tp"), of("FP").alias("fp"), of("MISS").alias("fn"), of("MATCH", "SWITCH").alias("m"), F.avg("iou").alias("mean_iou"))
        precision, recall = ratio(F.col("m"), F.col("m") + F.col("fp")), ratio(F.col("m"), F.col("m") + F.col("fn"))
    else:
        totals = frame_pairs(truth, predictions, stride).groupBy("camera_id").agg(F.sum("n_truth").alias("t"), F.sum("n_predicted").alias("p"))
        hit = matches(overlaps(truth, predictions, stride), threshold).groupBy("camera_id").agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"))
        rows = totals.join(hit, "camera_id", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
        rows = rows.withColumns({"fp": F.col("p") - F.col("tp"), "fn": F.col("t") - F.col("tp")})
        precision, recall = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("t"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return rows.select("camera_id", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "mean_iou")


class Accumulator:
    """One camera's pairs, frame by frame: what a truth was matched to last is kept while it overlaps enough
    and no other truth has it; the rest is assigned."""

    def __init__(self, threshold: float):
        self.threshold, self.last = threshold, {}

    def step(self, truths: list, predicted: list, near: np.ndarray) -> list[tuple]:
        """(event, truth, predicted, overlap) of a frame; a truth whose prediction is another than before is a SWITCH."""
        allowed = 1 - near <= 1 - self.threshold + 1e-12
        place, pairs, used = {x: c for c, x in reversed(list(enumerate(predicted)))}, [], set()
        for r, x in enumerate(truths):
            c = place.get(self.last[x]) if x in self.last else None
            if c is not None and c not in used and allowed[r, c]:
                pairs.append((r, c))
                used.add(c)
        held = {r for r, _ in pairs}
        rows, columns = [r for r in range(len(truths)) if r not in held], [c for c in range(len(predicted)) if c not in used]
        at = np.ix_(rows, columns)
        pairs += [(rows[r], columns[c]) for r, c in gated(1 - near[at], allowed[at], 1.0)]
        out = []
        for r, c in pairs:
            out.append(("SWITCH" if self.last.get(truths[r], predicted[c]) != predicted[c] else "MATCH", truths[r], predicted[c], float(near[r, c])))
            self.last[truths[r]] = predicted[c]
        held, used = {r for r, _ in pairs}, {c for _, c in pairs}
        out += [("MISS", x, None, None) for r, x in enumerate(truths) if r not in held]
        return out + [("FP", None, x, None) for c, x in enumerate(predicted) if c not in used]


def mot_events(truth: DataFrame, predictions: DataFrame, threshold: float = THRESHOLD, stride: int = STRIDE, identities: bool = True) -> DataFrame:
    """The accumulator's events: camera_id, gt_pos, event (MATCH, SWITCH, MISS, FP), truth, predicted, iou. Identities are
    class names and track ids, or, without, the places in a frame's lists. A camera's frames come in order, a batch at a time."""
    frame = ["camera_id", "gt_pos"]
    place = (F.row_number().over(Window.partitionBy(*frame).orderBy("det_ord")) - 1).cast("string")
    frames = truth.select(*frame).distinct()
    a = truth.select(*frame, F.lit(0).alias("side"), "det_ord", (F.col("class_name") if identities else place).alias("identity"), *COORDS)
    b = on_truth(predictions, stride).join(frames, frame, "left_semi")
    b = b.select(*frame, F.lit(1).alias("side"), "det_ord", (F.col("track_id").cast("string") if identities else place).alias("identity"), *COORDS)
    rows = a.unionByName(b).repartition("camera_id").sortWithinPartitions("camera_id", "gt_pos", "side", "det_ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for pdf in whole_runs(batches, *frame):
            out = []
            camera, pos, side = (pdf[c].to_numpy() for c in ("camera_id", "gt_pos", "side"))
            boxes, names = pdf[list(COORDS)].to_numpy(float), pdf.identity.to_list()
            # A frame changes with its place, or with its camera where two cameras' frames meet.
            for lo, hi in spans(np.stack([pd.factorize(camera)[0], pos], axis=1).view("i8,i8").ravel()):
                if camera[lo] != now:
                    now, held = camera[lo], Accumulator(threshold)
                cut = lo + int((side[lo:hi] == 0).sum())
                near = iou_matrix(boxes[lo:cut], boxes[cut:hi], 0.0)
                out += [(now, int(pos[lo]), *e) for e in held.step(names[lo:cut], names[cut:hi], near)]
            yield pd.DataFrame(out, columns=["camera_id", "gt_pos", "event", "truth", "predicted", "iou"])

    return rows.mapInPandas(run, "camera_id string, gt_pos bigint, event string, truth string, predicted string, iou double")


def cooccurrence(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return pairs.where(F.col("iou") >= threshold).groupBy("camera_id", "class_name", "track_id").agg(F.count("*").alias("frames"))


def judged(truth: DataFrame, predictions: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The predictions on annotated frames."""
    return on_truth(predictions, stride).join(truth.select("camera_id", "gt_pos"), ["camera_id", "gt_pos"], "left_semi").select(*predictions.columns)


def totals(truth: DataFrame, predictions: DataFrame, stride: int = STRIDE) -> DataFrame:
    """By camera: frames, identities and detections on both sides."""
    a = truth.groupBy("camera_id").agg(F.count_distinct("gt_pos").alias("num_timesteps"), F.count_distinct("class_name").alias("num_gt_ids"), F.count("*").alias("num_gt_dets"))
    b = judged(truth, predictions, stride).groupBy("camera_id").agg(F.count_distinct("track_id").alias("num_tracker_ids"), F.count("*").alias("num_tracker_dets"))
    return a.join(b, "camera_id", "left").na.fill(0, ["num_tracker_ids", "num_tracker_dets"])


def identity_metrics(truth: DataFrame, predictions: DataFrame, threshold: float = THRESHOLD, stride: int = STRIDE) -> DataFrame:
    """IDTP, IDFP, IDFN, IDP, IDR, IDF1 by camera: one global one-to-one assignment of identities."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="class_name", columns="track_id", values="frames", fill_value=0).to_numpy(float)
        return pd.DataFrame({"camera_id": [pdf.camera_id.iloc[0]], "idtp": [int(sum(table[r, c] for r, c in assign(-table)))]})

    best = cooccurrence(overlaps(truth, predictions, stride), threshold).groupBy("camera_id").applyInPandas(run, "camera_id string, idtp bigint")
    rows = totals(truth, predictions, stride).join(best, "camera_id", "left").withColumn("idtp", F.coalesce("idtp", F.lit(0)))
    tp, t, p = F.col("idtp"), F.col("num_gt_dets"), F.col("num_tracker_dets")
    return rows.select("camera_id", "idtp", (p - tp).alias("idfp"), (t - tp).alias("idfn"), ratio(tp, p).alias("idp"), ratio(tp, t).alias("idr"), ratio(2 * tp, t + p).alias("idf1"))


def hota_by_alpha(truth: DataFrame, predictions: DataFrame, stride: int = STRIDE) -> DataFrame:
    """By camera and alpha: tp, hota, deta, assa, loca."""
    pairs = overlaps(truth, predictions, stride)
    counts_t = truth.groupBy("camera_id", "class_name").agg(F.count("*").alias("count_t"))
    counts_p = judged(truth, predictions, stride).groupBy("camera_id", "track_id").agg(F.count("*").alias("count_p"))
    # How well two identities agree over the whole sequence, from each frame's normalised overlaps.
    of = lambda *names: F.sum("iou").over(Window.partitionBy("camera_id", "gt_pos", *names))
    norm = pairs.withColumn("norm", F.col("iou") / (of("gt_ord") + of("pred_ord") - F.col("iou")))
    shared = norm.groupBy("camera_id", "class_name", "track_id").agg(F.sum("norm").alias("potential"))
    aligned = shared.join(counts_t, ["camera_id", "class_name"]).join(counts_p, ["camera_id", "track_id"]).select(
        "camera_id", "class_name", "track_id", "count_t", "count_p", (F.col("potential") / (F.col("count_t") + F.col("count_p") - F.col("potential"))).alias("alignment")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = pd.factorize(pdf.class_name), pd.factorize(pdf.track_id)
        score = np.zeros((len(rows[1]), len(columns[1])))
        score[rows[0], columns[0]] = pdf.alignment * pdf["iou"]
        hit = {x for x in assign(-score)}
        return pdf[[(r, c) in hit for r, c in zip(rows[0], columns[0], strict=True)]]

    both = pairs.join(aligned, ["camera_id", "class_name", "track_id"])
    # Dealt by frame once: that serves the counts, the assignments, and both ways of a pair.
    chosen = _assigned(both.repartition("camera_id", "gt_pos"), run)
    # A row a pair of identities with its sums for all alphas, and only then a row an alpha.
    passed = lambda a: F.col("iou") >= F.lit(a - 2.3e-16)
    sums = [F.struct(F.lit(a).alias("alpha"), F.count_if(passed(a)).alias("m"), F.sum(F.when(passed(a), F.col("iou"))).alias("near")) for a in ALPHAS]
    by_pair = chosen.groupBy("camera_id", "class_name", "track_id").agg(F.array(*sums).alias("a"), F.first("count_t").alias("count_t"), F.first("count_p").alias("count_p"))
    by_pair = by_pair.select("camera_id", "count_t", "count_p", F.explode("a").alias("x")).select("camera_id", "count_t", "count_p", "x.*").where("m > 0")
    by_alpha = by_pair.groupBy("camera_id", "alpha").agg(
        F.sum("m").alias("tp"), F.sum("near").alias("near"), F.sum(F.col("m") * F.col("m") / (F.col("count_t") + F.col("count_p") - F.col("m"))).alias("ass")
    )
    grid = totals(truth, predictions, stride).withColumn("alpha", F.explode(F.array(*(F.lit(a) for a in ALPHAS))))
    rows = grid.join(by_alpha, ["camera_id", "alpha"], "left").na.fill(0, ["tp", "near", "ass"])
    most = F.greatest(F.lit(1.0), F.col("tp").cast("double"))
    rows = rows.withColumns(
        {
            "assa": F.col("ass") / most,
            "deta": F.col("tp") / F.greatest(F.lit(1.0), (F.col("num_gt_dets") + F.col("num_tracker_dets") - F.col("tp")).cast("double")),
            "loca": F.greatest(F.lit(1e-10), F.col("near")) / F.greatest(F.lit(1e-10), F.col("tp").cast("double")),
        }
    ).withColumn("hota", F.sqrt(F.col("assa") * F.col("deta")))
    return rows.select("camera_id", "alpha", "tp", "hota", "deta", "assa", "loca")


def hota(truth: DataFrame, predictions: DataFrame, stride: int = STRIDE) -> DataFrame:
    """By camera: hota, deta, assa, loca, each the mean over ALPHAS, and the arrays by alpha."""
    rows, names = hota_by_alpha(truth, predictions, stride), ["hota", "deta", "assa", "loca"]
    listed = rows.groupBy("camera_id").agg(F.sort_array(F.collect_list(F.struct("alpha", *names))).alias("a"), *(F.avg(n).alias(n) for n in names))
    return listed.select("camera_id", *names, *(F.col("a")[n].alias(f"{n}_alpha") for n in names))


def metric_tables(results: dict[str, DataFrame], places: int, *columns: str) -> DataFrame:
    """The results of several methods as a table: method, camera_id, counts as they are and other columns rounded; sorted."""
    out = None
    for method, rows in results.items():
        kinds = dict(rows.dtypes)
        part = rows.select(F.lit(method).alias("method"), "camera_id", *((F.round(c, places) if kinds[c] == "double" else F.col(c)).alias(c) for c in columns))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("method", "camera_id")
