"""Relational operators on detections: filters, unions, suppression, frame choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import iou, units
from ..schema import COORDS

FRAME = ("camera_id", "frame_index")


def with_confidence(df: DataFrame, least: float = 0.3) -> DataFrame:
    return df.where(F.col("confidence") >= least)


def with_classes(df: DataFrame, class_ids: list[int] | None = None) -> DataFrame:
    return df if class_ids is None else df.where(F.col("class_id").isin(class_ids))


def after_warmup(df: DataFrame, frames: int = 10) -> DataFrame:
    """Detections of the first frames go; the frames themselves stay in the frames table."""
    return df.where(F.col("frame_index") >= frames)


def first_frames(df: DataFrame, limit: int | None = None) -> DataFrame:
    """None or a negative limit: all."""
    return df if limit is None or limit < 0 else df.where(F.col("frame_index") < limit)


def merge_detections(first: DataFrame, *rest: DataFrame, frames: list[DataFrame] | None = None) -> DataFrame:
    """Per frame, the detections of all inputs in argument order. With the inputs' frames
    tables given, all must have the same (source, camera_id, frame_index) rows."""
    if frames:
        keys = ["source", "camera_id", "frame_index"]
        for other in frames[1:]:
            a, b = frames[0].select(*keys), other.select(*keys)
            if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
                raise ValueError("the inputs' sources, cameras or frames differ")
    parts = [d.withColumn("_input", F.lit(k)) for k, d in enumerate((first, *rest))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.row_number().over(Window.partitionBy(*FRAME).orderBy("_input", "det_ord")) - 1
    return out.withColumn("det_ord", place.cast("int")).drop("_input")


def nms(df: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = FRAME) -> DataFrame:
    """Greedy suppression: from the most confident down (ties: det_ord), a box stays unless it
    overlaps one that stayed by the threshold or more. One shuffle by frame, no Python; with
    class_name among the keys it works per class."""
    others = [c for c in df.columns if c not in by]
    row = F.struct((-F.col("confidence")).alias("_minus"), "det_ord", *(c for c in others if c != "det_ord"))
    boxes = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_boxes"))
    side = lambda b: [b[c] for c in COORDS]
    empty = F.slice(F.col("_boxes"), 1, 0)
    kept = F.aggregate(
        "_boxes",
        empty,
        lambda acc, b: F.when(F.exists(acc, lambda k: iou(side(k), side(b)) >= threshold), acc).otherwise(F.concat(acc, F.array(b))),
    )
    return boxes.select(*by, F.explode(kept).alias("_b")).select(*(F.col(c) if c in by else F.col(f"_b.{c}").alias(c) for c in df.columns))


def _placed(frames: DataFrame) -> DataFrame:
    """A camera's frames with their position and how many there are."""
    w = Window.partitionBy("camera_id").orderBy("frame_index")
    rows = frames.select("camera_id", "frame_index").distinct()
    sizes = rows.groupBy("camera_id").agg(F.count("*").alias("_len"))
    return rows.withColumn("_pos", F.row_number().over(w) - 1).join(sizes, "camera_id")


def evenly_spaced(frames: DataFrame, n: int) -> DataFrame:
    """n frames a camera, from its first to its last, evenly spaced by position."""
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.expr("0") if n == 1 else F.floor(i * (F.col("_len") - 1) / (n - 1)).cast("int")))
    return _placed(frames).where(F.array_contains(picks, F.col("_pos"))).select("camera_id", "frame_index")


def choose_frames(frames: DataFrame, n: int | None = None, indexes: list[int] | None = None) -> DataFrame:
    """camera_id, place, frame_index: the positions given, as often and in the order they are given, else n
    evenly spaced ones, else the first, middle and last one."""
    if indexes is None and n is not None:
        rows = evenly_spaced(frames, n)
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_index")) - 1).select("camera_id", "place", "frame_index")
    at = F.array(*map(F.lit, indexes)) if indexes else F.array(F.lit(0), F.floor(F.col("_len") / 2).cast("int"), (F.col("_len") - 1).cast("int"))
    rows = _placed(frames).select("camera_id", "frame_index", "_pos", F.posexplode(at).alias("place", "_at"))
    return rows.where(F.col("_pos") == F.col("_at")).select("camera_id", "place", "frame_index")


def first_of_frame(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n detections of each frame, as they are listed."""
    w = Window.partitionBy(*FRAME).orderBy("det_ord")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def zip_frames(left: DataFrame, right: DataFrame) -> DataFrame:
    """camera_id, place, left_frame, right_frame: the frames of two tables paired by their position, as far as both go."""
    a, b = (_placed(df).select("camera_id", F.col("_pos").alias("place"), F.col("frame_index").alias(name)) for df, name in ((left, "left_frame"), (right, "right_frame")))
    return a.join(b, ["camera_id", "place"])


RAW_BOX = "struct<x1: double, y1: double, x2: double, y2: double, confidence: double, class_id: int>"


def from_detector(raw: DataFrame, names: dict[int, str], source: str = "yolo") -> DataFrame:
    """Detections from raw(camera_id, frame_index, boxes array of RAW_BOX): a row a box, in the detector's order, with its
    class's name and a confidence of three decimals. A class without a name is an error."""
    labels = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    rows = raw.select("camera_id", "frame_index", F.posexplode("boxes").alias("det_ord", "b"))
    name = F.try_element_at(labels, F.col("b.class_id"))
    return rows.select(
        F.lit(source).alias("source"), "camera_id", "frame_index", "det_ord", *(F.col(f"b.{c}").alias(c) for c in COORDS),
        (units(F.col("b.confidence"), 3) / 1000).alias("confidence"), F.col("b.class_id").alias("class_id"),
        F.coalesce(name, F.raise_error(F.concat(F.lit("no name for class "), F.col("b.class_id").cast("string")))).alias("class_name"),
    )


def player_classes(names: dict[int, str], ball: int = 0) -> list[int]:
    """All classes but the ball's."""
    return sorted(k for k in names if k != ball)


def channel_histograms(df: DataFrame, channels: dict[str, Column], bins: int = 256) -> DataFrame:
    """channel, bin, n of several values of a row, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.floor(v).cast("int").alias("bin")) for c, v in channels.items())))
    return df.select(each.alias("x")).select("x.*").where(F.col("bin").between(0, bins - 1)).groupBy("channel", "bin").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, bins: int = 256) -> DataFrame:
    return df.select(F.floor(value).cast("int").alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count("*").alias("n"))
