"""One stable label a track: confidence votes, claims by priority, one detection a label and frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import BALL


def votes(tracks: DataFrame) -> DataFrame:
    """Summed confidence, in thousandths so that sums and ties are exact, and count by
    (camera, track, label); first is where the label was first seen."""
    return tracks.groupBy("camera_id", "track_id", "class_name").agg(
        F.sum(F.round(F.col("confidence") * 1000).cast("long")).alias("milli"),
        F.count("*").alias("n"),
        F.min(F.struct("frame_index", "det_ord")).alias("first"),
    )


def ranked(voted: DataFrame) -> DataFrame:
    w = Window.partitionBy("camera_id", "track_id").orderBy(F.col("milli").desc(), "first")
    return voted.withColumn("rank", F.row_number().over(w))


def _tracks(voted: DataFrame) -> DataFrame:
    """A row a track: its labels by rank, its length, its best label's votes, where it was first seen."""
    rows = voted.groupBy("camera_id", "track_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("milli")).alias("minus"), "first", "class_name"))).alias("labels"),
        F.sum("n").alias("length"),
        F.min("first").alias("first"),
    )
    names = F.transform("labels", lambda x: x["class_name"]).alias("labels")
    return rows.select("camera_id", "track_id", names, "length", (-F.col("labels")[0]["minus"]).alias("top"), "first")


def _priority() -> list[Column]:
    """The order in which a camera's tracks claim their labels."""
    return [F.desc("top"), F.desc("length"), F.asc("first")]


def priorities(voted: DataFrame) -> DataFrame:
    """The tracks with their priority within the camera."""
    w = Window.partitionBy("camera_id").orderBy(*_priority())
    return _tracks(voted).select("camera_id", "track_id", "labels", "length", "top", F.row_number().over(w).alias("priority"))


def stable_labels(voted: DataFrame) -> DataFrame:
    """Each track, by priority, claims its best label not yet claimed; the ball is never claimed, and a track without
    a free label keeps its best one. A camera's tracks come in order, a batch at a time: only claims are held."""
    rows = _tracks(voted).repartition("camera_id").sortWithinPartitions("camera_id", *_priority())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, claimed = None, set()
        for pdf in batches:
            names = []
            for camera, found in zip(pdf.camera_id, pdf.labels, strict=True):
                if camera != now:
                    now, claimed = camera, set()
                mine = next((x for x in found if x is not None and x not in claimed), found[0])
                if mine != BALL:
                    claimed.add(mine)
                names.append(mine)
            yield pd.DataFrame({"camera_id": pdf.camera_id, "track_id": pdf.track_id, "stable_name": names})

    return rows.select("camera_id", "track_id", "labels").mapInPandas(run, "camera_id string, track_id bigint, stable_name string")


def dedupe(tracks: DataFrame) -> DataFrame:
    """The most confident detection (ties: the first) of each label and frame; all balls."""
    w = Window.partitionBy("camera_id", "frame_index", "class_name").orderBy(F.col("confidence").desc(), "det_ord")
    return tracks.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) | (F.col("class_name") == BALL)).drop("_r")


def resolve(tracks: DataFrame) -> DataFrame:
    """Tracks under their stable labels, one detection a label and frame."""
    names = stable_labels(votes(tracks))
    renamed = tracks.join(names, ["camera_id", "track_id"], "left").withColumn("class_name", F.coalesce("stable_name", "class_name")).drop("stable_name")
    return dedupe(renamed.select(*tracks.columns))


def multi_label(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("camera_id", "track_id").agg(F.count_distinct("class_name").alias("labels")).where("labels > 1")


def label_sets(tracks: DataFrame) -> DataFrame:
    """The labels of each track, sorted."""
    return tracks.groupBy("camera_id", "track_id").agg(F.array_sort(F.collect_set("class_name")).alias("labels"))


def counts(tracks: DataFrame) -> DataFrame:
    """By camera: distinct tracks and detections."""
    return tracks.groupBy("camera_id").agg(F.count_distinct("track_id").alias("tracks"), F.count("*").alias("detections"))
