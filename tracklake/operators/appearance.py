"""Galleries of embeddings against detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import cosine_distance


def rolling_gallery(features: DataFrame, budget: int = 100) -> DataFrame:
    """The last `budget` embeddings of each track: features(track_id, ord, embedding)."""
    w = Window.partitionBy("track_id").orderBy(F.col("ord").desc())
    return features.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= budget).drop("_r")


def appearance_cost(gallery: DataFrame, queries: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Least cosine distance of each track's gallery to each detection of its frame: gallery(camera_id, frame_index,
    track_id, embedding) as it is at that frame, queries(camera_id, frame_index, query_id, embedding). An equi-join by
    frame. With tracks(camera_id, frame_index, track_id), those without a gallery are as far as can be (1)."""
    frame = ["camera_id", "frame_index"]
    pairs = gallery.select(*frame, "track_id", F.col("embedding").alias("_g")).join(queries.select(*frame, "query_id", F.col("embedding").alias("_q")), frame)
    near = pairs.groupBy(*frame, "track_id", "query_id").agg(F.min(cosine_distance(F.col("_g"), F.col("_q"))).alias("distance"))
    if tracks is None:
        return near
    grid = tracks.select(*frame, "track_id").distinct().join(queries.select(*frame, "query_id"), frame)
    return grid.join(near, [*frame, "track_id", "query_id"], "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))
