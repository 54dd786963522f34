"""Annotation files: COCO and per-camera sequence JSON, read with fixed schemas."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import COCO_JSON, SEQUENCE_JSON


def camera_of(file_name: Column) -> Column:
    """out13_frame_... -> cam_13; null for other names."""
    head = F.substring_index(file_name, "_", 1)
    return F.when(head.startswith("out"), F.concat(F.lit("cam_"), F.substr(head, F.lit(4))))


def frame_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"frame_(\d+)", 1).cast("bigint")


def video_path(camera_id: Column, folder: str) -> Column:
    return F.concat(F.lit(f"{folder}/out"), F.get(F.split(camera_id, "_", 2), F.lit(1)), F.lit(".mp4"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """categories(id, name), images(id, file_name), annotations(image_id, category_id, x, y, w, h, ord)."""
    if path.rsplit("/", 1)[-1][:1] in "_.":  # Spark takes no files of such names; the document is one row either way
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(conf).open(at)
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        df = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", COCO_JSON).alias("d")).select("d.*")
    else:
        df = spark.read.schema(COCO_JSON).option("multiLine", True).json(path)
    annotations = df.select(F.posexplode("annotations").alias("ord", "a")).select("a.image_id", "a.category_id", *(F.col("a.bbox")[k].alias(n) for k, n in enumerate("xywh")), F.col("ord").cast("long").alias("ord"))
    return df.select(F.explode("categories").alias("c")).select("c.*"), df.select(F.explode("images").alias("i")).select("i.*"), annotations


def coco_to_truth(categories: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Ground truth by camera: frames numbered from a camera's first annotated one, images of
    unknown cameras dropped, boxes as corners, full confidence, no track id. A category that is not listed is an error."""
    known = images.select(F.col("id").alias("image_id"), camera_of(F.col("file_name")).alias("camera_id"), frame_of(F.col("file_name")).alias("frame")).where("camera_id IS NOT NULL")
    # A camera's first frame meets its images, not its annotations: no task gets all rows of a camera.
    first = known.join(annotations, "image_id", "left_semi").groupBy("camera_id").agg(F.min("frame").alias("first"))
    known = known.join(first, "camera_id")
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("class_name"))
    rows = annotations.join(known, "image_id").join(names, "category_id", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown category "), F.coalesce(F.col("category_id").cast("string"), F.lit("null"))))
    rows = rows.where(F.when(F.col("class_name").isNull(), unknown.cast("boolean")).otherwise(F.lit(True)))
    # Places are taken by frame_index, so that what groups by camera and frame next finds its rows where they are.
    rows = rows.withColumn("frame_index", F.col("frame") - F.col("first"))
    place = F.row_number().over(Window.partitionBy("camera_id", "frame_index").orderBy("ord")) - 1
    return rows.select(
        "camera_id", "frame_index", place.cast("int").alias("det_ord"),
        F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"),
        F.lit(1.0).alias("confidence"), F.col("category_id").alias("class_id"), "class_name", F.lit(None).cast("bigint").alias("track_id"),
    )


def with_place(rows: DataFrame) -> DataFrame:
    """Adds gt_pos: the place of a camera's frame among those that have rows. Frames are ranked, then met by their rows;
    a row without a frame has no place."""
    frame = ["camera_id", "frame_index"]
    place = (F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_index")) - 1).cast("bigint")
    places = rows.select(*frame).where("frame_index IS NOT NULL").distinct().withColumn("gt_pos", place)
    return rows.join(places, frame, "left").select(*rows.columns, "gt_pos")


def dictionary_ids(rows: DataFrame, name: str, order: list[str], base: int = 1) -> DataFrame:
    """Ids of names by first occurrence within each camera."""
    first = rows.groupBy("camera_id", name).agg(F.min(F.struct(*order)).alias("first"))
    return first.select("camera_id", name, (F.row_number().over(Window.partitionBy("camera_id").orderBy("first")) + (base - 1)).cast("bigint").alias("id"))


def nested(rows: DataFrame) -> DataFrame:
    """A row a frame, as the JSON files hold it: camera_id, frame_index, detections in order. A camera has any
    number of frames, so it is a file (write_sequences), never a row."""
    box = F.struct("x1", "y1", "x2", "y2").alias("bbox")
    frames = rows.groupBy("camera_id", "frame_index").agg(F.sort_array(F.collect_list(F.struct("det_ord", box, "confidence", "class_id", "class_name", "track_id"))).alias("d"))
    plain = F.transform("d", lambda x: F.struct(x["bbox"].alias("bbox"), x["confidence"].alias("confidence"), x["class_id"].alias("class_id"), x["class_name"].alias("class_name"), x["track_id"].alias("track_id")))
    return frames.select("camera_id", "frame_index", plain.alias("detections"))


def sequence_text(rows: DataFrame, fps: float = 25.0, source: str = "ground_truth") -> DataFrame:
    """The JSON document of each camera, a line a frame in order: camera_id, value. The first line opens it, the last closes it."""
    w = Window.partitionBy("camera_id").orderBy("frame_index")
    head = F.lit(f'{{"source":{json.dumps(source)},"fps":{json.dumps(fps)},"frames":[')
    begin = F.when(F.row_number().over(w) == 1, head).otherwise(F.lit(","))
    end = F.when(F.lead(F.lit(1)).over(w).isNull(), F.lit("]}")).otherwise(F.lit(""))
    return nested(rows).select("camera_id", "frame_index", F.concat(begin, F.to_json(F.struct("frame_index", "detections")), end).alias("value")).sortWithinPartitions("camera_id", "frame_index").select("camera_id", "value")


def write_sequences(rows: DataFrame, path: str, **options: object) -> list[str]:
    """One folder a camera, of those that have none yet: what exists is left as it is. A camera's frames stream through
    its task into one document. Returns the cameras written, sorted."""
    spark = rows.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    top, writing = fs_path(path), fs_path(path, f"_writing-{uuid.uuid4().hex}")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cameras = sorted(r["camera_id"] for r in rows.select("camera_id").distinct().collect())
    there = {f.getPath().getName() for f in fs.listStatus(top)} if fs.exists(top) else set()
    missing = [c for c in cameras if f"camera_id={c}" not in there]
    if missing:
        some = rows.where(F.col("camera_id").isin(missing))
        sequence_text(some, **options).write.partitionBy("camera_id").option("maxRecordsPerFile", 0).text(writing.toString())
        for folder in fs.listStatus(writing):
            if not folder.isDirectory():
                continue
            for file in fs.listStatus(folder.getPath()):
                name = file.getPath().getName()
                fs.rename(file.getPath(), fs_path(folder.getPath(), name.replace(".txt", ".json")))
            fs.rename(folder.getPath(), fs_path(top, folder.getPath().getName()))
        fs.delete(writing, True)
    return missing


def copy_annotations(folder: str, target: str, coco: bool = True, spark: SparkSession | None = None) -> list[str]:
    """A downloaded split of a dataset: COCO annotations become sequences, of another format the first JSON file is copied."""
    import shutil
    from pathlib import Path

    if coco:
        source = Path(folder) / "_annotations.coco.json"
        if not source.exists():
            raise FileNotFoundError(str(source))
        return write_sequences(coco_to_truth(*read_coco(spark or SparkSession.getActiveSession(), str(source))), target)
    found = sorted(Path(folder).glob("*.json"))
    if not found:
        raise FileNotFoundError(f"no JSON file in {folder}")
    Path(target).mkdir(parents=True, exist_ok=True)
    shutil.copy2(found[0], Path(target) / found[0].name)
    return [found[0].name]


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Flat ground truth with gt_pos and track ids (by first-seen class where the file has none)."""
    df = spark.read.schema(SEQUENCE_JSON).option("multiLine", True).json(path)
    frames = df.select("source", "camera_id", "fps", F.posexplode("frames").alias("gt_pos", "f"))
    rows = frames.select("source", "camera_id", "fps", F.col("gt_pos").cast("bigint").alias("gt_pos"), "f.frame_index", F.posexplode("f.detections").alias("det_ord", "d"))
    rows = rows.select("source", "camera_id", "fps", "gt_pos", "frame_index", "det_ord", "d.bbox.*", "d.confidence", "d.class_id", "d.class_name", "d.track_id")
    ids = dictionary_ids(rows, "class_name", ["gt_pos", "det_ord"])
    return rows.join(ids, ["camera_id", "class_name"], "left").withColumn("track_id", F.coalesce("track_id", "id")).drop("id")
