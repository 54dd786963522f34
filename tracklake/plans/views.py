"""Test inputs over the driver's tables, as SQL that Spark and DuckDB both read after two word changes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "det": """SELECT concat('cam_', CAST(user_id % 3 AS STRING)) AS camera_id, event_id DIV 400 AS frame_index,
 CAST(row_number() OVER (PARTITION BY user_id % 3, event_id DIV 400 ORDER BY event_id) - 1 AS INT) AS det_ord,
 CAST((user_id*37) % 300 AS DOUBLE) AS x1, CAST((event_id*53) % 200 AS DOUBLE) AS y1,
 CAST((user_id*37) % 300 + 60 AS DOUBLE) AS x2, CAST((event_id*53) % 200 + 120 AS DOUBLE) AS y2,
 CAST((event_id*7919) % 1000 AS DOUBLE)/1000 AS confidence, CAST(user_id % 11 AS INT) AS class_id,
 CASE WHEN user_id % 11 = 0 THEN 'Ball' WHEN user_id % 11 <= 4 THEN concat('Red_', CAST(user_id % 11 AS STRING))
      WHEN user_id % 11 <= 8 THEN concat('White_', CAST(user_id % 11 AS STRING)) ELSE concat('Refree_', CAST(user_id % 11 AS STRING)) END AS class_name
FROM events""",
    "gt": """SELECT concat('cam_', CAST(n.n_nationkey % 3 AS STRING)) AS camera_id, c.c_custkey*5 AS frame_index, c.c_custkey AS gt_pos,
 CAST(n.n_nationkey DIV 3 AS INT) AS det_ord,
 CAST(90*(n.n_nationkey DIV 3) + (c.c_custkey*3) % 200 AS DOUBLE) AS x1, CAST(100 + c.c_custkey % 50 AS DOUBLE) AS y1,
 CAST(90*(n.n_nationkey DIV 3) + (c.c_custkey*3) % 200 + 60 AS DOUBLE) AS x2, CAST(220 + c.c_custkey % 50 AS DOUBLE) AS y2,
 concat('Red_', CAST(n.n_nationkey AS STRING)) AS class_name
FROM nation n CROSS JOIN customer c""",
    "pred": """SELECT camera_id, frame_index, det_ord,
 x1 + (gt_pos*7 + det_ord*5) % 23 AS x1, y1 + (gt_pos*3) % 11 AS y1, x2 + (gt_pos*7 + det_ord*5) % 23 AS x2, y2 + (gt_pos*3) % 11 AS y2,
 CAST(det_ord + 1 + 100*((gt_pos + det_ord) DIV 40) AS BIGINT) AS track_id
FROM gt WHERE (gt_pos*5 + det_ord*3) % 13 <> 0""",
    "tracked": """SELECT camera_id, frame_index, det_ord, x1, y1, x2, y2, confidence, class_name,
 CAST((CAST(substring(camera_id, 5) AS INT)*1000) + (frame_index*7 + det_ord) % 12 AS BIGINT) AS track_id FROM det""",
    "gallery": """SELECT concat('cam_', CAST(vec_id % 3 AS STRING)) AS camera_id, vec_id DIV 60 AS frame_index, CAST(label AS BIGINT) AS track_id, vec_id, embedding
FROM embeddings WHERE vec_id % 2 = 0""",
    "det_feat": """SELECT concat('cam_', CAST(vec_id % 3 AS STRING)) AS camera_id, vec_id DIV 60 AS frame_index, vec_id, embedding
FROM embeddings WHERE vec_id % 2 = 1""",
    "raw": """SELECT camera_id, frame_index, det_ord, x1, y1, x2, y2, class_id, CAST((det_ord*7919 + frame_index*104729 + class_id*31) % 100000 AS DOUBLE)/100000 AS confidence FROM det""",
    "coco_images": """SELECT o_orderkey AS id, concat(CASE WHEN o_orderkey % 17 = 0 THEN 'foo' ELSE 'out' END, CAST(o_custkey % 3 + 2 AS STRING),
 '_frame_', lpad(CAST(o_orderkey AS STRING), 5, '0'), '_jpg.rf.x.jpg') AS file_name FROM orders""",
    "coco_categories": "SELECT n_nationkey AS id, concat('White_', CAST(n_nationkey AS STRING)) AS name FROM nation",
    "coco_annotations": """SELECT l_orderkey AS image_id, CAST(l_suppkey % 25 AS INT) AS category_id, l_quantity AS x, CAST(l_linenumber*10 AS DOUBLE) AS w,
 CAST(l_partkey % 700 AS DOUBLE) AS y, CAST(30 + l_linenumber AS DOUBLE) AS h, ((l_linenumber*CAST(1000000 AS BIGINT) + l_partkey)*100000 + l_suppkey)*100 + CAST(l_quantity AS INT) AS ord FROM lineitem""",
    "pixels": "SELECT CAST(0 AS BIGINT) AS frame_index, c_custkey % 40 AS x, c_custkey DIV 40 AS y FROM customer WHERE (c_custkey*c_custkey*31 + c_custkey*17) % 100 < 35",
}
_USES = {name: [w for w in (*VIEWS, "events", "nation", "customer", "embeddings", "orders", "lineitem") if re.search(rf"\b(FROM|JOIN) {w}\b", sql)] for name, sql in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {u: view(spark, sf_dir, u) for u in _USES[name]}
    sql = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], VIEWS[name])
    return spark.sql(sql, **used)


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views (and those they use) before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for u in _USES.get(name, []):
            add(u)
        if name in VIEWS and name not in order:
            order.append(name)

    for n in names:
        add(n)
    text = ",\n".join(f"{n} AS ({VIEWS[n].replace(' DIV ', ' // ').replace('AS STRING', 'AS VARCHAR')})" for n in order)
    if not text and not sql.lstrip().startswith((",", "RECURSIVE")):
        return sql
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("RECURSIVE") else ""
    body = sql.lstrip()[len("RECURSIVE") :] if recursive else sql
    return f"WITH {recursive}{text}{body if body.lstrip().startswith(',') else ' ' + body}"
