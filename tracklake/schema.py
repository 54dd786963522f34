"""Table schemas. det_ord is a detection's place in its frame; every order ends with it."""

BOX = "x1 double, y1 double, x2 double, y2 double"
FRAMES = "source string, camera_id string, fps double, frame_index bigint"
DETECTIONS = f"source string, camera_id string, frame_index bigint, det_ord int, {BOX}, confidence double, class_id int, class_name string"
TRACKS = f"{DETECTIONS}, track_id bigint"
FEATURES = "camera_id string, frame_index bigint, det_ord int, embedding array<float>"
SEQUENCE_JSON = (
    "source string, camera_id string, fps double, frames array<struct<frame_index:bigint, detections:array<struct<"
    "bbox:struct<x1:double,y1:double,x2:double,y2:double>, confidence:double, class_id:int, class_name:string, track_id:bigint>>>>"
)
COCO_JSON = (
    "categories array<struct<id:int,name:string>>, images array<struct<id:bigint,file_name:string>>, "
    "annotations array<struct<image_id:bigint,category_id:int,bbox:array<double>>>"
)
COORDS = ("x1", "y1", "x2", "y2")
BALL = "Ball"
EPSILON = 1e-9
