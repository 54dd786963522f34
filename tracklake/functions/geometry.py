"""Boxes and captions as column expressions: all of it runs in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COORDS, EPSILON

#: Team colours (blue, green, red) by the head of a class name, and the colour of any other.
TEAM_COLORS = {"ball": (0, 255, 255), "red": (0, 0, 255), "white": (255, 255, 255), "referee": (0, 165, 255)}
OTHER_COLOR = (128, 128, 128)


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in COORDS]


def iou(a: list[Column], b: list[Column], epsilon: float = EPSILON) -> Column:
    """Intersection over union; epsilon keeps empty boxes from dividing by zero."""
    zero = F.lit(0.0)
    width = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = width * height
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.try_divide(both, union + F.lit(epsilon))


def xywh() -> list[Column]:
    x1, y1, x2, y2 = box()
    return [x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")]


def xyah() -> list[Column]:
    x1, y1, x2, y2 = box()
    w, h = x2 - x1, y2 - y1
    return [(x1 + w / 2).alias("cx"), (y1 + h / 2).alias("cy"), (w / F.greatest(h, F.lit(1e-6))).alias("a"), h.alias("h")]


def from_xyah(cx: Column, cy: Column, a: Column, h: Column) -> list[Column]:
    w = a * h
    return [c.alias(n) for c, n in zip((cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2), COORDS, strict=True)]


def int_box() -> list[Column]:
    return [F.col(c).cast("int").alias(c) for c in COORDS]


def crop_box(width: int, height: int) -> list[Column]:
    """Pixel bounds of a box within an image; empty where the box is outside."""
    x1, y1, x2, y2 = box()
    low = lambda v: F.greatest(F.lit(0), F.floor(v).cast("int"))
    high = lambda v, most: F.least(F.lit(most), F.ceil(v).cast("int"))
    return [low(x1).alias("left"), low(y1).alias("top"), high(x2, width).alias("right"), high(y2, height).alias("bottom")]


def team_head(name: Column) -> Column:
    head = F.lower(F.substring_index(name, "_", 1))
    return F.when(head.isin("refree", "referee"), F.lit("referee")).when(head.isin("ball", "red", "white"), head)


def jersey(name: Column) -> Column:
    """The number a class name carries; none for the ball, the whole name for unknown teams."""
    head, tail = team_head(name), F.when(F.instr(name, "_") > 0, F.substr(name, F.instr(name, "_") + 1)).otherwise(F.lit(""))
    return F.when(head.isNull(), name).when(head == "ball", F.lit("")).otherwise(tail)


def team_color(name: Column) -> Column:
    out = F.array(*(F.lit(v) for v in OTHER_COLOR))
    for head, color in TEAM_COLORS.items():
        out = F.when(team_head(name) == head, F.array(*(F.lit(v) for v in color))).otherwise(out)
    return out


def text_color(color: Column) -> Column:
    """Black on light, white on dark, by BT.601 luminance."""
    luminance = color[2] * 0.299 + color[1] * 0.587 + color[0] * 0.114
    return F.when(luminance > 128, F.lit("black")).otherwise(F.lit("white"))


def units(value: Column, places: int) -> Column:
    """How many units of the last of `places` decimals a value from 0 up is, rounded by its exact binary value: where
    one decimal more is a 5, the exact error of that product (by splitting the factor) decides, and a true half goes to even."""
    scale = float(10 ** (places + 1))
    fine = F.round(value * scale).cast("long")
    split = value * 134217729.0
    high = split - (split - value)
    over = (high * scale - fine.cast("double")) + (value - high) * scale
    coarse = F.floor(fine / 10)
    up = (over > 0) | ((over == 0) & (coarse % 2 == 1))
    return F.when(fine % 10 == 5, coarse + up.cast("long")).otherwise(F.floor((fine + 5) / 10))


def two_places(value: Column) -> Column:
    """A value from 0 up with two decimals."""
    cents = units(value, 2)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def caption(name: Column, track_id: Column, confidence: Column) -> Column:
    number = jersey(name)
    tag = F.coalesce(F.concat(F.lit(" #"), track_id.cast("string")), F.lit(""))
    return F.concat(F.when(number == "", name).otherwise(number), tag, F.lit(" "), two_places(confidence))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return F.lit(1.0) - dot(a, b)


def l2_normalize(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)
