"""Boxes and tracks of faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.functions.scalars import nearest_rank

#: Least detector score and share of the frame's height; weight of the overlap and least score of a link.
LEAST_DET, LEAST_HEIGHT, OVERLAP, ACCEPT = 0.70, 0.07, 0.30, 0.25
#: What a turned and a tilted head cost (fixed values).
YAW, ROLL, TINY = 1.4, 0.8, 1e-6


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of two boxes [x, y, w, h]; 0 where the union is empty."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i] + a[i + 2], b[i] + b[i + 2]) - F.greatest(a[i], b[i]))
    both = side(0) * side(1)
    union = a[2] * a[3] + b[2] * b[3] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def clamp_centre(centre: Column, size: Column, limit: Column) -> Column:
    """A centre moved so that a box of ``size`` lies within 0..limit; the middle if it can't."""
    return F.when(size >= limit, limit / 2).otherwise(F.greatest(size / 2, F.least(limit - size / 2, centre)))


def strict_candidates(faces: Column, height: Column) -> Column:
    """Faces with a good score and size."""
    return F.filter(faces, lambda f: (f["det"] >= LEAST_DET) & (f["bbox"][3] >= LEAST_HEIGHT * height))


def main_faces(faces: Column, share: float = 0.20) -> Column:
    """Faces with at least ``share`` of the largest one's area."""
    area = lambda f: f["bbox"][2] * f["bbox"][3]
    return F.filter(faces, lambda f: area(f) >= share * F.array_max(F.transform(faces, area)))


def with_fallback(strict: Column, faces: Column, least: float = 0.40) -> tuple[Column, Column]:
    """The strict candidates, or else the largest face with a fair score; and whether it is that loose one."""
    fair = F.filter(faces, lambda f: f["det"] >= least)
    order = lambda x, y: F.when(x["bbox"][2] * x["bbox"][3] > y["bbox"][2] * y["bbox"][3], -1).when(x["bbox"][2] * x["bbox"][3] < y["bbox"][2] * y["bbox"][3], 1).otherwise(0)
    loose = F.slice(F.array_sort(fair, order), 1, 1)
    empty = F.size(strict) == 0
    return F.when(empty, loose).otherwise(strict), empty & (F.size(fair) > 0)


def face_score(w: Column, h: Column, cx: Column, cy: Column, frontal: Column, conf: Column) -> Column:
    """Size, closeness to the middle and frontality of a face whose box is given as shares of the frame."""
    centre = 1 - F.hypot(cx - 0.5, cy - 0.5) / 0.707
    return (0.55 * F.sqrt(w * h) * 3 + 0.15 * centre + 0.30 * frontal) * conf


def frontality(right_eye: Column, left_eye: Column, nose: Column) -> Column:
    """How straight a face looks at the camera, by its landmarks [x, y]: the nose's way off the middle of the eyes and the slope
    between the eyes, in eye distances, count against it; 0 at least."""
    across, down = left_eye[0] - right_eye[0], left_eye[1] - right_eye[1]
    apart = F.hypot(across, down) + TINY
    yaw, roll = F.abs(nose[0] - (right_eye[0] + left_eye[0]) / 2) / apart, F.abs(down) / apart
    return F.greatest(F.lit(0.0), 1 - yaw * YAW - roll * ROLL)


def stable_size(boxes: DataFrame, key: str, margin: float = 0.20, part: float = 0.90) -> DataFrame:
    """key, side, static: the nearest-rank 90th percentile of the larger sides with a margin on both ends; static if the
    centres move less than a tenth of it. ``boxes``: key, x, y, w, h."""
    rows = boxes.groupBy(key).agg(F.collect_list(F.greatest("w", "h")).alias("s_"), *(F.max(F.expr(e)) .alias(n) for e, n in (("x + w / 2", "x1"), ("y + h / 2", "y1"))), *(F.min(F.expr(e)).alias(n) for e, n in (("x + w / 2", "x0"), ("y + h / 2", "y0"))))
    side = nearest_rank(F.col("s_"), part) * (1 + 2 * margin)
    return rows.withColumn("side", side).select(key, "side", (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < 0.1 * F.col("side")).alias("static"))


def track_quality(frames: DataFrame, key: str) -> DataFrame:
    """key, det_rate, mean_sim, anchors, visible_ratio, status. ``frames``: key, detected, sim, visible."""
    anchors = F.count_if(F.coalesce(F.col("sim") >= 0.363, F.lit(False)))
    rows = frames.groupBy(key).agg(F.avg(F.col("detected").cast("double")).alias("det_rate"), F.avg("sim").alias("mean_sim"), anchors.alias("anchors"), F.avg(F.col("visible").cast("double")).alias("visible_ratio"))
    status = F.when((F.col("anchors") < 5) | (F.col("visible_ratio") < 0.30), "drop").when(F.col("visible_ratio") < 0.50, "low_confidence").otherwise("ok")
    return rows.withColumn("status", status)


def aligned_frames(video: Column, both: Column, audio_s: Column, fps: Column) -> Column:
    """Frames that all tracks of a clip have."""
    return F.least(video, both, F.floor(audio_s * fps + 1e-9))
