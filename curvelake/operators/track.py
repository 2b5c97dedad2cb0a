"""The track of one face through a clip: linking, a crop box that stands still or pans slowly, presence and status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from curvelake import scratch
from curvelake.functions.scalars import rounded
from curvelake.operators import geometry, islands

#: Margin on both sides of the face, part of the sizes that the box holds, weight of the newest centre, and the share of the box's
#: side within which centres count as standing still.
MARGIN, SIZE_PART, EMA, STILL = 0.20, 0.90, 0.15, 0.10
#: Seconds of a loss that is bridged, of a presence that counts, and of the median's window.
HOLD_S, VISIBLE_S, MEDIAN_S = 0.40, 0.20, 0.8
#: Similarity and number of anchors; visible shares below which a clip is dropped or of low confidence.
ANCHOR, ANCHORS, LEAST, LOW = 0.363, 5, 0.30, 0.50
#: One unit of the median's range order; halves of windows divide it nearly, see ``centred_median``.
REACH = 1_000_000_000
FACE = "x double, y double, w double, h double, sim double, sim_ref double"


@F.pandas_udf(StringType())
def two_digits(x: pd.Series) -> pd.Series:
    """A share with two digits: the nearest to the number as it is stored, of two as near the even one (0.125 and 0.285 become 0.12 and 0.28)."""
    return x.map("{:.2f}".format, na_action="ignore")


def overlap(a: tuple, b: tuple) -> float:
    wide = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    high = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - wide * high
    return wide * high / union if union > 0 else 0.0


def link(frames: DataFrame, key: str) -> DataFrame:
    """key, frame_i, pick, and the picked face (nulls: none): in each frame the face with the largest similarity plus
    OVERLAP times its overlap with the last accepted box, the first of equals; accepted if its similarity by itself is ACCEPT or
    more. ``frames``: key, frame_i, faces (array of bbox, sim and, if it has one, sim_ref).

    Each choice feeds the next, so a task goes through its clips frame by frame; it holds one box, and emits each frame as it comes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    has_ref = "sim_ref" in frames.schema["faces"].dataType.elementType.fieldNames()
    split = lambda of: F.transform("faces", of)
    ref = (lambda f: F.coalesce(f["sim_ref"], f["sim"])) if has_ref else (lambda f: f["sim"])
    flat = frames.select(key, "frame_i", F.flatten(split(lambda f: F.array(*(f["bbox"][i].cast("double") for i in range(4)), f["sim"].cast("double"), ref(f).cast("double")))).alias("flat"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, box = None, None
        for b in batches:
            made = []
            for k, flat in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != last:
                    last, box = k, None
                best = None
                for i in range(0, len(flat or ()), 6):
                    score = flat[i + 4] + (geometry.OVERLAP * overlap(flat[i : i + 4], box) if box else 0.0)
                    if best is None or score > best[0]:
                        best = (score, i)
                if best is None or flat[best[1] + 4] < geometry.ACCEPT:
                    made.append((-1, *[None] * 6))
                else:
                    own = flat[best[1] : best[1] + 6]
                    box = own[:4]
                    made.append((best[1] // 6, *own))
            cols = list(zip(*made, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[1:])], [key, "frame_i", "pick", "x", "y", "w", "h", "sim", "sim_ref"])

    return flat.repartition(key).sortWithinPartitions(key, "frame_i").mapInArrow(run, f"{key} {kinds[key]}, frame_i {kinds['frame_i']}, pick int, {FACE}")


def centred_median(rows: DataFrame, key: str, order: str, columns: list[str], half: str) -> DataFrame:
    """``columns`` become their medians over ``half`` rows on either side; ``half`` may differ from clip to clip (up to thousands): rows are
    laid REACH // half apart, so that a range of REACH spans just that many."""
    at = (F.col(order) * F.floor(F.lit(REACH) / F.col(half))).cast("long")
    w = Window.partitionBy(key).orderBy("at_").rangeBetween(-REACH, REACH)
    return rows.withColumn("at_", at).withColumns({c: F.percentile(c, 0.5).over(w) for c in columns}).drop("at_")


def box_size(linked: DataFrame, key: str, margin: float = MARGIN, part: float = SIZE_PART) -> DataFrame:
    """key, side: the nearest-rank percentile of the larger sides with a margin on both ends, at most the frame's smaller side.
    ``linked``: key, w, h, frame_w, frame_h."""
    size = F.greatest("w", "h")
    found = linked.where("w is not null").select(key, size.alias("size"), F.least("frame_w", "frame_h").cast("double").alias("most"))
    w = Window.partitionBy(key)
    rank = F.row_number().over(w.orderBy("size")) - 1
    n = F.count("*").over(w)
    ranked = found.withColumns({"rank": rank, "want": F.least(n - 1, F.bround((n - 1) * F.lit(part), 0).cast("long"))})
    return ranked.where("rank = want").select(key, F.least(F.col("size") * (1 + 2 * margin), F.col("most")).alias("side"))


def stable_box(linked: DataFrame, key: str, margin: float = MARGIN) -> DataFrame:
    """``linked`` with place, side, mode and the centre cx, cy of each frame's box, which never leaves the frame; for clips in which
    a face was found at all. Centres between faces are interpolated and held at both ends, rolling medians take out
    single jumps; if what is left moves less than STILL of the side, the box stands at the clip's median, else it follows
    slowly. ``linked``: key, frame_i, x, y, w, h, fps, frame_w, frame_h.
    """
    whole, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("frame_i")
    rows = linked.join(box_size(linked, key, margin), key)
    rows = rows.withColumns({"place": F.row_number().over(order) - 1, "cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    past, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("cx").isNotNull(), F.struct("place", "cx", "cy"))
    rows = rows.withColumns({"a_": F.last(known, True).over(past), "b_": F.first(known, True).over(ahead)})
    share = (F.col("place") - F.col("a_.place")) / (F.col("b_.place") - F.col("a_.place"))

    def between(c: str) -> Column:
        a, b = F.col(f"a_.{c}"), F.col(f"b_.{c}")
        return F.when(F.col(c).isNotNull(), F.col(c)).when(F.col("a_").isNull(), b).when(F.col("b_").isNull(), a).otherwise(a * (1 - share) + b * share)

    half = F.floor(F.greatest(F.lit(3), F.bround(F.col("fps") * MEDIAN_S, 0).cast("int").bitwiseOR(F.lit(1))) / 2)
    rows = rows.withColumns({"cx": between("cx"), "cy": between("cy"), "half_": half}).drop("a_", "b_")
    rows = centred_median(rows, key, "place", ["cx", "cy"], "half_").drop("half_")
    span = F.greatest(*(F.max(c).over(whole) - F.min(c).over(whole) for c in ("cx", "cy")))
    rows = rows.withColumn("mode", F.when(span < F.col("side") * STILL, "static").otherwise("slow"))
    for c, limit in (("cx", "frame_w"), ("cy", "frame_h")):
        rows = rows.withColumn("still_", F.percentile(c, 0.5).over(whole))
        rows = islands.exponential(rows.withColumn("place_", F.col("place")).drop("place"), key, "place_", c, EMA).drop("place").withColumnRenamed("place_", "place")
        rows = rows.withColumn(c, geometry.clamp_centre(F.when(F.col("mode") == "static", F.col("still_")).otherwise(F.col("ema")), F.col("side"), F.col(limit).cast("double"))).drop("still_", "ema")
    return rows


def presence(rows: DataFrame, key: str, order: str, present: str, fps: str) -> DataFrame:
    """``visible``: presence without flicker. Losses inside of at most HOLD_S are bridged, then what is seen for less than VISIBLE_S goes."""
    frames = lambda s: F.greatest(F.lit(1), F.bround(F.col(fps) * s, 0).cast("int"))
    return islands.close_open(rows, key, order, present, frames(HOLD_S), frames(VISIBLE_S)).withColumnRenamed("smooth", "visible")


def build(frames: DataFrame, clips: DataFrame, key: str, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """The crop's frames (key, frame_i, place, cx, cy, present, visible, bbox) and a summary of each clip (key, mode, side, its
    statistics, status, reasons). A clip without any face has no frames and no crop. ``frames``: key, frame_i, faces (bbox, det, sim and, if
    it has one, sim_ref), one row for every frame; ``clips``: key, fps, frame_w, frame_h."""
    named = clips.select(key, F.col("fps").cast("double").alias("fps"), "frame_w", "frame_h")
    good = frames.join(named.select(key, "frame_h"), key).select(key, "frame_i", geometry.strict_candidates(F.col("faces"), F.col("frame_h")).alias("faces"))
    linked = link(good, key).join(named, key).withColumn("present", F.col("pick") >= 0)
    seen = scratch.materialize(presence(linked, key, "frame_i", "present", "fps"), "linked")
    boxed = scratch.materialize(stable_box(seen, key, margin), "boxed")
    r = lambda c, n: rounded(F.col(c) if isinstance(c, str) else c, n)
    box = F.when(F.col("present"), F.array(*(r(c, 1) for c in "xywh")))
    crop = boxed.select(key, "frame_i", "place", r("cx", 2).alias("cx"), r("cy", 2).alias("cy"), "present", "visible", box.alias("bbox"))

    w = Window.partitionBy(key).orderBy("frame_i")
    dark = ~F.col("visible") & F.coalesce(F.lag("visible").over(w), F.lit(True))
    lost = islands.runs(seen, key, "frame_i", "present").groupBy(key).agg(F.coalesce(F.max(F.when(~F.col("present"), F.col("n"))), F.lit(0)).alias("max_gap_frames"))
    inside = boxed.where("present").groupBy(key).agg(
        F.first("mode").alias("mode"), F.first("side").alias("side"),
        F.avg(((F.col("x") >= F.col("cx") - F.col("side") / 2) & (F.col("y") >= F.col("cy") - F.col("side") / 2) & (F.col("x") + F.col("w") <= F.col("cx") + F.col("side") / 2) & (F.col("y") + F.col("h") <= F.col("cy") + F.col("side") / 2)).cast("double")).alias("inside"),
    )
    stats = seen.withColumn("dark_", dark).groupBy(key).agg(
        F.count("*").alias("frames"), F.count_if("present").alias("detected"), F.coalesce(F.avg("sim"), F.lit(0.0)).alias("mean_sim"), F.count_if(F.col("sim_ref") >= ANCHOR).alias("anchors"),
        F.coalesce(F.avg(F.col("h")) / F.first("frame_h"), F.lit(0.0)).alias("height"), F.count_if("visible").alias("shown"), F.count_if("dark_").alias("flicker_cuts"), F.first("fps").alias("fps"),
    )
    rows = stats.join(lost, key).join(inside, key, "left")
    found, det, shown = F.col("detected") > 0, F.col("detected") / F.col("frames"), F.col("shown") / F.col("frames")
    share = F.when(found, shown).otherwise(det)
    rows = rows.withColumn("two_", two_digits(share))
    word = F.when(found, "visible").otherwise("det_rate")
    few = F.when(F.col("anchors") < ANCHORS, F.format_string(f"anchors=%d<{ANCHORS}", "anchors"))
    low = F.when(share < LEAST, F.concat(word, F.lit("="), "two_", F.lit(f"<{LEAST}")))
    bad = F.array_compact(F.when(found, F.array(few, low)).otherwise(F.array(low, few)))
    unsure = (F.size(bad) == 0) & (share < LOW)
    reasons = F.when(unsure, F.array(F.concat(word, F.lit("="), "two_", F.lit(f"<{LOW}")))).otherwise(bad)
    status = F.when(F.size(bad) > 0, "drop").when(unsure, "low_confidence").otherwise("ok")
    summary = rows.select(
        key, "mode", r("side", 2).alias("side"), "detected", r(det, 4).alias("det_rate"), "max_gap_frames", r(F.col("max_gap_frames") / F.col("fps"), 3).alias("max_gap_seconds"), r("mean_sim", 4).alias("mean_sim"), "anchors",
        r("height", 4).alias("mean_face_h_ratio"), r("inside", 4).alias("face_inside_ratio"), F.when(found, r(shown, 4)).alias("visible_ratio"), F.when(found, r(1 - shown, 4)).alias("black_ratio"),
        F.when(found, F.col("flicker_cuts")).alias("flicker_cuts"), status.alias("status"), reasons.alias("reasons"),
    )
    return crop, summary
