"""Choosing the frame and face that show a speaker, and checks of what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.functions.scalars import unit

#: Faces below this height can't be told in company; scores under which a pick is reviewed, with others in
#: the picture and alone; spread of the tracks' lengths; shares of visible frames.
TINY_PX, LOW, LOW_ALONE, SPREAD_S, LEAST_VISIBLE, LOW_VISIBLE = 50, 0.35, 0.15, 0.030, 0.30, 0.50


def quality(score: Column, sharp: Column, sharpest: Column) -> Column:
    return score * (0.7 + 0.3 * F.least(F.lit(1.0), sharp / F.when(sharpest > 0, sharpest).otherwise(1.0)))


def best_frame(faces: DataFrame, key: str) -> DataFrame:
    """key, frame_i, face, confidence (4 digits, 1 at most), status: the best face of a frame that has only this main one;
    where there is no such frame, the best of all at 0.8 of its score. ``faces``: key, frame_i, face, score, sharp, main."""
    w = Window.partitionBy(key)
    n = F.count_if("main").over(Window.partitionBy(key, "frame_i"))
    alone = F.col("alone_")
    rows = faces.withColumns({"n_": n, "s_": F.max("sharp").over(w)}).withColumn("alone_", F.col("main") & (F.col("n_") == 1)).withColumn("q_", F.when(alone, quality(F.col("score"), F.col("sharp"), F.col("s_"))).otherwise(F.col("score") * 0.8))
    best = rows.groupBy(key).agg(F.max_by(F.struct("frame_i", "face", "q_"), F.struct(alone, "q_", -F.col("frame_i"), -F.col("face"))).alias("b"), F.max("n_").alias("most"))
    floor = F.when(F.col("most") <= 1, LOW_ALONE).otherwise(LOW)
    return best.select(key, "b.frame_i", "b.face", F.round(F.least(F.lit(1.0), F.col("b.q_")), 4).alias("confidence"), F.when(F.col("b.q_") >= floor, "ok").otherwise("needs_review").alias("status"))


def bucket(counts: DataFrame, key: str) -> DataFrame:
    """key, bucket: single, multi or none by the median number of main faces (halves cut off). ``counts``: key, n."""
    rows = counts.groupBy(key).agg(F.floor(F.percentile("n", 0.5)).alias("m"), F.max("n").alias("most"))
    return rows.select(key, F.when((F.col("m") == 0) & (F.col("most") == 0), "none").when(F.col("m") <= 1, "single").otherwise("multi").alias("bucket"))


def apply_picks(manifest: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """key, status, method, reason: a person's verdict (pick, discard, no_speaker, skip) on the manifest's rows; tiny faces
    in company go by rule unless they were picked. ``manifest``: key, status, method, height, most; ``picks``: key, action."""
    rows = manifest.join(picks, key, "left")
    act = F.coalesce("action", F.lit(""))
    tiny = F.coalesce((F.col("height") < TINY_PX) & (F.col("most") > 1), F.lit(False)) & (act != "pick")
    status = F.when(act == "pick", "ok").when((act == "discard") | tiny, "discarded").when(act == "no_speaker", "needs_review").otherwise(F.col("status"))
    reason = F.when(act == "discard", "human_discard").when(tiny, "tiny_face_multi_person")
    return rows.select(key, status.alias("status"), F.when(act == "pick", "human").otherwise(F.col("method")).alias("method"), reason.alias("reason"))


def refine(faces: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """key, frame_i, face: the chosen one, or the best better face of another frame that is the same person's by place
    (centre moved by half a box at most) and size (area ratio between 0.6 and 1.7). Both: key, frame_i, face, x, y, w, h,
    score, sharp."""
    sharpest = F.max("sharp").over(Window.partitionBy(key))
    rows = faces.withColumn("q", quality(F.col("score"), F.col("sharp"), sharpest))
    own = chosen.select(key, F.col("frame_i").alias("i0"), F.col("face").alias("f0"), *(F.col(c).alias(c + "0") for c in ("x", "y", "w", "h")), F.col("score").alias("q0"))
    both = rows.join(own, key)
    near = (F.abs(F.expr("x + w / 2 - x0 - w0 / 2")) <= 0.5 * F.col("w0")) & (F.abs(F.expr("y + h / 2 - y0 - h0 / 2")) <= 0.5 * F.col("h0"))
    ratio = F.expr("w * h / (w0 * h0)")
    better = both.where((F.col("frame_i") != F.col("i0")) & near & (ratio > 0.6) & (ratio < 1.7) & (F.col("q") > F.col("q0")))
    best = better.groupBy(key).agg(F.max_by(F.struct("frame_i", "face"), F.struct("q", -F.col("frame_i"), -F.col("face"))).alias("b"))
    out = chosen.join(best, key, "left")
    return out.select(key, F.coalesce("b.frame_i", "frame_i").alias("frame_i"), F.coalesce("b.face", "face").alias("face"))


def strided(n: Column, fps: Column, seconds: float = 0.25, most: int = 60) -> Column:
    """Every frame ``seconds`` apart, ``most`` at most."""
    step = F.greatest(F.lit(1), F.bround(fps * seconds, 0).cast("int"))
    return F.when(n > 0, F.slice(F.sequence(F.lit(0), n - 1, step), 1, most)).otherwise(F.array().cast("array<int>"))


def recognised(answers: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """key, place, status: frames are asked in order until one is recognised; sure answers are ok, others to be reviewed;
    with none, the best-scored frame is to be reviewed. ``answers``: key, place, found, confidence, score."""
    first = F.min_by(F.struct("place", "confidence"), F.when(F.col("found"), F.col("place")))
    rows = answers.groupBy(key).agg(F.bool_or("found").alias("any_"), first.alias("f"), F.max_by("place", F.struct("score", -F.col("place"))).alias("best"))
    return rows.select(key, F.when(F.col("any_"), F.col("f.place")).otherwise(F.col("best")).alias("place"), F.when(F.col("any_") & (F.col("f.confidence") >= least), "ok").otherwise("needs_review").alias("status"))


def second_opinion(answer: Column) -> Column:
    """verdict, confidence (4 digits), reason of a checker's answer as JSON; what can't be read is an error."""
    read = F.from_json(answer, "verdict string, confidence double, reason string")
    return F.struct(F.coalesce(read["verdict"], F.lit("error")).alias("verdict"), F.round(F.coalesce(read["confidence"], F.lit(0.0)), 4).alias("confidence"), F.left(F.coalesce(read["reason"], F.lit("")), F.lit(160)).alias("reason"))


def requeue(manifest: DataFrame, rejected: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The manifest without the rejected rows, and those as rejected, for the archive."""
    ids = rejected.select(key).distinct()
    return manifest.join(ids, key, "left_anti"), manifest.join(ids, key, "left_semi").withColumn("status", F.lit("rejected"))


def mean_template(vectors: DataFrame, key: str) -> DataFrame:
    """key, template: the unit mean of several picked boxes' vectors. ``vectors``: key, v."""
    cells = vectors.select(key, F.posexplode("v").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    mean = cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("m"))
    return mean.select(key, unit(F.col("m")).alias("template"))


def missing_files(samples: DataFrame, required: list[str], present: DataFrame) -> DataFrame:
    """sample_id, file of what a publication lacks. ``present``: sample_id, file."""
    return samples.select("sample_id", F.explode(F.array(*map(F.lit, required))).alias("file")).join(present, ["sample_id", "file"], "left_anti")


def media_check(tracks: DataFrame, excluded: DataFrame, built: DataFrame, files: DataFrame, required: list[str]) -> DataFrame:
    """sample_id, verdict: dropped, excluded, missing, incomplete, uneven or ok. ``tracks``: sample_id, status; ``built``:
    sample_id, spread; ``files``: sample_id, file."""
    have = files.where(F.col("file").isin(required)).groupBy("sample_id").agg(F.count_distinct("file").alias("n_"))
    rows = tracks.join(excluded.select("sample_id", F.lit(True).alias("x_")), "sample_id", "left").join(built, "sample_id", "left").join(have, "sample_id", "left")
    verdict = (
        F.when(F.col("status") == "drop", "dropped").when(F.col("x_"), "excluded").when(F.col("spread").isNull(), "missing")
        .when(F.coalesce("n_", F.lit(0)) < len(required), "incomplete").when(F.col("spread") > SPREAD_S, "uneven").otherwise("ok")
    )
    return rows.select("sample_id", verdict.alias("verdict"))


def coverage(boxes: DataFrame, key: str) -> DataFrame:
    """key, inside (4 digits): share of the frames with a face that lies wholly in the crop. ``boxes``: key, x, y, w, h (null
    without a face), cx, cy, side."""
    half = F.col("side") / 2
    inside = (F.col("x") >= F.col("cx") - half) & (F.col("y") >= F.col("cy") - half) & (F.col("x") + F.col("w") <= F.col("cx") + half) & (F.col("y") + F.col("h") <= F.col("cy") + half)
    return boxes.groupBy(key).agg(F.round(F.coalesce(F.avg(F.when(F.col("x").isNotNull() & (F.col("side") > 0), inside.cast("int"))), F.lit(0.0)), 4).alias("inside"))


def build_status(frames: DataFrame, key: str) -> DataFrame:
    """key, visible_ratio, black_ratio, flicker_cuts, status: dropped without five anchors or with too few visible frames.
    ``frames``: key, frame_i, visible, anchor."""
    w = Window.partitionBy(key).orderBy("frame_i")
    dark = ~F.col("visible") & F.coalesce(F.lag("visible").over(w), F.lit(True))
    rows = frames.withColumn("dark_", dark).groupBy(key).agg(F.avg(F.col("visible").cast("int")).alias("v"), F.count_if("dark_").alias("flicker_cuts"), F.count_if("anchor").alias("a"))
    status = F.when((F.col("a") < 5) | (F.col("v") < LEAST_VISIBLE), "drop").when(F.col("v") < LOW_VISIBLE, "low_confidence").otherwise("ok")
    return rows.select(key, F.round("v", 4).alias("visible_ratio"), F.round(1 - F.col("v"), 4).alias("black_ratio"), "flicker_cuts", status.alias("status"))
