"""Quality of raters: agreement summaries, outliers, spot checks and smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.operators import curves
from curvelake.operators.monitor import local_day

#: Comparisons that a baseline or an outlier needs.
LEAST_COMPARED = 5


def summary(compared: DataFrame) -> DataFrame:
    """annotator_id, compared, mean_mae (3 digits), median_r (2), both without nulls; halves round away from zero."""
    digits = lambda x, n: F.round(x.cast("decimal(18,9)"), n).cast("double")
    return compared.groupBy("annotator_id").agg(F.count("*").alias("compared"), digits(F.avg("mae"), 3).alias("mean_mae"), digits(F.percentile("r", 0.5), 2).alias("median_r"))


def detail(pairs: DataFrame, key: list[str], points: int = 60) -> DataFrame:
    """key, mae, r, n and both curves as they are shown: ``mine`` and ``ref`` at ``points`` cells at most. ``pairs``: key, k, mine, ref; or
    key, n, lo, hi, mine, ref as ``curves.paired`` makes them, of which runs alone are moved, and the cells that aren't shown are never listed."""
    if "lo" in pairs.columns:
        runs = pairs.groupBy(*key).agg(F.first("n").alias("n_"), F.array_sort(F.collect_list(F.struct("lo", "hi", "mine", "ref"))).alias("runs_"))
        seen = lambda r: F.filter(F.sequence(r["lo"], r["hi"]), lambda k: curves.wanted(k, F.col("n_"), points))
        cells = F.flatten(F.transform("runs_", lambda r: F.transform(seen(r), lambda k: F.struct(k.alias("k"), r["mine"].alias("mine"), r["ref"].alias("ref")))))
        rows = curves.compare(curves.cells(pairs), key).join(runs, key).withColumn("cells_", cells).drop("n_", "runs_")
    else:
        few = curves.downsample(pairs, points, key)
        shown = few.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "mine", "ref"))).alias("cells_"))  # points at most
        rows = curves.compare(pairs, key).join(shown, key)
    return rows.withColumns({c: F.col(f"cells_.{c}") for c in ("mine", "ref")}).drop("cells_")


def outliers(rows: DataFrame, factor: float = 1.5) -> DataFrame:
    """``outlier``: enough comparisons and a mean error over ``factor`` times the group's median. The baseline is one row."""
    base = rows.where(F.col("compared") >= LEAST_COMPARED).agg(F.percentile("mean_mae", 0.5).alias("base_"))
    flag = (F.col("compared") >= LEAST_COMPARED) & (F.col("mean_mae") > factor * F.col("base_"))
    return rows.crossJoin(F.broadcast(base)).withColumn("outlier", flag).drop("base_")


def spot_check(done: DataFrame, day: Column, n: int, seed: int) -> DataFrame:
    """n of a local day's tasks, drawn by hash and seed, with their order of completion."""
    drawn = done.where(local_day(F.col("completed_at")) == day).orderBy(F.xxhash64(F.lit(seed), "task_id"), "task_id").limit(n)
    return drawn.orderBy("completed_at", "task_id")


def stratified(rows: DataFrame, stratum: str, key: str, k: int, seed: int) -> DataFrame:
    """stratum, key of k rows of each stratum (all, if fewer), drawn by hash and seed."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= k).select(stratum, key)


def notes(flat: Column, spread: Column, revisions: Column, narrow: float = 0.2, many: int = 3) -> Column:
    """What a reviewer should look at."""
    moves = F.when(flat, "barely moves").when(spread < narrow, "narrow")
    return F.array_compact(F.array(moves, F.when(revisions >= many, F.concat(F.lit("redone "), revisions.cast("string")))))


def savitzky_golay(points: DataFrame, window: int = 11, order: int = 2) -> DataFrame:
    """curve, k, v, smooth: local polynomial fits; ends are read off the first and last window. A curve with fewer points
    than the window takes the largest odd window that fits; under four points it stays as it is. One curve is one row."""
    own = points.groupBy("curve").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("p_"))
    return smoothed(own.select("curve", F.col("p_.k").alias("ks"), F.col("p_.v").alias("vs")), window, order)


def smoothed(lists: DataFrame, window: int = 11, order: int = 2) -> DataFrame:
    """``savitzky_golay`` of curves that are arrays: curve, vs and, if their places aren't 0, 1, ..., ks."""

    def fits(w: int) -> np.ndarray:
        x = np.vander(np.arange(w) - w // 2, order + 1, increasing=True)
        return x @ np.linalg.pinv(x)

    @F.pandas_udf("array<double>")
    def run(lines: pd.Series) -> pd.Series:
        known: dict[int, np.ndarray] = {}
        out = []
        for line in lines:
            y = np.asarray(line, dtype=float)
            n = len(y)
            w = min(window, n if n % 2 else n - 1)
            if n >= 4 and w > order:
                fit = known[w] if w in known else known.setdefault(w, fits(w))
                h = w // 2
                y = np.concatenate([fit[:h] @ y[:w], np.convolve(y, fit[h][::-1], "valid"), fit[-h:] @ y[n - w :]])
            out.append(y)
        return pd.Series(out)

    places = F.col("ks") if "ks" in lists.columns else F.sequence(F.lit(0), F.size("vs") - 1)
    rows = lists.select("curve", F.explode(F.arrays_zip(places.alias("k"), F.col("vs").alias("v"), run("vs").alias("smooth"))).alias("c"))
    return rows.select("curve", F.col("c.k").cast("int").alias("k"), "c.v", F.nullif("c.smooth", F.lit(float("nan"))).alias("smooth"))
