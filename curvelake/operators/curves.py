"""Rating curves: sampled values over media time, resampled, compared, filled and audited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP, EPSILON = 0.1, 1e-9
#: Population deviation below which a curve is flat, and cells that continuous playback may have skipped.
FLAT, MOST_FILLED = 0.02, 20


def trajectory(chunks: DataFrame, key: str = "attempt_id") -> DataFrame:
    """Long form of chunked samples: chunks in the order of their index, whatever order they came in, one of each index."""
    once = chunks.groupBy(key, "chunk_index").agg(F.min_by("samples", "created_at").alias("samples"))
    return once.select(key, "chunk_index", F.posexplode("samples").alias("pos", "s")).select(key, "chunk_index", "pos", "s.*")


def grid_size(end: str) -> str:
    return f"greatest(1, cast(floor({end} / {STEP}D) as int) + 1)"


def steps(points: DataFrame, ends: DataFrame, key: str = "curve") -> DataFrame:
    """key, n, lo, hi, v: the curve on its grid of n cells as runs of cells lo to hi of one value, without gaps. There are at most as many
    runs as points, so what is moved are points, never cells. Arguments as for ``resample``.

    A point is mapped to the first cell that sees it. Points are dealt out by curve once; all that follows is done where they are.
    """
    cell = F.greatest(F.lit(0), F.ceil((F.col("t") - EPSILON) / STEP - 1e-12)).cast("int")
    own = points.where(F.coalesce("is_valid", F.lit(True))).select(key, cell.alias("k"), "t", "v")
    last = own.repartition(key).groupBy(key, "k").agg(F.max_by("v", F.struct("t", "v")).alias("seen"), F.min_by("v", F.struct("t", "v")).alias("v0"))
    w = Window.partitionBy(key).orderBy("k")
    first = F.first("v0").over(w)
    rows = last.select(key, "k", F.lead("k").over(w).alias("next_"), first.alias("first"), (F.row_number().over(w) == 1).alias("opens_"), F.coalesce(F.last("seen", ignorenulls=True).over(w), first).alias("v"))
    rows = rows.join(ends.select(key, F.expr(grid_size("end")).alias("n")), key)
    run = lambda lo, hi, v: F.struct(lo.cast("int").alias("lo"), (F.least(hi, F.col("n")) - 1).cast("int").alias("hi"), v.alias("v"))
    before = F.when(F.col("opens_"), run(F.lit(0), F.col("k"), F.col("first")))
    runs = F.filter(F.array(before, run(F.col("k"), F.coalesce("next_", "n"), F.col("v"))), lambda r: r["lo"] <= r["hi"])
    return rows.select(key, "n", F.explode(runs).alias("r_")).select(key, "n", "r_.*")


def resample(points: DataFrame, ends: DataFrame, key: str = "curve") -> DataFrame:
    """key, k, v: on a grid of STEP, the value of the last valid point at or before k * STEP, and the first point's before it.
    A curve without points has no rows. ``points``: key, t, v, is_valid; ``ends``: key, end, one row for each curve."""
    return steps(points, ends, key).select(key, F.explode(F.sequence("lo", "hi")).alias("k"), "v")


def wanted(k: Column, n: Column, points: int) -> Column:
    """Whether a cell is shown: all, if there are at most ``points``, else cells floor(i * n / points)."""
    return (n <= points) | (F.floor(F.ceil(k * points / n) * n / points) == k)


def shown(runs: DataFrame, points: int = 60, key: str = "curve") -> DataFrame:
    """key, k, v: the cells that ``downsample`` leaves, made from ``steps`` alone."""
    return runs.select(key, "n", F.explode(F.sequence("lo", "hi")).alias("k"), "v").where(wanted(F.col("k"), F.col("n"), points)).select(key, "k", "v")


def paired(mine: DataFrame, ref: DataFrame, on: list[str]) -> DataFrame:
    """All columns of ``mine`` but v, and mine, ref: runs of cells lo to hi that two curves both have, of their n common cells. ``mine``:
    ``on``, others, n, lo, hi, v; ``ref``: ``on``, n, lo, hi, v."""
    own = [c for c in mine.columns if c not in ("n", "lo", "hi", "v")]
    other = ref.select(*on, F.col("n").alias("n_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), F.col("v").alias("ref"))
    both = mine.withColumnRenamed("v", "mine").join(other, on).where("lo <= hi_ and lo_ <= hi")
    return both.select(*own, F.least("n", "n_").alias("n"), F.greatest("lo", "lo_").alias("lo"), F.least("hi", "hi_").alias("hi"), "mine", "ref")


def cells(runs: DataFrame) -> DataFrame:
    """All columns but lo and hi, and k: a row for each cell."""
    return runs.withColumn("k", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def listed(runs: DataFrame, key: str = "curve") -> DataFrame:
    """key, vs: the curve's cells as one array, put together from its runs."""
    own = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "v"))).alias("r_"))
    return own.select(key, F.flatten(F.transform("r_", lambda r: F.array_repeat(r["v"], r["hi"] - r["lo"] + 1))).alias("vs"))


def compare(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Mean absolute error (3 digits) and correlation (2) of curves on one grid: ``pairs`` has key, k, mine, ref.

    The correlation needs three cells and both deviations of FLAT at least; else it is null.
    """
    n, both = F.count("*"), (F.stddev_pop("mine") >= FLAT) & (F.stddev_pop("ref") >= FLAT)
    return pairs.groupBy(*key).agg(F.round(F.avg(F.abs(F.col("mine") - F.col("ref"))), 3).alias("mae"), F.when((n >= 3) & both, F.round(F.try_divide(F.covar_pop("mine", "ref"), F.stddev_pop("mine") * F.stddev_pop("ref")), 2)).alias("r"), n.alias("n"))


def downsample(grid: DataFrame, points: int = 60, key: str | list[str] = "curve") -> DataFrame:
    """At most ``points`` cells of each curve: cells floor(i * len / points)."""
    n = F.count("*").over(Window.partitionBy(key))
    return grid.withColumn("n_", n).where(wanted(F.col("k"), F.col("n_"), points)).drop("n_")


def curve_stats(points: DataFrame, key: list[str]) -> DataFrame:
    """spread (3 digits) and flat (three points at least and a population deviation under FLAT)."""
    return points.groupBy(*key).agg(F.round(F.max("v") - F.min("v"), 3).alias("spread"), ((F.count("v") >= 3) & (F.stddev_pop("v") < FLAT)).alias("flat"))


def fill_cells(cells: DataFrame, key: str = "curve") -> DataFrame:
    """key, cell, v, filled: up to MOST_FILLED cells that continuous playback skipped, by linear interpolation. Nothing is
    filled before the first cell or across a break (``run`` changes there)."""
    w = Window.partitionBy(key, "run").orderBy("cell")
    rows = cells.select(key, "run", "cell", "v", F.lag("cell").over(w).alias("c0"), F.lag("v").over(w).alias("v0"))
    skipped = F.col("cell") - F.col("c0") - 1
    own = F.when(skipped.between(1, MOST_FILLED), F.sequence(F.col("c0") + 1, F.col("cell"))).otherwise(F.array("cell"))
    rows = rows.select(key, "cell", "v", "c0", "v0", F.explode(own).alias("at"))
    share = (F.col("at") - F.col("c0")) / (F.col("cell") - F.col("c0"))
    value = F.when(F.col("at") == F.col("cell"), F.col("v")).otherwise(F.col("v0") + (F.col("v") - F.col("v0")) * share)
    return rows.select(key, F.col("at").alias("cell"), value.alias("v"), (F.col("at") < F.col("cell")).alias("filled"))


def increasing(points: DataFrame, key: str = "curve") -> DataFrame:
    """Points whose time is later than that of all before them (``seq``: order of arrival)."""
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("m_", F.max("t").over(before)).where("m_ is null or t > m_").drop("m_")


def gap_audit(points: DataFrame, key: str = "curve", hz: int = 10) -> DataFrame:
    """expected, measured, filled and missing samples of each curve."""
    out = points.groupBy(key).agg((F.floor(F.max("t") * hz + 0.5) + 1).alias("expected"), F.count_if(~F.col("filled")).alias("measured"), F.count_if("filled").alias("filled"))
    return out.withColumn("missing", F.col("expected") - F.col("measured") - F.col("filled"))


def gap_report(points: DataFrame, attempts: DataFrame, since: Column, cut: Column, key: str = "attempt_id", hz: int = 10, large: int = 5) -> DataFrame:
    """annotator_id, modality, period (before or after ``cut``): attempts begun since ``since``, their expected, measured and filled samples, attempts
    that miss ``large`` samples or more, and the shares. ``points``: key, t, filled; ``attempts``: key, annotator_id, modality, started_at."""
    own = attempts.where(F.col("started_at") >= since).select(key, "annotator_id", "modality", F.when(F.col("started_at") >= cut, "after").otherwise("before").alias("period"))
    each = gap_audit(points, key, hz).join(own, key)
    sums = [F.sum(c).alias(c) for c in ("expected", "measured", "filled")]
    rows = each.groupBy("annotator_id", "modality", "period").agg(F.count("*").alias("attempts"), *sums, F.count_if(F.col("missing") >= large).alias("gappy"))
    share = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    had = F.col("measured") + F.col("filled")
    missing = F.when(F.col("expected") != 0, 1 - had / F.col("expected")).otherwise(0.0)
    return rows.withColumns({"missing_share": missing, "measured_share": share(F.col("measured"), F.col("expected")), "gappy_share": share(F.col("gappy"), F.col("attempts"))})
