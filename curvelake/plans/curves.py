"""Rating curves, their quality and smoothing, on events as samples: a user's day in one event type is a curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.operators import curves, islands, monitor, quality
from curvelake.plans.registry import Registry, table

registry = Registry()
query = registry.query
#: Media time: 30 days in 30 seconds; value in -1..1.
POINTS = """points AS (SELECT event_type || '/' || user_id AS curve, event_type AS rater, user_id AS task,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS t, value / 250 - 1 AS v, value < 480 AS is_valid, event_id FROM events)"""
GRID = (
    POINTS
    + """, own AS (SELECT *, CAST(greatest(0, ceil((t - 1e-9) / 0.1 - 1e-12)) AS INTEGER) AS k FROM points WHERE is_valid),
 last AS (SELECT curve, k, arg_max(v, (t, v)) AS seen FROM own GROUP BY 1, 2),
 f AS (SELECT curve, arg_min(v, (t, v)) AS first, any_value(rater) AS rater, any_value(task) AS task FROM own GROUP BY 1),
 cells AS (SELECT f.*, CAST(unnest(range(0, 301)) AS INTEGER) AS k FROM f),
 grid AS (SELECT c.curve, c.rater, c.task, c.k, coalesce(last_value(seen IGNORE NULLS) OVER (PARTITION BY c.curve ORDER BY c.k), first) AS v FROM cells c LEFT JOIN last USING (curve, k))"""
)


def points(spark: SparkSession, sf: str) -> DataFrame:
    """curve, rater, task, t, v, is_valid, event_id."""
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf, "events").select(
        F.concat_ws("/", "event_type", "user_id").alias("curve"),
        F.col("event_type").alias("rater"),
        F.col("user_id").alias("task"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 86400e6).alias("t"),
        (F.col("value") / 250 - 1).alias("v"),
        (F.col("value") < 480).alias("is_valid"),
        "event_id",
    )


def named(out: DataFrame) -> DataFrame:
    return out.withColumns({"rater": F.substring_index("curve", "/", 1), "task": F.substring_index("curve", "/", -1).cast("long")})


def sampled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Points, and the end of each curve."""
    own = points(spark, sf)
    return own.select("curve", "t", "v", "is_valid"), own.groupBy("curve").agg(F.lit(30.0).alias("end"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return named(curves.resample(*sampled(spark, sf)))


@query("T1_resample", f"WITH {GRID} SELECT curve, k, round(v, 6) AS v FROM grid")
def resample(spark: SparkSession, sf: str) -> DataFrame:
    return grid(spark, sf).select("curve", "k", F.round("v", 6).alias("v"))


PAIRS = GRID + """, pairs AS (SELECT a.rater, a.task, a.k, a.v AS mine, b.v AS ref FROM grid a JOIN grid b ON a.task = b.task AND a.k = b.k WHERE a.rater <> 'view' AND b.rater = 'view'),
 cmp AS (SELECT rater, task, round(avg(abs(mine - ref)), 3) AS mae, CASE WHEN count(*) >= 3 AND stddev_pop(mine) >= 0.02 AND stddev_pop(ref) >= 0.02 THEN round(corr(mine, ref), 2) + 0 END AS r, count(*) AS n FROM pairs GROUP BY 1, 2)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """rater, task, n, lo, hi, mine, ref: each curve beside that of the views of its task, in runs of cells."""
    own = named(curves.steps(*sampled(spark, sf)))
    return curves.paired(own.where("rater <> 'view'").select("rater", "task", "n", "lo", "hi", "v"), own.where("rater = 'view'"), ["task"])


def compared(spark: SparkSession, sf: str) -> DataFrame:
    return curves.compare(curves.cells(pairs(spark, sf)), ["rater", "task"])


@query("T2_compare", f"WITH {PAIRS} SELECT * FROM cmp")
def compare(spark: SparkSession, sf: str) -> DataFrame:
    return compared(spark, sf)


@query("Q6_detail", f"WITH {PAIRS}, few AS (SELECT rater, task, CAST(row_number() OVER (PARTITION BY rater, task ORDER BY k) - 1 AS INTEGER) AS place, round(mine, 6) AS mine, round(ref, 6) AS ref FROM pairs WHERE k IN (SELECT CAST(floor(i * 301 / 60) AS INTEGER) FROM range(0, 60) t(i))) SELECT few.*, mae, r, n FROM few JOIN cmp USING (rater, task)")
def detail(spark: SparkSession, sf: str) -> DataFrame:
    """Each comparison with both of its curves, cell by cell."""
    rows = quality.detail(pairs(spark, sf), ["rater", "task"])
    cells = rows.select("rater", "task", "mae", "r", "n", F.posexplode(F.arrays_zip("mine", "ref")).alias("place", "c"))
    return cells.select("rater", "task", "place", F.round("c.mine", 6).alias("mine"), F.round("c.ref", 6).alias("ref"), "mae", "r", "n")


@query("T3_downsample", f"WITH {GRID} SELECT curve, k, round(v, 6) AS v FROM grid WHERE k IN (SELECT CAST(floor(i * 301 / 60) AS INTEGER) FROM range(0, 60) t(i))")
def downsample(spark: SparkSession, sf: str) -> DataFrame:
    return curves.shown(curves.steps(*sampled(spark, sf))).select("curve", "k", F.round("v", 6).alias("v"))


@query("T4_curve_stats", f"WITH {POINTS} SELECT curve, round(max(v) - min(v), 3) AS spread, count(v) >= 3 AND stddev_pop(v) < 0.02 AS flat FROM points WHERE is_valid GROUP BY 1")
def stats(spark: SparkSession, sf: str) -> DataFrame:
    return curves.curve_stats(points(spark, sf).where("is_valid"), ["curve"])


CELLS = POINTS + ", cells AS (SELECT curve, CAST(floor(t * 1) AS INTEGER) AS cell, arg_max(v, (t, event_id)) AS v FROM points GROUP BY 1, 2)"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    own = points(spark, sf).groupBy("curve", F.floor("t").cast("int").alias("cell")).agg(F.max_by("v", F.struct("t", "event_id")).alias("v"))
    return own.withColumn("run", F.lit(0))


@query(
    "T5_fill_cells",
    f"""WITH {CELLS}, p AS (SELECT *, lag(cell) OVER w AS c0, lag(v) OVER w AS v0 FROM cells WINDOW w AS (PARTITION BY curve ORDER BY cell)),
 x AS (SELECT curve, cell, v, c0, v0, CAST(unnest(CASE WHEN cell - c0 - 1 BETWEEN 1 AND 20 THEN range(c0 + 1, cell + 1) ELSE [CAST(cell AS BIGINT)] END) AS INTEGER) AS pos FROM p)
 SELECT curve, pos AS cell, round(CASE WHEN pos = cell THEN v ELSE v0 + (v - v0) * ((pos - c0) / (cell - c0)) END, 6) AS v, pos < cell AS filled FROM x""",
)
def fill(spark: SparkSession, sf: str) -> DataFrame:
    return curves.fill_cells(cells(spark, sf)).withColumn("v", F.round("v", 6))


@query("T6_increasing", f"WITH {POINTS} SELECT event_id FROM (SELECT event_id, v, max(v) OVER (PARTITION BY curve ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM points) WHERE m IS NULL OR v > m")
def increasing(spark: SparkSession, sf: str) -> DataFrame:
    return curves.increasing(points(spark, sf).select("curve", F.col("event_id").alias("seq"), F.col("v").alias("t"), "event_id")).select("event_id")


@query("T7_flush_batches", f"WITH {POINTS}, n AS (SELECT curve, event_id, row_number() OVER (PARTITION BY curve ORDER BY event_id) - 1 AS i FROM points) SELECT curve, (i // 10) * 10 AS chunk_index, count(*) AS samples, min(event_id) AS first_event FROM n GROUP BY 1, 2")
def flush(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = points(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("curve").orderBy("event_id")) - 1)
    return n.groupBy("curve", (F.floor(F.col("i") / 10) * 10).alias("chunk_index")).agg(F.count("*").alias("samples"), F.min("event_id").alias("first_event"))


@query("T8_gap_audit", f"WITH {POINTS}, a AS (SELECT curve, CAST(floor(max(t) * 10 + 0.5) + 1 AS BIGINT) AS expected, count(*) FILTER (WHERE is_valid) AS measured, count(*) FILTER (WHERE NOT is_valid) AS filled FROM points GROUP BY 1) SELECT *, expected - measured - filled AS missing, expected - measured - filled >= 5 AS gappy FROM a")
def gap_audit(spark: SparkSession, sf: str) -> DataFrame:
    return curves.gap_audit(points(spark, sf).withColumn("filled", ~F.col("is_valid"))).withColumn("gappy", F.col("missing") >= 5)


@query(
    "T9_savitzky_golay",
    f"""WITH {GRID}, w AS (SELECT curve, k, greatest(0, least(k - 5, 290)) AS a FROM grid),
 s AS (SELECT w.curve, w.k, any_value(w.k - w.a - 5) AS t, sum(g.v) AS y0, sum((g.k - w.a - 5) * g.v) AS y1, sum((g.k - w.a - 5) * (g.k - w.a - 5) * g.v) AS y2 FROM w JOIN grid g ON g.curve = w.curve AND g.k BETWEEN w.a AND w.a + 10 GROUP BY 1, 2)
 SELECT curve, k, round((1958 * y0 - 110 * y2) / 9438 + t * y1 / 110 + t * t * (11 * y2 - 110 * y0) / 9438, 6) AS smooth FROM s""",
)
def smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Every grid has 301 cells, so the window is always 11 wide: a parabola fitted to each, or to the nearest at the ends."""
    return quality.smoothed(curves.listed(curves.steps(*sampled(spark, sf)))).select("curve", "k", F.round("smooth", 6).alias("smooth"))


@query("T12_overlay", f"WITH {GRID} SELECT task, k, round(max(v) FILTER (WHERE rater = 'view'), 6) AS view, round(max(v) FILTER (WHERE rater = 'click'), 6) AS click FROM grid WHERE rater IN ('view', 'click') GROUP BY 1, 2")
def overlay(spark: SparkSession, sf: str) -> DataFrame:
    own = grid(spark, sf).where("rater in ('view', 'click')")
    return own.groupBy("task", "k").pivot("rater", ["view", "click"]).agg(F.round(F.max("v"), 6))


SUMMARY = PAIRS + ", s AS (SELECT task % 40 AS annotator_id, count(*) AS compared, CAST(round(CAST(avg(mae) AS DECIMAL(18,9)), 3) AS DOUBLE) AS mean_mae, CAST(round(CAST(quantile_cont(r, 0.5) AS DECIMAL(18,9)), 2) AS DOUBLE) AS median_r FROM cmp GROUP BY 1)"


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.summary(compared(spark, sf).withColumn("annotator_id", F.col("task") % 40))


@query("Q4_annotator_summary", f"WITH {SUMMARY} SELECT * FROM s")
def annotator_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary(spark, sf)


@query("Q5_outliers", f"WITH {SUMMARY} SELECT s.*, compared >= 5 AND mean_mae > 1.1 * (SELECT quantile_cont(mean_mae, 0.5) FROM s WHERE compared >= 5) AS outlier FROM s")
def outliers(spark: SparkSession, sf: str) -> DataFrame:
    return quality.outliers(summary(spark, sf), factor=1.1)


@query("Q8_spot_check", "WITH d AS (SELECT event_id, ts FROM events WHERE CAST(ts + INTERVAL 3 HOUR AS DATE) = DATE '2024-01-12') SELECT least(count(*), 25) AS drawn, least(count(*), 25) AS of_that_day FROM d")
def spot_check(spark: SparkSession, sf: str) -> DataFrame:
    """How many were drawn, and how many different ones of them belong to the day; which they are depends on the seed."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("task_id"), F.col("ts").alias("completed_at"))
    drawn = quality.spot_check(rows, F.lit("2024-01-12").cast("date"), 25, 7)
    day = rows.where(monitor.local_day(F.col("completed_at")) == F.lit("2024-01-12").cast("date")).select("task_id", F.lit(1).alias("d"))
    return drawn.join(day, "task_id", "left").agg(F.count("*").alias("drawn"), F.count_distinct(F.when(F.col("d") == 1, F.col("task_id"))).alias("of_that_day"))


NOTES = POINTS + ", s AS (SELECT curve, round(max(v) - min(v), 3) AS spread, count(v) >= 3 AND stddev_pop(v) < 0.02 AS flat, count(*) AS revisions FROM points WHERE is_valid GROUP BY 1)"


@query("Q9_notes", f"WITH {NOTES} SELECT curve, list_filter([CASE WHEN flat THEN 'barely moves' WHEN spread < 1.7 THEN 'narrow' END, CASE WHEN revisions >= 15 THEN 'redone ' || revisions END], lambda x: x IS NOT NULL) AS notes FROM s")
def notes(spark: SparkSession, sf: str) -> DataFrame:
    own = points(spark, sf).where("is_valid")
    rows = curves.curve_stats(own, ["curve"]).join(own.groupBy("curve").agg(F.count("*").alias("revisions")), "curve")
    return rows.select("curve", quality.notes(F.col("flat"), F.col("spread"), F.col("revisions"), narrow=1.7, many=15).alias("notes"))


@query("Q10_day_summary", f"WITH {POINTS}, s AS (SELECT curve, CAST(floor(t + 0.125) AS BIGINT) AS day, round(max(v) - min(v), 3) AS spread, count(v) >= 3 AND stddev_pop(v) < 0.02 AS flat FROM points WHERE is_valid GROUP BY 1, 2) SELECT day, count(*) AS completed, CAST(round(CAST(avg(CAST(flat AS INTEGER)) AS DECIMAL(18,9)), 2) AS DOUBLE) AS flat_share, CAST(round(CAST(avg(spread) AS DECIMAL(18,9)), 3) AS DOUBLE) AS mean_spread FROM s GROUP BY 1")
def day_summary(spark: SparkSession, sf: str) -> DataFrame:
    """All tasks of each local day, three hours ahead of the data."""
    rows = curves.curve_stats(points(spark, sf).where("is_valid").withColumn("day", F.floor(F.col("t") + 0.125)), ["curve", "day"])
    digits = lambda x, n: F.round(F.avg(x).cast("decimal(18,9)"), n).cast("double")
    return rows.groupBy("day").agg(F.count("*").alias("completed"), digits(F.col("flat").cast("int"), 2).alias("flat_share"), digits(F.col("spread"), 3).alias("mean_spread"))


DAYS = """days AS (SELECT u.user_id, CAST(d AS INTEGER) AS d, coalesce(n > 0, FALSE) AS seen, m FROM (SELECT * FROM (SELECT DISTINCT user_id FROM events), range(1, 31) t(d)) u
 LEFT JOIN (SELECT user_id, CAST(day(ts) AS INTEGER) AS d, count(*) AS n, min(value) AS m FROM events GROUP BY 1, 2) e USING (user_id, d))"""


def days(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(F.count("*").alias("n"), F.min("value").alias("m"))
    frame = rows.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("d"))
    return frame.join(rows, ["user_id", "d"], "left").select("user_id", "d", F.coalesce(F.col("n") > 0, F.lit(False)).alias("seen"), "m")


RUNS = DAYS + """, g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id, seen ORDER BY d) AS grp FROM days),
 runs AS (SELECT user_id, seen, min(d) AS first, max(d) AS last, count(*) AS n FROM g GROUP BY user_id, seen, grp)"""


@query("W14_runs", f"WITH {RUNS} SELECT user_id, seen, first, last, n FROM runs")
def runs(spark: SparkSession, sf: str) -> DataFrame:
    return islands.runs(days(spark, sf), "user_id", "d", "seen").drop("run")


@query("W15_max_gap", f"WITH {RUNS} SELECT user_id, coalesce(max(n) FILTER (WHERE NOT seen), 0) AS max_gap FROM runs GROUP BY 1")
def max_gap(spark: SparkSession, sf: str) -> DataFrame:
    own = islands.runs(days(spark, sf), "user_id", "d", "seen")
    return own.groupBy("user_id").agg(F.coalesce(F.max(F.when(~F.col("seen"), F.col("n"))), F.lit(0)).alias("max_gap"))


@query(
    "W16_close_open",
    f"""WITH {DAYS}, a AS (SELECT *, max(CASE WHEN seen THEN d END) OVER (PARTITION BY user_id ORDER BY d) AS p, min(CASE WHEN seen THEN d END) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM days),
 c AS (SELECT *, seen OR coalesce(q - p - 1 <= 1, FALSE) AS closed FROM a),
 g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id, closed ORDER BY d) AS grp FROM c)
 SELECT user_id, d, closed AND count(*) OVER (PARTITION BY user_id, closed, grp) >= 3 AS smooth FROM g""",
)
def close_open(spark: SparkSession, sf: str) -> DataFrame:
    return islands.close_open(days(spark, sf), "user_id", "d", "seen", 1, 3).select("user_id", "d", "smooth")


@query(
    "W13_interpolate",
    f"""WITH {DAYS}, k AS (SELECT *, CASE WHEN m IS NOT NULL THEN d END AS x FROM days),
 a AS (SELECT *, max(x) OVER (PARTITION BY user_id ORDER BY d) AS x0, min(x) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1 FROM k),
 b AS (SELECT a.*, p.m AS y0, q.m AS y1 FROM a LEFT JOIN days p ON a.user_id = p.user_id AND a.x0 = p.d LEFT JOIN days q ON a.user_id = q.user_id AND a.x1 = q.d)
 SELECT user_id, d, round(CASE WHEN m IS NOT NULL THEN m WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * ((d - x0) / (x1 - x0)) END, 6) AS "full" FROM b""",
)
def interpolate(spark: SparkSession, sf: str) -> DataFrame:
    return islands.interpolate(days(spark, sf), "user_id", "d", "m").select("user_id", "d", F.round("full", 6).alias("full"))


@query("W11_rolling_median", "SELECT event_id, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS median FROM events")
def rolling_median(spark: SparkSession, sf: str) -> DataFrame:
    return islands.rolling_median(table(spark, sf, "events"), "user_id", "event_id", "value", 3).select("event_id", "median")


@query(
    "W12_ema",
    """WITH RECURSIVE n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 e AS (SELECT user_id, i, CAST(value AS DOUBLE) AS ema FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, 0.15 * n.value + 0.85 * e.ema FROM e JOIN n ON n.user_id = e.user_id AND n.i = e.i + 1)
 SELECT user_id, CAST(i - 1 AS INTEGER) AS pos, CAST(floor(ema * 1e6 + 1 / 3) AS BIGINT) AS ema_micro FROM e""",
)
def ema(spark: SparkSession, sf: str) -> DataFrame:
    rows = islands.exponential(table(spark, sf, "events"), "user_id", "event_id", "value")
    return rows.select("user_id", F.col("place").alias("pos"), F.floor(F.col("ema") * 1e6 + 1 / 3).alias("ema_micro"))


@query("K3_missing_runs", f"WITH {RUNS} SELECT user_id, first, last FROM runs WHERE NOT seen")
def missing_runs(spark: SparkSession, sf: str) -> DataFrame:
    return islands.runs(days(spark, sf), "user_id", "d", "seen").where(~F.col("seen")).select("user_id", "first", "last")


QUERIES, ORACLES = registry.queries, registry.oracles
