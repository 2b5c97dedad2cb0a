"""Pace, state and forecast of annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A gap up to this many seconds is work; fewer such gaps than LEAST_GAPS give no pace.
ACTIVE_GAP_S, LEAST_GAPS = 600, 20
#: Days begin at midnight of this fixed offset.
OFFSET = "INTERVAL '3' HOUR"


def seconds_between(a: Column, b: Column) -> Column:
    """Exact seconds from a to b (timestamps with or without a zone)."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def gaps(done: DataFrame, active_s: float = ACTIVE_GAP_S) -> DataFrame:
    """annotator_id, gap: seconds between neighbouring completions that are at most ``active_s`` apart."""
    w = Window.partitionBy("annotator_id").orderBy("completed_at", "task_id")
    rows = done.withColumn("gap", seconds_between(F.lag("completed_at").over(w), F.col("completed_at")))
    return rows.where(F.col("gap") <= active_s).select("annotator_id", "gap")


def pace(done: DataFrame, active_s: float = ACTIVE_GAP_S, least: int = LEAST_GAPS) -> DataFrame:
    """annotator_id, n_gaps, seconds_per_task (null where there are too few gaps) and active_hours, for everyone with a
    completion; unrounded in ``pace_s``, else 1 digit."""
    w = Window.partitionBy("annotator_id").orderBy("completed_at", "task_id")
    rows = done.withColumn("gap", seconds_between(F.lag("completed_at").over(w), F.col("completed_at")))
    short = F.when(F.col("gap") <= active_s, F.col("gap"))
    out = rows.groupBy("annotator_id").agg(F.count(short).alias("n_gaps"), F.coalesce(F.sum(short), F.lit(0.0)).alias("s"))
    pace_s = F.when(F.col("n_gaps") >= least, F.col("s") / F.col("n_gaps"))
    return out.select("annotator_id", "n_gaps", F.round(pace_s, 1).alias("seconds_per_task"), F.round(F.col("s") / 3600, 1).alias("active_hours"), pace_s.alias("pace_s"))


def gap_spread(done: DataFrame, active_s: float = ACTIVE_GAP_S, least: int = LEAST_GAPS) -> DataFrame:
    """annotator_id with least, median and largest gap (1 digit)."""
    out = gaps(done, active_s).groupBy("annotator_id").agg(
        F.count("*").alias("n"), F.round(F.min("gap"), 1).alias("least"), F.round(F.percentile("gap", 0.5), 1).alias("median"), F.round(F.max("gap"), 1).alias("most")
    )
    return out.where(F.col("n") >= least).drop("n")


def state(has_training: Column, trained: Column, seen: Column, main_touched: Column, done: Column, total: Column) -> Column:
    """The first rule that holds. Training tasks may lie in the main queue as well: while someone is in training (has
    training tasks and isn't trained yet), work on those doesn't count as main work."""
    in_training = has_training & ~trained
    begun = F.when(seen, "training").otherwise("not_started")
    return (
        F.when((total > 0) & (done >= total) & ~in_training, "done")
        .when(in_training, begun)
        .when(main_touched | (done > 0), "annotating")
        .when(trained, "trained")
        .otherwise(begun)
    )


def local_day(ts: Column) -> Column:
    return F.to_date(ts + F.expr(OFFSET))


def forecast(done: DataFrame, now: Column, remaining: Column, deadline: Column) -> DataFrame:
    """annotator_id, per_day, last_24h, days_left, on_track, needed_per_day. The rate is taken over the last 24 hours, or
    since the first completion if that is later, and needs six hours at least."""
    span = F.least(F.lit(86400.0), seconds_between(F.min("completed_at"), now))
    age = seconds_between(F.col("completed_at"), now)
    rows = done.groupBy("annotator_id").agg(span.alias("span"), F.count_if(age <= 86400).alias("n"), F.count_if(age < 86400).alias("last_24h"), remaining.alias("remaining"))
    n = F.col("n")  # nothing is older than the first completion, so the shorter span counts the same rows
    days = seconds_between(now, deadline) / 86400
    rate = F.when((F.col("span") >= 6 * 3600) & (F.col("remaining") > 0), n / (F.col("span") / 86400))
    return rows.select(
        "annotator_id",
        F.bround(rate, 0).cast("long").alias("per_day"),
        "last_24h",
        (rate * F.greatest(days, F.lit(0.0)) >= F.col("remaining")).alias("on_track"),
        F.when((days > 0) & (F.col("remaining") != 0), F.ceil(F.col("remaining") / days)).alias("needed_per_day"),
    )


def panel(accounts: DataFrame, queue: DataFrame, attempts: DataFrame, done: DataFrame, now: Column, deadline: Column, active_s: float = ACTIVE_GAP_S, least: int = LEAST_GAPS) -> DataFrame:
    """One row for each account: state, idle, training and main progress, activity, pace and forecast.

    ``accounts``: annotator_id, trained_at; ``queue``: annotator_id, task_id, phase, status; ``attempts``: annotator_id,
    task_id, started_at, received_at; ``done``: annotator_id, task_id, completed_at. Only active queue rows count.
    """
    key = ["annotator_id", "task_id"]
    active = queue.where("status = 'active'").groupBy(*key).agg(F.bool_or(F.col("phase") == "main").alias("main"), F.bool_or(F.col("phase") == "training").alias("training"))
    tried = attempts.groupBy(*key).agg(F.min("started_at").alias("started_at"), F.max("received_at").alias("received_at"), F.lit(True).alias("tried"))
    rows = active.join(tried, key, "full").join(done.select(*key, "completed_at"), key, "full")
    main, training = F.coalesce("main", F.lit(False)), F.coalesce("training", F.lit(False))
    ended = F.col("completed_at")
    main_ended = F.when(main, ended)
    each = rows.groupBy("annotator_id").agg(
        F.min("started_at").alias("first_activity"),
        F.max("received_at").alias("received_at"),
        F.max(F.when(main | training, ended)).alias("last_done"),
        F.count_if(training).alias("training_total"),
        F.count_if(training & ended.isNotNull()).alias("training_done"),
        F.count_if(main).alias("main_total"),
        F.count(main_ended).alias("main_done"),
        F.coalesce(F.bool_or(main & F.coalesce("tried", F.lit(False))), F.lit(False)).alias("main_touched"),
        F.count_if(main_ended >= now - F.expr("INTERVAL '1' DAY")).alias("window_done"),
        F.count_if(main_ended > now - F.expr("INTERVAL '1' DAY")).alias("last_24h"),
        F.count_if(local_day(main_ended) >= local_day(now)).alias("today"),
        F.min(main_ended).alias("first_main"),
    )
    of_main = done.join(active.where("main").select(*key), key, "left_semi")
    speed = pace(of_main, active_s, least).select("annotator_id", "seconds_per_task", "active_hours", "pace_s")
    out = accounts.join(each, "annotator_id", "left").join(speed, "annotator_id", "left")
    counts = ("training_total", "training_done", "main_total", "main_done", "window_done", "last_24h", "today")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {"active_hours": F.coalesce("active_hours", F.lit(0.0)), "last_activity": F.greatest("received_at", "last_done")})
    left = F.col("main_total") - F.col("main_done")
    own = state(F.col("training_total") > 0, F.col("trained_at").isNotNull(), F.col("first_activity").isNotNull(), F.coalesce("main_touched", F.lit(False)), F.col("main_done"), F.col("main_total"))
    days = seconds_between(now, deadline) / 86400
    age = seconds_between(F.col("first_main"), now)
    rate = F.when((left > 0) & (age >= 6 * 3600), F.col("window_done") / (F.least(F.lit(86400.0), age) / 86400))
    idle = (seconds_between(F.col("last_activity"), now) > 86400) & ~own.isin("done", "not_started")
    return out.select(
        "annotator_id", "trained_at", own.alias("state"), "first_activity", "last_activity", F.coalesce(idle, F.lit(False)).alias("idle"), "training_done", "training_total",
        "main_done", "main_total", F.when(F.col("main_total") == 0, 0).otherwise(F.floor(F.col("main_done") * 100 / F.col("main_total"))).alias("percent"), "today", "last_24h",
        "seconds_per_task", "active_hours", F.when(F.col("pace_s") != 0, F.round(left * F.col("pace_s") / 3600, 1)).alias("hours_left"),
        F.when((days > 0) & (left > 0), F.ceil(left / days)).alias("needed_per_day"), F.bround(rate, 0).cast("long").alias("per_day"), (rate * F.greatest(days, F.lit(0.0)) >= left).alias("on_track"),
    )


def by_modality(queue: DataFrame, done: DataFrame, tasks: DataFrame) -> DataFrame:
    """annotator_id, modality, done, total of the active main queue. ``tasks``: task_id, modality."""
    own = queue.where("status = 'active' and phase = 'main'").select("annotator_id", "task_id").distinct().join(tasks, "task_id")
    ended = done.select("annotator_id", "task_id", F.lit(True).alias("d_"))
    rows = own.join(ended, ["annotator_id", "task_id"], "left")
    return rows.groupBy("annotator_id", "modality").agg(F.count("d_").alias("done"), F.count("*").alias("total"))


def alerts(snapshots: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, alert: what changed since the snapshot before. ``snapshots``: state, trained, idle, on_track."""
    w = Window.partitionBy(key).orderBy(order)
    old = lambda c: F.lag(c).over(w)
    rows = snapshots.select(
        key, order,
        F.array_compact(F.array(
            F.when(old("state").isNotNull() & (old("state") != F.col("state")), F.concat(F.lit("state "), old("state"), F.lit(" > "), F.col("state"))),
            F.when(F.col("trained") & (old("trained") == F.lit(False)), "trained"),
            F.when(F.col("idle") & (old("idle") == F.lit(False)), "idle"),
            F.when((F.col("on_track") == F.lit(False)) & F.coalesce(old("on_track"), F.lit(True)) & old("state").isNotNull(), "behind"),
        )).alias("alerts"),
    )
    return rows.select(key, order, F.explode("alerts").alias("alert"))


def failing_sites(checks: DataFrame, key: str, order: str, least: int = 3) -> DataFrame:
    """key, order of the check with which a run of failures reaches ``least``. ``checks``: key, order, ok."""
    w = Window.partitionBy(key).orderBy(order)
    runs = checks.withColumn("run_", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy(key, "run_", "ok").orderBy(order))
    return runs.where(~F.col("ok")).withColumn("n_", F.when(~F.col("ok"), nth)).where(F.col("n_") == least).select(key, order)


def milestones(snapshots: DataFrame, key: str, order: str, marks: tuple[int, ...] = (25, 50, 75, 100)) -> DataFrame:
    """key, order, mark: percentages that a snapshot passes since the one before (old < mark <= new)."""
    w = Window.partitionBy(key).orderBy(order)
    rows = snapshots.withColumn("old", F.coalesce(F.lag("percent").over(w), F.lit(0)))
    rows = rows.select(key, order, "old", "percent", F.explode(F.array(*map(F.lit, marks))).alias("mark"))
    return rows.where("old < mark and mark <= percent").select(key, order, "mark")


def cumulative(counters: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``total``: a counter's growth so far; where it falls, it was reset and counts from zero."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.when(F.lag(value).over(w).isNull(), 0).when(F.col(value) >= F.lag(value).over(w), F.col(value) - F.lag(value).over(w)).otherwise(F.col(value))
    return counters.withColumn("step_", step).withColumn("total", F.sum("step_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step_")


#: Seconds that lie between a reading and the one it is compared with, at least (half an hour less than a day) and less than.
DAY_AGO_S = (84_600, 172_800)


def growth_since(readings: DataFrame, key: str, at: str, order: str, value: str, ago_s: tuple[int, int] = DAY_AGO_S) -> DataFrame:
    """``growth``: the counter less what it was at the last reading that is as old as ``ago_s`` says; null if there is none. Over
    a range of time, so readings may come as often or seldom as they like."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy("micros_").rangeBetween(1 - ago_s[1] * 1_000_000, -ago_s[0] * 1_000_000)
    rows = readings.withColumn("micros_", micros)
    return rows.withColumn("growth", F.col(value) - F.max_by(value, F.struct("micros_", order)).over(frame)).drop("micros_")


def traffic_alerts(readings: DataFrame, key: str, at: str, order: str, value: str, limits: tuple[float, ...], daily: float) -> DataFrame:
    """key, order, alert: the reading at which the total since the first reaches a limit (each limit is told once, a reset of the
    counter goes on from the total), and a day's first reading that grew by more than ``daily`` since the day before."""
    rows = growth_since(cumulative(readings, key, order, value), key, at, order, value)
    before = F.coalesce(F.lag("total").over(Window.partitionBy(key).orderBy(order)), F.lit(float("-inf")))
    crossed = rows.withColumn("before_", before).select(key, order, "total", "before_", F.explode(F.array(*(F.lit(float(x)) for x in limits))).alias("limit_"))
    crossed = crossed.where("before_ < limit_ and total >= limit_").select(key, order, F.concat(F.lit("total "), F.col("limit_").cast("string")).alias("alert"))
    large = rows.where(F.col("growth") > daily).groupBy(key, F.to_date(at).alias("day_")).agg(F.min(order).alias(order))
    return crossed.union(large.select(key, order, F.lit("day").alias("alert")))
