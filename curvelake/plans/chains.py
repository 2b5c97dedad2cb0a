"""Version chains, completion and pace over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake.operators import chains, completion, monitor
from curvelake.plans.registry import SUBMISSIONS, Registry, submissions, table

registry = Registry()
query = registry.query
CHAIN, ORDER = ["annotator_id", "dimension"], ["submitted_at", "submission_id"]
BOTH = ["purchase", "signup"]
ROWS = "submission_id, annotator_id, task_id, dimension, submitted_at, value"
COMPLETE = f"""{SUBMISSIONS}, complete AS (SELECT annotator_id, task_id FROM submissions WHERE dimension IN ('purchase', 'signup')
  GROUP BY 1, 2 HAVING count(DISTINCT dimension) = 2)"""
TIMES = f"""{SUBMISSIONS}, firsts AS (SELECT annotator_id, task_id, dimension, min(submitted_at) AS first_at FROM submissions
  WHERE dimension IN ('purchase', 'signup') GROUP BY 1, 2, 3),
done AS (SELECT annotator_id, task_id, max(first_at) AS completed_at FROM firsts GROUP BY 1, 2 HAVING count(*) = 2)"""


@query("W1_latest_version", f"WITH {SUBMISSIONS} SELECT {ROWS} FROM submissions QUALIFY row_number() OVER (PARTITION BY annotator_id, dimension ORDER BY submitted_at DESC, submission_id DESC) = 1")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    return chains.latest(submissions(spark, sf), CHAIN, ORDER)


@query("W2_superseded", f"WITH {SUBMISSIONS} SELECT {ROWS} FROM submissions QUALIFY row_number() OVER (PARTITION BY annotator_id, dimension ORDER BY submitted_at DESC, submission_id DESC) > 1")
def superseded(spark: SparkSession, sf: str) -> DataFrame:
    return chains.superseded(submissions(spark, sf), CHAIN, ORDER)


@query(
    "W3_rounds",
    f"""WITH {SUBMISSIONS}, r AS (SELECT submission_id, value < 250 AS own, row_number() OVER w AS k, count(*) OVER (PARTITION BY annotator_id, dimension, value < 250) AS n
    FROM submissions WINDOW w AS (PARTITION BY annotator_id, dimension, value < 250 ORDER BY submitted_at, submission_id))
    SELECT submission_id, CASE WHEN own THEN k ELSE 1 END AS round, CASE WHEN own THEN n ELSE 1 END AS round_count, (NOT own) OR k = n AS is_current FROM r""",
)
def rounds(spark: SparkSession, sf: str) -> DataFrame:
    return chains.rounds(submissions(spark, sf), CHAIN, ORDER, F.col("value") < 250).select("submission_id", "round", "round_count", "is_current")


@query("W8_rechain", f"WITH {SUBMISSIONS} SELECT submission_id, CAST(row_number() OVER w AS INTEGER) AS revision, lag(submission_id) OVER w AS previous_id FROM submissions WINDOW w AS (PARTITION BY annotator_id, dimension ORDER BY submitted_at, submission_id)")
def rechain(spark: SparkSession, sf: str) -> DataFrame:
    return chains.rechain(submissions(spark, sf), CHAIN, ORDER, "submission_id").select("submission_id", "revision", "previous_id")


@query("W9_next_revision", f"WITH {SUBMISSIONS} SELECT annotator_id, dimension, count(*) + 1 AS next_revision, arg_max(submission_id, (submitted_at, submission_id)) AS previous_id FROM submissions GROUP BY 1, 2")
def next_revision(spark: SparkSession, sf: str) -> DataFrame:
    return chains.next_revision(submissions(spark, sf), CHAIN, ORDER, "submission_id")


@query("X1_first_chunk_wins", f"WITH {SUBMISSIONS} SELECT {ROWS} FROM submissions QUALIFY row_number() OVER (PARTITION BY annotator_id, task_id, dimension ORDER BY submitted_at, submission_id) = 1")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return chains.first_wins(submissions(spark, sf), ["annotator_id", "task_id", "dimension"], ORDER)


@query("X12_purge_versions", f"WITH {SUBMISSIONS} SELECT {ROWS} FROM submissions QUALIFY row_number() OVER (PARTITION BY annotator_id, dimension ORDER BY submitted_at DESC, submission_id DESC) > 3")
def purge(spark: SparkSession, sf: str) -> DataFrame:
    return chains.prune(submissions(spark, sf), CHAIN, ORDER, 3)


@query("U1_local_wins", f"""WITH {SUBMISSIONS}, l AS (SELECT annotator_id, task_id, max(value) AS value FROM submissions WHERE dimension = 'view' GROUP BY 1, 2),
 r AS (SELECT annotator_id, task_id, min(value) AS value FROM submissions GROUP BY 1, 2)
 SELECT * FROM l UNION ALL SELECT r.* FROM r ANTI JOIN l USING (annotator_id, task_id)""")
def local_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = submissions(spark, sf)
    local = rows.where("dimension = 'view'").groupBy("annotator_id", "task_id").agg(F.max("value").alias("value"))
    remote = rows.groupBy("annotator_id", "task_id").agg(F.min("value").alias("value"))
    return chains.local_wins(local, remote, ["annotator_id", "task_id"])


@query("U2_confirmed_union", f"""WITH {SUBMISSIONS}, f AS (SELECT DISTINCT annotator_id FROM submissions WHERE task_id >= 28), o AS (SELECT DISTINCT annotator_id FROM submissions WHERE task_id < 15)
 SELECT annotator_id, TRUE AS fresh FROM f UNION ALL SELECT annotator_id, FALSE FROM o ANTI JOIN f USING (annotator_id)""")
def confirmed(spark: SparkSession, sf: str) -> DataFrame:
    rows = submissions(spark, sf)
    fresh = rows.where("task_id >= 28").select("annotator_id").distinct()
    old = rows.where("task_id < 15").select("annotator_id").distinct()
    return fresh.withColumn("fresh", F.lit(True)).union(old.join(fresh, "annotator_id", "left_anti").withColumn("fresh", F.lit(False)))


@query("A1_completion", f"WITH {COMPLETE} SELECT * FROM complete")
def complete(spark: SparkSession, sf: str) -> DataFrame:
    return completion.complete_tasks(submissions(spark, sf), BOTH)


@query("A2_completed_counts", f"WITH {COMPLETE} SELECT annotator_id, count(*) AS completed FROM complete GROUP BY 1")
def completed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return complete(spark, sf).groupBy("annotator_id").agg(F.count("*").alias("completed"))


@query("A3_client_completion", f"""WITH {SUBMISSIONS}, last AS (SELECT * FROM submissions QUALIFY row_number() OVER (PARTITION BY annotator_id, task_id, dimension ORDER BY submitted_at DESC, submission_id DESC) = 1)
 SELECT annotator_id, task_id FROM last WHERE value >= 20 AND dimension IN ('purchase', 'signup') GROUP BY 1, 2 HAVING count(DISTINCT dimension) = 2""")
def client_completion(spark: SparkSession, sf: str) -> DataFrame:
    attempts = submissions(spark, sf).withColumnsRenamed({"submission_id": "attempt_id", "submitted_at": "started_at"})
    return completion.client_complete(attempts, attempts.where("value >= 20"), BOTH)


@query("A4_completion_time", f"WITH {TIMES} SELECT * FROM done")
def completion_times(spark: SparkSession, sf: str) -> DataFrame:
    return completion.completion_times(submissions(spark, sf), BOTH)


@query("A5_first_last_seen", f"WITH {SUBMISSIONS} SELECT annotator_id, min(submitted_at) AS first_seen, max(submitted_at) AS last_seen, count(DISTINCT task_id) AS touched FROM submissions GROUP BY 1")
def seen(spark: SparkSession, sf: str) -> DataFrame:
    return submissions(spark, sf).groupBy("annotator_id").agg(F.min("submitted_at").alias("first_seen"), F.max("submitted_at").alias("last_seen"), F.count_distinct("task_id").alias("touched"))


PROGRESS = f"""WITH {COMPLETE}, queue AS (SELECT CAST(o_custkey % 150 AS BIGINT) AS annotator_id, CAST(day(o_orderdate) AS INTEGER) AS task_id, bool_or(o_orderpriority = '1-URGENT') AS is_anchor
   FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
 touched AS (SELECT DISTINCT annotator_id, task_id FROM submissions),
 t AS (SELECT q.annotator_id, count(*) AS assigned, count(*) FILTER (WHERE is_anchor) AS anchors, count(t.task_id) AS started, count(c.task_id) AS submitted,
   count(*) FILTER (WHERE t.task_id IS NOT NULL AND c.task_id IS NULL) AS in_progress
   FROM queue q LEFT JOIN touched t ON q.annotator_id = t.annotator_id AND q.task_id = t.task_id LEFT JOIN complete c ON q.annotator_id = c.annotator_id AND q.task_id = c.task_id GROUP BY 1),
 e AS (SELECT annotator_id, count(*) AS n FROM complete GROUP BY 1),
 p AS (SELECT t.*, coalesce(e.n, 0) AS submitted_all FROM t LEFT JOIN e USING (annotator_id))"""


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as assignments: a customer's orders on a day are a task; pending ones are released."""
    rows = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    own = rows.select((F.col("o_custkey") % 150).alias("annotator_id"), F.dayofmonth("o_orderdate").alias("task_id"), (F.col("o_orderpriority") == "1-URGENT").alias("a"))
    return own.groupBy("annotator_id", "task_id").agg(F.bool_or("a").alias("is_anchor")).withColumn("status", F.lit("active"))


@query("A7_progress", PROGRESS + " SELECT * FROM p")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    return completion.progress(queue(spark, sf), submissions(spark, sf), complete(spark, sf))


@query("A8_progress_totals", PROGRESS + " SELECT count(*) AS annotators, CAST(sum(assigned) AS BIGINT) AS assigned, CAST(sum(submitted) AS BIGINT) AS submitted, CAST(sum(in_progress) AS BIGINT) AS in_progress FROM p")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return progress(spark, sf).agg(F.count("*").alias("annotators"), *(F.sum(c).alias(c) for c in ("assigned", "submitted", "in_progress")))


@query("U4_queue_intersections", PROGRESS + ", x AS (SELECT annotator_id, task_id FROM queue INTERSECT SELECT annotator_id, task_id FROM complete) SELECT annotator_id, count(*) AS done_from_queue FROM x GROUP BY 1")
def intersections(spark: SparkSession, sf: str) -> DataFrame:
    own = queue(spark, sf).select("annotator_id", "task_id").intersect(complete(spark, sf))
    return own.groupBy("annotator_id").agg(F.count("*").alias("done_from_queue"))


@query("W5_block_position", f"WITH {SUBMISSIONS} SELECT submission_id, CAST(row_number() OVER (PARTITION BY annotator_id, dimension ORDER BY submission_id) AS INTEGER) AS position, count(*) OVER (PARTITION BY annotator_id, dimension) AS total FROM submissions")
def block_position(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("annotator_id", "dimension")
    return submissions(spark, sf).select("submission_id", F.row_number().over(w.orderBy("submission_id")).alias("position"), F.count("*").over(w).alias("total"))


@query("W7_latest_flag", f"WITH {SUBMISSIONS} SELECT task_id, arg_max(dimension, (submitted_at, submission_id)) AS flag FROM submissions GROUP BY 1")
def latest_flag(spark: SparkSession, sf: str) -> DataFrame:
    return submissions(spark, sf).groupBy("task_id").agg(F.max_by("dimension", F.struct("submitted_at", "submission_id")).alias("flag"))


GAPS = f"""WITH {SUBMISSIONS}, g AS (SELECT annotator_id, (epoch_us(submitted_at) - epoch_us(lag(submitted_at) OVER (PARTITION BY annotator_id ORDER BY submitted_at, task_id))) / 1e6 AS gap FROM submissions),
 k AS (SELECT * FROM g WHERE gap <= 21600)"""


def completions(spark: SparkSession, sf: str) -> DataFrame:
    return submissions(spark, sf).select("annotator_id", "task_id", F.col("submitted_at").alias("completed_at"))


@query("M1_pace", GAPS + " SELECT annotator_id, count(gap) FILTER (WHERE gap <= 21600) AS n_gaps, CASE WHEN count(gap) FILTER (WHERE gap <= 21600) >= 20 THEN round(sum(gap) FILTER (WHERE gap <= 21600) / count(gap) FILTER (WHERE gap <= 21600), 1) END AS seconds_per_task, round(coalesce(sum(gap) FILTER (WHERE gap <= 21600), 0) / 3600, 1) AS active_hours FROM g GROUP BY 1")
def pace(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.pace(completions(spark, sf), 21600).drop("pace_s")


@query("M2_gap_spread", GAPS + " SELECT annotator_id, round(min(gap), 1) AS least, round(quantile_cont(gap, 0.5), 1) AS median, round(max(gap), 1) AS most FROM k GROUP BY 1 HAVING count(*) >= 20")
def gap_spread(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.gap_spread(completions(spark, sf), 21600)


@query("M5_local_days", f"WITH {SUBMISSIONS} SELECT annotator_id, CAST(submitted_at + INTERVAL 3 HOUR AS DATE) AS day, count(*) AS done FROM submissions GROUP BY 1, 2")
def local_days(spark: SparkSession, sf: str) -> DataFrame:
    return submissions(spark, sf).groupBy("annotator_id", monitor.local_day(F.col("submitted_at")).alias("day")).agg(F.count("*").alias("done"))


@query(
    "M6_forecast",
    f"""WITH {SUBMISSIONS}, n AS (SELECT TIMESTAMP '2024-01-30 12:00:00' AS now, TIMESTAMP '2024-02-10 00:00:00' AS deadline),
 a AS (SELECT annotator_id, epoch_us(now) - epoch_us(submitted_at) AS age, (epoch_us(deadline) - epoch_us(now)) / 86400e6 AS days FROM submissions, n WHERE submitted_at <= now),
 g AS (SELECT annotator_id, least(86400.0, max(age) / 1e6) AS span, count(*) FILTER (WHERE age <= 86400000000) AS n, count(*) FILTER (WHERE age < 86400000000) AS last_24h, 120 - count(*) AS remaining, any_value(days) AS days FROM a GROUP BY 1),
 r AS (SELECT *, CASE WHEN span >= 21600 AND remaining > 0 THEN n / (span / 86400) END AS rate FROM g)
 SELECT annotator_id, CAST(round_even(rate, 0) AS BIGINT) AS per_day, last_24h, rate * greatest(days, 0) >= remaining AS on_track, CASE WHEN days > 0 AND remaining <> 0 THEN CAST(ceil(remaining / days) AS BIGINT) END AS needed_per_day FROM r""",
)
def forecast(spark: SparkSession, sf: str) -> DataFrame:
    now, deadline = F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00")), F.to_timestamp_ntz(F.lit("2024-02-10 00:00:00"))
    return monitor.forecast(completions(spark, sf).where(F.col("completed_at") <= now), now, 120 - F.count("*"), deadline)


@query(
    "M12_milestones",
    f"""WITH {SUBMISSIONS}, d AS (SELECT annotator_id, task_id, CAST(count(*) AS BIGINT) AS n FROM submissions GROUP BY 1, 2),
 s AS (SELECT annotator_id, task_id, CAST(least(100, sum(n) OVER (PARTITION BY annotator_id ORDER BY task_id)) AS BIGINT) AS percent FROM d),
 o AS (SELECT *, coalesce(lag(percent) OVER (PARTITION BY annotator_id ORDER BY task_id), 0) AS old FROM s)
 SELECT annotator_id, task_id, CAST(mark AS INTEGER) AS mark FROM o, (VALUES (25), (50), (75), (100)) m(mark) WHERE old < mark AND mark <= percent""",
)
def milestones(spark: SparkSession, sf: str) -> DataFrame:
    daily = submissions(spark, sf).groupBy("annotator_id", "task_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("annotator_id").orderBy("task_id").rowsBetween(Window.unboundedPreceding, 0)
    return monitor.milestones(daily.withColumn("percent", F.least(F.lit(100), F.sum("n").over(w))), "annotator_id", "task_id")


@query(
    "W18_counter_resets",
    f"""WITH {SUBMISSIONS}, c AS (SELECT submission_id, annotator_id, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY annotator_id ORDER BY submission_id) AS p FROM submissions)
 SELECT submission_id, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) OVER (PARTITION BY annotator_id ORDER BY submission_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM c""",
)
def counter_resets(spark: SparkSession, sf: str) -> DataFrame:
    rows = submissions(spark, sf).withColumn("v", F.floor("value"))
    return monitor.cumulative(rows, "annotator_id", "submission_id", "v").select("submission_id", "total")


@query(
    "flagship_completion_pace",
    f"""WITH {COMPLETE}, last AS (SELECT annotator_id, count(*) AS chains FROM (SELECT DISTINCT annotator_id, task_id, dimension FROM submissions) GROUP BY 1),
 n AS (SELECT annotator_id, count(*) AS completed FROM complete GROUP BY 1),
 g AS (SELECT annotator_id, (epoch_us(submitted_at) - epoch_us(lag(submitted_at) OVER (PARTITION BY annotator_id ORDER BY submitted_at, task_id))) / 1e6 AS gap FROM submissions),
 k AS (SELECT annotator_id, count(*) AS n_gaps, sum(gap) AS s FROM g WHERE gap <= 21600 GROUP BY 1)
 SELECT last.annotator_id, chains, coalesce(completed, 0) AS completed, CASE WHEN n_gaps >= 20 THEN round(s / n_gaps, 1) END AS seconds_per_task
 FROM last LEFT JOIN n USING (annotator_id) LEFT JOIN k USING (annotator_id)""",
)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Latest version of every chain, tasks complete, and pace: all keyed by the annotator."""
    rows = submissions(spark, sf)
    current = chains.latest(rows, ["annotator_id", "task_id", "dimension"], ORDER)
    held = current.groupBy("annotator_id").agg(F.count("*").alias("chains"))
    done = completion.complete_tasks(current, BOTH).groupBy("annotator_id").agg(F.count("*").alias("completed"))
    speed = monitor.pace(completions(spark, sf), 21600).select("annotator_id", "seconds_per_task")
    out = held.join(done, "annotator_id", "left").join(speed, "annotator_id", "left")
    return out.select("annotator_id", "chains", F.coalesce("completed", F.lit(0)).alias("completed"), "seconds_per_task")


QUERIES, ORACLES = registry.queries, registry.oracles
