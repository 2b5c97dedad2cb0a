"""The monitor's panel and the comparison of anchors, on orders as assignments and events as submissions.

An account is a user; its queue are the orders of the customers dealt to it, a day of the month being a task. Events
before NOW are its attempts; a task is complete with both dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake.operators import anchors, chains, completion, monitor
from curvelake.plans.chains import BOTH, TIMES
from curvelake.plans.registry import Registry, submissions, table

registry = Registry()
query = registry.query
MODALITIES = ("face", "body", "audio", "text", "full")
NOW, DEADLINE, ACTIVE_S = "2024-01-25 12:00:00", "2024-02-10 00:00:00", 864_000


def instant(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """annotator_id, task_id, phase, status, is_anchor."""
    who, task = F.col("o_custkey") % 160, F.dayofmonth("o_orderdate")
    phase = F.when((F.col("o_orderpriority") == "5-LOW") & (who % 5 > 0), "training").when(task % 3 == F.col("o_custkey") % 3, "main").otherwise("pilot")
    status = F.when(F.col("o_orderstatus") == "P", "released").otherwise("active")
    return table(spark, sf, "orders").select(who.alias("annotator_id"), task.alias("task_id"), phase.alias("phase"), status.alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("is_anchor"), F.col("o_orderkey").alias("assignment_id"))


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    trained = F.when(F.col("annotator_id") % 3 != 0, instant("2024-01-05 00:00:00") + F.make_dt_interval(hours=F.col("annotator_id").cast("int")))
    return table(spark, sf, "customer").select((F.col("c_custkey") % 160).alias("annotator_id")).distinct().withColumn("trained_at", trained)


def done(spark: SparkSession, sf: str) -> DataFrame:
    return completion.completion_times(submissions(spark, sf), BOTH).where(F.col("completed_at") <= instant(NOW))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    tried = submissions(spark, sf).where(F.col("submitted_at") <= instant(NOW)).select("annotator_id", "task_id", F.col("submitted_at").alias("started_at"), F.col("submitted_at").alias("received_at"))
    return monitor.panel(accounts(spark, sf), queue(spark, sf), tried, done(spark, sf), instant(NOW), instant(DEADLINE), ACTIVE_S, least=1)


QUEUE = """q AS (SELECT CAST(o_custkey % 160 AS BIGINT) AS annotator_id, CAST(day(o_orderdate) AS INTEGER) AS task_id, o_orderkey AS assignment_id, o_orderpriority = '1-URGENT' AS is_anchor,
   CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 160 % 5 > 0 THEN 'training' WHEN day(o_orderdate) % 3 = o_custkey % 3 THEN 'main' ELSE 'pilot' END AS phase,
   CASE WHEN o_orderstatus = 'P' THEN 'released' ELSE 'active' END AS status FROM orders)"""
PANEL = f"""WITH {TIMES}, n AS (SELECT TIMESTAMP '{NOW}' AS now, TIMESTAMP '{DEADLINE}' AS deadline), {QUEUE},
 t AS (SELECT annotator_id, task_id, submitted_at AS tried_at FROM submissions, n WHERE submitted_at <= now), d AS (SELECT done.* FROM done, n WHERE completed_at <= now),
 a AS (SELECT *, CASE WHEN annotator_id % 3 <> 0 THEN TIMESTAMP '2024-01-05 00:00:00' + to_hours(annotator_id) END AS trained_at FROM (SELECT DISTINCT CAST(c_custkey % 160 AS BIGINT) AS annotator_id FROM customer)),
 mq AS (SELECT DISTINCT annotator_id, task_id FROM q WHERE phase = 'main' AND status = 'active'), tq AS (SELECT DISTINCT annotator_id, task_id FROM q WHERE phase = 'training' AND status = 'active'),
 md AS (SELECT d.* FROM d SEMI JOIN mq ON d.annotator_id = mq.annotator_id AND d.task_id = mq.task_id), td AS (SELECT d.* FROM d SEMI JOIN tq ON d.annotator_id = tq.annotator_id AND d.task_id = tq.task_id),
 gaps AS (SELECT annotator_id, (epoch_us(completed_at) - epoch_us(lag(completed_at) OVER (PARTITION BY annotator_id ORDER BY completed_at, task_id))) / 1e6 AS gap FROM md),
 s AS (SELECT a.*, (SELECT min(tried_at) FROM t WHERE t.annotator_id = a.annotator_id) AS first_activity,
   greatest((SELECT max(tried_at) FROM t WHERE t.annotator_id = a.annotator_id), (SELECT max(completed_at) FROM md WHERE md.annotator_id = a.annotator_id), (SELECT max(completed_at) FROM td WHERE td.annotator_id = a.annotator_id)) AS last_activity,
   (SELECT count(*) FROM tq WHERE tq.annotator_id = a.annotator_id) AS training_total, (SELECT count(*) FROM td WHERE td.annotator_id = a.annotator_id) AS training_done,
   (SELECT count(*) FROM mq WHERE mq.annotator_id = a.annotator_id) AS main_total, (SELECT count(*) FROM md WHERE md.annotator_id = a.annotator_id) AS main_done,
   (SELECT count(*) FROM t SEMI JOIN mq ON t.annotator_id = mq.annotator_id AND t.task_id = mq.task_id WHERE t.annotator_id = a.annotator_id) AS main_tried,
   (SELECT min(completed_at) FROM md WHERE md.annotator_id = a.annotator_id) AS first_main,
   (SELECT count(*) FROM md, n WHERE md.annotator_id = a.annotator_id AND completed_at > now - INTERVAL 24 HOUR) AS last_24h,
   (SELECT count(*) FROM md, n WHERE md.annotator_id = a.annotator_id AND completed_at + INTERVAL 3 HOUR >= date_trunc('day', now + INTERVAL 3 HOUR)) AS today,
   (SELECT count(*) FROM gaps WHERE gaps.annotator_id = a.annotator_id AND gap <= {ACTIVE_S}) AS n_gaps, (SELECT coalesce(sum(gap), 0) FROM gaps WHERE gaps.annotator_id = a.annotator_id AND gap <= {ACTIVE_S}) AS active_s FROM a),
 b AS (SELECT s.*, now, deadline, main_total - main_done AS rest, training_total > 0 AND trained_at IS NULL AS in_training, CASE WHEN n_gaps >= 1 THEN active_s / n_gaps END AS pace_s,
   (epoch_us(deadline) - epoch_us(now)) / 86400e6 AS days, CASE WHEN first_main IS NOT NULL THEN least(86400.0, (epoch_us(now) - epoch_us(first_main)) / 1e6) END AS span FROM s, n),
 c AS (SELECT *, CASE WHEN main_total > 0 AND rest = 0 AND NOT in_training THEN 'done' WHEN in_training THEN CASE WHEN first_activity IS NULL THEN 'not_started' ELSE 'training' END
   WHEN main_done > 0 OR main_tried > 0 THEN 'annotating' WHEN trained_at IS NOT NULL THEN 'trained' WHEN first_activity IS NOT NULL THEN 'training' ELSE 'not_started' END AS state,
   CASE WHEN rest > 0 AND span >= 21600 THEN (SELECT count(*) FROM md WHERE md.annotator_id = b.annotator_id AND completed_at >= b.now - INTERVAL 24 HOUR) / (span / 86400) END AS rate FROM b),
 p AS (SELECT annotator_id, trained_at, state, first_activity, last_activity, coalesce(last_activity < now - INTERVAL 24 HOUR AND state NOT IN ('done', 'not_started'), FALSE) AS idle, training_done, training_total,
   main_done, main_total, CASE WHEN main_total = 0 THEN 0 ELSE main_done * 100 // main_total END AS percent, today, last_24h, round(pace_s, 1) AS seconds_per_task, round(active_s / 3600, 1) AS active_hours,
   CASE WHEN pace_s <> 0 THEN round(rest * pace_s / 3600, 1) END AS hours_left, CASE WHEN days > 0 AND rest > 0 THEN CAST(ceil(rest / days) AS BIGINT) END AS needed_per_day,
   CAST(round_even(rate, 0) AS BIGINT) AS per_day, rate * greatest(days, 0) >= rest AS on_track FROM c)"""


@query("M3_state", PANEL + " SELECT annotator_id, state, percent FROM p")
def state(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("annotator_id", "state", "percent")


@query("M4_activity", PANEL + " SELECT annotator_id, first_activity, last_activity, idle FROM p")
def activity(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("annotator_id", "first_activity", "last_activity", "idle")


@query("M7_need", PANEL + " SELECT annotator_id, seconds_per_task, active_hours, hours_left, needed_per_day, per_day, on_track FROM p")
def need(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("annotator_id", "seconds_per_task", "active_hours", "hours_left", "needed_per_day", "per_day", "on_track")


@query("M8_by_modality", PANEL + f" SELECT mq.annotator_id, {list(MODALITIES)}[task_id % 5 + 1] AS modality, count(d.task_id) AS done, count(*) AS total FROM mq LEFT JOIN d ON d.annotator_id = mq.annotator_id AND d.task_id = mq.task_id GROUP BY 1, 2".replace("[task_id", "[mq.task_id"))
def by_modality(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.by_modality(queue(spark, sf), done(spark, sf), tasks(spark))


@query("Z17_sections", PANEL + f" SELECT mq.annotator_id, {list(MODALITIES)}[mq.task_id % 5 + 1] AS modality, bool_and(d.task_id IS NOT NULL) AS complete FROM mq LEFT JOIN d ON d.annotator_id = mq.annotator_id AND d.task_id = mq.task_id GROUP BY 1, 2")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Which modality sections of the queue are complete; a section without tasks isn't one."""
    return by_modality(spark, sf).select("annotator_id", "modality", (F.col("done") == F.col("total")).alias("complete"))


@query("M9_main_progress", PANEL + " SELECT annotator_id, today, last_24h, main_done, main_total FROM p")
def main_progress(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("annotator_id", "today", "last_24h", "main_done", "main_total")


@query("M10_totals", PANEL + " SELECT count(*) AS annotators, count(*) FILTER (WHERE state <> 'not_started') AS started, count(trained_at) AS trained, CAST(sum(main_done) AS BIGINT) AS main_done, CAST(sum(main_total) AS BIGINT) AS main_total, CAST(sum(today) AS BIGINT) AS today FROM p")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    sums = (F.sum(c).alias(c) for c in ("main_done", "main_total", "today"))
    return panel(spark, sf).agg(F.count("*").alias("annotators"), F.count_if(F.col("state") != "not_started").alias("started"), F.count("trained_at").alias("trained"), *sums)


@query("M11_training", PANEL + " SELECT annotator_id, training_done, training_total, trained_at FROM p")
def training(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("annotator_id", "training_done", "training_total", "trained_at")


@query(
    "W17_alerts",
    """WITH s AS (SELECT user_id, event_id, event_type AS state, value > 200 AS trained, value < 20 AS idle, CASE WHEN value > 100 THEN value < 400 END AS on_track FROM events),
 o AS (SELECT *, lag(state) OVER w AS s0, lag(trained) OVER w AS t0, lag(idle) OVER w AS i0, lag(on_track) OVER w AS k0 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT user_id, event_id, 'state ' || s0 || ' > ' || state AS alert FROM o WHERE s0 <> state UNION ALL SELECT user_id, event_id, 'trained' FROM o WHERE trained AND NOT t0
 UNION ALL SELECT user_id, event_id, 'idle' FROM o WHERE idle AND NOT i0 UNION ALL SELECT user_id, event_id, 'behind' FROM o WHERE NOT on_track AND coalesce(k0, TRUE) AND s0 IS NOT NULL""",
)
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("state"), (v > 200).alias("trained"), (v < 20).alias("idle"), F.when(v > 100, v < 400).alias("on_track"))
    return monitor.alerts(rows, "user_id", "event_id")


@query(
    "M13_failing_sites",
    """WITH c AS (SELECT user_id, event_id, event_type NOT IN ('error', 'view') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 x AS (SELECT *, lag(ok, 1) OVER w AS a, lag(ok, 2) OVER w AS b, lag(ok, 3) OVER w AS d FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id FROM x WHERE NOT ok AND NOT a AND NOT b AND coalesce(d, TRUE)""",
)
def failing(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.failing_sites(table(spark, sf, "events").select("user_id", "event_id", (~F.col("event_type").isin("error", "view")).alias("ok")), "user_id", "event_id")


def tasks(spark: SparkSession) -> DataFrame:
    return spark.range(1, 32).select(F.col("id").cast("int").alias("task_id"), F.get(F.array(*map(F.lit, MODALITIES)), (F.col("id") % 5).cast("int")).alias("modality"))


# Anchors: accounts by name; REF ones are the reference, which rates tasks of the stage's queue as well.
NAMED = """n AS (SELECT *, format('P{}-ZH-{:02d}', annotator_id % 3 + 1, annotator_id % 40) AS account FROM q),
 own AS (SELECT DISTINCT task_id, account FROM n WHERE phase = 'main' AND status = 'active' AND regexp_matches(account, '^P1-(ZH|EN)-[0-9]+$')), tr AS (SELECT DISTINCT task_id FROM n WHERE phase = 'training' AND task_id % 6 = 0),
 sub AS (SELECT event_id AS attempt_id, CASE WHEN user_id % 10 = 0 THEN format('REF-{:02d}', user_id // 10) ELSE format('P{}-ZH-{:02d}', user_id % 3 + 1, user_id % 40) END AS account, CAST(day(ts) AS INTEGER) AS task_id, event_type AS dimension, ts FROM events),
 last AS (SELECT account, task_id, dimension, arg_max(attempt_id, (ts, attempt_id)) AS attempt_id FROM sub WHERE dimension IN ('purchase', 'signup') GROUP BY 1, 2, 3),
 st AS (SELECT * FROM last WHERE task_id IN (SELECT task_id FROM own) AND task_id NOT IN (SELECT task_id FROM tr)),
 sides AS (SELECT *, CASE WHEN account LIKE 'REF-%' THEN 'reference' WHEN EXISTS (SELECT 1 FROM own o WHERE o.task_id = st.task_id AND o.account = st.account) THEN 'owner' END AS side FROM st),
 ready AS (SELECT task_id FROM sides WHERE side = 'reference' GROUP BY 1 HAVING count(DISTINCT dimension) = 2)"""
ANCHORS = f"WITH {QUEUE}, {NAMED}"


def named(spark: SparkSession, sf: str) -> DataFrame:
    who = F.col("annotator_id")
    return queue(spark, sf).withColumn("account", F.format_string("P%d-ZH-%02d", who % 3 + 1, who % 40))


def owners(spark: SparkSession, sf: str) -> DataFrame:
    return anchors.stage_queue(named(spark, sf), 1)


def trained_on(spark: SparkSession, sf: str) -> DataFrame:
    return named(spark, sf).where("phase = 'training' and task_id % 6 = 0").select("task_id").distinct()


def sides(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    account = F.when(u % 10 == 0, F.format_string("REF-%02d", F.floor(u / 10))).otherwise(F.format_string("P%d-ZH-%02d", u % 3 + 1, u % 40))
    sent = table(spark, sf, "events").where(F.col("event_type").isin(BOTH)).select(F.col("event_id").alias("attempt_id"), account.alias("account"), F.dayofmonth("ts").alias("task_id"), F.col("event_type").alias("dimension"), "ts")
    last = chains.latest(sent, ["account", "task_id", "dimension"], ["ts", "attempt_id"])
    return anchors.sides(last, owners(spark, sf), trained_on(spark, sf))


@query("Q1_stage_queue", ANCHORS + " SELECT task_id, string_agg(account, ',' ORDER BY account) AS owners FROM own GROUP BY 1")
def stage_queue(spark: SparkSession, sf: str) -> DataFrame:
    return owners(spark, sf).groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("account")), ",").alias("owners"))


@query("Q2_sides", ANCHORS + " SELECT account, task_id, dimension, attempt_id, side FROM sides WHERE side IS NOT NULL")
def anchor_sides(spark: SparkSession, sf: str) -> DataFrame:
    return sides(spark, sf).select("account", "task_id", "dimension", "attempt_id", "side")


@query("Q3_ready", ANCHORS + " SELECT o.account, count(*) AS ready FROM own o JOIN ready USING (task_id) GROUP BY 1")
def ready(spark: SparkSession, sf: str) -> DataFrame:
    return owners(spark, sf).join(anchors.ready(sides(spark, sf), BOTH), "task_id").groupBy("account").agg(F.count("*").alias("ready"))


@query("Q7_reference_progress", ANCHORS + """, qr AS (SELECT DISTINCT task_id FROM n WHERE status = 'active' AND is_anchor AND task_id % 2 = 0)
 SELECT (SELECT count(*) FROM qr WHERE task_id IN (SELECT task_id FROM own)) AS queued, (SELECT count(*) FROM ready) AS done, (SELECT count(*) FROM ready WHERE task_id IN (SELECT task_id FROM qr)) AS done_from_queue""")
def reference_progress(spark: SparkSession, sf: str) -> DataFrame:
    queued = named(spark, sf).where("status = 'active' and is_anchor and task_id % 2 = 0").select("task_id").distinct()
    return anchors.reference_progress(queued, owners(spark, sf), anchors.ready(sides(spark, sf), BOTH))


@query("J17_reference_fan_out", ANCHORS + """, r AS (SELECT task_id, dimension, arg_max(attempt_id, (account, attempt_id)) AS attempt_id FROM sides WHERE side = 'reference' GROUP BY 1, 2)
 SELECT o.account, o.task_id, d.dimension, r.attempt_id, CASE WHEN r.attempt_id % 3 = 0 THEN 'note ' || r.attempt_id END AS note FROM own o, (VALUES ('purchase'), ('signup')) d(dimension) LEFT JOIN r ON r.task_id = o.task_id AND r.dimension = d.dimension""")
def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    reference = chains.latest(sides(spark, sf).where("side = 'reference'"), ["task_id", "dimension"], ["account", "attempt_id"]).select("task_id", "dimension", "attempt_id")
    notes = reference.where("attempt_id % 3 = 0").select("task_id", "dimension", F.concat(F.lit("note "), F.col("attempt_id").cast("string")).alias("note"))
    return anchors.with_reference(owners(spark, sf), BOTH, reference, notes)


@query("Q11_hidden_reference", ANCHORS + ", r AS (SELECT task_id, dimension, max(attempt_id) AS attempt_id FROM last WHERE account LIKE 'REF-%' GROUP BY 1, 2) SELECT task_id, dimension, CASE WHEN task_id NOT IN (SELECT task_id FROM tr) THEN attempt_id END AS attempt_id FROM r")
def hidden_reference(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    sent = table(spark, sf, "events").where(F.col("event_type").isin(BOTH) & (u % 10 == 0)).select(F.col("event_id").alias("attempt_id"), u.alias("account"), F.dayofmonth("ts").alias("task_id"), F.col("event_type").alias("dimension"), "ts")
    last = chains.latest(sent, ["account", "task_id", "dimension"], ["ts", "attempt_id"]).groupBy("task_id", "dimension").agg(F.max("attempt_id").alias("attempt_id"))
    return anchors.hide_training(last, trained_on(spark, sf), "attempt_id")


@query("Q12_debrief_gate", f"WITH {TIMES}, {QUEUE}, tr AS (SELECT DISTINCT annotator_id, task_id FROM q WHERE phase = 'training' AND status = 'active') SELECT tr.annotator_id, {list(MODALITIES)}[tr.task_id % 5 + 1] AS modality, bool_and(done.task_id IS NOT NULL) AS unlocked FROM tr LEFT JOIN done ON done.annotator_id = tr.annotator_id AND done.task_id = tr.task_id GROUP BY 1, 2")
def debrief(spark: SparkSession, sf: str) -> DataFrame:
    training = queue(spark, sf).where("phase = 'training' and status = 'active'").select("annotator_id", "task_id").distinct().join(tasks(spark), "task_id")
    complete = completion.completion_times(submissions(spark, sf), BOTH).select("annotator_id", "task_id", F.lit(True).alias("c"))
    return training.join(complete, ["annotator_id", "task_id"], "left").groupBy("annotator_id", "modality").agg(F.bool_and(F.col("c").isNotNull()).alias("unlocked"))


@query("Q13_import_reference", """WITH l AS (SELECT day(ts) AS task_id, event_type AS dimension, arg_max(event_id, (ts, event_id)) AS attempt_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
 k AS (SELECT day(o_orderdate) AS task_id, o_orderpriority AS p, max(o_orderkey) AS o FROM orders GROUP BY 1, 2), old AS (SELECT task_id, 'view' AS dimension, 'kept ' || max(o) AS note FROM k GROUP BY 1)
 SELECT CAST(l.task_id AS INTEGER) AS task_id, l.dimension, l.attempt_id, CASE WHEN l.value > 90 THEN 'new ' || l.attempt_id ELSE old.note END AS note FROM l LEFT JOIN old ON old.task_id = l.task_id AND old.dimension = l.dimension""")
def import_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Reference curves from the latest submissions; a note is kept unless a new one comes with the curve."""
    rows = submissions(spark, sf)
    latest = chains.latest(rows, ["task_id", "dimension"], ["submitted_at", "submission_id"])
    new = latest.select("task_id", "dimension", F.col("submission_id").alias("attempt_id"), F.when(F.col("value") > 90, F.concat(F.lit("new "), F.col("submission_id").cast("string"))).alias("note"))
    old = table(spark, sf, "orders").groupBy(F.dayofmonth("o_orderdate").alias("task_id")).agg(F.concat(F.lit("kept "), F.max("o_orderkey").cast("string")).alias("note")).withColumn("dimension", F.lit("view"))
    return anchors.import_reference(new, old)


@query("P4_public_fields", f"WITH {QUEUE} SELECT assignment_id, annotator_id, task_id, phase FROM q WHERE status = 'active'")
def public_fields(spark: SparkSession, sf: str) -> DataFrame:
    """What an annotator may see of an assignment: nothing that tells anchors from others."""
    return queue(spark, sf).where("status = 'active'").select("assignment_id", "annotator_id", "task_id", "phase")


@query("Z19_status_listing", f"WITH {QUEUE} SELECT annotator_id, count(*) FILTER (WHERE status = 'active') AS assigned, count(*) FILTER (WHERE status = 'active' AND is_anchor) AS anchors FROM q GROUP BY 1")
def status_listing(spark: SparkSession, sf: str) -> DataFrame:
    active = F.col("status") == "active"
    return queue(spark, sf).groupBy("annotator_id").agg(F.count_if(active).alias("assigned"), F.count_if(active & F.col("is_anchor")).alias("anchors"))


@query("Z18_ticket_ids", f"WITH {QUEUE} SELECT assignment_id, format('{{}}-{{}}-{{:02d}}', annotator_id, {list(MODALITIES)}[task_id % 5 + 1], row_number() OVER (PARTITION BY annotator_id, task_id % 5 ORDER BY assignment_id)) AS ticket FROM q WHERE status = 'active'")
def ticket_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = queue(spark, sf).where("status = 'active'").join(tasks(spark), "task_id")
    nth = F.row_number().over(Window.partitionBy("annotator_id", "modality").orderBy("assignment_id"))
    return rows.select("assignment_id", F.format_string("%s-%s-%02d", F.col("annotator_id").cast("string"), "modality", nth).alias("ticket"))


@query("Q6_modality_order", ANCHORS + f" SELECT account, task_id, CAST(row_number() OVER (PARTITION BY account ORDER BY task_id % 5, task_id) AS INTEGER) AS place FROM own JOIN ready USING (task_id)")
def modality_order(spark: SparkSession, sf: str) -> DataFrame:
    """The order in which an annotator's compared anchors are shown: by modality, then task."""
    rows = owners(spark, sf).join(anchors.ready(sides(spark, sf), BOTH), "task_id").join(tasks(spark), "task_id")
    rank = F.array_position(F.array(*map(F.lit, MODALITIES)), F.col("modality"))
    return rows.select("account", "task_id", F.row_number().over(Window.partitionBy("account").orderBy(rank, "task_id")).alias("place"))


QUERIES, ORACLES = registry.queries, registry.oracles
