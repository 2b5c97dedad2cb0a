"""Queues, joins, audits, scalar functions and lifecycle on orders, customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake.functions import scalars
from curvelake.operators import allocation, lifecycle, quality, ranges
from curvelake.plans.chains import COMPLETE, complete, queue
from curvelake.scratch import folder
from curvelake.plans.registry import SUBMISSIONS, Registry, submissions, table

registry = Registry()
query = registry.query
RANKS = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END"


@query("P1_active_queue", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000")
def active(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") >= 100000)).select("o_orderkey", "o_custkey")


@query("P2_prefix_filter", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_name").startswith("red")).select("p_partkey", "p_name")


@query("P3_account_classes", r"""SELECT c_custkey, CAST(CAST(regexp_extract(c_name, '^Customer#0*(\d)(\d*)$', 1) AS INTEGER) AS INTEGER) AS stage, regexp_extract(c_name, '^Customer#0*(\d)(\d*)$', 2) AS number,
 regexp_matches(c_mktsegment, '^(BUILDING|MACHINERY)$') AS mirror FROM customer""")
def accounts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer")
    return rows.select("c_custkey", F.regexp_extract("c_name", r"^Customer#0*(\d)(\d*)$", 1).cast("int").alias("stage"), F.regexp_extract("c_name", r"^Customer#0*(\d)(\d*)$", 2).alias("number"), F.col("c_mktsegment").rlike("^(BUILDING|MACHINERY)$").alias("mirror"))


@query("P7_manifest_errors", """WITH d AS (SELECT p_brand, p_name FROM part GROUP BY 1, 2 HAVING count(*) > 1)
 SELECT p_partkey, list_filter([CASE WHEN p_size > 45 THEN 'size' END, CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL', 'LARGE', 'MEDIUM', 'STANDARD') THEN 'type' END, CASE WHEN d.p_brand IS NOT NULL THEN 'duplicate' END], lambda x: x IS NOT NULL) AS errors
 FROM part LEFT JOIN d ON part.p_brand = d.p_brand AND part.p_name = d.p_name""")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    twice = rows.groupBy("p_brand", "p_name").agg((F.count("*") > 1).alias("twice"))
    rules = (("size", F.col("p_size") > 45), ("type", ~F.col("p_type").isin("ECONOMY", "SMALL", "LARGE", "MEDIUM", "STANDARD")), ("duplicate", F.col("twice")))
    return rows.join(twice, ["p_brand", "p_name"]).select("p_partkey", F.array_compact(F.array(*(F.when(c, n) for n, c in rules))).alias("errors"))


@query("P8_enum_guard", "SELECT count(*) AS bad FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def enum_guard(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(~F.col("o_orderstatus").isin("O", "F")).agg(F.count("*").alias("bad"))


@query("J1_assignment_tasks", "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def assignments(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return own.join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")


@query("J2_optional_number", "SELECT c_custkey, max(o_orderkey) AS number FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY 1")
def optional_number(spark: SparkSession, sf: str) -> DataFrame:
    numbers = table(spark, sf, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("number"))
    return table(spark, sf, "customer").select("c_custkey").join(numbers, "c_custkey", "left")


@query("J3_composite_join", f"WITH {SUBMISSIONS}, q AS (SELECT DISTINCT CAST(o_custkey % 150 AS BIGINT) AS annotator_id, CAST(day(o_orderdate) AS INTEGER) AS task_id FROM orders WHERE o_orderstatus <> 'P') SELECT submission_id FROM submissions JOIN q USING (annotator_id, task_id)")
def composite(spark: SparkSession, sf: str) -> DataFrame:
    return submissions(spark, sf).join(queue(spark, sf), ["annotator_id", "task_id"]).select("submission_id")


@query("J4_in_queue", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def in_queue(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(own, "c_custkey", "left_semi")


@query("J5_candidate_anchors", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    drop = lambda rows, rule: rows.join(orders.where(rule).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return drop(drop(table(spark, sf, "customer").select("c_custkey"), "o_orderstatus = 'P'"), "o_orderpriority = '1-URGENT'")


@query("J7_missing_tasks", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem ANTI JOIN (SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_partkey % 10 = s_suppkey % 10) x ON l_partkey = p_partkey AND l_suppkey = s_suppkey")
def missing_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Line items without a task: their part or supplier is unknown, or the two don't go together. The pairs that do are never made."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey")).distinct().withColumn("part_", F.lit(True))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey")).distinct().withColumn("supplier_", F.lit(True))
    wanted = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    fits = F.col("part_") & F.col("supplier_") & (F.col("l_partkey") % 10 == F.col("l_suppkey") % 10)
    return wanted.join(part, "l_partkey", "left").join(supplier, "l_suppkey", "left").where(~F.coalesce(fits, F.lit(False))).select("l_partkey", "l_suppkey")


@query("J8_missing_samples", f"WITH {SUBMISSIONS}, want AS (SELECT annotator_id, unnest(range(1, 31)) AS task_id FROM (SELECT DISTINCT annotator_id FROM submissions)) SELECT annotator_id, CAST(task_id AS INTEGER) AS task_id FROM want ANTI JOIN submissions USING (annotator_id, task_id)")
def missing_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = submissions(spark, sf).select("annotator_id", "task_id").distinct()
    want = rows.select("annotator_id").distinct().select("annotator_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("task_id"))
    return want.join(rows, ["annotator_id", "task_id"], "left_anti")


@query("J9_latest_record", "SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def latest_record(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
    return table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left")


@query("J10_json_samples", "SELECT user_id, CAST(sum(CAST(props->>'k' AS INTEGER)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def json_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.from_json("props", "k int").alias("p"))
    return rows.groupBy("user_id").agg(F.sum("p.k").alias("total"), F.count("*").alias("n"))


SPANS = "WITH s AS (SELECT o_custkey AS key, epoch_us(o_orderdate) / 86400e6 AS start, epoch_us(o_orderdate) / 86400e6 + 20 AS stop FROM orders WHERE o_orderkey % 3 = 0), p AS (SELECT o_custkey AS key, o_orderkey AS id, epoch_us(o_orderdate) / 86400e6 AS at FROM orders)"


@query("J12_in_span", SPANS + " SELECT id, count(s.key) > 0 AS in_span FROM p LEFT JOIN s ON p.key = s.key AND p.at >= s.start - 0.15 AND p.at <= s.stop + 0.15 GROUP BY 1")
def in_span(spark: SparkSession, sf: str) -> DataFrame:
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), day.alias("at"))
    spans = rows.where("id % 3 = 0").select("key", F.col("at").alias("start"), (F.col("at") + 20).alias("stop"))
    return ranges.in_spans(rows, spans, width=60.0, slack=0.15).select("id", "in_span")


@query("J13_as_of", "WITH t AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view') SELECT t.event_id, v.value FROM t ASOF LEFT JOIN v ON t.user_id = v.user_id AND t.ts >= v.ts")
def as_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = rows.where("event_type = 'view'").select("user_id", "ts", "value")
    return ranges.as_of(left, right, "user_id", "ts", ["value"]).select("event_id", "value")


@query("J14_pool_expansion", "SELECT p_partkey, modality FROM part, (VALUES ('face'), ('voice'), ('text'), ('body'), ('audiovisual')) m(modality)")
def pool(spark: SparkSession, sf: str) -> DataFrame:
    five = F.array(*map(F.lit, ("face", "voice", "text", "body", "audiovisual")))
    return table(spark, sf, "part").select("p_partkey", F.explode(five).alias("modality"))


@query("J15_prototype_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON lower(trim(CAST(s_nationkey AS VARCHAR))) = lower(trim(CAST(n_nationkey AS VARCHAR)))")
def prototype_lookup(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    names = table(spark, sf, "nation").select(key("n_nationkey").alias("k"), "n_name")
    return table(spark, sf, "supplier").select("s_suppkey", key("s_nationkey").alias("k")).join(names, "k").drop("k")


@query("L1_queue_order", f"SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {RANKS}, o_orderkey) AS INTEGER) AS place FROM orders")
def queue_order(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))), F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "o_orderkey")).alias("place"))


@query("L3_recent", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 30")
def recent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.col("event_id").desc()).limit(30)


@query("L6_top_clusters", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY 1, 2) WHERE k <= 3")
def top_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), "first")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_type", "n")


@query("L7_argmax", "SELECT user_id, arg_max(event_id, (round(value, 0), -event_id)) AS best FROM events GROUP BY 1")
def argmax(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(F.round("value", 0), -F.col("event_id"))).alias("best"))


@query("W4_ticket_labels", "SELECT o_orderkey, 'S' || (o_custkey % 5) || '-' || row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS ticket FROM orders")
def tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Running number of each (annotator, modality); rows of every status and phase use up numbers."""
    n = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.format_string("S%d-%d", F.col("o_custkey") % 5, n).alias("ticket"))


@query("A10_integrity", "SELECT 'part' AS side, l_partkey AS key, count(DISTINCT l_suppkey) AS others FROM lineitem GROUP BY 2 HAVING count(DISTINCT l_suppkey) > 1 UNION ALL SELECT 'order', l_orderkey, count(DISTINCT l_returnflag) FROM lineitem GROUP BY 2 HAVING count(DISTINCT l_returnflag) > 2")
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    side = lambda name, key, other, n: rows.groupBy(F.col(key).alias("key")).agg(F.count_distinct(other).alias("others")).where(F.col("others") > n).select(F.lit(name).alias("side"), "key", "others")
    return side("part", "l_partkey", "l_suppkey", 1).union(side("order", "l_orderkey", "l_returnflag", 2))


@query("A11_submitted_drafts", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS submitted, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS drafts, count(*) AS total FROM orders GROUP BY 1")
def drafts(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda s: F.sum((F.col("o_orderstatus") == s).cast("int"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(one("F").alias("submitted"), one("P").alias("drafts"), F.count("*").alias("total"))


@query("A12_pivot_rollup", "SELECT o_orderpriority AS source, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def pivot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").rollup(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("A13_plan_audit", """WITH p AS (SELECT o_custkey AS annotator_id, o_orderpriority AS modality, CAST(day(o_orderdate) AS INTEGER) AS sample_id FROM orders),
 e AS (SELECT annotator_id, count(*) AS n, count(DISTINCT sample_id) AS samples FROM p GROUP BY 1), d AS (SELECT count(*) - 1 AS x FROM p GROUP BY annotator_id, sample_id, modality)
 SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS annotators, min(n) AS least, max(n) AS most, CAST(sum(n - samples) AS BIGINT) AS repeat_samples, (SELECT CAST(sum(x) AS BIGINT) FROM d) AS duplicates, (SELECT count(DISTINCT sample_id) FROM p) AS samples FROM e""")
def plan_audit(spark: SparkSession, sf: str) -> DataFrame:
    return allocation.audit(table(spark, sf, "orders").select(F.col("o_custkey").alias("annotator_id"), F.col("o_orderpriority").alias("modality"), F.dayofmonth("o_orderdate").alias("sample_id")))


@query("A17_outcome_tally", "SELECT CASE WHEN value >= 270 THEN 'ok' WHEN value >= 140 THEN 'needs_review' ELSE 'deferred' END AS status, count(*) AS n FROM events GROUP BY 1")
def tally(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("value") >= 270, "ok").when(F.col("value") >= 140, "needs_review").otherwise("deferred")
    return table(spark, sf, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("C2_fair_shares", "WITH l AS (SELECT s_suppkey AS annotator_id, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1) SELECT annotator_id, round(greatest((SELECT sum(n) / count(*) FROM l) - n, 0), 6) AS capacity FROM l")
def fair_shares(spark: SparkSession, sf: str) -> DataFrame:
    load = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("annotator_id")).agg(F.count("*").alias("n"))
    return allocation.fair_shares(load, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("annotator_id"))).withColumn("capacity", F.round("capacity", 6))


QUEUED = f"""WITH {COMPLETE}, q AS (SELECT CAST(min(o_orderkey) AS BIGINT) AS assignment_id, CAST(o_custkey % 150 AS BIGINT) AS annotator_id, CAST(day(o_orderdate) + CASE WHEN o_custkey % 150 = 9 THEN 100 ELSE 0 END AS INTEGER) AS task_id,
 CASE WHEN day(o_orderdate) < 4 THEN 'training' ELSE 'main' END AS phase, CAST(min(o_orderkey) % 1000 AS BIGINT) AS order_index, CASE WHEN arg_min(o_orderstatus, o_orderkey) = 'P' THEN 'released' ELSE 'active' END AS status FROM orders GROUP BY 2, 3, 4),
 m AS (SELECT *, row_number() OVER (ORDER BY order_index, assignment_id) - 1 AS place FROM q WHERE annotator_id = 4 AND phase = 'main' AND status = 'active' AND task_id NOT IN (SELECT task_id FROM complete WHERE annotator_id = 4))"""


def queued(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A queue with phases, its tasks and its accounts: a person's orders on a day are an assignment; one has tasks of their own."""
    who, day = F.col("o_custkey") % 150, F.dayofmonth("o_orderdate")
    rows = table(spark, sf, "orders").select(who.alias("annotator_id"), (day + F.when(who == 9, 100).otherwise(0)).alias("task_id"), F.when(day < 4, "training").otherwise("main").alias("phase"), "o_orderkey", (F.col("o_orderstatus") == "P").alias("p"))
    own = rows.groupBy("annotator_id", "task_id", "phase").agg(F.min("o_orderkey").alias("assignment_id"), F.when(F.min_by("p", "o_orderkey"), "released").otherwise("active").alias("status"))
    own = own.select("assignment_id", "annotator_id", "task_id", "phase", (F.col("assignment_id") % 1000).alias("order_index"), "status", F.lit(None).cast("long").alias("replaces"))
    return own, own.select("task_id", (F.col("task_id") % 10 == 0).alias("exclusive")).distinct(), own.select("annotator_id", (F.col("annotator_id") != 10).alias("reads_all")).distinct()


@query("X9_transfer", f"""{QUEUED} SELECT assignment_id, annotator_id, task_id, phase, order_index, CASE WHEN assignment_id IN (SELECT assignment_id FROM m) THEN 'released' ELSE status END AS status, CAST(NULL AS BIGINT) AS replaces FROM q
 UNION ALL SELECT (SELECT max(assignment_id) FROM q) + place + 1, 9, task_id, phase, (SELECT coalesce(max(order_index), -1) FROM q WHERE annotator_id = 9 AND phase = 'main') + place + 1, 'active', assignment_id FROM m""")
def transfer(spark: SparkSession, sf: str) -> DataFrame:
    """The whole queue after a transfer, made current as one."""
    queue, tasks, accounts = queued(spark, sf)
    held = lifecycle.Snapshots(spark, folder(spark, "queue"), "assignment_id long, annotator_id long, task_id int, phase string, order_index long, status string, replaces long")
    held.swap(queue)
    refused = held.swap(*lifecycle.transfer(held.current(), complete(spark, sf), tasks, accounts, 4, 9))
    if refused:
        raise ValueError(refused)
    return held.current()


@query("X9_refused", f"""{QUEUED} SELECT 'held' AS what, task_id FROM m WHERE task_id IN (SELECT task_id FROM q WHERE annotator_id = 10 AND phase = 'main') UNION ALL SELECT 'language', task_id FROM m WHERE task_id % 10 = 0""")
def refused_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """What forbids a transfer to someone who has some of the tasks and doesn't read the language of others."""
    queue, tasks, accounts = queued(spark, sf)
    return lifecycle.transfer(queue, complete(spark, sf), tasks, accounts, 4, 10)[1]


@query("X14_phase_unlock", f"WITH {COMPLETE}, t AS (SELECT DISTINCT CAST(o_custkey % 150 AS BIGINT) AS annotator_id, CAST(day(o_orderdate) AS INTEGER) AS task_id FROM orders WHERE o_orderpriority = '5-LOW') SELECT t.annotator_id, bool_and(c.task_id IS NOT NULL) AS unlocked FROM t LEFT JOIN complete c USING (annotator_id, task_id) GROUP BY 1")
def unlock(spark: SparkSession, sf: str) -> DataFrame:
    training = table(spark, sf, "orders").where("o_orderpriority = '5-LOW'").select((F.col("o_custkey") % 150).alias("annotator_id"), F.dayofmonth("o_orderdate").alias("task_id")).distinct()
    return lifecycle.unlocked(training, complete(spark, sf))


@query("X15_set_durations", "SELECT p_partkey AS task_id, CASE WHEN abs(m.d - p_retailprice) > 1e-6 THEN m.d ELSE p_retailprice END AS duration, coalesce(abs(m.d - p_retailprice) > 1e-6, FALSE) AS changed, m.d IS NULL AS missing FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) + 880 AS d FROM lineitem WHERE l_tax > 0.03 GROUP BY 1) m ON p_partkey = l_partkey")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    measured = table(spark, sf, "lineitem").where("l_tax > 0.03").groupBy(F.col("l_partkey").alias("task_id")).agg((F.max("l_quantity") + 880).alias("duration"))
    return lifecycle.set_durations(table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_retailprice").alias("duration")), measured)


@query("X8_task_upsert", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 UNION ALL SELECT p_partkey, upper(p_name), p_size FROM part WHERE p_size < 10")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return lifecycle.upsert(stored, stored.where("p_size < 10").withColumn("p_name", F.upper("p_name")), "p_partkey", "p_name")[0]


@query("F1_dataset_prefix", "SELECT p_partkey, split_part(p_name, ' ', 1) AS dataset FROM part")
def dataset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", scalars.prefix(F.col("p_name"), " ").alias("dataset"))


@query(
    "F2_clean_name",
    r"""SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 'Richard' || chr(8217) || 's Date' WHEN 5 THEN NULL
 WHEN 6 THEN 'Flight Attendant' WHEN 7 THEN 'None' ELSE trim(c_name) END AS name FROM customer""",
)
def clean_name(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.array(*map(F.lit, ("PERSON3", " Moderator ", "member-girl", "  ", "Richard\x92s Date", "Unknown 12", " Flight Attendant", "None")))
    k = (F.col("c_custkey") % 9).cast("int")
    return table(spark, sf, "customer").select("c_custkey", scalars.clean_speaker(F.when(k == 8, F.col("c_name")).otherwise(F.get(raw, k))).alias("name"))


@query("F3_format_ids", "SELECT s_suppkey, format('S{:04d}', s_suppkey) AS display_id, format('P{:d}-L{:d}-{:02d}', s_suppkey % 3 + 1, s_nationkey, s_suppkey % 100) AS account FROM supplier")
def format_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", F.format_string("S%04d", "s_suppkey").alias("display_id"), F.format_string("P%d-L%d-%02d", F.col("s_suppkey") % 3 + 1, "s_nationkey", F.col("s_suppkey") % 100).alias("account"))


@query("F4_next_number", r"SELECT p_type, max(TRY_CAST(substr(p_brand, 7) AS INTEGER)) + 1 AS next FROM part GROUP BY 1")
def next_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_type").agg((F.max(F.expr("try_cast(substr(p_brand, 7) as int)")) + 1).alias("next"))


@query("F11_clamp", "SELECT event_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 200 - 1)) AS v FROM events")
def clamp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", scalars.clamp(F.col("value") / 200 - 1).alias("v"))


@query("F19_arousal_width", "SELECT event_id, round(0.015 + greatest(0.0, least(1.0, (value / 250) / 2)) * 0.205, 9) AS w FROM events")
def width(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(scalars.half_width(F.col("value") / 250 - 1), 9).alias("w"))


@query("F22_percentages", "SELECT o_custkey, CASE WHEN count(*) = 0 THEN 0 ELSE CAST(floor(count(*) FILTER (WHERE o_orderstatus = 'F') * 100 / count(*)) AS BIGINT) END AS percent, CAST(ceil(sum(o_totalprice) / 7) AS BIGINT) AS per_day FROM orders GROUP BY 1")
def percentages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(scalars.floor_percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("percent"), F.ceil(scalars.exact_sum(F.col("o_totalprice")) / 7).cast("long").alias("per_day"))


@query("F24_json_default", "SELECT event_id, coalesce(TRY_CAST(props->>'k' AS INTEGER), -1) AS k, coalesce(TRY_CAST(props->>'filled' AS BOOLEAN), FALSE) AS filled FROM events")
def json_default(spark: SparkSession, sf: str) -> DataFrame:
    get = lambda name, kind: F.expr(f"try_cast(get_json_object(props, '$.{name}') as {kind})")
    return table(spark, sf, "events").select("event_id", F.coalesce(get("k", "int"), F.lit(-1)).alias("k"), F.coalesce(get("filled", "boolean"), F.lit(False)).alias("filled"))


@query("Z1_stratified_sample", "SELECT p_type, least(count(*), 10) AS n, least(count(*), 10) AS different FROM part GROUP BY 1")
def stratified(spark: SparkSession, sf: str) -> DataFrame:
    """How many each stratum's sample has; which they are is drawn by hash and seed."""
    drawn = quality.stratified(table(spark, sf, "part"), "p_type", "p_partkey", 10, 7)
    return drawn.groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("different"))


@query("Z2_look_ahead", "SELECT event_id, coalesce(array_to_string([lead(event_id, 1) OVER w, lead(event_id, 2) OVER w], ','), '') AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def look_ahead(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", F.concat_ws(",", F.lead("event_id", 1).over(w).cast("string"), F.lead("event_id", 2).over(w).cast("string")).alias("ahead"))


@query("Z3_spaced_positions", "SELECT p_partkey, array_to_string(list_distinct([CAST(floor(p_size * (0.06::DOUBLE + 0.88::DOUBLE * (i + 0.5::DOUBLE) / 9)) AS BIGINT) FOR i IN range(0, 9)]).list_sort(), ',') AS positions FROM part")
def spaced(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(scalars.spaced(F.col("p_size"))).cast("array<string>"), ",").alias("positions"))


@query("Z17_all_complete", "SELECT c_custkey, count(o_orderkey) > 0 AND coalesce(bool_and(o_orderstatus = 'F'), FALSE) AS all_complete, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def all_complete(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_and(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(own, "c_custkey", "left").select("c_custkey", F.coalesce("a", F.lit(False)).alias("all_complete"), F.coalesce("n", F.lit(0)).alias("completed"))


@query("Z22_familiarisation_plays", "SELECT p_partkey, p_size % 4 + least(1, p_retailprice / 1000) AS plays FROM part")
def plays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4 + F.least(F.lit(1.0), F.col("p_retailprice") / 1000)).alias("plays"))


QUERIES, ORACLES = registry.queries, registry.oracles
