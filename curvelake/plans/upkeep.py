"""Upkeep of stores and queues, and the small rules: submission, recovery, replacement, mirrors, purge, files and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake.functions import scalars
from curvelake.operators import chains, costs, curves, geometry, lifecycle, picks, roster
from curvelake.plans import panel
from curvelake.plans.registry import SUBMISSIONS, Registry, submissions, table
from curvelake.scratch import folder
from curvelake.sources import files

registry = Registry()
query = registry.query

SUBMIT = """a AS (SELECT event_id AS attempt_id, user_id AS annotator_id, CAST(day(ts) AS INTEGER) AS task_id, event_type AS dimension, ts, CASE WHEN value < 15 THEN 'preview' ELSE 'annotation' END AS mode, CASE WHEN value > 150 THEN 'recording' ELSE 'completed' END AS status FROM events),
 stored AS (SELECT attempt_id * 10 AS submission_id, * FROM a WHERE attempt_id % 3 = 0 AND mode = 'annotation' AND status = 'completed'),
 sent AS (SELECT attempt_id * 10 AS submission_id, attempt_id, ts FROM a WHERE attempt_id % 3 < 2 UNION ALL SELECT attempt_id * 10 + 5, attempt_id, ts + INTERVAL 1 SECOND FROM a WHERE attempt_id % 2 = 0),
 f AS (SELECT s.* FROM sent s WHERE submission_id NOT IN (SELECT submission_id FROM stored) AND attempt_id NOT IN (SELECT attempt_id FROM stored)),
 one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY ts, submission_id) = 1),
 j AS (SELECT one.submission_id, one.ts AS submitted_at, a.* FROM one JOIN a USING (attempt_id)),
 al AS (SELECT submission_id, annotator_id, task_id, dimension, ts AS submitted_at, FALSE AS new FROM stored UNION ALL SELECT submission_id, annotator_id, task_id, dimension, submitted_at, TRUE FROM j WHERE mode = 'annotation' AND status = 'completed'),
 n AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS revision, lag(submission_id) OVER w AS previous_id FROM al WINDOW w AS (PARTITION BY annotator_id, task_id, dimension ORDER BY submitted_at, submission_id))"""


def submitted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v, k = F.col("value"), F.col("attempt_id")
    a = table(spark, sf, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("annotator_id"), F.dayofmonth("ts").alias("task_id"), F.col("event_type").alias("dimension"), F.col("ts").alias("submitted_at"),
        F.when(v < 15, "preview").otherwise("annotation").alias("mode"), F.when(v > 150, "recording").otherwise("completed").alias("status"),
    )
    stored = a.where((k % 3 == 0) & (F.col("mode") == "annotation") & (F.col("status") == "completed")).withColumn("submission_id", k * 10)
    first = a.where(k % 3 < 2).select((k * 10).alias("submission_id"), "attempt_id", "submitted_at")
    again = a.where(k % 2 == 0).select((k * 10 + 5).alias("submission_id"), "attempt_id", (F.col("submitted_at") + F.expr("INTERVAL '1' SECOND")).alias("submitted_at"))
    return lifecycle.submit(stored, a.drop("submitted_at"), first.unionByName(again))


@query("X3_submit", f"WITH {SUBMIT} SELECT submission_id, revision, previous_id FROM n WHERE new")
def submit(spark: SparkSession, sf: str) -> DataFrame:
    return submitted(spark, sf)[0].select("submission_id", "revision", "previous_id")


@query("X3_refused", f"WITH {SUBMIT} SELECT submission_id, CASE WHEN mode <> 'annotation' THEN 'preview' ELSE 'unfinished' END AS reason FROM j WHERE mode <> 'annotation' OR status <> 'completed'")
def refused(spark: SparkSession, sf: str) -> DataFrame:
    return submitted(spark, sf)[1]


@query("X2_attempt_upsert", "SELECT user_id, day(ts) AS client_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def attempt_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts that a client sends again under its own id: the last received counts."""
    rows = table(spark, sf, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("client_id"), "value", "ts", "event_id")
    return chains.latest(rows, ["user_id", "client_id"], ["ts", "event_id"]).select("user_id", "client_id", "value")


@query("X6_recover", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'interrupted' ELSE event_type END AS new_status, CASE WHEN event_type IN ('view', 'click') THEN 'recovered' END AS event FROM events")
def recover(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "recording").when(F.col("event_type") == "click", "paused").otherwise(F.col("event_type"))
    return lifecycle.recover(table(spark, sf, "events").select("event_id", status.alias("status"))).select("event_id", "new_status", "event")


REPLACE = f"""{panel.QUEUE}, old AS (SELECT annotator_id, phase, task_id, min(assignment_id) AS order_index FROM q GROUP BY 1, 2, 3), su AS (SELECT DISTINCT user_id AS annotator_id, CAST(day(ts) AS INTEGER) AS task_id FROM events WHERE value > 60),
 nw AS (SELECT CAST(c_custkey % 170 AS BIGINT) AS annotator_id, 'main' AS phase, CAST(c_custkey % 40 AS INTEGER) AS sample_id, ['face', 'text'][c_custkey % 2 + 1] AS modality, c_custkey AS order_index FROM customer),
 ix AS (SELECT s.sample_id, m.modality, s.sample_id AS task_id FROM (SELECT CAST(unnest(range(0, 35)) AS INTEGER) AS sample_id) s, (SELECT unnest(['face', 'text']) AS modality) m),
 begun AS (SELECT DISTINCT old.annotator_id, old.phase FROM old SEMI JOIN su ON old.annotator_id = su.annotator_id AND old.task_id = su.task_id),
 fr AS (SELECT * FROM nw ANTI JOIN begun ON nw.annotator_id = begun.annotator_id AND nw.phase = begun.phase)"""


def replaced(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old = panel.queue(spark, sf).groupBy("annotator_id", "phase", "task_id").agg(F.min("assignment_id").alias("order_index"))
    k = F.col("c_custkey")
    modality = F.get(F.array(F.lit("face"), F.lit("text")), (k % 2).cast("int"))
    new = table(spark, sf, "customer").select((k % 170).alias("annotator_id"), F.lit("main").alias("phase"), (k % 40).cast("int").alias("sample_id"), modality.alias("modality"), k.alias("order_index"))
    index = spark.range(35).select(F.col("id").cast("int").alias("sample_id"), F.explode(F.array(F.lit("face"), F.lit("text"))).alias("modality"), F.col("id").cast("int").alias("task_id"))
    sent = submissions(spark, sf).where("value > 60").select("annotator_id", "task_id")
    return lifecycle.replace_queue(old, new, index, sent)


@query("X7_replace_queue", f"WITH {REPLACE} SELECT annotator_id, phase, task_id, order_index FROM old ANTI JOIN fr ON old.annotator_id = fr.annotator_id AND old.phase = fr.phase UNION ALL SELECT fr.annotator_id, fr.phase, ix.task_id, fr.order_index FROM fr JOIN ix USING (sample_id, modality)")
def replace_queue(spark: SparkSession, sf: str) -> DataFrame:
    return replaced(spark, sf)[0]


@query("X7_not_replaced", f"WITH {REPLACE} SELECT DISTINCT annotator_id, phase, 'begun' AS what FROM nw SEMI JOIN begun ON nw.annotator_id = begun.annotator_id AND nw.phase = begun.phase UNION ALL SELECT annotator_id, phase, sample_id || '::' || modality FROM fr WHERE sample_id >= 35")
def not_replaced(spark: SparkSession, sf: str) -> DataFrame:
    return replaced(spark, sf)[1]


@query("X10_mirror", f"WITH {panel.QUEUE} SELECT annotator_id, phase, task_id, assignment_id, status FROM q WHERE annotator_id <> 5 UNION ALL SELECT 5, phase, task_id, assignment_id, status FROM q WHERE annotator_id = 4 AND status = 'active'")
def mirror(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.mirror(panel.queue(spark, sf).select("annotator_id", "phase", "task_id", "assignment_id", "status"), 4, 5)


@query("X11_training_template", "WITH a AS (SELECT c_custkey AS annotator_id, CASE WHEN c_nationkey % 2 = 0 THEN 'zh' ELSE 'en' END AS language FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')) SELECT a.annotator_id, s_suppkey AS task_id, s_suppkey AS order_index FROM a JOIN supplier ON (s_suppkey % 3 = 0) = (language = 'zh')")
def training_template(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("annotator_id"), F.when(F.col("c_nationkey") % 2 == 0, "zh").otherwise("en").alias("language"))
    template = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "zh").otherwise("en").alias("language"), F.col("s_suppkey").alias("task_id"), F.col("s_suppkey").alias("order_index"))
    having = table(spark, sf, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("annotator_id"))
    return lifecycle.copy_template(template, people, having)


@query("X13_purge", f"WITH {panel.QUEUE} SELECT 'assignments' AS name, count(*) AS n FROM q WHERE annotator_id <> 7 UNION ALL SELECT 'submissions', count(*) FROM events WHERE user_id <> 7")
def purge(spark: SparkSession, sf: str) -> DataFrame:
    queue = panel.queue(spark, sf).withColumn("replaces", F.lit(None).cast("long"))
    left = lifecycle.purge({"assignments": queue, "submissions": submissions(spark, sf)}, queue, 7)
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in left.items()]
    return counts[0].union(counts[1])


@query("X16_flags", "SELECT user_id, count(*) AS flags, arg_max(event_type, event_id) AS latest FROM events WHERE event_type IN ('view', 'error') GROUP BY 1")
def flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags are only ever added: appended in two writes, read as one, of which the last counts."""
    path = folder(spark, "flags")
    rows = table(spark, sf, "events").where("event_type in ('view', 'error')").select("user_id", "event_id", "event_type")
    for kind in ("view", "error"):
        files.append_json_lines(rows.where(F.col("event_type") == kind), path)
    read = files.read_json_lines(spark, path, "user_id long, event_id long, event_type string")
    return read.groupBy("user_id").agg(F.count("*").alias("flags"), F.max_by("event_type", "event_id").alias("latest"))


@query("K5_reassembly", "SELECT user_id AS attempt_id, CAST(event_id AS INTEGER) AS chunk_index, CAST(p AS INTEGER) AS pos, value + p AS v FROM events, range(0, 2) r(p)")
def reassembly(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that came late and twice, in the order of their index; of copies the first counts."""
    sample = lambda x: F.struct(x.cast("double").alias("v"))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("attempt_id"), F.col("event_id").cast("int").alias("chunk_index"), F.array(sample(F.col("value")), sample(F.col("value") + 1)).alias("samples"), F.lit(1).alias("created_at"))
    late = rows.where("chunk_index % 2 = 0").withColumn("samples", F.array(sample(F.lit(-1)))).withColumn("created_at", F.lit(2))
    return curves.trajectory(late.unionByName(rows))


@query("T10_latest_by_time", f"WITH {SUBMISSIONS}, l AS (SELECT task_id, max((submitted_at, submission_id)) AS k FROM submissions GROUP BY 1) SELECT s.task_id, s.submission_id, s.value FROM submissions s JOIN l ON l.task_id = s.task_id AND s.submission_id = l.k[2] WHERE value < 480")
def latest_by_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = chains.latest(submissions(spark, sf), ["task_id"], ["submitted_at", "submission_id"])
    return rows.where("value < 480").select("task_id", "submission_id", "value")


@query("S2_pool", "SELECT p_type || '_' || p_partkey AS sample_id, p_type AS source FROM part")
def pool(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "pool")
    table(spark, sf, "part").select(F.concat_ws("_", "p_type", F.col("p_partkey").cast("string")).alias("sample_id"), F.col("p_type").alias("source")).write.json(path)
    return files.read_json_lines(spark, path, "sample_id string, source string")


@query("S5_shard_glob", "SELECT p_partkey, p_name FROM part")
def shard_glob(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "shards")
    for i in range(3):
        files.shard(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", i, 3).write.json(f"{path}/shard-{i}")
    return files.read_keyed(spark, f"{path}/shard-*", "p_partkey long, p_name string", "p_partkey")


@query("S7_csv_index", "SELECT format('dia{}_utt{}', p_size, p_partkey) AS id, p_name FROM part")
def csv_index(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "index")
    table(spark, sf, "part").select("p_size", "p_partkey", "p_name").write.option("header", True).csv(path)
    return files.read_csv(spark, path, "p_size int, p_partkey long, p_name string", ["p_size", "p_partkey"], "dia%d_utt%d").select("id", "p_name")


@query("S10_manifest", "SELECT p_partkey AS task_id, CASE WHEN p_size < 20 THEN upper(p_name) ELSE p_name END AS src FROM part")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest read from JSON, over what is stored."""
    path = folder(spark, "manifest")
    stored = table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("src"), "p_size")
    stored.where("p_size < 20").select("task_id", F.upper("src").alias("src")).write.json(path)
    return lifecycle.upsert(stored.drop("p_size"), files.read_json_lines(spark, path, "task_id long, src string"), "task_id", "src")[0]


@query("S13_bundle", "SELECT CAST(row_number() OVER (ORDER BY p, annotator_id) AS BIGINT) AS place, annotator_id, n FROM (SELECT o_custkey AS annotator_id, min(o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY 1)")
def bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The order of all annotators' documents: by phase, then account."""
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("annotator_id")).agg(F.min("o_orderpriority").alias("p"), F.count("*").alias("n"))
    from curvelake.operators.allocation import numbered

    return numbered(rows, [F.col("p"), F.col("annotator_id")], "k").select((F.col("k") + 1).alias("place"), "annotator_id", "n")


@query("P9_language_exclusive", "SELECT p_partkey, p_size % 5 IN (3, 4) AND p_size % 3 = 0 AS exclusive FROM part")
def language_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    modality = F.get(F.array(*map(F.lit, ("face", "body", "audio", "text", "audiovisual"))), F.col("p_size") % 5)
    sample = F.concat(F.when(F.col("p_size") % 3 == 0, "chsims_").otherwise("iemocap_"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", scalars.language_exclusive(modality, sample).alias("exclusive"))


@query("A18_cost", "SELECT user_id, count(*) AS calls, sum(event_id % 1000) AS tokens_in, sum(event_id % 70) AS tokens_out, round(sum(event_id % 1000) / 1e6 * 0.5 + sum(event_id % 70) / 1e6 * 3.0, 9) AS cost FROM events GROUP BY 1")
def cost(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 70).alias("tokens_out"))
    return costs.by_key(rows, "user_id", 0.5, 3.0).withColumn("cost", F.round("cost", 9))


@query("L4_begun", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS begun FROM customer")
def begun(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return roster.begun(table(spark, sf, "customer").select("c_custkey"), rows, "c_custkey")


@query("L9_last_of_any", "SELECT c_custkey, greatest((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')) AS last FROM customer")
def last_of_any(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return roster.last_of_any(table(spark, sf, "customer").select("c_custkey"), rows, "c_custkey", "o_orderkey", [F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW"])


@query("U6_skip_sets", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def skip_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    return roster.skip_set("o_custkey", rows.where("o_orderpriority = '5-LOW'"), rows.where("o_orderstatus = 'P'"))


@query("F8_spacing", "SELECT p_partkey, 'see ' || split_part(p_name, ' ', 1) || CASE WHEN p_size % 2 = 0 THEN '你好' ELSE ' end' END AS text FROM part")
def spacing(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.array(F.lit("see"), F.substring_index("p_name", " ", 1), F.when(F.col("p_size") % 2 == 0, "你").otherwise("end"), F.when(F.col("p_size") % 2 == 0, "好").otherwise(""))
    step = lambda s, x: F.struct(F.concat(s["text"], F.when(scalars.needs_blank(s["before"], x), " ").otherwise(""), x).alias("text"), x.alias("before"))
    return table(spark, sf, "part").select("p_partkey", F.aggregate(tokens, F.struct(F.lit("").alias("text"), F.lit("").alias("before")), step)["text"].alias("text"))


@query("F9_spoken", "SELECT event_id, value <= 30 AS spoken FROM events")
def spoken(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", (F.col("value") <= 30).alias("spoken"))


@query("F10_translation_lint", """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'really,never' WHEN 1 THEN '' WHEN 2 THEN 'so' WHEN 3 THEN '' WHEN 4 THEN 'even' ELSE '' END AS strong, p_size % 6 = 5 AS bang,
 p_size % 6 IN (3, 4) AS skewed FROM part""")
def lint(spark: SparkSession, sf: str) -> DataFrame:
    pairs = (("他去学校了", "He really never went"), ("他真的去了", "He really went"), ("他很烦人啊", "He is so annoying"), ("他去了所以我也去了很久", "He, so I"), ("他去", "Even he"), ("他今天走了", "He left today!"))
    k = F.col("p_size") % 6
    zh, en = (F.get(F.array(*(F.lit(p[i]) for p in pairs)), k) for i in (0, 1))
    ratio = scalars.word_ratio(zh, en)
    return table(spark, sf, "part").select("p_partkey", F.array_join(scalars.unlicensed(zh, en), ",").alias("strong"), (en.contains("!") & ~zh.contains("！")).alias("bang"), ((ratio > 0.95) | (ratio < 0.3)).alias("skewed"))


@query("F17_rational_rate", "SELECT p_partkey, p_size, p_partkey * 24 // gcd(p_partkey * 24, p_size * 7 + 1001) || '/' || (p_size * 7 + 1001) // gcd(p_partkey * 24, p_size * 7 + 1001) AS rate FROM part")
def rational_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Rates over denominators of 1008 to 1351, which come back in lowest terms."""
    return table(spark, sf, "part").select("p_partkey", "p_size", scalars.rational_rate(F.col("p_partkey") * 24 / (F.col("p_size") * 7 + 1001)).alias("rate"))


@query("F18_utc_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || strftime(ts, '%f') ELSE '' END || '+00:00' AS at FROM events".replace(" AS at ", ' AS "at" '))
def utc_iso(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", scalars.utc_iso(F.col("ts")).alias("at"))


@query("F21_crop_rule", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'crop=640:' || (p_size * 10 + 100) * 82 // 100 // 2 * 2 || ':0:0' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'fixed' END END AS crop FROM part")
def crop_rule(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(F.lit("chsims_"), F.lit("iemocap_"), F.lit("mosi_")), F.col("p_size") % 3)
    height = F.when(F.col("p_size") % 3 == 1, F.when(F.col("p_size") % 2 == 0, 480).otherwise(400)).otherwise(F.col("p_size") * 10 + 100)
    width = F.when(F.col("p_size") % 3 == 1, 360).otherwise(640)
    return table(spark, sf, "part").select("p_partkey", scalars.crop_rule(F.concat(kind, F.lit("1")), width, height).alias("crop"))


@query("F23_token_hash", "SELECT c_custkey, sha256(c_name) AS hash FROM customer")
def token_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", scalars.token_hash(F.col("c_name")).alias("hash"))


@query("F25_asset_urls", "SELECT p_partkey, format('/media/{}/S{:04d}.{}', m, p_partkey, CASE m WHEN 'audio' THEN 'm4a' WHEN 'text' THEN 'json' ELSE 'mp4' END) AS url FROM (SELECT p_partkey, ['face', 'body', 'audio', 'text', 'full'][p_size % 5 + 1] AS m FROM part)")
def asset_urls(spark: SparkSession, sf: str) -> DataFrame:
    from curvelake.operators.allocation import asset

    modality = F.get(F.array(*map(F.lit, panel.MODALITIES)), F.col("p_size") % 5)
    return table(spark, sf, "part").select("p_partkey", asset(modality, F.format_string("S%04d", "p_partkey")).alias("url"))


@query("Z12_roster", r"SELECT c_custkey, CASE WHEN NOT regexp_matches(a, '^P\d+-(ZH|EN)-\d+$') THEN 'name' WHEN lower(regexp_extract(a, '^P\d+-(ZH|EN)', 1)) <> l THEN 'language' END AS violation FROM (SELECT c_custkey, format('P{}-{}-{:02d}', c_custkey % 3 + 1, ['ZH', 'EN', 'FR'][c_custkey % 3 + 1], c_custkey % 90) AS a, ['zh', 'en'][c_custkey % 2 + 1] AS l FROM customer)")
def named_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts whose name isn't one of a stage, or says another language than they have."""
    k = F.col("c_custkey")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (k % n).cast("int"))
    account = F.format_string("P%d-%s-%02d", k % 3 + 1, pick(("ZH", "EN", "FR"), 3), k % 90)
    return table(spark, sf, "customer").select("c_custkey", roster.account_violation(account, pick(("zh", "en"), 2)).alias("violation"))


@query("Z13_new_accounts", "SELECT c_custkey AS id, format('P1-ZH-{:02d}', 5 + row_number() OVER (ORDER BY c_custkey)) AS account FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def new_accounts(spark: SparkSession, sf: str) -> DataFrame:
    people, having = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return roster.new_accounts(people, having, "id", "P1-ZH-", 5)


@query("Z14_index_maps", "SELECT p_type || '_' || p_partkey AS source_id, m AS modality, format('S{:04d}', p_partkey) || '::' || m AS task_id FROM part, (SELECT unnest(['face', 'body', 'audio', 'text', 'full']) AS m)")
def index_maps(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat_ws("_", "p_type", F.col("p_partkey").cast("string"))
    numbers = table(spark, sf, "part").select(source.alias("source_id"), F.format_string("S%04d", "p_partkey").alias("number"))
    return roster.index_maps(numbers, panel.MODALITIES).drop("number")


@query("Z16_single_task", f"WITH {SUBMISSIONS}, l AS (SELECT annotator_id, task_id, dimension, arg_max(value, (submitted_at, submission_id)) AS v FROM submissions GROUP BY 1, 2, 3) SELECT annotator_id, task_id, dimension, v >= 20 AS submitted, bool_and(v >= 20) OVER (PARTITION BY annotator_id, task_id) AND count(*) OVER (PARTITION BY annotator_id, task_id) = 5 AS complete FROM l")
def single_task(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the latest attempt in a task's dimension was submitted, and whether that holds for all five."""
    last = chains.latest(submissions(spark, sf), ["annotator_id", "task_id", "dimension"], ["submitted_at", "submission_id"])
    return roster.task_state(last.withColumn("submitted", F.col("value") >= 20), 5)


@query("Z23_pending_samples", "SELECT user_id, event_id AS sample_index, CASE WHEN event_id % 4 = 0 THEN value + 1 ELSE value END AS v FROM events WHERE event_type <> 'error' OR event_id % 4 = 0")
def pending_samples(spark: SparkSession, sf: str) -> DataFrame:
    """An export with the samples that weren't sent yet in their place."""
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("sample_index"), F.col("value").alias("v"), "event_type")
    pending = rows.where("sample_index % 4 = 0").select("user_id", "sample_index", (F.col("v") + 1).alias("v"))
    return chains.local_wins(pending, rows.where("event_type <> 'error'").select("user_id", "sample_index", "v"), ["user_id", "sample_index"])


# Frames of clips: an order is a clip, a line a face.
FACES = "f AS (SELECT l_orderkey AS clip, l_linenumber AS frame_i, l_partkey * 1000 + l_suppkey AS face, l_discount * 8 AS score, l_tax * 100 AS sharp, l_quantity > 15 AS main, l_quantity AS x, l_discount * 100 AS y, 20.0::DOUBLE + l_tax * 100 AS w, 30.0::DOUBLE + l_discount * 100 AS h FROM lineitem)"


def faces(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("frame_i"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("face"), (F.col("l_discount") * 8).alias("score"), (F.col("l_tax") * 100).alias("sharp"),
        (F.col("l_quantity") > 15).alias("main"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.lit(20.0) + F.col("l_tax") * 100).alias("w"), (F.lit(30.0) + F.col("l_discount") * 100).alias("h"),
    )


@query("G9_apply_picks", """WITH m AS (SELECT l_orderkey AS clip, max(l_quantity) + 20 AS height, count(*) AS most FROM lineitem GROUP BY 1), p AS (SELECT *, CASE clip % 7 WHEN 0 THEN 'pick' WHEN 1 THEN 'discard' WHEN 2 THEN 'no_speaker' WHEN 3 THEN 'skip' END AS act FROM m)
 SELECT clip, CASE WHEN act = 'pick' THEN 'ok' WHEN act = 'discard' OR (height < 50 AND most > 1) THEN 'discarded' WHEN act = 'no_speaker' THEN 'needs_review' ELSE 'ok' END AS status, CASE WHEN act = 'pick' THEN 'human' ELSE 'auto' END AS method,
 CASE WHEN act = 'discard' THEN 'human_discard' WHEN height < 50 AND most > 1 AND coalesce(act, '') <> 'pick' THEN 'tiny_face_multi_person' END AS reason FROM p""")
def apply_picks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("clip")).agg((F.max("l_quantity") + 20).alias("height"), F.count("*").alias("most"))
    action = F.get(F.array(*map(F.lit, ("pick", "discard", "no_speaker", "skip"))), (F.col("clip") % 7).cast("int"))
    return picks.apply_picks(rows.withColumns({"status": F.lit("ok"), "method": F.lit("auto")}), rows.select("clip", action.alias("action")).where("action is not null"), "clip")


@query("G10_best_frame", f"""WITH {FACES}, n AS (SELECT *, count(*) FILTER (WHERE main) OVER (PARTITION BY clip, frame_i) AS n, max(sharp) OVER (PARTITION BY clip) AS s FROM f),
 k AS (SELECT *, main AND n = 1 AS alone, CASE WHEN main AND n = 1 THEN score * (0.7 + 0.3 * least(1.0, sharp / CASE WHEN s > 0 THEN s ELSE 1.0 END)) ELSE score * 0.8 END AS k, max(n) OVER (PARTITION BY clip) AS most FROM n)
 SELECT clip, frame_i, face, round(least(1.0, k), 4) AS confidence, CASE WHEN k >= CASE WHEN most <= 1 THEN 0.15 ELSE 0.35 END THEN 'ok' ELSE 'needs_review' END AS status FROM k QUALIFY row_number() OVER (PARTITION BY clip ORDER BY alone DESC, k DESC, frame_i, face) = 1""")
def best_frame(spark: SparkSession, sf: str) -> DataFrame:
    return picks.best_frame(faces(spark, sf), "clip")


@query("G11_buckets", f"WITH {FACES}, c AS (SELECT clip, frame_i, count(*) FILTER (WHERE main) AS n FROM f GROUP BY 1, 2), m AS (SELECT clip, floor(quantile_cont(n, 0.5)) AS m, max(n) AS most FROM c GROUP BY 1) SELECT clip, CASE WHEN m = 0 AND most = 0 THEN 'none' WHEN m <= 1 THEN 'single' ELSE 'multi' END AS bucket FROM m")
def buckets(spark: SparkSession, sf: str) -> DataFrame:
    return picks.bucket(faces(spark, sf).groupBy("clip", "frame_i").agg(F.count_if("main").alias("n")), "clip")


@query("Z4_strided", "SELECT p_partkey, coalesce(array_to_string([CAST(x AS INTEGER) FOR x IN range(0, p_size * 20, greatest(1, CAST(round_even((p_size % 40 + 1) * 0.25, 0) AS BIGINT)))][:60], ','), '') AS frames FROM part")
def strided(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(picks.strided(F.col("p_size") * 20, F.col("p_size") % 40 + 1).cast("array<string>"), ",").alias("frames"))


@query("Z5_refine", f"""WITH {FACES}, q AS (SELECT *, score * (0.7 + 0.3 * least(1.0, sharp / CASE WHEN max(sharp) OVER (PARTITION BY clip) > 0 THEN max(sharp) OVER (PARTITION BY clip) ELSE 1.0 END)) AS q FROM f), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY clip ORDER BY frame_i, face) = 1),
 b AS (SELECT c.clip, q.frame_i, q.face FROM c JOIN q ON q.clip = c.clip AND q.frame_i <> c.frame_i AND abs(q.x + q.w / 2 - c.x - c.w / 2) <= 0.5 * c.w AND abs(q.y + q.h / 2 - c.y - c.h / 2) <= 0.5 * c.h AND q.w * q.h / (c.w * c.h) > 0.6 AND q.w * q.h / (c.w * c.h) < 1.7 AND q.q > c.score
   QUALIFY row_number() OVER (PARTITION BY c.clip ORDER BY q.q DESC, q.frame_i, q.face) = 1)
 SELECT c.clip, coalesce(b.frame_i, c.frame_i) AS frame_i, coalesce(b.face, c.face) AS face FROM c LEFT JOIN b ON b.clip = c.clip""")
def refine(spark: SparkSession, sf: str) -> DataFrame:
    rows = faces(spark, sf)
    first = rows.groupBy("clip").agg(F.min_by(F.struct("frame_i", "face", "x", "y", "w", "h", "score", "sharp"), F.struct("frame_i", "face")).alias("b")).select("clip", "b.*")
    return picks.refine(rows, first, "clip")


@query("Z6_recognised", """WITH a AS (SELECT user_id, event_id AS place, event_type = 'error' AS found, value / 100 AS confidence, value AS score FROM events), g AS (SELECT user_id, min(place) FILTER (WHERE found) AS p, arg_min(confidence, place) FILTER (WHERE found) AS c, arg_max(place, (score, -place)) AS b FROM a GROUP BY 1)
 SELECT user_id, coalesce(p, b) AS place, CASE WHEN p IS NOT NULL AND c >= 0.6 THEN 'ok' ELSE 'needs_review' END AS status FROM g""")
def recognised(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("place"), (F.col("event_type") == "error").alias("found"), (F.col("value") / 100).alias("confidence"), F.col("value").alias("score"))
    return picks.recognised(rows, "user_id")


@query("Z7_second_opinion", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE event_type END AS verdict, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 100 / 100 END AS confidence FROM events")
def second_opinion(spark: SparkSession, sf: str) -> DataFrame:
    """A checker's answers as JSON, some of which can't be read."""
    answer = F.when(F.col("event_type") != "error", F.to_json(F.struct(F.col("event_type").alias("verdict"), (F.col("event_id") % 100 / 100).alias("confidence")))).otherwise("{not json")
    rows = table(spark, sf, "events").select("event_id", picks.second_opinion(answer).alias("o"))
    return rows.select("event_id", "o.verdict", "o.confidence")


@query("Z8_requeue", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'rejected' ELSE 'kept' END AS status FROM customer")
def requeue(spark: SparkSession, sf: str) -> DataFrame:
    rejected = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    kept, archive = picks.requeue(table(spark, sf, "customer").select("c_custkey", F.lit("kept").alias("status")), rejected, "c_custkey")
    return kept.unionByName(archive)


@query("Z9_publish_check", "WITH r AS (SELECT s_suppkey AS sample_id, f AS file FROM supplier, (SELECT unnest(['R', 'A', 'N']) AS f)) SELECT sample_id, file FROM r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = sample_id AND l_returnflag = file AND l_quantity > 45 AND l_tax > 0.06)")
def publish_check(spark: SparkSession, sf: str) -> DataFrame:
    there = table(spark, sf, "lineitem").where("l_quantity > 45 and l_tax > 0.06").select(F.col("l_suppkey").alias("sample_id"), F.col("l_returnflag").alias("file")).distinct()
    return picks.missing_files(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id")), ["R", "A", "N"], there)


@query("Q15_media_check", """WITH t AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'drop' ELSE 'ok' END AS status, o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS x FROM orders),
 b AS (SELECT l_orderkey AS sample_id, (max(l_tax) - min(l_tax)) / 2 AS spread, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1)
 SELECT sample_id, CASE WHEN status = 'drop' THEN 'dropped' WHEN x THEN 'excluded' WHEN spread IS NULL THEN 'missing' WHEN n < 3 THEN 'incomplete' WHEN spread > 0.030 THEN 'uneven' ELSE 'ok' END AS verdict FROM t LEFT JOIN b USING (sample_id)""")
def media_check(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    tracks = orders.select(F.col("o_orderkey").alias("sample_id"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), "drop").otherwise("ok").alias("status"))
    out = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sample_id"))
    built = lines.groupBy(F.col("l_orderkey").alias("sample_id")).agg(((F.max("l_tax") - F.min("l_tax")) / 2).alias("spread"))
    return picks.media_check(tracks, out, built, lines.select(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("file")), ["R", "A", "N"])


@query("Q17_coverage", f"WITH {FACES} SELECT clip, round(coalesce(avg(CASE WHEN main THEN CAST(x >= 0 AND y >= 0 AND x + w <= 60 AND y + h <= 60 AS INTEGER) END), 0), 4) AS inside FROM f GROUP BY 1")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = faces(spark, sf).select("clip", *(F.when(F.col("main"), F.col(c)).alias(c) for c in ("x", "y", "w", "h")), F.lit(30.0).alias("cx"), F.lit(30.0).alias("cy"), F.lit(60.0).alias("side"))
    return picks.coverage(rows, "clip")


@query("D5_build_status", """WITH f AS (SELECT user_id AS clip, event_id AS frame_i, event_type NOT IN ('error', 'view') AS visible, value > 25 AS anchor FROM events), d AS (SELECT *, NOT visible AND coalesce(lag(visible) OVER (PARTITION BY clip ORDER BY frame_i), TRUE) AS dark FROM f),
 g AS (SELECT clip, avg(CAST(visible AS INTEGER)) AS v, count(*) FILTER (WHERE dark) AS flicker_cuts, count(*) FILTER (WHERE anchor) AS a FROM d GROUP BY 1)
 SELECT clip, round(v, 4) AS visible_ratio, round(1 - v, 4) AS black_ratio, flicker_cuts, CASE WHEN a < 5 OR v < 0.30 THEN 'drop' WHEN v < 0.50 THEN 'low_confidence' ELSE 'ok' END AS status FROM g""")
def build_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame_i"), (~F.col("event_type").isin("error", "view")).alias("visible"), (F.col("value") > 25).alias("anchor"))
    return picks.build_status(rows, "clip")


@query("Z11_mean_template", "WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY 1) SELECT c.label, i - 1 AS i, round(x / n, 5) AS x FROM c JOIN n ON n.label = c.label OR (n.label IS NULL AND c.label IS NULL)")
def mean_template(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return picks.mean_template(rows, "label").select("label", F.posexplode("template").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


FRAMED = FACES + """, c AS (SELECT clip, face, w, h, x, y, score AS det, w * h AS area, max(w * h) OVER (PARTITION BY clip) AS largest FROM f)"""


def framed(spark: SparkSession, sf: str) -> DataFrame:
    """clip, faces: all of a clip's faces as those of one frame."""
    box = F.array("x", "y", "w", "h")
    return faces(spark, sf).groupBy("clip").agg(F.collect_list(F.struct(box.alias("bbox"), F.col("score").alias("det"), "face")).alias("faces"))


@query("P10_candidates", f"WITH {FRAMED} SELECT clip, face FROM c WHERE det >= 0.70 AND h >= 0.07 * 480")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return framed(spark, sf).select("clip", F.explode(geometry.strict_candidates(F.col("faces"), F.lit(480))).alias("f")).select("clip", "f.face")


@query("P11_main_faces", f"WITH {FRAMED} SELECT clip, face FROM c WHERE area >= 0.20 * largest")
def main_faces(spark: SparkSession, sf: str) -> DataFrame:
    return framed(spark, sf).select("clip", F.explode(geometry.main_faces(F.col("faces"))).alias("f")).select("clip", "f.face")


@query("P12_fallback", f"WITH {FRAMED}, s AS (SELECT DISTINCT clip FROM c WHERE det >= 0.70 AND h >= 33.6), l AS (SELECT clip, max(area) AS area FROM c WHERE det >= 0.40 AND clip NOT IN (SELECT clip FROM s) GROUP BY 1) SELECT c.clip, count(*) FILTER (WHERE det >= 0.70 AND h >= 33.6) + coalesce(max(CASE WHEN l.area IS NOT NULL THEN 1 END), 0) AS n, max(l.area) IS NOT NULL AS loose, round(max(l.area), 6) AS area FROM c LEFT JOIN l ON l.clip = c.clip GROUP BY 1")
def fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The strict candidates, or else the one largest fair face; and which of the two it was."""
    kept, loose = geometry.with_fallback(geometry.strict_candidates(F.col("faces"), F.lit(480)), F.col("faces"))
    rows = framed(spark, sf).select("clip", kept.alias("k"), loose.alias("loose"))
    return rows.select("clip", F.size("k").cast("long").alias("n"), "loose", F.round(F.when(F.col("loose"), F.col("k")[0]["bbox"][2] * F.col("k")[0]["bbox"][3]), 6).alias("area"))


@query("F20_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], [1.0::DOUBLE FOR x IN embedding]), 6) AS sim FROM embeddings")
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    ones = scalars.unit(F.transform("embedding", lambda x: F.lit(1.0)))
    return table(spark, sf, "embeddings").select("vec_id", F.round(scalars.cosine(scalars.unit(F.col("embedding")), ones), 6).alias("sim"))


@query("X1_recount", f"WITH {SUBMISSIONS}, k AS (SELECT *, (epoch_us(submitted_at) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS t FROM submissions QUALIFY row_number() OVER (PARTITION BY annotator_id, task_id, dimension ORDER BY submitted_at, submission_id) = 1) SELECT annotator_id, count(*) AS sample_count, round(max(t), 6) AS last_media_time FROM k GROUP BY 1")
def recount(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of what is stored after repeated chunks were ignored, not of what was sent."""
    kept = chains.first_wins(submissions(spark, sf), ["annotator_id", "task_id", "dimension"], ["submitted_at", "submission_id"])
    t = (F.unix_micros(F.col("submitted_at").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 86400e6
    return kept.groupBy("annotator_id").agg(F.count("*").alias("sample_count"), F.round(F.max(t), 6).alias("last_media_time"))


@query("X5_store_violations", "SELECT event_id AS attempt_id, CASE WHEN event_id % 5 = 0 THEN 'samples lost' || CASE WHEN value < 30 AND event_id % 3 = 0 THEN ',finished attempt changed' ELSE '' END ELSE 'finished attempt changed' END AS violations FROM events WHERE event_id % 5 = 0 OR (value < 30 AND event_id % 3 = 0)")
def store_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What a new snapshot of a client's store may not do."""
    k, done = F.col("attempt_id"), F.when(F.col("value") < 30, "completed").otherwise("recording")
    before = table(spark, sf, "events").select(F.col("event_id").alias("attempt_id"), F.lit(9).alias("sample_count"), done.alias("status"), F.lit("x").alias("digest"))
    after = before.select("attempt_id", F.when(k % 5 == 0, 8).otherwise(9).alias("sample_count"), "status", F.when(k % 3 == 0, "y").otherwise("x").alias("digest"))
    return lifecycle.store_violations(before, after).select("attempt_id", F.array_join("violations", ",").alias("violations"))


STORE = """WITH a AS (SELECT user_id * 10 + (hash_ % 7) AS attempt_id, * FROM (SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) AS v, day(ts) AS hash_ FROM events)),
 s AS (SELECT attempt_id, v % 40 AS sample_index, min(v) AS body FROM a WHERE event_type <> 'error' GROUP BY 1, 2), t AS (SELECT attempt_id, max(sample_index) + 1 AS n, CASE WHEN attempt_id % 3 = 0 THEN 'completed' ELSE 'recording' END AS status FROM s GROUP BY 1),
 e AS (SELECT attempt_id, v % 40 AS sample_index, min(v) AS body, max(v) AS other FROM a WHERE event_type = 'error' GROUP BY 1, 2),
 x AS (SELECT e.*, t.n, t.status, s.body AS held FROM e JOIN t USING (attempt_id) LEFT JOIN s USING (attempt_id, sample_index)),
 b AS (SELECT attempt_id, bool_or(status = 'completed') AS finished, bool_or(sample_index >= n + 5) AS beyond, bool_or(body <> other OR coalesce(held <> body, FALSE)) AS changed FROM x GROUP BY 1)"""


def stored_and_sent(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Samples of a user's days are stored; errors are samples that are sent later, with counts five beyond what is stored."""
    v = F.floor("value")
    rows = table(spark, sf, "events").select((F.col("user_id") * 10 + F.dayofmonth("ts") % 7).alias("attempt_id"), (v % 40).alias("sample_index"), v.alias("body"), (F.col("event_type") == "error").alias("late"))
    samples = rows.where("not late").groupBy("attempt_id", "sample_index").agg(F.min("body").alias("body"))
    status = F.when(F.col("attempt_id") % 3 == 0, "completed").otherwise("recording")
    attempts = samples.groupBy("attempt_id").agg((F.max("sample_index") + 1).alias("sample_count")).select("attempt_id", "sample_count", status.alias("status"), F.lit("x").alias("digest"))
    came = rows.where("late").join(attempts.select("attempt_id"), "attempt_id", "left_semi").select("attempt_id", "sample_index", "body", F.col("attempt_id").alias("sent_with"))
    sent = attempts.join(came.select("attempt_id").distinct(), "attempt_id", "left_semi").select("attempt_id", (F.col("sample_count") + 5).alias("sample_count"), "status", F.lit("y").alias("digest"))
    return attempts, samples, sent, came


@query("X5_checkpoint", STORE + """ SELECT attempt_id, sample_index, body FROM s UNION ALL SELECT attempt_id, sample_index, x.body FROM x JOIN b USING (attempt_id) WHERE held IS NULL AND NOT (finished OR beyond OR changed)""")
def checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.checkpoint(*stored_and_sent(spark, sf))[1]


@query("X5_refused", STORE + """ SELECT attempt_id, concat_ws(',', CASE WHEN finished THEN 'finished attempt changed' END, CASE WHEN beyond THEN 'sample beyond the count' END, CASE WHEN changed THEN 'sample changed' END) AS violations FROM b WHERE finished OR beyond OR changed""")
def refused_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.checkpoint(*stored_and_sent(spark, sf))[2].select("attempt_id", F.array_join("violations", ",").alias("violations"))


@query("X8_conflicts", "SELECT a.p_partkey, min(b.p_partkey) AS held_by FROM part a JOIN part b ON a.p_size < 3 AND b.p_size >= 3 AND a.p_name = b.p_name GROUP BY 1")
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an import whose name another key holds: they stop it."""
    stored = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    clash = lifecycle.upsert(stored.drop("p_size"), stored.where("p_size < 3").drop("p_size"), "p_partkey", "p_name")[1]
    return clash.groupBy("p_partkey").agg(F.min("held_by").alias("held_by"))


@query("Z2_assets", "WITH a AS (SELECT user_id, event_id, event_type, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, concat_ws(',', event_type, CASE WHEN b <> event_type THEN b END, CASE WHEN c <> event_type AND c <> b THEN c END) AS assets FROM a")
def assets(spark: SparkSession, sf: str) -> DataFrame:
    """The different files that a task and the two after it need, in their order."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    need = F.array_distinct(F.array_compact(F.array("event_type", F.lead("event_type", 1).over(w), F.lead("event_type", 2).over(w))))
    return table(spark, sf, "events").select("event_id", F.array_join(need, ",").alias("assets"))


@query("T0_trajectory", "SELECT l_orderkey AS attempt_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, v) AS INTEGER) AS place, v FROM (SELECT l_orderkey, l_linenumber, unnest([min(l_quantity), max(l_quantity) + 0.5]) AS v FROM lineitem GROUP BY 1, 2)")
def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    sample = lambda x: F.struct(x.cast("double").alias("v"))
    chunks = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("chunk_index")).agg(F.array(sample(F.min("l_quantity")), sample(F.max("l_quantity") + 0.5)).alias("samples"))
    rows = curves.trajectory(chunks.withColumn("created_at", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("attempt_id").orderBy("chunk_index", "pos"))
    return rows.select("attempt_id", place.alias("place"), "v")


QUERIES, ORACLES = registry.queries, registry.oracles
