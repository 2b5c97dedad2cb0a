"""Delivery, chains by links, and readings over ranges of time, on events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake.operators import chains, costs, curves, monitor
from curvelake.plans.registry import Registry, table
from curvelake.scratch import discard, folder, materialize
from curvelake.sources import files
from curvelake.streaming import delivery

registry = Registry()
query = registry.query
STATE = "user_id long, event_id long, state string, trained boolean, idle boolean, on_track boolean, percent long, active boolean"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as the chunks of an attempt."""
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf, "events").withColumn("index", index.cast("long"))
    return rows.select(F.col("user_id").cast("string").alias("attempt"), "index", F.lit(1).cast("long").alias("size"), F.col("event_id").cast("string").alias("payload"), F.col("ts").cast("timestamp").alias("at"), "event_type")


@query("K1_ordered_release", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), s AS (SELECT * FROM c WHERE event_type <> 'error')
 SELECT CAST(user_id AS VARCHAR) AS attempt, i AS index, CAST(event_id AS VARCHAR) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS place, i - coalesce(lag(i) OVER (PARTITION BY user_id ORDER BY i), -1) - 1 AS skipped FROM s""")
def ordered_release(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that are sent twice and arrive in any order, over several batches; errors are lost on the way."""
    base = folder(spark, "release")
    rows = chunks(spark, sf).where("event_type <> 'error'").drop("event_type")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.union(rows).repartition(parts, F.xxhash64("payload")).write.parquet(f"{base}/in")
    # one more attempt, far ahead in time, ends the wait for what was lost
    rows.agg(F.lit("").alias("attempt"), F.lit(0).cast("long").alias("index"), F.lit(1).cast("long").alias("size"), F.lit("").alias("payload"), (F.max("at") + F.expr("INTERVAL '1000' DAY")).alias("at")).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, parts // 3)).parquet(f"{base}/in")
    with delivery.map_state(spark):
        drain(delivery.in_order(stream, patience_s=365 * 86_400, behind_s=365 * 86_400), f"{base}/out", f"{base}/state")
    return spark.read.schema(delivery.RELEASED).parquet(f"{base}/out").where("attempt <> ''").select("attempt", "index", "payload", "place", "skipped")


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now, to Parquet."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


@query("K1_batch_release", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), s AS (SELECT * FROM c WHERE event_type <> 'error')
 SELECT CAST(user_id AS VARCHAR) AS attempt, i AS index, CAST(event_id AS VARCHAR) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS place, i - coalesce(lag(i) OVER (PARTITION BY user_id ORDER BY i), -1) - 1 AS skipped FROM s""")
def reassembly(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf).where("event_type <> 'error'").drop("event_type")
    return delivery.assembled(rows.union(rows)).select("attempt", "index", "payload", "place", "skipped")


@query("S4_append_once", "SELECT p_partkey, p_name, p_size < 20 AS small FROM part")
def append_once(spark: SparkSession, sf: str) -> DataFrame:
    """Two jobs, each run twice."""
    path = folder(spark, "appended")
    rows = table(spark, sf, "part").select("p_partkey", "p_name", (F.col("p_size") < 20).alias("small"))
    for small in (True, False, True, False):
        files.append_once(rows.where(F.col("small") == small), path, f"small-{small}")
    return files.read_json_lines(spark, path, "p_partkey long, p_name string, small boolean")


@query("K4_flush", "SELECT CAST(user_id AS VARCHAR) AS attempt_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample_index, value AS v FROM events")
def flushed(spark: SparkSession, sf: str) -> DataFrame:
    """Samples that arrive while the buffer runs, read back from the chunks it has flushed."""
    base = folder(spark, "buffer")
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("attempt_id"), index.cast("long").alias("sample_index"), F.col("value").alias("v"), "event_type")
    kind = rows.drop("event_type").schema
    late = F.col("event_type").isin("error", "view")
    rows.where(~late).drop("event_type").write.parquet(f"{base}/in")
    q = delivery.buffered(spark.readStream.schema(kind).parquet(f"{base}/in"), f"{base}/out", f"{base}/state").start()
    try:
        q.processAllAvailable()
        rows.where(late).drop("event_type").write.mode("append").parquet(f"{base}/in")
        q.processAllAvailable()
    finally:
        q.stop()
    chunks = files.read_json_lines(spark, f"{base}/out", "attempt_id string, chunk_index long, samples array<struct<sample_index:long,v:double>>")
    return chunks.select("attempt_id", F.explode("samples").alias("s")).select("attempt_id", "s.*")


SNAPSHOTS = """s AS (SELECT user_id, event_id, event_type AS state, value > 200 AS trained, value < 20 AS idle, CASE WHEN value > 100 THEN value < 400 END AS on_track, CAST(floor(value / 5) AS BIGINT) AS percent, event_type <> 'error' AS active FROM events),
 o AS (SELECT *, lag(state) OVER w AS s0, lag(trained) OVER w AS t0, lag(idle) OVER w AS i0, lag(on_track) OVER w AS k0, lag(percent) OVER w AS p0 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 a AS (SELECT user_id, event_id, active, 'state ' || s0 || ' > ' || state AS alert FROM o WHERE s0 <> state UNION ALL SELECT user_id, event_id, active, 'trained' FROM o WHERE trained AND NOT t0
 UNION ALL SELECT user_id, event_id, active, 'idle' FROM o WHERE idle AND NOT i0 UNION ALL SELECT user_id, event_id, active, 'behind' FROM o WHERE NOT on_track AND coalesce(k0, TRUE) AND s0 IS NOT NULL
 UNION ALL SELECT user_id, event_id, active, m || '%' FROM o, (VALUES (25), (50), (75), (100)) t(m) WHERE p0 < m AND m <= percent)"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("state"), (v > 200).alias("trained"), (v < 20).alias("idle"), F.when(v > 100, v < 400).alias("on_track"), F.floor(v / 5).alias("percent"), (F.col("event_type") != "error").alias("active"))


@query("K7_watch", f"WITH {SNAPSHOTS} SELECT user_id, event_id, alert FROM a WHERE active")
def watched(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots that arrive in three batches, each told against what the one before has stored."""
    base, rows = folder(spark, "watch"), snapshots(spark, sf)
    ends = rows.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    watch = delivery.Watch("user_id", "event_id", f"{base}/watch")
    for third in range(3):
        low, high = ((ends.a or 0) + ((ends.b or 0) + 1 - (ends.a or 0)) * i // 3 for i in (third, third + 1))
        rows.where((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(STATE).parquet(f"{base}/in")
        watch.start(stream, f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return watch.alerts(spark, "long, long")


@query("J16_release_chain", """WITH RECURSIVE c AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR))) AS replaces FROM events),
 r AS (SELECT event_id, event_id AS root, CAST(0 AS BIGINT) AS depth FROM c WHERE replaces IS NULL UNION ALL SELECT c.event_id, r.root, r.depth + 1 FROM c JOIN r ON c.replaces = r.event_id) SELECT event_id, root, depth FROM r""")
def release_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chains in an order that no column tells; what is followed are the links alone."""
    w = Window.partitionBy("user_id").orderBy(F.md5(F.col("event_id").cast("string")))
    links = table(spark, sf, "events").select("event_id", F.lag("event_id").over(w).alias("replaces"))
    return chains.follow(materialize(links, "links"), "event_id", "replaces").select("event_id", "root", "depth")


@query("W18_growth", """WITH r AS (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) AS v FROM events)
 SELECT a.event_id, a.v - CASE WHEN b.ts > a.ts - INTERVAL 48 HOUR THEN b.v END AS growth FROM r a ASOF LEFT JOIN r b ON a.user_id = b.user_id AND a.ts - INTERVAL 1410 MINUTE >= b.ts""")
def growth(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("v", F.floor("value"))
    return monitor.growth_since(rows, "user_id", "ts", "event_id", "v").select("event_id", "growth")


@query("M13_traffic", """WITH r AS (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
 t AS (SELECT *, sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM r),
 g AS (SELECT a.user_id, a.event_id, a.ts, a.v - CASE WHEN b.ts > a.ts - INTERVAL 48 HOUR THEN b.v END AS growth FROM r a ASOF LEFT JOIN r b ON a.user_id = b.user_id AND a.ts - INTERVAL 1410 MINUTE >= b.ts)
 SELECT user_id, min(event_id) AS event_id, 'total ' || x AS alert FROM t, (VALUES ('500.0'), ('1500.0'), ('2000.0')) l(x) WHERE total >= CAST(x AS DOUBLE) GROUP BY user_id, x
 UNION ALL SELECT user_id, min(event_id), 'day' FROM g WHERE growth > 100 GROUP BY user_id, CAST(ts AS DATE)""")
def traffic(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("v", F.floor("value"))
    return monitor.traffic_alerts(rows, "user_id", "ts", "event_id", "v", (500, 1500, 2000), 100)


@query("T8_before_and_after", """WITH p AS (SELECT user_id || '/' || day(ts) AS attempt_id, CAST(user_id AS VARCHAR) AS annotator_id, event_type AS modality, ts, (epoch_us(ts) % 86400000000) / 8640e6 AS t, value < 100 AS filled FROM events),
 a AS (SELECT attempt_id, min(annotator_id) AS annotator_id, arg_min(modality, ts) AS modality, min(ts) AS started_at FROM p GROUP BY 1 HAVING min(ts) >= TIMESTAMP '2024-01-04'),
 e AS (SELECT attempt_id, floor(max(t) * 10 + 0.5) + 1 AS expected, count(*) FILTER (WHERE NOT filled) AS measured, count(*) FILTER (WHERE filled) AS filled FROM p GROUP BY 1),
 s AS (SELECT annotator_id, modality, CASE WHEN started_at >= TIMESTAMP '2024-01-16' THEN 'after' ELSE 'before' END AS period, count(*) AS attempts, sum(expected) AS expected, sum(measured) AS measured, sum(filled) AS filled, count(*) FILTER (WHERE expected - measured - filled >= 5) AS gappy FROM a JOIN e USING (attempt_id) GROUP BY 1, 2, 3)
 SELECT annotator_id, modality, period, attempts, CAST(expected AS BIGINT) AS expected, CAST(measured AS BIGINT) AS measured, CAST(filled AS BIGINT) AS filled, gappy, round(CASE WHEN expected <> 0 THEN 1 - (measured + filled) / expected ELSE 0 END, 6) AS missing_share,
 round(CASE WHEN expected <> 0 THEN measured / expected ELSE 0 END, 6) AS measured_share, round(gappy / attempts, 6) AS gappy_share FROM s""")
def gap_report(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    rows = table(spark, sf, "events").select(F.concat_ws("/", "user_id", F.dayofmonth("ts")).alias("attempt_id"), F.col("user_id").cast("string").alias("annotator_id"), F.col("event_type").alias("modality"), "ts", (F.unix_micros(at) % 86_400_000_000 / 8640e6).alias("t"), (F.col("value") < 100).alias("filled"))
    attempts = rows.groupBy("attempt_id").agg(F.min("annotator_id").alias("annotator_id"), F.min_by("modality", "ts").alias("modality"), F.min("ts").alias("started_at"))
    when: dict[str, Column] = {k: F.to_timestamp_ntz(F.lit(f"2024-01-{k} 00:00:00")) for k in ("04", "16")}
    out = curves.gap_report(rows, attempts, when["04"], when["16"])
    return out.withColumns({c: F.round(c, 6) for c in ("missing_share", "measured_share", "gappy_share")})


@query("A18_observed", "SELECT count(*) AS rows_written, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS tokens_in, CAST(sum(event_id % 70) AS BIGINT) AS tokens_out, round(sum(event_id % 1000) / 1e6 * 0.5 + sum(event_id % 70) / 1e6 * 3.0, 9) AS cost FROM events")
def observed(spark: SparkSession, sf: str) -> DataFrame:
    """Totals that come with a write, without a job of their own."""
    out = folder(spark, "observed")
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 70).alias("tokens_out"))
    watched, meter = costs.metered(rows, 0.5, 3.0)
    watched.write.parquet(out)
    written = spark.read.parquet(out).count()
    discard(spark, out)
    total = meter()
    return spark.createDataFrame([(written, total["calls"], total["tokens_in"], total["tokens_out"], round(total["cost"], 9))], "rows_written long, calls long, tokens_in long, tokens_out long, cost double")


QUERIES, ORACLES = registry.queries, registry.oracles
