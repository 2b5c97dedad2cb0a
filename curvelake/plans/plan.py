"""Plans of work on parts as samples and suppliers as people. Draws by hash can't be had in SQL, so the SQL states what
must hold of them: coverage, language, quota, balance, and the order of the queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake.operators import allocation
from curvelake.plans import panel
from curvelake.plans.registry import Registry, table

registry = Registry()
query = registry.query
MODALITIES, COVERAGE, QUOTA = ["face", "body", "audio", "text", "full"], 2, {"text": 3, "full": 2}


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Small parts' text and full are for speakers only."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), "p_size", F.explode(F.array(*map(F.lit, MODALITIES))).alias("modality"))
    return rows.select("sample_id", "modality", (F.col("modality").isin("text", "full") & (F.col("p_size") < 4)).alias("exclusive"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("annotator_id"), F.when(F.col("s_suppkey") % 4 == 0, "zh").otherwise("en").alias("language"))


def planned(spark: SparkSession, sf: str) -> DataFrame:
    own = allocation.assign(pool(spark, sf), people(spark, sf).withColumn("annotator_id", F.col("annotator_id").cast("string")), COVERAGE, 7, QUOTA)
    return own.withColumn("annotator_id", F.col("annotator_id").cast("long"))


POOL = f"""m AS (SELECT unnest({MODALITIES}) AS modality), pool AS (SELECT p_partkey AS sample_id, modality, modality IN ('text', 'full') AND p_size < 4 AS exclusive FROM part, m),
 who AS (SELECT s_suppkey AS annotator_id, CASE WHEN s_suppkey % 4 = 0 THEN 'zh' ELSE 'en' END AS language FROM supplier)"""


@query("C1_assign", f"WITH {POOL} SELECT sample_id, modality, CAST({COVERAGE} AS BIGINT) AS copies, CAST({COVERAGE} AS BIGINT) AS people, CASE WHEN exclusive THEN CAST(0 AS BIGINT) END AS of_others FROM pool")
def assign(spark: SparkSession, sf: str) -> DataFrame:
    """Each subtask's copies, the different people that have them, and those who may not."""
    rows = planned(spark, sf).join(people(spark, sf), "annotator_id").groupBy("sample_id", "modality").agg(F.count("*").alias("copies"), F.count_distinct("annotator_id").alias("people"), F.count_if(F.col("language") != "zh").alias("o"))
    return pool(spark, sf).join(rows, ["sample_id", "modality"], "left").select("sample_id", "modality", "copies", "people", F.when(F.col("exclusive"), F.col("o")).alias("of_others"))


@query("C2_quota", f"WITH {POOL}, q(modality, n) AS (VALUES ('text', 3), ('full', 2)) SELECT annotator_id, modality, CAST(n AS BIGINT) AS open FROM who, q WHERE language = 'zh'")
def quota(spark: SparkSession, sf: str) -> DataFrame:
    """Open subtasks of the modalities with a quota, of each speaker."""
    rows = planned(spark, sf).join(pool(spark, sf).where("not exclusive and modality in ('text', 'full')"), ["sample_id", "modality"])
    return rows.join(people(spark, sf).where("language = 'zh'"), "annotator_id", "left_semi").groupBy("annotator_id", "modality").agg(F.count("*").alias("open"))


@query("C4_balance", f"WITH {POOL} SELECT (SELECT count(*) FROM pool) * {COVERAGE} AS rows, (SELECT count(*) FROM who) AS annotators, TRUE AS even")
def balance(spark: SparkSession, sf: str) -> DataFrame:
    """Loads differ by two subtasks at most."""
    each = people(spark, sf).join(planned(spark, sf).groupBy("annotator_id").agg(F.count("*").alias("n")), "annotator_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return each.agg(F.sum("n").alias("rows"), F.count("*").alias("annotators"), (F.max("n") - F.min("n") <= 2).alias("even"))


@query(
    "C5_preflight",
    f"""WITH {POOL}, s AS (SELECT count(*) AS n FROM who WHERE language = 'zh'), q(modality, n) AS (VALUES ('full', 2), ('text', 3))
 SELECT 'heads' AS "check", CAST({COVERAGE} AS BIGINT) AS needed, count(*) AS there FROM who UNION ALL SELECT 'speakers', {COVERAGE}, n FROM s WHERE EXISTS (SELECT 1 FROM pool WHERE exclusive)
 UNION ALL SELECT 'quota of ' || q.modality, q.n * s.n, (SELECT count(*) FROM pool WHERE pool.modality = q.modality AND NOT exclusive) FROM q, s WHERE s.n > 0""",
)
def preflight(spark: SparkSession, sf: str) -> DataFrame:
    """What a plan needs and what is there, before it is made."""
    speakers, others = allocation.heads(people(spark, sf), "zh")
    counts = {(r.modality, r.exclusive): r["count"] for r in pool(spark, sf).groupBy("modality", "exclusive").count().collect()}
    return spark.createDataFrame(allocation.preflight(counts, speakers, others, COVERAGE, QUOTA), "check string, needed long, there long")


QUEUE_ROWS = f"""WITH {panel.QUEUE}, r AS (SELECT annotator_id, assignment_id AS sample_id, {MODALITIES}[task_id % 5 + 1] AS modality, is_anchor FROM q WHERE status = 'active')"""


def queue_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel.queue(spark, sf).where("status = 'active'").join(panel.tasks(spark), "task_id")
    return allocation.queue_order(rows.select("annotator_id", F.col("assignment_id").alias("sample_id"), "modality", "is_anchor"), MODALITIES, 7)


@query("C3_queue_blocks", QUEUE_ROWS + """ SELECT annotator_id, modality, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY annotator_id ORDER BY list_position(['face', 'body', 'audio', 'text', 'full'], modality)) - count(*) AS INTEGER) AS first,
 count(*) AS span, CASE WHEN count(*) FILTER (WHERE NOT is_anchor) > 1 THEN TRUE END AS inside FROM r GROUP BY 1, 2""")
def queue_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each block's place and length, and whether its anchors lie inside it, neither first nor last."""
    rows = queue_rows(spark, sf)
    k, anchor = F.col("order_index"), F.col("is_anchor")
    each = rows.groupBy("annotator_id", "modality").agg(
        F.count("*").alias("n"), F.min(k).alias("first"), (F.max(k) - F.min(k) + 1).cast("long").alias("span"), F.count_if(~anchor).alias("others"), F.min_by(anchor, k).alias("a"), F.max_by(anchor, k).alias("z")
    )
    return each.select("annotator_id", "modality", "n", "first", "span", F.when(F.col("others") > 1, ~(F.col("a") | F.col("z"))).alias("inside"))


OWNED = f"""WITH {panel.QUEUE}, o AS (SELECT o_orderdate::DATE AS day, {MODALITIES}[day(o_orderdate) % 5 + 1] AS modality, list_sort(list_distinct(list(o_custkey % 10))) AS owners FROM orders GROUP BY 1, 2)"""


@query("C6_anchor_queue", OWNED + """, c AS (SELECT modality, count(*) AS n FROM o GROUP BY 1), s AS (SELECT modality, unnest(range(0, least(n, 12))) AS place FROM c),
 p AS (SELECT modality, place, row_number() OVER (ORDER BY place, list_position(['face', 'body', 'audio', 'text', 'full'], modality)) AS k FROM s) SELECT modality, count(*) AS n, count(*) AS different FROM p WHERE k <= 60 GROUP BY 1""")
def anchor_queue(spark: SparkSession, sf: str) -> DataFrame:
    """How many anchors each modality's block has; that every prefix is even is tested against the plain loop."""
    task = F.to_date("o_orderdate")
    owned = table(spark, sf, "orders").groupBy(task.alias("task_id"), F.get(F.array(*map(F.lit, MODALITIES)), F.dayofmonth(task) % 5).alias("modality")).agg(F.collect_set((F.col("o_custkey") % 10).cast("string")).alias("owners"))
    return allocation.anchor_queue(owned, 60, MODALITIES, 7).groupBy("modality").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("different"))


@query("C7_mix", f"""WITH {POOL}, p AS (SELECT o_custkey % 50 AS annotator_id, o_orderpriority AS modality, o_orderstatus = 'F' AS exclusive FROM orders)
 SELECT p.annotator_id, p.modality, p.exclusive, count(*) AS n, count(*) FILTER (WHERE p.exclusive AND coalesce(language, '') <> 'zh') AS violations FROM p LEFT JOIN who ON who.annotator_id = p.annotator_id GROUP BY 1, 2, 3""")
def mix(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("annotator_id"), F.col("o_orderpriority").alias("modality"), (F.col("o_orderstatus") == "F").alias("exclusive"))
    return allocation.mix(rows, people(spark, sf))


@query("A19_modality_spread", """WITH n AS (SELECT o_orderpriority AS modality, s_suppkey, count(o_orderkey) AS n FROM supplier, (SELECT DISTINCT o_orderpriority AS p FROM orders) LEFT JOIN orders ON o_custkey % 300 = s_suppkey AND o_orderpriority = p GROUP BY p, s_suppkey, o_orderpriority)
 SELECT p AS modality, min(k) AS least, max(k) AS most FROM (SELECT p, s_suppkey, count(o_orderkey) AS k FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) CROSS JOIN supplier LEFT JOIN orders ON o_custkey % 300 = s_suppkey AND o_orderpriority = p GROUP BY 1, 2) GROUP BY 1""")
def spread(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 300).alias("annotator_id"), F.col("o_orderpriority").alias("modality"))
    return allocation.modality_spread(rows, people(spark, sf))


@query("C8_issue_numbers", "SELECT format('S{:04d}', 20 + row_number() OVER (ORDER BY s_suppkey)) AS display_id FROM supplier WHERE s_suppkey >= 20 UNION ALL SELECT format('S{:04d}', s_suppkey + 1) FROM supplier WHERE s_suppkey < 20")
def issue(spark: SparkSession, sf: str) -> DataFrame:
    """All numbers after twenty samples had theirs: without a gap, none twice."""
    samples = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    issued = samples.where("sample_id < 20").select("sample_id", F.format_string("S%04d", F.col("sample_id") + 1).alias("display_id"))
    return issued.unionByName(allocation.issue_numbers(samples, issued, 3)).groupBy("sample_id").agg(F.first("display_id").alias("display_id")).select("display_id")


@query("Z15_export_map", "SELECT s_suppkey AS sample_id, CASE WHEN s_suppkey < 20 THEN format('S{:04d}', s_suppkey + 1) END AS issued_before, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') THEN 'active' ELSE 'retired' END AS status FROM supplier")
def export_map(spark: SparkSession, sf: str) -> DataFrame:
    """Every number ever issued; samples that are in no queue any more are retired."""
    samples = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    issued = samples.where("sample_id < 20").select("sample_id", F.format_string("S%04d", F.col("sample_id") + 1).alias("display_id"))
    all_ = issued.withColumn("old", F.lit(True)).unionByName(allocation.issue_numbers(samples, issued, 3).withColumn("old", F.lit(False)))
    queued = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("sample_id")).distinct().withColumn("q", F.lit(True))
    rows = all_.join(queued, "sample_id", "left")
    return rows.select("sample_id", F.when(F.col("old"), F.col("display_id")).alias("issued_before"), F.when(F.col("q"), "active").otherwise("retired").alias("status"))


@query("J6_retired", "SELECT s_suppkey AS sample_id FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45)")
def retired(spark: SparkSession, sf: str) -> DataFrame:
    queued = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 45").select(F.col("l_suppkey").alias("sample_id"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id")).join(queued, "sample_id", "left_anti")


@query("L8_least_loaded", "WITH l AS (SELECT l_returnflag AS modality, l_suppkey AS annotator_id, count(*) AS n, sum(l_quantity) AS fill FROM lineitem GROUP BY 1, 2) SELECT modality, arg_min(annotator_id, (n, fill, annotator_id)) AS annotator_id FROM l GROUP BY 1")
def least_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Who gets the next one: least load, then least fill, then the id in place of a draw."""
    load = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("modality"), F.col("l_suppkey").alias("annotator_id")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("fill"))
    return load.groupBy("modality").agg(F.min_by("annotator_id", F.struct("n", "fill", "annotator_id")).alias("annotator_id"))


@query("Z10_task_list", """WITH kept AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 0) SELECT format('S{:04d}', id + 1) || '::' || modality AS task_id, format('/media/{}/S{:04d}.{}', modality, id + 1, CASE modality WHEN 'audio' THEN 'm4a' WHEN 'text' THEN 'json' ELSE 'mp4' END) AS src
 FROM kept, (SELECT unnest(['face', 'body', 'audio', 'text', 'full']) AS modality)""")
def task_list(spark: SparkSession, sf: str) -> DataFrame:
    """Five tasks for each sample that isn't dropped, with their files; a sample without a number stops it."""
    samples = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), "s_acctbal")
    numbers = samples.select("sample_id", F.format_string("S%04d", F.col("sample_id") + 1).alias("display_id"))
    return allocation.task_list(samples.select("sample_id"), samples.where("s_acctbal <= 0").select("sample_id"), numbers, MODALITIES)


QUERIES, ORACLES = registry.queries, registry.oracles
