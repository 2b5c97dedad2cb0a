"""Sources and sinks: JSON lines, CSV, manifests and nested exports."""

from __future__ import annotations

import functools
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake import scratch
from curvelake.operators.allocation import numbered

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (also of many shards, by a glob); blank and half-written lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def read_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last record of each key, by file and place in it (files in the order of their names)."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("f_"), F.col("_metadata.file_block_start").alias("b_"), F.monotonically_increasing_id().alias("n_"), "value")
    rows = raw.withColumn("r_", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where(F.col(f"r_.{key}").isNotNull())
    last = rows.groupBy(F.col(f"r_.{key}").alias("key_")).agg(F.max_by("r_", F.struct("f_", "b_", "n_")).alias("r_"))
    return last.select("r_.*")


def append_json_lines(rows: DataFrame, path: str) -> None:
    """Appends a job's rows under a key of its own; a job that may be run again gives its key to ``append_once``."""
    append_once(rows, path, uuid.uuid4().hex)


def append_once(rows: DataFrame, path: str, key: str) -> bool:
    """Appends rows as JSON lines under ``key``, unless that was done before (False). They are written beside the table, where no
    reader looks, and get into it by one rename: a task or job that fails half-way leaves no row, one that is run again no row twice."""
    spark, target = rows.sparkSession, f"{path.rstrip('/')}/append={key}"
    if scratch.names(spark, target):
        return False
    aside = f"{path.rstrip('/')}/_aside-{uuid.uuid4().hex}"
    try:
        rows.write.json(aside)
        return scratch.move(spark, aside, target)
    finally:
        scratch.discard(spark, aside)


def shard(rows: DataFrame, index: str, number: int, of: int) -> DataFrame:
    """Rows whose index falls to one of ``of`` workers."""
    return rows.where(F.pmod(F.col(index), F.lit(of)) == number)


def read_csv(spark: SparkSession, path: str, schema: str, key: list[str], template: str) -> DataFrame:
    """A CSV table with ``id`` built from its key columns."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("id", F.format_string(template, *key))


def write_plan(plan: DataFrame, path: str) -> None:
    plan.select("annotator_id", "order_index", "sample_id", "modality", "is_anchor").write.option("header", True).mode("overwrite").csv(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("annotator_id string, order_index int, sample_id string, modality string, is_anchor boolean").option("header", True).csv(path)


def resolve(samples: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """sample_id, source, path: for each source a pattern with groups and a path template (%1$s is the first group)."""
    path = None
    for source, (pattern, template) in rules.items():
        groups = [F.regexp_extract("sample_id", pattern, i + 1) for i in range(template.count("$s"))]
        made = F.when(F.col("sample_id").rlike(pattern), F.format_string(template, *groups))
        path = F.when(F.col("source") == source, made) if path is None else path.when(F.col("source") == source, made)
    return samples.select("sample_id", "source", path.alias("path"))


@dataclass
class Rule:
    """How a source's samples resolve. ``pattern``: of what follows the source in the id, whole, with groups; ``path``: a template for
    format_string over the key and the groups (%1$s is the key). ``index``: a table of what is known of the samples, by key, with ``path_from`` (a column that goes
    before the template), ``speaker`` (a column) and ``extra`` (name: column, or number of a group). ``gender``: number of a group.
    ``indexed``: a sample that isn't in the index isn't resolved."""

    path: str
    pattern: str = "(.*)"
    index: DataFrame | None = None
    path_from: str | None = None
    speaker: str | None = None
    gender: int | None = None
    extra: dict[str, str | int] = field(default_factory=dict)
    indexed: bool = False


def resolve_all(samples: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """sample_id, source, resolved, path, speaker, gender, extra (map): each sample by the rule of its source; with an index, after one join
    with it. A source without a rule, and an id that doesn't fit the pattern, isn't resolved. ``samples``: sample_id, source."""
    text = F.lit(None).cast("string")
    out = samples.where(~F.col("source").isin(*rules) | F.col("source").isNull()).select("sample_id", "source", F.lit(False).alias("resolved"), text.alias("path"), text.alias("speaker"), text.alias("gender"), F.create_map().cast("map<string,string>").alias("extra"))
    for source, rule in rules.items():
        own = samples.where(F.col("source") == source).select("sample_id", "source", F.expr(f"substring(sample_id, {len(source) + 2})").alias("key_"))
        fits, known = F.col("key_").rlike(f"^(?:{rule.pattern})$"), F.lit(rule.index is None)
        if rule.index is not None:
            own = own.join(rule.index.withColumnRenamed("key", "key_").withColumn("there_", F.lit(True)), "key_", "left")
            known = F.coalesce("there_", F.lit(False))
        group = lambda n, pattern=rule.pattern, fits=fits: F.when(fits, F.regexp_extract("key_", f"^(?:{pattern})$", n))
        groups = re.compile(rule.pattern).groups
        made = F.format_string(rule.path, "key_", *(F.coalesce(group(i + 1), F.lit("")) for i in range(groups)))
        path = F.coalesce(F.col(rule.path_from), made) if rule.path_from else made
        value = lambda v, group=group: group(v) if isinstance(v, int) else F.col(v).cast("string")
        extra = F.map_filter(F.create_map(*(x for k, v in rule.extra.items() for x in (F.lit(k), value(v)))), lambda _, v: v.isNotNull()) if rule.extra else F.create_map().cast("map<string,string>")
        done = (fits & known) if rule.indexed else fits
        when = lambda c, done=done: F.when(done, c)
        speaker = F.col(rule.speaker) if rule.speaker else text
        out = out.union(own.select("sample_id", "source", F.coalesce(done, F.lit(False)), when(path), when(speaker), when(group(rule.gender) if rule.gender else text), F.coalesce(when(extra), F.create_map().cast("map<string,string>"))))
    return out


def export(attempts: DataFrame, samples: DataFrame, submissions: DataFrame) -> DataFrame:
    """annotator_id, document: attempts with their samples in order and submissions with ``superseded``, as JSON."""
    own = samples.groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("samples"))
    tried = attempts.join(own, "attempt_id", "left").groupBy("annotator_id").agg(F.array_sort(F.collect_list(F.struct("attempt_id", "task_id", "samples"))).alias("attempts"))
    sent = submissions.groupBy("annotator_id").agg(F.array_sort(F.collect_list(F.struct("submission_id", "revision", "superseded"))).alias("submissions"))
    both = tried.join(sent, "annotator_id", "left")
    return both.select("annotator_id", F.to_json(F.struct("attempts", "submissions")).alias("document"))


def export_documents(attempts: DataFrame, chunks: DataFrame, submissions: DataFrame, people: DataFrame, path: str, header: dict[str, str] | None = None, bundled: bool = False) -> DataFrame:
    """One JSON document for each annotator, at ``path``/annotator_id=.../: a header, attempts with all their columns, by started_at, each with its samples in
    the order of their chunks, and submissions with all their columns, by submitted_at. Returns the list of documents (place, phase, annotator_id), by phase
    and account. ``bundled``: each task writes its documents one after the other into one file, each on a line of its own (JSON lines), as a file for
    each of very many people costs far more than what is in it; a document of 2 GB and more needs a file of its own.

    A document is written line by line as its rows come, sorted, so neither a person's attempts nor an attempt's samples are ever gathered; of
    chunks sent twice the first counts. ``attempts``: attempt_id, annotator_id, started_at, ...; ``chunks``: attempt_id, chunk_index, created_at, samples
    (an array of structs); ``submissions``: submission_id, annotator_id, submitted_at, ...; ``people``: annotator_id, phase.
    """
    whole = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    inner = lambda text, n: F.expr(f"substring({text}, {n + 1}, char_length({text}) - {2 * n})")
    row = lambda df, who, part, at, key, chunk, line: df.select(F.col(who).alias("annotator_id"), F.lit(part).alias("part"), at.cast("timestamp").alias("at"), key.cast("string").alias("key"), chunk.alias("chunk"), line.alias("line"))
    none, start, end = F.lit(None), F.lit(-1).cast("long"), F.lit((1 << 62)).cast("long")
    head = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in (header or {}).items()), F.col("annotator_id").cast("string").alias("annotator_id")))
    parts = [row(people, "annotator_id", 0, none, none, start, F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(', "attempts": [')))]
    parts.append(row(people, "annotator_id", 2, none, none, start, F.lit('], "submissions": [')))
    parts.append(row(people, "annotator_id", 4, none, none, start, F.lit("]}")))
    own = attempts.withColumn("json_", F.regexp_replace(whole(attempts), r"\}$", ', "samples": ['))
    parts.append(row(own, "annotator_id", 1, F.col("started_at"), F.col("attempt_id"), start, F.col("json_")))
    parts.append(row(own, "annotator_id", 1, F.col("started_at"), F.col("attempt_id"), end, F.lit("]}")))
    first = chunks.groupBy("attempt_id", "chunk_index").agg(F.min_by("samples", "created_at").alias("samples")).where(F.size("samples") > 0)
    text = F.to_json("samples", {"ignoreNullFields": "false"})
    placed = first.join(attempts.select("attempt_id", "annotator_id", "started_at"), "attempt_id").withColumn("json_", text)
    parts.append(row(placed, "annotator_id", 1, F.col("started_at"), F.col("attempt_id"), F.col("chunk_index").cast("long"), inner("json_", 1)))
    sent = submissions.withColumn("json_", whole(submissions))
    parts.append(row(sent, "annotator_id", 3, F.col("submitted_at"), F.col("submission_id"), start, F.col("json_")))
    rows = functools.reduce(DataFrame.union, parts)
    order = ["part", "at", "key", "chunk"]
    before = Window.partitionBy("annotator_id").orderBy(*order)
    follows = F.lag("part").over(before) == F.col("part")
    # a comma stands between attempts, between submissions, and between an attempt's chunks
    opens = (F.col("chunk") == start) | (F.lag("chunk").over(before) >= 0)
    comma = F.when(follows & F.col("part").isin(1, 3) & opens & (F.col("chunk") != end), F.lit(",")).otherwise("")
    lines = rows.select("annotator_id", *order, F.concat(comma, "line").alias("value"))
    # what the window sorted is what the writer sees: a task goes through its people one after the other, and puts its documents in their
    # place itself when it ends; the driver would rename them one by one. A job that fails may leave some documents, but returns no list
    committed = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    written = lines.sortWithinPartitions("annotator_id", *order)
    if bundled:  # between the rows of a document stands a blank, which means nothing there, and after its last one a line ends
        written.select(F.when(F.col("part") == 4, F.concat("value", F.lit("\n"))).otherwise(F.col("value")).alias("value")).write.options(**committed).option("lineSep", " ").text(path)
    else:
        written.select("annotator_id", "value").write.options(**committed).partitionBy("annotator_id").text(path)
    return numbered(people.select("phase", "annotator_id"), [F.col("phase"), F.col("annotator_id")], "place")


def read_documents(spark: SparkSession, path: str, schema: str, bundled: bool = False) -> DataFrame:
    """The documents of ``export_documents``, a row for each. Their folders are listed in a few tasks, not in one for each document."""
    if bundled:
        return spark.read.schema(schema).option("lineSep", "\n").json(path)
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    finally:
        spark.conf.set(LISTING, before)


def mapping(numbers: DataFrame, active: DataFrame) -> DataFrame:
    """display_id, source_id, dataset, status (active or retired)."""
    rows = numbers.join(active.select("source_id").distinct().withColumn("a_", F.lit(True)), "source_id", "left")
    status = F.when(F.col("a_"), "active").otherwise("retired")
    return rows.select("display_id", "source_id", F.substring_index("source_id", "_", 1).alias("dataset"), status.alias("status"))
