"""Lifecycle of queues and records as pure functions from a snapshot to a new one, with violations beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake import scratch
from curvelake.operators import allocation

#: States in which an attempt no longer changes.
FINISHED = ("completed", "interrupted")
#: Annotators and tasks of a square of ``copy_template``, of all languages, by average: what a row of squares needs is sent once for each of them.
PACK, SLICE = 256, 1024


class Snapshots:
    """A table of which each state is written to a place of its own and becomes the current one by a rename, all of it or nothing.
    Readers see the last state that was made current; a job that dies half-way, or a change that is refused, leaves it as it is."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self) -> int:
        return max((int(n[1:]) for n in scratch.names(self.spark, self.path) if n.startswith("v")), default=0)

    def current(self) -> DataFrame:
        n = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{n}") if n else self.spark.createDataFrame([], self.schema)

    def swap(self, after: DataFrame, violations: DataFrame | None = None) -> list:
        """Makes ``after`` current, unless there are violations: of those up to 100 are returned, and nothing has changed."""
        if violations is not None and (found := violations.limit(100).collect()):
            return found
        aside, target = f"{self.path}/_aside-{uuid.uuid4().hex}", f"{self.path}/v{self.version() + 1}"
        try:
            after.write.parquet(aside)
            if not scratch.move(self.spark, aside, target):
                raise RuntimeError("someone else has changed the table meanwhile")
        finally:
            scratch.discard(self.spark, aside)
        return []


def transfer(queue: DataFrame, done: DataFrame, tasks: DataFrame, accounts: DataFrame, source: int, target: int, phase: str = "main") -> tuple[DataFrame, DataFrame]:
    """The queues after all that ``source`` hasn't finished in a phase went to ``target``, and what forbids it (what, task_id): the
    transfer is refused as a whole if there is anything. The moved rows are released and stay; each new one names the row that it
    ``replaces`` and goes after the target's last place, in the old order.

    Refused: to oneself, an unknown account, nothing to move, tasks that need a language the target doesn't read, tasks that
    the target has in this phase already, whatever their status. ``queue``: assignment_id long, annotator_id, task_id, phase, order_index, status,
    replaces; ``done``: annotator_id, task_id (all dimensions); ``tasks``: task_id, exclusive; ``accounts``: annotator_id, reads_all.
    """
    spark = queue.sparkSession
    own = queue.where((F.col("annotator_id") == source) & (F.col("status") == "active") & (F.col("phase") == phase))
    finished = done.where(F.col("annotator_id") == source).select("task_id").distinct()
    moved = allocation.numbered(own.join(finished, "task_id", "left_anti"), [F.col("order_index"), F.col("assignment_id")], "place")
    theirs = queue.where((F.col("annotator_id") == target) & (F.col("phase") == phase))
    whole = lambda what, bad: spark.range(1).where(F.lit(bad)).select(F.lit(what).alias("what"), F.lit(None).cast(queue.schema["task_id"].dataType).alias("task_id"))
    known = {r.annotator_id: r.reads_all for r in accounts.where(F.col("annotator_id").isin(source, target)).collect()}  # two rows
    against = whole("self", source == target).union(whole(f"unknown {source}", source not in known)).union(whole(f"unknown {target}", target not in known))
    against = against.union(whole("nothing to move", moved.isEmpty()))
    needed = moved.join(tasks.where("exclusive").select("task_id").distinct(), "task_id", "left_semi").where(F.lit(not known.get(target, True)))
    held = moved.join(theirs.select("task_id").distinct(), "task_id", "left_semi")
    violations = against.union(needed.select(F.lit("language"), "task_id")).union(held.select(F.lit("held"), "task_id"))

    last = queue.agg(F.coalesce(F.max("assignment_id"), F.lit(0)).alias("id_"), F.coalesce(F.max(F.when((F.col("annotator_id") == target) & (F.col("phase") == phase), F.col("order_index"))), F.lit(-1)).alias("at_"))
    new = moved.crossJoin(F.broadcast(last)).select(  # last is one row
        (F.col("id_") + F.col("place") + 1).cast("long").alias("assignment_id"), F.lit(target).cast(queue.schema["annotator_id"].dataType).alias("annotator_id"), "task_id", "phase",
        (F.col("at_") + F.col("place") + 1).cast(queue.schema["order_index"].dataType).alias("order_index"), F.lit("active").alias("status"), F.col("assignment_id").alias("replaces"),
    )
    gone = moved.select("assignment_id", F.lit(True).alias("gone_"))
    kept = queue.join(gone, "assignment_id", "left").withColumn("status", F.when(F.col("gone_"), "released").otherwise(F.col("status"))).select(*new.columns)
    return kept.unionByName(new), violations


def upsert(stored: DataFrame, new: DataFrame, key: str, unique: str) -> tuple[DataFrame, DataFrame]:
    """New snapshot with ``new`` over ``stored`` by key, and the new rows whose ``unique`` value another key holds: each once, with
    ``held_by``, the smallest of the keys that hold it."""
    kept = stored.join(new.select(key), key, "left_anti")
    clash = new.join(kept.groupBy(unique).agg(F.min(key).alias("held_by")), unique)
    return kept.unionByName(new), clash


def set_durations(tasks: DataFrame, measured: DataFrame) -> DataFrame:
    """task_id, duration, changed (by more than a millionth), missing (not measured)."""
    rows = tasks.join(measured.withColumnRenamed("duration", "new_"), "task_id", "left")
    changed = F.coalesce(F.abs(F.col("new_") - F.col("duration")) > 1e-6, F.lit(False))
    return rows.select("task_id", F.when(changed, F.col("new_")).otherwise(F.col("duration")).alias("duration"), changed.alias("changed"), F.col("new_").isNull().alias("missing"))


def store_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """attempt_id, violations: a count that shrank, a finished attempt that changed. Both: attempt_id, sample_count, status, digest."""
    new = after.select("attempt_id", F.col("sample_count").alias("n1"), F.col("status").alias("s1"), F.col("digest").alias("d1"))
    rows = before.join(new, "attempt_id")
    found = F.array_compact(
        F.array(
            F.when(F.col("n1") < F.col("sample_count"), "samples lost"),
            F.when(F.col("status").isin(*FINISHED) & ((F.col("s1") != F.col("status")) | (F.col("d1") != F.col("digest"))), "finished attempt changed"),
        )
    )
    return rows.select("attempt_id", found.alias("violations")).where(F.size("violations") > 0)


def checkpoint(attempts: DataFrame, samples: DataFrame, sent: DataFrame, sent_samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A store's attempts and samples after clients have sent theirs, and what was refused (attempt_id, violations). An attempt with its
    samples is taken or refused as a whole; a sample that is there already, the same, changes nothing.

    ``attempts``, ``sent``: attempt_id, sample_count, status, digest; ``samples``: attempt_id, sample_index, body; ``sent_samples``: these and
    sent_with (the attempt they came with).
    """
    said = sent.select(F.col("attempt_id").alias("sent_with"), F.col("sample_count").alias("count_"))
    came = sent_samples.groupBy("sent_with", "attempt_id", "sample_index").agg(F.min("body").alias("body"), F.max("body").alias("other_"))
    there = samples.select("attempt_id", "sample_index", F.col("body").alias("held_"))
    rows = came.join(said, "sent_with").join(there, ["attempt_id", "sample_index"], "left")
    differs = (F.col("body") != F.col("other_")) | F.coalesce(F.col("held_") != F.col("body"), F.lit(False))
    bad = rows.groupBy(F.col("sent_with").alias("attempt_id")).agg(
        F.array_compact(F.array(
            F.when(F.bool_or(F.col("attempt_id") != F.col("sent_with")), "sample of another attempt"),
            F.when(F.bool_or(F.col("sample_index") >= F.col("count_")), "sample beyond the count"),
            F.when(F.bool_or(differs), "sample changed"),
        )).alias("violations")
    )
    found = store_violations(attempts, sent).unionByName(bad.where(F.size("violations") > 0))
    refused = found.groupBy("attempt_id").agg(F.array_sort(F.flatten(F.collect_list("violations"))).alias("violations"))
    taken = sent.join(refused, "attempt_id", "left_anti")
    after = attempts.join(taken.select("attempt_id"), "attempt_id", "left_anti").unionByName(taken)
    new = rows.where("held_ is null").join(taken.select(F.col("attempt_id").alias("sent_with")), "sent_with", "left_semi").select("attempt_id", "sample_index", "body")
    return after, samples.unionByName(new), refused


def copy_template(template: DataFrame, annotators: DataFrame, having: DataFrame) -> DataFrame:
    """The template's rows for every annotator of its language who has none yet: as many rows as annotators times tasks. They are made in squares of
    some hundred annotators by some hundred tasks, dealt out evenly, of which a worker holds one at a time. In a square a task goes to all annotators
    before the next one does, so that what is written repeats itself at short distances and takes little room. The template, one queue, fits in memory."""
    parts = int(template.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    new = scratch.materialize(annotators.select("annotator_id", "language").join(having.select("annotator_id").distinct(), "annotator_id", "left_anti"), "new")
    packs, slices = max(parts, -(-new.count() // PACK)), max(1, -(-template.count() // SLICE))
    packed = new.withColumn("pack_", F.pmod(F.xxhash64("annotator_id"), F.lit(packs)))
    own = packed.groupBy("language", "pack_").agg(F.collect_list(F.struct("annotator_id")).alias("own_"))  # in a struct, so that null is kept
    squares = own.select("language", "pack_", F.col("own_.annotator_id").alias("own_"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice_"))
    cut = template.withColumn("slice_", F.pmod(F.xxhash64("task_id"), F.lit(slices)).cast("int"))
    dealt = squares.repartition(parts, "language", "pack_", "slice_")
    return dealt.join(F.broadcast(cut), ["language", "slice_"]).select(F.explode("own_").alias("annotator_id"), "task_id", "order_index")


def unlocked(training: DataFrame, complete: DataFrame) -> DataFrame:
    """annotator_id, unlocked: all training tasks are complete."""
    done = complete.select("annotator_id", "task_id").distinct().withColumn("d", F.lit(True))
    rows = training.join(done, ["annotator_id", "task_id"], "left")
    return rows.groupBy("annotator_id").agg(F.bool_and(F.coalesce("d", F.lit(False))).alias("unlocked"))


def submit(stored: DataFrame, attempts: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New submissions (submission_id, attempt_id, annotator_id, task_id, dimension, revision, previous_id, submitted_at), and
    what was refused (submission_id, reason). An id sent before changes nothing; of several for one attempt the first
    counts; previews and unfinished attempts are refused; revisions run for each dimension.

    ``stored``: submission_id, attempt_id, annotator_id, task_id, dimension, submitted_at; ``attempts``: attempt_id,
    annotator_id, task_id, dimension, mode, status; ``sent``: submission_id, attempt_id, submitted_at."""
    chain = ["annotator_id", "task_id", "dimension"]
    fresh = sent.join(stored.select("submission_id"), "submission_id", "left_anti").join(stored.select("attempt_id"), "attempt_id", "left_anti")
    first = fresh.groupBy("attempt_id").agg(F.min_by(F.struct("submission_id", "submitted_at"), F.struct("submitted_at", "submission_id")).alias("f"))
    rows = first.select("attempt_id", "f.*").join(attempts, "attempt_id", "left")
    reason = F.when(F.col("mode").isNull(), "unknown").when(F.col("mode") != "annotation", "preview").when(F.col("status") != "completed", "unfinished")
    rows = rows.withColumn("reason", reason)
    new = rows.where("reason is null").select("submission_id", "attempt_id", *chain, "submitted_at", F.lit(True).alias("new_"))
    all_ = stored.select("submission_id", "attempt_id", *chain, "submitted_at").withColumn("new_", F.lit(False)).unionByName(new)
    w = Window.partitionBy(*chain).orderBy("submitted_at", "submission_id")
    made = all_.withColumns({"revision": F.row_number().over(w), "previous_id": F.lag("submission_id").over(w)}).where("new_")
    return made.select("submission_id", "attempt_id", *chain, "revision", "previous_id", "submitted_at"), rows.where("reason is not null").select("submission_id", "reason")


def recover(attempts: DataFrame) -> DataFrame:
    """Attempts that were being recorded or paused become interrupted, with an event of it."""
    hit = F.col("status").isin("recording", "paused")
    return attempts.select("*", F.when(hit, "interrupted").otherwise(F.col("status")).alias("new_status"), F.when(hit, "recovered").alias("event"))


def replace_queue(queue: DataFrame, new: DataFrame, index: DataFrame, submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queues after a replacement, and what wasn't done (annotator_id, phase, what): a queue that was begun stays, and
    pairs without a task are left out. ``queue``: annotator_id, phase, task_id, order_index; ``new``: annotator_id, phase,
    sample_id, modality, order_index; ``index``: sample_id, modality, task_id; ``submitted``: annotator_id, task_id."""
    key = ["annotator_id", "phase"]
    begun = queue.join(submitted.select("annotator_id", "task_id").distinct(), ["annotator_id", "task_id"], "left_semi").select(*key).distinct()
    free = new.join(begun, key, "left_anti")
    found = free.join(index, ["sample_id", "modality"], "left")
    kept = queue.join(free.select(*key).distinct(), key, "left_anti")
    after = kept.select(*key, "task_id", "order_index").unionByName(found.where("task_id is not null").select(*key, "task_id", "order_index"))
    refused = new.select(*key).distinct().join(begun, key, "left_semi").withColumn("what", F.lit("begun"))
    return after, refused.unionByName(found.where("task_id is null").select(*key, F.concat_ws("::", "sample_id", "modality").alias("what")))


def mirror(queue: DataFrame, source: int, target: int) -> DataFrame:
    """The snapshot in which ``target``'s queue is a copy of ``source``'s active rows of all phases. ``queue``: annotator_id,
    phase, task_id, order_index, status."""
    copy = queue.where((F.col("annotator_id") == source) & (F.col("status") == "active")).withColumn("annotator_id", F.lit(target).cast(queue.schema["annotator_id"].dataType))
    return queue.where(F.col("annotator_id") != target).unionByName(copy)


def purge(tables: dict[str, DataFrame], assignments: DataFrame, annotator: int) -> dict[str, DataFrame]:
    """Each table without the annotator's rows. Refused where an assignment of theirs was handed on to someone else, whose row
    would point to nothing. ``assignments``: assignment_id, annotator_id, replaces."""
    own = assignments.where(F.col("annotator_id") == annotator).select(F.col("assignment_id").alias("replaces"))
    handed = assignments.where(F.col("annotator_id") != annotator).join(own, "replaces", "left_semi")
    if not handed.isEmpty():
        raise ValueError("assignments were handed on: release them instead")
    return {name: rows.where(F.col("annotator_id") != annotator) for name, rows in tables.items()}
