"""Appraisal records: a list of broken rules for each nested document; nothing raises.

Rules are named by group: N1 score window, N2 checks of the card, N3 place of the event, N4 evidence, N5 ratings, N6
conflict, N7 constraint, N8 change. A document is read once; what several rules need stands in columns of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions, channels, states and scores of the scale, and its version and candidate window.
DIMENSIONS = ("R", "I", "C", "N")
MODALITIES = ("face", "body", "audio", "text")
CONFLICT, CONSTRAINT, DYNAMIC, PLACES = ("confirmed", "not_confirmed", "uncertain"), ("present", "absent", "unknown"), ("changed", "unchanged", "unknown"), ("inside", "outside", "unknown")
FIELDS = ("event", "goal", "role")
CANDIDATE_WINDOW, CANDIDATE_SOURCE, MODALITY = (2.4, 4.8), "mock-candidate-v1", "audiovisual"
_RATINGS = "struct<" + ", ".join(f"{d}: struct<state:string, value:variant, evidence_ids:array<string>, mixed:boolean, note:string>" for d in DIMENSIONS) + ">"
#: The shape of a document. Scores keep the kind in which they are written, so that neither 1.0 nor "1" is taken for 1.
SCHEMA = (
    "schema_version string, anchor_version string, subject_id string, event_id string, modality string, revision_reason string, "
    "score_window array<double>, card struct<subject:string, event:string, goal:string, role:string>, checks struct<subject:string, event:string, goal:string, role:string>, "
    "event_location string, event_window array<double>, evidence array<struct<id:string, modality:string, span:array<double>, observation:string, verified:boolean>>, "
    f"ratings {_RATINGS}, conflict struct<status:string, reviewed_window:array<double>, modalities:array<string>, candidate_window:array<double>, candidate_source:string>, "
    "constraint struct<status:string, evidence_ids:array<string>>, "
    f"dynamic struct<status:string, time:double, modalities:array<string>, description:string, updated_ratings:{_RATINGS}, score_window:array<double>>"
)


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def bad_window(w: Column, duration: Column) -> Column:
    """Not two numbers a < b within 0..duration."""
    return ~yes((F.size(w) == 2) & (w[0] >= 0) & (w[0] < w[1]) & (w[1] <= duration) & ~F.isnan(w[0]) & ~F.isnan(w[1]))


def bad_ratings(ratings: Column, verified: Column) -> Column:
    """Names of the dimensions that break a rule: unknown has no score; known has a whole score from -2 to 2 and verified
    evidence only, one at least; mixed needs a note."""

    def bad(d: str) -> Column:
        x = ratings[d]
        backed = (F.size(x["evidence_ids"]) > 0) & (F.size(F.array_except(x["evidence_ids"], verified)) == 0)
        whole = yes(F.schema_of_variant(x["value"]) == "BIGINT") & yes(F.try_variant_get(x["value"], "$", "long").between(-2, 2))
        known = (x["state"] == "known") & ~(whole & yes(backed))
        unknown = (x["state"] == "unknown") & x["value"].isNotNull() & ~F.is_variant_null(x["value"])
        return ~yes(x["state"].isin("known", "unknown")) | yes(known) | yes(unknown) | (yes(x["mixed"]) & blank(x["note"]))

    return F.array_compact(F.array(*(F.when(bad(d), d) for d in DIMENSIONS)))


def broken_rules(r: Column, verified: Column, verified_modalities: Column, duration: Column) -> Column:
    """Ids of the broken rules N1 to N8, in order. ``verified``: ids of the verified evidence, with its modalities."""
    none = F.array().cast("array<string>")
    evidence = F.coalesce(r["evidence"], F.array().cast("array<struct<id:string,modality:string,span:array<double>,observation:string,verified:boolean>>"))
    ids = F.transform(evidence, lambda e: F.coalesce(e["id"], F.lit("")))
    strange = lambda m: F.size(F.array_except(F.coalesce(m, none), F.array(*map(F.lit, MODALITIES)))) > 0
    field = lambda f: ~yes(r["checks"][f].isin("confirmed", "unknown")) | (yes(r["checks"][f] == "confirmed") & blank(r["card"][f]))
    c, d, k = r["conflict"], r["dynamic"], r["constraint"]
    changed_to = d["score_window"]
    early = yes((F.size(changed_to) == 2) & (changed_to[0] < d["time"]))
    again = d["updated_ratings"].isNotNull() & (bad_window(changed_to, duration) | early | (F.size(bad_ratings(d["updated_ratings"], verified)) > 0))
    lacking = F.size(F.array_except(F.coalesce(c["modalities"], none), verified_modalities)) > 0
    rules = {
        "N1": bad_window(r["score_window"], duration),
        "N2": blank(r["card"]["subject"]) | ~yes(r["checks"]["subject"] == "confirmed") | field("event") | field("goal") | field("role"),
        "N3": ~yes(r["event_location"].isin(*PLACES)) | (yes(r["event_location"] == "inside") & bad_window(r["event_window"], duration)),
        "N4": (F.size(F.array_distinct(ids)) < F.size(ids)) | F.exists(evidence, lambda e: yes(e["verified"]) & ~blank(e["observation"]) & bad_window(e["span"], duration)),
        "N5": F.size(bad_ratings(r["ratings"], verified)) > 0,
        "N6": ~yes(c["status"].isin(*CONFLICT))
        | (yes(c["status"] == "confirmed") & (bad_window(c["reviewed_window"], duration) | ~yes(F.size(F.array_distinct(c["modalities"])) >= 2) | strange(c["modalities"]) | lacking)),
        "N7": ~yes(k["status"].isin(*CONSTRAINT)) | (yes(k["status"] == "present") & ~yes(F.arrays_overlap(k["evidence_ids"], verified))),
        "N8": ~yes(d["status"].isin(*DYNAMIC))
        | (yes(d["status"] == "changed") & (~yes(d["time"].between(0, duration)) | ~yes(F.size(d["modalities"]) > 0) | strange(d["modalities"]) | blank(d["description"]) | again)),
    }
    return F.array_compact(F.array(*(F.when(bad, name) for name, bad in rules.items())))


def read(records: DataFrame, payload: str) -> DataFrame:
    """All columns, ``record_`` (the document) and what its rules share: verified evidence."""
    rows = records.withColumn("record_", F.from_json(payload, SCHEMA))
    held = F.filter("record_.evidence", lambda e: yes(e["verified"]) & ~blank(e["observation"]))
    rows = rows.withColumn("held_", F.coalesce(held, F.array().cast("array<struct<id:string,modality:string,span:array<double>,observation:string,verified:boolean>>")))
    return rows.withColumns({"verified_": F.transform("held_", lambda e: e["id"]), "channels_": F.transform("held_", lambda e: e["modality"])}).drop("held_")


def validate(records: DataFrame, payload: str, duration: Column) -> DataFrame:
    """All columns and ``errors``; a payload that can't be read has the one error ``unreadable``."""
    rows = read(records, payload)
    whole = yes(F.trim(F.col(payload)).startswith("{") & F.get_json_object(payload, "$").isNotNull())
    errors = broken_rules(F.col("record_"), F.col("verified_"), F.col("channels_"), duration)
    return rows.withColumn("errors", F.when(whole, errors).otherwise(F.array(F.lit("unreadable")))).drop("record_", "verified_", "channels_")


def save(stored: DataFrame, new: DataFrame, version: str, duration: Column) -> DataFrame:
    """task_id, clip_id, status, attempt_no, refused: what becomes of ``new`` records (task_id, clip_id, status, payload),
    one for each task, on top of ``stored`` ones (task_id, attempt_no, status). Drafts needn't be complete; version,
    ids and the candidate window are fixed; a change of a submitted record needs a reason. Refused ones get no number."""
    w = Window.partitionBy("task_id").orderBy(F.col("attempt_no").desc())
    last = stored.withColumn("n_", F.row_number().over(w)).where("n_ = 1").select("task_id", F.col("attempt_no").alias("last_"), F.col("status").alias("was_"))
    rows = read(validate(new, "payload", duration), "payload").join(last, "task_id", "left")
    r = F.col("record_")
    same = lambda c, v: yes(c == v)
    why = (
        F.when(~yes(F.col("status").isin("draft", "submitted")), "status")
        .when(~same(r["schema_version"], F.lit(version)) | ~same(r["anchor_version"], F.lit(version)), "version")
        .when(~same(r["subject_id"], F.concat("clip_id", F.lit(":subject-1"))) | ~same(r["event_id"], F.concat("clip_id", F.lit(":event-1"))) | ~same(r["modality"], F.lit(MODALITY)), "ids")
        .when(~same(r["conflict"]["candidate_window"], F.array(*map(F.lit, CANDIDATE_WINDOW))) | ~same(r["conflict"]["candidate_source"], F.lit(CANDIDATE_SOURCE)), "candidate")
        .when((F.col("status") == "submitted") & (F.size("errors") > 0), "rules")
        .when((F.col("was_") == "submitted") & blank(r["revision_reason"]), "reason")
    )
    number = F.when(why.isNull(), F.coalesce(F.col("last_") + 1, F.lit(1)))
    return rows.select("task_id", "clip_id", "status", number.cast("int").alias("attempt_no"), why.alias("refused"))
