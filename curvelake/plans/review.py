"""Appraisal records: documents with one or two changes each, checked, saved and exported."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake.operators import records
from curvelake.plans.registry import Registry, table

registry = Registry()
query = registry.query
VERSION, DURATION = "v1", 12
_RATING = {"state": "unknown", "value": None, "evidence_ids": [], "mixed": False, "note": ""}
#: A document that breaks no rule.
BASE = {
    "schema_version": VERSION, "anchor_version": VERSION, "subject_id": "CPM-S0001:subject-1", "event_id": "CPM-S0001:event-1", "modality": "audiovisual",
    "card": {"subject": "speaker", "event": "defeat", "goal": "", "role": ""}, "checks": {"subject": "confirmed", "event": "confirmed", "goal": "unknown", "role": "unknown"},
    "event_location": "outside", "event_window": [1, 2], "score_window": [0, 12],
    "evidence": [{"id": "E01", "modality": "text", "span": [1, 8], "observation": "tactics", "verified": True}],
    "ratings": {d: _RATING for d in records.DIMENSIONS},
    "conflict": {"status": "uncertain", "candidate_window": [2.4, 4.8], "candidate_source": "mock-candidate-v1", "reviewed_window": [2, 5], "modalities": ["text", "face"]},
    "constraint": {"status": "unknown", "evidence_ids": ["E01"]},
    "dynamic": {"status": "unchanged", "time": 5, "modalities": ["face"], "description": "turns", "updated_ratings": None, "score_window": [5, 12]},
    "revision_reason": "",
}
TEXT = json.dumps(BASE, separators=(",", ":"))
_I, _E = '"I":{"state":"unknown","value":null,"evidence_ids":[]', '"span":[1,8],"observation":"tactics","verified":true}]'
_KNOWN = '"I":{"state":"known","value":%s,"evidence_ids":%s'
_MORE = '"span":[1,8],"observation":"tactics","verified":true},{"id":"%s","modality":"face","span":%s,"observation":"%s","verified":%s}]'
#: What is changed into what, for each number of a change; the first changes nothing.
CHANGES = (
    ("~", "~"), ('"score_window":[0,12]', '"score_window":[0,13]'), ('"score_window":[0,12]', '"score_window":[4,3]'), ('"score_window":[0,12]', '"score_window":"all"'), ('"subject":"speaker"', '"subject":" "'),
    ('"subject":"confirmed"', '"subject":"unknown"'), ('"goal":"unknown"', '"goal":"confirmed"'), ('"role":"unknown"', '"role":"maybe"'), ('"outside"', '"inside"'), ('"outside"', '"during"'), ('"event_window":[1,2]', '"event_window":[]'),
    (_E, _MORE % ("E01", "[2,3]", "x", "true")), (_E, _MORE % ("E02", "[3,3]", "x", "true")), (_E, _MORE % ("E02", "[3,3]", "x", "false")), (_E, _MORE % ("E02", "[2,5]", "mouth", "true")),
    (_I, _KNOWN % ("0", '["E01"]')), (_I, _KNOWN % ("1.0", '["E01"]')), (_I, _KNOWN % ("3", '["E01"]')), (_I, _KNOWN % ("-2", "[]")), (_I, _KNOWN % ("2", '["E01","E02"]')), (_I, '"I":{"state":"unknown","value":0,"evidence_ids":[]'), (_I, '"I":{"state":"unset","value":null,"evidence_ids":[]'),
    ('"evidence_ids":[],"mixed":false', '"evidence_ids":[],"mixed":true'), ('"status":"uncertain"', '"status":"confirmed"'), ('"status":"uncertain"', '"status":"open"'), ('"modalities":["text","face"]', '"modalities":["text","text"]'), ('"reviewed_window":[2,5]', '"reviewed_window":[5]'),
    ('"constraint":{"status":"unknown"', '"constraint":{"status":"present"'), ('"constraint":{"status":"unknown"', '"constraint":{"status":""'), ('"evidence_ids":["E01"]},"dynamic"', '"evidence_ids":["E09"]},"dynamic"'), ('"status":"unchanged"', '"status":"changed"'), ('"status":"unchanged"', '"status":"perhaps"'),
    ('"time":5', '"time":99'), ('"description":"turns"', '"description":""'), ('["face"],"description"', '["voice"],"description"'), ('"updated_ratings":null', '"updated_ratings":' + json.dumps(BASE["ratings"], separators=(",", ":"))), ('"score_window":[5,12]}', '"score_window":[3,12]}'), ('"verified":true', '"verified":false'),
    ('"schema_version":"v1"', '"schema_version":"v0"'), ('"candidate_window":[2.4,4.8]', '"candidate_window":[1,2]'), ('mock-candidate-v1', 'changed'), ('"modality":"audiovisual"', '"modality":"text"'), ('"revision_reason":""', '"revision_reason":"checked again"'), ('"candidate_source"', 'candidate_source"'),
)


def changed(k: Column, text: Column) -> Column:
    """``text`` with the k-th change."""
    pick = lambda i: F.get(F.array(*(F.lit(c[i]) for c in CHANGES)), k.cast("int"))
    return F.replace(text, pick(0), pick(1))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, user_id, event_type, payload."""
    n = F.lit(len(CHANGES))
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    # a change that needs another one (a window of a confirmed conflict, say) meets it in one of the pairs
    return rows.withColumn("payload", changed(F.floor(F.col("event_id") / n) % n, changed(F.col("event_id") % n, F.lit(TEXT))))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FROM, TO = ("[" + ", ".join(quoted(c[i]) for c in CHANGES) + "]" for i in (0, 1))
MADE = f"""c AS (SELECT {FROM} AS f, {TO} AS t), made AS (SELECT event_id, user_id, event_type, replace(replace({quoted(TEXT)}, f[event_id % {len(CHANGES)} + 1], t[event_id % {len(CHANGES)} + 1]),
   f[event_id // {len(CHANGES)} % {len(CHANGES)} + 1], t[event_id // {len(CHANGES)} % {len(CHANGES)} + 1]) AS text FROM events, c),
 d AS (SELECT *, CASE WHEN json_valid(text) THEN text::JSON END AS d FROM made),
 h AS (SELECT *, coalesce(list_filter((d->'$.evidence')::JSON[], lambda x: (x->>'$.verified') = 'true' AND trim(x->>'$.observation') <> ''), []) AS held FROM d),
 v AS (SELECT *, list_transform(held, lambda x: x->>'$.id') AS ids, list_transform(held, lambda x: x->>'$.modality') AS channels FROM h)"""


def window_sql(path: str, d: str = "d") -> str:
    """Whether a window is good."""
    a, b = (f"TRY_CAST({d}->>'{path}[{i}]' AS DOUBLE)" for i in (0, 1))
    return f"coalesce(json_type({d}, '{path}') = 'ARRAY' AND json_array_length({d}, '{path}') = 2 AND {a} >= 0 AND {a} < {b} AND {b} <= {DURATION}, FALSE)"


def ratings_sql(path: str) -> str:
    """Whether all four ratings are good."""
    each = []
    for dim in records.DIMENSIONS:
        p = f"{path}.{dim}"
        value, refs = f"json_type(d, '{p}.value')", f"CAST(d->'{p}.evidence_ids' AS VARCHAR[])"
        known = f"{value} IN ('UBIGINT', 'BIGINT') AND CAST(d->>'{p}.value' AS BIGINT) BETWEEN -2 AND 2 AND len({refs}) > 0 AND len(list_filter({refs}, lambda y: NOT list_contains(ids, y))) = 0"
        each.append(f"coalesce(CASE d->>'{p}.state' WHEN 'unknown' THEN {value} = 'NULL' WHEN 'known' THEN {known} ELSE FALSE END AND ((d->>'{p}.mixed') = 'false' OR trim(d->>'{p}.note') <> ''), FALSE)")
    return "(" + " AND ".join(each) + ")"


_FIELD = "(d->>'$.checks.{0}' IN ('confirmed', 'unknown') AND (d->>'$.checks.{0}' = 'unknown' OR trim(d->>'$.card.{0}') <> ''))"
_CHANNELS = "('face', 'body', 'audio', 'text')"
GOOD = {
    "N1": window_sql("$.score_window"),
    "N2": "trim(d->>'$.card.subject') <> '' AND d->>'$.checks.subject' = 'confirmed' AND " + " AND ".join(_FIELD.format(f) for f in records.FIELDS),
    "N3": f"d->>'$.event_location' IN ('inside', 'outside', 'unknown') AND (d->>'$.event_location' <> 'inside' OR {window_sql('$.event_window')})",
    "N4": "len(list_distinct(list_transform((d->'$.evidence')::JSON[], lambda x: x->>'$.id'))) = json_array_length(d, '$.evidence') AND len(list_filter(held, lambda x: NOT " + window_sql("$.span", "x") + ")) = 0",
    "N5": ratings_sql("$.ratings"),
    "N6": f"d->>'$.conflict.status' IN ('confirmed', 'not_confirmed', 'uncertain') AND (d->>'$.conflict.status' <> 'confirmed' OR ({window_sql('$.conflict.reviewed_window')} AND len(list_distinct(CAST(d->'$.conflict.modalities' AS VARCHAR[]))) >= 2"
    f" AND len(list_filter(CAST(d->'$.conflict.modalities' AS VARCHAR[]), lambda m: m NOT IN {_CHANNELS} OR NOT list_contains(channels, m))) = 0))",
    "N7": "d->>'$.constraint.status' IN ('present', 'absent', 'unknown') AND (d->>'$.constraint.status' <> 'present' OR list_has_any(CAST(d->'$.constraint.evidence_ids' AS VARCHAR[]), ids))",
    "N8": f"d->>'$.dynamic.status' IN ('changed', 'unchanged', 'unknown') AND (d->>'$.dynamic.status' <> 'changed' OR (CAST(d->>'$.dynamic.time' AS DOUBLE) BETWEEN 0 AND {DURATION} AND json_array_length(d, '$.dynamic.modalities') > 0"
    f" AND len(list_filter(CAST(d->'$.dynamic.modalities' AS VARCHAR[]), lambda m: m NOT IN {_CHANNELS})) = 0 AND trim(d->>'$.dynamic.description') <> ''"
    f" AND (json_type(d, '$.dynamic.updated_ratings') = 'NULL' OR ({window_sql('$.dynamic.score_window')} AND CAST(d->>'$.dynamic.score_window[0]' AS DOUBLE) >= CAST(d->>'$.dynamic.time' AS DOUBLE) AND {ratings_sql('$.dynamic.updated_ratings')}))))",
}
BROKEN = "CASE WHEN d IS NULL THEN 'unreadable' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({g}, FALSE) THEN '{n}' END" for n, g in GOOD.items()) + ") END"


@query("N1_appraisal_rules", f"WITH {MADE} SELECT event_id, {BROKEN} AS errors FROM v")
def appraisal(spark: SparkSession, sf: str) -> DataFrame:
    made = records.validate(documents(spark, sf), "payload", F.lit(float(DURATION)))
    return made.select("event_id", F.array_join("errors", ",").alias("errors"))


@query("X17_save_record", f"""WITH {MADE}, s AS (SELECT user_id, count(*) AS n, arg_max(CASE WHEN event_type = 'click' THEN 'draft' ELSE 'submitted' END, event_id) AS was FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
 k AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1),
 r AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'draft' ELSE 'submitted' END AS status, d, ids, channels, held FROM v SEMI JOIN k ON v.event_id = k.event_id),
 b AS (SELECT r.*, was, n, {BROKEN} AS errors FROM r LEFT JOIN s USING (user_id)),
 w AS (SELECT *, CASE WHEN NOT coalesce(d->>'$.schema_version' = '{VERSION}' AND d->>'$.anchor_version' = '{VERSION}', FALSE) THEN 'version' WHEN NOT coalesce(d->>'$.subject_id' = 'CPM-S0001:subject-1' AND d->>'$.event_id' = 'CPM-S0001:event-1' AND d->>'$.modality' = 'audiovisual', FALSE) THEN 'ids'
   WHEN NOT coalesce(CAST(d->'$.conflict.candidate_window' AS DOUBLE[]) = [2.4, 4.8] AND d->>'$.conflict.candidate_source' = 'mock-candidate-v1', FALSE) THEN 'candidate' WHEN status = 'submitted' AND errors <> '' THEN 'rules' WHEN was = 'submitted' AND trim(d->>'$.revision_reason') = '' THEN 'reason' END AS refused FROM b)
 SELECT user_id AS task_id, status, CASE WHEN refused IS NULL THEN CAST(coalesce(n, 0) + 1 AS INTEGER) END AS attempt_no, refused FROM w""")
def save(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last other event as a new record, after the viewed and clicked ones as stored records."""
    rows = documents(spark, sf).withColumnRenamed("user_id", "task_id")
    nth = F.row_number().over(Window.partitionBy("task_id").orderBy("event_id"))
    stored = rows.where("event_type in ('view', 'click')").select("task_id", nth.alias("attempt_no"), F.when(F.col("event_type") == "click", "draft").otherwise("submitted").alias("status"))
    new = rows.where("event_type not in ('view', 'click')").groupBy("task_id").agg(F.max_by(F.struct("event_type", "payload"), "event_id").alias("x"))
    new = new.select("task_id", F.lit("CPM-S0001").alias("clip_id"), F.when(F.col("x.event_type") == "error", "draft").otherwise("submitted").alias("status"), F.col("x.payload").alias("payload"))
    return records.save(stored, new, VERSION, F.lit(float(DURATION))).drop("clip_id")


@query("S14_appraisal_export", f"WITH {MADE} SELECT event_id, user_id AS task_id, d->>'$.card.subject' AS subject, CAST(json_array_length(d, '$.evidence') AS INTEGER) AS n_evidence, d->>'$.ratings.I.value' AS i_value FROM d WHERE d IS NOT NULL")
def export(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their payload decoded."""
    rows = records.read(documents(spark, sf), "payload").where(F.get_json_object("payload", "$").isNotNull())
    r = F.col("record_")
    return rows.select("event_id", F.col("user_id").alias("task_id"), r["card"]["subject"].alias("subject"), F.size(r["evidence"]).alias("n_evidence"), F.get_json_object("payload", "$.ratings.I.value").alias("i_value"))


@query("X18_seed", "SELECT DISTINCT CAST(c_custkey % 400 AS BIGINT) AS clip, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey % 400) THEN 'kept' ELSE 'new' END AS origin FROM customer UNION SELECT CAST(s_suppkey AS BIGINT), 'kept' FROM supplier")
def seed(spark: SparkSession, sf: str) -> DataFrame:
    """Insert or ignore: stored rows stay as they are, and only missing ones come in."""
    stored = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("clip"), F.lit("kept").alias("origin"))
    new = table(spark, sf, "customer").select((F.col("c_custkey") % 400).alias("clip")).distinct()
    return stored.union(new.join(stored, "clip", "left_anti").select("clip", F.lit("new")))


QUERIES, ORACLES = registry.queries, registry.oracles
