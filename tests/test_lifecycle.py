"""Changes that are refused as a whole, and exports that are read back by another engine."""

import glob
import random

import duckdb
import pytest

from curvelake.operators import lifecycle
from curvelake.sources import files

QUEUE = "assignment_id long, annotator_id int, task_id int, phase string, order_index long, status string, replaces long"
ROWS = [(1, 1, 10, "main", 0, "active", None), (2, 1, 11, "main", 1, "active", None), (3, 1, 12, "main", 2, "released", None), (4, 1, 13, "main", 3, "active", None), (5, 1, 14, "training", 0, "active", None),
        (6, 2, 12, "main", 0, "active", None), (7, 2, 10, "training", 5, "active", None), (8, 3, 13, "main", 4, "released", None), (9, 1, 15, "main", 9, "active", None), (10, 5, 1, "main", 0, "active", None)]


@pytest.fixture
def world(spark, tmp_path):
    held = lifecycle.Snapshots(spark, f"file://{tmp_path}/queue", QUEUE)
    assert held.current().count() == 0 and held.swap(spark.createDataFrame(ROWS, QUEUE)) == []
    done = spark.createDataFrame([(1, 11), (2, 10), (5, 1)], "annotator_id int, task_id int")
    tasks = spark.createDataFrame([(t, t == 15) for t in range(1, 20)], "task_id int, exclusive boolean")
    accounts = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True)], "annotator_id int, reads_all boolean")
    return held, lambda a, b, phase="main": held.swap(*lifecycle.transfer(held.current(), done, tasks, accounts, a, b, phase))


def test_a_transfer_releases_links_and_appends(world):
    held, move = world
    assert move(1, 2) == []
    rows = {r.assignment_id: tuple(r)[1:] for r in held.current().collect()}
    assert rows[2][4] == "active" and [rows[i][4] for i in (1, 4, 9)] == ["released"] * 3 and rows[5][4] == "active"
    assert [rows[i] for i in (11, 12, 13)] == [(2, 10, "main", 1, "active", 1), (2, 13, "main", 2, "active", 4), (2, 15, "main", 3, "active", 9)]
    assert len(rows) == 13 and held.version() == 2


@pytest.mark.parametrize(("a", "b", "why"), [(1, 1, "self"), (1, 7, "unknown 7"), (7, 1, "unknown 7"), (1, 4, "language"), (1, 3, "held"), (5, 2, "nothing to move")])
def test_a_refused_transfer_leaves_all_as_it_was(world, a, b, why):
    held, move = world
    before = sorted(map(tuple, held.current().collect()), key=str)
    assert why in {r.what for r in move(a, b)}
    assert held.version() == 1 and sorted(map(tuple, held.current().collect()), key=str) == before


def test_a_change_that_fails_half_way_leaves_all_as_it_was(spark, world):
    held, _ = world

    def broken(batches):
        yield from batches
        raise OSError("gone")

    with pytest.raises(Exception, match="gone"):
        held.swap(held.current().mapInArrow(broken, QUEUE))
    assert held.version() == 1 and held.current().count() == len(ROWS)


def test_checkpoints_are_taken_or_refused_whole(spark):
    rng = random.Random(2)
    stored = {a: (rng.randrange(1, 6), rng.choice(["recording", "completed", "interrupted"]), "x") for a in range(30)}
    held = {(a, i): f"{a}/{i}" for a, (n, _, _) in stored.items() for i in range(n) if rng.random() < 0.7}
    sent, came = {}, []
    for a in range(40):
        n, status, digest = stored.get(a, (3, "recording", "x"))
        if rng.random() < 0.8:
            sent[a] = (n + rng.choice([-1, 0, 0, 2]), status, digest if rng.random() < 0.8 else "y")
            for i in range(rng.randrange(6)):
                came.append((a if rng.random() < 0.95 else a + 1, rng.randrange(max(1, n + 2)), None, a))
    came = [(a, i, f"{a}/{i}" if rng.random() < 0.95 else "other", w) for a, i, _, w in came]
    came += came[:3]
    want_attempts, want_samples, refused = dict(stored), dict(held), set()
    for a, new in sent.items():
        own = [(x, i, b) for x, i, b, w in came if w == a]
        old = stored.get(a)
        bad = old and (old[0] > new[0] or (old[1] != "recording" and old != new and (old[1] != new[1] or old[2] != new[2])))
        seen = {}
        for x, i, b in own:
            bad = bad or x != a or i >= new[0] or held.get((x, i), b) != b or seen.setdefault((x, i), b) != b
        if bad:
            refused.add(a)
        else:
            want_attempts[a] = new
            want_samples |= {(x, i): b for x, i, b in own}
    attempt, sample = "attempt_id int, sample_count int, status string, digest string", "attempt_id int, sample_index int, body string"
    out = lifecycle.checkpoint(
        spark.createDataFrame([(a, *v) for a, v in stored.items()], attempt), spark.createDataFrame([(*k, v) for k, v in held.items()], sample),
        spark.createDataFrame([(a, *v) for a, v in sent.items()], attempt), spark.createDataFrame(came, f"{sample}, sent_with int"),
    )
    assert {r.attempt_id: tuple(r)[1:] for r in out[0].collect()} == want_attempts
    assert sorted(tuple(r) for r in out[1].collect()) == sorted((*k, v) for k, v in want_samples.items())
    assert {r.attempt_id for r in out[2].collect()} == refused and len(refused) > 5


def test_documents_are_whole_json_for_another_engine(spark, tmp_path):
    rng = random.Random(4)
    attempts = [(f"t{k}", rng.choice(["ann", "bob"]), f'said "{k}" \\ é', f"2024-01-{1 + k % 28:02d} 00:00:00", [("play", k)], None) for k in range(40)] + [("none", "eve", "x", "2024-01-01 00:00:00", [], None)]
    chunks = [(f"t{k}", i, c, [(i * 10 + j + c / 100,) for j in range(i + 1)]) for k in range(40) for i in range(k % 4) for c in (1, 2)] + [("t3", 9, 1, [])]
    sent = [(f"s{k}", rng.choice(["ann", "bob"]), k % 3 == 0, f"2024-02-{1 + k % 28:02d} 00:00:00") for k in range(30)]
    people = [("ann", "main"), ("bob", "main"), ("eve", "main"), ("zoe", "early")]
    ts = lambda df, c: df.withColumn(c, df[c].cast("timestamp"))
    made = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    listed = files.export_documents(
        ts(made(attempts, "attempt_id string, annotator_id string, note string, started_at string, events array<struct<kind:string,n:int>>, calibration string"), "started_at"),
        made(chunks, "attempt_id string, chunk_index int, created_at int, samples array<struct<v:double>>"),
        ts(made(sent, "submission_id string, annotator_id string, superseded boolean, submitted_at string"), "submitted_at"),
        made(people, "annotator_id string, phase string"), f"{tmp_path}/out", {"schema_version": "1"},
    )
    assert [(r.place, r.annotator_id) for r in listed.orderBy("place").collect()] == [(0, "zoe"), (1, "ann"), (2, "bob"), (3, "eve")]
    for who, _ in people:
        (found,) = glob.glob(f"{tmp_path}/out/annotator_id={who}/*.txt")
        kind = "{schema_version: 'VARCHAR', annotator_id: 'VARCHAR', attempts: 'STRUCT(attempt_id VARCHAR, note VARCHAR, calibration VARCHAR, events STRUCT(kind VARCHAR, n INT)[], samples STRUCT(v DOUBLE)[])[]', submissions: 'STRUCT(submission_id VARCHAR, superseded BOOLEAN)[]'}"
        ((version, name, tried, said),) = duckdb.sql(f"SELECT * FROM read_json('{found}', columns = {kind}, format = 'unstructured')").fetchall()
        assert (version, name) == ("1", who)
        own = sorted((a for a in attempts if a[1] == who), key=lambda a: (a[3], a[0]))
        assert [(t["attempt_id"], t["note"], [(e["kind"], e["n"]) for e in t["events"]]) for t in tried] == [(a[0], a[2], a[4]) for a in own]
        assert [[x["v"] for x in t["samples"]] for t in tried] == [[v for _, i, c, vs in sorted(x for x in chunks if x[0] == a[0] and x[2] == 1) for (v,) in vs] for a in own]
        assert [(s["submission_id"], s["superseded"]) for s in said] == [(s[0], s[2]) for s in sorted((s for s in sent if s[1] == who), key=lambda s: (s[3], s[0]))]
