"""Ordered release, appends that happen once, watched snapshots, chains by links and ranges of time, against plain loops."""

import collections
import datetime
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from curvelake.operators import chains, costs, curves, monitor
from curvelake.sources import files
from curvelake.streaming import delivery

START = datetime.datetime(2024, 1, 1)
CHUNK = "attempt string, index long, size long, payload string, at timestamp"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def feed(spark, base, rows):
    spark.createDataFrame(rows, CHUNK).repartition(2).write.mode("append").parquet(f"{base}/in")


def run(spark, base, once=True, **how):
    stream = spark.readStream.schema(CHUNK).parquet(f"{base}/in")
    with delivery.map_state(spark):
        q = delivery.in_order(stream, **how).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(delivery.RELEASED).parquet(f"{base}/out").collect())


@pytest.fixture
def base(tmp_path):
    return f"file://{tmp_path}"


def test_shuffled_repeated_chunks_leave_in_order_over_restarts(spark, base):
    rng = random.Random(1)
    rows = [(a, i * 2, 2, f"{a}{i}", at(i)) for a in "xyz" for i in range(40)]
    sent = rows + rng.sample(rows, 50)
    rng.shuffle(sent)
    for part in range(0, len(sent), 60):  # every run goes on from the checkpoint of the one before
        feed(spark, base, sent[part : part + 60])
        out = run(spark, base, patience_s=600)
        for a in "xyz":
            own = sorted((r for r in out if r[0] == a), key=lambda r: r[4])
            assert [r[1] for r in own] == [2 * i for i in range(len(own))] and not any(r[5] or r[6] for r in own)
    assert [r[:4] for r in out] == sorted(r[:4] for r in rows)
    batch = delivery.assembled(spark.createDataFrame(sent, CHUNK)).collect()
    assert sorted(tuple(r) for r in batch) == [r[:6] for r in out]


def test_a_gap_is_given_up_in_time_and_what_comes_after_all_is_late(spark, base):
    feed(spark, base, [("x", i, 1, f"x{i}", at(i)) for i in (0, 1, 4, 5, 8)])
    assert [r[1] for r in run(spark, base, patience_s=60, behind_s=10)] == [0, 1]
    feed(spark, base, [("clock", 0, 1, "", at(50))])
    assert [r[1] for r in run(spark, base, patience_s=60, behind_s=10) if r[0] == "x"] == [0, 1]
    feed(spark, base, [("clock", 1, 1, "", at(200))])
    out = [r for r in run(spark, base, patience_s=60, behind_s=10) if r[0] == "x"]
    assert [(r[1], r[4], r[5], r[6]) for r in out] == [(0, 0, 0, False), (1, 1, 0, False), (4, 2, 2, False), (5, 3, 0, False), (8, 4, 2, False)]
    feed(spark, base, [("x", 3, 1, "x3", at(200)), ("x", 3, 1, "again", at(201)), ("x", 4, 1, "again", at(202)), ("x", 9, 1, "x9", at(203))])
    run(spark, base, patience_s=60, behind_s=10)
    feed(spark, base, [("x", 3, 1, "again", at(204)), ("x", 2, 1, "x2", at(205)), ("x", 7, 1, "x7", at(206))])
    out = sorted((r for r in run(spark, base, patience_s=60, behind_s=10) if r[0] == "x"), key=lambda r: r[4])
    assert [(r[1], r[3], r[6]) for r in out[5:]] == [(3, "x3", True), (9, "x9", False), (2, "x2", True), (7, "x7", True)]


class Kept:
    """Stands in for the handle and its states, and counts what would go through the JVM."""

    def __init__(self):
        self.calls, self.of, self.timers = 0, {}, set()

    def state(self, name, *_):
        handle = self

        class State:
            def get(self):
                handle.calls += 1
                return iter(handle.of.get(name, ())) if name != "at" else handle.of.get(name)

            def update(self, value):
                handle.calls += 1
                handle.of[name] = value

            put = update

            def appendValue(self, value):
                handle.calls += 1
                handle.of[name] = [*handle.of.get(name, ()), value]

            def clear(self):
                handle.calls += 1
                handle.of.pop(name, None)

        return State()

    getValueState = getListState = getMapState = state

    def registerTimer(self, at_ms):
        self.calls += 1
        self.timers.add(at_ms)

    def deleteTimer(self, at_ms):
        self.calls += 1
        self.timers.remove(at_ms)


def test_a_batch_takes_few_calls_however_many_chunks_wait(spark):
    kept, until = Kept(), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    release = delivery.Release(1000)
    release.init(kept)
    row = lambda i, at_s: {"at_us": at_s * 1_000_000, "index": i, "size": 1, "payload": f"p{i}"}
    for k in range(3):  # every chunk but the first of each ten, twice
        before = kept.calls
        sent = [row(i, i) for i in range(k, 300, 3) if i % 10] * 2
        assert not list(release.handleInputRows(("x",), iter([Row(**r) for r in sent]), until))
        assert kept.calls - before <= 6
    assert kept.timers == {2000}
    before, until.getCurrentWatermarkInMs = kept.calls, lambda: 100_000
    out = list(release.handleExpiredTimer(("x",), until, None))
    assert kept.calls - before <= 7 and [r["index"] for r in out] == [i for i in range(100) if i % 10]
    assert [r.place for r in out] == list(range(90)) and {r.skipped for r in out} == {0, 1} and kept.timers == {102_000}
    before = kept.calls
    late = list(release.handleInputRows(("x",), iter([Row(**row(i, 200)) for i in range(100)] * 2), until))
    assert [(r["index"], r["late"]) for r in late] == [(i, True) for i in range(0, 100, 10)] and kept.calls - before <= 5


def test_a_job_that_fails_half_way_leaves_nothing_and_runs_again_once(spark, base):
    rows = spark.range(1000, numPartitions=4)

    def broken(batches):
        for k, b in enumerate(batches):
            yield b.slice(0, b.num_rows // 2)
            raise OSError("gone")

    with pytest.raises(Exception, match="gone"):
        files.append_once(rows.mapInArrow(broken, "id long"), f"{base}/table", "monday")
    assert files.append_once(rows, f"{base}/table", "monday")
    assert not files.append_once(rows, f"{base}/table", "monday")
    files.append_json_lines(rows.limit(5), f"{base}/table")
    found = collections.Counter(r.id for r in files.read_json_lines(spark, f"{base}/table", "id long").collect())
    assert len(found) == 1000 and sum(found.values()) == 1005


def test_a_stream_appends_each_batch_once_also_if_its_checkpoint_is_lost(spark, base):
    spark.range(50).write.parquet(f"{base}/in")
    for checkpoint in ("a", "b", "b"):
        stream = spark.readStream.schema("id long").parquet(f"{base}/in")
        delivery.append_stream(stream, f"{base}/table", f"{base}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    assert files.read_json_lines(spark, f"{base}/table", "id long").count() == 50


def test_a_buffer_flushes_what_came_meanwhile_each_sample_once(spark, base):
    kind = "attempt_id string, sample_index long, v double"
    rows = [(a, i, i / 10) for a in "ab" for i in range(30)]
    for run_ in range(3):  # stopped and started again, it goes on
        q = delivery.buffered(spark.readStream.schema(kind).parquet(f"{base}/in") if run_ else stream(spark, base, rows[:5], kind), f"{base}/out", f"{base}/state", "200 milliseconds").start()
        for part in range(2):
            at_ = 5 + (run_ * 2 + part) * 10
            spark.createDataFrame(rows[at_ : at_ + 10], kind).write.mode("append").parquet(f"{base}/in")
            q.processAllAvailable()
        q.stop()
    chunks = files.read_json_lines(spark, f"{base}/out", "attempt_id string, chunk_index long, samples array<struct<sample_index:long,v:double>>").collect()
    assert sorted((c.attempt_id, s.sample_index, s.v) for c in chunks for s in c.samples) == rows and len(chunks) >= 6
    assert all(c.chunk_index == c.samples[0].sample_index for c in chunks)


def stream(spark, base, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(f"{base}/in")
    return spark.readStream.schema(kind).parquet(f"{base}/in")


SNAPSHOT = "who string, n long, state string, trained boolean, idle boolean, on_track boolean, percent long, active boolean"


def snapshots(seed, n=200):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(pick("a", "b", "c", "d"), i, pick("training", "annotating", "done"), pick(True, False), pick(True, False, None), pick(True, False, None), rng.randrange(101), pick(True, True, False)) for i in range(n)]


def told(rows):
    last, out = {}, []
    for who, n, state, trained, idle, on_track, percent, active in rows:
        old = last.get(who)
        last[who] = (state, trained, idle, on_track, percent)
        if old is None or not active:
            continue
        if old[0] != state:
            out.append((who, n, f"state {old[0]} > {state}"))
        if trained and old[1] is False:
            out.append((who, n, "trained"))
        if idle and old[2] is False:
            out.append((who, n, "idle"))
        if on_track is False and old[3] is not False:
            out.append((who, n, "behind"))
        out += [(who, n, f"{m}%") for m in (25, 50, 75, 100) if old[4] < m <= percent]
    return sorted(out)


def test_watched_snapshots_tell_what_one_batch_would_and_a_repeated_batch_nothing_new(spark, base):
    rows = snapshots(3)
    watch = delivery.Watch("who", "n", f"{base}/watch")
    for batch, part in enumerate((rows[:50], rows[50:60], rows[60:])):
        new = spark.createDataFrame(part, SNAPSHOT)
        for _ in range(2):
            watch.take(new, batch)
    assert sorted(tuple(r) for r in watch.alerts(spark, "string, long").collect()) == told(rows)
    whole = delivery.Watch("who", "n", f"{base}/other")
    whole.take(spark.createDataFrame(rows, SNAPSHOT), 0)
    assert sorted(tuple(r) for r in whole.alerts(spark, "string, long").collect()) == told(rows)


def test_chains_are_followed_by_links_in_any_order(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 400)
    links = {ids[i]: ids[i - 1] if i % 90 else None for i in range(300)}  # long chains
    links |= {i: rng.choice(ids[:300]) for i in ids[300:380]}  # a tree
    links |= {ids[380]: ids[381], ids[381]: ids[382], ids[382]: ids[380], ids[383]: ids[380], ids[384]: ids[384], ids[385]: -1}  # a cycle, what leads into it, a loop, a link to nowhere
    out = {r.id: (r.root, r.depth, r.cyclic) for r in chains.follow(spark.createDataFrame(list(links.items()), "id long, old long").repartition(3), "id", "old").collect()}
    assert out.keys() == links.keys()
    for i in links:
        seen, k = [], i
        while k is not None and k in links and k not in seen:
            seen.append(k)
            k = links[k]
        cyclic = k in seen
        assert out[i] == ((None, None, True) if cyclic else (seen[-1], len(seen) - 1, False))
    assert chains.follow(spark.createDataFrame([], "id long, old long"), "id", "old").count() == 0


def test_growth_and_alerts_of_readings_at_any_times(spark):
    rng = random.Random(7)
    rows, t, v = [], 0, 100
    for i in range(300):
        t += rng.choice([600, 3600, 20_000, 90_000, 84_600])
        v = v + rng.randrange(50) if rng.random() < 0.95 else rng.randrange(20)
        rows.append(("h", i, at(t), v))
    readings = spark.createDataFrame(rows, "host string, n long, at timestamp, v long")
    base, last, day_told, total_told, growth, want = rows[0][3], None, None, set(), {}, []
    for _, i, when, v in rows:
        if last is not None and v < last:
            base -= last
        last = v
        old = [r for r in rows[:i] if 84_600 <= (when - r[2]).total_seconds() < 172_800]
        growth[i] = v - old[-1][3] if old else None
        for limit in (300, 1000, 2500):
            if v - base >= limit and limit not in total_told:
                total_told.add(limit)
                want.append((i, f"total {float(limit)}"))
        if growth[i] is not None and growth[i] > 60 and day_told != when.date():
            day_told = when.date()
            want.append((i, "day"))
    assert {r.n: r.growth for r in monitor.growth_since(readings, "host", "at", "n", "v").collect()} == growth
    assert sorted((r.n, r.alert) for r in monitor.traffic_alerts(readings, "host", "at", "n", "v", (300, 1000, 2500), 60).collect()) == sorted(want)
    assert len(want) > 5


def test_gaps_before_and_after_a_change(spark):
    attempts = spark.createDataFrame([("a", "p", "face", at(0)), ("b", "p", "face", at(100)), ("c", "p", "face", at(50)), ("d", "p", "face", at(-1))], "attempt_id string, annotator_id string, modality string, started_at timestamp")
    points = [("a", i / 10, False) for i in range(11)] + [("b", i / 10, i % 4 == 0) for i in range(0, 21, 2)] + [("c", 0.94, False), ("d", 9.0, False)]
    out = {r.period: r for r in curves.gap_report(spark.createDataFrame(points, "attempt_id string, t double, filled boolean"), attempts, F.lit(at(0)), F.lit(at(100))).collect()}
    before, after = out["before"], out["after"]
    assert (before.attempts, before.expected, before.measured, before.filled, before.gappy) == (2, 11 + 10, 12, 0, 1)
    assert (round(before.missing_share, 6), before.gappy_share) == (round(1 - 12 / 21, 6), 0.5)
    assert (after.attempts, after.expected, after.measured, after.filled, after.gappy) == (1, 21, 5, 6, 1)


def test_totals_come_with_the_write_and_with_a_streams_progress(spark, base):
    calls = spark.createDataFrame([("a", 10, 1), ("b", 5, None), ("a", 1, 2)], "who string, tokens_in long, tokens_out long")
    watched, meter = costs.metered(calls, 2.0, 10.0)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    watched.write.parquet(f"{base}/calls")
    total = meter()
    assert len(tracker.getJobIdsForGroup()) - before <= 1
    assert (total["calls"], total["tokens_in"], total["tokens_out"]) == (3, 16, 3)
    by = costs.by_key(calls, "who", 2.0, 10.0).collect()
    assert abs(sum(r.cost for r in by) - total["cost"]) < 1e-12 and sum(r.calls for r in by) == 3
    stream = spark.readStream.schema(calls.schema).parquet(f"{base}/calls").observe("cost", *costs.totals())
    q = stream.writeStream.format("noop").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [p["observedMetrics"]["cost"] for p in q.recentProgress if p["observedMetrics"]]
    assert sum(s["tokens_in"] for s in seen) == 16 and sum(s["calls"] for s in seen) == 3
