"""What a query moves and makes, on small tables on which the earlier forms made or moved far more, or gave another result."""

import collections
import functools
import glob
import json
import operator
import os

import pytest
from pyspark.sql import functions as F

from curvelake import catalog, scratch
from curvelake.operators import allocation, curves, graph, lifecycle, quality, track
from curvelake.sources import files


def stages(spark):
    g = spark.sparkContext._gateway
    found = spark._jsc.sc().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s for s in (found.apply(i) for i in range(found.size()))}


def moved(spark, run):
    """What ``run`` returns, and the rows that its shuffles wrote."""
    before = stages(spark)
    with scratch.passing(spark):
        out = run()
    return out, sum(s.shuffleWriteRecords() for k, s in stages(spark).items() if k not in before)


def test_missing_tasks_makes_no_pairs(spark, tmp_path):
    spark.range(2000).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(500).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    items = [(11, 21), (11, 21), (11, 22), (2003, 13), (13, 503), (None, 3), (3, None), (1999, 499)]
    spark.createDataFrame(items, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, rows = moved(spark, lambda: catalog.queries()["J7_missing_tasks"](spark, str(tmp_path)).collect())
    assert sorted(map(tuple, got), key=repr) == sorted([(11, 22), (2003, 13), (13, 503), (None, 3), (3, None)], key=repr)
    assert rows < 10_000  # there are 100,000 pairs that go together


def test_upsert_tells_a_clash_once(spark):
    stored = spark.createDataFrame([(k, "a") for k in (7, 5, 6)] + [(8, "b"), (1, "a")], "k long, name string")
    new = spark.createDataFrame([(1, "a"), (9, "b"), (10, "c"), (11, None)], "k long, name string")
    after, clash = lifecycle.upsert(stored, new, "k", "name")
    assert after.count() == 8
    assert sorted((r.k, r.held_by) for r in clash.collect()) == [(1, 5), (9, 8)]


def test_a_sum_of_prices_depends_on_no_order(spark, tmp_path):
    prices = [2.2, 2.2, 2.2, 0.4]  # 7.000000000000001 in any order
    rows = [(1, "F", p) for p in prices] + [(2, "O", 7.01), (3, "F", 6.99), (3, "O", 0.01)]
    spark.createDataFrame(rows, "o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    df = catalog.queries()["F22_percentages"](spark, str(tmp_path))
    assert dict(df.dtypes)["per_day"] == "bigint"
    assert sorted(map(tuple, df.collect())) == [(1, 100, 1), (2, 0, 2), (3, 50, 1)]


def test_digits_are_those_of_the_number_as_stored(spark):
    kind = "clip string, frame_i int, faces array<struct<bbox:array<double>,det:double,sim:double>>"
    sims = [0.26515, 0.37025, 0.29139, 0.40015, 0.29468, 0.27884, 0.46931, 0.26242, 0.2983, 0.26313, 0.27413]  # their mean is 0.31525 less a trifle
    face = lambda s: [([100.0, 100.0, 90.0, 90.0], 0.9, s)]
    frames = [("a", i, face(s)) for i, s in enumerate(sims)] + [("b", i, face(0.9) if i < 57 else []) for i in range(200)] + [("c", i, face(0.9) if i < 5 else []) for i in range(40)]
    clips = spark.createDataFrame([(c, 25.0, 1920, 720) for c in "abc"], "clip string, fps double, frame_w int, frame_h int")
    out = {r.clip: r for r in track.build(spark.createDataFrame(frames, kind), clips, "clip")[1].collect()}
    assert out["a"].mean_sim == round(functools.reduce(operator.add, sims) / len(sims), 4) == 0.3152
    assert (out["b"].reasons, out["c"].reasons) == ([f"visible={57 / 200:.2f}<0.3"], [f"visible={5 / 40:.2f}<0.3"]) == (["visible=0.28<0.3"], ["visible=0.12<0.3"])


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["T1_resample", "T2_compare", "T3_downsample", "T9_savitzky_golay", "Q6_detail", "Q4_annotator_summary", "Q5_outliers"])
def test_curves_move_points_not_cells(spark, name):
    events = spark.read.parquet(f"{SF}/events.parquet").count()  # the grids have 301 cells for each curve, a curve has few points
    _, rows = moved(spark, lambda: catalog.queries()[name](spark, SF).collect())
    assert rows < 6 * events


def test_pairs_of_unlike_length_and_short_curves(spark):
    points = spark.createDataFrame([("a", 0.35, 1.0, True), ("a", 0.1, 2.0, True), ("a", 9.0, 3.0, True), ("b", 0.0, 4.0, True), ("b", 0.2, 5.0, True), ("c", 8.0, 6.0, True), ("d", 0.0, 7.0, False)], "curve string, t double, v double, is_valid boolean")
    ends = spark.createDataFrame([("a", 0.45), ("b", 0.25), ("c", 0.15), ("d", 1.0)], "curve string, end double")
    runs = curves.steps(points, ends)
    cells = {c: [r.v for r in curves.resample(points, ends).where(f"curve = '{c}'").orderBy("k").collect()] for c in "abcd"}
    assert cells == {"a": [2.0, 2.0, 2.0, 2.0, 1.0], "b": [4.0, 4.0, 5.0], "c": [6.0, 6.0], "d": []}
    assert {r.curve: r.vs for r in curves.listed(runs).collect()} == {c: v for c, v in cells.items() if v}
    assert sorted(r.k for r in curves.shown(runs, 2).where("curve = 'a'").collect()) == [0, 2]
    side = lambda c: runs.where(f"curve = '{c}'").withColumn("task", F.lit(1)).drop("curve")
    both = curves.paired(side("a"), side("b"), ["task"])
    assert sorted((r.k, r.mine, r.ref, r.n) for r in curves.cells(both).collect()) == [(0, 2.0, 4.0, 3), (1, 2.0, 4.0, 3), (2, 2.0, 5.0, 3)]
    by_cells = quality.detail(curves.cells(both).drop("n"), ["task"], 2).collect()
    assert quality.detail(both, ["task"], 2).collect() == by_cells and by_cells[0].mine == [2.0, 2.0]


def test_a_template_is_dealt_out_over_all_tasks(spark):
    people = spark.createDataFrame([(i, "zh") for i in range(40)], "annotator_id long, language string")
    template = spark.createDataFrame([("zh", t, t) for t in range(5)] + [("en", 9, 9)], "language string, task_id long, order_index long")
    out = lifecycle.copy_template(template, people, people.where("annotator_id < 10"))
    assert out.count() == 150 and out.distinct().count() == 150
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_template_takes_little_room(spark, tmp_path, monkeypatch):
    """Everybody gets all tasks of their language, and what is written repeats itself."""
    monkeypatch.setattr(lifecycle, "SLICE", 1000)
    people = spark.range(2500).select((F.col("id") * 7919 % 1_000_003).alias("annotator_id"), F.when(F.col("id") % 3 == 0, "zh").when(F.col("id") % 500 != 1, "en").alias("language"))
    people = people.union(spark.createDataFrame([(None, "zh")], "annotator_id long, language string"))
    template = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "zh").otherwise("en").alias("language"), (F.col("id") * 104_729 % 1_000_003).alias("task_id"), F.col("id").alias("order_index"))
    having = people.where("annotator_id % 5 = 0")
    out = lifecycle.copy_template(template, people, having)
    out.write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out")
    want = people.where("annotator_id is null or annotator_id % 5 > 0").join(template, "language").select("annotator_id", "task_id", "order_index")
    assert rows.exceptAll(want).count() == want.exceptAll(rows).count() == 0
    n = rows.count()
    assert n > 2_500_000 and rows.where("annotator_id is null").count() == 1500
    assert sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/out/*.parquet")) < n  # more than two bytes a row with one annotator after the other


def test_documents_are_listed_in_few_tasks(spark, tmp_path):
    at = F.timestamp_seconds(F.col("id"))
    attempts = spark.range(80).select(F.col("id").alias("attempt_id"), F.col("id").alias("annotator_id"), at.alias("started_at"))
    chunks = attempts.select("attempt_id", F.lit(0).alias("chunk_index"), F.lit(1).alias("created_at"), F.array(F.struct(F.lit(0.5).alias("v"))).alias("samples"))
    sent = attempts.select(F.col("attempt_id").alias("submission_id"), "annotator_id", F.col("started_at").alias("submitted_at"))
    files.export_documents(attempts, chunks, sent, attempts.select("annotator_id", F.lit("main").alias("phase")), f"{tmp_path}/docs")
    before = stages(spark)
    read = files.read_documents(spark, f"{tmp_path}/docs", "annotator_id string, attempts array<struct<attempt_id:long, samples:array<struct<v:double>>>>")
    assert all(s.numTasks() <= 4 for k, s in stages(spark).items() if k not in before)  # not one for each of 80 folders
    assert sorted((int(r.annotator_id), r.attempts[0].attempt_id, r.attempts[0].samples[0].v) for r in read.collect()) == [(i, i, 0.5) for i in range(80)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["S12_document_submissions", "S12_document_attempts", "S13_documents"])
def test_documents_of_many_people_share_files(spark, name):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    people = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    before = {p for p, _, _ in os.walk(base)}
    with scratch.passing(spark):
        catalog.queries()[name](spark, SF).collect()
        made = [f for p, _, fs in os.walk(base) if p not in before and "documents-" in p for f in fs if f.endswith(".txt")]
    assert people > 10 and 0 < len(made) <= 4  # not one for each of them


def test_bundled_documents_are_the_same_documents(spark, tmp_path):
    """Each on a line of its own, whatever stands in its texts."""
    note = F.concat(F.lit('a\n b\r\u2028 "\\ \t }\n{'), F.col("id").cast("string"))
    at = F.timestamp_seconds(F.col("id"))
    attempts = spark.range(60).select(F.col("id").alias("attempt_id"), F.concat(F.lit("p "), (F.col("id") % 7).cast("string")).alias("annotator_id"), at.alias("started_at"), note.alias("note"))
    chunks = attempts.where("attempt_id % 3 > 0").select("attempt_id", F.explode(F.array(F.lit(1), F.lit(0))).alias("chunk_index"), F.lit(1).alias("created_at"), F.expr("array(named_struct('v', attempt_id / 4), named_struct('v', cast(null as double)))").alias("samples"))
    sent = attempts.where("attempt_id < 20").select(F.col("attempt_id").alias("submission_id"), "annotator_id", F.col("started_at").alias("submitted_at"), "note")
    people = attempts.select("annotator_id", F.lit("main").alias("phase")).distinct().union(spark.createDataFrame([("none", "main")], "annotator_id string, phase string"))
    kind = "schema_version string, annotator_id string, attempts array<struct<attempt_id:long, note:string, samples:array<struct<v:double>>>>, submissions array<struct<submission_id:long, note:string>>"
    out = []
    for bundled in (False, True):
        files.export_documents(attempts, chunks, sent, people, f"{tmp_path}/{bundled}", {"schema_version": "1"}, bundled=bundled)
        out.append(sorted(files.read_documents(spark, f"{tmp_path}/{bundled}", kind, bundled=bundled).collect()))
    assert out[0] == out[1] and len(out[0]) == 8 and sum(len(r.attempts) for r in out[0]) == 60
    whole = [json.loads(line) for f in glob.glob(f"{tmp_path}/True/*.txt") for line in open(f, encoding="utf-8", newline="\n") if line.strip()]
    assert sorted(d["annotator_id"] for d in whole) == [r.annotator_id for r in sorted(out[0], key=lambda r: r.annotator_id)]


def test_people_are_dealt_to_by_counts(spark, monkeypatch):
    """Nothing that the driver holds has a row for each person."""
    pool = spark.range(3000).select(F.col("id").alias("sample_id"), F.explode(F.array(*map(F.lit, ["face", "body", "text", "full"]))).alias("modality"))
    pool = pool.withColumn("exclusive", (F.col("modality") == "text") & (F.col("sample_id") < 100))
    people = spark.range(700).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("annotator_id"), F.when(F.col("id") % 5 == 0, "zh").when(F.col("id") % 7 > 0, "en").alias("language"))
    held, collect, create = [], type(pool).collect, type(spark).createDataFrame
    with monkeypatch.context() as m:
        m.setattr(type(pool), "collect", lambda df: held.append(collect(df)) or held[-1])
        m.setattr(type(spark), "createDataFrame", lambda self, rows, *a, **k: held.append(rows) or create(self, rows, *a, **k))
        plan = allocation.assign(pool, people, 2, 5, {"full": 3})
    assert held and max(map(len, held)) < 100
    rows = plan.join(people, "annotator_id").join(pool, ["sample_id", "modality"]).collect()
    assert len(rows) == len({(r.sample_id, r.modality, r.annotator_id) for r in rows}) == 24_000
    loads, copies = collections.Counter(r.annotator_id for r in rows), collections.Counter((r.sample_id, r.modality) for r in rows)
    assert set(copies.values()) == {2} and len(loads) == 700 and max(loads.values()) - min(loads.values()) <= 2
    assert all(r.language == "zh" for r in rows if r.exclusive)
    assert set(collections.Counter(r.annotator_id for r in rows if r.language == "zh" and r.modality == "full").values()) == {3}


def test_there_are_no_more_lots_with_more_people():
    dealt = [allocation.lots({("a", True): 11 * k, ("a", False): 301 * k, ("b", False): 299 * k, ("c", False): 303 * k, ("d", False): 307 * k}, 7 * k, 22 * k + 1, 3, {"a": 2}) for k in (1, 100_000)]
    assert all(len(x) < 40 for x in dealt)
    for x, k in zip(dealt, (1, 100_000), strict=True):
        assert sum((y.last - y.first + 1) * y.each for y in x) == 3 * (11 + 301 + 299 + 303 + 307) * k


def test_a_block_is_sent_once_to_each_square_of_pairs(spark, monkeypatch):
    """Vectors without cells: 40 blocks and more, all of whose pairs have to be compared."""
    import numpy as np

    v = np.random.default_rng(9).normal(size=(640, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([("g", i, x.tolist()) for i, x in enumerate(v)], "g string, id long, v array<double>")
    own = graph.blocks(rows, "g", 16)
    n, pairs = own.count(), scratch.materialize(graph.block_pairs(own, own, 0.5, True), "pairs")
    assert n >= 40 and pairs.count() > n * n // 4
    monkeypatch.setattr(graph, "TILE", 16)
    before = stages(spark)
    found = graph.block_matches(pairs, own, own, 0.5, False).where("a <> b").collect()
    size = sum(s.shuffleWriteBytes() for k, s in stages(spark).items() if k not in before)
    i, j = np.nonzero(np.triu(v @ v.T >= 0.5, 1))
    assert sorted((min(r.a, r.b), max(r.a, r.b)) for r in found) == sorted(zip(i.tolist(), j.tolist(), strict=True))
    assert size < 12 * v.nbytes  # each pair of blocks with both bodies: over 20 times
