"""Embeddings, boxes and transcripts: vectors of ``embeddings``, boxes made from line items, words of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelake.functions.scalars import cosine, nearest_rank, unit
from curvelake.operators import geometry, graph, track, transcripts
from curvelake.plans.registry import Registry, table

registry = Registry()
query = registry.query
UNIT = """u AS (SELECT vec_id AS id, label, [CAST(c AS DOUBLE) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])) FOR c IN embedding] AS v FROM embeddings)"""
SIMILAR = UNIT + ", pairs AS (SELECT a.label, a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS sim FROM u a JOIN u b ON a.label = b.label AND a.id < b.id WHERE list_inner_product(a.v, b.v) >= 0.363)"
PARTS = """walk AS (SELECT label, id, id AS component FROM u UNION SELECT w.label, CASE WHEN w.id = p.a THEN p.b ELSE p.a END, w.component FROM walk w JOIN pairs p ON w.label = p.label AND (w.id = p.a OR w.id = p.b)),
 parts AS (SELECT label, id, min(component) AS component FROM walk GROUP BY 1, 2),
 sizes AS (SELECT label, component, count(*) AS n FROM parts GROUP BY 1, 2),
 best AS (SELECT label, component, n FROM sizes QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, component) = 1)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", unit(F.col("embedding")).alias("v"))


@query("G1_normalise", f"WITH {UNIT} SELECT id, round(list_sum([x * x FOR x IN v]), 6) AS norm FROM u")
def normalise(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("id", F.round(cosine(F.col("v"), F.col("v")), 6).alias("norm"))


@query("G2_similar_pairs", f"WITH {SIMILAR} SELECT label, a, b, round(sim, 6) AS sim FROM pairs")
def similar(spark: SparkSession, sf: str) -> DataFrame:
    return graph.similar_pairs(vectors(spark, sf), "label").withColumn("sim", F.round("sim", 6))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    own = vectors(spark, sf)
    edges = graph.similar_pairs(own, "label")
    return graph.components(own.select("label", "id"), edges.select("label", "a", "b"), ["label"])


@query("G3_largest_component", f"WITH RECURSIVE {SIMILAR}, {PARTS} SELECT label, id FROM parts JOIN best USING (label, component)")
def largest(spark: SparkSession, sf: str) -> DataFrame:
    return graph.largest_component(parts(spark, sf), ["label"]).select("label", "id")


PROTOTYPES = f"""WITH RECURSIVE {SIMILAR}, {PARTS}, m AS (SELECT u.* FROM u JOIN parts USING (label, id) JOIN best USING (label, component) WHERE best.n >= 3),
 c AS (SELECT label, i, avg(v[i]) AS x, count(*) AS n FROM m, range(1, 65) t(i) GROUP BY 1, 2),
 r AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS raw FROM c GROUP BY 1),
 proto AS (SELECT label, n, [x / sqrt(list_sum([y * y FOR y IN raw])) FOR x IN raw] AS prototype FROM r)"""


def prototypes(spark: SparkSession, sf: str) -> DataFrame:
    members = graph.largest_component(parts(spark, sf), ["label"]).select("label", "id")
    return graph.prototypes(vectors(spark, sf).join(members, ["label", "id"]), ["label"])


@query("G4_prototypes", PROTOTYPES + " SELECT label, n, round(prototype[1], 6) AS first, round(prototype[64], 6) AS last FROM proto")
def prototype_table(spark: SparkSession, sf: str) -> DataFrame:
    return prototypes(spark, sf).select("label", "n", F.round(F.col("prototype")[0], 6).alias("first"), F.round(F.col("prototype")[63], 6).alias("last"))


@query(
    "G5_best_match",
    PROTOTYPES
    + """, s AS (SELECT u.id % 25 AS clip, u.id, round(list_inner_product(u.v, p.prototype), 3) AS sim, u.id % 7 AS quality FROM u JOIN proto p USING (label))
 SELECT clip, id, sim, CASE WHEN sim >= 0.55 THEN 'ok' WHEN sim >= 0.28 THEN 'needs_review' ELSE 'deferred' END AS status FROM s QUALIFY row_number() OVER (PARTITION BY clip ORDER BY sim DESC, quality DESC, id) = 1""",
)
def best_match(spark: SparkSession, sf: str) -> DataFrame:
    candidates = vectors(spark, sf).select((F.col("id") % 25).alias("clip"), "label", "id", (F.col("id") % 7).alias("quality"), "v")
    return graph.best_match(candidates, prototypes(spark, sf), ["clip"], "label").select("clip", "id", "sim", "status")


@query("G7_new_people", f"WITH {UNIT} SELECT label, id FROM u n WHERE v[1] > 0 AND NOT EXISTS (SELECT 1 FROM u o WHERE o.v[1] <= 0 AND o.label = n.label AND list_inner_product(o.v, n.v) >= 0.363)")
def new_people(spark: SparkSession, sf: str) -> DataFrame:
    own = vectors(spark, sf)
    return graph.new_people(own.where("v[0] > 0"), own.where("v[0] <= 0"), "label")


@query("G8_merge_verdicts", """SELECT event_id AS id, CASE WHEN v IS NULL THEN 'needs_review' WHEN v = 'yes' THEN 'ok' WHEN v = 'no' THEN 'rejected' ELSE 'needs_review' END AS status,
 CASE WHEN v IN ('yes', 'no') THEN 'verified:' || v WHEN v IS NOT NULL THEN 'verified:unsure' END AS note FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'yes' WHEN 'click' THEN 'no' WHEN 'error' THEN 'error' END AS v FROM events)""")
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    verdict = F.when(F.col("event_type") == "view", "yes").when(F.col("event_type") == "click", "no").when(F.col("event_type") == "error", "error")
    return graph.merge_verdicts(rows.select("id", F.lit("needs_review").alias("status")), rows.select("id", verdict.alias("verdict")).where("verdict is not null"))


BOXES = "b AS (SELECT l_orderkey AS clip, l_linenumber AS frame_i, l_partkey AS part, l_suppkey AS sup, [l_quantity, l_discount * 100, 20.0 + l_tax * 100, 30.0 + l_discount * 100]::DOUBLE[] AS bbox FROM lineitem)"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    q, d, t = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("frame_i"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("sup"), F.array(q, d, 20.0 + t, 30.0 + d).alias("bbox"))


@query(
    "F14_iou",
    f"""WITH {BOXES}, x AS (SELECT part, sup, clip, bbox, [10.0, 2.0, 25.0, 25.0]::DOUBLE[] AS o FROM b),
 s AS (SELECT *, greatest(0, least(bbox[1] + bbox[3], o[1] + o[3]) - greatest(bbox[1], o[1])) * greatest(0, least(bbox[2] + bbox[4], o[2] + o[4]) - greatest(bbox[2], o[2])) AS i FROM x)
 SELECT clip, part, sup, round(i / (bbox[3] * bbox[4] + o[3] * o[4] - i), 6) AS iou FROM s""",
)
def iou(spark: SparkSession, sf: str) -> DataFrame:
    other = F.array(*map(F.lit, (10.0, 2.0, 25.0, 25.0)))
    return boxes(spark, sf).select("clip", "part", "sup", F.round(geometry.iou(F.col("bbox"), other), 6).alias("iou"))


@query("F15_clamp_centre", "SELECT l_orderkey, l_partkey, l_suppkey, greatest(15.0, least(35.0, l_quantity)) AS centre FROM lineitem")
def clamp_centre(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", geometry.clamp_centre(F.col("l_quantity"), F.lit(30.0), F.lit(50.0)).alias("centre"))


@query("F16_nearest_rank", "WITH s AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, v[least(len(v) - 1, CAST(round_even(0.9 * (len(v) - 1), 0) AS BIGINT)) + 1] AS p90 FROM s")
def rank90(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v")).select("l_orderkey", nearest_rank(F.col("v"), 0.9).alias("p90"))


@query("F12_face_score", """SELECT l_orderkey, l_partkey, l_suppkey, round((0.55 * sqrt(l_tax * 4 * l_discount * 4) * 3 + 0.15 * (1 - sqrt((l_quantity / 50 - 0.5) * (l_quantity / 50 - 0.5) + (l_discount * 8 - 0.5) * (l_discount * 8 - 0.5)) / 0.707)
 + 0.30 * l_tax * 10) * 0.9, 6) AS score FROM lineitem""")
def face_score(spark: SparkSession, sf: str) -> DataFrame:
    own = geometry.face_score(F.col("l_tax") * 4, F.col("l_discount") * 4, F.col("l_quantity") / 50, F.col("l_discount") * 8, F.col("l_tax") * 10, F.lit(0.9))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.round(own, 6).alias("score"))


_OVER = "greatest(0, least(f.b[1] + f.b[3], box[1] + box[3]) - greatest(f.b[1], box[1])) * greatest(0, least(f.b[2] + f.b[4], box[2] + box[4]) - greatest(f.b[2], box[2]))"


@query(
    "D1_link_track",
    f"""WITH RECURSIVE {BOXES}, f0 AS (SELECT clip, frame_i, list_sort(list({{'b': bbox, 'sim': (part % 100) / 100}})) AS faces FROM b GROUP BY 1, 2), fr AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame_i) AS n FROM f0),
 r AS (SELECT DISTINCT clip, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE[]) AS box, CAST(-2 AS BIGINT) AS pick FROM fr UNION ALL
   SELECT clip, n, CASE WHEN faces[i].sim >= 0.25 THEN faces[i].b ELSE box END, CASE WHEN faces[i].sim >= 0.25 THEN i - 1 ELSE -1 END FROM (SELECT *, list_position(scores, list_max(scores)) AS i FROM
     (SELECT r.clip, fr.n, r.box, fr.faces, list_transform(fr.faces, lambda f: f.sim + CASE WHEN r.box IS NULL THEN 0 ELSE 0.3::DOUBLE * coalesce({_OVER} / nullif(f.b[3] * f.b[4] + box[3] * box[4] - {_OVER}, 0), 0) END) AS scores FROM r JOIN fr ON fr.clip = r.clip AND fr.n = r.n + 1)))
 SELECT clip, string_agg(pick, ',' ORDER BY n) AS picks FROM r WHERE n > 0 GROUP BY 1""",
)
def link(spark: SparkSession, sf: str) -> DataFrame:
    faces = F.struct("bbox", F.lit(0.9).alias("det"), ((F.col("part") % 100) / 100).alias("sim"))
    frames = boxes(spark, sf).groupBy("clip", "frame_i").agg(F.array_sort(F.collect_list(faces)).alias("faces"))
    picks = F.transform(F.array_sort(F.collect_list(F.struct("frame_i", "pick"))), lambda x: x["pick"].cast("string"))
    return track.link(frames, "clip").groupBy("clip").agg(F.array_join(picks, ",").alias("picks"))


@query(
    "D3_stable_size",
    f"""WITH {BOXES}, s AS (SELECT clip, list_sort(list(greatest(bbox[3], bbox[4]))) AS v, max(bbox[1] + bbox[3] / 2) - min(bbox[1] + bbox[3] / 2) AS dx, max(bbox[2] + bbox[4] / 2) - min(bbox[2] + bbox[4] / 2) AS dy FROM b GROUP BY 1),
 r AS (SELECT *, v[least(len(v) - 1, CAST(round_even(0.9 * (len(v) - 1), 0) AS BIGINT)) + 1] * 1.4::DOUBLE AS side FROM s) SELECT clip, round(side, 6) AS side, greatest(dx, dy) < 0.1::DOUBLE * side AS static FROM r""",
)
def stable(spark: SparkSession, sf: str) -> DataFrame:
    rows = boxes(spark, sf).select("clip", *(F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")))
    return geometry.stable_size(rows, "clip").withColumn("side", F.round("side", 6))


#: One face at most in a frame, of a width whose side is never midway between two hundredths; half of the users' faces move a lot. 25 frames a second, so windows of 21 frames, losses of 10 and glimpses of 5.
TRACK = """f AS (SELECT user_id AS clip, event_id AS frame_i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, event_type <> 'error' AND value >= 60 AS present,
   CASE WHEN user_id % 2 = 0 THEN value * 2 ELSE 300 + value / 50 END AS x0, 100 + value / 5 AS y0, 60.0031::DOUBLE + value / 10 AS w0, 55 + value / 10 AS h0, 0.2 + value / 1000 AS sim0 FROM events),
 n AS (SELECT *, x0 + w0 / 2 AS px, y0 + h0 / 2 AS py FROM f WHERE present),
 sz AS (SELECT clip, least(v[least(len(v) - 1, CAST(round_even(0.9 * (len(v) - 1), 0) AS BIGINT)) + 1] * 1.4::DOUBLE, 720) AS side FROM (SELECT clip, list_sort(list(greatest(w0, h0))) AS v FROM n GROUP BY 1)),
 i AS (SELECT f.*, side, last_value(CASE WHEN present THEN {'p': place, 'x': x0 + w0 / 2, 'y': y0 + h0 / 2} END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY place) AS a,
   first_value(CASE WHEN present THEN {'p': place, 'x': x0 + w0 / 2, 'y': y0 + h0 / 2} END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM f JOIN sz USING (clip)),
 c AS (SELECT *, CASE WHEN a IS NULL THEN b.x WHEN b IS NULL OR a.p = b.p THEN a.x ELSE a.x + (b.x - a.x) * (place - a.p) / (b.p - a.p) END AS cx, CASE WHEN a IS NULL THEN b.y WHEN b IS NULL OR a.p = b.p THEN a.y ELSE a.y + (b.y - a.y) * (place - a.p) / (b.p - a.p) END AS cy FROM i),
 m AS (SELECT *, quantile_cont(cx, 0.5) OVER w AS mx, quantile_cont(cy, 0.5) OVER w AS my FROM c WINDOW w AS (PARTITION BY clip ORDER BY place ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
 s AS (SELECT *, greatest(max(mx) OVER w - min(mx) OVER w, max(my) OVER w - min(my) OVER w) < side * 0.1::DOUBLE AS still, quantile_cont(mx, 0.5) OVER w AS sx, quantile_cont(my, 0.5) OVER w AS sy FROM m WINDOW w AS (PARTITION BY clip)),
 e AS (SELECT clip, place, mx AS ex, my AS ey FROM s WHERE place = 0 UNION ALL SELECT s.clip, s.place, 0.15::DOUBLE * mx + 0.85::DOUBLE * ex, 0.15::DOUBLE * my + 0.85::DOUBLE * ey FROM e JOIN s ON s.clip = e.clip AND s.place = e.place + 1),
 box AS (SELECT s.*, least(greatest(CASE WHEN still THEN sx ELSE ex END, side / 2), greatest(side / 2, 1200 - side / 2)) AS ox, least(greatest(CASE WHEN still THEN sy ELSE ey END, side / 2), greatest(side / 2, 720 - side / 2)) AS oy FROM s JOIN e USING (clip, place)),
 q AS (SELECT *, present OR coalesce(first_value(CASE WHEN present THEN place END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - last_value(CASE WHEN present THEN place END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY place) - 1 <= 10, FALSE) AS closed FROM f),
 ru AS (SELECT *, place - row_number() OVER (PARTITION BY clip, closed ORDER BY place) AS run FROM q), vis AS (SELECT *, closed AND count(*) OVER (PARTITION BY clip, closed, run) >= 5 AS visible FROM ru)"""


def face_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """clip, frame_i, faces; and clip, fps, frame_w, frame_h."""
    v = F.col("value")
    box = F.array(F.when(F.col("user_id") % 2 == 0, v * 2).otherwise(300 + v / 50), 100 + v / 5, 60.0031 + v / 10, 55 + v / 10)
    face = F.struct(box.alias("bbox"), F.lit(0.9).alias("det"), (0.2 + v / 1000).alias("sim"))
    seen = (F.col("event_type") != "error") & (v >= 60)
    frames = table(spark, sf, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame_i"), F.when(seen, F.array(face)).otherwise(F.array().cast(f"array<{face_kind()}>")).alias("faces"))
    return frames, frames.select("clip").distinct().select("clip", F.lit(25.0).alias("fps"), F.lit(1200).alias("frame_w"), F.lit(720).alias("frame_h"))


def face_kind() -> str:
    return "struct<bbox:array<double>,det:double,sim:double>"


@query("D3_stable_box", f"WITH RECURSIVE {TRACK} SELECT clip, frame_i, CASE WHEN still THEN 'static' ELSE 'slow' END AS mode, round(side, 6) AS side, round(ox + 0.0000123::DOUBLE, 4) AS cx, round(oy + 0.0000123::DOUBLE, 4) AS cy FROM box")
def stable_box(spark: SparkSession, sf: str) -> DataFrame:
    frames, clips = face_frames(spark, sf)
    linked = track.link(frames, "clip").join(clips, "clip")
    off = lambda c: F.round(F.col(c) + 0.0000123, 4).alias(c)  # noqa: E731  (many centres end in a 5, which would be rounded either way)
    return track.stable_box(linked, "clip").select("clip", "frame_i", "mode", F.round("side", 6).alias("side"), off("cx"), off("cy"))


@query("D4_presence", f"WITH RECURSIVE {TRACK} SELECT clip, frame_i, present, visible FROM vis")
def presence(spark: SparkSession, sf: str) -> DataFrame:
    frames, _ = face_frames(spark, sf)
    rows = frames.select("clip", "frame_i", (F.size("faces") > 0).alias("present"), F.lit(25.0).alias("fps"))
    return track.presence(rows, "clip", "frame_i", "present", "fps").select("clip", "frame_i", "present", "visible")


@query("D5_build", f"""WITH RECURSIVE {TRACK}, g AS (SELECT clip, max(n) AS gap FROM (SELECT clip, count(*) AS n FROM (SELECT *, place - row_number() OVER (PARTITION BY clip, present ORDER BY place) AS k FROM f) WHERE NOT present GROUP BY clip, k) GROUP BY 1),
 st AS (SELECT clip, count(*) AS frames, count(*) FILTER (WHERE present) AS detected, coalesce(avg(sim0) FILTER (WHERE present), 0) AS mean_sim, count(*) FILTER (WHERE present AND sim0 >= 0.363) AS anchors, coalesce(avg(h0) FILTER (WHERE present) / 720, 0) AS height,
   count(*) FILTER (WHERE visible) AS shown, count(*) FILTER (WHERE dark) AS cuts FROM (SELECT *, NOT visible AND coalesce(lag(visible) OVER (PARTITION BY clip ORDER BY place), TRUE) AS dark FROM vis) GROUP BY 1),
 ins AS (SELECT clip, any_value(CASE WHEN still THEN 'static' ELSE 'slow' END) AS mode, any_value(side) AS side, avg(CAST(x0 >= ox - side / 2 AND y0 >= oy - side / 2 AND x0 + w0 <= ox + side / 2 AND y0 + h0 <= oy + side / 2 AS INTEGER)) FILTER (WHERE present) AS inside FROM box GROUP BY 1),
 al AS (SELECT *, shown / frames AS v FROM st LEFT JOIN g USING (clip) JOIN ins USING (clip))
 SELECT clip, mode, round(side, 2) AS side, detected, round(detected / frames, 4) AS det_rate, coalesce(gap, 0) AS max_gap_frames, round(coalesce(gap, 0) / 25, 3) AS max_gap_seconds, round(mean_sim, 4) AS mean_sim, anchors, round(height, 4) AS mean_face_h_ratio, round(inside, 4) AS face_inside_ratio,
 round(v, 4) AS visible_ratio, round(1 - v, 4) AS black_ratio, cuts AS flicker_cuts, CASE WHEN anchors < 5 OR v < 0.3 THEN 'drop' WHEN v < 0.5 THEN 'low_confidence' ELSE 'ok' END AS status,
 concat_ws(';', CASE WHEN anchors < 5 THEN 'anchors=' || anchors || '<5' END, CASE WHEN v < 0.3 THEN format('visible={{:.2f}}<0.3', v) WHEN v < 0.5 AND anchors >= 5 THEN format('visible={{:.2f}}<0.5', v) END) AS reasons FROM al""")
def built(spark: SparkSession, sf: str) -> DataFrame:
    return track.build(*face_frames(spark, sf), "clip")[1].withColumn("reasons", F.array_join("reasons", ";"))


@query(
    "Q16_track_quality",
    """SELECT user_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS det_rate, round(avg(value / 500), 6) AS mean_sim, count(*) FILTER (WHERE value / 500 >= 0.363) AS anchors, round(avg(CASE WHEN value < 120 THEN 1.0 ELSE 0.0 END), 6) AS visible_ratio,
 CASE WHEN count(*) FILTER (WHERE value / 500 >= 0.363) < 5 OR avg(CASE WHEN value < 120 THEN 1.0 ELSE 0.0 END) < 0.3 THEN 'drop' WHEN avg(CASE WHEN value < 120 THEN 1.0 ELSE 0.0 END) < 0.5 THEN 'low_confidence' ELSE 'ok' END AS status FROM events GROUP BY 1""",
)
def track_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", (F.col("event_type") != "error").alias("detected"), (F.col("value") / 500).alias("sim"), (F.col("value") < 120).alias("visible"))
    out = geometry.track_quality(rows, "user_id")
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in ("det_rate", "mean_sim")), "anchors", F.round("visible_ratio", 6).alias("visible_ratio"), "status")


@query("D11_aligned_frames", "SELECT l_orderkey, l_partkey, l_suppkey, least(CAST(l_quantity AS BIGINT), CAST(floor(l_extendedprice / 1000) AS BIGINT), CAST(floor(l_tax * 20 * 25 + 1e-9) AS BIGINT)) AS frames FROM lineitem")
def aligned_frames(spark: SparkSession, sf: str) -> DataFrame:
    own = geometry.aligned_frames(F.col("l_quantity").cast("long"), F.floor(F.col("l_extendedprice") / 1000), F.col("l_tax") * 20, F.lit(25))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", own.alias("frames"))


WORDS = """w AS (SELECT conv_id * 100 + turn AS talk, unnest(list_filter(string_split(replace(trim(text), chr(10), ' '), ' '), lambda x: x <> '')) AS t,
   unnest(range(0, len(list_filter(string_split(replace(trim(text), chr(10), ' '), ' '), lambda x: x <> '')))) AS i FROM conversations),
 words AS (SELECT talk, i, t, CAST(i * 0.25 + (i * 7 % 11) * 0.05 AS DOUBLE) AS s, CAST(i * 0.25 + (i * 7 % 11) * 0.05 + (i * 5 % 4) * 0.1 AS DOUBLE) AS e FROM w)"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    parts = transcripts.tokens(F.translate("text", "\n", " "), F.lit("en"))
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("talk"), F.posexplode(parts).alias("i", "t"))
    s = F.col("i") * F.lit(0.25) + (F.col("i") * 7 % 11) * F.lit(0.05)
    return rows.select("talk", F.col("i").cast("long").alias("i"), "t", s.alias("s"), (s + (F.col("i") * 5 % 4) * F.lit(0.1)).alias("e"))


@query("F5_tokens", f"WITH {WORDS} SELECT talk, i, t FROM words")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).select("talk", "i", "t")


FIXED = WORDS + """, x AS (SELECT *, 0.04::DOUBLE * i + max(greatest(e, s + 0.04::DOUBLE) - 0.04::DOUBLE * i) OVER (PARTITION BY talk ORDER BY i) AS e2 FROM words),
 fixed AS (SELECT talk, i, t, greatest(s, coalesce(lag(e2) OVER (PARTITION BY talk ORDER BY i), s)) AS s2, e2 FROM x)"""


@query("D6_normalise", f"""WITH RECURSIVE {WORDS}, early AS (SELECT talk, i, s - 0.1 AS s, e - 0.1 AS e FROM words),
 r AS (SELECT talk, i, greatest(s, 0) AS b, greatest(e, greatest(s, 0) + 0.04) AS f FROM early WHERE i = 0 UNION ALL
   SELECT w.talk, w.i, greatest(w.s, r.f), greatest(w.e, greatest(w.s, r.f) + 0.04) FROM r JOIN early w ON w.talk = r.talk AND w.i = r.i + 1),
 l AS (SELECT *, max(f) OVER (PARTITION BY talk) AS last FROM r)
 SELECT talk, i, round(b * CASE WHEN last > 10 THEN 10 / last ELSE 1 END, 6) AS start, round(f * CASE WHEN last > 10 THEN 10 / last ELSE 1 END, 6) AS "end" FROM l""")
def repaired(spark: SparkSession, sf: str) -> DataFrame:
    early = words(spark, sf).withColumns({"s": F.col("s") - F.lit(0.1), "e": F.col("e") - F.lit(0.1)})
    out = transcripts.compress(transcripts.normalise(early, "talk"), "talk", F.lit(10.0))
    return out.select("talk", "i", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("D7_sentences", f"""WITH {FIXED}, m AS (SELECT *, coalesce(CAST(sum(CASE WHEN regexp_matches(t, '[.!?。！？…]$') THEN 1 ELSE 0 END) OVER (PARTITION BY talk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS sentence FROM fixed)
 SELECT talk, sentence, round(min(s2), 3) AS start, round(max(e2), 3) AS "end", string_agg(t, ' ' ORDER BY i) AS text FROM m GROUP BY 1, 2""")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.sentences(transcripts.normalise(words(spark, sf), "talk"), "talk")


@query("D8_violations", f"""WITH {WORDS}, p AS (SELECT *, lag(e) OVER (PARTITION BY talk ORDER BY i) AS pe FROM words) SELECT talk, i, 'order' AS rule FROM p WHERE s < pe UNION ALL SELECT talk, i, 'width' FROM p WHERE e <= s UNION ALL SELECT talk, i, 'bounds' FROM p WHERE s < 0 OR e > 20""")
def violations(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.violations(words(spark, sf), "talk", F.lit(20.0))


SENTENCED = WORDS + """, g AS (SELECT *, i // 4 AS sentence FROM words), sn AS (SELECT talk, sentence, min(s) AS a, max(e) - 0.12 AS z FROM g GROUP BY 1, 2)"""


@query("D8_sentence_violations", f"""WITH {SENTENCED}, p AS (SELECT *, lag(z) OVER (PARTITION BY talk ORDER BY sentence) AS pz FROM sn), q AS (SELECT g.*, a, z, lag(e) OVER (PARTITION BY g.talk, g.sentence ORDER BY i) AS pe FROM g JOIN sn USING (talk, sentence))
 SELECT talk, sentence, NULL AS i, 'order' AS rule FROM p WHERE a < coalesce(pz, 0) UNION ALL SELECT talk, sentence, NULL, 'width' FROM p WHERE z <= a UNION ALL SELECT talk, sentence, i, 'word order' FROM q WHERE s < coalesce(pe, a)
 UNION ALL SELECT talk, sentence, i, 'word width' FROM q WHERE e <= s UNION ALL SELECT talk, sentence, i, 'word outside' FROM q WHERE e > z""")
def sentence_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of four words whose end is set a little too early."""
    rows = words(spark, sf).withColumn("sentence", F.floor(F.col("i") / 4))
    own = rows.groupBy("talk", "sentence").agg(F.min("s").alias("start"), (F.max("e") - 0.12).alias("end"))
    return transcripts.sentence_violations(own, rows, "talk")


@query("D9_pull_back", f"""WITH RECURSIVE {WORDS}, n AS (SELECT *, greatest(e - s, 0) AS width, row_number() OVER (PARTITION BY talk ORDER BY i DESC) AS k FROM words),
 r AS (SELECT DISTINCT talk, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS i, CAST(12 AS DOUBLE) AS a, CAST(12 AS DOUBLE) AS z FROM words UNION ALL
   SELECT r.talk, n.k, n.i, greatest(least(n.e, r.a) - width, 0), CASE WHEN least(n.e, r.a) - width < 0 THEN least(width, r.a) ELSE least(n.e, r.a) END FROM r JOIN n ON n.talk = r.talk AND n.k = r.k + 1)
 SELECT talk, i, CAST(round(a, 5) AS DOUBLE) AS start, CAST(round(z, 5) AS DOUBLE) AS "end" FROM r WHERE k > 0""")
def pull_back(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.pull_back(words(spark, sf), "talk", F.lit(12.0)).select("talk", "i", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"))


@query("D10_place_missing", f"""WITH {WORDS}, k AS (SELECT talk, i, CASE WHEN i % 3 <> 1 THEN s END AS s, CASE WHEN i % 3 <> 1 THEN e END AS e FROM words),
 n AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY talk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(s IGNORE NULLS) OVER (PARTITION BY talk ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM k)
 SELECT talk, i, round(coalesce(s, (coalesce(b, f, 0) + coalesce(f, b, 0)) / 2), 6) AS s, CASE WHEN s IS NULL THEN -1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM n""")
def place_missing(spark: SparkSession, sf: str) -> DataFrame:
    own = words(spark, sf)
    seen = F.col("i") % 3 != 1
    rows = own.select("talk", "i", F.when(seen, F.col("s")).alias("s"), F.when(seen, F.col("e")).alias("e"), F.lit(0.5).alias("score"))
    return transcripts.place_missing(rows, "talk").select("talk", "i", F.round("s", 6).alias("s"), "score")


@query("Q14_alignment_quality", f"""WITH {WORDS}, p AS (SELECT *, s >= coalesce(lag(s) OVER (PARTITION BY talk ORDER BY i), s) AS ok FROM words)
 SELECT talk, bool_and(ok) AS monotonic, round(avg(CAST(s BETWEEN 0.85 AND 6.15 OR s BETWEEN 7.85 AND 20.15 AS INTEGER)), 3) AS in_speech, round((max(e) - min(s)) / 60, 4) AS span_ratio, round(avg((i % 10) / 10), 4) AS mean_score, round(60 - max(e), 4) AS silent_tail FROM p GROUP BY 1""")
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.alignment_quality(words(spark, sf).withColumn("score", F.col("i") % 10 / 10), "talk", F.lit(60.0), F.array(F.array(F.lit(1.0), F.lit(6.0)), F.array(F.lit(8.0), F.lit(20.0))))


@query(
    "F6_spoken_numbers",
    """WITH w AS (SELECT ['ZERO','ONE','TWO','THREE','FOUR','FIVE','SIX','SEVEN','EIGHT','NINE','TEN','ELEVEN','TWELVE','THIRTEEN','FOURTEEN','FIFTEEN','SIXTEEN','SEVENTEEN','EIGHTEEN','NINETEEN'] AS ones,
   ['TWENTY','THIRTY','FORTY','FIFTY','SIXTY','SEVENTY','EIGHTY','NINETY'] AS tens),
 h AS (SELECT n, CASE WHEN n < 20 THEN ones[n + 1] ELSE tens[n // 10 - 1] || CASE WHEN n % 10 > 0 THEN ' ' || ones[n % 10 + 1] ELSE '' END END AS t FROM w, range(0, 100) r(n)),
 k AS (SELECT r.n, CASE WHEN r.n < 100 THEN b.t ELSE a.t || ' HUNDRED' || CASE WHEN r.n % 100 > 0 THEN ' ' || b.t ELSE '' END END AS t FROM range(0, 1000) r(n) JOIN h a ON a.n = r.n // 100 JOIN h b ON b.n = r.n % 100),
 s AS (SELECT p.*, CASE WHEN p_partkey < 1000 THEN b.t ELSE a.t || ' THOUSAND' || CASE WHEN p_partkey % 1000 > 0 THEN ' ' || b.t ELSE '' END END AS key FROM part p JOIN k a ON a.n = p_partkey // 1000 JOIN k b ON b.n = p_partkey % 1000)
 SELECT s.p_partkey, trim('BRAND ' || c.t || '   ' || d.t || ' ' || 'DON''TOK ' || s.key) AS words FROM s JOIN k c ON c.n = CAST(substr(s.p_brand, 7) AS INTEGER) JOIN k d ON d.n = s.p_size""",
)
def spoken(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", transcripts.spoken(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_size").cast("string"), F.lit("don't?o.K."), F.col("p_partkey").cast("string"))).alias("words"))


@query("Z20_word_spans", f"WITH {WORDS} SELECT talk, i // 3 AS word, min(s) AS s, max(e) AS e, round(avg((i % 10) / 10), 6) AS score FROM words GROUP BY 1, 2")
def word_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = words(spark, sf)
    tokens = rows.select("talk", F.floor(F.col("i") / 3).alias("word"), "s", "e", (F.col("i") % 10 / 10).alias("score"))
    return transcripts.word_spans(tokens, "talk").withColumn("score", F.round("score", 6))


@query("D2_templates", f"""WITH RECURSIVE {SIMILAR}, {PARTS}, r AS (SELECT label, v AS ref FROM u QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) = 1),
 k AS (SELECT u.label, u.id, v, list_inner_product(v, ref) AS sim FROM u JOIN r USING (label)), a AS (SELECT * FROM k WHERE sim >= 0.363), n AS (SELECT label FROM a GROUP BY 1 HAVING count(*) >= 5),
 c AS (SELECT label, i, avg(v[i]) AS x FROM a, range(1, 65) t(i) WHERE label IN (SELECT label FROM n) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS t FROM c GROUP BY 1)
 SELECT k.id, round(CASE WHEN m.t IS NULL THEN k.sim ELSE greatest(k.sim, list_inner_product(k.v, [x / sqrt(list_sum([y * y FOR y IN m.t])) FOR x IN m.t])) END, 6) AS sim FROM k LEFT JOIN m USING (label)""".replace("WITH RECURSIVE " + SIMILAR + ", " + PARTS, "WITH " + UNIT))
def templates(spark: SparkSession, sf: str) -> DataFrame:
    """Second pass: similarity to the reference (a label's first vector), or to the mean of the anchors, those like the
    reference, if that is larger and there are five anchors at least."""
    own = vectors(spark, sf)
    first = own.groupBy("label").agg(F.min_by("v", "id").alias("ref"))
    return graph.second_pass(own.join(first, "label"), "label", 5).select("id", F.round("sim", 6).alias("sim"))


@query("L5_spaced_frames", """WITH a AS (SELECT user_id, event_id, value FROM events), p AS (SELECT user_id, arg_min(event_id, (-value, event_id)) AS a FROM a GROUP BY 1),
 s AS (SELECT p.user_id, p.a, arg_min(event_id, (-value, event_id)) AS b FROM p JOIN a ON a.user_id = p.user_id AND abs(event_id - p.a) >= 2 GROUP BY 1, 2),
 t AS (SELECT s.user_id, arg_min(event_id, (-value, event_id)) AS c FROM s JOIN a ON a.user_id = s.user_id AND abs(event_id - s.a) >= 2 AND abs(event_id - s.b) >= 2 GROUP BY 1)
 SELECT user_id, 0 AS k, a AS event_id FROM p UNION ALL SELECT user_id, 1, b FROM s UNION ALL SELECT user_id, 2, c FROM t""")
def spaced_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's three best events that lie two apart at least, best first. Each choice shuts out three places at most, so
    the nine best decide: a fold over those."""
    order = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(order).alias("n")).where("n <= 9")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda x: x["event_id"])
    take = lambda s, x: F.when((F.size(s) < 3) & ~F.exists(s, lambda y: F.abs(y - x) < 2), F.concat(s, F.array(x))).otherwise(s)
    picked = rows.groupBy("user_id").agg(F.aggregate(ordered, F.array().cast("array<bigint>"), take).alias("o"))
    return picked.select("user_id", F.posexplode("o").alias("k", "event_id"))


@query("F13_pick_quality", "SELECT event_id, round((value / 500) * (0.7 + 0.3 * least(1, value / max(value) OVER (PARTITION BY user_id))), 6) AS quality FROM events")
def pick_quality(spark: SparkSession, sf: str) -> DataFrame:
    sharp = F.col("value") / F.max("value").over(Window.partitionBy("user_id"))
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") / 500 * (0.7 + 0.3 * F.least(F.lit(1), sharp)), 6).alias("quality"))


QUERIES, ORACLES = registry.queries, registry.oracles
