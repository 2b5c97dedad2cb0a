"""The track build against a plain loop over one clip's frames."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from curvelake.operators import geometry, track

FACES = "clip string, frame_i int, faces array<struct<bbox:array<double>,det:double,sim:double>>"
CLIPS = "clip string, fps double, frame_w int, frame_h int"


def face(x, y, w=100, h=120, sim=0.6, det=0.95):
    return ([float(x), float(y), float(w), float(h)], det, sim)


def runs(values, value):
    out = []
    for i, v in enumerate(values):
        if v == value:
            if out and out[-1][1] == i - 1:
                out[-1][1] = i
            else:
                out.append([i, i])
    return out


def over(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def loop(frames, fps, wide, high):
    """visible, boxes, mode, side, status, reasons, flicker."""
    picked, last = [], None
    for faces in frames:
        fair = [f for f in faces if f[1] >= 0.7 and f[0][3] >= 0.07 * high]
        best = max(fair, key=lambda f: f[2] + (0.3 * over(f[0], last) if last else 0), default=None)
        picked.append(best if best and best[2] >= 0.25 else None)
        last = picked[-1][0] if picked[-1] else last
    n, found = len(picked), [i for i, f in enumerate(picked) if f]
    if not found:
        return picked, None
    sizes = sorted(max(picked[i][0][2:]) for i in found)
    side = min(sizes[min(len(sizes) - 1, round(0.9 * (len(sizes) - 1)))] * 1.4, min(wide, high))
    middle = {i: (picked[i][0][0] + picked[i][0][2] / 2, picked[i][0][1] + picked[i][0][3] / 2) for i in found}
    centres = []
    for i in range(n):
        a, b = max((k for k in found if k <= i), default=found[0]), min((k for k in found if k >= i), default=found[-1])
        share = (i - a) / (b - a) if a < i < b else 0
        centres.append(tuple(p + (q - p) * share for p, q in zip(middle[a], middle[b], strict=True)))
    half = max(3, round(fps * 0.8) | 1) // 2
    medians = [tuple(statistics.median(c[d] for c in centres[max(0, i - half) : i + half + 1]) for d in (0, 1)) for i in range(n)]
    still = max(max(m[d] for m in medians) - min(m[d] for m in medians) for d in (0, 1)) < 0.1 * side
    at, boxes = medians[0], []
    for m in medians:
        at = tuple(0.15 * x + 0.85 * y for x, y in zip(m, at, strict=True))
        where = tuple(statistics.median(x[d] for x in medians) for d in (0, 1)) if still else at
        boxes.append(tuple(min(max(x, side / 2), max(side / 2, limit - side / 2)) for x, limit in zip(where, (wide, high), strict=True)))
    visible = [bool(f) for f in picked]
    for a, b in runs(visible, False):
        if a > 0 and b < n - 1 and b - a < max(1, round(0.4 * fps)):
            visible[a : b + 1] = [True] * (b + 1 - a)
    for a, b in runs(visible, True):
        if b - a + 1 < max(1, round(0.2 * fps)):
            visible[a : b + 1] = [False] * (b + 1 - a)
    share, anchors = sum(visible) / n, sum(picked[i][2] >= 0.363 for i in found)
    reasons = [f"anchors={anchors}<5"] * (anchors < 5) + [f"visible={share:.2f}<0.3"] * (share < 0.3)
    status = "drop" if reasons else "low_confidence" if share < 0.5 else "ok"
    reasons = reasons or [f"visible={share:.2f}<0.5"] * (share < 0.5)
    return picked, (visible, boxes, "static" if still else "slow", side, status, reasons, len(runs(visible, False)))


def clip(rng):
    x, y, out = rng.uniform(0, 800), rng.uniform(0, 300), []
    pace, loss = rng.choice([0, 1, 25]), rng.choice([0.05, 0.4, 0.8])
    gone = False
    for _ in range(rng.randrange(1, 90)):
        gone = rng.random() < (0.9 if gone else loss)
        x, y = x + rng.gauss(pace, 3), y + rng.gauss(0, 3)
        faces = [] if gone else [face(x, y, rng.uniform(60, 300), rng.uniform(60, 300), round(rng.uniform(0.2, 0.8), 3))]
        if rng.random() < 0.3:
            faces.append(face(rng.uniform(0, 1000), y, 90, rng.choice([20, 120]), round(rng.uniform(0.2, 0.8), 3), rng.choice([0.5, 0.9])))
        out.append(faces)
    return out


CASES = {
    "still": [[face(500 + i % 2, 300)] for i in range(30)],
    "across": [[face(100 + 40 * i, 300)] for i in range(30)],
    "jump": [[face(100, 300)]] * 15 + [[face(1500, 300)]] * 15,
    "outlier": [[face(500, 300)]] * 20 + [[face(1400, 300)]] + [[face(500, 300)]] * 20,
    "lost": [[face(500, 300)], [], [], [face(520, 300)]],
    "late": [[], [], [face(800, 300)]],
    "corner": [[face(0, 0, 200, 200)]] * 10,
    "large": [[face(100, 100, 700, 700)]] * 10,
    "none": [[], [], []],
    "cut": [[face(500, 300)] if i < 15 or i >= 40 else [] for i in range(55)],
    "profile": [[] if 10 <= i < 22 else [face(500, 300)] for i in range(40)],
    "glimpse": [[face(5, 300)]] * 15 + [[]] * 12 + [[face(5, 300)]] + [[]] * 12 + [[face(5, 300)]] * 15,
    "flicker": [[face(5, 300)]] + [[face(5, 300)] if i % 2 else [] for i in range(38)] + [[face(5, 300)]],
}


@pytest.mark.parametrize("fps", [25.0, 29.97, 12.5])
def test_build_equals_a_loop(spark, fps):
    rng = random.Random(fps)
    cases = CASES | {f"random {i}": clip(rng) for i in range(25)}
    frames = spark.createDataFrame([(k, i, faces) for k, own in cases.items() for i, faces in enumerate(own)], FACES).repartition(3)
    clips = spark.createDataFrame([(k, fps, 1920, 720) for k in cases], CLIPS)
    crop, summary = track.build(frames, clips, "clip")
    rows = {}
    for r in crop.orderBy("frame_i").collect():
        rows.setdefault(r.clip, []).append(r)
    said = {r.clip: r for r in summary.collect()}
    for k, own in cases.items():
        picked, want = loop(own, fps, 1920, 720)
        s = said[k]
        assert s.detected == sum(bool(f) for f in picked)
        assert s.max_gap_frames == max((b - a + 1 for a, b in runs([bool(f) for f in picked], False)), default=0)
        if want is None:
            assert k not in rows and s.mode is None and s.status == "drop" and s.reasons == ["det_rate=0.00<0.3", "anchors=0<5"] and s.det_rate == 0
            continue
        visible, boxes, mode, side, status, reasons, cuts = want
        assert [r.visible for r in rows[k]] == visible and [r.place for r in rows[k]] == list(range(len(own)))
        assert [r.present for r in rows[k]] == [bool(f) for f in picked]
        assert [r.bbox for r in rows[k]] == [[pytest.approx(v, abs=0.051) for v in f[0]] if f else None for f in picked]
        assert [(r.cx, r.cy) for r in rows[k]] == [(pytest.approx(x, abs=0.006), pytest.approx(y, abs=0.006)) for x, y in boxes]
        assert (s.mode, s.status, s.reasons, s.flicker_cuts) == (mode, status, reasons, cuts) and abs(s.side - side) < 0.006
        inside = [x >= cx - side / 2 and y >= cy - side / 2 and x + w <= cx + side / 2 and y + h <= cy + side / 2 for f, (cx, cy) in zip(picked, boxes, strict=True) if f for x, y, w, h in [f[0]]]
        assert abs(s.face_inside_ratio - sum(inside) / len(inside)) < 1e-4
        assert abs(s.visible_ratio - sum(visible) / len(visible)) < 1e-4 and abs(s.visible_ratio + s.black_ratio - 1) < 1e-9
    assert said["still"].mode == said["outlier"].mode == "static" and said["across"].mode == "slow"
    assert said["profile"].status == "ok" and said["cut"].flicker_cuts == 1


def test_a_tighter_margin_leaves_less_of_a_moving_face_inside(spark):
    frames = spark.createDataFrame([("m", i, [face(500 + (0 if i % 2 else 120), 300)]) for i in range(20)], FACES)
    clips = spark.createDataFrame([("m", 25.0, 1920, 720)], CLIPS)
    loose, tight = (track.build(frames, clips, "clip", margin=m)[1].first().face_inside_ratio for m in (0.6, 0.05))
    assert loose > tight


def test_the_second_pass_counts_anchors_by_the_reference_alone(spark):
    kind = "clip string, frame_i int, faces array<struct<bbox:array<double>,det:double,sim:double,sim_ref:double>>"
    frames = spark.createDataFrame([("m", i, [([1.0, 1.0, 90.0, 90.0], 0.9, 0.9, 0.9 if i < 4 else 0.1)]) for i in range(9)], kind)
    out = track.build(frames, spark.createDataFrame([("m", 25.0, 1920, 720)], CLIPS), "clip")[1].first()
    assert (out.anchors, out.reasons) == (4, ["anchors=4<5"])


def test_a_straight_face_is_frontal(spark):
    point = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    straight, turned, tilted, away = spark.range(1).select(
        *(geometry.frontality(point(*a), point(*b), point(*c)) for a, b, c in (((0, 0), (10, 0), (5, 3)), ((0, 0), (10, 0), (7, 3)), ((0, 0), (6, 8), (3, 4)), ((0, 0), (10, 0), (20, 0))))
    ).first()
    assert (round(straight, 5), round(turned, 5), round(tilted, 5), away) == (1.0, 1 - 0.2 * 1.4, round(1 - 0.8 * 0.8, 5), 0.0)
