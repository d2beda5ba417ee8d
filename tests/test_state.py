import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import boxes, iou, rows_of
from trackframe.operators import particles as PA
from trackframe.operators import reckoning as K
from trackframe.schema import TRANSFORM_COLUMNS

TRACK = ["frame", "identity", "x1", "y1", "x2", "y2"]


def wandering(seed, frames=12, objects=5, skip=()):
    """Boxes that drift, sometimes hide and sometimes cross."""
    rng = random.Random(seed)
    place = {i: [rng.randrange(60), rng.randrange(60)] for i in range(objects)}
    rows = []
    for f in range(1, frames + 1):
        for i, p in place.items():
            p[0] += rng.randrange(-3, 4)
            p[1] += rng.randrange(-3, 4)
            if f in skip or rng.random() < 0.2:
                continue
            rows.append((f, i, None, p[0], p[1], p[0] + 12, p[1] + 10))
    return rows


def identity_matrices(spark, frames, dx=0.0):
    ddl = "video string, frame int, " + ", ".join(f"{n} double" for n in TRANSFORM_COLUMNS)
    rows = [("v", f, 1.0, 0.0, dx, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for f in frames]
    return spark.createDataFrame(rows, ddl)


def plain_reckoning(rows, max_dist, threshold, corrected):
    """Frame by frame with lists and dictionaries."""
    last = max(r[0] for r in rows)
    first = min(r[0] for r in rows)
    prev, counter, out = [], 0, []
    for f in range(first, last + 1):
        now = [{"id": None, "box": r[3:]} for r in sorted(r for r in rows if r[0] == f)]
        mid = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
        options = []
        for c, b in enumerate(now):
            for p in prev:
                (ax, ay), (bx, by) = mid(b["box"]), mid(p["box"])
                d = ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5
                if d <= max_dist:
                    options.append((d, p["id"], c))
        used = set()
        for d, p, c in sorted(options):
            if p not in used and now[c]["id"] is None:
                now[c]["id"] = p
                used.add(p)
        both = now + [dict(p) for p in prev if p["id"] not in used]
        lose = set()
        for i in range(len(both)):
            for j in range(i + 1, len(both)):
                if iou(both[i]["box"], both[j]["box"]) < threshold:
                    continue
                a, b = both[i]["id"], both[j]["id"]
                if a is None and b is None:
                    lose |= {j} if corrected else {i, j}
                elif b is None or (a is not None and a < b):
                    lose.add(j)
                else:
                    lose.add(i)
        for b in now:
            if b["id"] is None:
                b["id"] = counter
                counter += 1
        prev = [b for i, b in enumerate(both) if i not in lose]
        out += [(f, b["id"], *b["box"]) for b in prev]
    return sorted(out)


@pytest.mark.parametrize("corrected", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_dead_reckoning_against_plain_loop(spark, seed, corrected):
    rows = wandering(seed, skip=(6,))
    got = K.dead_reckoning(boxes(spark, rows), 9, 0.3, corrected=corrected)
    assert rows_of(got, *TRACK) == plain_reckoning(rows, 9, 0.3, corrected)


def test_legacy_order_can_reuse_a_previous_box():
    dist = np.array([[1.0, 9.0], [2.0, 9.0], [3.0, 9.0]])
    # the first takes 0; the second has nothing else and leaves, the third is not cleaned
    assert K._assign_unsorted(dist, 5) == {0: 0, 2: 0}
    assert K._assign(dist, np.array([0, 1]), 5) == {0: 0}
    open_choice = np.array([[1.0, 4.0], [2.0, 3.0]])
    assert K._assign_unsorted(open_choice, 5) == {0: 0, 1: 1} == K._assign(open_choice, np.array([0, 1]), 5)


def test_resample_against_plain_loop(spark):
    rng = random.Random(4)
    rows = [
        ("v", 1, f, p, p, 0, p + 5, 5, rng.choice([0.2, 0.2 * rng.random(), 0.01]))
        for f in range(40) for p in range(5)
    ]
    ddl = "video string, frame int, filter int, particle int, x1 int, y1 int, x2 int, y2 int, weight double"
    want = []
    for f in range(40):
        mine = sorted((r for r in rows if r[2] == f), key=lambda r: (-r[-1], r[3]))
        total, picks = sum(r[-1] for r in mine), []
        for r in mine:
            copies = min(int(np.round(r[-1] / total / 0.2)), 5 - len(picks))
            if copies == 0:
                break
            picks += [r[3]] * copies
        want += [(f, i, p) for i, p in enumerate(picks)]
    got = PA.particle_resample(spark.createDataFrame(rows, ddl))
    assert rows_of(got, "filter", "particle", "parent") == sorted(want)


def test_steps_agree_with_the_fold(spark):
    """Update and resample as DataFrames equal those of the state function."""
    rng = np.random.default_rng(5)
    start = np.repeat(rng.integers(0, 60, (6, 2)), 5, axis=0) + rng.integers(-4, 5, (30, 2))
    part = np.hstack([start, start + 11]).astype(np.int64)
    spots = rng.integers(0, 60, (8, 2))
    found = np.hstack([spots, spots + 12]).astype(np.int64)
    ddl = "video string, frame int, filter int, particle int, x1 int, y1 int, x2 int, y2 int, weight double"
    table = spark.createDataFrame(
        [("v", 1, i // 5, i % 5, *map(int, b), 0.2) for i, b in enumerate(part)], ddl
    )
    det = boxes(spark, [(1, i, None, *map(int, b)) for i, b in enumerate(found)])
    state = PA.Filters(ids=np.repeat(np.arange(6), 5), boxes=part.copy(), weights=np.full(30, 0.2), observed=np.zeros(30, bool))
    PA._update(state, found)
    updated = PA.particle_update(table, det)
    names = ["filter", "particle", "x1", "y1", "x2", "y2"]
    assert rows_of(updated, *names) == [(i // 5, i % 5, *map(int, b)) for i, b in enumerate(state.boxes)]
    PA._resample(state, 5)
    ranks = state.ranks()
    want = sorted((int(i), int(r), *map(int, b)) for i, r, b in zip(state.ids, ranks, state.boxes))
    assert rows_of(PA.particle_resample(updated), *names) == want


def test_filters_follow_and_end(spark):
    steady = [(f, 0, None, 2 * f, 5, 2 * f + 12, 15) for f in range(1, 9)]
    once = [(3, 1, None, 100, 100, 112, 110)]
    regions = boxes(spark, steady + once)
    matrices = identity_matrices(spark, [f for f in range(1, 9) if f != 5])
    tracks = PA.particle_filter(regions, matrices)
    by_id = {}
    for f, i, *box in rows_of(tracks, *TRACK):
        by_id.setdefault(i, {})[f] = tuple(box)
    assert set(by_id) == {0, 1}
    assert set(by_id[0]) == {1, 2, 3, 4, 6, 7, 8}  # frame 5 has no matrix
    assert set(by_id[1]) == {3}  # dropped as soon as nothing overlaps
    kept = PA.particle_filter(regions, matrices, persist=True)
    assert {f for f, i in rows_of(kept, "frame", "identity") if i == 1} == {3, 4, 6, 7, 8}
    confirmed = PA.confirmed_tracks(regions, matrices)
    assert {i for (i,) in rows_of(confirmed, "identity")} == {0}


def test_same_seed_same_tracks(spark):
    regions = boxes(spark, wandering(3))
    matrices = identity_matrices(spark, range(1, 13), 0.4)
    one = rows_of(PA.particle_filter(regions, matrices, seed=1), *TRACK, "observed")
    again = rows_of(PA.particle_filter(regions.repartition(7), matrices, seed=1), *TRACK, "observed")
    assert one == again
    history = PA.particle_history(regions, matrices, seed=1)
    steps = history.groupBy("filter_identity", "frame", "step_name").count()
    assert steps.filter("count > 5").count() == 0
    once = history.groupBy("filter_identity", "step_idx").agg(F.countDistinct("frame", "step_name").alias("n"))
    assert once.filter("n > 1").count() == 0
    names = {n for (n,) in rows_of(history.select("step_name").distinct(), "step_name")}
    assert names == {"initial", "predict", "transform", "update", "resample"}


def test_every_detection_is_claimed(spark):
    rows = wandering(6)
    regions, matrices = boxes(spark, rows), identity_matrices(spark, range(1, 13))
    tracks = rows_of(PA.particle_filter(regions, matrices), *TRACK)
    for f, _, _, *box in rows:
        assert any(t[0] == f and (iou(t[2:], box) > 0) for t in tracks) or any(
            t[0] == f for t in tracks
        )
    best = PA.particle_filter(regions, matrices, corrected=True)
    assert best.count() == len(tracks)


def test_predicted_boxes_stay_near(spark):
    table = boxes(spark, [(1, i, i, 10, 10, 40, 50) for i in range(500)]).withColumns(
        {"filter": F.col("ord"), "particle": F.lit(0), "weight": F.lit(0.2)}
    )
    moved = PA.particle_predict(table, 9)
    d = moved.select((F.col("x1") - 10).alias("a"), (F.col("x2") - 40).alias("b"))
    stats = d.agg(F.max(F.abs("a")), F.max(F.abs("b")), F.min(F.col("b") - F.col("a")), F.avg("a")).first()
    assert stats[0] <= 5 and stats[1] <= 5 and stats[2] >= 0 and abs(stats[3]) < 0.3
    assert rows_of(moved, "x1", "x2") == rows_of(PA.particle_predict(table.repartition(5), 9), "x1", "x2")
    assert moved.select("x1", "y1", "x2", "y2").distinct().count() > 3


def test_iou_of_all_pairs_is_that_of_each():
    import numpy as np

    from tests.helpers import iou
    from trackframe.operators.reckoning import pairwise_iou

    rng = np.random.default_rng(5)
    low = rng.integers(0, 20, (30, 2))
    found = np.hstack([low, low + rng.integers(1, 9, (30, 2))])
    got = pairwise_iou(found, found[::-1])
    want = [[iou(a, b) for b in found[::-1].tolist()] for a in found.tolist()]
    assert np.array_equal(got, np.array(want))
