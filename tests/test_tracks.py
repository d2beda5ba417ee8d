import math
import random

import pytest

from tests.helpers import boxes, iou, rows_of
from trackframe.operators import tracks as T
from trackframe.operators.running import FRAME_CHUNK, running, row_numbers
from pyspark.sql import functions as F


def test_velocity_ignores_gaps_and_crosses_chunks(spark):
    far = FRAME_CHUNK * 3 + 1
    table = boxes(
        spark,
        [(1, 0, 1, 0, 0, 10, 10), (5, 0, 1, 3, 4, 13, 14), (far, 0, 1, 3, 10, 13, 20), (2, 0, 2, 0, 0, 4, 4)],
    )
    got = rows_of(T.velocity(table, 30), "identity", "frame", "velocity")
    assert got == [(1, 5, 150.0), (1, far, 180.0)]
    angles = dict(rows_of(T.direction(table), "frame", "direction"))
    assert math.isclose(angles[5], math.atan2(4, 3))
    assert math.isclose(angles[far], math.pi / 2)


def test_running_equals_plain_loop(spark):
    rng = random.Random(1)
    rows = [(k, o, rng.choice([None, *range(20)])) for k in "ab" for o in rng.sample(range(400), 120)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    for inclusive in (True, False):
        got = running(
            df, ["k"], ["o"], F.floor(F.col("o") / 7),
            {n: (n, F.col("v")) for n in ("max", "min", "sum", "last")}, inclusive,
        )
        want = []
        for k in "ab":
            seen = []
            for _, o, v in sorted(r for r in ((a, b, c) for a, b, c in rows if a == k) if True):
                if inclusive:
                    seen.append(v)
                vals = [s for s in seen if s is not None]
                want.append((k, o, max(vals, default=None), min(vals, default=None), sum(vals), vals[-1] if vals else None))
                if not inclusive:
                    seen.append(v)
        found = sorted(tuple(r) for r in got.select("k", "o", "max", "min", "sum", "last").collect())
        assert found == sorted(want)
    numbered = row_numbers(df, ["k"], ["o"], F.floor(F.col("o") / 7))
    for k in "ab":
        ordered = [r["rn"] for r in numbered.filter(F.col("k") == k).orderBy("o").collect()]
        assert ordered == list(range(1, 121))


def motion_rows(rng):
    rows, place = [], {}
    for f in range(1, 41):
        for i in range(3):
            if rng.random() < 0.3:
                continue
            x = place.get(i, 0) + (rng.choice([0, 0, 1, 5]) if f % 7 == 0 else 0)
            place[i] = x
            rows.append((f, i, i, x, 50 * i, x + 10, 50 * i + 10))
    return rows


def moved(r, others, back, ahead):
    return any(
        s[2] == r[2] and s[0] != r[0] and -back <= s[0] - r[0] <= ahead and iou(r[3:], s[3:]) <= 0.425
        for s in others
    )


@pytest.mark.parametrize("back, ahead", [(4, 6), (8, 1)])
def test_motion_only_as_a_set_and_in_order(spark, back, ahead):
    rows = motion_rows(random.Random(2))
    table = boxes(spark, rows)
    want = sorted((r[0], r[1]) for r in rows if moved(r, rows, back, ahead))
    assert rows_of(T.motion_only(table, back, ahead), "frame", "ord") == want
    left = list(rows)
    for r in sorted(rows):
        if not moved(r, left, back, ahead):
            left.remove(r)
    got = rows_of(T.motion_only_in_order(table, back, ahead), "frame", "ord")
    assert got == sorted((r[0], r[1]) for r in left)


def test_dropped_boxes_prove_nothing_in_order(spark):
    table = boxes(spark, [(1, 0, 0, 0, 0, 10, 10), (5, 0, 0, 30, 0, 40, 10)])
    # frame 1 looks one frame ahead and sees nothing; frame 5 looks back at it
    assert rows_of(T.motion_only(table, 8, 1), "frame") == [(5,)]
    assert rows_of(T.motion_only_in_order(table, 8, 1), "frame") == []


def test_ids_continue_over_chunks(spark):
    rows = [(f, o, None if o else 99, 0, 0, 1, 1) for f in (1, 2, FRAME_CHUNK + 5) for o in (0, 1, 2)]
    got = rows_of(T.assign_ids(boxes(spark, rows)), "frame", "ord", "identity", "id_str")
    fresh = [r for r in got if r[1]]
    assert [r[2] for r in fresh] == [0, 1, 2, 3, 4, 5]
    assert all(r[2] == 99 for r in got if not r[1])


def test_history_needs_all_predecessors(spark):
    rows = [(f, 0, 0, 0, 0, 1, 1) for f in (1, 2, 3, 4, 6, 7, 8, 9)]
    got = rows_of(T.history_pairs(boxes(spark, rows), 3), "frame", "hist_frame")
    assert got == [(4, 1), (4, 2), (4, 3), (9, 6), (9, 7), (9, 8)]


def test_fingerprint_sees_every_box(spark):
    rows = [(f, 0, 0, f, 0, f + 5, 5) for f in range(1, 30)]
    one = T.regions_fingerprint(boxes(spark, rows)).first()["fingerprint"]
    again = T.regions_fingerprint(boxes(spark, rows[::-1])).first()["fingerprint"]
    other = T.regions_fingerprint(boxes(spark, rows[:-1])).first()["fingerprint"]
    assert one == again != other
