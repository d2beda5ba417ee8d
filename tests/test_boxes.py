import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import boxes, iou, rows_of
from trackframe.functions import geometry as G
from trackframe.operators import matching as M
from trackframe.operators import metrics as E
from trackframe.operators.reckoning import pairwise_iou


def test_iou_edges(spark):
    cases = [
        ((0, 0, 10, 10), (0, 0, 10, 10), 1.0),  # identical
        ((0, 0, 10, 10), (10, 0, 20, 10), 0.0),  # touching edges
        ((0, 0, 10, 10), (2, 2, 7, 7), 0.25),  # contained
        ((0, 0, 10, 10), (3, 3, 3, 8), 0.0),  # zero area
        ((0, 0, 10, 10), (8, 8, 2, 2), 0.0),  # inverted corners
        ((3, 3, 3, 8), (3, 3, 3, 8), 0.0),  # identical but empty
    ]
    ddl = ", ".join(f"{s}{n} int" for s in "ab" for n in G.BOX_COLUMNS) + ", want double"
    df = spark.createDataFrame([(*a, *b, w) for a, b, w in cases], ddl)
    a, b = (tuple(F.col(f"{s}{n}") for n in G.BOX_COLUMNS) for s in "ab")
    for row in df.select("want", G.iou(a, b).alias("got"), G.iou(b, a).alias("back")).collect():
        assert row["got"] == row["want"] == row["back"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=8, max_size=8))
def test_iou_is_symmetric_and_bounded(v):
    import numpy as np

    a, b = np.array([v[:4]]), np.array([v[4:]])
    if (a[0, 2:] <= a[0, :2]).any() or (b[0, 2:] <= b[0, :2]).any():
        return
    there, back = pairwise_iou(a, b)[0, 0], pairwise_iou(b, a)[0, 0]
    assert there == back == iou(a[0], b[0])
    assert 0 <= there <= 1


def test_pad_and_transform_round_half_to_even(spark):
    row = spark.createDataFrame([(1, 1, 4, 4)], "x1 int, y1 int, x2 int, y2 int")
    padded = row.select(*G.pad_box(G.corners(), 100, 100)).first()
    assert tuple(padded) == (0, 0, 6, 6)  # -0.5 clamps to 0, 5.5 rounds to 6
    half = {n: F.lit(v) for n, v in zip(
        ["t11", "t12", "t13", "t21", "t22", "t23", "t31", "t32", "t33"],
        [1.0, 0.0, 0.5, 0.0, 1.0, 1.5, 0.0, 0.0, 2.0],
    )}
    moved = row.withColumns(half).select(*G.transform_box(G.corners())).first()
    assert tuple(moved) == (2, 2, 4, 6)  # 1.5, 2.5, 4.5, 5.5; no divide by t33


def greedy(pairs, order):
    """Walk pairs in the given order, both ends used once."""
    left, right, out = set(), set(), []
    for p in sorted(pairs, key=order):
        if p[0] not in left and p[1] not in right:
            left.add(p[0])
            right.add(p[1])
            out.append(p[:2])
    return out


def random_boxes(rng, frames, per_frame, first=0):
    rows = []
    for f in range(1, frames + 1):
        for i in range(per_frame):
            x, y = rng.randrange(40), rng.randrange(40)
            rows.append((f, first + i, first + i, x, y, x + rng.randrange(5, 20), y + rng.randrange(5, 20)))
    return rows


def test_greedy_match_equals_plain_walk(spark):
    rng = random.Random(5)
    a, b = random_boxes(rng, 4, 12), random_boxes(rng, 3, 9, 50)
    want = []
    for f in range(1, 5):
        pairs = [
            (r[1], s[1], iou(r[3:], s[3:])) for r in a for s in b if r[0] == s[0] == f
        ]
        pairs = [p for p in pairs if p[2] > 0.05]
        want += [(f, *p) for p in greedy(pairs, lambda p: (p[0], -p[2], p[1]))]
    got = M.greedy_match(boxes(spark, a), boxes(spark, b), 0.05, cell=16)
    assert rows_of(got, "frame", "a_ord", "b_ord") == sorted(want)


def test_greedy_assign_equals_plain_walk(spark):
    rng = random.Random(9)
    rows = random_boxes(rng, 5, 10)
    table = boxes(spark, rows)
    center = lambda r: ((r[3] + r[5]) / 2, (r[4] + r[6]) / 2)
    want = []
    for f in range(2, 6):
        pairs = []
        for c in (r for r in rows if r[0] == f):
            for p in (r for r in rows if r[0] == f - 1):
                (cx, cy), (px, py) = center(c), center(p)
                d = ((cx - px) ** 2 + (cy - py) ** 2) ** 0.5
                if d <= 12:
                    pairs.append((c[1], p[1], d))
        want += [(f, *p) for p in greedy(pairs, lambda p: (p[2], p[1], p[0]))]
    got = M.assign_previous(table, table, 12)
    assert rows_of(got, "frame", "curr", "prev") == sorted(want)


def test_conflict_and_ties(spark):
    truth = boxes(spark, [(1, 7, 7, 0, 0, 10, 10), (1, 8, 8, 100, 0, 110, 10), (1, 9, 9, 104, 0, 114, 10)])
    for first, second in ((0, 1), (1, 0)):
        calc = boxes(spark, [(1, first, 0, 0, 0, 10, 9), (1, second, 1, 0, 0, 10, 10)])
        matched = rows_of(M.greedy_match(calc, truth), "a_ord", "b_ord")
        assert matched == [(0, 7)]  # the first listed wins, not the better one
    tie = boxes(spark, [(1, 0, 0, 102, 0, 112, 10)])
    assert rows_of(M.greedy_match(tie, truth), "a_ord", "b_ord") == [(0, 8)]
    assert rows_of(M.best_match(tie, truth), "ord", "b_ord") == [(0, 8)]


def test_empty_frames_and_unequal_ends(spark):
    box = (0, 0, 10, 10)
    calc = boxes(spark, [(2, 0, 0, *box), (4, 0, 0, *box), (6, 0, 0, *box)])
    gt = boxes(spark, [(1, 0, 0, *box), (4, 0, 0, *box), (5, 0, 0, *box)])
    counts = E.frame_counts(calc, gt)
    got = rows_of(counts, "frame", "true_positive", "false_negative", "false_positive")
    assert got == [(1, 0, 1, 0), (2, 0, 0, 1), (3, 0, 0, 0), (4, 1, 0, 0), (5, 0, 1, 0)]
    scores = E.detection_scores(counts).first()
    assert (scores["recall"], scores["precision"]) == (1 / 3, 0.5)
    none = E.frame_counts(calc.limit(0), gt)
    assert none.count() == 0
    assert E.detection_scores(none, ["video"]).count() == 0
    assert E.frame_count_value(calc.limit(0)).first()["frame_count"] == 0


def test_missing_identities_block_each_other_only_in_legacy(spark):
    truth = boxes(spark, [(1, 0, 0, 0, 0, 10, 10), (1, 1, 1, 50, 0, 60, 10)])
    calc = boxes(spark, [(1, 0, None, 0, 0, 10, 10), (1, 1, None, 50, 0, 60, 10)])
    plain = E.frame_counts(calc, truth).first()
    legacy = E.frame_counts(calc, truth, legacy_null_ids=True).first()
    assert plain["false_negative"] == 0
    assert legacy["false_negative"] == 1
    assert legacy["true_positive"] == plain["true_positive"] == 2


def test_size_limits_test_truth_then_detection(spark):
    truth = boxes(spark, [(1, 0, 0, 0, 0, 10, 10)])
    calc = boxes(spark, [(1, 0, 0, 0, 0, 14, 10)])
    row = E.frame_counts(calc, truth, max_width=12).first()
    # first pass: truth is narrow enough; second pass: the detection is not
    assert (row["true_positive"], row["false_positive"], row["false_negative"]) == (1, 0, 1)
    overlap = E.frame_counts(calc, truth, max_width=12, allow_overlap=True).first()
    assert overlap == row


def test_true_positives_never_exceed_truth(spark):
    rng = random.Random(3)
    calc, gt = random_boxes(rng, 3, 20), random_boxes(rng, 3, 6)
    for row in E.frame_counts(boxes(spark, calc), boxes(spark, gt)).collect():
        assert row["true_positive"] <= 6
        assert row["true_positive"] + row["false_positive"] == 20


def test_frame_spine_covers_block_borders(spark):
    last = spark.createDataFrame([("v", E.SPINE_STEP * 2 + 3), ("w", 1)], "video string, last_frame int")
    frames = E.frame_spine(last).groupBy("video").agg(
        F.count("*").alias("n"), F.countDistinct("frame").alias("d"), F.max("frame").alias("m")
    )
    end = E.SPINE_STEP * 2 + 3
    assert rows_of(frames, "video", "n", "d", "m") == [("v", end, end, end), ("w", 1, 1, 1)]


def test_duplicates(spark):
    near = [(0, 0, 10, 10), (1, 0, 11, 10)]
    far = (100, 100, 110, 110)
    for ids, published, corrected in (
        ((3, 5), [0, 2], [0, 2]),
        ((5, 3), [1, 2], [1, 2]),
        ((None, 4), [1, 2], [1, 2]),
        ((4, None), [0, 2], [0, 2]),
        ((None, None), [2], [0, 2]),
    ):
        table = boxes(
            spark,
            [(1, 0, ids[0], *near[0]), (1, 1, ids[1], *near[1]), (1, 2, 9, *far)],
        )
        assert [r[0] for r in rows_of(M.suppress_duplicates(table, 0.5), "ord")] == published
        kept = M.suppress_duplicates(table, 0.5, corrected=True)
        assert [r[0] for r in rows_of(kept, "ord")] == corrected
