import random

import numpy as np
import pytest

from tests.helpers import rows_of
from trackframe.operators import pareto as P
from trackframe.operators import reports as R
from trackframe.operators import skyline
from trackframe.operators import sweep as D

DDL = "video string, idx bigint, sample_ord bigint, recall double, prec double, f1 double"


def f1(r, p):
    return 2 * r * p / (r + p) if r + p else 0.0


def scores(spark, points):
    rows = [("v", i, i, r, p, f1(r, p)) for i, (r, p) in enumerate(points)]
    return spark.createDataFrame(rows, DDL)


def beats(a, b):
    return all(x >= y for x, y in zip(a, b)) and any(x > y for x, y in zip(a, b))


def plain_front(points):
    """Indices of the first of each non-dominated point."""
    keep = []
    for i, p in enumerate(points):
        if p not in points[:i] and not any(beats(q, p) for q in points):
            keep.append(i)
    return keep


def cloud(seed, n, kind):
    rng = random.Random(seed)
    points = []
    for _ in range(n):
        if kind == "steps":
            points.append((rng.randrange(6) / 5, rng.randrange(6) / 5))
        elif kind == "curve":
            a = rng.random()
            points.append((a, max(0.0, 1 - a * a - rng.random() * 0.02)))
        else:
            points.append((rng.random(), rng.random()))
    return points


@pytest.mark.parametrize("kind", ["steps", "curve", "uniform"])
def test_fronts_against_pairs(spark, kind):
    points = cloud(1, 150, kind)
    df = scores(spark, points)
    want = plain_front(points)
    assert [i for (i,) in rows_of(P.pareto_front(df, ["recall", "prec"]), "idx")] == want
    full = [(r, p, f1(r, p)) for r, p in points]
    assert [i for (i,) in rows_of(P.pareto_front(df), "idx")] == plain_front(full)


def test_front_of_objectives_on_any_scale(spark):
    points = [(1000 * r - 400, p / 1000) for r, p in cloud(3, 150, "uniform")]
    df = scores(spark, points)
    found = P.pareto_front(df, ["recall", "prec"])
    assert [i for (i,) in rows_of(found, "idx")] == plain_front(points)
    borders = P._borders(df, ["video"], ["recall", "prec"])
    cells = P._gridded(df, borders, ["video"], ["recall", "prec"]).groupBy("g0").count().collect()
    assert len(cells) == P.GRID and max(r["count"] for r in cells) < 25


def test_front_of_free_third_objective(spark):
    rng = random.Random(2)
    points = [tuple(rng.randrange(12) / 8 - 0.2 for _ in range(3)) for _ in range(200)]
    rows = [("v", i, i, *p) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, DDL)
    assert [i for (i,) in rows_of(P.pareto_front(df), "idx")] == plain_front(points)


OBJECTIVES5 = ["a", "b", "c", "d", "e"]


def many_objectives(spark, points):
    ddl = "video string, idx bigint, " + ", ".join(f"{o} double" for o in OBJECTIVES5)
    return spark.createDataFrame([("v", i, *p) for i, p in enumerate(points)], ddl)


@pytest.mark.parametrize("block", [20, 8192])
@pytest.mark.parametrize("size", [4, 5])
def test_front_of_many_objectives(spark, monkeypatch, size, block):
    monkeypatch.setattr(skyline, "BLOCK", block)
    rng = random.Random(size)
    points = [tuple(rng.randrange(9) - 4.0 for _ in OBJECTIVES5) for _ in range(300)]
    found = P.pareto_front(many_objectives(spark, points), OBJECTIVES5[:size])
    assert [i for (i,) in rows_of(found, "idx")] == plain_front([p[:size] for p in points])


def test_margin_front_of_many_objectives(spark, monkeypatch):
    monkeypatch.setattr(skyline, "BLOCK", 30)
    rng = random.Random(11)
    points = [tuple(rng.random() for _ in range(5)) for _ in range(150)]
    low = np.min(points, axis=0)
    front = np.array([points[i] for i in plain_front(points)])
    moved = front - (front - low) * 0.1
    want = [i for i, p in enumerate(points) if not (moved > np.array(p)).all(axis=1).any()]
    found = P.margin_front(many_objectives(spark, points), 0.1, OBJECTIVES5)
    assert [i for (i,) in rows_of(found, "idx")] == want


def test_front_with_nulls_and_infinities(spark):
    inf = float("inf")
    points = [
        (1.0, 1.0, 1.0, 1.0, 0.0), (2.0, 1.0, 1.0, 1.0, 0.0), (None, 0.0, 0.0, 0.0, 0.0),
        (inf, -inf, 0.0, 0.0, 0.0), (inf, -inf, -1.0, 0.0, 0.0), (0.0, 0.0, inf, -inf, 0.0),
    ]
    df = many_objectives(spark, points)
    assert [i for (i,) in rows_of(P.pareto_front(df, OBJECTIVES5[:4]), "idx")] == [1, 2, 3, 5]
    two = P.pareto_front(df, ["a", "b"])
    assert [i for (i,) in rows_of(two, "idx")] == [1, 2, 3]
    assert P.pareto_front(df.limit(0), OBJECTIVES5).count() == 0
    assert P.pareto_front(df.limit(0), ["a", "b"]).count() == 0


def test_two_objectives_compare_no_pairs(spark):
    plan = P.pareto_front(scores(spark, cloud(1, 50, "uniform")), ["recall", "prec"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_front_edges(spark):
    assert rows_of(P.pareto_front(scores(spark, [(0.5, 0.5)])), "idx") == [(0,)]
    zeros = [(0.0, 0.0)] * 3
    assert rows_of(P.pareto_front(scores(spark, zeros)), "idx") == [(0,)]
    ties = [(0.5, 0.2), (0.5, 0.4), (0.3, 0.4), (0.5, 0.4)]
    assert rows_of(P.pareto_front(scores(spark, ties)), "idx") == [(1,)]


@pytest.mark.parametrize("margin", [0.0, 0.05, 0.3])
def test_margin_front(spark, margin):
    points = [(r, p, f1(r, p)) for r, p in cloud(4, 80, "uniform")]
    low = np.min(points, axis=0)
    y = np.array(points)
    front = y[plain_front(points)]
    kept = [
        i
        for i, row in enumerate(y)
        if all((row >= s - (s - low) * margin).any() for s in front)
    ]
    df = scores(spark, [p[:2] for p in points])
    got = [i for (i,) in rows_of(P.margin_front(df, margin), "idx")]
    assert got == kept


def area(front):
    front = sorted(front)
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(front, front[1:]))


@pytest.mark.parametrize("kind", ["steps", "curve", "uniform"])
def test_front_growth_against_prefixes(spark, kind):
    points = cloud(7, 90, kind)
    df = scores(spark, points)
    areas = dict(rows_of(P.front_history(df), "n", "area"))
    since = dict((n, (s, share)) for n, s, share in rows_of(P.samples_since_front(df), "n", "samples_since", "share"))
    new = dict(rows_of(P.new_front_points(df), "idx", "is_new_front"))
    for n in range(1, len(points) + 1):
        front = plain_front(points[:n])
        assert abs(areas[n] - area([points[i] for i in front])) < 1e-9
        assert since[n] == (n - 1 - max(front), (n - 1 - max(front)) / n)
        assert new[n - 1] == (n - 1 in front)
    stop = P.samples_until_stop(df, 0.5).first()["remaining"]
    assert stop == (0.5 * len(points) - since[len(points)][0]) / 0.5


def test_average_precision_and_curve(spark):
    df = scores(spark, [(0.2, 0.9), (0.6, 0.5), (0.9, 0.1), (0.1, 0.3)])
    front = P.pareto_front(df)
    want = 0.2 * 0.9 + 0.4 * 0.7 + 0.3 * 0.3
    assert abs(P.average_precision(front).first()["ap"] - want) < 1e-12
    assert rows_of(P.pr_curve(front), "point", "recall", "prec") == [
        (0, 0.0, 0.9), (1, 0.2, 0.9), (2, 0.6, 0.5), (3, 0.9, 0.1),
    ]


def test_running_best_and_zero_floor(spark):
    df = scores(spark, [(0.0, 0.0), (0.5, 0.2), (0.4, 0.6), (0.5, 0.6)])
    rows = P.running_best(df).orderBy("sample_ord").collect()
    assert [r["best_recall"] for r in rows] == [0.0, 0.0, 0.5, 0.5]
    assert [r["new_prec"] for r in rows] == [False, True, True, False]
    floored = P.zero_floor(df).orderBy("idx").first()
    assert (floored["recall"], floored["prec"], floored["f1"]) == (1e-5, 1e-5, 1e-5)


def test_design_numbers_follow_the_mesh(spark):
    values = list(D.learned_parameters().values())
    assert [len(v) for v in values] == [4, 5, 8, 5, 8, 3]
    assert values[5] == [5, 7, 9]
    mesh = np.array(np.meshgrid(*values)).T.reshape(-1, len(values))
    assert len(mesh) == D.space_size() == 19_200
    space = D.design_space(spark).orderBy("idx").toPandas()
    assert (space.drop(columns="idx").to_numpy(dtype=float) == mesh).all()


def test_budget_is_seeded_and_exact(spark):
    space = D.design_space(spark).select("idx")
    a = {i for (i,) in rows_of(D.sampling_budget(space, 0.3, 1), "idx")}
    again = {i for (i,) in rows_of(D.sampling_budget(space, 0.3, 1), "idx")}
    other = {i for (i,) in rows_of(D.sampling_budget(space, 0.3, 2), "idx")}
    assert len(a) == 5_760 and a == again and a != other


def test_objective_settings_and_names(spark):
    ddl = "video string, max_width int, max_height int, allow_overlap boolean, idx bigint, recall double, prec double, f1 double"
    rows = [
        ("v", 1024, 1024, True, 1, 0.9, 0.5, f1(0.9, 0.5)),
        ("v", 35, 35, False, 2, 0.6, 0.8, f1(0.6, 0.8)),
        ("v", 99, 99, False, 3, 1.0, 1.0, 1.0),
    ]
    table = R.objective_table(spark.createDataFrame(rows, ddl))
    assert rows_of(table, "objective_function", "allow_overlap", "recall", "ap") == [
        ("Final Objective Function", "no", 0.6, 0.48),
        ("Problem Objective function 1", "yes", 0.9, 0.45),
    ]
    names = R.names_table(spark)
    known = spark.createDataFrame([("VISO/car/005",)], "video string")
    assert R.name_videos(known, names).first()["name"] == "Video 3"
    assert R.videos_by_name(known.select(R.F.lit("Video 7").alias("name")), names).first()["video"] == "VISO/car/009"


def test_sweep_skips_what_is_stored(spark, tmp_path):
    from trackframe.plans.sweeping import report, sweep_and_store
    from trackframe.sources import sinks
    from tests.helpers import boxes

    gt = boxes(spark, [(f, 0, 0, 0, 0, 10, 10) for f in range(1, 6)])
    calls = []

    def detect(design):
        calls.append(design["idx"])
        step = design["idx"] * 4
        return gt.selectExpr("video", "frame", "ord", "identity", f"x1+{step} as x1", "y1", f"x2+{step} as x2", "y2")

    key = dict(dataset="d", config_hash="h", tracking=True, persist=False, max_width=35, max_height=35, allow_overlap=False)
    path = str(tmp_path / "scores")
    designs = [{"idx": i} for i in (0, 1, 3)]
    assert sweep_and_store(spark, path, designs, detect, gt, key, stored=False) == 3
    assert sweep_and_store(spark, path, [*designs, {"idx": 2}], detect, gt, key) == 1
    assert calls == [0, 1, 3, 2]
    table = sinks.read_scores(spark, path).withColumnRenamed("precision", "prec")
    assert rows_of(table, "idx", "recall", "sample_ord") == [(0, 1.0, 0), (1, 1.0, 1), (2, 1.0, 3), (3, 0.0, 2)]
    assert rows_of(report(table)["front"], "idx") == [(0,)]
