"""Streams over several micro-batches give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import boxes, pixel_table, rows_of
from tests.test_state import TRACK, identity_matrices, wandering
from trackframe.operators import metrics as E
from trackframe.operators import particles as PA
from trackframe.operators import pixels as PX
from trackframe.operators import reckoning as K
from trackframe.operators import tracks as T
from trackframe.streaming import sinks as SS
from trackframe.streaming import sources as SO
from trackframe.streaming import stateful as ST


def landed(table, folder, batches=3):
    """One file per run of frames, arriving in frame order."""
    import os
    import time

    top = table.agg(F.max("frame")).first()[0]
    size = -(-top // batches)
    for i in range(batches):
        part = table.filter(F.col("frame").between(i * size + 1, (i + 1) * size))
        part.coalesce(1).write.mode("append").parquet(str(folder))
        now = time.time() - 100 + i
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.startswith("part-") and not getattr(landed, "seen", set()) & {path}:
                os.utime(path, (now, now))
                landed.seen = getattr(landed, "seen", set()) | {path}


def stream_of(spark, table, tmp_path, batches=3):
    folder = tmp_path / "in"
    landed(table, folder, batches)
    return SO.stream_table(spark, str(folder), table.schema, files_per_batch=1)


def drained(spark, stream, tmp_path):
    SS.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    found = spark.read.parquet(str(tmp_path / "out"))
    if "late" in found.columns:
        assert ST.late_rows(found).count() == 0
        return ST.on_time(found)
    return found


def land(table, folder, when, number=[0]):
    """One file of these rows, later than those before."""
    import os
    import time

    number[0] += 1
    part = str(folder / f"part{number[0]}")
    table.filter(when).coalesce(1).write.parquet(part)
    stamp = time.time() - 1000 + number[0]
    for name in os.listdir(part):
        os.utime(os.path.join(part, name), (stamp, stamp))


def split_stream(spark, table, tmp_path, late="3 seconds", fps=2.0, closing=True):
    """Rows of every frame in three files, frames out of order, and a row that closes all."""
    folder = tmp_path / "split"
    half = F.pmod(F.xxhash64(*[c for c in table.columns if c != "frame"]), F.lit(2)) == 0
    top = table.agg(F.max("frame")).first()[0]
    for start in range(1, top + 1, 6):
        here = F.col("frame").between(start, start + 5)
        land(table, folder, here & half & (F.col("frame") % 2 == 0))
        land(table, folder, here & half & (F.col("frame") % 2 == 1))
        land(table, folder, here & ~half)
    if closing:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != "frame"]
        closed = spark.range(1).select(F.lit(top + 1000).cast(table.schema["frame"].dataType).alias("frame"), *none)
        land(closed.select(table.columns), folder, F.lit(True))
    stream = SO.stream_table(spark, f"{folder}/*", table.schema, files_per_batch=1)
    return SO.with_event_time(stream, fps, late)


def test_history(spark, tmp_path):
    table = boxes(spark, [(f, o, 0, 0, 0, 1, 1) for f in range(1, 13) for o in (0, 1)])
    got = drained(spark, ST.stream_history(stream_of(spark, table, tmp_path), 4), tmp_path)
    held = rows_of(got.filter("event = 'held'"), "frame", "hist_frame")
    assert held == rows_of(T.history_pairs(table, 4), "frame", "hist_frame")
    evicted = rows_of(got.filter("event = 'evicted'"), "frame", "hist_frame")
    assert evicted == [(f, f - 5) for f in range(6, 13)]


def test_dead_reckoning(spark, tmp_path):
    table = boxes(spark, wandering(1, skip=(6,)))
    stream = stream_of(spark, table, tmp_path)
    got = drained(spark, ST.stream_dead_reckoning(stream, 9, 0.3), tmp_path)
    assert rows_of(got, *TRACK) == rows_of(K.dead_reckoning(table, 9, 0.3), *TRACK)


@pytest.mark.parametrize("persist", [False, True])
def test_particle_filter(spark, tmp_path, persist):
    table = boxes(spark, wandering(2))
    matrices = identity_matrices(spark, [1, 2, 3, 4, 6, 7, 8, 9, 11, 12], 0.6)
    stream = stream_of(spark, table, tmp_path)
    got = drained(spark, ST.stream_particle_filter(stream, matrices, persist=persist, seed=3), tmp_path)
    want = PA.particle_filter(table, matrices, persist=persist, seed=3)
    assert rows_of(got, *TRACK, "observed") == rows_of(want, *TRACK, "observed")


def test_observation_hysteresis(spark, tmp_path):
    rng = random.Random(5)
    rows = [("v", i, f, 3 * f, rng.random() < 0.4) for i in range(20) for f in range(1, 10)]
    table = spark.createDataFrame(rows, "video string, identity int, frame int, x1 int, observed boolean")
    stream = stream_of(spark, table, tmp_path)
    got = drained(spark, ST.stream_observation_hysteresis(stream), tmp_path)
    names = ["identity", "frame", "x1"]
    assert rows_of(got, *names) == rows_of(T.observation_hysteresis(table), *names)


@pytest.mark.parametrize("corrected", [False, True])
def test_pixel_hysteresis(spark, tmp_path, corrected):
    rng = random.Random(6)
    table = pixel_table(
        spark, {f: [[rng.choice([0, 255]) for _ in range(4)] for _ in range(3)] for f in range(1, 16)}
    )
    stream = stream_of(spark, table, tmp_path)
    got = drained(spark, ST.stream_pixel_hysteresis(stream, 2, 3, corrected), tmp_path)
    want = PX.pixel_hysteresis(table, 2, 3, corrected)
    assert rows_of(got, *PX.PIXEL, "v") == rows_of(want, *PX.PIXEL, "v")


def test_counts_and_repeated_batches(spark, tmp_path):
    calc, gt = boxes(spark, wandering(1)), boxes(spark, wandering(1, objects=6))
    both = calc.withColumn("side", F.lit("calc")).unionByName(gt.withColumn("side", F.lit("gt")))
    stream = stream_of(spark, both, tmp_path)
    out = str(tmp_path / "counts")
    SS.stream_counts(stream, out, str(tmp_path / "c1")).awaitTermination()
    names = ["frame", *E.COUNTS]
    want = rows_of(E.frame_counts(calc, gt), *names)
    assert rows_of(spark.read.parquet(out), *names) == want
    # a batch that is written again replaces itself; a new run replaces the table
    again = spark.read.parquet(out).filter("batch = 1").drop("batch")
    again = spark.createDataFrame(again.collect(), again.schema)
    SS.write_batch(again, 1, out)
    assert rows_of(spark.read.parquet(out), *names) == want
    SS.stream_counts(stream, out, str(tmp_path / "c2")).awaitTermination()
    assert rows_of(spark.read.parquet(out), *names) == want
    totals = SS.running_totals(spark.read.parquet(out)).first()
    assert totals["true_positive"] == sum(r[1] for r in want)


def test_sweep_scores_each_request_once(spark, tmp_path):
    rows = [(1, 5), (1, 7), (1, 5), (2, 7), (2, 8), (3, 8)]
    requests = spark.createDataFrame(rows, "frame int, idx bigint")
    stream = stream_of(spark, requests, tmp_path).select("idx")
    asked = []

    def score(wanted):
        asked.append(sorted(r["idx"] for r in wanted.collect()))
        return wanted.withColumn("f1", F.col("idx") * 2.0)

    out = str(tmp_path / "scores")
    SS.stream_sweep(stream, out, str(tmp_path / "check"), score).awaitTermination()
    assert [a for a in asked if a] == [[5, 7], [8]]
    assert rows_of(spark.read.parquet(out), "idx", "f1") == [(5, 10.0), (7, 14.0), (8, 16.0)]


def test_frames_have_event_time(spark, tmp_path):
    table = pixel_table(spark, {f: [[f]] for f in range(1, 7)})
    landed(table, tmp_path / "in", 2)
    stream = SO.stream_frames(spark, str(tmp_path / "in"), table.schema, fps=2.0)
    got = drained(spark, stream.withColumn("ms", F.unix_millis("event_time")), tmp_path)
    assert rows_of(got, "frame", "ms") == [(f, f * 500) for f in range(1, 7)]


def test_split_frames_give_the_same_windows(spark, tmp_path):
    table = boxes(spark, [(f, o, 0, 0, 0, 1, 1) for f in range(1, 13) for o in range(4)])
    got = drained(spark, ST.stream_history(split_stream(spark, table, tmp_path), 4), tmp_path)
    held = rows_of(got.filter("event = 'held'"), "frame", "hist_frame")
    assert held == rows_of(T.history_pairs(table, 4), "frame", "hist_frame")


def test_split_frames_give_the_same_reckoning(spark, tmp_path):
    table = boxes(spark, wandering(1, skip=(6,)))
    stream = split_stream(spark, table, tmp_path)
    got = drained(spark, ST.stream_dead_reckoning(stream, 9, 0.3), tmp_path)
    assert rows_of(got, *TRACK) == rows_of(K.dead_reckoning(table, 9, 0.3), *TRACK)


def test_split_frames_give_the_same_particles(spark, tmp_path):
    table = boxes(spark, wandering(2))
    matrices = identity_matrices(spark, [2, 3, 4, 6, 7, 8, 9, 11, 12], 0.6)
    stream = split_stream(spark, table, tmp_path)
    got = drained(spark, ST.stream_particle_filter(stream, matrices, seed=3), tmp_path)
    want = PA.particle_filter(table, matrices, seed=3)
    assert rows_of(got, *TRACK, "observed") == rows_of(want, *TRACK, "observed")


@pytest.mark.parametrize("tile", [2, 64])
def test_split_frames_give_the_same_pixels(spark, tmp_path, tile):
    rng = random.Random(6)
    frames = {f: [[rng.choice([0, 255]) for _ in range(5)] for _ in range(3)] for f in range(1, 12)}
    table = pixel_table(spark, frames)
    stream = split_stream(spark, table, tmp_path)
    got = drained(spark, ST.stream_pixel_hysteresis(stream, 2, 3, True, tile=tile), tmp_path)
    want = PX.pixel_hysteresis(table, 2, 3, True)
    assert rows_of(got, *PX.PIXEL, "v") == rows_of(want, *PX.PIXEL, "v")


def test_a_split_frame_is_counted_once(spark, tmp_path):
    calc, gt = boxes(spark, wandering(1)), boxes(spark, wandering(1, objects=6))
    both = calc.withColumn("side", F.lit("calc")).unionByName(gt.withColumn("side", F.lit("gt")))
    out = str(tmp_path / "counts")
    stream = split_stream(spark, both, tmp_path)
    late = str(tmp_path / "late")
    SS.stream_counts(stream, out, str(tmp_path / "c"), late).awaitTermination()
    names = ["frame", *E.COUNTS]
    assert rows_of(spark.read.parquet(out), *names) == rows_of(E.frame_counts(calc, gt), *names)
    empty = "video string, frame int, side string, late bigint"
    assert spark.read.schema(empty).parquet(late).count() == 0


def late_stream(spark, table, tmp_path):
    """Frames 1 to 12 in order, those of the last object far too late; a second video lags."""
    folder = tmp_path / "late-in"
    last = F.col("ord") == 2
    for start in (1, 5, 9):
        land(table, folder, F.col("frame").between(start, start + 3) & ~last & (F.col("video") == "v"))
    land(table, folder, last | (F.col("video") == "w"))
    stream = SO.stream_table(spark, f"{folder}/*", table.schema, files_per_batch=1)
    return SO.with_event_time(stream, 2.0)


def test_late_rows_are_counted_not_lost(spark, tmp_path):
    rows = [(f, o, 0, 10 * o, 0, 10 * o + 5, 5) for f in range(1, 13) for o in range(3)]
    table = boxes(spark, rows)
    table = table.unionByName(table.filter("ord < 2").withColumn("video", F.lit("w")))
    SS.run_to_table(
        ST.whole_frames(late_stream(spark, table, tmp_path)), str(tmp_path / "o1"), str(tmp_path / "s1")
    )
    found = spark.read.parquet(str(tmp_path / "o1"))
    names = ["video", "frame", "ord"]
    # the last frames are still open when the rest arrives
    on_time = rows_of(ST.on_time(found), *names)
    late = rows_of(found.filter("late = 1"), *names)
    assert sorted(on_time + late) == rows_of(table, *names)
    assert {r[0] for r in late} == {"v"} and {r[2] for r in late} == {2}
    assert {r[1] for r in late} == set(range(1, 9))

    SS.run_to_table(
        ST.stream_history(late_stream(spark, table, tmp_path / "h"), 3), str(tmp_path / "o2"), str(tmp_path / "s2")
    )
    history = spark.read.parquet(str(tmp_path / "o2"))
    assert rows_of(ST.late_rows(history), "video", "frame", "late") == [("v", f, 1) for f in range(1, 9)]
    got = rows_of(ST.on_time(history).filter("event = 'held'"), "video", "frame", "hist_frame")
    assert got == rows_of(T.history_pairs(table, 3), "video", "frame", "hist_frame")


def test_frames_closed_long_ago_are_late_by_age(spark, tmp_path):
    table = boxes(spark, [(f, 0, 0, 0, 0, 1, 1) for f in range(1, 41)])
    folder = tmp_path / "in"
    for when in ("frame > 30", "frame between 20 and 30", "frame < 20", "frame = 35"):
        land(table, folder, F.expr(when))
    stream = SO.with_event_time(SO.stream_table(spark, f"{folder}/*", table.schema, 1), 2.0)
    SS.run_to_table(ST.whole_frames(stream, keep_ms=9_000), str(tmp_path / "o"), str(tmp_path / "s"))
    found = spark.read.parquet(str(tmp_path / "o"))
    # the watermark is at frame 40, 18 frames are kept in mind
    assert rows_of(found.filter("late = 1"), "frame") == [(f,) for f in sorted([*range(1, 20), 20, 21, 22, 35])]
    assert rows_of(ST.on_time(found), "frame") == [(f,) for f in range(23, 41)]


def test_tracks_are_forgotten_after_their_time(spark, tmp_path):
    ddl = "video string, identity int, frame int, observed boolean"
    rows = [("v", 1, 1), ("v", 2, 1), ("v", 1, 900), ("v", 3, 900), ("v", 1, 1800), ("v", 3, 1800), ("v", 2, 2700)]
    table = spark.createDataFrame([(*r, True) for r in rows], ddl)
    stream = stream_of(spark, table, tmp_path, 3)  # 30 frames a second
    got = drained(spark, ST.stream_observation_hysteresis(stream, 40_000), tmp_path)
    # the second track had been forgotten when it came again
    assert rows_of(got, "identity", "frame") == [(1, 1), (1, 900), (1, 1800), (3, 900), (3, 1800)]


class KeptInMemory:
    """State of one key, with the calls of the store counted."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, [], {}

    def getValueState(self, name, ddl):
        return self

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def exists(self):
        return "v" in self.values

    def get(self):
        return self.values["v"]

    def update(self, value):
        self.calls += 1
        self.values["v"] = value


def test_tracks_of_a_block_take_few_calls_of_the_store(spark):
    import pandas as pd

    handle = KeptInMemory()
    tracks = ST.Confirmed(["video", "identity", "frame"], ["identity bigint", "frame bigint"], None)
    tracks.init(handle)
    for frame in (1, 2):
        batch = pd.DataFrame({"identity": range(32), "frame": [frame] * 32, "at": [0] * 32})
        found = list(tracks.handleInputRows(("v", 0), iter([batch]), None))
    assert handle.calls == 2
    assert sorted(map(tuple, found[0].to_numpy().tolist())) == sorted(("v", i, f) for i in range(32) for f in (1, 2))
