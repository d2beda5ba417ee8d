import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.helpers import boxes, rows_of
from trackframe.functions import scalars as SC
from trackframe.functions import sql_functions
from trackframe.plans.scoring import score_files
from trackframe.plans.tracking import track_results
from trackframe.sources import files as FI
from trackframe.sources import frames as FR
from trackframe.sources import layout as L
from trackframe.sources import metadata as MD
from trackframe.sources import sinks as SK
from trackframe.streaming import sources as SO
from trackframe.streaming import sinks as SS
from tests.test_state import identity_matrices

BOX = ["frame", "identity", "x1", "y1", "x2", "y2"]


def write_png(path, image):
    """An 8-bit colour PNG of an (h, w, 3) red-green-blue array."""
    h, w, _ = image.shape
    lines = b"".join(b"\0" + image[y].astype("uint8").tobytes() for y in range(h))

    def part(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")
    )


def image_folder(tmp_path, count=3):
    folder = tmp_path / "Datasets" / "VISO" / "car" / "003" / "img"
    folder.mkdir(parents=True)
    images = np.random.default_rng(1).integers(0, 256, (count, 4, 5, 3))
    for i, image in enumerate(images):
        write_png(folder / f"{i + 1:06d}.png", image)
    return folder, images


def test_image_folder(spark, tmp_path):
    folder, images = image_folder(tmp_path, 12)
    frames = FI.read_frames(spark, str(folder))
    assert {r["video"] for r in frames.select("video").collect()} == {"VISO/car/003"}
    info = FI.videos_of(frames).first()
    assert (info["width"], info["height"], info["fps"], info["frame_count"]) == (5, 4, 30.0, 12)
    pixels = FR.explode_pixels(frames, 3).collect()
    assert len(pixels) == 12 * 20
    for r in pixels:
        red, green, blue = images[r["frame"] - 1][r["y"], r["x"]]
        assert (r["r"], r["g"], r["b"]) == (red, green, blue)
    assert rows_of(L.list_datasets(spark, str(tmp_path)), "dataset") == [("VISO/car/003",)]


def test_images_written_and_read(spark, tmp_path):
    rng = np.random.default_rng(4)
    colour = [rng.integers(0, 256, (3, 5, 3)).astype("uint8") for _ in range(12)]
    gray = rng.integers(0, 256, (2, 7)).astype("uint8")
    rows = [("a/1", 10 * i, 3, 5, 3, bytearray(c.tobytes())) for i, c in enumerate(colour)]
    rows.append(("b", 4, 2, 7, 1, bytearray(gray.tobytes())))
    frames = spark.createDataFrame(
        rows, "video string, frame int, height int, width int, channels int, data binary"
    )
    for _ in range(2):  # a repeated job leaves the same files
        SK.write_frames(frames, str(tmp_path))
    assert len(list(tmp_path.rglob("*"))) == 13 + 6
    back = FI.read_frames(spark, f"{tmp_path}/Datasets/a/1/img").orderBy("frame").collect()
    assert [(r["video"], r["frame"]) for r in back] == [("a/1", i + 1) for i in range(12)]
    assert [bytes(r["data"]) for r in back] == [c.tobytes() for c in colour]
    one = FI.read_frames(spark, f"{tmp_path}/Datasets/b/img").first()
    assert (one["channels"], bytes(one["data"])) == (1, gray.tobytes())


def test_score_table_written_and_read(spark, tmp_path):
    rows = [("A", "u", "recall", 0.1), ("A", "v", "prec", 1 / 3), ("B", "u", "prec", 2.0)]
    scores = spark.createDataFrame(rows, "method string, video string, metric string, value double")
    SK.write_score_table(scores, str(tmp_path / "t"), ["u", "v"], ["recall", "prec"])
    back = FI.read_score_table(spark, str(tmp_path / "t"), 2)
    assert rows_of(back.filter("value is not null"), "method", "video", "metric", "value") == rows
    assert back.count() == 8


def test_image_stream(spark, tmp_path):
    folder, _ = image_folder(tmp_path)
    stream = SO.stream_image_files(spark, str(folder), fps=10)
    out = stream.withColumn("ms", F.unix_millis("event_time")).drop("content")
    SS.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "check"))
    got = rows_of(spark.read.parquet(str(tmp_path / "out")), "video", "frame", "ms")
    assert got == [("VISO/car/003", i, i * 100) for i in (1, 2, 3)]


def test_ground_truth_keeps_or_loses_its_first_line(spark, tmp_path):
    folder = tmp_path / "Datasets" / "VISO" / "car" / "004" / "gt"
    folder.mkdir(parents=True)
    (folder / "gt.txt").write_text("1,7,10,20,5,6,1,-1,-1,-1\n2,7,11,20,5,6,1,-1,-1,-1\n")
    path = str(folder / "gt.txt")
    rows = FI.read_regions(spark, path)
    assert rows_of(rows, "video", *BOX) == [
        ("VISO/car/004", 1, 7, 10, 20, 15, 26), ("VISO/car/004", 2, 7, 11, 20, 16, 26),
    ]
    assert rows_of(FI.read_gt(spark, path, skip_first=True), "frame") == [(2,)]


CVAT = """<?xml version="1.0" encoding="utf-8"?>
<annotations><version>1.1</version>
<track id="3" label="car"><box frame="0" xtl="1.2" ytl="2.9" xbr="8.1" ybr="9.0" outside="0"></box>
<box frame="4" xtl="2.0" ytl="3.0" xbr="9.5" ybr="10.5" outside="0"></box></track>
<track id="5" label="car"><box frame="0" xtl="-0.5" ytl="0.0" xbr="3.0" ybr="4.2" outside="0"></box></track>
</annotations>"""


def test_annotation_xml(spark, tmp_path):
    path = tmp_path / "marks.xml"
    path.write_text(CVAT)
    rows = FI.read_regions(spark, str(path), "v")
    assert rows_of(rows, *BOX) == [(1, 3, 1, 2, 9, 9), (1, 5, -1, 0, 3, 5), (5, 3, 2, 3, 10, 11)]


def test_gt_file_round_trip(spark, tmp_path):
    table = boxes(spark, [(f, i, i, f, 2, f + 4, 9) for f in (1, 2) for i in (0, 1)])
    SK.write_gt(table, str(tmp_path / "gt"))
    text = [p.read_text() for p in (tmp_path / "gt" / "video=v").glob("*.csv")]
    lines = sorted(line for t in text for line in t.split())
    assert lines[0] == "1,0,1,2,4,7,1,-1,-1,-1" and len(lines) == 4
    back = FI.read_gt(spark, str(tmp_path / "gt" / "video=v"), "v")
    assert rows_of(back, *BOX) == rows_of(table, *BOX)


def test_only_given_videos_are_replaced(spark, tmp_path):
    path = str(tmp_path / "results")
    one = boxes(spark, [(1, 0, 0, 0, 0, 4, 4), (2, 0, 0, 9, 0, 12, 4)])
    two = one.withColumn("video", F.lit("w"))
    SK.write_regions(one.unionByName(two), path)
    SK.write_regions(two.filter("frame = 1"), path)
    stored = FI.read_results(spark, path)
    assert rows_of(stored, "video", "frame") == [("v", 1), ("v", 2), ("w", 1)]
    pruned = FI.read_results(spark, path, video="v", frames=(2, 2))
    assert rows_of(pruned, "x1") == [(9,)]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(video" in plan and "PushedFilters: [IsNotNull(frame), GreaterThanOrEqual(frame,2)" in plan


def test_score_tables(spark, tmp_path):
    wide = tmp_path / "five.csv"
    wide.write_text(
        "# a paper\n# more\n\n ,Video 1,Video 1,Video 2,Video 2\nMethod,Recall,F1,Recall,F1\n"
        "FD,0.58,0.29,0.79,0.38\nABM,0.81,0.71,0.79,0.75\n"
    )
    rows = rows_of(FI.read_score_table(spark, str(wide), 2), "method", "video", "metric", "value")
    assert len(rows) == 8 and ("ABM", "Video 2", "f1", 0.75) in rows
    narrow = tmp_path / "six.csv"
    narrow.write_text("# a paper\nMethod,Video 1, Video 2\nFD,0.26,0.55\n")
    rows = rows_of(FI.read_score_table(spark, str(narrow)), "method", "video", "metric", "value")
    assert rows == [("FD", "Video 1", "ap", 0.26), ("FD", "Video 2", "ap", 0.55)]


def test_baseline_allows_blanks(spark, tmp_path):
    path = tmp_path / "base.csv"
    path.write_text("1, 2, 3, 4, 5\n6, 7, 8, 9, 10\n")
    assert rows_of(FI.read_baseline(spark, str(path)), "x1", "y2", "frame") == [(1, 4, 5), (6, 9, 10)]


def test_metadata_of_other_pipelines_stays(spark, tmp_path):
    path = str(tmp_path / "meta")
    ddl = "pipeline string, start string, kernel int, stages array<string>"
    runs = spark.createDataFrame([("a", "t0", 3, ["x", "y"]), ("b", "t0", 5, ["x"])], ddl)
    for batch in (runs, runs.filter("pipeline = 'b'").withColumn("start", F.lit("t1"))):
        rows = MD.metadata_rows(batch, ["start"]).unionByName(MD.config_row(batch, ["kernel"]))
        MD.write_run_metadata(rows, MD.stage_rows(batch), path)
    stored = MD.read_run_metadata(spark, path)
    assert rows_of(stored, "pipeline", "key", "value") == [
        ("a", "config", '{"kernel":3}'), ("a", "start", "t0"),
        ("b", "config", '{"kernel":5}'), ("b", "start", "t1"),
    ]
    stages = MD.read_run_metadata(spark, path, "stages")
    assert rows_of(stages, "pipeline", "sort_order", "name") == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x")]


def test_result_addresses(spark, tmp_path):
    path = str(tmp_path / "scores")
    ddl = (
        "dataset string, config_hash string, tracking boolean, persist boolean, max_width int, "
        "max_height int, allow_overlap boolean, idx bigint, recall double, precision double, "
        "f1 double, sample_ord bigint"
    )
    rows = [("VISO/car/003", "h", True, False, 35, 35, False, i, 0.1 * i, 0.5, 0.2, i) for i in range(3)]
    SK.append_scores(spark.createDataFrame(rows, ddl), path)
    stored = SK.read_scores(spark, path)
    assert L.results_exist(stored, dataset="VISO/car/003", idx=2)
    assert not L.results_exist(stored, dataset="VISO/car/003", idx=9)
    assert L.score_lookup(stored, 1, config_hash="h", tracking=True).first()["recall"] == 0.1


def test_names_paths_and_functions(spark):
    df = spark.createDataFrame([(7, "img/000042.jpg", "/d/Datasets/VISO/car/003/img")], "n int, f string, p string")
    row = df.select(
        SC.frame_name(F.col("n")).alias("a"),
        SC.frame_from_name(F.col("f")).alias("b"),
        SC.dataset_from_path(F.col("p")).alias("c"),
        SC.pct(F.lit(1234.0), F.lit(10000.0)).alias("d"),
    ).first()
    assert tuple(row) == ("000007", 42, "VISO/car/003", "12.34%")
    sql_functions.register(spark)
    got = spark.sql("select iou(0,0,10,10,2,2,7,7), box_area(1,1,4,5), level3(200), quantize(255, 48)").first()
    assert tuple(got) == (0.25, 12, 5, 48)


def test_score_and_track_from_stored_files(spark, tmp_path):
    path = str(tmp_path / "run")
    truth = boxes(spark, [(f, 0, 0, 3 * f, 5, 3 * f + 12, 15) for f in range(1, 9)])
    SK.write_motion(truth, identity_matrices(spark, range(1, 9)), path)
    regions = track_results(spark, path, with_history=True)
    assert regions.count() == 8
    history = FI.read_results(spark, path, "particle_filter_history")
    assert history.count() > 8 and "step_name" in history.columns
    gt_folder = tmp_path / "gt"
    gt_folder.mkdir()
    lines = [f"{f},0,{3 * f},5,12,10,1,-1,-1,-1" for f in range(1, 9)]
    (gt_folder / "gt.txt").write_text("\n".join(lines) + "\n")
    scores = score_files(spark, path, str(gt_folder / "gt.txt"), str(tmp_path / "metrics"), "v")
    assert scores.first()["f1"] == 1.0
    header = next((tmp_path / "metrics").glob("part-*")).read_text().splitlines()[0]
    assert header == "video,frame,true_positive,false_negative,false_positive"
