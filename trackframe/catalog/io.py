"""Queries that go through files, stored tables and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.catalog import query
from trackframe.catalog.boxes import BOXES
from trackframe.catalog.scores import _exports
from trackframe.functions import scalars as SC
from trackframe.operators import metrics as E
from trackframe.session import scratch_path
from trackframe.sources import files as FI
from trackframe.sources import fixtures as X
from trackframe.sources import frames as FR
from trackframe.sources import layout as L
from trackframe.sources import metadata as MD
from trackframe.sources import sinks as SK


@query(
    "read_results",
    "gt_regions",
    "select video, frame, ord, x1, y1, x2, y2 from gt_regions where frame between 50 and 120",
)
def read_results(spark, sf):
    path = scratch_path(spark, "results")
    SK.write_regions(X.gt_regions(spark, sf), path)
    rows = FI.read_results(spark, path, "regions", frames=(50, 120))
    return rows.select("video", "frame", "ord", "x1", "y1", "x2", "y2")


@query(
    "write_regions",
    "calc_regions",
    """select video, frame, ord, identity, cast(identity as varchar) as id_str, x1, y1, x2, y2
    from calc_regions""",
)
def write_regions(spark, sf):
    path = scratch_path(spark, "regions")
    SK.write_regions(X.calc_regions(spark, sf), path)
    return FI.read_results(spark, path)


@query(
    "write_motion",
    "calc_regions transformations",
    """select r.video, r.frame, r.ord, x1, y1, x2, y2, t13, t23 from calc_regions r
    join transformations t on t.video = r.video and t.frame = r.frame""",
)
def write_motion(spark, sf):
    path = scratch_path(spark, "motion")
    SK.write_motion(X.calc_regions(spark, sf), X.transformations(spark, sf), path)
    boxes = FI.read_results(spark, path, "motion_regions")
    matrices = FI.read_results(spark, path, "transformations").select(
        "video", "frame", "t13", "t23"
    )
    return boxes.join(matrices, ["video", "frame"])


@query(
    "write_tracks",
    "observed_tracks",
    """select video, identity, frame, x1, y1, x1 + 10 as x2, y1 + 8 as y2, observed,
      cast(identity as varchar) as id_str from observed_tracks""",
)
def write_tracks(spark, sf):
    path = scratch_path(spark, "tracks")
    boxes = X.observed_tracks(spark, sf).selectExpr("*", "x1 + 10 as x2", "y1 + 8 as y2")
    SK.write_tracks(boxes, None, path)
    return FI.read_results(spark, path, "bayesian_filter_regions")


@query(
    "write_history",
    "observed_tracks",
    """select video, frame, identity as filter_identity, 0 as step_idx, 'predict' as step_name,
      p.n as particle, x1 + p.n as x1, y1, x1 + 10 + p.n as x2, y1 + 8 as y2, observed,
      0.25e0 * (1 + p.n) as weight
    from observed_tracks, (select unnest(range(0, 3)) as n) p""",
)
def write_history(spark, sf):
    """Tracks with the history of three particles each."""
    path = scratch_path(spark, "history")
    boxes = X.observed_tracks(spark, sf).selectExpr("*", "x1 + 10 as x2", "y1 + 8 as y2")
    history = boxes.withColumn("particle", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr(
        "video", "frame", "identity as filter_identity", "0 as step_idx", "'predict' as step_name",
        "particle", "x1 + particle as x1", "y1", "x2 + particle as x2", "y2", "observed",
        "0.25D * (1 + particle) as weight",
    )
    SK.write_tracks(boxes, history, path)
    return FI.read_results(spark, path, "particle_filter_history")


GT_SQL = """select video, frame, identity, x1, y1, x2 - x1 as width, y2 - y1 as height,
  1 as c1, -1 as c2, -1 as c3, -1 as c4 from gt_regions"""


@query("write_gt", "gt_regions", GT_SQL)
def write_gt(spark, sf):
    return SK.gt_rows(X.gt_regions(spark, sf))


@query(
    "read_gt",
    "gt_regions",
    "select video, frame, identity, ord, x1, y1, x2, y2, cast(identity as varchar) as id_str from gt_regions",
)
def read_gt(spark, sf):
    """Ground truth written as files per video and read back."""
    path = scratch_path(spark, "gt")
    SK.write_gt(X.gt_regions(spark, sf), path)
    rows = FI.read_gt(spark, f"{path}/*/*.csv", video="")
    folder = F.regexp_extract(F.input_file_name(), r"video=(\d+)/", 1)
    return rows.withColumn("video", folder.cast("long"))


@query(
    "read_regions",
    "calc_regions",
    "select cast(video as varchar) as video, frame, ord, x1, y1, x2, y2, identity from calc_regions",
)
def read_regions(spark, sf):
    """Boxes written as results and read back by the reader that tells formats apart."""
    path = scratch_path(spark, "stored-regions")
    SK.write_regions(X.calc_regions(spark, sf), path)
    columns = ["frame", "ord", "x1", "y1", "x2", "y2", "identity"]
    return FI.read_regions(spark, path).select(F.col("video").cast("string"), *columns)


@query(
    "read_cvat",
    "gt_regions",
    """select video, frame, ord, x1, y1, x2, y2, identity, cast(identity as varchar) as id_str
    from gt_regions""",
)
def read_cvat(spark, sf):
    """Ground truth written as annotation XML per video and read back."""
    path = scratch_path(spark, "annotations")
    box = F.struct(
        (F.col("frame") - 1).alias("_frame"),
        *[F.col(a).cast("double").alias(f"_{b}")
          for a, b in (("x1", "xtl"), ("y1", "ytl"), ("x2", "xbr"), ("y2", "ybr"))],
    )
    tracks = X.gt_regions(spark, sf).groupBy("video", F.col("identity").alias("_id")).agg(
        F.sort_array(F.collect_list(box)).alias("box")
    )
    (
        tracks.write.partitionBy("video").format("xml")
        .option("rowTag", "track").option("rootTag", "annotations").save(path)
    )
    rows = FI.read_cvat(spark, f"{path}/*/*.xml", video="")
    folder = F.regexp_extract(F.input_file_name(), r"video=(\d+)/", 1)
    return rows.withColumn("video", folder.cast("long"))


@query(
    "write_baseline",
    "gt_regions",
    "select cast(video as varchar) as video, frame, x1, y1, x2, y2 from gt_regions",
)
def write_baseline(spark, sf):
    path = scratch_path(spark, "baseline")
    SK.write_baseline(X.gt_regions(spark, sf), path)
    return FI.read_baseline(spark, path)


@query(
    "write_metrics",
    BOXES,
    """select video, count(*) as frames, cast(sum(n) as bigint) as boxes from (
      select video, frame, count(*) as n from calc_regions group by 1, 2) t group by 1""",
)
def write_metrics(spark, sf):
    """Counts written as CSV; every detection is a true or a false positive."""
    path = scratch_path(spark, "metrics")
    base = X.boxes_base(spark, sf)
    counts = E.frame_counts(X.calc_from_base(base), X.gt_from_base(base))
    SK.write_metrics(counts, path)
    ddl = "video bigint, frame bigint, true_positive bigint, false_negative bigint, false_positive bigint"
    rows = spark.read.schema(ddl).csv(path, header=True)
    found = F.col("true_positive") + F.col("false_positive")
    return rows.filter(found > 0).groupBy("video").agg(
        F.count("*").alias("frames"), F.sum(found).alias("boxes")
    )


@query(
    "export_samples",
    "scores",
    """select 'VISO' as dataset, cast(video as varchar) as video_name, case idx % 3
        when 0 then 'Problem Objective function 1' when 1 then 'Problem Objective function 2'
        else 'Final Objective Function' end as objective_function,
      idx, recall, prec as precision, f1 from scores""",
)
def export_samples(spark, sf):
    path = scratch_path(spark, "samples")
    SK.write_samples(_exports(spark, sf), path)
    ddl = (
        "dataset string, video_name string, objective_function string, idx bigint, "
        "recall double, precision double, f1 double"
    )
    return spark.read.schema(ddl).csv(path, header=True)


RUNS_SQL = """runs as (select concat('p', cast(p_partkey % 50 as varchar)) as pipeline, max(p_size) as size,
  max(p_brand) as brand, count(*) as parts from part group by 1),
fresh as (select * from runs where size % 2 = 0)"""


def _runs(spark, sf):
    return (
        X.table(spark, sf, "part")
        .groupBy(F.concat(F.lit("p"), (F.col("p_partkey") % 50).cast("string")).alias("pipeline"))
        .agg(
            F.max("p_size").alias("size"),
            F.max("p_brand").alias("brand"),
            F.count("*").alias("parts"),
        )
    )


@query(
    "run_metadata",
    "",
    f"""with {RUNS_SQL}, old as (select pipeline, 'size' as key, cast(size as varchar) as value from runs
      union all select pipeline, 'brand', brand from runs),
    new as (select pipeline, 'size' as key, cast(size + 1000 as varchar) as value from runs where size % 2 = 0
      union all select pipeline, 'config', concat('{{"brand":"', brand, '","parts":', cast(parts as varchar), '}}')
      from runs where size % 2 = 0)
    select * from old where pipeline not in (select pipeline from new) union all select * from new""",
)
def run_metadata(spark, sf):
    runs = _runs(spark, sf)
    again = runs.filter("size % 2 = 0").withColumn("size", F.col("size") + 1000)
    fresh = MD.metadata_rows(again, ["size"]).unionByName(
        MD.config_row(again, ["brand", "parts"])
    )
    return MD.replace_pipelines(MD.metadata_rows(runs, ["size", "brand"]), fresh)


@query(
    "run_metadata_stored",
    "",
    f"""with {RUNS_SQL} select pipeline, 'size' as key, cast(size + case when size % 2 = 0 then 1000 else 0 end as varchar)
      as value from runs""",
)
def run_metadata_stored(spark, sf):
    """Two writes; the second replaces the folders of its own pipelines only."""
    path = scratch_path(spark, "metadata")
    runs = _runs(spark, sf)
    again = runs.filter("size % 2 = 0").withColumn("size", F.col("size") + 1000)
    stages = runs.select("pipeline", F.split("brand", "#").alias("stages"))
    for batch in (runs, again):
        names = stages.join(batch.select("pipeline"), "pipeline", "left_semi")
        MD.write_run_metadata(MD.metadata_rows(batch, ["size"]), MD.stage_rows(names), path)
    return MD.read_run_metadata(spark, path).select("pipeline", "key", "value")


@query(
    "stage_list",
    "",
    f"""with {RUNS_SQL}, s as (select pipeline, unnest(string_split(brand, '#')) as name,
      generate_subscripts(string_split(brand, '#'), 1) - 1 as sort_order from runs)
    select pipeline, name, sort_order from s""",
)
def stage_list(spark, sf):
    runs = _runs(spark, sf).withColumn("stages", F.split("brand", "#"))
    return MD.stage_rows(runs)


@query(
    "repair_metadata",
    "",
    """with m as (select n_nationkey as video, 'file_name' as key, n_name as value from nation
      union all select n_nationkey, 'region', cast(n_regionkey as varchar) from nation)
    select m.video, m.key, case when key = 'file_name' then coalesce(r.r_name, value) else value end as value
    from m left join (select n_nationkey as video, r_name from nation join region on n_regionkey = r_regionkey
      where n_nationkey % 2 = 0) r on r.video = m.video
    union all select n_nationkey, 'frame_width', cast(n_nationkey * 10 as varchar) from nation""",
)
def repair_metadata(spark, sf):
    nation, region = (X.table(spark, sf, n) for n in ("nation", "region"))
    video = F.col("n_nationkey").alias("video")
    stored = nation.select(video, F.col("n_name").alias("file_name"), F.col("n_regionkey").cast("string").alias("region")).unpivot(
        "video", ["file_name", "region"], "key", "value"
    )
    updates = (
        nation.filter("n_nationkey % 2 = 0")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(video, F.lit("file_name").alias("key"), F.col("r_name").alias("value"))
    )
    inserts = nation.select(
        video,
        F.lit("frame_width").alias("key"),
        (F.col("n_nationkey") * 10).cast("string").alias("value"),
    )
    return MD.repair_metadata(stored, updates, inserts)


KEYED_SQL = """k as (select concat('VISO/car/00', cast(video as varchar)) as dataset, 'h' || cast(idx % 2 as varchar) as config_hash,
  idx % 3 = 0 as tracking, idx % 5 = 0 as persist, 35 as max_width, 35 as max_height, idx % 2 = 0 as allow_overlap,
  idx, sample_ord, recall, prec as precision, f1 from scores)"""


def _keyed(spark, sf):
    return X.scores(spark, sf).selectExpr(
        "concat('VISO/car/00', cast(video as string)) as dataset",
        "concat('h', cast(idx % 2 as string)) as config_hash",
        "idx % 3 = 0 as tracking",
        "idx % 5 = 0 as persist",
        "35 as max_width",
        "35 as max_height",
        "idx % 2 = 0 as allow_overlap",
        "idx",
        "sample_ord",
        "recall",
        "prec as precision",
        "f1",
    )


@query(
    "score_lookup",
    "scores",
    f"""with {KEYED_SQL} select dataset, idx, recall, precision, f1 from k where config_hash = 'h0' and tracking
      and not persist and max_width = 35 and max_height = 35 and allow_overlap""",
)
def score_lookup(spark, sf):
    """All datasets under one setting, from stored folders."""
    path = scratch_path(spark, "scores")
    SK.append_scores(_keyed(spark, sf), path)
    found = L.score_lookup(
        SK.read_scores(spark, path),
        config_hash="h0",
        tracking=True,
        persist=False,
        max_width=35,
        max_height=35,
        allow_overlap=True,
    )
    return found.select("dataset", "idx", "recall", "precision", "f1")


@query(
    "results_layout",
    "scores",
    f"""with {KEYED_SQL} select distinct dataset, config_hash, idx + 1 as idx from k
    where not exists (select 1 from k b where b.dataset = k.dataset and b.config_hash = k.config_hash and b.idx = k.idx + 1)""",
)
def results_layout(spark, sf):
    """Which of the next designs have no stored result yet."""
    keys = ["dataset", "config_hash", "idx"]
    stored = _keyed(spark, sf).select(*keys)
    wanted = stored.withColumn("idx", F.col("idx") + 1).distinct()
    return L.missing_results(wanted, stored, keys)


@query(
    "list_datasets",
    "",
    """select distinct concat('VISO/', regexp_extract(url, '//([^/]+)/', 1)) as dataset from pages""",
)
def list_datasets(spark, sf):
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    pages = X.table(spark, sf, "pages").select(
        F.concat(F.lit("/data/Datasets/VISO/"), host, F.lit("/img/"), "page_id", F.lit(".jpg")).alias("path")
    )
    return L.dataset_of(pages)


@query(
    "dataset_from_path",
    "",
    r"""select page_id, regexp_extract(concat('/x/Datasets/', url), 'Datasets/(.+)/[^/]*$', 1) as dataset from pages""",
)
def dataset_from_path(spark, sf):
    path = F.concat(F.lit("/x/Datasets/"), "url")
    return X.table(spark, sf, "pages").select(
        "page_id", SC.dataset_from_path(path).alias("dataset")
    )


@query(
    "frame_name",
    "",
    """select l_orderkey, l_linenumber, printf('%06d', l_orderkey * 1000 + l_linenumber) as name,
      l_orderkey * 1000 + l_linenumber as frame from lineitem""",
)
def frame_name(spark, sf):
    rows = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    number = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    named = rows.withColumn("name", SC.frame_name(number))
    image = F.concat(F.lit("img/"), "name", F.lit(".jpg"))
    return named.withColumn("frame", SC.frame_from_name(image))


@query(
    "minutes_since",
    "",
    """select event_id, round(date_diff('microsecond', ts, timestamp '2024-02-01 00:00:00') / 60000000.0e0, 4) as minutes
    from events""",
)
def minutes_since(spark, sf):
    events = X.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return events.select(
        "event_id", F.round(SC.minutes_since(F.col("ts"), now), 4).alias("minutes")
    )


@query(
    "video_length",
    "gt_regions",
    """select video, max(frame) as frames, round(max(frame) / 30.0e0, 6) as seconds from gt_regions group by 1""",
)
def video_length(spark, sf):
    frames = X.gt_regions(spark, sf).groupBy("video").agg(F.max("frame").alias("frames"))
    seconds = SC.video_length(F.col("frames"), F.lit(FI.IMAGE_FPS))
    return frames.withColumn("seconds", F.round(seconds, 6))


@query(
    "flatten",
    "gt_regions",
    "select video, frame, x1 as edge from gt_regions union all select video, frame, x2 from gt_regions",
)
def flatten(spark, sf):
    nested = F.array(F.array("x1"), F.array("x2"))
    return X.gt_regions(spark, sf).select(
        "video", "frame", F.explode(SC.flatten_once(nested)).alias("edge")
    )


@query(
    "round2_pct",
    "scores",
    """select video, idx, round_even(recall * 100, 0) / 100 as recall,
      concat(cast(round_even(recall / 3.0e0 * 10000, 0) / 100 as varchar), '%') as share from scores""",
)
def round2_pct(spark, sf):
    return X.scores(spark, sf).select(
        "video",
        "idx",
        SC.round2(F.col("recall")).alias("recall"),
        SC.pct(F.col("recall"), F.lit(3.0)).alias("share"),
    )


@query(
    "read_frames",
    "pixels",
    """select cast(video as varchar) as video,
      cast(dense_rank() over (partition by video order by frame) as int) as frame, y, x, v from pixels""",
)
def read_frames(spark, sf):
    """Frames written as image files and read back, numbered by file name."""
    path = scratch_path(spark, "images")
    SK.write_frames(FR.assemble_frames(X.pixels(spark, sf)), path)
    return FR.explode_pixels(FI.read_frames(spark, f"{path}/Datasets/*/img"))


@query(
    "read_score_table",
    "scores",
    """with cells as (select 'm' || (idx % 25) as method, cast(video as varchar) as video,
      max(recall) as recall, max(prec) as prec from scores group by 1, 2),
    grid as (select method, video from (select distinct method from cells),
      (select cast(unnest(range(0, 7)) as varchar) as video))
    select method, video, m.metric, case m.metric when 'recall' then recall else prec end as value
    from grid left join cells using (method, video),
      (select unnest(['recall', 'prec']) as metric) m""",
)
def read_score_table(spark, sf):
    """Best scores of 25 groups of designs, written with two header rows and read back."""
    path = scratch_path(spark, "score-table")
    best = (
        X.scores(spark, sf)
        .select(
            F.concat(F.lit("m"), F.col("idx") % 25).alias("method"), "video", "recall", "prec"
        )
        .unpivot(["method", "video"], ["recall", "prec"], "metric", "value")
    )
    SK.write_score_table(best, path, list(range(7)), ["recall", "prec"])
    return FI.read_score_table(spark, path, header_rows=2)
