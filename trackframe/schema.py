"""Schemas of every stored table, as DDL text that readers and Arrow functions take."""

from __future__ import annotations

BOX = "x1 int, y1 int, x2 int, y2 int"

FRAMES = "video string, frame int, height int, width int, channels int, data binary"
PIXELS = "video string, frame int, y int, x int, v int"
VIDEOS = "video string, width int, height int, fps double, frame_count bigint"
REGIONS = f"video string, frame int, ord int, {BOX}, identity bigint, id_str string"
MOTION_REGIONS = f"video string, frame int, ord int, {BOX}"
TRANSFORMS = (
    "video string, frame int, t11 double, t12 double, t13 double, t21 double, "
    "t22 double, t23 double, t31 double, t32 double, t33 double"
)
TRACKS = (
    f"video string, frame int, {BOX}, identity bigint, id_str string, observed boolean"
)
PARTICLE_HISTORY = (
    "video string, frame int, filter_identity bigint, step_idx int, step_name string, "
    f"particle int, {BOX}, identity bigint, id_str string, observed boolean, weight double"
)
METADATA = "pipeline string, key string, value string"
STAGES = "pipeline string, name string, sort_order int"
GT_FILE = (
    "frame int, identity bigint, x1 int, y1 int, width int, height int, "
    "c1 int, c2 int, c3 int, c4 int"
)
BASELINE_FILE = f"{BOX}, frame int"
SCORES = (
    "dataset string, config_hash string, tracking boolean, persist boolean, max_width int, "
    "max_height int, allow_overlap boolean, idx bigint, recall double, precision double, "
    "f1 double, sample_ord bigint"
)
SCORE_TABLE = "method string, video string, metric string, value double"

TRANSFORM_COLUMNS = ["t11", "t12", "t13", "t21", "t22", "t23", "t31", "t32", "t33"]
BOX_COLUMNS = ["x1", "y1", "x2", "y2"]
