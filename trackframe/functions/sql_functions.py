"""SQL functions for sessions that query boxes and pixels as text.

They are SQL bodies, so calls are inlined into the plan and code-generated.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_BOX = "x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT"
_PAIR = (
    "ax1 BIGINT, ay1 BIGINT, ax2 BIGINT, ay2 BIGINT, "
    "bx1 BIGINT, by1 BIGINT, bx2 BIGINT, by2 BIGINT"
)
_INTER = (
    "(greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * "
    "greatest(least(ay2, by2) - greatest(ay1, by1), 0))"
)

DEFINITIONS = {
    "box_area": (_BOX, "BIGINT", "abs((x2 - x1) * (y2 - y1))"),
    "centroid_x": (_BOX, "DOUBLE", "(x2 - x1) / 2D + x1"),
    "centroid_y": (_BOX, "DOUBLE", "(y2 - y1) / 2D + y1"),
    "iou": (
        _PAIR,
        "DOUBLE",
        f"CASE WHEN {_INTER} = 0 THEN 0D "
        "WHEN ax1 = bx1 AND ay1 = by1 AND ax2 = bx2 AND ay2 = by2 THEN 1D "
        f"ELSE {_INTER} / CAST(abs((ax2 - ax1) * (ay2 - ay1)) + "
        f"abs((bx2 - bx1) * (by2 - by1)) - {_INTER} AS DOUBLE) END",
    ),
    "level3": ("v INT", "INT", "CASE WHEN v <= 85 THEN 3 WHEN v < 170 THEN 2 ELSE 5 END"),
    "quantize": ("v INT, s INT", "INT", "CAST(floor(v * s / 255D) AS INT)"),
}


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in DEFINITIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} "
            f"RETURN {body}"
        )
