"""Views that give the driver's tables the shapes of this package.

``SQL`` holds each view as text for any SQL engine; :func:`view` builds the same
rows with the DataFrame API, spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators.running import row_numbers

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "boxes_base": (
        (),
        """select k, p, k // 5000 as video, (k // 25) % 200 + 1 as frame, k % 25 as identity,
  ((k % 25)*37 + ((k // 25) % 200 + 1)*((k % 25) % 5)) % 300 as x1,
  ((k % 25)*53 + ((k // 25) % 200 + 1)*((k % 25) % 3)) % 200 as y1,
  12 + (k % 25) % 9 as w, 10 + (k % 25) % 7 as h
from (select cast(o_orderkey as bigint) as k, cast(round(o_totalprice*100) as bigint) as p from orders) t""",
    ),
    "gt_regions": (
        ("boxes_base",),
        """select video, frame, identity, identity as ord, x1, y1, x1+w as x2, y1+h as y2
from boxes_base where p % 10 <> 0""",
    ),
    "calc_regions": (
        ("boxes_base",),
        """select video, frame, identity, identity as ord, x1 + p % 7 - 3 as x1, y1 + p % 5 - 2 as y1,
  x1 + p % 7 - 3 + w as x2, y1 + p % 5 - 2 + h as y2
from boxes_base where p % 4 <> 0
union all
select video, frame, identity + 1000, identity + 1000, x1 + 40, y1 + 25, x1 + 40 + w, y1 + 25 + h
from boxes_base where p % 5 = 0""",
    ),
    "tracks": (
        (),
        """select user_id % 3 as video, user_id as identity,
  row_number() over (partition by user_id order by ts, event_id) as frame,
  (event_id*37) % 1000 as x1, (event_id*53) % 800 as y1,
  (event_id*37) % 1000 + 10 as x2, (event_id*53) % 800 + 8 as y2
from events""",
    ),
    "observed_tracks": (
        (),
        """select (event_id // 3) % 3 as video, event_id // 3 as identity, event_id % 3 + 1 as frame,
  (event_id*37) % 1000 as x1, (event_id*53) % 800 as y1,
  cast(round(value*100) as bigint) % 3 <> 0 as observed
from events""",
    ),
    "transformations": (
        ("boxes_base",),
        """select distinct video, frame, 1.0e0 as t11, 0.0e0 as t12, cast(frame % 3 - 1 as double) as t13,
  0.0e0 as t21, 1.0e0 as t22, cast(frame % 2 as double) as t23, 0.0e0 as t31, 0.0e0 as t32, 1.0e0 as t33
from boxes_base where frame % 10 <> 0""",
    ),
    "vectors": (
        (),
        """select label as video, vec_id, embedding,
  row_number() over (partition by label order by vec_id) as frame from embeddings""",
    ),
    "pixels": (
        ("vectors",),
        """select video, frame, pos // 8 as y, pos % 8 as x,
  cast(greatest(0, least(255, floor((cast(e as double)*2+1)*127.5))) as int) as v
from (select video, frame, unnest(embedding) as e, generate_subscripts(embedding,1)-1 as pos
  from vectors) t""",
    ),
    "mask": (("pixels",), "select video, frame, y, x from pixels where v >= 140"),
    "scores": (
        (),
        """select video, idx, sample_ord, recall, prec,
  case when recall + prec = 0 then 0 else 2*recall*prec/(recall+prec) end as f1
from (select p_partkey % 7 as video, p_partkey as idx, p_partkey // 7 as sample_ord,
  (p_partkey*31 % 101) / 101.0e0 as recall, (p_partkey*p_partkey*17 % 103) / 103.0e0 as prec
from part) t""",
    ),
}


def with_views(names: str, body: str) -> str:
    """``body`` below a WITH clause that defines the named views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in SQL[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    clauses = [f"{name} as (\n{SQL[name][1]}\n)" for name in order]
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join([*clauses, body[len("with recursive "):]])
    if body.lower().startswith("with "):
        return "with " + ",\n".join([*clauses, body[len("with "):]])
    return "with " + ",\n".join(clauses) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return boxes_from_orders(orders)


def boxes_from_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").cast("bigint").alias("k"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("p"),
    ).selectExpr(
        "k",
        "p",
        "k div 5000 as video",
        "(k div 25) % 200 + 1 as frame",
        "k % 25 as identity",
        "((k % 25)*37 + ((k div 25) % 200 + 1)*((k % 25) % 5)) % 300 as x1",
        "((k % 25)*53 + ((k div 25) % 200 + 1)*((k % 25) % 3)) % 200 as y1",
        "12 + (k % 25) % 9 as w",
        "10 + (k % 25) % 7 as h",
    )


def gt_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt_from_base(boxes_base(spark, sf_dir))


def gt_from_base(base: DataFrame) -> DataFrame:
    return base.filter("p % 10 <> 0").selectExpr(
        "video", "frame", "identity", "identity as ord", "x1", "y1", "x1+w as x2", "y1+h as y2"
    )


def calc_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calc_from_base(boxes_base(spark, sf_dir))


def calc_from_base(base: DataFrame) -> DataFrame:
    seen = base.filter("p % 4 <> 0").selectExpr(
        "video",
        "frame",
        "identity",
        "identity as ord",
        "x1 + p % 7 - 3 as x1",
        "y1 + p % 5 - 2 as y1",
        "x1 + p % 7 - 3 + w as x2",
        "y1 + p % 5 - 2 + h as y2",
    )
    false_alarm = base.filter("p % 5 = 0").selectExpr(
        "video",
        "frame",
        "identity + 1000 as identity",
        "identity + 1000 as ord",
        "x1 + 40 as x1",
        "y1 + 25 as y1",
        "x1 + 40 + w as x2",
        "y1 + 25 + h as y2",
    )
    return seen.unionByName(false_alarm)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    day = F.date_trunc("day", F.col("ts"))
    return row_numbers(events, ["user_id"], ["ts", "event_id"], day, "frame").selectExpr(
        "user_id % 3 as video",
        "user_id as identity",
        "frame",
        "(event_id*37) % 1000 as x1",
        "(event_id*53) % 800 as y1",
        "(event_id*37) % 1000 + 10 as x2",
        "(event_id*53) % 800 + 8 as y2",
    )


def observed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed_from_events(table(spark, sf_dir, "events"))


def observed_from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "(event_id div 3) % 3 as video",
        "event_id div 3 as identity",
        "event_id % 3 + 1 as frame",
        "(event_id*37) % 1000 as x1",
        "(event_id*53) % 800 as y1",
        "cast(round(value*100) as bigint) % 3 <> 0 as observed",
    )


def transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        boxes_base(spark, sf_dir)
        .filter("frame % 10 <> 0")
        .select("video", "frame")
        .distinct()
        .selectExpr(
            "video",
            "frame",
            "1.0D as t11",
            "0.0D as t12",
            "cast(frame % 3 - 1 as double) as t13",
            "0.0D as t21",
            "1.0D as t22",
            "cast(frame % 2 as double) as t23",
            "0.0D as t31",
            "0.0D as t32",
            "1.0D as t33",
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings numbered per label; the payload is joined back after numbering."""
    rows = table(spark, sf_dir, "embeddings")
    keys = rows.select(F.col("label").alias("video"), "vec_id")
    chunk = F.floor(F.col("vec_id") / 4096)
    frames = row_numbers(keys, ["video"], ["vec_id"], chunk, "frame")
    return rows.select("vec_id", "embedding").join(frames, "vec_id")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(
        "video", "frame", F.posexplode("embedding").alias("pos", "e")
    ).selectExpr(
        "video",
        "frame",
        "pos div 8 as y",
        "pos % 8 as x",
        "cast(greatest(0, least(255, floor((cast(e as double)*2+1)*127.5))) as int) as v",
    )


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).filter("v >= 140").select("video", "frame", "y", "x")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 7 as video",
        "p_partkey as idx",
        "p_partkey div 7 as sample_ord",
        "(p_partkey*31 % 101) / 101.0D as recall",
        "(p_partkey*p_partkey*17 % 103) / 103.0D as prec",
    ).selectExpr(
        "*",
        "case when recall + prec = 0 then 0D else 2*recall*prec/(recall+prec) end as f1",
    )
