"""URL verdicts: host and path rules, and per host a tree of path templates.

Pages that a rule decides are the labelled ones. For each host, path segments are
turned into template parts: where one place of the tree holds many different
segments of one shape, they become a wildcard of that shape. Branches of a host
with the same shape and the same degree of labelled purity are merged. A page
without a rule is blocked if the purity of its merged template, smoothed towards
that of the host, is low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    """What follows the first ``://``, or an empty string."""
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise("")


def rule_of(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest rule that fits, or null.

    ``rules`` maps ``host/path`` to allow or block. It is a list that people write,
    and becomes one expression.
    """
    fits = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # longer ones go outside
        rule_host, _, tail = rule.partition("/")
        here = (host == rule_host) | host.endswith(f".{rule_host}")
        fits = F.when(here & path.startswith(f"/{tail}"), F.lit(rule)).otherwise(fits)
    return fits


def path_templates(paths: DataFrame, max_values: int = 8) -> DataFrame:
    """Distinct (host, path) rows with their ``shape`` and ``template``.

    A segment becomes ``{shape}`` if its place holds more than ``max_values``
    different segments of that shape; digits are 0 and letters a in a shape. A
    place is the host and the shapes of the segments before. Work is one row per
    segment, whatever the depth.
    """
    shape = lambda s: F.regexp_replace(
        F.regexp_replace(s, "[0-9]+", "0"), "[A-Za-z]+", "a"
    )
    split = paths.withColumn("parts", F.split("path", "/", -1)).withColumn(
        "shapes", F.transform("parts", shape)
    )
    parts = split.select(
        "host", "path", F.array_join("shapes", "/").alias("all_shapes"), "shapes",
        F.posexplode("parts").alias("pos", "part"),
    ).select(
        "host", "path", "all_shapes", "pos", "part",
        F.array_join(F.slice("shapes", 1, F.col("pos")), "/").alias("before"),
        F.element_at("shapes", F.col("pos") + 1).alias("shape"),
    )
    place = ["host", "pos", "before", "shape"]
    variable = (
        parts.select(*place, "part").distinct().groupBy(*place).agg(F.count("*").alias("values"))
        .filter(F.col("values") > max_values)
        .select(*place, F.lit(True).alias("wild"))
    )
    return (
        # written, so that the join can split a place of very many segments
        parts.join(stored(variable, "variable-places"), place, "left")
        .withColumn(
            "part",
            F.when(F.col("wild"), F.concat(F.lit("{"), "shape", F.lit("}"))).otherwise(
                F.col("part")
            ),
        )
        .groupBy("host", "path", F.col("all_shapes").alias("shape"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("steps"))
        .select(
            "host", "path", "shape",
            F.array_join(F.transform("steps", lambda s: s["part"]), "/").alias("template"),
        )
    )


def url_verdicts(
    pages: DataFrame,
    rules: dict[str, str],
    id_col: str = "page_id",
    url_col: str = "url",
    max_values: int = 8,
    weight: int = 4,
    least_purity: float = 0.25,
) -> DataFrame:
    """(id, host, path, rule, verdict, template) for every page.

    Urls that are null or lack ``://`` have an empty host and path, are judged as
    one template, and are allowed. Repeated rows are judged one by one, ids may be
    null. ``weight`` pseudo-pages pull a template's purity towards its host's, and
    the host's towards one half.
    """
    pages = pages.select(
        F.col(id_col), host_of(url_col).alias("host"), path_of(url_col).alias("path")
    ).withColumn("rule", rule_of(rules, F.col("host"), F.col("path")))
    says = lambda what: F.col("rule").isin([r for r, v in rules.items() if v == what])
    paths = pages.groupBy("host", "path").agg(
        F.count(F.when(says("allow"), 1)).alias("good"),
        F.count(F.when(says("block"), 1)).alias("bad"),
    )
    templates = path_templates(paths.select("host", "path"), max_values)
    branches = (
        paths.join(templates, ["host", "path"])
        .groupBy("host", "shape", "template")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .withColumn(
            "degree",
            F.when(F.col("good") + F.col("bad") == 0, -1).otherwise(
                F.floor(4 * (F.col("good") + 1) / (F.col("good") + F.col("bad") + 2))
            ),
        )
    )
    merged = branches.groupBy("host", "shape", "degree").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )
    hosts = branches.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb"))
    host_purity = (F.col("hg") + weight / 2) / (F.col("hg") + F.col("hb") + weight)
    purity = (F.col("good") + weight * F.col("hp")) / (F.col("good") + F.col("bad") + weight)
    judged = (
        branches.drop("good", "bad")
        .join(merged, ["host", "shape", "degree"])
        .join(hosts.select("host", host_purity.alias("hp")), "host")
        .select("host", "shape", "template", (purity < least_purity).alias("reject"))
    )
    by_path = templates.join(judged, ["host", "shape", "template"]).select(
        "host", "path", "template", "reject"
    )
    verdict = (
        F.when(says("allow"), "allow").when(says("block"), "block")
        .when(F.col("reject"), "block").otherwise("allow")
    )
    return pages.join(by_path, ["host", "path"], "left").select(
        F.col(id_col), "host", "path", "rule", verdict.alias("verdict"), "template"
    )
