"""Registration of frame pairs: keypoints, descriptors, homographies, warps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators.pixels import FRAME
from trackframe.operators.running import row_numbers
from trackframe.schema import TRANSFORM_COLUMNS
from trackframe.session import spread

# Positions are kept in 1/32 pixel when a frame is resampled.
SUBPIXEL = 32

WARPED = ["video", "frame", "hist_frame", "y", "x"]


# Keypoints ------------------------------------------------------------------


def spatial_topk(keypoints: DataFrame, n: int, cell: int) -> DataFrame:
    """The n strongest keypoints per frame, spread over grid cells.

    ``keypoints(video, frame, kp, x, y, response)``. The strongest of every cell
    come first, then the second strongest, and so on.
    """
    inside = Window.partitionBy(*FRAME, "cx", "cy").orderBy(F.col("response").desc(), "kp")
    ranked = (
        keypoints.withColumns(
            {"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)}
        )
        .withColumn("cell_rank", F.row_number().over(inside))
        .filter(F.col("cell_rank") <= n)
        .withColumn("weak", -F.col("response"))
    )
    numbered = row_numbers(
        ranked, FRAME, ["cell_rank", "weak", "kp"], F.col("cell_rank"), "place"
    )
    return numbered.filter(F.col("place") <= n).select(*keypoints.columns, "place")


# Keypoints of b that are indexed together, and keypoints of a that ask one index.
DESCRIPTOR_BLOCK, DESCRIPTOR_ASKS = 16384, 4096


def _nearest_in_block(a, b, words: list[str], keys: list[str]):
    """Each keypoint of Arrow table ``a`` with its nearest of ``b``, ties to the lowest kp."""
    import numpy as np
    import pyarrow as pa

    from trackframe.operators.bitindex import nearest

    b = b.sort_by("b_kp")
    bits = lambda table, tag: np.stack(
        [table.column(f"{tag}_{w}").to_numpy().astype(np.int64).view(np.uint64) for w in words]
    )
    if not a.num_rows or not b.num_rows:
        return a.select([*keys, "a_kp"]).slice(0, 0).append_column(
            "match", b.column("b_kp").slice(0, 0)
        ).append_column("dist", pa.array([], pa.int32()))
    place, dist, _ = nearest(bits(a, "a"), bits(b, "b"))
    return (
        a.select([*keys, "a_kp"])
        .append_column("match", b.column("b_kp").take(pa.array(place)))
        .append_column("dist", pa.array(dist, pa.int32()))
    )


def match_descriptors(
    a: DataFrame, b: DataFrame, words: list[str], keys: list[str] | None = None
) -> DataFrame:
    """For each keypoint of a, the nearest descriptor of b within the frame pair.

    Both sides have (keys, kp, words...) and share their keys per frame pair. Both are
    dealt into blocks of bounded size. Where they meet, b's block is indexed by bands of
    bits, which a's keypoints probe at growing radius until the nearest is proven; each
    leaves one row. No pair of keypoints is ever a row. Ties go to the lowest kp of b.
    Output: keys, kp, match, dist.
    """
    keys = keys or FRAME

    def sided(df: DataFrame, tag: str, names: list[str]) -> DataFrame:
        return df.select(
            *[F.col(k).alias(name) for k, name in zip(keys, names)],
            F.col("kp").alias(f"{tag}_kp"),
            *[F.col(w).alias(f"{tag}_{w}") for w in words],
        )

    # both sides may stem from one table, so all columns get names of their own
    other = [f"b_{k}" for k in keys]
    left, right = sided(a, "a", keys), sided(b, "b", other)

    def blocks(df: DataFrame, names: list[str], most: int, name: str) -> DataFrame:
        return df.groupBy(*[F.col(c).alias(k) for c, k in zip(names, keys)]).agg(
            F.ceil(F.count("*") / most).cast("int").alias(name)
        )

    sizes = blocks(left, keys, DESCRIPTOR_ASKS, "parts").join(
        blocks(right, other, DESCRIPTOR_BLOCK, "blocks"), keys
    )
    part = F.pmod(F.xxhash64("a_kp"), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64("b_kp"), F.col("blocks")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = (
        left.join(sizes, keys).withColumn("a_part", part).withColumn("a_block", upto("blocks"))
        .drop("parts", "blocks")
    )
    dealt = (
        right.join(sizes.withColumnsRenamed(dict(zip(keys, other))), other)
        .withColumn("b_block", block).withColumn("b_part", upto("parts"))
        .drop("parts", "blocks")
    )
    kinds = [f"{k} {left.schema[k].dataType.simpleString()}" for k in keys]
    kinds.append(f"a_kp {left.schema['a_kp'].dataType.simpleString()}")
    kinds.append(f"match {right.schema['b_kp'].dataType.simpleString()}")
    near = (
        asks.groupBy(*keys, "a_part", "a_block")
        .cogroup(dealt.groupBy(*other, "b_part", "b_block"))
        .applyInArrow(
            lambda mine, other: _nearest_in_block(mine, other, words, keys),
            ", ".join([*kinds, "dist int"]),
        )
    )
    return (
        near.groupBy(*keys, "a_kp").agg(F.min(F.struct("dist", "match")).alias("m"))
        .select(*keys, F.col("a_kp").alias("kp"), F.col("m.match"), F.col("m.dist"))
    )


def top_fraction(
    matches: DataFrame, share: float, keys: list[str] | None = None
) -> DataFrame:
    """The floor(n * share) closest matches of each frame pair.

    Ranking is cut at each distance, so a pair with very many matches is many
    small windows.
    """
    keys = keys or FRAME
    numbered = row_numbers(matches, keys, ["dist", "kp"], F.col("dist"), "rank")
    counts = matches.groupBy(*keys).agg(F.count("*").alias("n"))
    return (
        numbered.join(counts, keys)
        .filter(F.col("rank") <= F.floor(F.col("n") * share))
        .drop("n", "rank")
    )


# Homography -----------------------------------------------------------------


def solve_homographies(src, dst):
    """3x3 matrices through stacks of point pairs, and which of them could be solved."""
    import numpy as np

    def normalizer(points):
        center = points.mean(axis=1)
        spread = np.sqrt(((points - center[:, None]) ** 2).sum(axis=2)).mean(axis=1)
        scale = np.where(spread > 0, np.sqrt(2) / np.where(spread > 0, spread, 1.0), 1.0)
        m = np.zeros((len(points), 3, 3))
        m[:, 0, 0] = m[:, 1, 1] = scale
        m[:, :2, 2], m[:, 2, 2] = -scale[:, None] * center, 1.0
        return m

    ns, nd = normalizer(src), normalizer(dst)
    ones = np.ones((*src.shape[:2], 1))
    s = np.concatenate([src, ones], axis=2) @ ns.transpose(0, 2, 1)
    d = np.concatenate([dst, ones], axis=2) @ nd.transpose(0, 2, 1)
    zero = np.zeros_like(s)
    top = np.concatenate([s, zero, -d[:, :, :1] * s], axis=2)
    low = np.concatenate([zero, s, -d[:, :, 1:2] * s], axis=2)
    # four points have a ninth direction of their own; more need no square factor
    four = src.shape[1] == 4
    _, values, vt = np.linalg.svd(np.concatenate([top, low], axis=1), full_matrices=four)
    m = np.linalg.inv(nd) @ vt[:, -1].reshape(-1, 3, 3) @ ns
    good = np.abs(m[:, 2, 2]) > 1e-12
    if four:
        good &= values[:, -1] >= 1e-9 * np.maximum(values[:, 0], 1e-300)
    return m / np.where(good, m[:, 2, 2], 1.0)[:, None, None], good


def solve_homography(src, dst):
    """3x3 matrix through point pairs by normalized linear least squares, or None."""
    m, good = solve_homographies(src[None], dst[None])
    return m[0] if good[0] else None


# Frame pairs whose draws are kept by a task.
KEPT_DRAWS = 4096


class _Draws:
    """Seeded draws of four of n points: those of a frame and a number of points are one row of draws."""

    def __init__(self, seed: int):
        self.seed, self.kept = seed, {}

    def of(self, frame: int, n: int, number: int):
        import numpy as np

        if (frame, n) not in self.kept:
            if len(self.kept) >= KEPT_DRAWS:
                self.kept.clear()
            self.kept[frame, n] = (np.random.default_rng([self.seed, frame, n]), [])
        rng, drawn = self.kept[frame, n]
        while len(drawn) <= number:
            drawn.append(rng.choice(n, 4, replace=False))
        return drawn[number]


def _consensus(frames, src, dst, max_error, rounds, draws):
    """Which points of each frame pair agree; pairs have the same number of points."""
    import numpy as np

    pairs, n = src.shape[:2]
    best, count = np.zeros((pairs, n), bool), np.zeros(pairs, int)
    needed, open_, tried = np.full(pairs, rounds), np.arange(pairs), 0
    ones = np.ones((pairs, n, 1))
    while len(open_):
        pick = np.stack([draws.of(int(f), n, tried) for f in frames[open_]])
        tried += 1
        each = open_[:, None]
        m, good = solve_homographies(src[each, pick], dst[each, pick])
        p = np.concatenate([src[open_], ones[open_]], axis=2) @ m.transpose(0, 2, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.sqrt(((p[:, :, :2] / p[:, :, 2:] - dst[open_]) ** 2).sum(axis=2))
        near = (off <= max_error) & good[:, None]
        more = near.sum(axis=1) > count[open_]
        at = open_[more]
        best[at], count[at] = near[more], near[more].sum(axis=1)
        share = count[at] / n
        miss = np.log(np.maximum(1 - share**4, 1e-12))
        with np.errstate(divide="ignore"):
            enough = np.ceil(np.minimum(np.log(0.005) / np.where(miss < 0, miss, -1e-300), rounds))
        needed[at] = np.where(share >= 1.0, 0, enough).astype(int)
        open_ = open_[tried < needed[open_]]
    return best, count


def _fit_pairs(frames, starts, src, dst, max_error, rounds, draws):
    """Seeded consensus fit of the frame pairs in sorted rows: (pairs with a fit, their matrices)."""
    import numpy as np

    sizes = np.diff(np.r_[starts, len(src)])
    fitted, found = np.zeros(len(starts), bool), np.zeros((len(starts), 9))
    for n in np.unique(sizes[sizes >= 4]):
        pairs = np.flatnonzero(sizes == n)
        rows = starts[pairs][:, None] + np.arange(n)
        best, count = _consensus(frames[starts[pairs]], src[rows], dst[rows], max_error, rounds, draws)
        for many in np.unique(count[count >= 4]):
            at = np.flatnonzero(count == many)
            chosen = rows[at][best[at]].reshape(len(at), many)
            m, good = solve_homographies(src[chosen], dst[chosen])
            fitted[pairs[at[good]]] = True
            found[pairs[at[good]]] = m[good].reshape(-1, 9)
    kept = np.flatnonzero(fitted)
    return kept, found[kept]


# Points that are fitted together.
FIT_ROWS = 1 << 15


def estimate_transform(
    matches: DataFrame,
    max_error: float = 5.0,
    rounds: int = 2000,
    seed: int = 0,
    keys: list[str] | None = None,
) -> DataFrame:
    """Homography per frame pair from matched points, outliers rejected.

    ``matches(keys, kp, x, y, mx, my)``: a point and its partner. The caller
    bounds a group with :func:`spatial_topk`. Pairs without a fit are left out.
    Pairs with as many points go through the rounds together.
    """
    keys = keys or FRAME

    def fit(table, starts):
        import numpy as np
        import pyarrow as pa

        from trackframe.operators.stacks import first_rows, numbers

        src, dst = (
            np.column_stack([numbers(table, c).astype(float) for c in names])
            for names in (("x", "y"), ("mx", "my"))
        )
        kept, found = _fit_pairs(numbers(table, "frame"), starts, src, dst, max_error, rounds, _Draws(seed))
        return first_rows(
            table, starts[kept], keys, {n: pa.array(found[:, i]) for i, n in enumerate(TRANSFORM_COLUMNS)}
        )

    from trackframe.operators.stacks import whole_groups

    fields = [f"{n} {matches.schema[n].dataType.simpleString()}" for n in keys]
    out = ", ".join([*fields, *[f"{n} double" for n in TRANSFORM_COLUMNS]])
    points = matches.select(*keys, "kp", "x", "y", "mx", "my")
    return whole_groups(points, keys, fit, out, FIT_ROWS, FIT_ROWS, ["kp"])


# Warps ----------------------------------------------------------------------


def _inverse() -> list[Column]:
    """Columns of the inverse matrix up to scale (the adjugate)."""
    t = {n: F.col(n) for n in TRANSFORM_COLUMNS}
    return [
        t["t22"] * t["t33"] - t["t23"] * t["t32"],
        t["t13"] * t["t32"] - t["t12"] * t["t33"],
        t["t12"] * t["t23"] - t["t13"] * t["t22"],
        t["t23"] * t["t31"] - t["t21"] * t["t33"],
        t["t11"] * t["t33"] - t["t13"] * t["t31"],
        t["t13"] * t["t21"] - t["t11"] * t["t23"],
        t["t21"] * t["t32"] - t["t22"] * t["t31"],
        t["t12"] * t["t31"] - t["t11"] * t["t32"],
        t["t11"] * t["t22"] - t["t12"] * t["t21"],
    ]


def _targets(transforms: DataFrame, width: int, height: int) -> DataFrame:
    """Every output pixel with ``corners``: its source pixels in the image and their weights (of 1024).

    Image rows are dealt to all partitions before they are widened, by a fixed number:
    they are few bytes, and merged at run time they would be widened in one task.
    """
    keys = ["video", "frame", "hist_frame"]
    solved = transforms.select(
        *keys, *[c.alias(f"i{n}") for n, c in enumerate(_inverse())]
    )
    rows = solved.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    grid = spread(rows, *keys, "y").withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )
    x, y = F.col("x"), F.col("y")
    w = F.col("i6") * x + F.col("i7") * y + F.col("i8")

    def position(a: str, b: str, c: str) -> Column:
        top = (F.col(a) * x + F.col(b) * y + F.col(c)) * SUBPIXEL
        return F.when(w != 0, F.bround(top / w)).otherwise(F.lit(0.0)).cast("long")

    at = grid.withColumns({"u": position("i0", "i1", "i2"), "w": position("i3", "i4", "i5")})
    fu, fw = F.pmod(F.col("u"), F.lit(SUBPIXEL)), F.pmod(F.col("w"), F.lit(SUBPIXEL))
    corners = F.array(
        *[
            F.struct(
                (F.floor(F.col("w") / SUBPIXEL) + dy).alias("sy"),
                (F.floor(F.col("u") / SUBPIXEL) + dx).alias("sx"),
                (
                    (fu if dx else SUBPIXEL - fu) * (fw if dy else SUBPIXEL - fw)
                ).alias("part"),
            )
            for dy in (0, 1)
            for dx in (0, 1)
        ]
    )
    inside = F.filter(
        corners,
        lambda c: (c["part"] > 0)
        & c["sx"].between(0, width - 1)
        & c["sy"].between(0, height - 1),
    )
    return at.select(*keys, "y", "x", inside.alias("corners"))


def _level(parts: Column) -> Column:
    full = SUBPIXEL * SUBPIXEL
    return F.floor((parts + full // 2) / full).cast("int")


def warp_history(
    pixels: DataFrame, transforms: DataFrame, width: int, height: int
) -> DataFrame:
    """History frames in the coordinates of their frame, bilinear, 0 outside.

    ``transforms(video, frame, hist_frame, t11..t33)`` map history coordinates to
    those of the frame; ``pixels`` are dense. Output: video, frame, hist_frame,
    y, x, v, covered for all pixels; covered is the warp of an all-ones frame.
    """
    source = pixels.select(
        "video",
        F.col("frame").alias("hist_frame"),
        F.col("y").cast("long").alias("sy"),
        F.col("x").cast("long").alias("sx"),
        "v",
    )
    # a pixel without a source has one row all the same
    parts = _targets(transforms, width, height).select(*WARPED, F.inline_outer("corners"))
    drawn = parts.join(source, ["video", "hist_frame", "sy", "sx"], "left")
    seen = F.when(F.col("v").isNotNull(), F.col("part")).otherwise(0)
    return drawn.groupBy(*WARPED).agg(
        _level(F.sum(F.coalesce(F.col("v"), F.lit(0)) * seen)).alias("v"),
        _level(F.sum(seen)).alias("covered"),
    )


def coverage_masks(transforms: DataFrame, width: int, height: int) -> DataFrame:
    """The warp of an all-ones frame: 1 where history covers the frame, else 0.

    Each pixel adds its own corners; nothing is grouped.
    """
    covered = F.aggregate("corners", F.lit(0).cast("long"), lambda s, c: s + c["part"])
    return _targets(transforms, width, height).select(*WARPED, _level(covered).alias("v"))
