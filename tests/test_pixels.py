import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import mask_table, picture, pixel_table, rows_of
from trackframe.functions.scalars import level3
from trackframe.operators import bitindex
from trackframe.operators import components as C
from trackframe.operators import morphology as MO
from trackframe.operators import pixels as PX
from trackframe.operators import registration as RG
from trackframe.sources import frames as FR


def image_of(df, column="v"):
    rows = df.collect()
    out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), dtype=int)
    for r in rows:
        out[r["y"], r["x"]] = r[column]
    return out


def noise(seed, height=9, width=11):
    return np.random.default_rng(seed).integers(0, 256, (height, width))


def test_level_bands(spark):
    df = spark.range(256).select(
        F.col("id"), level3(F.col("id")).alias("code"), level3(F.col("id"), True).alias("fixed")
    )
    for r in df.collect():
        band = 0 if r["id"] <= 85 else 1 if r["id"] < 170 else 2
        assert r["code"] == (3, 2, 5)[band] and r["fixed"] == (1, 2, 3)[band]


@pytest.mark.parametrize("n", [2, 3])
@pytest.mark.parametrize("corrected", [False, True])
def test_pixel_hysteresis_on_one_pixel(spark, n, corrected):
    motion = [1, 1, 1, 0, 0, 1, 0, 0, 0]
    df = pixel_table(spark, {f + 1: [[255 * m]] for f, m in enumerate(motion)})
    on = off = value = 0
    want = []
    for m in motion:
        on, off = (on + 1, 0) if m else (0, off + 1)
        value = 255 if on == n else 0 if off == (2 if corrected else n) else value
        want.append(value)
    got = PX.pixel_hysteresis(df, n, 2, corrected)
    assert [r["v"] for r in got.orderBy("frame").collect()] == want


@pytest.mark.parametrize("k", [3, 4, 5])
def test_box_blur_against_loops(spark, k):
    image = noise(k)
    padded = np.pad(image, k // 2, mode="reflect")
    want = np.zeros_like(image)
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            total = padded[y : y + k, x : x + k].sum()
            want[y, x] = np.round(total / (k * k))
    got = MO.box_blur(pixel_table(spark, {1: image}), k, 11, 9)
    assert (image_of(got) == want).all()


RING = [
    "............",
    ".#####...##.",
    ".#...#...##.",
    ".#...#......",
    ".#####......",
    "......#.....",
    ".......#....",
    "............",
    "#.......#..#",
    "#...#......#",
]


def flood(lines):
    """Pixel sets of the 8-connected components."""
    left = {(y, x) for y, line in enumerate(lines) for x, c in enumerate(line) if c == "#"}
    parts = []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            y, x = stack.pop()
            part.add((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (y + dy, x + dx) in left:
                        left.remove((y + dy, x + dx))
                        stack.append((y + dy, x + dx))
        parts.append(frozenset(part))
    return set(parts)


@pytest.mark.parametrize("band_rows", [C.BAND_ROWS, 1, 3])
def test_components_against_flood(spark, band_rows):
    rng = random.Random(4)
    noisy = ["".join(rng.choice("#..") for _ in range(12)) for _ in range(10)]
    both = mask_table(spark, RING, 1).unionByName(mask_table(spark, noisy, 40))
    labelled = C.connected_components(both, band_rows).collect()
    for frame, lines in ((1, RING), (40, noisy)):
        parts = {}
        for r in labelled:
            if r["frame"] == frame:
                parts.setdefault((r["ly"], r["lx"]), set()).add((r["y"], r["x"]))
        assert {frozenset(p) for p in parts.values()} == flood(lines)
        assert all(key == min(part) for key, part in parts.items())


def test_blobs_and_holes(spark):
    found = rows_of(C.detect_blobs(mask_table(spark, RING), 10), "x1", "y1", "x2", "y2", "hole")
    assert (1, 1, 8, 7, False) in found  # ring and its diagonal tail
    assert (1, 1, 6, 5, True) in found  # the hole, one pixel larger on each side
    assert (9, 1, 11, 3, False) in found
    assert (0, 8, 1, 10, False) in found and (11, 8, 12, 10, False) in found
    assert len(found) == 7
    centers = rows_of(C.component_centroids(mask_table(spark, RING)), "pixels", "cx", "cy")
    assert (4, 9, 1) in centers


def test_group_filter_and_close(spark):
    lines = ["#....", "..##.", "..##.", "....."]
    mask = mask_table(spark, lines)
    assert picture(MO.group_filter(mask, 3), 5, 4) == [".....", "..##.", "..##.", "....."]
    gap = mask_table(spark, ["##.##", "##.##"])
    assert picture(MO.close_mask(gap, 3, 5, 2), 5, 2) == ["#####", "#####"]


def test_ellipse_shapes():
    def drawn(k):
        cells = set(MO.ellipse_offsets(k))
        r = k // 2
        return ["".join("#" if (y - r, x - r) in cells else "." for x in range(k)) for y in range(k)]

    assert drawn(3) == [".#.", "###", ".#."]
    assert drawn(5) == ["..#..", "#####", "#####", "#####", "..#.."]
    assert drawn(1) == ["#"]


@pytest.mark.parametrize("eps, least", [(1.0, 3), (1.5, 4), (2.0, 5), (0.5, 1)])
def test_density_filter_against_pairs(spark, eps, least):
    rng = random.Random(8)
    lines = ["".join(rng.choice("#...") for _ in range(20)) for _ in range(15)]
    on = [(y, x) for y, line in enumerate(lines) for x, c in enumerate(line) if c == "#"]
    near = {p: [q for q in on if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in on}
    cores = {p for p in on if len(near[p]) >= least}
    want = sorted(p for p in on if any(q in cores for q in near[p]))
    assert rows_of(MO.density_filter(mask_table(spark, lines), eps, least), "y", "x") == want


def test_density_border_at_exact_distance(spark):
    # four in a row are exactly min_samples around the second; the last is at eps
    mask = mask_table(spark, ["####..#..#"])
    kept = [x for (x,) in rows_of(MO.density_filter(mask, 3, 5), "x")]
    assert kept == [0, 1, 2, 3, 6]  # 3 sees 0..3 and 6; 9 sees only 6 and itself


def plain_features(images, history, scale):
    frames = sorted(images)
    out = {}
    for i, f in enumerate(frames):
        if i < history:
            continue
        past = [images[g] for g in frames[i - history : i]]
        q = [np.floor(p * scale / 255.0).astype(int) for p in past]
        weight = np.zeros_like(past[0])
        moved = np.zeros_like(past[0])
        union = np.zeros_like(past[0])
        for j in range(1, history):
            same = np.abs(q[j] - q[j - 1]) <= 1
            weight += same
            moved += np.where(same, 0, np.abs(past[j] - past[j - 1]))
            inter = np.where(same, 0, past[j - 1])
            union = np.where(inter != 0, inter, union)
        out[f] = (weight, moved // history, union)
    return out


def test_history_features_in_both_forms(spark):
    images = {f: noise(f, 3, 4) // (1 + f % 3) for f in range(1, 9)}
    pixels = pixel_table(spark, images)
    rolled = PX.rolling_history(pixels, 3, 20).collect()
    want = plain_features(images, 3, 20)
    assert {r["frame"] for r in rolled} == set(want)
    for r in rolled:
        got = (r["weight"], r["dissimilarity"], r["background"])
        assert got == tuple(int(a[r["y"], r["x"]]) for a in want[r["frame"]])
    names = [*PX.PIXEL, "weight", "dissimilarity", "background"]
    anchored = pixels.withColumn("hist_frame", F.col("frame")).withColumn(
        "frame", F.explode(F.sequence(F.col("frame") + 1, F.col("frame") + 3))
    )
    both = PX.anchored_history(anchored, 3, 20).filter(F.col("frame") <= 8)
    assert rows_of(both, *names) == sorted(tuple(r[n] for n in names) for r in rolled)


def warp_loops(image, matrix):
    """Inverse map, positions in 1/32 pixel, bilinear, 0 outside."""
    back = np.linalg.inv(matrix)
    h, w = image.shape
    out = np.zeros_like(image)
    for y in range(h):
        for x in range(w):
            px, py, pw = back @ (x, y, 1)
            u, v = int(np.round(32 * px / pw)), int(np.round(32 * py / pw))
            sx, sy, a, b = u // 32, v // 32, u % 32, v % 32
            total = 0
            for dy, fy in ((0, 32 - b), (1, b)):
                for dx, fx in ((0, 32 - a), (1, a)):
                    if 0 <= sy + dy < h and 0 <= sx + dx < w:
                        total += int(image[sy + dy, sx + dx]) * fx * fy
            out[y, x] = (total + 512) // 1024
    return out


MATRICES = {
    "shift": [[1, 0, 2], [0, 1, -1], [0, 0, 1]],
    "half": [[1, 0, 0.5], [0, 1, 0.25], [0, 0, 1]],
    "turn": [[0.96, -0.28, 2.1], [0.28, 0.96, -1.3], [0, 0, 1]],
    "perspective": [[1.05, 0.02, -0.7], [0.01, 0.97, 0.4], [0.004, 0.002, 1]],
}


@pytest.mark.parametrize("name", MATRICES)
def test_warp_against_loops(spark, name):
    matrix = np.array(MATRICES[name], dtype=float)
    image = noise(2)
    ddl = "video string, frame int, hist_frame int, " + ", ".join(
        f"{n} double" for n in RG.TRANSFORM_COLUMNS
    )
    table = spark.createDataFrame([("v", 2, 1, *[float(v) for v in matrix.ravel()])], ddl)
    warped = RG.warp_history(pixel_table(spark, {1: image}), table, 11, 9)
    assert (image_of(warped) == warp_loops(image, matrix)).all()
    ones = warp_loops(np.ones_like(image), matrix)
    assert (image_of(warped, "covered") == ones).all()
    assert (image_of(RG.coverage_masks(table, 11, 9)) == ones).all()


@pytest.mark.parametrize("name", MATRICES)
def test_homography_survives_outliers(spark, name):
    matrix = np.array(MATRICES[name], dtype=float)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        x, y = rng.uniform(0, 200, 2)
        px, py, pw = matrix @ (x, y, 1)
        bad = 40.0 + i if i % 4 == 0 else 0.0
        rows.append(("v", 5, i, float(x), float(y), float(px / pw + bad), float(py / pw - bad)))
    ddl = "video string, frame int, kp int, x double, y double, mx double, my double"
    found = RG.estimate_transform(spark.createDataFrame(rows, ddl), 1.0).first()
    got = np.array([found[n] for n in RG.TRANSFORM_COLUMNS]).reshape(3, 3)
    assert np.allclose(got, matrix, atol=1e-6)
    too_few = spark.createDataFrame(rows[:3], ddl)
    assert RG.estimate_transform(too_few).count() == 0


def test_descriptors_near_and_far(spark):
    rng = random.Random(7)
    a = [("v", 1, i, rng.getrandbits(63), rng.getrandbits(63)) for i in range(30)]
    b = [("v", 1, i, rng.getrandbits(63), rng.getrandbits(63)) for i in range(25)]
    for i in range(10):  # near copies: a few bits flipped
        b.append(("v", 1, 100 + i, a[i][3] ^ (1 << i), a[i][4] ^ (3 << i)))
    ddl = "video string, frame int, kp int, w0 bigint, w1 bigint"
    got = RG.match_descriptors(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), ["w0", "w1"])
    bits = lambda p, q: (p[3] ^ q[3]).bit_count() + (p[4] ^ q[4]).bit_count()
    want = [(p[2], *min((bits(p, q), q[2]) for q in b)[::-1]) for p in a]
    assert rows_of(got, "kp", "match", "dist") == sorted(want)


def test_ten_thousand_descriptors_a_frame(spark):
    n, rng = 10_000, np.random.default_rng(1)
    bits = rng.integers(-(2**63), 2**63, (n, 4), dtype=np.int64)
    moved = bits.copy()
    for row in moved:  # forty of 256 bits flipped
        for at in rng.choice(256, 40, replace=False):
            row[at // 64] ^= np.int64(np.uint64(1 << int(at % 64)).view(np.int64))
    ddl = "video string, frame int, kp int, w0 bigint, w1 bigint, w2 bigint, w3 bigint"

    def table(rows):
        return spark.createDataFrame([("v", 1, i, *map(int, r)) for i, r in enumerate(rows)], ddl)

    got = RG.match_descriptors(table(moved), table(bits), ["w0", "w1", "w2", "w3"])
    assert got.filter("kp = match and dist = 40").count() == n


def whole_block(mine, other):
    """Nearest places and distances by comparing everything, 500 at a time."""
    place, dist = [], []
    for at in range(0, mine.shape[1], 500):
        far = sum(np.bitwise_count(x[at : at + 500, None] ^ y).astype(int) for x, y in zip(mine, other))
        place.append(far.argmin(axis=1))
        dist.append(far.min(axis=1))
    return np.concatenate(place), np.concatenate(dist)


def flipped(rng, words, bits):
    moved = words.copy()
    for i in range(words.shape[1]):
        for at in rng.choice(64 * len(words), rng.integers(0, bits + 1), replace=False):
            moved[at // 64, i] ^= np.uint64(1 << int(at % 64))
    return moved


def test_bit_index_computes_far_fewer_distances():
    n, rng = 10_000, np.random.default_rng(5)
    other = rng.integers(0, 2**64, (4, n), dtype=np.uint64)
    mine = flipped(rng, other, 40)
    place, dist, looked = bitindex.nearest(mine, other)
    want_place, want_dist = whole_block(mine, other)
    assert (place == want_place).all() and (dist == want_dist).all()
    assert looked < n * n / 50


@pytest.mark.parametrize("kind", ["far", "few bits", "equal", "hot", "two words", "small"])
def test_bit_index_proves_the_nearest(kind):
    rng = np.random.default_rng(6)
    n = 100 if kind == "small" else 1500
    other = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
    mine = flipped(rng, other, 20)[:, rng.permutation(n)[:700]]
    if kind == "far":
        mine = rng.integers(0, 2**64, (2, 700), dtype=np.uint64)
    if kind == "few bits":  # many ties
        mine, other = mine & np.uint64(0x1F3), other & np.uint64(0x1F3)
    if kind == "equal":
        mine, other = np.zeros_like(mine), np.zeros_like(other)
    if kind == "hot":  # two thirds of a block are one string
        other[:, :1000] = other[:, :1]
        mine[:, :300] = flipped(rng, other[:, :300], 3)
    if kind == "two words":  # the low half of each word only
        mine, other = mine & np.uint64(2**32 - 1), other & np.uint64(2**32 - 1)
    place, dist, looked = bitindex.nearest(mine, other)
    want_place, want_dist = whole_block(mine, other)
    assert (place == want_place).all() and (dist == want_dist).all()
    assert looked <= 1.3 * mine.shape[1] * n


def test_descriptors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(RG, "DESCRIPTOR_BLOCK", 700)
    monkeypatch.setattr(RG, "DESCRIPTOR_ASKS", 400)
    rng = np.random.default_rng(8)
    other = rng.integers(0, 2**64, (2, 1500), dtype=np.uint64)
    mine = flipped(rng, other, 30)
    ddl = "video string, frame int, kp int, w0 bigint, w1 bigint"
    table = lambda words: spark.createDataFrame(
        [("v", 1, i, *map(int, w)) for i, w in enumerate(words.T.astype(np.int64))], ddl
    )
    place, dist = whole_block(mine, other)
    got = RG.match_descriptors(table(mine), table(other), ["w0", "w1"])
    assert rows_of(got, "kp", "match", "dist") == [
        (i, p, d) for i, (p, d) in enumerate(zip(place.tolist(), dist.tolist()))
    ]


def test_frames_go_to_bytes_and_back(spark):
    images = {1: noise(1), 2: noise(2)}
    pixels = pixel_table(spark, images)
    frames = FR.assemble_frames(pixels)
    row = frames.filter("frame = 2").first()
    assert (row["height"], row["width"], bytes(row["data"])) == (9, 11, images[2].astype("uint8").tobytes())
    names = [*PX.PIXEL, "v"]
    assert rows_of(FR.explode_pixels(frames), *names) == rows_of(pixels, *names)


@pytest.mark.parametrize("corrected", [False, True])
def test_principal_channels(spark, corrected):
    rng = np.random.default_rng(3)
    colour = {f: rng.integers(0, 256, (6, 5, 3)) for f in (1, 2)}
    rows = [
        ("v", f, y, x, *(int(c) for c in colour[f][y, x]))
        for f in colour for y in range(6) for x in range(5)
    ]
    df = spark.createDataFrame(rows, "video string, frame int, y int, x int, b int, g int, r int")
    got = {(r["frame"], r["y"], r["x"]): r for r in PX.pca_channels(df, corrected).collect()}
    first = colour[1].reshape(-1, 3).astype(float)
    values, vectors = np.linalg.eigh(np.cov(first.T, bias=True))
    axes = vectors[:, ::-1].T
    axes = axes * np.sign(axes[range(3), np.abs(axes).argmax(axis=1)])[:, None]
    for f in colour:
        parts = (colour[f].reshape(-1, 3) - first.mean(axis=0)) @ axes.T
        level = np.round(parts / parts.max(axis=0) * 255).astype(int)
        level = np.maximum(level, 0) if corrected else level % 256
        for i in range(30):
            row = got[(f, i // 5, i % 5)]
            assert [row[f"c{j}"] for j in range(3)] == level[i].tolist()


def test_targets_are_dealt_before_they_are_widened(spark):
    ddl = "video string, frame int, hist_frame int, " + ", ".join(f"{n} double" for n in RG.TRANSFORM_COLUMNS)
    rows = [("v", f, f - 1, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for f in range(2, 60)]
    table = spark.createDataFrame(rows, ddl).coalesce(1)
    drawn = RG.coverage_masks(table, 8, 8)
    # a few bytes a row would be merged into one task at run time
    tasks = drawn.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
    assert rows_of(drawn.select("x", "v").distinct(), "x", "v") == [
        (x, int(x > 0)) for x in range(8)
    ]
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_many_pairs_are_fitted_as_each_alone():
    rng = np.random.default_rng(4)
    sizes = rng.integers(3, 12, 40)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    src = rng.integers(0, 200, (sizes.sum(), 2)).astype(float)
    dst = src + 3.0
    dst[rng.random(len(dst)) < 0.2] += 40.0
    frames = np.repeat(np.arange(40), sizes)
    kept, found = RG._fit_pairs(frames, starts, src, dst, 2.0, 200, RG._Draws(0))
    assert len(kept) > 20
    alone = {}
    for i, (first, n) in enumerate(zip(starts, sizes)):
        span = slice(first, first + n)
        one = RG._fit_pairs(frames[span], np.array([0]), src[span], dst[span], 2.0, 200, RG._Draws(0))
        if len(one[0]):
            alone[i] = one[1][0]
    assert sorted(alone) == kept.tolist()
    for i, m in zip(kept, found):
        assert np.allclose(m, alone[i], atol=1e-6)
