"""Particle filters over boxes: single steps as DataFrames, whole tracks as a fold."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.operators import matching as M
from trackframe.operators.fold import fold_frames
from trackframe.operators.reckoning import corners_of, pairwise_iou
from trackframe.operators.tracks import observation_hysteresis, with_transform
from trackframe.schema import BOX_COLUMNS, TRANSFORM_COLUMNS
from trackframe.session import cut

# Fixed value: particles per filter.
PARTICLES = 5

FILTER = ["video", "frame", "filter"]
PARTICLE = [*FILTER, "particle"]


# Single steps on particles(video, frame, filter, particle, x1..y2, weight) ---


def particle_predict(particles: DataFrame, seed: int = 0) -> DataFrame:
    """Move every particle by its seeded noise and mark it unobserved."""
    moved = G.jitter_box(G.corners(), seed, *[F.col(n) for n in PARTICLE])
    return particles.withColumns(dict(zip(BOX_COLUMNS, moved))).withColumn(
        "observed", F.lit(False)
    )


def particle_transform(particles: DataFrame, transforms: DataFrame) -> DataFrame:
    moved = G.transform_box(G.corners())
    joined = with_transform(particles, transforms)
    return joined.withColumns(dict(zip(BOX_COLUMNS, moved))).drop(*TRANSFORM_COLUMNS)


def particle_overlaps(particles: DataFrame, detections: DataFrame) -> DataFrame:
    """(particle, detection) pairs that overlap, with their IoU."""
    pairs = M.overlap_join(
        particles.select(*PARTICLE, *BOX_COLUMNS), detections.select("video", "frame", "ord", *BOX_COLUMNS)
    )
    return pairs.select(
        "video",
        "frame",
        F.col("a_filter").alias("filter"),
        F.col("a_particle").alias("particle"),
        F.col("b_ord").alias("ord"),
        "iou",
        *[F.col(f"b_{n}").alias(f"d_{n}") for n in BOX_COLUMNS],
    )


def particle_update(particles: DataFrame, detections: DataFrame) -> DataFrame:
    """Move each particle to its best detection and weigh it by their IoU.

    Without any overlap the particle stays as it is. Ties go to the first box.
    """
    best = (
        particle_overlaps(particles, detections)
        .groupBy(*PARTICLE)
        .agg(
            F.min(
                F.struct((-F.col("iou")).alias("n"), "ord", *[f"d_{n}" for n in BOX_COLUMNS])
            ).alias("m")
        )
    )
    hit = F.col("m").isNotNull()
    moved = {n: F.when(hit, F.col(f"m.d_{n}")).otherwise(F.col(n)) for n in BOX_COLUMNS}
    weight = F.when(hit, F.col("weight") * -F.col("m.n")).otherwise(F.col("weight"))
    return (
        particles.join(best, PARTICLE, "left")
        .withColumns({**moved, "weight": weight, "observed": hit})
        .drop("m")
    )


def particle_resample(particles: DataFrame, n: int = PARTICLES) -> DataFrame:
    """Heaviest particle first, round(share * n) copies each, n in all.

    It stops at the first particle that gets no copy. Copies keep ``parent``,
    the particle they come from. A group is the particles of one filter.
    """
    heavy = Window.partitionBy(*FILTER).orderBy(F.col("weight").desc(), "particle")
    whole = Window.partitionBy(*FILTER)
    before = heavy.rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("weight") / F.sum("weight").over(whole)
    asked = (
        particles.withColumn("asked", F.bround(share / F.lit(1.0 / n)).cast("int"))
        .withColumn("ahead", F.coalesce(F.sum("asked").over(before), F.lit(0)))
        .withColumn("copies", F.greatest(F.least(F.col("asked"), n - F.col("ahead")), F.lit(0)))
        .withColumn("stopped", F.coalesce(F.max((F.col("copies") == 0).cast("int")).over(before), F.lit(0)))
        .filter((F.col("copies") > 0) & (F.col("stopped") == 0))
        .withColumn("at", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    )
    return asked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(
        *FILTER,
        (F.col("at") + F.col("copy")).alias("particle"),
        F.col("particle").alias("parent"),
        *BOX_COLUMNS,
        F.lit(1.0 / n).alias("weight"),
    )


def particle_weights(particles: DataFrame, lineage: str = "parent", corrected: bool = False) -> DataFrame:
    """Weight per region of a filter, and whether it is the filter's best.

    Regions are told apart by lineage, as published; ``corrected`` merges equal
    boxes. Ties go to the region listed first.
    """
    by = BOX_COLUMNS if corrected else [lineage, *BOX_COLUMNS]
    regions = particles.groupBy(*FILTER, *by).agg(
        F.sum("weight").alias("weight"), F.min("particle").alias("first")
    )
    best = regions.groupBy(*FILTER).agg(
        F.min_by("first", F.struct(-F.col("weight"), "first")).alias("best")
    )
    return regions.join(best, FILTER).withColumn("is_best", F.col("first") == F.col("best")).drop("best")


def filter_probability(
    particles: DataFrame, detections: DataFrame, n: int = PARTICLES
) -> DataFrame:
    """Per filter and overlapping detection, the sum of IoU over particles / n."""
    return (
        particle_overlaps(particles, detections)
        .groupBy(*FILTER, "ord")
        .agg(F.sum(F.col("iou") * F.lit(1.0 / n)).alias("probability"))
    )


def claimed(particles: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections that some filter accounts for."""
    return M.region_semi(detections, particles)


def unclaimed(particles: DataFrame, detections: DataFrame) -> DataFrame:
    return M.region_anti(detections, particles)


# Whole tracks -----------------------------------------------------------------


# Boxes compared at once, so that memory stays small on crowded frames.
COMPARE_CELLS = 2_000_000


@dataclass
class Filters:
    """State of a video: all live particles, filter by filter, and the next identity."""

    salt: int = 0
    counter: int = 0
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    boxes: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    observed: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    steps: dict[int, int] = field(default_factory=dict)

    def starts(self) -> np.ndarray:
        """Position of the first particle of each filter."""
        if len(self.ids) == 0:
            return np.zeros(0, dtype=int)
        return np.flatnonzero(np.r_[True, self.ids[1:] != self.ids[:-1]])

    def ranks(self) -> np.ndarray:
        """Position of each particle within its filter."""
        starts = self.starts()
        sizes = np.diff(np.r_[starts, len(self.ids)])
        return np.arange(len(self.ids)) - np.repeat(starts, sizes)

    def keep(self, chosen: np.ndarray) -> None:
        self.ids, self.boxes = self.ids[chosen], self.boxes[chosen]
        self.weights, self.observed = self.weights[chosen], self.observed[chosen]


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix) of an unsigned array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniforms(salt: int, ids: np.ndarray, ranks: np.ndarray, frame: int, draws: int) -> np.ndarray:
    """particles x draws numbers in (0, 1), fixed by (salt, filter, frame, particle)."""
    base = np.full(len(ids), salt & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    base = _mix(base ^ ids.astype(np.uint64))
    base = _mix(base ^ np.uint64(frame))
    grid = ranks.astype(np.uint64)[:, None] * np.uint64(draws) + np.arange(draws, dtype=np.uint64)
    bits = _mix(grid ^ base[:, None]) >> np.uint64(12)
    return (bits.astype(float) + 0.5) / float(1 << 52)


def _predict(state: Filters, frame: int) -> None:
    u = _uniforms(state.salt, state.ids, state.ranks(), frame, 7)
    size = (state.boxes[:, 2:] - state.boxes[:, :2]).astype(float)
    length = np.sqrt((size**2).sum(axis=1))
    gauss = np.sqrt(-2 * np.log(u[:, 0])) * np.cos(2 * np.pi * u[:, 1])
    step, angle = np.abs(gauss) * 0.01 * length, u[:, 2] * 2 * np.pi
    shift = np.round(np.stack([step * np.sin(angle), step * np.cos(angle)], axis=1))
    noise = np.round(u[:, 3:] - 0.5)
    noise[:, 2:] = np.maximum(noise[:, :2], noise[:, 2:])
    state.boxes = state.boxes + (np.hstack([shift, shift]) + noise).astype(np.int64)
    state.observed = np.zeros(len(state.ids), dtype=bool)


def _transform(state: Filters, matrix: np.ndarray) -> None:
    corners = state.boxes.reshape(-1, 2).astype(float)
    moved = corners @ matrix[:2, :2].T + matrix[:2, 2]
    state.boxes = np.round(moved).astype(np.int64).reshape(-1, 4)


def _overlaps(boxes: np.ndarray, found: np.ndarray):
    """IoU matrix in row blocks of bounded size, with the first row of each block."""
    rows = max(COMPARE_CELLS // max(len(found), 1), 1)
    for first in range(0, len(boxes), rows):
        yield first, pairwise_iou(boxes[first : first + rows], found)


def _update(state: Filters, found: np.ndarray) -> None:
    best = np.zeros(len(state.ids), dtype=int)
    share = np.zeros(len(state.ids))
    for first, overlap in _overlaps(state.boxes, found):
        span = slice(first, first + len(overlap))
        best[span] = overlap.argmax(axis=1)
        share[span] = overlap.max(axis=1)
    hit = share > 0
    state.boxes = np.where(hit[:, None], found[best], state.boxes)
    state.weights = np.where(hit, state.weights * share, state.weights)
    state.observed = state.observed | hit


def _resample(state: Filters, n: int) -> None:
    """Copies per particle, heaviest first within each filter, at most n in all."""
    state.keep(np.lexsort((state.ranks(), -state.weights, state.ids)))
    starts = state.starts()
    sizes = np.diff(np.r_[starts, len(state.ids)])
    total = np.repeat(np.add.reduceat(state.weights, starts), sizes)
    asked = np.round((state.weights / total) / (1.0 / n)).astype(int)
    before = np.cumsum(asked) - asked
    ahead = before - np.repeat(before[starts], sizes)
    # Heaviest first, so once a particle gets no copy no later one does.
    copies = np.clip(np.minimum(asked, n - ahead), 0, None)
    state.keep(np.repeat(np.arange(len(state.ids)), copies))
    state.weights = np.full(len(state.ids), 1.0 / n)


def _best(state: Filters, corrected: bool) -> np.ndarray:
    """One particle per filter, of its heaviest region, the first among equals.

    After resampling, copies of the heaviest particle come first. ``corrected``
    merges equal boxes of a filter before comparing.
    """
    starts = state.starts()
    if not corrected or len(starts) == 0:
        return starts
    tagged = np.hstack([state.ids[:, None], state.boxes])
    _, first, group = np.unique(tagged, axis=0, return_index=True, return_inverse=True)
    weight = np.bincount(group.reshape(-1), weights=state.weights)
    order = np.lexsort((first, -weight, state.ids[first]))
    owner = state.ids[first][order]
    return first[order][np.r_[True, owner[1:] != owner[:-1]]]


def _history(state: Filters, frame: int, name: str, only: np.ndarray | None = None) -> list[tuple]:
    chosen = slice(None) if only is None else only
    columns = (state.ids, state.ranks(), state.boxes, state.observed, state.weights)
    rows = [
        (frame, owner, state.steps.get(owner, 0), name, rank, *box, seen, weight)
        for owner, rank, box, seen, weight in zip(*(v[chosen].tolist() for v in columns), strict=True)
    ]
    for owner in {r[1] for r in rows}:
        state.steps[owner] = state.steps.get(owner, 0) + 1
    return rows


def filter_frame(
    state: Filters,
    frame: int,
    found: np.ndarray,
    matrix: np.ndarray,
    n: int = PARTICLES,
    persist: bool = False,
    corrected: bool = False,
    with_history: bool = False,
) -> tuple[list[tuple], list[tuple]]:
    """Advance all filters by one frame.

    Gives track rows (frame, identity, x1..y2, observed) and, when asked for,
    history rows (frame, identity, step_idx, step_name, particle, x1..y2,
    observed, weight).
    """
    history: list[tuple] = []

    def note(name: str, only: np.ndarray | None = None) -> None:
        if with_history:
            history.extend(_history(state, frame, name, only))

    claimed_by_any = np.zeros(len(found), dtype=bool)
    if len(state.ids):
        _predict(state, frame)
        note("predict")
        _transform(state, matrix)
        note("transform")
        _update(state, found)
        note("update")
        _resample(state, n)
        note("resample")
        touching = np.zeros(len(state.ids), dtype=bool)
        for first, overlap in _overlaps(state.boxes, found):
            touching[first : first + len(overlap)] = (overlap > 0).any(axis=1)
            claimed_by_any |= (overlap > 0).any(axis=0)
        if not persist:
            alive = np.unique(state.ids[touching])
            state.keep(np.isin(state.ids, alive))
            live = {int(i) for i in alive}
            state.steps = {k: v for k, v in state.steps.items() if k in live}
    fresh = found[~claimed_by_any]
    if len(fresh):
        new_ids = np.arange(state.counter, state.counter + len(fresh))
        state.counter += len(fresh)
        state.ids = np.r_[state.ids, np.repeat(new_ids, n)]
        state.boxes = np.vstack([state.boxes, np.repeat(fresh, n, axis=0)])
        state.weights = np.r_[state.weights, np.full(len(fresh) * n, 1.0 / n)]
        state.observed = np.r_[state.observed, np.ones(len(fresh) * n, dtype=bool)]
        note("initial", np.isin(state.ids, new_ids))
    best = _best(state, corrected)
    columns = (state.ids[best], state.boxes[best], state.observed[best])
    rows = [
        (frame, owner, *box, seen)
        for owner, box, seen in zip(*(values.tolist() for values in columns))
    ]
    return rows, history


def salt_of(seed: int, key: tuple) -> int:
    text = "|".join(str(part) for part in key).encode()
    return (seed << 32) ^ zlib.crc32(text)


def matrix_of(rows) -> np.ndarray:
    return np.array([np.asarray(rows[n])[0] for n in TRANSFORM_COLUMNS], dtype=float).reshape(3, 3)


TRACK_OUTPUT = "frame bigint, identity bigint, x1 int, y1 int, x2 int, y2 int, observed boolean"
HISTORY_OUTPUT = (
    "frame bigint, filter_identity bigint, step_idx int, step_name string, particle int, "
    "x1 int, y1 int, x2 int, y2 int, observed boolean, weight double"
)


def _filtered(
    regions: DataFrame,
    transforms: DataFrame,
    n: int,
    persist: bool,
    seed: int,
    corrected: bool,
    keys: list[str],
    want_history: bool,
    want_tracks: bool = False,
) -> DataFrame:
    """Tracks, history, or both in one pass; then a row has the columns of one kind."""
    columns = regions.select(*dict.fromkeys(["video", *keys, "frame", "ord", *BOX_COLUMNS]))
    ready = with_transform(columns, transforms)

    def step(state, key, frame, rows):
        tracks, history = filter_frame(
            state, frame, corners_of(rows), matrix_of(rows), n, persist, corrected, want_history
        )
        if both:
            return [(*key, *r, *no_history) for r in tracks] + [
                (*key, *no_tracks, *r) for r in history
            ]
        return [(*key, *r) for r in (history if want_history else tracks)]

    both = want_history and want_tracks
    no_tracks = (None,) * len(TRACK_OUTPUT.split(","))
    no_history = (None,) * len(HISTORY_OUTPUT.split(","))
    fields = [f"{k} {ready.schema[k].dataType.simpleString()}" for k in keys]
    output = HISTORY_OUTPUT if want_history else TRACK_OUTPUT
    if both:
        output = f"{_prefixed(TRACK_OUTPUT, 't_')}, {_prefixed(HISTORY_OUTPUT, 'h_')}"
    schema = ", ".join([*fields, output])
    return fold_frames(ready, keys, lambda key: Filters(salt_of(seed, key)), step, schema)


def particle_filter(
    regions: DataFrame,
    transforms: DataFrame,
    n: int = PARTICLES,
    persist: bool = False,
    seed: int = 0,
    corrected: bool = False,
    keys: list[str] | None = None,
) -> DataFrame:
    """Track boxes through frames that have both boxes and a matrix.

    Every filter predicts, is transformed, updated and resampled. Filters that
    overlap no box end unless ``persist``; each unclaimed box starts a new one.
    One row per live filter and frame. Noise is a hash of (seed, key, filter,
    frame, particle), so a lost task repeats the same tracks. Frames of a key
    run in order in one task that holds one frame and the live filters.
    """
    return _filtered(regions, transforms, n, persist, seed, corrected, keys or ["video"], False)


def particle_history(
    regions: DataFrame,
    transforms: DataFrame,
    n: int = PARTICLES,
    persist: bool = False,
    seed: int = 0,
    corrected: bool = False,
    keys: list[str] | None = None,
) -> DataFrame:
    """Every particle after every step of the same run, each step once."""
    return _filtered(regions, transforms, n, persist, seed, corrected, keys or ["video"], True)


def _prefixed(ddl: str, prefix: str) -> str:
    return ", ".join(f"{prefix}{part.strip()}" for part in ddl.split(","))


def tracks_and_history(
    regions: DataFrame,
    transforms: DataFrame,
    n: int = PARTICLES,
    persist: bool = False,
    seed: int = 0,
    corrected: bool = False,
    keys: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Tracks and particle history of one run of the filter, materialized once."""
    keys = keys or ["video"]
    rows = cut(_filtered(regions, transforms, n, persist, seed, corrected, keys, True, True))

    def part(ddl: str, prefix: str) -> DataFrame:
        names = [piece.strip().split(" ")[0] for piece in ddl.split(",")]
        return rows.filter(F.col(f"{prefix}frame").isNotNull()).select(
            *keys, *[F.col(f"{prefix}{name}").alias(name) for name in names]
        )

    return part(TRACK_OUTPUT, "t_"), part(HISTORY_OUTPUT, "h_")


def confirmed_tracks(regions: DataFrame, transforms: DataFrame, **options) -> DataFrame:
    """Particle tracks, kept where observed at least twice."""
    return observation_hysteresis(particle_filter(regions, transforms, **options))
