"""Dead reckoning: identities carried from frame to frame by distance."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from trackframe.operators.fold import fold_frames

# A box in state: identity, x1, y1, x2, y2.
WIDTH = 5


@dataclass
class Reckoning:
    """What a video needs from its past: the boxes of its last frame, and a counter."""

    frame: int | None = None
    counter: int = 0
    boxes: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH), dtype=np.int64))


def pairwise_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of a with every box of b; corners in four columns."""
    if len(a) == 0 or len(b) == 0:
        return np.zeros((len(a), len(b)))
    # a matrix for each coordinate: reductions over short last axes cost far more
    ax1, ay1, ax2, ay2 = (a[:, i, None] for i in range(4))
    bx1, by1, bx2, by2 = (b[None, :, i] for i in range(4))
    wide = np.maximum(np.minimum(ax2, bx2) - np.maximum(ax1, bx1), 0)
    high = np.maximum(np.minimum(ay2, by2) - np.maximum(ay1, by1), 0)
    inter = (wide * high).astype(float)
    union = np.abs((ax2 - ax1) * (ay2 - ay1)) + np.abs((bx2 - bx1) * (by2 - by1)) - inter
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(inter > 0, inter / union, 0.0)
    same = (ax1 == bx1) & (ay1 == by1) & (ax2 == bx2) & (ay2 == by2) & (inter > 0)
    return np.where(same, 1.0, share)


def _centers(boxes: np.ndarray) -> np.ndarray:
    return (boxes[:, 2:] - boxes[:, :2]) / 2 + boxes[:, :2]


def _assign(dist: np.ndarray, prev_ids: np.ndarray, limit: float) -> dict[int, int]:
    """Current index -> previous index, smallest distances first."""
    curr, prev = np.nonzero(dist <= limit)
    order = np.lexsort((curr, prev_ids[prev], dist[curr, prev]))
    taken: dict[int, int] = {}
    used: set[int] = set()
    for i in order:
        c, p = int(curr[i]), int(prev[i])
        if c not in taken and p not in used:
            taken[c] = p
            used.add(p)
    return taken


def _assign_unsorted(dist: np.ndarray, limit: float) -> dict[int, int]:
    """The published order: boxes queue by their first distance and never re-sort.

    When a chosen previous box empties a waiting candidate list, the list after
    it keeps that box, so a previous box can be given out twice.
    """
    queue = []
    for c in range(dist.shape[0]):
        near = [p for p in np.argsort(dist[c], kind="stable") if dist[c, p] <= limit]
        if near:
            queue.append((c, [int(p) for p in near]))
    queue.sort(key=lambda entry: dist[entry[0], entry[1][0]])
    taken: dict[int, int] = {}
    while queue:
        (c, near), queue = queue[0], queue[1:]
        chosen = taken[c] = near[0]
        kept, skip = [], False
        for entry in queue:
            if skip:
                skip = False
                kept.append(entry)
                continue
            rest = [p for p in entry[1] if p != chosen]
            skip = not rest
            if rest:
                kept.append((entry[0], rest))
        queue = kept
    return taken


def _losers(ids: list[int | None], boxes: np.ndarray, limit: float, corrected: bool) -> set[int]:
    """Indices that lose a duplicate pair."""
    overlap = pairwise_iou(boxes, boxes)
    out = set()
    for i, j in zip(*np.nonzero(np.triu(overlap >= limit, 1))):
        a, b = ids[i], ids[j]
        if a == b:
            out.update([int(j)] if corrected else [int(i), int(j)])
        elif a is None or (b is not None and b < a):
            out.add(int(i))
        else:
            out.add(int(j))
    return out


def reckon_frame(
    state: Reckoning,
    frame: int,
    found: np.ndarray,
    max_dist: float,
    same_threshold: float,
    legacy_order: bool = False,
    corrected: bool = False,
) -> list[tuple]:
    """Advance one frame; gives (frame, identity, x1, y1, x2, y2, carried) rows."""
    prev = state.boxes
    ids: list[int | None] = [None] * len(found)
    if state.frame is not None and len(prev) and len(found):
        gap = _centers(found)[:, None, :] - _centers(prev[:, 1:])[None, :, :]
        dist = np.sqrt((gap**2).sum(axis=2))
        pairs = (
            _assign_unsorted(dist, max_dist)
            if legacy_order
            else _assign(dist, prev[:, 0], max_dist)
        )
        for c, p in pairs.items():
            ids[c] = int(prev[p, 0])
    known = {i for i in ids if i is not None}
    gone = [row for row in prev if int(row[0]) not in known]
    all_ids = ids + [int(row[0]) for row in gone]
    boxes = np.vstack([found, *[row[1:][None, :] for row in gone]]) if gone else found
    dropped = _losers(all_ids, boxes, same_threshold, corrected) if len(boxes) > 1 else set()
    for c in range(len(found)):
        if ids[c] is None:
            all_ids[c] = state.counter
            state.counter += 1
    rows = [
        (frame, all_ids[i], *box, i >= len(found))
        for i, box in enumerate(boxes.tolist())
        if i not in dropped
    ]
    state.frame = frame
    state.boxes = np.array([r[1:6] for r in rows], dtype=np.int64).reshape(-1, WIDTH)
    return rows


def reckon_through(state: Reckoning, frame: int, found: np.ndarray, **options) -> list[tuple]:
    """Advance to ``frame``; frames without boxes in between repeat what is known."""
    rows: list[tuple] = []
    if state.frame is not None:
        nothing = np.zeros((0, 4), dtype=np.int64)
        for empty in range(state.frame + 1, frame):
            rows += reckon_frame(state, empty, nothing, **options)
    return rows + reckon_frame(state, frame, found, **options)


OUTPUT = "frame bigint, identity bigint, x1 int, y1 int, x2 int, y2 int, carried boolean"


def corners_of(rows) -> np.ndarray:
    """Corner columns of a frame as one array."""
    return np.column_stack([rows[n] for n in ("x1", "y1", "x2", "y2")]).astype(np.int64)


def dead_reckoning(
    regions: DataFrame,
    max_dist: float,
    same_threshold: float,
    legacy_order: bool = False,
    corrected: bool = False,
    keys: list[str] | None = None,
) -> DataFrame:
    """Give boxes identities that persist over frames.

    Nearest boxes of the frame before pass their identity on, tracks without a
    box now are repeated, duplicates are dropped, and the rest get new numbers.
    A frame depends on the one before, so frames of a key run in order in one
    task that holds one frame; add a scene column to ``keys`` to split a video.
    """
    keys = keys or ["video"]
    options = dict(
        max_dist=max_dist,
        same_threshold=same_threshold,
        legacy_order=legacy_order,
        corrected=corrected,
    )

    def step(state, key, frame, rows):
        return [(*key, *r) for r in reckon_through(state, frame, corners_of(rows), **options)]

    fields = [f"{k} {regions.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*fields, OUTPUT])
    columns = regions.select(*keys, "frame", "ord", "x1", "y1", "x2", "y2")
    return fold_frames(columns, keys, lambda key: Reckoning(), step, schema)
