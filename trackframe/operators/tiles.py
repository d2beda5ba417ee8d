"""Images as tiles: the detector's pixel operators on one small array per row.

``tiles(video, frame, ty, tx, data)`` holds bytes, row by row, of squares of ``tile``
pixels; those at the right and lower border are what is left of the image. A tile is
the unit of work and of shuffles, so a frame of any size is spread over tasks, and no
pixel is a row before the mask. Values are those of the pixel operators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.scalars import BAND_CODES, CORRECTED_CODES, HIGH_LIMIT, LOW_LIMIT
from trackframe.operators.morphology import _offsets
from trackframe.operators.pixels import ON, SAME_LEVELS
from trackframe.operators.registration import SUBPIXEL, _inverse
from trackframe.operators.stacks import first_rows, numbers, starts_of, whole, whole_groups
from trackframe.session import spread

TILE = 128
KEY = ["video", "frame", "ty", "tx"]
#: What the comparison with the history gives for each pixel, all bytes.
LAYERS = ["v", "weight", "dissimilarity", "background", "covered", "covered_all", "foreground", "moving"]


class Grid:
    """Sizes of an image and of its tiles."""

    def __init__(self, width: int, height: int, tile: int = TILE):
        self.width, self.height, self.tile = width, height, tile
        self.rows, self.columns = -(-height // tile), -(-width // tile)

    def span(self, ty: int, tx: int, reach: int = 0) -> tuple[int, int, int, int]:
        """First and last (excluded) y and x of a tile and what is ``reach`` around it."""
        t = self.tile
        return (
            max(ty * t - reach, 0), min((ty + 1) * t + reach, self.height),
            max(tx * t - reach, 0), min((tx + 1) * t + reach, self.width),
        )

    def array(self, data: bytes, ty: int, tx: int) -> np.ndarray:
        y0, y1, x0, x1 = self.span(ty, tx)
        return np.frombuffer(data, np.uint8).reshape(y1 - y0, x1 - x0)


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _rows(columns: dict, like: pa.Schema, extra: dict) -> pa.RecordBatch:
    """Columns as a batch; those of the input keep their types."""
    kinds = {name: like.field(name).type for name in columns if name in like.names} | extra
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, kinds[name]) for name, v in columns.items()],
        list(columns),
    )


BYTES = {"ty": pa.int32(), "tx": pa.int32(), "data": pa.binary()}

# Stacks -----------------------------------------------------------------------

#: Pixels that are worked on at once; a stack holds as many tiles.
STACK_PIXELS = 1 << 20


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row begins."""
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), begins


def _stack(column: pa.Array, at: np.ndarray, high: int, wide: int) -> np.ndarray:
    """The tiles of some rows, which have one size, as one array."""
    data, begins = _flat(column)
    return data[begins[at].astype(np.int64)[:, None] + np.arange(high * wide)].reshape(-1, high, wide)


class _Pieces:
    """Byte rows that are filled group by group, and come out as one column."""

    def __init__(self, sizes: np.ndarray):
        self.ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        self.data = np.zeros(int(self.ends[-1]), np.uint8)

    def put(self, at: np.ndarray, values: np.ndarray) -> None:
        flat = values.reshape(len(at), -1)
        self.data[self.ends[at][:, None] + np.arange(flat.shape[1])] = flat

    def column(self) -> pa.Array:
        buffers = [None, pa.py_buffer(self.ends.astype(np.int32)), pa.py_buffer(self.data)]
        return pa.Array.from_buffers(pa.binary(), len(self.ends) - 1, buffers)


def _alike(*columns: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of equal rows."""
    if len(columns[0]) == 0:
        return
    order = np.lexsort(columns)
    change = np.zeros(len(order) - 1, bool)
    for values in columns:
        change |= values[order][1:] != values[order][:-1]
    yield from np.split(order, np.flatnonzero(change) + 1)


def _grouped(
    df: DataFrame, keys: list[str], grid: Grid, step: Callable, schema: str, within=(), row_pixels: int | None = None
) -> DataFrame:
    """Groups that go together have rows, of a tile or ``row_pixels`` each, and tiles for a stack at most."""
    tile = grid.tile * grid.tile
    rows, groups = STACK_PIXELS // (row_pixels or tile), STACK_PIXELS // tile
    return whole_groups(df, keys, step, schema, max(rows, 1), max(groups, 1), within)


def _portions(batches: Iterator[pa.RecordBatch], pixels: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts whose rows of ``pixels`` make one stack."""
    most = max(STACK_PIXELS // max(pixels, 1), 1)
    for batch in batches:
        for first in range(0, len(batch), most):
            yield batch.slice(first, most)


def _sizes(grid: Grid, ty: np.ndarray, tx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Height and width of tiles."""
    t = grid.tile
    return np.minimum((ty + 1) * t, grid.height) - ty * t, np.minimum((tx + 1) * t, grid.width) - tx * t


def frame_tiles(frames: DataFrame, grid: Grid) -> DataFrame:
    """Gray frames (video, frame, height, width, data) cut into tiles where they are read."""
    places = [(a, b) for a in range(grid.rows) for b in range(grid.columns)]

    def cut_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, grid.width * grid.height):
            high, wide = numbers(batch, "height"), numbers(batch, "width")
            for at in _alike(high, wide):
                images = _stack(batch["data"], at, int(high[at[0]]), int(wide[at[0]]))
                spans = [grid.span(*place) for place in places]
                pieces = _Pieces(np.repeat([len(range(*s[:2])) * len(range(*s[2:])) for s in spans], len(at)))
                for n, (y0, y1, x0, x1) in enumerate(spans):
                    pieces.put(np.arange(n * len(at), (n + 1) * len(at)), images[:, y0:y1, x0:x1])
                same = pa.array(np.tile(at, len(places)))
                yield _rows(
                    {
                        "video": batch["video"].take(same), "frame": batch["frame"].take(same),
                        "ty": np.repeat([a for a, _ in places], len(at)),
                        "tx": np.repeat([b for _, b in places], len(at)), "data": pieces.column(),
                    },
                    batch.schema, BYTES,
                )

    schema = f"{_kinds(frames, ['video', 'frame'])}, ty int, tx int, data binary"
    return frames.select("video", "frame", "height", "width", "data").mapInArrow(cut_frames, schema)


def to_tiles(pixels: DataFrame, grid: Grid, value: str = "v") -> DataFrame:
    """Pixel rows to tiles; pixels without a row are 0."""
    placed = pixels.select(
        "video", "frame",
        F.floor(F.col("y") / grid.tile).cast("int").alias("ty"),
        F.floor(F.col("x") / grid.tile).cast("int").alias("tx"),
        F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
        F.col(value).cast("int").alias("v"),
    )

    def paint(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ty, tx = numbers(table, "ty").astype(np.int64), numbers(table, "tx").astype(np.int64)
        high, wide = _sizes(grid, ty, tx)
        pieces = _Pieces((high * wide)[starts])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(table)]))
        y, x = numbers(table, "y") - ty * grid.tile, numbers(table, "x") - tx * grid.tile
        pieces.data[pieces.ends[group] + y * wide + x] = numbers(table, "v")
        return first_rows(table, starts, KEY, {"data": pieces.column()})

    schema = f"{_kinds(placed, KEY)}, data binary"
    return _grouped(placed, KEY, grid, paint, schema, row_pixels=1)


def to_pixels(tiles: DataFrame, grid: Grid, layers: dict[str, str], only_set: bool = False) -> DataFrame:
    """Tiles to pixel rows, a column for each layer; ``only_set`` leaves out zeros of the first."""
    given = [c for c in tiles.columns if c in ("video", "frame", "hist_frame")]

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, grid.tile * grid.tile):
            ty, tx = numbers(batch, "ty").astype(np.int64), numbers(batch, "tx").astype(np.int64)
            high, wide = _sizes(grid, ty, tx)
            for at in _alike(high, wide):
                h, w = int(high[at[0]]), int(wide[at[0]])
                values = [_stack(batch[name], at, h, w) for name in layers]
                if only_set:
                    n, y, x = np.nonzero(values[0])
                else:
                    n, y, x = (v.reshape(-1) for v in np.indices(values[0].shape))
                if not len(n):
                    continue
                same = pa.array(at[n])
                found = {
                    own: v[n, y, x].astype(np.int32) for own, v in zip(layers.values(), values, strict=True)
                }
                yield _rows(
                    {
                        **{name: batch[name].take(same) for name in given},
                        "y": (y + ty[at[n]] * grid.tile).astype(np.int32),
                        "x": (x + tx[at[n]] * grid.tile).astype(np.int32), **found,
                    },
                    batch.schema, {"y": pa.int32(), "x": pa.int32()} | dict.fromkeys(found, pa.int32()),
                )

    out = ", ".join([_kinds(tiles, given), "y int", "x int", *[f"{n} int" for n in layers.values()]])
    return tiles.select(*given, "ty", "tx", *layers).mapInArrow(unfold, out)


# Neighbours -----------------------------------------------------------------


def with_halo(
    tiles: DataFrame, grid: Grid, reach: int, kernel: Callable, skip_empty: bool = False
) -> DataFrame:
    """Each tile through ``kernel(canvases, borders)`` with ``reach`` pixels around it.

    A canvas ends at the borders of the image, which ``borders`` (top, bottom, left,
    right) marks; the kernel gets a stack of canvases of one kind and gives one of the
    same size, whose middle is kept. Tiles pass the strips that their neighbours need, and
    are not copied as a whole. With ``skip_empty`` strips of zeros do not travel, and
    tiles of zeros alone have no row.
    """
    steps = -(-reach // grid.tile)
    strip = dict.fromkeys(("y0", "x0", "high"), pa.int32())

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, grid.tile * grid.tile):
            rows, columns = numbers(batch, "ty"), numbers(batch, "tx")
            for at in _alike(rows, columns):
                row, column = int(rows[at[0]]), int(columns[at[0]])
                top, bottom, left, right = grid.span(row, column)
                images = _stack(batch["data"], at, bottom - top, right - left)
                for ty in range(max(row - steps, 0), min(row + steps + 1, grid.rows)):
                    for tx in range(max(column - steps, 0), min(column + steps + 1, grid.columns)):
                        y0, y1, x0, x1 = grid.span(ty, tx, reach)
                        y0, y1 = max(y0, top), min(y1, bottom)
                        x0, x1 = max(x0, left), min(x1, right)
                        piece = images[:, y0 - top : max(y1 - top, 0), x0 - left : max(x1 - left, 0)]
                        kept = piece.any(axis=(1, 2)) if skip_empty else np.ones(len(at), bool)
                        many = int(kept.sum())
                        if not piece.size or not many:
                            continue
                        pieces = _Pieces(np.full(many, piece[0].size))
                        pieces.put(np.arange(many), piece[kept])
                        same = pa.array(at[kept])
                        yield _rows(
                            {
                                "video": batch["video"].take(same), "frame": batch["frame"].take(same),
                                **{n: np.full(many, v) for n, v in (
                                    ("ty", ty), ("tx", tx), ("y0", y0), ("x0", x0), ("high", piece.shape[1]))},
                                "data": pieces.column(),
                            },
                            batch.schema, BYTES | strip,
                        )

    def meet(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        rows = {n: numbers(table, n).astype(np.int64) for n in ("ty", "tx", "y0", "x0", "high")}
        data = whole(table, "data")
        size = np.diff(_flat(data)[1])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(table)]))
        high, wide = _sizes(grid, rows["ty"][starts], rows["tx"][starts])
        found = _Pieces(high * wide)
        full = np.ones(len(starts), bool)
        for places in _alike(rows["ty"][starts], rows["tx"][starts]):
            ty, tx = int(rows["ty"][starts[places[0]]]), int(rows["tx"][starts[places[0]]])
            y0, y1, x0, x1 = grid.span(ty, tx, reach)
            canvases = np.zeros((len(places), y1 - y0, x1 - x0), np.uint8)
            spot = np.full(len(starts), -1)
            spot[places] = np.arange(len(places))
            mine = np.flatnonzero(spot[group] >= 0)
            for part in _alike(*[v[mine] for v in (rows["y0"], rows["x0"], rows["high"], size)]):
                at = mine[part]
                h = int(rows["high"][at[0]])
                w = int(size[at[0]]) // h
                a, b = int(rows["y0"][at[0]]) - y0, int(rows["x0"][at[0]]) - x0
                canvases[spot[group[at]], a : a + h, b : b + w] = _stack(data, at, h, w)
            borders = (y0 == 0, y1 == grid.height, x0 == 0, x1 == grid.width)
            top, bottom, left, right = grid.span(ty, tx)
            done = kernel(canvases, borders)[:, top - y0 : bottom - y0, left - x0 : right - x0]
            found.put(places, done.astype(np.uint8))
            full[places] = done.any(axis=(1, 2))
        if not skip_empty:
            return first_rows(table, starts, KEY, {"data": found.column()})
        kept = np.flatnonzero(full)
        return first_rows(table, starts[kept], KEY, {"data": found.column().take(pa.array(kept))})

    offered = f"{_kinds(tiles, KEY)}, y0 int, x0 int, high int, data binary"
    strips = tiles.select(*KEY, "data").mapInArrow(offer, offered)
    return _grouped(strips, KEY, grid, meet, f"{_kinds(tiles, KEY)}, data binary")


def _running(values: np.ndarray, low: int, high: int, axis: int) -> np.ndarray:
    """Sums from ``low`` to ``high`` around each place; nothing counts outside."""
    size = values.shape[axis]
    sums = np.insert(np.cumsum(values, axis=axis, dtype=np.int64), 0, 0, axis=axis)
    at = np.arange(size)
    return np.take(sums, np.clip(at + high + 1, 0, size), axis) - np.take(
        sums, np.clip(at + low, 0, size), axis
    )


def box_blur(tiles: DataFrame, k: int, grid: Grid) -> DataFrame:
    """k x k mean with mirrored border, rounded once, half to even."""
    low, high = _offsets(k)
    if k // 2 >= min(grid.width, grid.height):
        raise ValueError("kernel larger than the image")

    def blur(canvases: np.ndarray, borders) -> np.ndarray:
        pad = [(0, 0), (-low if borders[0] else 0, high if borders[1] else 0),
               (-low if borders[2] else 0, high if borders[3] else 0)]
        wide = np.pad(canvases.astype(np.int64), pad, "reflect")
        sums = _running(_running(wide, low, high, -1), low, high, -2)
        h, w = canvases.shape[1:]
        middle = sums[:, pad[1][0] : pad[1][0] + h, pad[2][0] : pad[2][0] + w]
        return np.round(middle / float(k * k)).astype(np.uint8)

    return with_halo(tiles, grid, k // 2, blur)


def _within(mask: np.ndarray, eps: float) -> np.ndarray:
    """How many set pixels lie within ``eps`` of each pixel."""
    reach, high = int(math.floor(eps)), mask.shape[-2]
    found = np.zeros(mask.shape, np.int64)
    for d in range(-reach, reach + 1):
        half = int(math.floor(math.sqrt(eps * eps - d * d)))
        if abs(d) >= high:
            continue
        rows = _running(mask, -half, half, -1)
        found[..., max(-d, 0) : high - max(d, 0), :] += rows[..., max(d, 0) : high - max(-d, 0), :]
    return found


def _closed(mask: np.ndarray, k: int) -> np.ndarray:
    """Box dilation, then erosion; what is outside counts for neither."""
    low, high = _offsets(k)
    grown = _running(_running(mask, low, high, -1) > 0, low, high, -2) > 0
    return _running(_running(~grown, low, high, -1) > 0, low, high, -2) == 0


def density_filter(mask: DataFrame, eps: float, min_samples: int, grid: Grid) -> DataFrame:
    """Set pixels that density clustering would not call noise."""
    return clean_mask(mask, eps, min_samples, 1, grid)


def close_mask(mask: DataFrame, k: int, grid: Grid) -> DataFrame:
    """k x k dilate, then erode."""
    return clean_mask(mask, 0.0, 1, k, grid)


def clean_mask(mask: DataFrame, eps: float, min_samples: int, k: int, grid: Grid) -> DataFrame:
    """Density filter and closing after one exchange of strips; tiles without a set pixel go."""

    def clean(canvases: np.ndarray, borders) -> np.ndarray:
        set_ = canvases > 0
        cores = set_ & (_within(set_, eps) >= min_samples)
        kept = set_ & (_within(cores, eps) >= 1)
        return np.where(_closed(kept, k), ON, 0)

    return with_halo(mask, grid, 2 * int(math.floor(eps)) + 2 * (k // 2), clean, skip_empty=True)


# Warps ----------------------------------------------------------------------

SOLVED = [f"i{n}" for n in range(9)]


def _source(solved: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where target pixels come from, in parts of a pixel: along y and along x."""
    i = solved
    w = i[6] * x + i[7] * y + i[8]

    def position(a, b, c) -> np.ndarray:
        top = (a * x + b * y + c) * SUBPIXEL
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.where(w != 0, np.round(top / w), 0.0)
        return np.clip(np.nan_to_num(at), -(2.0**50), 2.0**50).astype(np.int64)

    return position(i[3], i[4], i[5]), position(i[0], i[1], i[2])


def _needed(solved: np.ndarray, grid: Grid, ty: np.ndarray, tx: int) -> list[np.ndarray]:
    """First and last (excluded) row and column of source tiles that target tiles can reach."""
    high, wide = _sizes(grid, ty, np.int64(tx))
    y0, x0 = ty * grid.tile, tx * grid.tile
    y = np.stack([y0, y0, y0 + high - 1, y0 + high - 1]).astype(float)
    x = np.array([x0, x0 + wide - 1, x0, x0 + wide - 1], float)[:, None]
    w = solved[6] * x + solved[7] * y + solved[8]
    near = (w > 0).all(axis=0) | (w < 0).all(axis=0)
    found = []
    for at, size, tiles in zip(
        _source(solved, y, x), (grid.height, grid.width), (grid.rows, grid.columns), strict=True
    ):
        at = np.clip(at // SUBPIXEL, -2, max(grid.height, grid.width) + 2)
        # where the horizon crosses the tile, all
        low = np.where(near, at.min(axis=0) - 1, 0)
        high = np.where(near, at.max(axis=0) + 2, size)
        first = np.maximum(low, 0) // grid.tile
        found += [first, np.maximum(np.minimum(high // grid.tile + 1, tiles), first)]
    return found


def _image_rows(transforms: DataFrame, grid: Grid) -> DataFrame:
    """Inverse matrices, once for each image row of tiles, dealt out before they are widened."""
    keys = ["video", "frame", "hist_frame"]
    solved = transforms.select(*keys, *[c.alias(n) for n, c in zip(SOLVED, _inverse(), strict=True)])
    rows = solved.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(grid.rows - 1))))
    return spread(rows, *keys, "ty")


def _targets(transforms: DataFrame, grid: Grid) -> DataFrame:
    """A row for each target tile and each source tile it needs, one at least."""
    keys = ["video", "frame", "hist_frame"]
    dealt = _image_rows(transforms, grid)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = np.stack([numbers(batch, n) for n in SOLVED])
            ty = numbers(batch, "ty").astype(np.int64)
            for tx in range(grid.columns):
                top, bottom, left, right = _needed(solved, grid, ty, tx)
                across = right - left
                many = (bottom - top) * across
                # a tile that needs none has a row without a source
                none = many == 0
                at = np.repeat(np.arange(len(ty)), np.maximum(many, 1))
                place = np.arange(len(at)) - np.repeat(np.cumsum(np.maximum(many, 1)) - np.maximum(many, 1),
                                                       np.maximum(many, 1))
                wide = np.maximum(across, 1)[at]
                same = pa.array(at)
                yield _rows(
                    {
                        **{n: batch[n].take(same) for n in [*keys, *SOLVED, "ty"]},
                        "tx": np.full(len(at), tx),
                        "sy": pa.array((top[at] + place // wide).astype(np.int32), mask=none[at]),
                        "sx": pa.array((left[at] + place % wide).astype(np.int32), mask=none[at]),
                    },
                    batch.schema, dict.fromkeys(("tx", "sy", "sx"), pa.int32()),
                )

    schema = f"{_kinds(dealt, [*keys, *SOLVED, 'ty'])}, tx int, sy int, sx int"
    return dealt.mapInArrow(widen, schema)


def _corners(solved: np.ndarray, grid: Grid, ty: int, tx: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For a stack of target tiles of one place, the four source pixels and their shares."""
    y0, y1, x0, x1 = grid.span(ty, tx)
    y = np.arange(y0, y1, dtype=float)[None, :, None]
    x = np.arange(x0, x1, dtype=float)[None, None, :]
    sy, sx = _source(solved[:, :, None, None], y, x)
    fy, fx = sy % SUBPIXEL, sx % SUBPIXEL
    for dy in (0, 1):
        for dx in (0, 1):
            a, b = sy // SUBPIXEL + dy, sx // SUBPIXEL + dx
            share = (fx if dx else SUBPIXEL - fx) * (fy if dy else SUBPIXEL - fy)
            inside = (a >= 0) & (a < grid.height) & (b >= 0) & (b < grid.width)
            yield np.where(inside, a, 0), np.where(inside, b, 0), np.where(inside, share, 0)


def _level(parts: np.ndarray) -> np.ndarray:
    full = SUBPIXEL * SUBPIXEL
    return (parts + full // 2) // full


def _warped(table: pa.Table, starts: np.ndarray, grid: Grid) -> Iterator[tuple[np.ndarray, ...]]:
    """(groups, values, coverage) of stacks of target tiles of one place.

    A group has the source tiles of one history frame for one target tile; they make a
    rectangle, in which a pixel's tile is found by its position.
    """
    t = grid.tile
    sizes = np.diff(np.r_[starts, len(table)])
    group = np.repeat(np.arange(len(starts)), sizes)
    column = whole(table, "data")
    data, begins = _flat(column)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sy = pc.fill_null(whole(table, "sy"), 0).to_numpy().astype(np.int64)
    sx = pc.fill_null(whole(table, "sx"), 0).to_numpy().astype(np.int64)
    wide = _sizes(grid, sy, sx)[1]
    top, left = np.minimum.reduceat(sy, starts), np.minimum.reduceat(sx, starts)
    down = np.maximum.reduceat(sy, starts) - top + 1
    across = np.maximum.reduceat(sx, starts) - left + 1
    base = np.cumsum(down * across) - down * across
    held = np.full(int((down * across).sum()) + 1, -1)
    rows = np.flatnonzero(there)
    of = group[rows]
    held[base[of] + (sy[rows] - top[of]) * across[of] + sx[rows] - left[of]] = rows
    solved = np.stack([numbers(table, n)[starts] for n in SOLVED])
    ty, tx = numbers(table, "ty")[starts], numbers(table, "tx")[starts]
    for places in _alike(ty, tx):
        each = lambda v: v[places][:, None, None]
        value = part = 0
        for a, b, share in _corners(solved[:, places], grid, int(ty[places[0]]), int(tx[places[0]])):
            row, at = a // t - each(top), b // t - each(left)
            known = (row >= 0) & (row < each(down)) & (at >= 0) & (at < each(across)) & (share > 0)
            tile = held[np.where(known, each(base) + row * each(across) + at, -1)]
            known &= tile >= 0
            tile = np.where(known, tile, 0)
            pixel = begins[tile] + (a - sy[tile] * t) * wide[tile] + b - sx[tile] * t
            share = np.where(known, share, 0)
            if len(data):
                value = value + data[np.where(known, pixel, 0)] * share
            part = part + share
        value = value if len(data) else np.zeros_like(part)
        yield places, _level(value), _level(part)


def _with_sources(tiles: DataFrame, transforms: DataFrame, grid: Grid) -> DataFrame:
    source = tiles.select(
        "video", F.col("frame").alias("hist_frame"), F.col("ty").alias("sy"), F.col("tx").alias("sx"), "data"
    )
    return _targets(transforms, grid).join(source, ["video", "hist_frame", "sy", "sx"], "left")


def warp_history(tiles: DataFrame, transforms: DataFrame, grid: Grid) -> DataFrame:
    """History frames in the coordinates of their frame: tiles with ``data`` and ``covered``.

    Bilinear, 0 outside; the corners of a target tile say which source tiles it needs.
    """
    joined = _with_sources(tiles, transforms, grid)
    keys = ["video", "frame", "hist_frame", "ty", "tx"]

    def warp(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        high, wide = _sizes(grid, numbers(table, "ty")[starts], numbers(table, "tx")[starts])
        found = {name: _Pieces(high * wide) for name in ("data", "covered")}
        for places, *values in _warped(table, starts, grid):
            for pieces, v in zip(found.values(), values, strict=True):
                pieces.put(places, v)
        return first_rows(table, starts, keys, {n: p.column() for n, p in found.items()})

    return _grouped(joined, keys, grid, warp, f"{_kinds(joined, keys)}, data binary, covered binary")


def coverage_masks(transforms: DataFrame, grid: Grid) -> DataFrame:
    """The warp of an all-ones frame, as tiles of 0 and 1; no image is read, none is joined."""
    keys = ["video", "frame", "hist_frame"]
    dealt = _image_rows(transforms, grid)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, grid.tile * grid.tile):
            solved = np.stack([numbers(batch, n) for n in SOLVED])
            rows = numbers(batch, "ty")
            for at in _alike(rows):
                ty, same = int(rows[at[0]]), pa.array(at)
                for tx in range(grid.columns):
                    covered = _level(sum(share for _, _, share in _corners(solved[:, at], grid, ty, tx)))
                    pieces = _Pieces(np.full(len(at), covered[0].size))
                    pieces.put(np.arange(len(at)), covered)
                    yield _rows(
                        {
                            **{n: batch[n].take(same) for n in keys},
                            "ty": np.full(len(at), ty), "tx": np.full(len(at), tx), "data": pieces.column(),
                        },
                        batch.schema, BYTES,
                    )

    return dealt.mapInArrow(draw, f"{_kinds(dealt, [*keys, 'ty'])}, tx int, data binary")


# History --------------------------------------------------------------------


class Compared:
    """A walk over the history frames of a tile, oldest first; the last one is held."""

    def __init__(self, scale: int):
        self.scale, self.last, self.seen = scale, None, 0

    def add(self, v: np.ndarray, covered: np.ndarray | None = None) -> None:
        v = v.astype(np.int64)
        q = np.floor(v * self.scale / 255.0).astype(np.int64)
        covered = np.ones(v.shape, np.int64) if covered is None else covered
        if self.last is None:
            self.weight, self.moved, self.background = (np.zeros(v.shape, np.int64) for _ in range(3))
            self.all = covered
        else:
            old, old_q = self.last
            same = np.abs(q - old_q) <= SAME_LEVELS
            self.weight += same
            self.moved += np.where(same, 0, np.abs(v - old))
            self.background = np.where(~same & (old != 0), old, self.background)
            self.all = np.minimum(self.all, covered)
        self.last, self.covered, self.seen = (v, q), covered, self.seen + 1

    def layers(self, v: np.ndarray, history: int, corrected: bool) -> dict[str, np.ndarray]:
        """LAYERS of the frame with values ``v``."""
        unlike = self.moved // history
        foreground = np.where(self.weight >= history - 1, 0, np.abs(v.astype(np.int64) - self.background))
        codes = CORRECTED_CODES if corrected else BAND_CODES

        def level(x: np.ndarray) -> np.ndarray:
            return np.where(x <= LOW_LIMIT, codes["low"], np.where(x < HIGH_LIMIT, codes["medium"], codes["high"]))

        third, fg, dl = (history - 1) // 3, level(foreground), level(unlike)
        medium = (self.weight > third) & (self.weight < history - 1) & (fg >= dl)
        low = (self.weight <= third) & (dl == 1) & (fg > dl)
        moving = np.where(medium | low, ON, 0)
        values = (v, self.weight, unlike, self.background, self.covered, self.all, foreground, moving)
        return dict(zip(LAYERS, values, strict=True))


LAYERS_DDL = ", ".join(f"{name} binary" for name in LAYERS)


def anchored_history(
    tiles: DataFrame,
    transforms: DataFrame,
    history: int,
    scale: int,
    grid: Grid,
    corrected: bool = False,
    want: DataFrame | None = None,
) -> DataFrame:
    """LAYERS of each tile against its warped history: warp, comparison and foreground at once.

    Source tiles travel, warped ones do not. ``tiles`` holds the frames themselves too; a
    frame needs ``history`` matrices and its own tile. ``want`` has the frames that are
    looked at, if they are others than those of ``tiles``.
    """
    joined = _with_sources(tiles, transforms, grid)
    own = (tiles if want is None else want).select(*KEY, "data")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in joined.schema if f.name not in own.columns]
    both = joined.unionByName(own.select("*", *none))

    def compare(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        # the frame's own tile comes first, then its history in order
        frames = starts_of(table, [*KEY, "hist_frame"])
        owner = np.searchsorted(starts, frames, "right") - 1
        seen = whole(table, "hist_frame").is_valid().to_numpy(zero_copy_only=False)
        many = np.bincount(owner[seen[frames]], minlength=len(starts))
        good = np.flatnonzero(~seen[starts] & (many == history))
        number = np.full(len(starts), -1)
        number[good] = np.arange(len(good))
        high, wide = _sizes(grid, numbers(table, "ty")[starts[good]], numbers(table, "tx")[starts[good]])
        found = {name: _Pieces(high * wide) for name in LAYERS}
        # only what has a whole history is warped
        past = np.flatnonzero(seen[frames] & (number[owner] >= 0))
        if len(past):
            ends = np.r_[frames[1:], len(table)]
            size = (ends - frames)[past]
            begin = np.cumsum(size) - size
            rows = np.arange(int(size.sum())) + np.repeat(frames[past] - begin, size)
            data = whole(table, "data")
            for places, value, covered in _warped(table.take(pa.array(rows)).combine_chunks(), begin, grid):
                # tiles of one place in the order of their frames, ``history`` for each
                places, order = np.sort(places), np.argsort(places, kind="stable")
                h, w = value.shape[1:]
                value = value[order].reshape(-1, history, h, w)
                covered = covered[order].reshape(-1, history, h, w)
                group = owner[past[places[::history]]]
                walk = Compared(scale)
                for n in range(history):
                    walk.add(value[:, n], covered[:, n])
                own_tiles = _stack(data, starts[group], h, w)
                for name, v in walk.layers(own_tiles, history, corrected).items():
                    found[name].put(number[group], v.astype(np.uint8))
        return first_rows(table, starts[good], KEY, {n: p.column() for n, p in found.items()})

    schema = f"{_kinds(both, KEY)}, {LAYERS_DDL}"
    return _grouped(both, KEY, grid, compare, schema, within=[F.col("hist_frame").asc_nulls_first()])


def rolling_history(
    tiles: DataFrame, history: int, scale: int, grid: Grid, corrected: bool = False
) -> DataFrame:
    """LAYERS of each tile against the ``history`` frames before, for a still camera.

    The tiles of a place are streamed in the order of their frames; the last ``history``
    tiles are held. Frames without a full history have no row.
    """
    placed = spread(tiles.select(*KEY, "data"), "video", "ty", "tx").sortWithinPartitions(
        "video", "ty", "tx", "frame"
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ring = None, None
        for batch in _portions(batches, grid.tile * grid.tile):
            table = pa.Table.from_batches([batch])
            starts = starts_of(table, ["video", "ty", "tx"])
            for first, last in zip(starts, [*starts[1:], len(batch)], strict=True):
                here = tuple(batch[n][int(first)].as_py() for n in ("video", "ty", "tx"))
                y0, y1, x0, x1 = grid.span(*here[1:])
                tiles = _stack(batch["data"], np.arange(first, last), y1 - y0, x1 - x0)
                if here == place:
                    tiles = np.concatenate([ring, tiles])
                place, ring, many = here, tiles[-history:], len(tiles) - history
                if many <= 0:
                    continue
                compared = Compared(scale)
                for n in range(history):
                    compared.add(tiles[n : n + many])
                found = {}
                for name, v in compared.layers(tiles[history:], history, corrected).items():
                    pieces = _Pieces(np.full(many, v[0].size))
                    pieces.put(np.arange(many), v.astype(np.uint8))
                    found[name] = pieces.column()
                yield first_rows(table, np.arange(last - many, last), KEY, found)

    return placed.mapInArrow(walk, f"{_kinds(tiles, KEY)}, {LAYERS_DDL}")


def layer(features: DataFrame, name: str) -> DataFrame:
    """One layer as tiles."""
    return features.select(*KEY, F.col(name).alias("data"))


def seen_moving(features: DataFrame, corrected: bool = False) -> DataFrame:
    """Moving pixels where the history covers them: the newest frame, or all if ``corrected``."""
    seen = "covered_all" if corrected else "covered"

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (moving, at), (covered, of) = _flat(batch["moving"]), _flat(batch[seen])
            pieces = _Pieces(np.diff(at))
            pieces.data[:] = np.where(covered[of[0] : of[-1]] == 1, moving[at[0] : at[-1]], 0)
            yield batch.select(KEY).append_column("data", pieces.column())

    columns = features.select(*KEY, "moving", seen)
    return columns.mapInArrow(mask, f"{_kinds(columns, KEY)}, data binary")
