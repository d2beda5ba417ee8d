"""Keyed state over frame streams, in the order of the frames.

A frame may reach the stream in pieces: split over files, in several micro-batches,
after a later frame. Its rows wait in the state of their key until the watermark has
passed the frame; then frames go through a step in order, one at a time. Nothing is
dropped: rows of a frame that has been closed come out as a count in ``late``, apart
from the results (:func:`on_time`, :func:`late_rows`).

Time is that of :func:`trackframe.streaming.sources.with_event_time`. A row without a
video only moves the watermark, so one such row after the last frame closes a stream.
State is kept by ``transformWithStateInPandas`` in RocksDB, which spills to disk: what
is in memory is one batch of input or one block of frames. The steps are those of the batch
operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegralType, StructType

from trackframe.operators import particles as PA
from trackframe.operators import reckoning as RK
from trackframe.schema import BOX_COLUMNS, TRANSFORM_COLUMNS
from trackframe.streaming.sources import with_event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that a task collects before it passes them on.
FLUSH_ROWS = 10_000
LATE = "late"


def use_keyed_state(spark: SparkSession) -> None:
    """Let streams that start from here on keep state with timers."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def on_time(rows: DataFrame) -> DataFrame:
    """The results of a keyed operator."""
    return rows.filter(f"{LATE} = 0").drop(LATE)


def late_rows(rows: DataFrame, keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """How many rows came for frames that had been closed; they are in no result."""
    return rows.filter(f"{LATE} > 0").select(*keys, LATE)


def _ddl(df: DataFrame, names: list[str]) -> list[str]:
    return [f"{n} {df.schema[n].dataType.simpleString()}" for n in names]


def _names(ddl: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(ddl).fields] if ddl else []


def _absent(key: tuple) -> bool:
    """Whether a row has no video; a null number arrives as NaN."""
    return key[0] is None or key[0] != key[0]


def _plain(values, whole: bool) -> list:
    """Values of a column for the state store; null numbers arrive as NaN."""
    import pandas as pd

    if values.dtype.kind in "iub":
        return values.tolist()
    if whole:
        return [None if pd.isna(v) else int(v) for v in values]
    if values.dtype == object:
        return list(values)
    return [None if v != v else v for v in values.tolist()]


#: Frames, and tracks, that share a key or an entry of state: each takes several calls of the store.
TOGETHER = 32


class InOrder(StatefulProcessor):
    """Rows wait by frame; closed frames go through ``step`` in order.

    ``step(key, past, frame, columns)`` gives (rows, past): rows are tuples for the
    columns of ``output`` behind the keys, ``past`` is a tuple for the fields of
    ``saved``, None at the start of a key.
    """

    def __init__(self, keys: list[str], columns: list[str], saved: str, output: str, step: Callable):
        self.columns, self.saved, self.step = columns, saved, step
        self.fields = [c.split(" ")[0] for c in columns]
        self.whole = [isinstance(f.dataType, IntegralType)
                      for f in StructType.fromDDL(", ".join(columns)).fields] if columns else []
        self.names = [*keys, *_names(output), LATE]
        self.keys = len(keys)

    def init(self, handle) -> None:
        self.handle = handle
        waiting = [f"{c.split(' ', 1)[0]} array<{c.split(' ', 1)[1]}>" for c in self.columns]
        held = ", ".join(["numbers array<bigint>", "at array<bigint>", *waiting])
        self.waiting = handle.getMapState("waiting", "block bigint", held)
        self.past = handle.getValueState("past", ", ".join(["closed bigint", self.saved]))

    def _table(self, rows: list[tuple]):
        import pandas as pd

        return pd.DataFrame(rows, columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        past = self.past.get() if self.past.exists() else None
        late: dict[int, int] = {}
        first = None
        for batch in rows:
            if _absent(key):
                continue
            if past is not None:
                over = batch["frame"] <= past[0]
                for frame, many in batch["frame"][over].value_counts().items():
                    late[int(frame)] = late.get(int(frame), 0) + int(many)
                batch = batch[~over]
            for block, part in batch.groupby(batch["frame"] // TOGETHER, sort=False):
                lists = [
                    part["frame"].astype("int64").tolist(), part["at"].tolist(),
                    *(_plain(part[n], w) for n, w in zip(self.fields, self.whole, strict=True)),
                ]
                place = (int(block),)
                if self.waiting.containsKey(place):
                    lists = [[*a, *b] for a, b in zip(self.waiting.getValue(place), lists, strict=True)]
                self.waiting.updateValue(place, tuple(lists))
                least = min(lists[1])
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first)
        if late:
            none = (None,) * (len(self.names) - self.keys - 2)
            yield self._table([(*key, frame, *none, n) for frame, n in sorted(late.items())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import numpy as np

        mark = timerValues.getCurrentWatermarkInMs()
        past = self.past.get() if self.past.exists() else None
        closed = None if past is None else past[0]
        out: list[tuple] = []
        for block in sorted(k[0] for k in self.waiting.keys()):
            lists = self.waiting.getValue((block,))
            numbers, at = np.array(lists[0]), np.array(lists[1])
            frames, place = np.unique(numbers, return_inverse=True)
            # a frame is as late as its latest row
            due = np.full(len(frames), np.iinfo(np.int64).min)
            np.maximum.at(due, place, at)
            open_ = np.flatnonzero(due > mark)
            many = int(open_[0]) if len(open_) else len(frames)
            for n, frame in enumerate(frames[:many].tolist()):
                rows = np.flatnonzero(place == n)
                columns = {
                    name: np.array([values[i] for i in rows])
                    for name, values in zip(self.fields, lists[2:], strict=True)
                }
                found, saved = self.step(key, None if past is None else past[1:], frame, columns)
                past = (frame, *saved)
                out += [(*key, *r, 0) for r in found]
                if len(out) >= FLUSH_ROWS:
                    yield self._table(out)
                    out = []
            if many == len(frames):
                self.waiting.removeKey((block,))
                continue
            if many:
                rest = np.flatnonzero(place >= many)
                self.waiting.updateValue((block,), tuple([values[i] for i in rest] for values in lists))
            self.handle.registerTimer(int(due[many]))
            break
        if past is not None and past[0] != closed:
            self.past.update(tuple(past))
        if out:
            yield self._table(out)


def in_order(
    stream: DataFrame, keys: list[str], columns: list[str], saved: str, output: str, step: Callable
) -> DataFrame:
    """Frames of each key through ``step``, as the watermark closes them.

    ``output`` starts with the frame. Rows of a null first key are not kept.
    """
    use_keyed_state(stream.sparkSession)
    timed = with_event_time(stream)
    # the time as a plain number: late rows are counted here, not dropped before
    rows = timed.select(
        *keys, F.col("frame").cast("bigint").alias("frame"), *columns,
        F.coalesce(F.unix_millis("event_time"), F.lit(0)).alias("at"),
    )
    processor = InOrder(keys, _ddl(rows, columns), saved, output, step)
    schema = ", ".join([*_ddl(rows, keys), output, f"{LATE} bigint"])
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


def stream_history(frames: DataFrame, history: int) -> DataFrame:
    """Count-based sliding window over the frames of a video.

    Rows (video, frame, hist_frame, event): held for each of the ``history``
    frames before a frame, once there are as many, and evicted for the frame
    that leaves the window.
    """

    def step(key, past, frame, columns):
        held = list(past[0]) if past else []
        out = []
        # held ends with the frame before this one; it enters the window now
        if len(held) > history:
            out.append((frame, held.pop(0), "evicted"))
        if len(held) == history:
            out.extend((frame, h, "held") for h in held)
        return out, ([*held, frame],)

    output = "frame bigint, hist_frame bigint, event string"
    return in_order(frames, ["video"], [], "held array<bigint>", output, step)


def stream_dead_reckoning(
    regions: DataFrame,
    max_dist: float,
    same_threshold: float,
    legacy_order: bool = False,
    corrected: bool = False,
) -> DataFrame:
    """Dead reckoning with the last frame's boxes and the identity counter as state."""
    options = dict(
        max_dist=max_dist,
        same_threshold=same_threshold,
        legacy_order=legacy_order,
        corrected=corrected,
    )

    def step(key, saved, frame, columns):
        import numpy as np

        past = RK.Reckoning()
        if saved:
            last, counter, flat = saved
            past = RK.Reckoning(last, counter, np.array(flat, dtype=np.int64).reshape(-1, RK.WIDTH))
        rows = RK.reckon_through(past, frame, RK.corners_of(_by_ord(columns)), **options)
        return rows, (past.frame, past.counter, [int(v) for v in past.boxes.ravel()])

    saved = "frame bigint, counter bigint, boxes array<bigint>"
    return in_order(regions, ["video"], ["ord", *BOX_COLUMNS], saved, RK.OUTPUT, step)


def _by_ord(columns: dict) -> dict:
    """The rows of a frame in their order, whichever pieces they came in."""
    import numpy as np

    order = np.argsort(columns["ord"], kind="stable")
    return {name: values[order] for name, values in columns.items()}


def stream_particle_filter(
    regions: DataFrame,
    transforms: DataFrame,
    n: int = PA.PARTICLES,
    persist: bool = False,
    seed: int = 0,
    corrected: bool = False,
) -> DataFrame:
    """Particle tracks with the live particles of a video as state.

    ``transforms`` is a table; its matrices meet the stream by (video, frame). Frames
    without one are left out in their turn, not by the join, so that rows without a
    video reach the watermark.
    """

    def step(key, saved, frame, columns):
        import numpy as np

        past = PA.Filters(PA.salt_of(seed, key))
        if saved:
            past.counter, ids, flat, weights, observed = saved
            past.ids = np.array(ids, dtype=np.int64)
            past.boxes = np.array(flat, dtype=np.int64).reshape(-1, 4)
            past.weights = np.array(weights, dtype=float)
            past.observed = np.array(observed, dtype=bool)
        rows, tracks = _by_ord(columns), []
        if rows[TRANSFORM_COLUMNS[0]][0] is not None:
            tracks, _ = PA.filter_frame(
                past, frame, PA.corners_of(rows), PA.matrix_of(rows), n, persist, corrected
            )
        return tracks, (
            int(past.counter),
            [int(v) for v in past.ids],
            [int(v) for v in past.boxes.ravel()],
            [float(v) for v in past.weights],
            [bool(v) for v in past.observed],
        )

    saved = (
        "counter bigint, ids array<bigint>, boxes array<bigint>, "
        "weights array<double>, observed array<boolean>"
    )
    boxes = with_event_time(regions).select("video", "frame", "ord", *BOX_COLUMNS, "event_time")
    ready = boxes.join(
        transforms.select("video", "frame", *TRANSFORM_COLUMNS), ["video", "frame"], "left"
    )
    columns = ["ord", *BOX_COLUMNS, *TRANSFORM_COLUMNS]
    return in_order(ready, ["video"], columns, saved, PA.TRACK_OUTPUT, step)


class Confirmed(StatefulProcessor):
    """Rows of a track from the second on; the first waits until there is one.

    A key has the tracks of a block of identities. With ``forget_ms`` a track is forgotten
    when the watermark is that far past its last row.
    """

    def __init__(self, names: list[str], kept: list[str], forget_ms: int | None):
        self.names, self.kept, self.forget_ms = names, kept, forget_ms
        fields = StructType.fromDDL(", ".join(kept)).fields
        self.fields = [f.name for f in fields]
        self.whole = [isinstance(f.dataType, IntegralType) for f in fields]

    def init(self, handle) -> None:
        self.handle = handle
        kept = [f"{c.split(' ', 1)[0]} array<{c.split(' ', 1)[1]}>" for c in self.kept]
        saved = ", ".join(["seen array<boolean>", "last array<bigint>", *kept])
        self.state = handle.getValueState("tracks", saved)

    def _known(self, timerValues) -> dict:
        """Seen, last time and first row of each track that is not over."""
        if not self.state.exists():
            return {}
        return {
            first[0]: [seen, last, first] for seen, last, *first in zip(*self.state.get(), strict=True)
            if not self._over(last, timerValues)
        }

    def _keep(self, tracks: dict) -> None:
        if not tracks:
            self.state.clear()
            return
        self.state.update(tuple(map(list, zip(*((s, t, *first) for s, t, first in tracks.values()), strict=True))))
        if self.forget_ms is not None:
            self.handle.registerTimer(min(t[1] for t in tracks.values()) + self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        tracks = self._known(timerValues)
        for batch in rows:
            lists = [_plain(batch[n], w) for n, w in zip(self.fields, self.whole, strict=True)]
            out = []
            for at, *row in zip(batch["at"].tolist(), *lists, strict=True):
                track = tracks.get(row[0])
                if track is None:
                    tracks[row[0]] = [False, max(at, 0), row]
                    continue
                if not track[0]:
                    out.append((key[0], *track[2]))
                track[0], track[1] = True, max(track[1], at)
                out.append((key[0], *row))
            if out:
                yield pd.DataFrame(out, columns=self.names)
        self._keep(tracks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.state.exists():
            self._keep(self._known(timerValues))
        return iter([])

    def _over(self, last: int, timerValues) -> bool:
        if self.forget_ms is None:
            return False
        return last + self.forget_ms <= timerValues.getCurrentWatermarkInMs()


def stream_observation_hysteresis(tracks: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Observed boxes of a track from its second observation on, the first included.

    The first observation waits in state, whatever its frame, so rows may come in any
    order and none is late. With ``forget_ms`` a track is forgotten when the watermark is
    that far past its last observation; a later one is a first observation again.
    """
    use_keyed_state(tracks.sparkSession)
    keys = ["video", "identity"]
    columns = [*keys, *[n for n in tracks.columns if n not in keys]]
    processor = Confirmed(columns, _ddl(tracks, columns[1:]), forget_ms)
    seen = tracks.filter("observed")
    at = F.lit(0).cast("bigint")
    if forget_ms is not None:
        seen = with_event_time(seen)
        at = F.coalesce(F.unix_millis("event_time"), F.lit(0))
    # identities that are near come at about the same time; others are keys of their own
    block = F.col("identity")
    if isinstance(tracks.schema["identity"].dataType, IntegralType):
        block = F.floor(block / TOGETHER)
    rows = seen.select(*columns, at.alias("at"), block.alias("block"))
    return rows.groupBy("video", "block").transformWithStateInPandas(
        processor, ", ".join(_ddl(tracks, columns)), "append",
        "None" if forget_ms is None else "EventTime",
    )


def stream_pixel_hysteresis(
    mask: DataFrame,
    on_after: int,
    off_after: int | None = None,
    corrected: bool = False,
    tile: int = 64,
) -> DataFrame:
    """Pixel hysteresis with one tile of the image as a key; its run lengths are the state.

    ``mask`` has a row per pixel and frame, v 0 or 255.
    """
    off_at = off_after if corrected and off_after is not None else on_after

    def step(key, past, frame, columns):
        import numpy as np

        x, y = columns["x"].astype(np.int64), columns["y"].astype(np.int64)
        place, moving = (y << 32) + x, columns["v"] == 255
        known = np.zeros((3, len(place)), np.int64)
        held = np.zeros((4, 0), np.int64) if past is None else np.array(past, np.int64)
        at = np.minimum(np.searchsorted(held[0], place), max(held.shape[1] - 1, 0))
        if held.shape[1]:
            hit = held[0][at] == place
            known[:, hit] = held[1:, at[hit]]
        on = np.where(moving, known[0] + 1, 0)
        off = np.where(moving, 0, known[1] + 1)
        value = np.where(on == on_after, 255, np.where(off == off_at, 0, known[2]))
        # pixels without a row in this frame keep their runs
        rest = held[:, ~np.isin(held[0], place)]
        now = np.hstack([rest, np.stack([place, on, off, value])])
        now = now[:, np.argsort(now[0], kind="stable")]
        rows = zip([frame] * len(x), y.tolist(), x.tolist(), value.tolist(), strict=True)
        return rows, tuple(line.tolist() for line in now)

    tiled = mask.withColumns({
        "ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")
    })
    found = in_order(
        tiled, ["video", "ty", "tx"], ["y", "x", "v"],
        "place array<bigint>, runs_on array<bigint>, runs_off array<bigint>, value array<bigint>",
        "frame bigint, " + ", ".join(_ddl(mask, ["y", "x", "v"])), step,
    )
    return found.select("video", "y", "frame", "x", "v", LATE)


class Whole(StatefulProcessor):
    """The rows of each frame of a block, together, once the watermark has passed it."""

    def __init__(self, columns: list[str], names: list[str], keep_ms: int):
        self.columns, self.names, self.keep_ms = columns, names, keep_ms
        fields = StructType.fromDDL(", ".join(columns)).fields
        self.fields = [f.name for f in fields]
        self.whole = [isinstance(f.dataType, IntegralType) for f in fields]

    def init(self, handle) -> None:
        self.handle = handle
        # the first column is the frame
        kept = [f"{c.split(' ', 1)[0]} array<{c.split(' ', 1)[1]}>" for c in self.columns]
        self.rows = handle.getValueState("rows", ", ".join(kept))
        self.frames = handle.getValueState("frames", "number array<bigint>, at array<bigint>, closed array<boolean>")

    def _known(self) -> dict:
        """Time of each frame, and whether it is closed."""
        if not self.frames.exists():
            return {}
        return {n: (at, closed) for n, at, closed in zip(*self.frames.get(), strict=True)}

    def _keep(self, frames: dict) -> None:
        if not frames:
            self.frames.clear()
            return
        self.frames.update((list(frames), [at for at, _ in frames.values()], [c for _, c in frames.values()]))
        self.handle.registerTimer(min(at + self.keep_ms * closed for at, closed in frames.values()))

    def _waiting(self) -> list[tuple]:
        return list(zip(*self.rows.get(), strict=True)) if self.rows.exists() else []

    def _wait(self, rows: list[tuple]) -> None:
        if rows:
            self.rows.update(tuple(map(list, zip(*rows, strict=True))))
        else:
            self.rows.clear()

    def _tables(self, key, rows: list[tuple], late: int) -> Iterator:
        import pandas as pd

        for first in range(0, len(rows), FLUSH_ROWS):
            part = rows[first : first + FLUSH_ROWS]
            yield pd.DataFrame([(key[0], *r, late) for r in part], columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        mark = timerValues.getCurrentWatermarkInMs()
        frames, waiting = self._known(), []
        for batch in rows:
            if _absent(key):
                continue
            lists = [_plain(batch[n], w) for n, w in zip(self.fields, self.whole, strict=True)]
            newest: dict = {}
            for frame, at in zip(lists[0], batch["at"].tolist(), strict=True):
                newest[frame] = max(newest.get(frame, at), at)
            late = {
                frame for frame, at in newest.items()
                if frames.get(frame, (at, False))[1] or at + self.keep_ms <= mark
            }
            fresh = list(zip(*lists, strict=True))
            if late:
                yield from self._tables(key, [r for r in fresh if r[0] in late], 1)
                fresh = [r for r in fresh if r[0] not in late]
            for frame in newest.keys() - late:
                frames[frame] = (min(frames.get(frame, (newest[frame],))[0], newest[frame]), False)
            waiting += fresh
        if waiting:
            self._wait([*self._waiting(), *waiting])
        self._keep(frames)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        mark = timerValues.getCurrentWatermarkInMs()
        # of closed frames that are older than that, the age of a row alone says that it is late
        frames = {n: f for n, f in self._known().items() if not (f[1] and f[0] + self.keep_ms <= mark)}
        due = {n for n, (at, closed) in frames.items() if not closed and at <= mark}
        if due:
            held = self._waiting()
            self._wait([r for r in held if r[0] not in due])
            yield from self._tables(key, [r for r in held if r[0] in due], 0)
        self._keep({n: (at, closed or n in due) for n, (at, closed) in frames.items()})


def whole_frames(stream: DataFrame, keep_ms: int = 3_600_000) -> DataFrame:
    """All rows of a frame in one micro-batch, when the watermark closes the frame.

    A column ``late`` is 1 for rows of frames that were closed before, which come out as
    they arrive; no row is lost and none comes twice. Videos may lag behind others by
    ``keep_ms`` of event time: so long is known which frames have been closed, and rows
    older than that are late. ``TOGETHER`` frames of a video share a key.
    """
    use_keyed_state(stream.sparkSession)
    timed = with_event_time(stream)
    names = [c for c in timed.columns if c not in ("video", "frame", "event_time")]
    rows = timed.select(
        "video", "frame", *names, F.coalesce(F.unix_millis("event_time"), F.lit(0)).alias("at"),
        F.floor(F.col("frame") / TOGETHER).alias("block"),
    )
    processor = Whole(_ddl(rows, ["frame", *names]), ["video", "frame", *names, LATE], keep_ms)
    schema = ", ".join([*_ddl(rows, ["video", "frame", *names]), f"{LATE} int"])
    return rows.groupBy("video", "block").transformWithStateInPandas(
        processor, schema, "append", "EventTime"
    )
