"""Keyed stream processors that see the rows of a key in the order of time (inventory STR3, STR4).

Rows of a key reach a micro-batch in any order and in several Arrow pieces. Without a watermark they are put in order inside each micro-batch; many rows of one key are
sorted in runs that wait in the state store. With a watermark rows wait in the state, in sorted entries known by their first time bucket, until the watermark has passed their bucket
(a key has one timer and a few entries, whatever the number of its buckets), so scores do not depend on the file an event came in; rows later than the watermark
are dropped, and a key that was silent for long leaves the state.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect.cluster import window_rows
from ..operators.detect.density import hbos_points

HELD_ROWS = 1 << 20
WAITING_ROWS = 1024
FOREVER = int(np.iinfo(np.int64).max)
FRESH = (0, 0, FOREVER, FOREVER)


def event_type(width: int = 1) -> np.dtype:
    """A row in the state: time, id (which may be missing) and values."""
    return np.dtype([("ts", "i8"), ("event_id", "i8"), ("nameless", "?"), ("value", "f8", (width,))])


EVENT = event_type()


def ordered(events: np.ndarray) -> np.ndarray:
    return events[np.lexsort((events["event_id"], events["nameless"], events["ts"]))]


def _rank(event) -> tuple:
    return event["ts"], event["nameless"], event["event_id"]


def in_time_order(pieces: Iterator[np.ndarray], held: int = HELD_ROWS, store=None) -> Iterator[np.ndarray]:
    """All events of ``pieces`` in the order of (ts, event_id), as blocks; about ``held`` events are in memory at a time.

    More events than that are sorted in runs, kept in ``store`` (a mapping of (run, block) to bytes, such as map state) and merged: every run shows its next
    block, and events up to the smallest last one shown are next, because no run hides an earlier one.
    """
    store = {} if store is None else store
    step, sizes, buffer, size, dtype = max(held // 64, 1), [], [], 0, EVENT
    for piece in pieces:
        dtype = piece.dtype
        buffer.append(piece)
        size += len(piece)
        if size >= held:
            run = ordered(np.concatenate(buffer))
            for k in range(0, len(run), step):
                store[len(sizes), k // step] = run[k:k + step].tobytes()
            sizes.append(-(-len(run) // step))
            buffer, size = [], 0
    rest = ordered(np.concatenate(buffer)) if buffer else np.empty(0, dtype)
    if not sizes:
        yield rest
        return
    at = [0] * len(sizes)
    shown = [np.empty(0, dtype) for _ in sizes] + [rest]
    while True:
        for i, n in enumerate(sizes):
            if not len(shown[i]) and at[i] < n:
                shown[i] = np.frombuffer(store[i, at[i]], dtype)
                del store[i, at[i]]
                at[i] += 1
        hiding = [_rank(shown[i][-1]) for i, n in enumerate(sizes) if at[i] < n]
        if not hiding:
            yield ordered(np.concatenate(shown))
            return
        last, ready = min(hiding), []
        for i, events in enumerate(shown):
            n = bisect.bisect_right(events, last, key=_rank)
            ready.append(events[:n])
            shown[i] = events[n:]
        yield ordered(np.concatenate(ready))


class _Runs:
    """Map state of the current key as a mapping."""

    def __init__(self, state):
        self.state = state

    def __setitem__(self, key, value):
        self.state.updateValue(key, (value,))

    def __getitem__(self, key):
        return bytes(self.state.getValue(key)[0])

    def __delitem__(self, key):
        self.state.removeKey(key)


class InOrder(StatefulProcessor):
    """Hands the rows of a key in order to ``score(key, events)``, which yields the output frames.

    ``bucket`` (seconds) switches to event time: the input then needs a watermark on ``order``. Rows without a time are left out there, elsewhere they come last. A key
    without rows for more than ``forget`` seconds of event time starts anew, and leaves the state once the watermark is that far.
    """

    def __init__(self, order: str, name: str, values: Sequence[str], held: int = HELD_ROWS, bucket: int | None = None, forget: int | None = None):
        self.order, self.name, self.values, self.held, self.bucket, self.forget = order, name, list(values), held, bucket, forget
        self.blocks = False  # rows come as they are, not by in_blocks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run long, block long", "rows binary")
        if self.bucket:
            self.waiting = handle.getMapState("waiting", "bucket long, part long", "rows binary")
            self.mark = handle.getValueState("mark", "parts long, latest long, last long, due long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declare further state."""

    def score(self, key, events: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def leave(self) -> None:
        """Clear the state of a key that is forgotten."""

    def packed(self, pdf: pd.DataFrame) -> np.ndarray:
        out = np.empty(len(pdf), event_type(len(self.values)))
        when = pdf[self.order]
        if pd.api.types.is_datetime64_any_dtype(when):
            out["ts"] = np.where(when.isna(), FOREVER, when.to_numpy().astype("datetime64[us]").astype(np.int64))
        else:
            out["ts"] = when.astype("Int64").fillna(FOREVER).to_numpy(dtype=np.int64)
        out["nameless"] = pdf[self.name].isna()
        out["event_id"] = pdf[self.name].fillna(0).to_numpy().astype(np.int64)
        out["value"] = pdf[self.values].to_numpy(dtype=float)
        return out

    def names(self, events: np.ndarray):
        ids = pd.array(events["event_id"], dtype="Int64")
        ids[events["nameless"]] = pd.NA
        return ids

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind = event_type(len(self.values))
        pieces = (piece for pdf in rows for piece in ([np.frombuffer(b, kind) for b in pdf["rows"]] if self.blocks else [self.packed(pdf)]))
        if not self.bucket:
            yield from self.score(key, in_time_order(pieces, self.held, _Runs(self.runs)))
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        parts, latest, last, due = self.mark.get() or FRESH
        first = due
        for events in pieces:
            events = events[(events["ts"] != FOREVER) & (events["ts"] >= watermark * 1000)]
            if len(events):
                parts, end = self._keep(events, parts)
                first, latest = min(first, end), max(latest, self._end(int(events["ts"].max()) // (self.bucket * 1_000_000)))
        self._alarm(due, first)
        self.mark.update((parts, latest, last, first))

    def _end(self, bucket: int) -> int:
        """Milliseconds at which a bucket ends."""
        return (bucket + 1) * self.bucket * 1000

    def _alarm(self, due: int, first: int) -> None:
        """A key has one timer, for its first waiting bucket."""
        if first < due:
            if due != FOREVER:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)

    def _keep(self, events: np.ndarray, parts: int) -> tuple[int, int]:
        """Put events into the state in time order, some rows in an entry known by its first bucket; the next part and the end of the first bucket."""
        events = events[np.argsort(events["ts"], kind="stable")]
        for lo in range(0, len(events), WAITING_ROWS):
            piece = events[lo:lo + WAITING_ROWS]
            self.waiting.updateValue((int(piece["ts"][0]) // (self.bucket * 1_000_000), parts), (piece.tobytes(),))
            parts += 1
        return parts, self._end(int(events["ts"][0]) // (self.bucket * 1_000_000))

    def _due(self, watermark: int, early: list[np.ndarray], ends: list[int]) -> Iterator[np.ndarray]:
        """The events of every bucket that the watermark has passed. What an entry holds beyond goes to ``early``, the first ends of entries that stay to ``ends``."""
        passed = watermark // (self.bucket * 1000)
        found = sorted((b, part) for b, part in self.waiting.keys())
        ends.extend(self._end(b) for b, _ in found if b >= passed)
        for b, part in found:
            if b < passed:
                events = np.frombuffer(bytes(self.waiting.getValue((b, part))[0]), event_type(len(self.values)))
                n = int(np.searchsorted(events["ts"], passed * self.bucket * 1_000_000))
                if n < len(events):
                    early.append(events[n:])
                yield events[:n]
                self.waiting.removeKey((b, part))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark, early, ends = timerValues.getCurrentWatermarkInMs(), [], []
        parts, latest, last, due = self.mark.get() or FRESH
        blocks = in_time_order(self._due(watermark, early, ends), self.held, _Runs(self.runs))
        if self.forget is None:
            yield from self.score(key, blocks)
        else:
            for block in blocks:
                if not len(block):
                    continue
                gaps = np.flatnonzero(np.diff(block["ts"], prepend=min(last, block["ts"][0])) > self.forget * 1_000_000)
                for piece in np.split(block, gaps):
                    if len(piece):
                        if len(gaps) and piece["ts"][0] in block["ts"][gaps]:
                            self.leave()
                        yield from self.score(key, iter([piece]))
                last = int(block["ts"][-1])
        if early:
            parts, end = self._keep(np.concatenate(early), parts)
            ends.append(end)
        first = min(ends, default=FOREVER)
        if not ends and self.forget is not None:
            if watermark > latest + self.forget * 1000:
                self.mark.clear()
                self.leave()
                return
            first = latest + self.forget * 1000 + 1
        if expiredTimerInfo.getExpiryTimeInMs() >= due:  # this timer was the key's, it is gone after this call
            due = FOREVER
        self._alarm(due, first)
        self.mark.update((parts, latest, last, first))

    def close(self) -> None:
        pass


def in_blocks(events: DataFrame, key: str, processor: InOrder) -> DataFrame:
    """``key, rows``: the rows that a task reads of a key, packed some thousands at a time. A stateful operator takes its input apart row by row in Python, in one task for a key."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                code, _ = pd.factorize(pdf[key], use_na_sentinel=False)
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                blocks = np.split(processor.packed(pdf)[order], first[1:])
                yield pdf[[key]].iloc[order[first]].assign(rows=[b.tobytes() for b in blocks])

    processor.blocks = True
    columns = dict.fromkeys([key, processor.order, processor.name, *processor.values])
    return events.select(*columns).mapInPandas(pack, f"`{key}` {events.schema[key].dataType.simpleString()}, rows binary")


class RunningScore(InOrder):
    """z-score of every event against the earlier events of its key, and against its last ``width`` values.

    State per key: count, mean, sum of squared deviations, and the last values.
    """

    def __init__(self, width: int = 20, held: int = HELD_ROWS, bucket: int | None = None, forget: int | None = None):
        super().__init__("ts", "event_id", ["value"], held, bucket, forget)
        self.width = width

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", "n long, mean double, m2 double, last binary")

    def leave(self) -> None:
        self.moments.clear()

    def score(self, key, events: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        n, mean, m2, recent = self.moments.get() or (0, 0.0, 0.0, b"")
        recent = np.frombuffer(bytes(recent))
        before = n
        for block in events:
            if not len(block):
                continue
            x = block["value"][:, 0]
            # Prefix sums about the mean so far keep the digits of values far from zero.
            centre = mean if n else x[0]
            d = x - centre
            shift = n * (mean - centre)
            k = n + np.arange(len(x) + 1)
            s1 = shift + np.concatenate([[0.0], np.cumsum(d)])
            s2 = m2 + shift * (mean - centre) + np.concatenate([[0.0], np.cumsum(d * d)])
            safe = np.maximum(k, 1)
            mu, var = s1 / safe, np.maximum(s2 / safe - (s1 / safe) ** 2, 0)
            sd = np.sqrt(np.where(var > 1e-13 * np.maximum(s2 / safe, 1e-300), var, 0))
            z = np.divide(d - mu[:-1], sd[:-1], out=np.zeros_like(x), where=sd[:-1] > 0)
            line = np.concatenate([np.full(self.width - len(recent), np.nan), recent, x])
            view = np.lib.stride_tricks.sliding_window_view(line, self.width)[: len(x)]
            some = ~np.isnan(view).all(1)
            local, at = np.zeros_like(x), np.flatnonzero(some)
            spread, middle = np.nanstd(view[at], axis=1), np.nanmean(view[at], axis=1)
            local[at] = np.divide(x[at] - middle, spread, out=np.zeros(len(at)), where=spread > 0)
            n, mean, m2 = int(k[-1]), float(centre + mu[-1]), float(var[-1] * k[-1])
            recent = np.concatenate([recent, x])[-self.width :]
            yield pd.DataFrame({"key": str(key[0]), "event_id": self.names(block), "z": z, "local_z": local})
        if n > before:
            self.moments.update((n, mean, m2, recent.tobytes()))


def running_scores(events: DataFrame, key: str = "user_id", width: int = 20, held: int = HELD_ROWS, late: str | None = None, bucket: int = 600, forget: int | None = None) -> DataFrame:
    """(key, event_id, z, local_z) of every event; needs the RocksDB state store.

    Without ``late`` the events that a micro-batch has of a key are scored in time order. With ``late``, the delay of the watermark, an event is scored once the watermark has
    passed its bucket of ``bucket`` seconds, in time order over all micro-batches; later ones are dropped.
    """
    out = "key string, event_id long, z double, local_z double"
    if late is None:
        return events.groupBy(key).transformWithStateInPandas(RunningScore(width, held), out, "append", "none")
    return events.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(RunningScore(width, held, bucket, forget), out, "append", "EventTime")


class WindowScore(InOrder):
    """Scores of the windows that end at each row, by a model in the state of its key; the last rows wait there for the next micro-batch.

    The model of a key comes with the initial state, as ``version`` and JSON, and stays as it is. A key without a model has NULL scores.
    """

    def __init__(self, kind: str, window: int, normalise: bool, order: str, name: str, values: Sequence[str], **time):
        super().__init__(order, name, values, **time)
        self.kind, self.window, self.normalise = kind, window, normalise

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "version long, model string")
        self.ring = handle.getValueState("ring", "rows binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        newest = initialState.sort_values("version").iloc[-1]
        self.model.update((int(newest["version"]), str(newest["model"])))

    def leave(self) -> None:
        """The model stays; windows do not reach over a long silence."""
        self.ring.clear()

    def score(self, key, events: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        kept = np.frombuffer(bytes(self.ring.get()[0]), event_type(len(self.values))) if self.ring.exists() else np.empty(0, event_type(len(self.values)))
        version, judge = None, None
        if self.model.exists():
            version, text = self.model.get()
            judge = SCORES[self.kind](json.loads(text))
        seen = False
        for block in events:
            if not len(block):
                continue
            seen, line = True, np.concatenate([kept, block])
            kept = line[max(len(line) - self.window + 1, 0):]
            if len(line) < self.window:
                continue
            view = np.lib.stride_tricks.sliding_window_view(line["value"], self.window, axis=0).transpose(0, 2, 1)
            ends = line[self.window - 1:]
            for lo in range(0, len(view), 4096):
                part = view[lo:lo + 4096]
                score = np.full(len(part), np.nan) if judge is None else judge(window_rows(part, self.normalise))
                yield pd.DataFrame({"key": str(key[0]), "event_id": self.names(ends[lo:lo + 4096]), "score": pd.array(score, dtype="Float64"), "version": pd.array([version] * len(part), dtype="Int64")})
        if seen:
            self.ring.update((kept.tobytes(),))


def _centre_distance(model: dict) -> Callable:
    centres = np.asarray(model["centres"], float).reshape(int(model["k"]), -1)

    def score(x: np.ndarray) -> np.ndarray:
        d2 = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
        return np.sqrt(((x - centres[d2.argmin(1)]) ** 2).sum(1))

    return score


def _histograms(model: dict) -> Callable:
    parts = sorted(model["elements"], key=lambda e: e["channel"])
    return lambda x: -sum(hbos_points(x[:, i], e["lo"], e["hi"], np.asarray(e["logd"], float)) for i, e in enumerate(parts))


SCORES = {"centres": _centre_distance, "histograms": _histograms}


def centre_models(model: DataFrame, key: str, version: int = 1) -> DataFrame:
    """``kmeans_fit`` models as ``key, version, model``."""
    return model.select(F.col(key), F.lit(version).cast("long").alias("version"), F.to_json(F.struct("k", "centres")).alias("model"))


def histogram_models(model: DataFrame, key: str, version: int = 1) -> DataFrame:
    """``hbos_fit`` models, a row for each element of the window, as one row ``key, version, model`` for each key."""
    elements = F.sort_array(F.collect_list(F.struct("channel", "lo", "hi", "logd"))).alias("elements")
    return model.groupBy(key).agg(elements).select(F.col(key), F.lit(version).cast("long").alias("version"), F.to_json(F.struct("elements")).alias("model"))


def score_windows(
    events: DataFrame, models: DataFrame, kind: str, window: int, values: Sequence[str] = ("value",), key: str = "event_type", order: str = "ts", name: str = "event_id",
    normalise: bool = True, held: int = HELD_ROWS, late: str | None = None, bucket: int = 600, forget: int | None = None,
) -> DataFrame:
    """(key, event_id, score, version): the window of ``window`` rows of a key that ends at each row, scored by the key's frozen model.

    ``kind`` is ``centres`` (distance to the nearest centre) or ``histograms`` (minus the sum of log densities). ``models`` has ``key, version, model``; the newest version counts.
    Windows run over micro-batches: the last ``window - 1`` rows of a key wait in its state. Order and lateness are those of :func:`running_scores`.
    """
    if kind not in SCORES:
        raise ValueError(f"kind must be one of {sorted(SCORES)}")
    out, initial = "key string, event_id long, score double, version long", models.groupBy(key)
    time = {"held": held} if late is None else {"held": held, "bucket": bucket, "forget": forget}
    processor = WindowScore(kind, window, normalise, order, name, list(values), **time)
    if late is None:
        return in_blocks(events, key, processor).groupBy(key).transformWithStateInPandas(processor, out, "append", "none", initial)
    return events.withWatermark(order, late).groupBy(key).transformWithStateInPandas(processor, out, "append", "EventTime", initial)
