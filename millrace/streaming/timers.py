"""State with lists and event-time timers: the top rows of each key and window, given out when the window closes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _TopRows(StatefulProcessor):
    """A list of the best rows of each open window of a key, k for a window at most, and a count of rows that came too late.

    A timer for each open window gives out its rows once the watermark has
    passed its end, and drops them.
    """

    def __init__(self, key: str, k: int, width_ms: int):
        self.key, self.k, self.width_ms = key, k, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "start long, value double, id long")
        self.late = handle.getValueState("late", "n long")

    def _keep(self, rows: dict[int, list[tuple[float, int]]]) -> None:
        flat = [(start, value, i) for start, own in sorted(rows.items()) for value, i in own]
        if flat:
            self.rows.put(flat)
        else:
            self.rows.clear()

    def _held(self) -> dict[int, list[tuple[float, int]]]:
        held: dict[int, list[tuple[float, int]]] = {}
        if self.rows.exists():
            for start, value, i in self.rows.get():
                held.setdefault(int(start), []).append((float(value), int(i)))
        return held

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Rows of earlier runs, as ``start, value, id``; their windows are open again."""
        held = self._held()
        for start, value, i in zip(initialState["start"], initialState["value"], initialState["id"], strict=True):
            held.setdefault(int(start), []).append((float(value), int(i)))
        for start in held:
            self.handle.registerTimer(start + self.width_ms)
            held[start] = sorted(held[start], key=lambda r: (-r[0], r[1]))[: self.k]
        self._keep(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, late = self._held(), 0
        watermark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            open_ = frame["start"] + self.width_ms > watermark
            late += int((~open_).sum())
            for start, value, i in zip(frame["start"][open_], frame["value"][open_], frame["id"][open_], strict=True):
                if int(start) not in held:
                    self.handle.registerTimer(int(start) + self.width_ms)
                held.setdefault(int(start), []).append((float(value), int(i)))
            for start in held:
                held[start] = sorted(held[start], key=lambda r: (-r[0], r[1]))[: self.k]
        self._keep(held)
        if late:
            before = self.late.get()[0] if self.late.exists() else 0
            self.late.update((before + late,))
            yield pd.DataFrame({self.key: [key[0]], "start": [-1], "place": [0], "id": [before + late], "value": [0.0]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.width_ms
        held = self._held()
        own = held.pop(start, [])
        self._keep(held)
        if own:
            n = len(own)
            values, ids = zip(*own, strict=True)
            yield pd.DataFrame({self.key: [key[0]] * n, "start": [start] * n, "place": range(1, n + 1), "id": ids, "value": values})

    def close(self) -> None:
        pass


def windowed_top(df: DataFrame, key: str, ts: str, value: str, id_col: str, k: int, width_ms: int, initial: DataFrame | None = None) -> DataFrame:
    """``key, start_ms, place, id, value``: the k largest values of each key and window, given out when the window closes.

    ``ts`` has the watermark. Needs :func:`millrace.streaming.windows.rocksdb_state`.
    A window of ``width_ms`` closes when the watermark passes its end; it appears once.
    State is k rows for each open window of a key. Ties go to the smaller id.

    * Rows with a null time, value or id, and NaN, are left out; a null key is a key.
    * Rows behind the watermark whose window has closed are counted, where Spark hands
      them on; the running count of a key is a row of place 0 with ``start_ms`` -1, its id the count.
    * ``initial``: rows ``key, start, value, id`` of windows that an earlier stream left open.
    """
    at = F.unix_millis(ts)
    rows = df.select(
        key, ts, (at - F.pmod(at, F.lit(width_ms))).alias("start"), F.col(value).cast("double").alias("value"), F.col(id_col).cast("long").alias("id")
    ).filter("start is not null and value is not null and not isnan(value) and id is not null")
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, start long, place long, id long, value double"
    groups = rows.groupBy(key)
    state = initial.select(key, "start", "value", "id").groupBy(key) if initial is not None else None
    found = groups.transformWithStateInPandas(_TopRows(key, k, width_ms), out, "Append", "EventTime", state)
    return found.select(key, F.col("start").alias("start_ms"), "place", F.col("id").alias(id_col), F.col("value").alias(value))
