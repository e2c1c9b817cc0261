"""Strictly-before history of each cell on a stream: the batch operator's features, row by row.

An event waits until the watermark has passed it, so that all earlier ones are there, and is then given its
features; the events of one instant do not see each other. Events older than the watermark of the
batch before the one they come in are late and dropped, by Spark; no earlier event than one
already given out is ever taken in. State of a cell is its waiting events, sums by instant of
the last ``days``, and three numbers on all it ever saw (for the mean gap). A timer wakes the cell for
its next waiting event, or, without any, when its last instant leaves the frame, and clears what has left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skygrid.operators.temporal import DAY

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = ["id", "cell", "at_us", "prior_count", "prior_count_short", "night_fraction", "value_variance", "mean_gap_days"]
#: Sums of an instant: rows, rows with a value, their sum and sum of squares, rows of known night, those at night.
_SUMS = "n bigint, k bigint, s double, q double, known bigint, night bigint"


def instant_sums(rows: pd.DataFrame) -> dict[int, np.ndarray]:
    """Sums by instant (``at_us``) of rows with value and night, either of which may be missing."""
    v, known = rows["value"].astype(float), rows["night"].notna()
    parts = pd.DataFrame({"at": rows["at_us"], "n": 1, "k": v.notna(), "s": v.fillna(0.0), "q": (v * v).fillna(0.0), "known": known, "night": rows["night"].eq(True)}).astype({"k": float, "known": float, "night": float})
    return {int(at): np.array(x) for at, *x in parts.groupby("at").sum().itertuples()}


def features(at: np.ndarray, sums: dict[int, np.ndarray], total: tuple[int, int, int] | None, days: int, short: int) -> pd.DataFrame:
    """Features of events at the instants ``at`` from all sums of the frame; total: (rows, first, last) before those.

    ``sums`` holds the instants of the state and the new ones; total covers the state only.
    """
    keys = np.array(sorted(sums), np.int64)
    upto = np.concatenate([np.zeros((1, 6)), np.cumsum([sums[k] for k in keys], axis=0)]) if len(keys) else np.zeros((1, 6))
    place = lambda t: np.searchsorted(keys, t, "left")
    recent, brief = upto[place(at)] - upto[place(at - days * DAY)], upto[place(at)] - upto[place(at - short * DAY)]
    n, k, s, q, known, night = recent.T
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = np.where(k >= 2, np.maximum(q / k - (s / k) ** 2, 0.0), np.nan)
        share = np.where(known > 0, night / known, np.nan)
    old, first, last = total or (0, None, None)
    new = np.array([x for x in keys if total is None or x > last], np.int64)
    count = np.concatenate([[0], np.cumsum([sums[x][0] for x in new])]) if len(new) else np.zeros(1)
    spot = np.searchsorted(new, at, "left")
    seen = old + count[spot]
    begin = np.full(len(at), first if total else (new[0] if len(new) else 0), np.int64)
    end = np.array([new[i - 1] if i else (last if total else 0) for i in spot], np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.where(seen >= 2, (end - begin) / DAY / (seen - 1), np.nan)
    return pd.DataFrame({"prior_count": n.astype(np.int64), "prior_count_short": brief[:, 0].astype(np.int64), "night_fraction": share, "value_variance": variance, "mean_gap_days": gap})


class _History(StatefulProcessor):
    def __init__(self, days: int, short: int) -> None:
        self.days, self.short = days, short

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id bigint, at_us bigint, value double, night boolean")
        self.frame = handle.getMapState("frame", "at_us bigint", _SUMS)
        self.total = handle.getValueState("total", "n bigint, first bigint, last bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        for part in rows:
            clean = part[["id", "at_us", "value", "night"]].astype(object).where(part[["id", "at_us", "value", "night"]].notna(), None)
            self.waiting.appendList([(int(i), int(a), None if v is None else float(v), None if x is None else bool(x)) for i, a, v, x in clean.itertuples(index=False)])
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _release(self, key: tuple, watermark_ms: int) -> Iterator[pd.DataFrame]:
        passed = watermark_ms * 1000
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["id", "at_us", "value", "night"])
        ready = held[held["at_us"] < passed].sort_values(["at_us", "id"])
        rest = held[held["at_us"] >= passed]
        state = {k[0]: np.array(v, float) for k, v in self.frame.iterator()}
        total = tuple(self.total.get()) if self.total.exists() else None
        last = total[2] if total else None
        if len(ready):
            own = instant_sums(ready)
            both = state | own
            at = ready["at_us"].to_numpy(np.int64)
            out = features(at, both, total, self.days, self.short)
            out.insert(0, "id", ready["id"].to_numpy(np.int64))
            out.insert(1, "cell", [key[0]] * len(out))
            out.insert(2, "at_us", at)
            last = int(at.max())
            self.total.update(((total[0] if total else 0) + len(ready), total[1] if total else int(at.min()), last))
            for k, v in own.items():
                self.frame.updateValue((k,), (int(v[0]), int(v[1]), float(v[2]), float(v[3]), int(v[4]), int(v[5])))
            state = both
            if len(rest):
                self.waiting.put([tuple(r) for r in rest.astype(object).where(rest.notna(), None).itertuples(index=False)])
            else:
                self.waiting.clear()
            yield out[_OUT]
        for k in state:
            if k < passed - self.days * DAY:  # no event to come can see it
                self.frame.removeKey((k,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(rest):
            self.handle.registerTimer(int(rest["at_us"].min()) // 1000 + 1)
        elif last is not None and last >= passed - self.days * DAY:
            self.handle.registerTimer((last + self.days * DAY) // 1000 + 1)


def recurrence_stream(stream: DataFrame, ident: str, cell: str, at: str, value: str, night: str, days: int, short: int, late: str = "1 hour") -> DataFrame:
    """(id, cell, ts, features) of each event of a stream, as ``temporal.recurrence`` gives them on a table.

    Events without a time or cell are left out. ``late``: how far behind the newest event one may come.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)  # the only store with maps and timers
    rows = stream.where(F.col(at).isNotNull() & F.col(cell).isNotNull()).withWatermark(at, late)
    rows = rows.select(F.col(ident).cast("long").alias("id"), F.col(cell).cast("string").alias("cell"), F.col(at), F.unix_micros(at).alias("at_us"), F.col(value).cast("double").alias("value"), F.col(night).alias("night"))
    out = rows.groupBy("cell").transformWithStateInPandas(_History(days, short), "id bigint, cell string, at_us bigint, prior_count bigint, prior_count_short bigint, night_fraction double, value_variance double, mean_gap_days double", "Append", "EventTime")
    return out.select("id", "cell", F.timestamp_micros("at_us").alias("ts"), *(F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in _OUT[5:] else F.col(c) for c in _OUT[3:]))
