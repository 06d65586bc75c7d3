"""Live assessment: what a well's samples say, when it is assessed again, and which alerts are new.

State is kept for each well between batches, bounded and with a time to live: a stream cut into batches anywhere gives what
one fold over the whole table gives.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from borelog.operators.sequences import in_sorted_batches

from . import detector
from .detector import Limits

#: Seconds that the detector looks back, least time between samples, metres until the next assessment, seconds until an alert is told again.
LOOK_BACK_S, LEAST_PERIOD_S, METRES, QUIET_S = 300.0, 0.5, 1.0, 120.0
#: State of a well or alert that is not touched for so long is dropped.
KEPT_MS = 6 * 3600 * 1000
SAMPLE = ["t", "torque", "spp", "hookload", "pit_vol", "flow_in"]
WATCHED = "well_id long, t timestamp, md_m double, channels array<string>, signal string"


def held(first: pd.Series, limits: Limits) -> int:
    """How many values a channel is judged by: those of the look-back at the rate of the first samples."""
    period = (first.iloc[-1] - first.iloc[0]).total_seconds() / max(1, len(first) - 1)
    return max(limits.least, int(LOOK_BACK_S / max(period, LEAST_PERIOD_S)))


def watch(rows: pd.DataFrame, state: dict | None, limits: Limits = Limits(), metres: float = METRES) -> tuple[pd.DataFrame, dict]:
    """The samples of one well at which it is assessed: the bit is ``metres`` or more from the last such place, or something is abnormal.

    The first ``limits.least`` samples, before which nothing can be abnormal, set how far the detector looks back."""
    state = state or {"first": [], "held": None, "judged": None, "last": None}
    rows = rows.sort_values("t", kind="stable").reset_index(drop=True)
    waiting = pd.DataFrame([[pd.Timestamp(t, unit="us"), *values] for t, *values in state["first"]], columns=SAMPLE)
    given = pd.concat([waiting, rows[SAMPLE]], ignore_index=True) if len(waiting) else rows[SAMPLE]
    size, judged, first = state["held"], state["judged"], state["first"]
    abnormal: dict[int, tuple] = {}
    if size is None and len(given) >= limits.least:
        size = held(given["t"].iloc[: limits.least], limits)
    if size is not None:
        out, judged = detector.judge(given.assign(well_id=0), judged, dataclasses.replace(limits, held=size))
        abnormal = {i - len(waiting): (r.channels, r.signal) for i, r in zip(out.index, out.itertuples(), strict=True)}
        first = []
    else:
        first = [[int(t.value // 1000), *[None if pd.isna(v) else float(v) for v in values]] for t, *values in given.itertuples(index=False)]
    last, kept = state["last"], []
    for i, md in enumerate(rows["md_m"].tolist()):
        if not pd.isna(md) and (last is None or abs(md - last) >= metres or i in abnormal):
            kept.append(i)
            last = md
    out = rows.loc[kept, ["well_id", "t", "md_m"]].reset_index(drop=True)
    out["channels"] = [list(abnormal.get(i, ([], None))[0]) for i in kept]
    out["signal"] = pd.Series([abnormal.get(i, ([], None))[1] for i in kept], dtype=object)
    return out, {"first": first, "held": size, "judged": judged, "last": last}


def quiet(times: pd.Series, last: float | None, seconds: float = QUIET_S) -> tuple[list[bool], float | None]:
    """Which of one alert's times are told: those ``seconds`` or more after the last one told."""
    mask = []
    for t in times:
        at = t.timestamp()
        mask.append(last is None or at - last >= seconds)
        last = at if mask[-1] else last
    return mask, last


class Watch(StatefulProcessor):
    """``watch`` with a well's state in the store."""

    def __init__(self, limits: Limits, metres: float, kept_ms: int):
        self.limits, self.metres, self.kept_ms = limits, metres, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("well", "state string", self.kept_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get()
        out, after = watch(pd.concat(list(rows)), json.loads(before[0]) if before else None, self.limits, self.metres)
        self.state.update((json.dumps(after),))
        yield out

    def close(self) -> None:
        pass


class Quiet(StatefulProcessor):
    """When each alert of a well was told last."""

    def __init__(self, columns: list[str], seconds: float, kept_ms: int):
        self.columns, self.seconds, self.kept_ms = columns, seconds, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getMapState("told", "hazard string, formation string, level string", "at double", self.kept_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for alert, same in pd.concat(list(rows)).sort_values("t", kind="stable").groupby(["hazard", "formation", "level"], sort=False):
            last = self.told.getValue(alert) if self.told.containsKey(alert) else None
            mask, at = quiet(same["t"], last[0] if last else None, self.seconds)
            if any(mask):
                self.told.updateValue(alert, (at,))
                yield same.loc[mask, self.columns]

    def close(self) -> None:
        pass


def alerts(samples: DataFrame, layers: DataFrame, limits: Limits = Limits(), metres: float = METRES, seconds: float = QUIET_S, kept_ms: int = KEPT_MS, reach: float = 150.0) -> DataFrame:
    """A stream of new alerts from a stream of samples (well_id, t, md_m, torque, spp, hookload, pit_vol, flow_in) and a table of ``layers`` (see ``detector.look_ahead``).

    Two keyed states follow each other: the detector with the last assessed depth, and the last telling of each (problem,
    layer, level). The session needs the RocksDB state store, and a trigger that goes on (state with a time to live never has
    its last batch, so ``availableNow`` would not end)."""
    watched = samples.groupBy("well_id").transformWithStateInPandas(Watch(limits, metres, kept_ms), WATCHED, "append", "processingTime")
    ahead = detector.look_ahead(watched, layers, reach)
    return ahead.groupBy("well_id").transformWithStateInPandas(Quiet(ahead.columns, seconds, kept_ms), ahead.schema, "append", "processingTime")


def alerts_batch(samples: DataFrame, layers: DataFrame, limits: Limits = Limits(), metres: float = METRES, seconds: float = QUIET_S, reach: float = 150.0) -> DataFrame:
    """The same over a table: each well's and each alert's rows in order, a batch at a time."""
    watched = in_sorted_batches(samples, ["well_id"], ["t"], lambda rows, state: watch(rows, state, limits, metres), WATCHED)
    return cool_down(detector.look_ahead(watched, layers, reach), seconds)


def cool_down(alerts: DataFrame, seconds: float = QUIET_S) -> DataFrame:
    """Alerts (well_id, hazard, formation, level, t) without those that come within ``seconds`` of the last one kept of their kind."""

    def keep(rows: pd.DataFrame, last: float | None) -> tuple[pd.DataFrame, float | None]:
        mask, last = quiet(rows["t"], last, seconds)
        return rows[mask], last

    return in_sorted_batches(alerts, ["well_id", "hazard", "formation", "level"], ["t"], keep, alerts.schema)
