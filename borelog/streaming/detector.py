"""Anomaly detection and look-ahead on live samples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from borelog.operators.sequences import in_sorted_batches

#: The channels that are judged by themselves, and the two signals of the pit's volume.
CHANNELS = ("torque", "spp", "hookload")
LOSSES, INFLUX = "possible_losses", "possible_influx"
OUT = "well_id long, t timestamp, channels array<string>, signal string, stale boolean"
STATE = "tails array<array<double>>, runs array<int>, pit double, sums array<double>, seen double"


@dataclass(frozen=True)
class Limits:
    """How many values a channel is judged by, how far off is far, for how many samples, and the slack and limit of the pit's sums."""

    held: int = 60
    least: int = 20
    far: float = 3.5
    persist: int = 3
    slack: float = 0.5
    alarm: float = 5.0
    min_flow: float = 100.0


def scores(tail: np.ndarray, values: np.ndarray, limits: Limits) -> np.ndarray:
    """The robust z of each value against up to ``held`` values before it (``tail`` comes before the first); NaN while these are too few or do not vary."""
    every = np.concatenate([np.full(limits.held - len(tail), np.nan), tail, values])
    before = np.lib.stride_tricks.sliding_window_view(every, limits.held)[: len(values)]
    out = np.full(len(values), np.nan)
    known = np.flatnonzero((~np.isnan(before)).sum(1) >= limits.least)
    for part in np.array_split(known, len(known) // 20_000 + 1):
        if len(part):
            middle = np.nanmedian(before[part], axis=1)
            spread = 1.4826 * np.nanmedian(np.abs(before[part] - middle[:, None]), axis=1)
            out[part] = np.where(spread > 1e-9, (values[part] - middle) / np.where(spread > 1e-9, spread, 1), np.nan)
    return out


def run_lengths(far: np.ndarray, ends: np.ndarray, before: int) -> np.ndarray:
    """At each place how many ``far`` there are since the last end of a run, which goes before it; ``before`` came earlier."""
    total = np.cumsum(far)
    base = np.maximum.accumulate(np.where(ends, total - far, -before))
    return total - base


def sum_alarms(x: np.ndarray, sums: list[float], limits: Limits) -> tuple[np.ndarray, list[float]]:
    """-1 where the sum of drops passes the alarm, 1 where that of gains does, else 0; and both sums at the end.

    A sum that is never below zero is the plain sum less its least value so far. The one that passes starts anew."""
    out = np.zeros(len(x), np.int8)
    state = {-1: sums[0], 1: sums[1]}
    at = {-1: 0, 1: 0}
    paths = {}

    def go(sign: int) -> int:
        """Where the sum of one sign passes next, if at all."""
        path = np.concatenate([[state[sign]], sign * x[at[sign] :] - limits.slack]).cumsum()
        paths[sign] = (path - np.minimum(np.minimum.accumulate(path), 0))[1:]
        passed = np.flatnonzero(paths[sign] > limits.alarm)
        return at[sign] + int(passed[0]) if len(passed) else len(x)

    nexts = {sign: go(sign) for sign in (-1, 1)}
    while (first := min(nexts.values())) < len(x):
        sign = -1 if nexts[-1] == first else 1
        if not out[first]:
            out[first] = sign
            state[sign], at[sign] = 0.0, first + 1
            nexts[sign] = go(sign)
        else:  # both pass at once: drops are told, gains keep their sum and pass again at the next sample that leaves them above
            state[sign], at[sign] = float(paths[sign][first - at[sign]]), first + 1
            nexts[sign] = go(sign)
    return out, [float(paths[s][-1]) if len(paths[s]) else state[s] for s in (-1, 1)]


def judge(rows: pd.DataFrame, state: tuple | None, limits: Limits) -> tuple[pd.DataFrame, tuple]:
    """The samples of one well, in order of time, that are abnormal (the index says which), and the state after them; the state's size is fixed.

    Samples without circulation are no evidence and are not held: they only end runs and tell the pit's volume. A channel's
    missing value leaves its run as it is."""
    tails, runs, pit, sums, seen = state or ([[]] * (len(CHANNELS) + 1), [0] * len(CHANNELS), None, [0.0, 0.0], 0.0)
    rows = rows.sort_values("t", kind="stable").reset_index(drop=True)
    flow = rows["flow_in"].to_numpy(float, na_value=np.nan)
    on = np.nan_to_num(flow) >= limits.min_flow
    hits = np.zeros((len(rows), len(CHANNELS)), bool)
    new_tails, new_runs = [], []
    for k, name in enumerate(CHANNELS):
        value = rows[name].to_numpy(float, na_value=np.nan)
        used = on & ~np.isnan(value)
        z = np.full(len(rows), np.nan)
        z[used] = scores(np.array(tails[k], float), value[used], limits)
        far = np.nan_to_num(np.abs(z)) >= limits.far
        length = run_lengths(far.astype(np.int64), ~on | (~np.isnan(z) & ~far), runs[k])
        hits[:, k] = far & (length >= limits.persist)
        new_tails.append([*tails[k], *value[used][-limits.held :].tolist()][-limits.held :])
        new_runs.append(int(length[-1]) if len(rows) else runs[k])
    volume = rows["pit_vol"].astype(float)
    before = volume.ffill().shift(fill_value=np.nan)
    before = before.fillna(np.nan if pit is None else pit).to_numpy()
    change = np.where(on, volume.to_numpy() - before, np.nan)
    used = ~np.isnan(change)
    held = np.array(tails[-1], float)
    x = scores(held, change[used], limits)
    ready = np.arange(len(held), len(held) + len(x)) >= limits.least
    # Values that do not vary have no spread; any change is then beyond measure.
    base = np.concatenate([held, change[used]])
    for i in np.flatnonzero(ready & np.isnan(x)):
        at = len(held) + i
        x[i] = (base[at] - np.median(base[max(0, at - limits.held) : at])) / 1e-6
    signs, sums = sum_alarms(x[ready], sums, limits)
    sign = np.zeros(len(rows), np.int8)
    sign[np.flatnonzero(used)[ready]] = signs
    new_tails.append([*tails[-1], *change[used][-limits.held :].tolist()][-limits.held :])
    told = volume.dropna()
    pit = float(told.iloc[-1]) if len(told) else pit
    some = np.flatnonzero(hits.any(1) | (sign != 0))
    named = [[*np.array(CHANNELS)[hits[i]].tolist(), *["pit_vol"] * bool(sign[i])] for i in some]
    signal = [{-1: LOSSES, 1: INFLUX}.get(int(sign[i])) for i in some]
    out = pd.DataFrame({"well_id": rows["well_id"].to_numpy()[some], "t": rows["t"].to_numpy()[some], "channels": named, "signal": pd.Series(signal, dtype=object, index=some), "stale": False}, index=some)
    seen = rows["t"].iloc[-1].timestamp() if len(rows) else seen
    return out, (new_tails, new_runs, pit, sums, seen)


def detect(samples: DataFrame, watermark: str | None = "10 minutes", stale_ms: int = 120_000, limits: Limits = Limits()) -> DataFrame:
    """A stream of anomalies from a stream of samples (well_id, t, torque, spp, hookload, pit_vol, flow_in).

    State is kept for each well: bounded tails, sums and runs. A well that is silent for ``stale_ms`` gets a stale row and
    its state is dropped. Rows of a batch are taken in order of time, all at once."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[4]
            state.remove()
            yield pd.DataFrame({"well_id": [key[0]], "t": [pd.Timestamp(last, unit="s")], "channels": [[]], "signal": [None], "stale": [True]})
            return
        out, after = judge(pd.concat(list(frames)), state.get if state.exists else None, limits)
        state.update(after)
        state.setTimeoutDuration(stale_ms)
        yield out

    rows = samples.withWatermark("t", watermark) if watermark else samples
    return rows.groupBy("well_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def detect_batch(samples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same over a table, in sorted Arrow batches: a well's samples are never gathered, its state goes from batch to batch."""
    return in_sorted_batches(samples, ["well_id"], ["t"], lambda rows, state: judge(rows, state, limits), OUT)


#: Metres of a cell of depth, and the deepest place that has one of its own.
CELL_M, DEEPEST_M = 500.0, 12_500.0
#: Which problems an anomaly of a channel or signal points to.
POINTS_TO = {"possible_losses": ["lost_circulation"], "possible_influx": ["kick"], "torque": ["torque_spike", "stuck_pipe"], "hookload": ["stuck_pipe"], "spp": ["wellbore_instability", "stuck_pipe"]}


def look_ahead(samples: DataFrame, layers: DataFrame, reach: float = 150.0, alert: float = 0.4, points_to: dict[str, list[str]] | None = None) -> DataFrame:
    """Samples (well_id, t, md_m; a table or a stream) with the layers at and up to ``reach`` metres below the bit and what is expected there.

    ``layers`` is a table of (well_id, formation, top, base, hazard, mean, status, n_with); a base that is not known has no
    end. Level: alert where the posterior is sure and high, notice where there is any evidence, escalated where there is
    and an anomaly of the sample (its ``channels`` and ``signal``, if it has them) points to the problem in the layer at the bit."""
    # Samples meet layers in cells of depth, and only then what is expected in those that are near.
    base = F.coalesce("base", F.lit(float("inf")))
    places = layers.select("well_id", "formation", "top", base.alias("_base")).distinct().withColumn("_cell", F.explode(F.sequence(*(F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(DEEPEST_M)) / CELL_M) for c in (F.col("top") - reach, F.col("_base"))))))
    cell = F.floor(F.least(F.greatest(F.col("md_m"), F.lit(0.0)), F.lit(DEEPEST_M)) / CELL_M)
    near = samples.withColumn("_cell", F.when(F.col("md_m").isNotNull(), cell)).join(places, ["well_id", "_cell"]).where((F.col("top") <= F.col("md_m") + reach) & (F.col("_base") > F.col("md_m"))).drop("_cell", "_base")
    level = F.when((F.col("status") == "ok") & (F.col("mean") >= alert), "alert").when(F.col("n_with") > 0, "notice")
    rows = near.join(layers.select("well_id", "formation", "top", "hazard", "mean", "status", "n_with"), ["well_id", "formation", "top"])
    if {"channels", "signal"} <= set(samples.columns):
        signs = F.concat(F.coalesce("channels", F.array().cast("array<string>")), F.array("signal"))
        pointed = F.lit(False)
        for sign, problems in (points_to or POINTS_TO).items():
            pointed = pointed | (F.array_contains(signs, sign) & F.col("hazard").isin(problems))
        level = F.when((F.col("top") <= F.col("md_m")) & (F.col("n_with") > 0) & F.coalesce(pointed, F.lit(False)), "escalated").otherwise(level)
    rows = rows.select("well_id", *[c for c in samples.columns if c not in ("well_id", "channels", "signal")], "formation", "top", "hazard", "mean", level.alias("level"))
    return rows.where("level is not null").withColumn("metres_ahead", F.greatest(F.lit(0.0), F.col("top") - F.col("md_m")))


def minute_medians(samples: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    return samples.withWatermark("t", watermark).groupBy("well_id", F.window("t", "1 minute").alias("w")).agg(F.median("value").alias("value")).select("well_id", F.col("w.start").alias("minute"), "value")


def moved(samples: DataFrame, metres: float = 1.0) -> DataFrame:
    """Samples (well_id, t, md_m, ...) at which the bit is ``metres`` or more from where it was assessed last: those to assess again."""

    def keep(rows: pd.DataFrame, last: float | None) -> tuple[pd.DataFrame, float | None]:
        mask = []
        for md in rows["md_m"]:
            mask.append(not pd.isna(md) and (last is None or abs(md - last) >= metres))
            last = md if mask[-1] else last
        return rows[mask], last

    return in_sorted_batches(samples, ["well_id"], ["t"], keep, samples.schema)
