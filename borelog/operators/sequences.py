"""Operators over ordered rows: runs, folds, tops, signals."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_sorted_batches(df: DataFrame, by: list[str], order: list[str], step: Callable, schema) -> DataFrame:
    """Each key's rows in order, a batch at a time, through ``step(rows, state)``, which gives rows and the state for the next batch.

    State is None where a key begins. A key's rows are never gathered."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            for _, rows in frame.groupby(by, sort=False, dropna=False):
                key = [None if pd.isna(x) else x for x in rows.iloc[0][by]]
                out, state = step(rows, state if key == last else None)
                last = key
                if len(out):
                    yield out

    return df.repartition(n, *by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def top_n(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encoding: key, run number, value, first and last place, rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"), F.lit(1))
    numbered = df.withColumn("run", F.sum(F.when(F.row_number().over(w) == 1, 1).otherwise(new)).over(w))
    return numbered.groupBy(*by, "run").agg(F.first(value).alias(value), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def merge_short_runs(df: DataFrame, key: str, top: str, base: str, value: str, least: float) -> DataFrame:
    """Intervals of each key with those thinner than ``least`` merged into the next one (the last into the one before), again and again until none is left or one remains."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for t, b, v in rows.sort_values(top)[[top, base, value]].itertuples(index=False):
            if kept and kept[-1][2] == v:
                kept[-1][1] = b
            else:
                kept.append([t, b, v])
        while len(kept) > 1:
            thin = next((i for i, (t, b, _) in enumerate(kept) if b - t < least), None)
            if thin is None:
                break
            t, b, _ = kept.pop(thin)
            if thin < len(kept):
                kept[thin][0] = t
            else:
                kept[-1][1] = b
            for i in range(len(kept) - 1, 0, -1):
                if kept[i][2] == kept[i - 1][2]:
                    kept[i - 1][1] = kept[i][1]
                    del kept[i]
        return pd.DataFrame({key: rows[key].iloc[0], "run": range(1, len(kept) + 1), top: [k[0] for k in kept], base: [k[1] for k in kept], value: [k[2] for k in kept]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"{key} {kinds[key]}, run long, {top} {kinds[top]}, {base} {kinds[base]}, {value} {kinds[value]}"
    return df.select(key, top, base, value).groupBy(key).applyInPandas(fold, schema)


def greedy_keep(df: DataFrame, by: list[str], at: str, order: list[str], within: float) -> DataFrame:
    """Rows kept in order, each unless it lies within ``within`` of one that was kept before it."""

    def keep(rows: pd.DataFrame, held: list[float] | None) -> tuple[pd.DataFrame, list[float]]:
        held, mask = held or [], []
        for x in rows[at].tolist():
            place = bisect(held, x)  # only the neighbours among those kept can be near
            mask.append(all(abs(x - h) > within for h in held[max(0, place - 1) : place + 1]))
            if mask[-1]:
                held.insert(place, x)
        return rows[mask], held

    return in_sorted_batches(df, by, order, keep, df.schema)


def cusum(df: DataFrame, key: str, order: list[str], x: str, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Two-sided CUSUM of ``x``: high and low sums after each row, and the alarm, a drop before a rise; the side that alarms starts anew."""

    def fold(rows: pd.DataFrame, sums: tuple[float, float] | None) -> tuple[pd.DataFrame, tuple[float, float]]:
        high, low = sums or (0.0, 0.0)
        out = []
        for v in rows[x].tolist():
            high, low = max(0.0, high + v - k), max(0.0, low - v - k)
            out.append((high, low, "possible_losses" if low > h else "possible_influx" if high > h else None))
            high, low = 0.0 if low <= h < high else high, 0.0 if low > h else low
        sums = pd.DataFrame(out, columns=["up", "down", "alarm"], index=rows.index)
        return pd.concat([rows, sums], axis=1), (high, low)

    rows = df.select(key, *order, x)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return in_sorted_batches(rows, [key], order, fold, f"{schema}, up double, down double, alarm string")


def middle(a: Column) -> Column:
    """The median of a sorted array."""
    m = F.size(a)
    lower, upper = F.get(a, F.floor((m - 1) / 2).cast("int")), F.get(a, F.floor(m / 2).cast("int"))
    return (lower + upper) / 2


def robust_z(df: DataFrame, key: str, order: str, value: str, n: int = 20, least: int = 20) -> DataFrame:
    """z of each value against the median and MAD of up to ``n`` rows before it; null before ``least`` rows or where MAD is 0."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    held = df.withColumn("_held", F.sort_array(F.collect_list(value).over(before)))
    held = held.withColumn("med", middle(F.col("_held")))
    held = held.withColumn("mad", middle(F.sort_array(F.transform("_held", lambda v: F.abs(v - F.col("med"))))) * 1.4826)
    ok = (F.size("_held") >= least) & (F.col("mad") > 1e-9)
    return held.withColumn("z", F.when(ok, (F.col(value) - F.col("med")) / F.col("mad"))).drop("_held")


def time_signature(rows: DataFrame, key: str, at: str, value: str, least: tuple[int, int, int] = (30, 20, 5)) -> DataFrame:
    """(key, minute, level, slope, spread) of a channel (``at``: the minute's number, one row a minute, ``value`` its median).

    In minutes: the base is the median of the 360 that ended 60 before, and of the distances from their own bases; the level is
    the last 60's median less the base, the slope the last 15's less that of the 15 which ended 45 before, the spread the last 60's
    median distance from their medians; all by the base's distance, cut off at 20 and 5. A frame needs as many values as
    ``least`` says (base, hour, quarter). Frames go by time, so missing minutes do not stretch them; rows without all three are left out."""
    order = Window.partitionBy(key).orderBy(at)
    frame = lambda n, lag: order.rangeBetween(-(n - 1) - lag, -lag)
    held = lambda c, n, lag, k: F.when(F.count(c).over(frame(n, lag)) >= k, middle(F.sort_array(F.collect_list(c).over(frame(n, lag)))))  # noqa: E731  at most n values
    base, hour, quarter = least
    out = rows.withColumns({"_base": held(value, 360, 60, base), "_hour": held(value, 60, 0, hour), "_first": held(value, 15, 45, quarter), "_last": held(value, 15, 0, quarter)})
    out = out.withColumns({"_off": F.abs(F.col(value) - F.col("_base")), "_near": F.abs(F.col(value) - F.col("_hour"))})
    out = out.withColumns({"_mad": held("_off", 360, 60, base) + 1e-6, "_wide": held("_near", 60, 0, hour)})
    cut = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-20.0)), F.lit(20.0)))
    level, slope = cut((F.col("_hour") - F.col("_base")) / F.col("_mad")), cut((F.col("_last") - F.col("_first")) / F.col("_mad"))
    spread = F.log1p(F.col("_wide") / F.col("_mad"))
    spread = F.when(spread.isNotNull(), F.least(spread, F.lit(5.0)))
    return out.select(key, at, level.alias("level"), slope.alias("slope"), spread.alias("spread")).dropna()
