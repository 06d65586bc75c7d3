"""The most similar wells around each well: in a radius, by nearness, common layers and depth."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borelog.functions import geo

from . import sequences

#: Left rows that a task holds at once, right rows that it looks at together, left rows that share a search, layers compared at once.
LEFT, RIGHT, TOGETHER, LAYERS = 32_768, 32_768, 64, 512
SCALE, DECIMALS = 5000.0, 10_000.0
KINDS = "well_id long, family long, lat double, lon double, td double, offset_id long, lat_o double, lon_o double, td_o double, common int, either int"


def similar(left: DataFrame, right: DataFrame, radius: float, most: int, nearest_first: bool = False) -> DataFrame:
    """The first ``most`` rows of ``right`` for each row of ``left``, both (well_id, family, lat, lon, td, formations: a set), at most ``radius`` metres away:
    (well_id, offset_id, family, distance, shared, sim, rank), by similarity, of equals the nearer (``nearest_first``), then the least id.

    A well is no offset of itself nor of its family (null: of none). Figures of the rows that come close are Spark's; see ``close``."""
    rows = close(left, right, radius, most)
    distance = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat_o"), F.col("lon_o"))
    rows = rows.withColumn("distance", distance).where(F.col("distance") <= radius)
    shared = F.when(F.col("either").isNotNull(), F.col("common") / F.col("either"))
    sim = F.round(geo.similarity(F.col("distance"), shared, F.col("td"), F.col("td_o")), 4)
    rows = rows.select("well_id", "offset_id", "family", F.round("distance", 4).alias("distance"), F.round(shared, 6).alias("shared"), sim.alias("sim"))
    order = [F.col("sim").desc(), *([F.col("distance")] if nearest_first else []), F.col("offset_id")]
    return sequences.top_n(rows, most, ["well_id"], order)


def close(left: DataFrame, right: DataFrame, radius: float, most: int) -> DataFrame:
    """KINDS: all pairs that may be among a well's first ``most`` (with ``common`` and ``either``, the sizes of the sets' intersection and union; null where one is empty), and few others.

    Cells are twice the radius high and at least as wide; a left row is in one cell, a right row in those it may be reached from. Of a cell with
    more left rows than LEFT each part meets all right rows. A task holds a part's left rows and lets the right rows pass, nearest
    first for each TOGETHER of them: where nearness alone cannot lift a row above what is there already, the rest is left out. Its figures
    have a margin above their error, and a row goes only if ``most`` others are certain to be before it."""
    high = math.degrees(radius / geo.EARTH_M) * 1.001
    reach = min(math.sin(min(math.radians(high), math.pi) / 2), 1.0)

    def across(band: Column) -> Column:
        """Degrees of longitude that the radius may span in a band or beside it."""
        steepest = F.least(F.lit(90.0), F.greatest(F.abs(band * 2 * high - high), F.abs((band + 1) * 2 * high + high)))
        return F.degrees(2 * F.asin(F.least(F.lit(1.0), reach / F.greatest(F.cos(F.radians(steepest)), F.lit(1e-12))))) * 1.001

    def cells(band: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(360 / (2 * across(band))))

    def place(lon: Column, count: Column) -> Column:
        return F.floor(F.pmod(lon, F.lit(360.0)) / 360 * count)

    columns = ["well_id", "family", "lat", "lon", "td", "formations"]
    known = "lat is not null and lon is not null"
    asked = left.select(*columns).where(known).withColumn("_y", F.floor(F.col("lat") / (2 * high)))
    asked = asked.withColumn("_x", F.pmod(place(F.col("lon"), cells(F.col("_y"))), cells(F.col("_y"))))
    crowded = asked.groupBy("_y", "_x").agg(F.ceil(F.count("*") / LEFT).cast("int").alias("_parts")).where("_parts > 1")
    asked = asked.join(F.broadcast(crowded), ["_y", "_x"], "left")  # a row for each LEFT rows at most
    asked = asked.withColumn("_p", F.pmod(F.xxhash64("well_id"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")

    held = right.select(*columns).where(known).withColumn("_y", F.explode(F.sequence(F.floor((F.col("lat") - high) / (2 * high)), F.floor((F.col("lat") + high) / (2 * high)))))
    n, wide = cells(F.col("_y")), across(F.col("_y"))
    spread = F.sequence(F.floor((F.col("lon") - wide) / 360 * n), F.floor((F.col("lon") + wide) / 360 * n))
    held = held.withColumn("_x", F.explode(F.array_distinct(F.transform(spread, lambda x: F.pmod(x, n)))))
    held = held.join(F.broadcast(crowded), ["_y", "_x"], "left").withColumn("_p", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")

    key = ["_y", "_x", "_p"]
    both = asked.withColumn("_side", F.lit(0)).unionByName(held.withColumn("_side", F.lit(1)))
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = both.repartition(tasks, *key).sortWithinPartitions(*key, "_side").select(*key, "_side", *columns)
    return lined.mapInArrow(lambda batches: _searched(batches, radius, most), KINDS)


def _searched(batches: Iterator[pa.RecordBatch], radius: float, most: int) -> Iterator[pa.RecordBatch]:
    key, left, right, group = None, [], [], None
    waiting = 0
    for batch in batches:
        at = np.column_stack([batch.column(c).to_numpy() for c in ("_y", "_x", "_p", "_side")]) if batch.num_rows else np.zeros((0, 4))
        starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)]) if len(at) else []
        for lo, hi in zip(starts, [*starts[1:], len(at)], strict=True):
            here, side, rows = tuple(at[lo, :3]), at[lo, 3], batch.slice(lo, hi - lo)
            if here != key:
                if group and waiting:
                    group.meet(_Rows(right, group.names))
                if group:
                    yield from group.result()
                key, left, right, group, waiting = here, [], [], None, 0
            if side == 0:
                left.append(rows)
            elif left:
                group = group or _Group(_Rows(left, {}), radius, most)
                right.append(rows)
                waiting += len(rows)
                if waiting >= RIGHT:
                    group.meet(_Rows(right, group.names))
                    right, waiting = [], 0
    if group:
        if waiting:
            group.meet(_Rows(right, group.names))
        yield from group.result()


class _Rows:
    """Rows as arrays. ``names`` numbers the layers; an empty one is filled with those of these rows, of others only its layers are kept."""

    def __init__(self, batches: list[pa.RecordBatch], names: dict[str, int]):
        table = pa.Table.from_batches(batches).combine_chunks()
        number = lambda c: table.column(c).cast(pa.float64()).to_numpy()
        self.id, self.lat, self.lon, self.td = table.column("well_id").to_numpy(), number("lat"), number("lon"), number("td")
        family = table.column("family")
        self.family, self.related = family.fill_null(0).to_numpy(), family.is_valid().to_numpy()
        lat, lon = np.radians(self.lat), np.radians(self.lon)
        self.xyz = np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
        layers = pa.concat_arrays(table.column("formations").chunks) if table.num_rows else pa.array([], pa.list_(pa.string()))
        sizes = layers.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        coded = layers.flatten().dictionary_encode()
        if not names:
            names.update({v: i for i, v in enumerate(coded.dictionary.to_pylist())})
        number = np.array([names.get(v, -1) for v in coded.dictionary.to_pylist()], np.int64)
        codes = number[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        self.names, self.sizes, self.codes = names, sizes, codes
        self.starts = np.r_[0, np.cumsum(sizes)]

    def elements(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``at``, layer) of all layers of the rows ``at``."""
        n = self.sizes[at]
        first = np.repeat(self.starts[at] - np.r_[0, np.cumsum(n)[:-1]], n) if len(at) else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(at)), n), self.codes[first + np.arange(len(first))]


class _Group:
    """Left rows in blocks of neighbours, each with the pairs that may be among the first."""

    def __init__(self, left: _Rows, radius: float, most: int):
        self.left, self.names, self.most = left, left.names, most
        self.far = 2 * math.sin(min(radius / geo.EARTH_M, math.pi) / 2)
        # what chords in place of arcs and single precision may change in a similarity
        self.margin = 2e-6 + 0.4 * (min(radius, math.pi * geo.EARTH_M) - self.far * geo.EARTH_M) / SCALE
        order = np.argsort(_interleaved(left.lat, left.lon), kind="stable")
        self.blocks = [_Block(self, order[i : i + TOGETHER]) for i in range(0, len(order), TOGETHER)]

    def meet(self, right: _Rows) -> None:
        for block in self.blocks:
            block.meet(right)

    def result(self) -> Iterator[pa.RecordBatch]:
        for b in self.blocks:
            if len(b.found["at"]):
                a, f = self.left, b.found
                at, empty = b.rows[f["at"]], f["either"] == 0
                cols = [pa.array(a.id[at]), pa.array(a.family[at], mask=~a.related[at]), pa.array(a.lat[at]), pa.array(a.lon[at]), pa.array(a.td[at], from_pandas=True), pa.array(f["id"]), pa.array(f["lat"]), pa.array(f["lon"]), pa.array(f["td"], from_pandas=True)]
                cols += [pa.array(f[c].astype(np.int32), mask=empty) for c in ("common", "either")]
                yield pa.RecordBatch.from_arrays(cols, names=[k.split()[0] for k in KINDS.split(", ")])


class _Block:
    def __init__(self, group: _Group, rows: np.ndarray):
        left = group.left
        self.group, self.rows = group, rows
        self.centre = left.xyz[rows].mean(axis=0)
        self.off = left.xyz[rows] - self.centre
        self.wide = float(np.sqrt((self.off**2).sum(axis=1)).max())
        place, layer = left.elements(rows)
        self.used = np.unique(layer)
        self.sets = np.zeros((len(rows), len(self.used)), np.float32)
        self.sets[place, np.searchsorted(self.used, layer)] = 1
        self.sizes, self.td = left.sizes[rows].astype(np.float32), left.td[rows].astype(np.float32)
        self.ids, self.families = np.sort(left.id[rows]), np.unique(left.family[rows][left.related[rows]])
        self.least = np.full(len(rows), -np.inf)  # a pair below is not among the first, in units of the last decimal
        self.found = {c: np.zeros(0, t) for c, t in (("at", np.int64), ("id", np.int64), ("lat", float), ("lon", float), ("td", float), ("common", np.int64), ("either", np.int64), ("low", float), ("high", float))}

    def reach(self) -> np.ndarray:
        """For each of the block's rows the chord from the centre beyond which no row is among its first."""
        far = np.full(len(self.rows), self.group.far * (1 + 1e-6) + 1e-10)
        rest = self.least / DECIMALS - 1e-4 - self.group.margin - 0.2 - np.where(self.sizes > 0, 0.4, 0.0)
        on = rest > 0
        far[on] = np.minimum(far[on], -SCALE * np.log(np.minimum(rest[on] / 0.4, 1.0)) / geo.EARTH_M)
        return far + self.wide + 1e-10

    def meet(self, right: _Rows) -> None:
        away = np.sqrt(((right.xyz - self.centre) ** 2).sum(axis=1))
        at = np.flatnonzero(away <= self.reach().max())
        at = at[np.argsort(away[at], kind="stable")]
        step, size = 0, 512
        while step < len(at):
            reach, near = self.reach(), at[step : step + size]
            near = near[: np.searchsorted(away[near], reach.max(), side="right")]
            if not len(near):
                break
            self.judge(right, near, np.flatnonzero(reach >= away[near[0]]), away[near[-1]])
            step, size = step + size, 1024

    def judge(self, right: _Rows, near: np.ndarray, on: np.ndarray, farthest: float) -> None:
        """Right rows ``near``, at most ``farthest`` from the centre, beside the block's rows ``on``. Single precision but for the distance: errors stay below the margin."""
        group, left, rows = self.group, self.group.left, self.rows[on]
        place, layer = right.elements(near)
        common = np.zeros((len(on), len(near)), np.float32)
        if len(self.used):
            known = np.minimum(np.searchsorted(self.used, layer), len(self.used) - 1)
            ours = self.used[known] == layer
            place, layer = place[ours], known[ours]
            for lo in range(0, len(self.used), LAYERS):
                part = (layer >= lo) & (layer < lo + LAYERS)
                held = np.zeros((len(near), min(LAYERS, len(self.used) - lo)), np.float32)
                held[place[part], layer[part] - lo] = 1
                common += self.sets[on, lo : lo + LAYERS] @ held.T
        size, other = self.sizes[on][:, None], right.sizes[near].astype(np.float32)[None, :]
        either = size + other - common
        if size.min() == 0 or other.min() == 0:
            either[(size == 0) | (other == 0)] = 0
        off, away = self.off[on], right.xyz[near] - self.centre
        square = off @ (-2 * away.T)
        square += (off**2).sum(axis=1)[:, None]
        square += (away**2).sum(axis=1)[None, :]
        chord = np.sqrt(np.maximum(square, 0, out=square).astype(np.float32))
        sim = np.exp(chord * np.float32(-geo.EARTH_M / SCALE))
        sim *= np.float32(0.4)
        mine, td = self.td[on][:, None], right.td[near].astype(np.float32)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            for share, whole, weight in ((common, either, 0.4), (np.minimum(mine, td), np.maximum(mine, td), 0.2)):
                share = share / whole
                if not whole.min() > 0:
                    share[~(whole > 0)] = 0
                share *= np.float32(weight)
                sim += share
        # the well itself and its family
        ids, families = right.id[near], right.family[near]
        kin = np.flatnonzero(_within(ids, self.ids) | (_within(families, self.families) & right.related[near]))
        if len(kin):
            same = left.id[rows][:, None] == ids[kin][None, :]
            same |= (left.family[rows][:, None] == families[kin][None, :]) & left.related[rows][:, None] & right.related[near][kin][None, :]
            sim[:, kin] = np.where(same, -np.inf, sim[:, kin])
        sure = sim
        if farthest + self.wide > group.far * (1 - 1e-6) - 1e-10:
            sim[chord > group.far * (1 + 1e-6) + 1e-10] = -np.inf
            sure = np.where(chord < group.far * (1 - 1e-6) - 1e-10, sim, -np.inf)
        if len(near) > group.most and not np.isfinite(self.least[on]).all():
            kth = -np.partition(-sure, group.most - 1, axis=1)[:, group.most - 1].astype(float)
            self.least[on] = np.maximum(self.least[on], np.floor((kth - group.margin) * DECIMALS + 0.5))
        kept, col = np.nonzero((sim >= ((self.least[on] - 1) / DECIMALS - group.margin).astype(np.float32)[:, None]) & (sim > -np.inf))
        s, r = sim[kept, col].astype(float), near[col]
        low = np.where(np.isfinite(sure[kept, col]), np.floor((s - group.margin) * DECIMALS + 0.5), -np.inf)
        new = {"at": on[kept], "id": right.id[r], "lat": right.lat[r], "lon": right.lon[r], "td": right.td[r], "common": common[kept, col].astype(np.int64), "either": either[kept, col].astype(np.int64), "low": low, "high": np.floor((s + group.margin) * DECIMALS + 0.5)}
        self.found = {c: np.concatenate([v, new[c]]) for c, v in self.found.items()}
        self.trim()

    def trim(self) -> None:
        f, most = self.found, self.group.most
        order = np.lexsort((-f["low"], f["at"]))
        at = f["at"][order]
        first = np.searchsorted(at, np.arange(len(self.rows)))
        enough = np.searchsorted(at, np.arange(len(self.rows)), side="right") - first >= most
        self.least[enough] = np.maximum(self.least[enough], f["low"][order][first[enough] + most - 1])
        kept = f["high"] >= self.least[f["at"]]
        self.found = f = {c: v[kept] for c, v in f.items()}
        if len(f["at"]) > 2 * most * len(self.rows):  # of equals at one place the least ids come first
            order = np.lexsort((f["id"], f["lon"], f["lat"], f["high"], f["low"], f["at"]))
            same = np.ones(len(order), bool)
            same[0] = False
            for c in ("at", "low", "high", "lat", "lon"):
                v = f[c][order]
                same[1:] &= v[1:] == v[:-1]
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            fixed = f["low"][order] == f["high"][order]
            order = order[~fixed | (np.arange(len(order)) - start < most)]
            self.found = {c: v[order] for c, v in f.items()}


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _interleaved(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Places along a curve that keeps neighbours together: ten bits of either coordinate in turn."""
    out = np.zeros(len(lat), np.int64)
    for shift, v in ((0, lat), (1, lon)):
        span = (v.max() - v.min()) or 1.0
        cell = ((v - v.min()) / span * 1023).astype(np.int64)
        for bit in range(10):
            out |= ((cell >> bit) & 1) << (2 * bit + shift)
    return out
