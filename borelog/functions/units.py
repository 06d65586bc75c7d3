"""Units of the sensor feeds and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FT_M, SG_PPG, M3_BBL = 0.3048, 8.345, 6.2898
#: Unit, what it is converted to, factor.
UNITS = [
    ("m", "m", 1.0), ("ft", "m", 0.3048), ("m/h", "m/h", 1.0), ("ft/h", "m/h", 0.3048), ("min/m", "min/m", 1.0), ("klbf", "klbf", 1.0), ("lbf", "klbf", 0.001),
    ("kn", "klbf", 0.224809), ("1000 kgf", "klbf", 2.20462), ("t", "klbf", 2.20462), ("kft.lbf", "kft.lbf", 1.0), ("ft.lbf", "kft.lbf", 0.001),
    ("kn.m", "kft.lbf", 0.737562), ("n.m", "kft.lbf", 0.000737562), ("rpm", "rpm", 1.0), ("c/min", "rpm", 1.0), ("rev/min", "rpm", 1.0), ("psi", "psi", 1.0), ("kpa", "psi", 0.145038),
    ("bar", "psi", 14.5038), ("gal/min", "gpm", 1.0), ("gpm", "gpm", 1.0), ("l/min", "gpm", 0.264172), ("m3/min", "gpm", 264.172), ("bbl", "bbl", 1.0), ("m3", "bbl", 6.2898),
    ("ppg", "ppg", 1.0), ("sg", "ppg", 8.345), ("kg/m3", "ppg", 0.008345),
]
#: Other spellings of units, without blanks.
SPELLINGS = {
    "meters": "m", "metres": "m", "feet": "ft", "ft-lbf": "ft.lbf", "kft-lbf": "kft.lbf", "kft_lb": "kft.lbf", "ft_lbs": "ft.lbf",
    "knm": "kn.m", "nm": "n.m", "galus/min": "gal/min", "1000kgf": "1000 kgf", "klb": "klbf",
}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def named(unit: Column) -> Column:
    """A unit by its usual name: any case, blanks and spelling; what is not known stays as it is."""
    plain = F.replace(F.lower(F.trim(unit)), F.lit(" "), F.lit(""))
    return F.coalesce(_map(SPELLINGS)[plain], plain)


def factor(unit: Column) -> Column:
    """What a value in ``unit`` is multiplied by; null where the unit is unknown, never a guess."""
    return _map({u: f for u, _, f in UNITS})[named(unit)]


def target(unit: Column) -> Column:
    """The unit that ``unit`` is converted to, or null."""
    return _map({u: to for u, to, _ in UNITS})[named(unit)]


def convert(readings: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """``readings`` with ``converted`` and ``to``; both null where the unit is unknown."""
    return readings.withColumns({"to": target(F.col(unit)), "converted": F.col(value) * factor(F.col(unit))})


def unknown_units(readings: DataFrame, unit: str = "unit") -> DataFrame:
    return readings.select(named(F.col(unit)).alias("unit")).where(F.col("unit").isNotNull() & factor(F.col("unit")).isNull()).distinct()


def mud_weight(value: Column, unit: Column) -> Column:
    """In ppg, null outside 7 to 20."""
    ppg = F.when(F.lower(unit) == "sg", value * SG_PPG).when(F.lower(unit) == "ppg", value)
    return F.when(ppg.between(7, 20), ppg)
