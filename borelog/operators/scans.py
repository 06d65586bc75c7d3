"""Running states over ordered rows, in pieces: a long document is no single group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a piece.
PIECE = 4096


def scanned(rows: DataFrame, key: list[str], seq: str, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, piece: int = PIECE) -> DataFrame:
    """``rows`` with, for each name of ``last``, the last value up to this row that is not null, and for each of ``total`` the sum up to this row.

    Both are states that compose: what a piece of rows does to them is one row (its last value, its sum). So states are run
    within pieces of ``piece`` places of ``seq`` (an integer), then over the pieces' rows, and put together. The key is not
    null and ``seq`` unique within it."""
    last, total = last or {}, total or {}
    cut = rows.withColumns({"_piece": F.floor(F.col(seq) / piece), **{f"_l_{k}": c for k, c in last.items()}, **{f"_t_{k}": c for k, c in total.items()}})
    within = Window.partitionBy(*key, "_piece").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    own = {f"_l_{k}": F.last(f"_l_{k}", ignorenulls=True).over(within) for k in last} | {f"_t_{k}": F.sum(f"_t_{k}").over(within) for k in total}
    ends = cut.groupBy(*key, "_piece").agg(
        F.count("*").alias("_rows"), *[F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.col(seq))).alias(f"_e_{k}") for k in last], *[F.sum(f"_t_{k}").alias(f"_s_{k}") for k in total]
    )
    before = Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    came = ends.select(*key, "_piece", *[F.last(f"_e_{k}", ignorenulls=True).over(before).alias(f"_e_{k}") for k in last], *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in total])
    joined = cut.withColumns(own).join(came, [*key, "_piece"])
    out = {k: F.coalesce(f"_l_{k}", f"_e_{k}") for k in last} | {k: F.coalesce(f"_t_{k}", F.lit(0)) + F.col(f"_s_{k}") for k in total}
    return joined.select(*[c for c in rows.columns if c not in out], *[v.alias(k) for k, v in out.items()])
