"""Ordered-per-key computations that survive a hot key.

A window ``partitionBy(key).orderBy(ts)`` sorts every row of a key in one
task; if one shipment / model / endpoint holds a third of all rows, that
task holds a third of the data. Here the rows are range-sorted by (key,
order) first (``in_order``). The bounds come from the data, so a key with
many rows is split at its own quantiles, whether its rows span a year or a
second. What follows works on (key, range) groups, none larger than a range:

* ``keyed_running_sum``: running sums within the groups, plus what the
  earlier ranges of the key hold;
* ``keyed_row_number``: the running sum of 1;
* ``keyed_previous``: the row before, taken from the end of the range before
  where a group begins;
* ``keyed_totals``: the key's totals on every row;
* ``keyed_lag``: values of the row k places earlier, by an equi-join on
  (key, row number - k), which spreads a hot key over all tasks.

Only the first key of a range can go on from the range before, so what is
carried from range to range is at most one row for each range.

Null keys are a key of their own and null order values sort first. Rows that
are equal in all of (key, order) share a range; their order is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

RANGE = "_range"


def in_order(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: ascending along (keys, order). Stored, so that every later step sees the same ranges.

    ``ranges`` defaults to ``spark.sql.shuffle.partitions``, of which AQE merges neighbours that are small.
    """
    by = [*keys, *order]
    spread = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return cut_lineage(spread.withColumn(RANGE, F.spark_partition_id()))


def _groups(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """One row for each (key, range)."""
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(RANGE).alias("_k_range")).agg(*aggregates)


def _same_group(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(RANGE) == F.col("_k_range")]


def _ranges_of(keys: list[str]):
    """The ranges of a key in order: a window over the rows of ``_groups``."""
    return Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_k_range")


def keyed_running_sum(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                      inclusive: bool = True, prefix: str = "cum_") -> DataFrame:
    """``cum_<v>``: sum of ``v`` over the key's rows up to this one (``df`` from ``in_order``)."""
    upto = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = df.select("*", *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"_l_{v}") for v in values])
    earlier = _ranges_of(keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = _groups(df, keys, *[F.sum(v).alias(f"_t_{v}") for v in values])
    carried = sums.select(*[f"_k_{k}" for k in keys], "_k_range", F.count(F.lit(1)).over(earlier).alias("_n"),
                          *[F.sum(f"_t_{v}").over(earlier).alias(f"_o_{v}") for v in values]).where("_n > 0").drop("_n")
    j = local.join(F.broadcast(carried), _same_group(keys), "left")  # at most one row a range
    return j.select(*df.columns, *[(F.coalesce(F.col(f"_o_{v}"), F.lit(0)) + F.col(f"_l_{v}")).alias(f"{prefix}{v}") for v in values])


def keyed_row_number(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """``rn``: place of the row among the key's rows, from 1 (``df`` from ``in_order``)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    r = keyed_running_sum(one, keys, order, ["_one"], prefix="_rn")
    return r.withColumnRenamed("_rn_one", out).drop("_one")


def keyed_previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str], prefix: str = "prev_") -> DataFrame:
    """``prev_<c>``: values of the key's row before, null for its first row (``df`` from ``in_order``)."""
    w = Window.partitionBy(*keys, RANGE).orderBy(*order)
    row = F.struct(*cols)
    local = df.select("*", F.lag(row).over(w).alias("_before"))
    last = _groups(df, keys, F.max_by(row, F.struct(*order)).alias("_last"))
    carried = last.select(*[f"_k_{k}" for k in keys], "_k_range", F.lag("_last").over(_ranges_of(keys)).alias("_carry")).where("_carry is not null")
    j = local.join(F.broadcast(carried), _same_group(keys), "left")  # at most one row a range
    return j.select(*df.columns, *[F.coalesce("_before", "_carry").getField(c).alias(f"{prefix}{c}") for c in cols])


def keyed_totals(df: DataFrame, keys: list[str], values: list[str], prefix: str = "all_") -> DataFrame:
    """``all_<v>``: sum of ``v`` over the key, joined by (key, range) so that a hot key stays spread (``df`` from ``in_order``)."""
    whole = Window.partitionBy(*[f"_k_{k}" for k in keys])  # a row for each range of the key
    sums = _groups(df, keys, *[F.sum(v).alias(f"_t_{v}") for v in values])
    totals = sums.select(*[f"_k_{k}" for k in keys], "_k_range", *[F.sum(f"_t_{v}").over(whole).alias(f"{prefix}{v}") for v in values])
    return df.join(totals, _same_group(keys)).select(*df.columns, *[f"{prefix}{v}" for v in values])


def keyed_lag(df: DataFrame, keys: list[str], rn: str, cols: list[str], offset: int = 1,
              prefix: str = "prev_") -> DataFrame:
    """Values of the row ``offset`` places earlier in the key (null for the first rows)."""
    prev = df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col(rn) + offset).alias("_k_rn"),
                     *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(rn) == F.col("_k_rn")]
    j = df.join(prev, cond, "left")
    return j.select(*df.columns, *[f"{prefix}{c}" for c in cols])
