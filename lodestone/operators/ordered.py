"""Positions, running sums and quantiles in a global order without bringing the rows to one task.

Rows are dealt out by ranges of the order and written; the sums of the ranges
are a small table whose running sums give each range its start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.shared import Scratch, unused


def dealt(df: DataFrame, by: Sequence[Column], part: str = "_part") -> DataFrame:
    """df with the number of its range in an order; equal rows of the order share a range. Written, so that numbers stay."""
    return Scratch(df.sparkSession, "ordered").write(df.repartitionByRange(*by).withColumn(part, F.spark_partition_id()), "rows")


def placed(df: DataFrame, by: Sequence[Column], *, position: str = "position", sums: dict[str, str] | None = None, total: str | None = None) -> DataFrame:
    """df with its position from 0 in an order whose last columns make it unique, and for each (column, name) of sums the sum of the rows before; in `total` the number of all rows."""
    sums = sums or {}
    part = unused("_part", df)
    rows = dealt(df, by, part)
    names = [f"{part}_{i}" for i in range(len(sums) + 1)]
    whole = rows.groupBy(part).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(sums)])
    # One row for each range: as many as there are partitions.
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    start = whole.select(part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in zip(["n", *[f"s{i}" for i in range(len(sums))]], names, strict=True)])
    if total:
        start = start.join(F.broadcast(whole.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(total))))
    own = W.partitionBy(part).orderBy(*by)
    inside = own.rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(F.broadcast(start), part).withColumn(position, F.row_number().over(own) - 1 + F.col(names[0]))
    for (c, name), first in zip(sums.items(), names[1:], strict=True):
        out = out.withColumn(name, F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(first))
    return out.drop(part, *names)


def least_after(df: DataFrame, by: Sequence[Column], value: str, out: str) -> DataFrame:
    """df with the least value of its own and all later rows of a unique order."""
    part = unused("_part", df)
    rows = dealt(df, by, part)
    whole = rows.groupBy(part).agg(F.min(value).alias("least"))
    later = whole.select(part, F.min("least").over(W.orderBy(part).rowsBetween(1, W.unboundedFollowing)).alias(f"{part}_later"))
    inside = W.partitionBy(part).orderBy(*by).rowsBetween(W.currentRow, W.unboundedFollowing)
    return rows.join(F.broadcast(later), part).withColumn(out, F.least(F.min(value).over(inside), f"{part}_later")).drop(part, f"{part}_later")


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with exact quantiles, interpolated between the two values beside them; null without values. Nulls are left out."""
    by = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    by = placed(by, [F.col("v")], sums={"n": "before"})
    total = by.agg(F.sum("n").alias("total"))
    own = by.join(F.broadcast(total))
    out = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * F.lit(float(share))
        low, high = F.floor(at), F.ceil(at)

        def value_at(k: Column) -> Column:
            return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("v")))

        out.append((value_at(low) + (value_at(high) - value_at(low)) * F.max(at - low)).alias(name))
    return own.agg(*out)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys with exact quantiles of their values, interpolated between the two values beside them; keys without values, and null values, are left out. Null keys are a group.

    Values are counted, then stand in one order of all keys and values: the
    values of a key with many of them are dealt over ranges as all others.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    by = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    by = Scratch(df.sparkSession, "ordered").write(placed(by, [F.col(c) for c in (*names, "_v")], position="_at", sums={"_n": "_before"}), "values")
    whole = by.groupBy(*names).agg(F.min("_before").alias("_first"), F.sum("_n").alias("_total"))
    whole = whole.select(*[F.col(n).alias(f"{n}_") for n in names], "_first", "_total")
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    low = F.col("_before") - F.col("_first")

    def value_at(k: Column) -> Column:
        return F.max(F.when((low <= k) & (k < low + F.col("_n")), F.col("_v")))

    out = []
    for name, share in shares.items():
        at = (F.col("_total") - 1) * F.lit(float(share))
        out.append((value_at(F.floor(at)) + (value_at(F.ceil(at)) - value_at(F.floor(at))) * F.max(at - F.floor(at))).alias(name))
    found = by.join(whole, same).groupBy(*names).agg(*out)
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *shares)
