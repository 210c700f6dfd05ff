"""Deduplication with every tie decided by named columns, never by the order of a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.shared import unused


def completeness(columns: Sequence[str], weights: dict[str, float] | None = None) -> Column:
    """Sum of the weights (1 each) of the columns that are neither null nor blank."""
    weights = weights or {}
    return sum((F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.lit(float(weights.get(c, 1.0)))).otherwise(0.0) for c in columns), F.lit(0.0))


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, null_keys: str = "keep", mark: str | None = None) -> DataFrame:
    """The first row of each key by `order`, or with mark all rows and whether each is the first.

    Rows with a null in a key never stand for each other: they are kept
    (null_keys='keep') or dropped ('drop').
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    at = unused("_rank", df)
    whole = df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn(at, rank)
    out = whole.withColumn(mark, F.col(at) == 1).drop(at) if mark else whole.where(F.col(at) == 1).drop(at)
    if null_keys == "drop":
        return out
    rest = df.where(" or ".join(f"`{k}` is null" for k in keys))
    return out.unionByName(rest.withColumn(mark, F.lit(True)) if mark else rest)


def most_complete(df: DataFrame, key: str, ties: Sequence[Column], weights: dict[str, float] | None = None) -> DataFrame:
    """The row of each key with most fields filled; null keys stay."""
    fields = [c for c in df.columns if c != key]
    return best_per_key(df, [key], [completeness(fields, weights).desc(), *ties])


def merged_fields(df: DataFrame, keys: Sequence[str], order: Column, fields: Sequence[str]) -> DataFrame:
    """One row per key; of each field the first value by `order` that is neither null nor blank. Aggregates combine before the shuffle."""
    def first(c: str) -> Column:
        there = F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
        return F.min_by(F.when(there, F.col(c)), F.when(there, order)).alias(c)

    return df.groupBy(*keys).agg(*[first(c) for c in fields])


def canonical_pair(df: DataFrame, a: str, b: str, *, drop_self: bool = True) -> DataFrame:
    """Both ends in order, smaller first; pairs of a thing with itself go."""
    out = df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})
    return out.where(F.col(a) != F.col(b)) if drop_self else out


def best_pairs(df: DataFrame, a: str, b: str, score: str, ties: Sequence[Column]) -> DataFrame:
    """The highest score of each unordered pair."""
    return best_per_key(canonical_pair(df, a, b), [a, b], [F.col(score).desc(), *ties], null_keys="drop")


def last_per_key(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The row of each key with the highest sequence number, which is unique in a key; rows with a null key stay."""
    return best_per_key(df, keys, [F.col(sequence).desc()])


def by_priority(df: DataFrame, keys: Sequence[str], column: str, priority: Sequence[str], ties: Sequence[Column]) -> DataFrame:
    """The row of each key whose column comes first in priority; unlisted values last."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(column))
    return best_per_key(df, keys, [F.when(place > 0, place).otherwise(len(priority) + 1), *ties])


def mixed_versions(df: DataFrame, key: str, prefix: int) -> DataFrame:
    """Prefixes of keys that come with several last characters, and how many."""
    out = df.groupBy(F.substring(key, 1, prefix).alias("prefix")).agg(F.countDistinct(F.substring(key, -1, 1)).alias("versions"))
    return out.where("versions > 1")


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the values that come more than once; nulls aren't values."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
