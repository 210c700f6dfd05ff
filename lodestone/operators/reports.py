"""Reports over tables and runs: snapshots, staleness, rates of calls, prediction breakdowns, features of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.operators.ordered import placed


def snapshot(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(column, rows, filled, distinct, repeated) of each key column in one pass over each; repeated counts values that come more than once. Nulls aren't values."""
    out = None
    for c in keys:
        by = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        there = F.col("v").isNotNull()
        row = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("filled"), F.count_if(there).alias("distinct"), F.count_if(there & (F.col("n") > 1)).alias("repeated"))
        part = row.select(F.lit(c).alias("column"), "rows", "filled", "distinct", "repeated")
        out = part if out is None else out.unionByName(part)
    return out


def stale(df: DataFrame, key: str, time: str, now: Column, hours: float) -> DataFrame:
    """(key, last, stale): the last time of each key and whether it is more than `hours` before now; a key without a time is stale."""
    last = df.groupBy(key).agg(F.max(time).alias("last"))
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return last.withColumn("stale", F.coalesce(age > hours * 3600, F.lit(True)))


def over_rate(calls: DataFrame, key: str, time: str, *, seconds: int = 60, most: int = 100) -> DataFrame:
    """calls with recent (calls of the key in the `seconds` up to and with it) and refused (over `most`). Rows without a time are left out.

    What counts for a call lies in its own span of `seconds` or the one before:
    a key's calls are counted span by span, so that a busy key is dealt over its
    time. A span begins with the number of calls in the one before, which leave
    it one after the other: a running sum, so that no call is counted anew for
    each that follows. Of calls at one time only their number goes to the span after.
    """
    span = seconds * 1_000_000
    own = calls.where(F.col(time).isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in calls.columns]).alias("_row"), F.col(key).alias("_key"), F.unix_micros(F.col(time).cast("timestamp")).alias("_at"))
    own = own.withColumn("_span", F.floor(F.col("_at") / span))
    none = F.lit(None).cast(own.schema["_row"].dataType).alias("_row")
    gone = own.groupBy("_key", "_at", "_span").agg((-F.count("*")).alias("_n")).select(none, "_key", (F.col("_at") + span).alias("_at"), (F.col("_span") + 1).alias("_span"), "_n")
    there = own.groupBy("_key", "_span").agg(F.count("*").alias("_n")).select(none, "_key", ((F.col("_span") + 1) * span - 1).alias("_at"), (F.col("_span") + 1).alias("_span"), "_n")
    w = W.partitionBy("_key", "_span").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    both = own.withColumn("_n", F.lit(1).cast("long")).unionByName(gone).unionByName(there).withColumn("_recent", F.sum("_n").over(w)).where("_row is not null")
    return both.select(*[F.col("_row")[c].alias(c) for c in calls.columns], F.col("_recent").alias("recent"), (F.col("_recent") > most).alias("refused"))


def breakdown(df: DataFrame, key: str, score: str, label: str, *, threshold: float) -> DataFrame:
    """key, score, label, rank (1 is the highest score, ties by key), percentile (share of rows at or below by rank), predicted and kind (tp, fp, fn, tn) of every row with a score."""
    own = placed(df.where(F.col(score).isNotNull()).select(key, score, label), [F.col(score).desc(), F.col(key)], total="_n")
    yes, truth = F.col(score) >= threshold, F.col(label) == 1
    kind = F.when(yes & truth, "tp").when(yes, "fp").when(truth, "fn").otherwise("tn")
    return own.select(key, score, label, (F.col("position") + 1).alias("rank"), (1 - F.col("position") / F.col("_n")).alias("percentile"), yes.cast("int").alias("predicted"), kind.alias("kind"))


def run_changes(before: DataFrame, after: DataFrame, key: str, score: str, rank: str) -> DataFrame:
    """(key, score_change, rank_change, only) of two breakdowns; only tells the run that alone has a key."""
    a = before.select(key, F.col(score).alias("_s0"), F.col(rank).alias("_r0"))
    b = after.select(key, F.col(score).alias("_s1"), F.col(rank).alias("_r1"))
    only = F.when(F.col("_s0").isNull(), "after").when(F.col("_s1").isNull(), "before")
    return a.join(b, key, "full_outer").select(key, (F.col("_s1") - F.col("_s0")).alias("score_change"), (F.col("_r1") - F.col("_r0")).alias("rank_change"), only.alias("only"))


def supplemented(pairs: DataFrame, a: str, left: DataFrame, b: str, right: DataFrame, *, sets: tuple[str, str], out: str = "overlap") -> DataFrame:
    """pairs with the features of both ends and the share that their sets have in common (intersection over union; 0 for two empty or missing sets).

    left and right have one row for each end; pairs whose end has none keep nulls.
    """
    both = pairs.join(left, a, "left").join(right, b, "left")
    x, y = (F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in sets)
    return both.withColumn(out, F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))).drop(*sets)


def beside(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The columns of two tables side by side, rows by a key that is unique in both; a column of the other that one has too gets the suffix _2."""
    named = {c: c if c == key or c not in one.columns else f"{c}_2" for c in other.columns}
    return one.join(other.select(*[F.col(c).alias(n) for c, n in named.items()]), key, "full_outer")


def scored(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], columns: Sequence[str], *, out: str = "score") -> DataFrame:
    """df with predict's numbers, which is called once for each Arrow batch of `columns` on the executors; what it closes over is sent once a task."""
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = predict(batch[list(columns)]).astype("float64") if len(batch) else pd.Series(dtype="float64")
            yield batch

    own = df.select(*names)
    return own.mapInPandas(run, own.withColumn(out, F.lit(0.0)).schema)


def standard_records(df: DataFrame) -> DataFrame:
    """Drug records (inchikey, name, formula, phase, approved, weight; all text) normalised in place, with the reason why one can't be used.

    Keys and names by functions.scalars, formulas in Hill order; a phase is a
    whole number from 0 to 4 or null, a weight a number over 0 or null, approved
    true for yes, true and 1. All other columns stay. A record without a key and without a name has the
    reason 'unidentified'.
    """
    from lodestone.functions import scalars as S

    key, name = S.inchikey(F.col("inchikey")), S.normal_name(S.nullish_to_null(F.col("name")))
    phase = F.expr("try_cast(trim(phase) as int)")
    weight = F.expr("try_cast(trim(weight) as double)")
    out = df.withColumns(
        {
            "inchikey": key,
            "name": F.nullif(name, F.lit("")),
            "formula": S.hill_formula(S.nullish_to_null(F.col("formula"))),
            "phase": F.when(phase.between(0, 4), phase),
            "approved": F.coalesce(F.lower(F.trim("approved")).isin("yes", "true", "1"), F.lit(False)),
            "weight": F.when(weight > 0, weight),
        }
    )
    return out.withColumn("reason", F.when(F.col("inchikey").isNull() & F.col("name").isNull(), "unidentified"))
