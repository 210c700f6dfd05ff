"""Group statistics and evidence merging."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.operators.ordered import group_quantiles, least_after, placed, quantiles


def median_with_representative(df: DataFrame, keys: Sequence[str], value: str, row_id: str) -> DataFrame:
    """keys, median of the positive values, n, and the id of the row nearest to the median (ties to the smaller id). Rows with a null key are left out."""
    df = df.where(F.col(value) > 0)
    medians = group_quantiles(df, keys, value, {"median": 0.5})
    return df.join(medians, list(keys)).groupBy(*keys, "median").agg(F.count("*").alias("n"), F.min_by(row_id, F.struct(F.abs(F.col(value) - F.col("median")), F.col(row_id))).alias("representative"))


def pair_scores(df: DataFrame, a: str, b: str, score: str, order: str, *, how: str = "mean") -> DataFrame:
    """One score per pair: mean, max, or first by `order`, and how many rows it stands for."""
    pick = {"mean": F.avg(score), "max": F.max(score), "first": F.min_by(score, order)}[how]
    return df.groupBy(a, b).agg(pick.alias("score"), F.count("*").alias("n"))


def channel_maxima(df: DataFrame, keys: Sequence[str], channels: Sequence[str], label: str, order: str) -> DataFrame:
    """The highest of each channel, the first label that isn't blank, and evidence_count."""
    there = F.trim(F.coalesce(F.col(label), F.lit(""))) != ""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in channels], F.min_by(F.when(there, F.col(label)), F.when(there, F.col(order))).alias(label), F.count("*").alias("evidence_count"))


def expression_statistics(df: DataFrame, keys: Sequence[str], value: str, group: Column, *, threshold: float, least: int = 3) -> DataFrame:
    """Groups of `least` values or more, max(2, a quarter) of them at the threshold or over: n, n_over, median, p75, and the moments of both sides of `group`."""
    over = F.count_if(F.col(value) >= threshold)
    side = {"a": group, "b": ~group}
    moments = [f(F.when(c, F.col(value))).alias(f"{name}_{s}") for s, c in side.items() for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), over.alias("n_over"), *moments)
    out = out.where((F.col("n") >= least) & (F.col("n_over") >= F.greatest(F.lit(2.0), F.col("n") * 0.25)))
    shape = group_quantiles(df, keys, value, {"median": 0.5, "p75": 0.75})
    return out.join(shape, list(keys)).select(*keys, "n", "n_over", "median", "p75", *[f"{name}_{s}" for s in side for name in ("n", "mean", "var")])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, term by term for all values at once."""

    def nonzero(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) > 1e-300, v, 1e-300)

    c = np.ones_like(x)
    d = 1 / nonzero(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / nonzero(1 + n * d), nonzero(1 + n / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return h


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tails of Student's distribution with df degrees of freedom (over 0)."""
    t, df = np.broadcast_arrays(np.atleast_1d(np.asarray(t, float)), np.asarray(df, float))
    x, a = df / (df + t * t), df / 2
    log_gamma = np.frompyfunc(math.lgamma, 1, 1)
    beta = (log_gamma(a + 0.5) - log_gamma(a)).astype(float) - math.lgamma(0.5)
    front = np.exp(beta + a * np.log(np.maximum(x, 1e-300)) + 0.5 * np.log(np.maximum(1 - x, 1e-300)))
    low = x < (a + 1) / (a + 2.5)
    half = np.full_like(a, 0.5)
    fraction = _beta_fraction(np.where(low, a, half), np.where(low, half, a), np.where(low, x, 1 - x))
    return np.where(low, front * fraction / a, 1 - front * fraction / 0.5)


def welch(stats: DataFrame) -> DataFrame:
    """stats (n_a, mean_a, var_a, n_b, mean_b, var_b) with t, df and the two-sided p of Welch's test; null with fewer than two values on a side or no variance."""
    e_a, e_b = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    fit = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (e_a + e_b > 0)
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(e_a + e_b)
    free = (e_a + e_b) * (e_a + e_b) / (e_a * e_a / (F.col("n_a") - 1) + e_b * e_b / (F.col("n_b") - 1))

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        there = (t.notna() & df.notna()).to_numpy()
        out = np.full(len(t), np.nan)
        out[there] = t_tail(t[there], df[there])
        return pd.Series(out).where(there, None)

    return stats.withColumn("t", F.when(fit, t)).withColumn("df", F.when(fit, free)).withColumn("p", tail("t", "df"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, *, out: str = "fdr") -> DataFrame:
    """Step-up false discovery rates over all rows with a p value, in ranges of p; ties by key, which must be unique. Rows without p are left out."""
    ranked = placed(df.where(F.col(p).isNotNull()), [F.col(p), F.col(key)], total="_tests").withColumn("_raw", F.col(p) * F.col("_tests") / (F.col("position") + 1))
    return least_after(ranked, [F.col(p), F.col(key)], "_raw", out).withColumn(out, F.least(F.lit(1.0), out)).drop("_raw", "_tests", "position")


def merged_edges(df: DataFrame, keys: Sequence[str], confidence: str, evidence: str, source: str, order: str, *, how: str = "max_confidence") -> DataFrame:
    """Edges of one key merged: the highest confidence (or the average), evidence summed, sources sorted and joined by a pipe; 'union' keeps all rows."""
    if how == "union":
        return df.select(*keys, confidence, evidence, source)
    pick = {"max_confidence": F.max(confidence), "average": F.avg(confidence)}[how]
    first = F.min_by(order, F.struct(-F.col(confidence), F.col(order)))
    sources = F.array_join(F.sort_array(F.collect_set(F.nullif(F.trim(source), F.lit("")))), "|")
    return df.groupBy(*keys).agg(pick.alias(confidence), F.sum(evidence).alias(evidence), sources.alias(source), first.alias("best_row"))


def evidence_rollup(df: DataFrame, keys: Sequence[str], *, total: str, highest: str, lowest: str, flag: Column) -> DataFrame:
    """Sum, max, min and any of four columns per key."""
    return df.groupBy(*keys).agg(F.sum(total).alias("total"), F.max(highest).alias("highest"), F.min(lowest).alias("lowest"), F.bool_or(flag).alias("any_flag"))


def reliable_confidence(df: DataFrame, keys: Sequence[str], confidence: str, source: str, weights: dict[str, float], *, unknown: float = 0.5) -> DataFrame:
    """The highest confidence times its source's weight, cut to 0 to 1."""
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    return df.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max(F.col(confidence) * F.coalesce(table[F.col(source)], F.lit(unknown))))).alias("confidence"))


def vote_counts(df: DataFrame, key: str, choice: Column) -> DataFrame:
    """Votes per key and choice with the rank of the choice: most votes first, ties by name."""
    votes = df.groupBy(key, choice.alias("choice")).agg(F.count("*").alias("votes"))
    return votes.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.col("votes").desc(), "choice")))


def score_distribution(df: DataFrame, value: str) -> DataFrame:
    """n, mean, population deviation, least, exact quartiles and greatest of the values that aren't null; nulls and n = 0 without any."""
    row = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return row.join(quantiles(df, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})).select("n", "mean", "std", "min", "q25", "median", "q75", "max")


def quality_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check: how many rows break it, of how many, in a single pass."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    stacked = ", ".join(f"'{k}', `{k}`" for k in checks)
    return row.select(F.expr(f"stack({len(checks)}, {stacked}) as (check_name, broken)"), F.col("_n").alias("rows")).withColumn("share", F.col("broken") / F.col("rows"))


def quality_score(df: DataFrame, fields: Sequence[str], key: str, valid: Column) -> DataFrame:
    """Mean of completeness of fields, distinctness of key and share of valid rows."""
    parts = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(f"_{c}") for c in fields], (F.countDistinct(key) / F.count("*")).alias("uniqueness"), F.avg(F.coalesce(valid, F.lit(False)).cast("double")).alias("validity"))
    complete = sum((F.col(f"_{c}") for c in fields), F.lit(0.0)) / len(fields)
    return parts.select(complete.alias("completeness"), "uniqueness", "validity", ((complete + F.col("uniqueness") + F.col("validity")) / 3).alias("score"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share of all rows) of each value, null being one."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def gates(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(gate, value, passed) of aggregate expressions and the conditions on them, in one pass."""
    row = df.agg(*[v.alias(k) for k, (v, _) in rules.items()])
    parts = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), ok.alias("passed")) for k, (_, ok) in rules.items()]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
