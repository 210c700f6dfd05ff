"""Ranking, paging and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.operators.ordered import placed
from lodestone.shared import unused


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, *, rank: str = "rank") -> DataFrame:
    """The first k rows of each group (null is a group) with their rank; the order's last column decides ties."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows; the order's last column must be unique."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: Sequence[Column], *, offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of an order whose last column is unique; empty beyond the end."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, score: str, key: str, *, after: tuple[float, object], limit: int) -> DataFrame:
    """The page that follows a (score, key), highest score first."""
    s, k = after
    return df.where((F.col(score) < s) | ((F.col(score) == s) & (F.col(key) > k))).orderBy(F.col(score).desc(), key).limit(limit)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """auc, positives, negatives by the tie-corrected U statistic over distinct scores, in ranges of the scores. Rows without a score are left out; auc is null without both labels."""
    by = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    by = placed(by, [F.col(score)], sums={"n": "below"})
    row = by.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)).alias("u"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return row.select(F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("u") / F.col("positives") / F.col("negatives")).alias("auc"), "positives", "negatives")


def average_ranks(df: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows with their rank, ties sharing the mean of theirs; without a group in ranges of the scores. Null scores come first."""
    if not group:
        own = unused("_s", df)
        by = placed(df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n")), [F.col("s")], sums={"n": "before"})
        mean = by.select(F.col("s").alias(own), (F.col("before") + (F.col("n") + 1) / 2.0).alias("avg_rank"))
        return df.drop("avg_rank").join(mean, F.col(score).eqNullSafe(F.col(own))).drop(own)
    w = W.partitionBy(*group).orderBy(score)
    return df.withColumn("avg_rank", F.rank().over(w) + (F.count("*").over(W.partitionBy(*group, score)) - 1) / 2.0)


def ranking_metrics(df: DataFrame, query: str, item: str, score: str, label: str, k: int) -> DataFrame:
    """Per query: precision@k (over k), recall@k, the reciprocal rank (0 without a hit) and hits@k; ties by item."""
    df = df.select(F.col(query), F.col(item).alias("_item"), F.col(score).alias("_score"), F.col(label).alias("_label"))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(query).orderBy(F.col("_score").desc(), "_item")))
    hit = F.col("_label") == 1
    top_hits = F.count_if(hit & (F.col("_r") <= k))
    return ranked.groupBy(query).agg((top_hits / F.lit(k)).alias("precision_at_k"), F.when(F.count_if(hit) > 0, top_hits / F.count_if(hit)).alias("recall_at_k"), F.coalesce(1.0 / F.min(F.when(hit, F.col("_r"))), F.lit(0.0)).alias("reciprocal_rank"), (top_hits > 0).cast("int").alias("hit_at_k"))


def leakage(df: DataFrame, score: str, label: str) -> DataFrame:
    """How many negatives have a score, to 12 places, that a positive has too; and over all pairs."""
    own = df.select(F.round(score, 12).alias("s"), label)
    by = own.groupBy("s").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return by.agg(F.sum(F.when(F.col("p") > 0, F.col("n")).otherwise(0)).alias("leaked"), (F.sum(F.when(F.col("p") > 0, F.col("n")).otherwise(0)) / (F.sum("p") * F.sum("n"))).alias("ratio"))


def bootstrap(df: DataFrame, value: str, key: str, *, resamples: int = 100) -> DataFrame:
    """Mean with the 2.5 and 97.5 percentiles of Poisson-resampled means; a row's weight in a resample comes from a hash of its key."""
    draws = df.select(value, key).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", "b", F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    bounds, weight = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183), F.lit(0)
    for b in bounds:  # the distribution of a Poisson variate of mean 1
        weight = weight + (u > b).cast("int")
    means = draws.withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def metric_delta(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) of keys of either table, each at most once in both; delta is null where one lacks it."""
    return one.select(key, F.col(value).alias("before")).join(two.select(key, F.col(value).alias("after")), key, "full_outer").withColumn("delta", F.col("after") - F.col("before"))


def limited_lists(df: DataFrame, group: str, value: str, score: str, k: int) -> DataFrame:
    """Per group its k best values in order, joined by commas."""
    best = top_per_group(df, [group], [F.col(score).desc(), F.col(value)], k)
    return best.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda s: s[value].cast("string")), ",").alias("best"))


def translation_score(head: Column, relation: Column, tail: Column) -> Column:
    """The L1 length of head + relation - tail, lower is likelier."""
    parts = F.transform(F.arrays_zip(head.alias("h"), relation.alias("r"), tail.alias("t")), lambda z: F.abs(z["h"].cast("double") + z["r"].cast("double") - z["t"].cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def temperature_scaled(logit: Column, temperature: float) -> Column:
    """The probability of a logit over a temperature; null stays null."""
    return 1 / (1 + F.exp(-logit / temperature))
