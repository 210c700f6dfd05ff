"""Lookups, integrity checks, updates by join and pair generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.operators.ordered import placed
from lodestone.shared import Scratch, unused


def replaced_columns(df: DataFrame, detail: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join whose detail columns take the place of df's; detail holds one row per key."""
    return df.drop(*columns).join(detail.select(*keys, *columns), list(keys), "left")


def group_statistics(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with their group's count and mean, through one window and no join."""
    w = W.partitionBy(key)
    return df.withColumn("group_n", F.count("*").over(w)).withColumn("group_mean", F.avg(value).over(w))


def translated_ends(df: DataFrame, mapping: DataFrame, a: str, b: str, *, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Both ends of pairs through a mapping: (rows with both ends mapped, rejected rows with the reason)."""
    first = mapping.select(F.col(source).alias(a), F.col(target).alias(f"{a}_to"))
    second = mapping.select(F.col(source).alias(b), F.col(target).alias(f"{b}_to"))
    both = df.join(first, a, "left").join(second, b, "left")
    missing = F.when(F.col(f"{a}_to").isNull() & F.col(f"{b}_to").isNull(), "both").when(F.col(f"{a}_to").isNull(), "first").when(F.col(f"{b}_to").isNull(), "second")
    both = both.withColumn("reason", missing)
    return both.where("reason is null").drop("reason"), both.where("reason is not null")


def dense_index(df: DataFrame, kind: str, key: str) -> DataFrame:
    """(kind, key, index from 0) of the distinct keys of each kind in order; a kind may have any share of the keys. Null comes first."""
    rows = placed(df.select(kind, key).distinct(), [F.col(kind), F.col(key)])
    first = rows.groupBy(F.col(kind).alias("_kind")).agg(F.min("position").alias("_first"))
    return rows.join(first, rows[kind].eqNullSafe(first["_kind"])).select(kind, key, (F.col("position") - F.col("_first")).alias("index"))


def first_of(df: DataFrame, lookups: Sequence[tuple[DataFrame, str, str]], key: str, out: str) -> DataFrame:
    """Left joins in order; the first lookup (frame, key, value) that has the key gives out."""
    names = []
    for i, (frame, k, v) in enumerate(lookups):
        names.append(f"_v{i}")
        df = df.join(frame.select(F.col(k).alias(key), F.col(v).alias(names[-1])), key, "left")
    return df.withColumn(out, F.coalesce(*names)).drop(*names)


def translate(crosswalk: DataFrame, ids: DataFrame, source: str, target: str) -> DataFrame:
    """ids(id) from one namespace to another by a long table (src_ns, src_id, dst_ns, dst_id, rank): the primary and all values in order."""
    own = crosswalk.where((F.col("src_ns") == source) & (F.col("dst_ns") == target))
    return ids.join(own, ids["id"] == own["src_id"], "left").groupBy("id").agg(F.min_by("dst_id", F.struct("rank", "dst_id")).alias("primary_id"), F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("rank", "dst_id"))), lambda s: s["dst_id"].cast("string")), "|").alias("all_ids"))


def merged_crosswalks(one: DataFrame, other: DataFrame, key: str, value: str, policy: str = "keep_self") -> DataFrame:
    """(key, value) of two maps; keep_self, keep_other or keep_both decide where they disagree, error refuses."""
    if policy == "keep_both":
        return one.select(key, value).unionByName(other.select(key, value)).distinct()
    both = one.select(key, F.col(value).alias("_a")).join(other.select(key, F.col(value).alias("_b")), key, "full_outer")
    if policy == "error":
        clash = (F.col("_a") != F.col("_b")) & F.col("_a").isNotNull()
        return both.select(key, F.when(F.assert_true(~F.coalesce(clash, F.lit(False)), F.lit("maps disagree")).isNull(), F.coalesce("_a", "_b")).alias(value))
    order = ("_a", "_b") if policy == "keep_self" else ("_b", "_a")
    return both.select(key, F.coalesce(*order).alias(value))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child with a key that parent lacks."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def with_existence(df: DataFrame, keys: Sequence[str], other: DataFrame, flag: str) -> DataFrame:
    """df with whether other has its keys."""
    there = other.select(*keys).distinct().withColumn(flag, F.lit(True))
    return df.join(there, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def joined_values(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Distinct sorted values per key in one string, as a correlated sub-select would give them."""
    return df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(F.col(value).cast("string"))), ",").alias(out))


def outcome_class(df: DataFrame, key: str, met: Column, not_met: Column) -> DataFrame:
    """met, not_met, partial (both) or unknown per key, from conditions on its rows."""
    m, n = F.bool_or(met), F.bool_or(not_met)
    return df.groupBy(key).agg(F.when(m & n, "partial").when(m, "met").when(n, "not_met").otherwise("unknown").alias("outcome"))


def unseen_pairs(pairs: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that aren't known, whatever the case of their names."""
    low = known.select(F.lower(F.col(a).cast("string")).alias("_a"), F.lower(F.col(b).cast("string")).alias("_b")).distinct()
    return pairs.join(low, (F.lower(pairs[a].cast("string")) == F.col("_a")) & (F.lower(pairs[b].cast("string")) == F.col("_b")), "left_anti")


#: Rows on a side of a block of pairs.
PAIR_ROWS = 100_000
#: Pairs that a task is to make, where there are as many blocks.
PAIRS = 1_000_000


def all_pairs(left: DataFrame, right: DataFrame, *, blocks: int | None = None) -> DataFrame:
    """Every row of left with every row of right, dealt out by blocks of both sides, so no side is broadcast.

    blocks of each side: 8, or as many as hold PAIR_ROWS rows each. Blocks are
    few bytes and much work, so their partitions are of a fixed number, by pairs:
    others are put together by bytes.
    """
    n, m = left.count(), right.count()
    blocks = blocks or max(8, -(-max(n, m) // PAIR_ROWS))
    tasks = min(blocks * blocks, 2000, -(-n * m // PAIRS) or 1)
    p, q = unused("_p", left, right), unused("_q", left, right)
    l = left.withColumn(p, F.pmod(F.xxhash64(*left.columns), F.lit(blocks)).cast("int")).withColumn(q, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = right.withColumn(q, F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int")).withColumn(p, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return l.repartition(tasks, p, q).join(r.repartition(tasks, p, q), [p, q]).drop(p, q)


#: First pairs of an order that are looked up among known ones by their names, at most.
FIRST = 20_000


def top_unseen_pairs(left: DataFrame, right: DataFrame, known: DataFrame, a: str, b: str, *, bound: Column, score: Column, ties: Sequence[str], k: int, block: int = 64) -> DataFrame:
    """The k pairs of the highest score (ties: the least `ties` first) that aren't known, without all pairs.

    `bound`, of a row of right, is at least the score of each of its pairs. The
    rows of highest bound are paired first; more are taken until the k-th score
    is above the bounds of all others, so the result is that over all pairs.
    Of a round's pairs the first ones are looked up among the known, by a filter
    on their names; if too few of them are new, more are, and beyond FIRST all.
    """
    scratch = Scratch(left.sparkSession, "unseen")
    right = scratch.write(right.withColumn("_bound", bound), "right")
    rows, turn, order = right.count(), 0, [F.col("score").desc(), *ties]

    def named(c: str, first: DataFrame) -> Column:
        low = F.lower(F.col(c).cast("string"))
        return low.isin([r[0] for r in first.select(low).distinct().collect() if r[0] is not None])

    def unseen(pairs: DataFrame) -> DataFrame:
        nonlocal known
        take = max(4 * k, 500)
        while take <= FIRST:
            first = scratch.write(pairs.orderBy(*order).limit(take), f"first{turn}_{take}")
            new = unseen_pairs(first, known.select(a, b).where(named(a, first) & named(b, first)), a, b)
            best = scratch.write(new.orderBy(*order).limit(k), f"best{turn}_{take}")
            if first.count() < take or best.count() == k:
                return best
            take *= 6
        if "known" not in scratch.paths:
            known = scratch.write(known.select(a, b).distinct(), "known")
        return scratch.write(unseen_pairs(pairs, known, a, b).orderBy(*order).limit(k), f"best{turn}")

    while True:
        cut = None if block >= rows else right.select("_bound").orderBy(F.col("_bound").desc_nulls_first()).limit(block).agg(F.min("_bound")).first()[0]
        used = right if cut is None else right.where(F.col("_bound").isNull() | (F.col("_bound") >= cut))
        best = unseen(all_pairs(left, used.drop("_bound")).withColumn("score", score))
        got = best.agg(F.count("score").alias("n"), F.min("score").alias("least")).first()
        if block >= rows or (cut is not None and got["n"] == k and got["least"] >= cut):
            return best
        block, turn = 4 * block, turn + 1


def alias_pairs(df: DataFrame, key: str, aliases: str) -> DataFrame:
    """(a, b), a < b, where a is among b's aliases; through exploded aliases, not by comparing all rows."""
    names = df.select(F.col(key).alias("b"), F.explode(aliases).alias("a"))
    return names.join(df.select(F.col(key).alias("a")), "a").where("a < b").distinct().select("a", "b")


def upserted(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Column, *, fill_only: bool = False) -> DataFrame:
    """table after an upsert: of each key the last change by `order` overwrites (or, fill_only, fills nulls of) the row, or is added."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))
    at = unused("_r", changes)
    last = changes.withColumn(at, rank).where(F.col(at) == 1).select(*table.columns)
    fields = [c for c in table.columns if c not in keys]
    place = {c: unused(f"_new{i}", table) for i, c in enumerate(fields)}
    fresh = unused("_in_new", table)
    new = last.select(*keys, *[F.col(c).alias(place[c]) for c in fields], F.lit(True).alias(fresh))
    both = table.join(new, list(keys), "full_outer")

    def value(c: str) -> Column:
        return F.coalesce(c, place[c]) if fill_only else F.when(F.col(fresh), F.coalesce(place[c], c)).otherwise(F.col(c))

    return both.select(*keys, *[value(c).alias(c) for c in fields])


def filled_from(table: DataFrame, staging: DataFrame, key: str, column: str) -> DataFrame:
    """column set where it is null, from staging keys that come once only."""
    own = unused("_v", table)
    once = staging.select(F.col(key).alias("k"), F.col(column).alias("v")).groupBy("k").agg(F.count("*").alias("n"), F.first("v").alias("v")).where("n = 1").select(F.col("k").alias(key), F.col("v").alias(own))
    return table.join(once, key, "left").withColumn(column, F.coalesce(column, own)).drop(own).select(*table.columns)


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of the broken ones, joined by commas."""
    reasons = F.array_join(F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull()), ",")
    marked = df.withColumn("reason", reasons)
    return marked.where("reason = ''").drop("reason"), marked.where("reason <> ''")
