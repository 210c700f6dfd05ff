"""Entity matching: a cascade of joins whose order and ties are explicit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lodestone.operators.ordered import quantiles
from lodestone.shared import Scratch, unused

# How sure each method of matching is.
CONFIDENCE = {"exact": 1.0, "block": 0.9, "name": 0.85, "fuzzy": 0.7}


def confidence_of(method: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(CONFIDENCE.items()) for x in pair])[method]


def sorted_tokens(c: Column) -> Column:
    """The words of a name in order."""
    return F.array_join(F.sort_array(F.split(F.trim(c), r"\s+")), " ")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of an integer for each letter of a."""
    place: dict[str, int] = {}
    for i, ch in enumerate(a):
        place[ch] = place.get(ch, 0) | 1 << i
    row = (1 << len(a)) - 1
    for ch in b:
        taken = row & place.get(ch, 0)
        row = (row + taken) | (row - taken)
    return len(a) - (row & (1 << len(a)) - 1).bit_count()


def _letters(names: list[str], none: int) -> np.ndarray:
    """A row of code points for each name, `none` after its end."""
    out = np.full((len(names), max(map(len, names), default=0)), none, np.uint32)
    for i, x in enumerate(names):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _common_of_many(a: list[str], b: list[str]) -> np.ndarray:
    """_common of pairs whose first names have up to 63 letters: all pairs at once, a letter of the second names after the other."""
    one, two = _letters(a, 0xFFFFFFFF), _letters(b, 0xFFFFFFFE)
    bit = np.uint64(1) << np.arange(one.shape[1], dtype=np.uint64)
    size = np.array([len(x) for x in a], np.uint64)
    whole = (np.uint64(1) << size) - np.uint64(1)
    row = whole.copy()
    for j in range(two.shape[1]):
        taken = row & ((one == two[:, j : j + 1]) * bit).sum(1, dtype=np.uint64)
        row = (row + taken) | (row - taken)
    return size.astype(np.int64) - np.bitwise_count(row & whole)


def _shares(a: Sequence[str | None], b: Sequence[str | None]) -> np.ndarray:
    """Twice the longest common subsequence over both lengths; NaN for two empty or any null text."""
    out = np.full(len(a), np.nan)
    told = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None and x + y]
    short = [i for i in told if len(a[i]) < 64]
    for lo in range(0, len(short), 2048):
        own = short[lo : lo + 2048]
        x, y = [a[i] for i in own], [b[i] for i in own]
        out[own] = 2.0 * _common_of_many(x, y) / np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
    for i in told:
        if len(a[i]) >= 64:
            out[i] = 2.0 * _common(a[i], b[i]) / (len(a[i]) + len(b[i]))
    return out


@F.pandas_udf(T.DoubleType())
def _shared_share(a: pd.Series, b: pd.Series) -> pd.Series:
    out = _shares(a, b)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def similarity(a: Column, b: Column) -> Column:
    """Twice the longest common subsequence of two names' sorted tokens over their lengths, 0 to 1; null for two empty or any null name."""
    return _shared_share(sorted_tokens(a), sorted_tokens(b))


def fuzzy_threshold(name: Column, base: float = 0.85) -> Column:
    """How alike a name must be, by its length: short ones the more."""
    n = F.length(name)
    return F.when(n < 4, 1.0).when(n < 8, F.greatest(F.lit(base), F.lit(0.92))).when(n <= 14, F.greatest(F.lit(base), F.lit(0.88))).otherwise(base)


def unique_names(entities: DataFrame, key: str, name: str) -> DataFrame:
    """(name, key) of the names that lead to one key only."""
    return entities.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(key).alias("key"), F.countDistinct(key).alias("n")).where("n = 1").drop("n")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pairs_of_letters(names: pd.Series) -> pd.Series:
    """Each two letters that stand together, with how many equal ones came before; a single letter alone."""
    out = []
    for x in names:
        seen: dict[str, int] = {}
        own = []
        for i in range(max(len(x) - 1, 1)):
            pair = x[i : i + 2]
            seen[pair] = seen.get(pair, -1) + 1
            own.append(f"{pair}{seen[pair]}")
        out.append(own)
    return pd.Series(out)


#: Names on a side of a block: those looked for, and those they are compared with.
BLOCK = (32_768, 65_536)
#: Comparing a pair of a block takes that much less than joining one.
CHEAPER = 32


def _bits(names: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each name the set of its pairs of letters, hashed to bits of so many words, and how many of its pairs share a bit with others of it."""
    bits, size = np.zeros((words, len(names)), np.uint64), np.array([len(x) for x in names])
    code, row = _letters(names, 0).astype(np.uint64), np.arange(len(names))
    for i in range(1, code.shape[1]):
        h = ((code[:, i - 1] << np.uint64(21) | code[:, i]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        own = i < size
        bits[h[own] // np.uint64(64) % np.uint64(words), row[own]] |= np.uint64(1) << h[own] % np.uint64(64)
    return bits, np.maximum(size - 1, 0) - np.bitwise_count(bits).sum(0, dtype=np.int64)


def _letter_counts(names: list[str]) -> np.ndarray:
    """How often each name has a letter of each of 64 kinds."""
    code, size = _letters(names, 0), np.array([len(x) for x in names])
    out, row = np.zeros((len(names), 64), np.uint16), np.arange(len(names))
    for i in range(code.shape[1]):
        own = i < size
        out[row[own], code[own, i] % 64] += np.uint16(1)
    return out


def _near_in_block(more: list[str]):
    """Of all pairs of a block (side, name, s, n, t and the columns `more`) those whose similarity reaches the first name's threshold t.

    Bits come first: as many pairs of letters as alike_names says are in common,
    so as many bits are, but for those that several pairs of letters share. Of
    what is left, letters in common are counted, whatever their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compared(batches, more)

    return run


def _compared(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    side, text, size = (table.column(c).to_numpy() for c in ("side", "s", "n"))
    least, name = table.column("t").to_numpy(), table.column("name")
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    left, right = left[np.lexsort((least[left], size[left]))], right[np.argsort(size[right], kind="stable")]
    if not len(left) or not len(right):
        return
    n, few = size[right].astype(np.int64), 1 << 16

    def told(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        at, other = np.repeat([i for i, _ in found], [len(x) for _, x in found]), np.concatenate([x for _, x in found])
        share = _shares(text[at].tolist(), text[other].tolist())
        fit = share >= least[at]
        x, y = (pa.array(i[fit]) for i in (at, other))
        return pa.RecordBatch.from_arrays([name.take(x).combine_chunks(), name.take(y).combine_chunks(), *[table.column(c).take(x).combine_chunks() for c in more], pa.array(share[fit])], names=["r", "e", *more, "s"])

    edges = np.flatnonzero((np.diff(size[left], prepend=-1) != 0) | (np.diff(least[left], prepend=-1) != 0))
    for own in np.split(left, edges[1:]):
        m, t = int(size[own[0]]), float(least[own[0]])
        lo, hi = np.searchsorted(n, [m * t / (2 - t) - 1e-6, m * (2 - t) / t + 1e-6])
        if lo == hi:
            continue
        words = 2
        while 10 * words < m and words < 32:
            words *= 2
        found, held = [], 0
        one, one_has = _bits(text[own].tolist(), words)[0], _letter_counts(text[own].tolist())
        for a in range(lo, hi, 16_384):
            b = min(a + 16_384, hi)
            (two, lost), two_has = _bits(text[right[a:b]].tolist(), words), _letter_counts(text[right[a:b]].tolist())
            letters = np.ceil(t * (m + n[a:b]) / 2 - 1e-9).astype(np.int64)
            need = np.clip(3 * letters - (m + n[a:b]) - 1 - lost, 0, 1 << 15).astype(np.uint16)
            both, one_word, count = np.empty(b - a, np.uint64), np.empty(b - a, np.uint8), np.empty(b - a, np.uint16)
            for k, i in enumerate(own):
                count[:] = np.bitwise_count(np.bitwise_and(two[0], one[0, k], out=both), out=one_word)
                for w in range(1, words):
                    np.add(count, np.bitwise_count(np.bitwise_and(two[w], one[w, k], out=both), out=one_word), out=count)
                hits = np.flatnonzero(count >= need)
                if len(hits):
                    hits = hits[np.minimum(two_has[hits], one_has[k]).sum(1, dtype=np.int64) >= letters[hits]]
                if len(hits):
                    found.append((i, right[a + hits]))
                    held += len(hits)
                    if held >= few:
                        yield told(found)
                        found, held = [], 0
        if found:
            yield told(found)


def alike_names(left: DataFrame, right: DataFrame, *, base: float = 0.85, within: str | None = None, blocks: bool | None = None) -> DataFrame:
    """(r, e, s) of the distinct names left(r) and right(e) whose similarity s reaches fuzzy_threshold of r.

    With within, a column of both, only names of equal value there are
    compared, and it stands in the result.

    Nothing is lost: names of similarity t over lengths m and n share at least
    (1.5 t - 1)(m + n) - 1 pairs of letters, so they share one of their rarest
    if each name gives all but so many of its own; only those are joined. Where
    no pair of letters is rare, as in digests, that join would meet most pairs
    many times over: all pairs of like length are then compared by the bits of
    their pairs of letters, in blocks. blocks: True or False for one of the two,
    None for the one with less to do. Nulls and empty names have no match.
    """
    t, more = base, [within] if within else []
    least = (1.5 * t - 1) * (1 + t / (2 - t))
    scratch = Scratch(left.sparkSession, "alike")

    def named(df: DataFrame, c: str) -> DataFrame:
        own = df.where(F.length(F.trim(c)) > 0).where(F.col(within).isNotNull() if within else F.lit(True))
        own = own.select(c, *more).distinct().repartition(4 * left.sparkSession.sparkContext.defaultParallelism, c)
        return scratch.write(own.withColumn("s", sorted_tokens(F.col(c))).withColumn("n", F.length("s")), c)

    def of_pairs(df: DataFrame, c: str) -> DataFrame:
        return df.select(c, *more, "s", "n", F.explode(_pairs_of_letters("s")).alias("pair"))

    def like(m: str, n: str) -> Column:
        return 2.0 * F.least(m, n) >= t * (F.col(m) + F.col(n)) - 1e-9

    left, right = named(left, "r"), named(right, "e")
    r, e = of_pairs(left, "r"), of_pairs(right, "e")
    common = e.groupBy("pair", *more).agg(F.count("*").alias("f"))

    def rarest(df: DataFrame, c: str) -> DataFrame:
        order = F.row_number().over(W.partitionBy(c, *more).orderBy(F.coalesce("f", F.lit(0)), "pair"))
        kept = F.greatest(F.col("n") - F.greatest(F.ceil(least * F.col("n") - 1 - 1e-9), F.lit(1)), F.lit(1))
        return df.join(common, ["pair", *more], "left").withColumn("k", order).where(F.col("k") <= kept).select(c, *more, "pair", F.col("n").alias(f"{c}_n"))

    def pairs_of(x: DataFrame, y: DataFrame, on: list[str], where: Column) -> float:
        """How many pairs of rows x(_x) and y(_y) stand for."""
        both = x.join(y, on) if on else x.crossJoin(y)
        return both.where(where).agg(F.sum(F.col("_x") * F.col("_y"))).first()[0] or 0.0

    def counted(df: DataFrame, out: str, *by: str | Column) -> DataFrame:
        return df.groupBy(*by).agg(F.count("*").cast("double").alias(out))

    rare_r, rare_e = rarest(r, "r"), rarest(e, "e")
    if blocks is None:
        lengths = counted(left, "_x", F.col("n").alias("r_n"), *more), counted(right, "_y", F.col("n").alias("e_n"), *more)
        shared = counted(rare_r, "_x", "pair", *more), counted(rare_e, "_y", "pair", *more)
        blocks = CHEAPER * pairs_of(*shared, ["pair", *more], F.lit(True)) > pairs_of(*lengths, more, like("r_n", "e_n"))
    if blocks:
        p, q = max(1, -(-left.count() // BLOCK[0])), max(8, -(-right.count() // BLOCK[1]))

        def dealt(df: DataFrame, c: str, side: int, least: Column, own: str, n: int, other: str, m: int) -> DataFrame:
            return df.select(F.lit(side).alias("side"), F.col(c).alias("name"), "s", "n", least.alias("t"), *more, F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

        units = dealt(left, "r", 0, fuzzy_threshold(F.col("r"), t), "p", p, "q", q).unionByName(dealt(right, "e", 1, F.lit(0.0), "q", q, "p", p))
        schema = T.StructType([T.StructField("r", T.StringType()), T.StructField("e", T.StringType()), *[left.schema[c] for c in more], T.StructField("s", T.DoubleType())])
        on = [*more, "p", "q"]
        # A fixed number of partitions: blocks are few bytes and much work, so they are not to be put together.
        found = units.repartition(max(64, p * q) if more else p * q, *on).groupBy(*on).applyInArrow(_near_in_block(more), schema)
        return found.select("r", "e", *more, "s").where(F.col("s") >= fuzzy_threshold(F.col("r"), base))
    near = rare_r.join(rare_e, ["pair", *more]).where(like("r_n", "e_n")).select("r", "e", *more).distinct()
    return near.withColumn("s", similarity(F.col("r"), F.col("e"))).where(F.col("s") >= fuzzy_threshold(F.col("r"), base))


#: Nearer to the best one than this, another name makes a match unsure.
NEAR_TIE = 0.01


def cascade(records: DataFrame, entities: DataFrame, *, record_id: str, key: str, name: str, block: int = 14, fuzzy: bool = True) -> DataFrame:
    """(record_id, match, method, confidence) of records(record_id, key, name) against entities(key, name).

    The first that hits of: the same key; the same first `block` letters of the
    key (smallest key); the same name, refused where it leads to several keys;
    the name most alike, of those alike enough that lead to one key, refused
    where another comes within NEAR_TIE of it. Others stay unmatched. Null keys
    and names match nothing; repeated records are each given.
    """
    r = records.select(F.col(record_id).alias("record_id"), F.col(key).alias("r_key"), F.col(name).alias("r_name"))
    e = entities.select(F.col(key).alias("e_key"), F.col(name).alias("e_name"))
    exact = e.select(F.col("e_key").alias("r_key"), F.col("e_key").alias("m_exact")).distinct()
    blocks = e.groupBy(F.substring("e_key", 1, block).alias("r_block")).agg(F.min("e_key").alias("m_block"))
    names = unique_names(e, "e_key", "e_name").select(F.col("name").alias("r_name"), F.col("key").alias("m_name"))
    out = r.join(exact, "r_key", "left").withColumn("r_block", F.substring("r_key", 1, block)).join(blocks, "r_block", "left").join(names, "r_name", "left")
    if fuzzy:
        left = out.where("m_exact is null and m_block is null and m_name is null").select(F.col("r_name").alias("r"))
        near = alike_names(left, names.select(F.col("r_name").alias("e")))
        best = near.groupBy("r").agg(F.max_by("e", "s").alias("e"), F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 2).alias("s"))
        sure = best.where((F.size("s") < 2) | (F.element_at("s", 1) - F.element_at("s", -1) > NEAR_TIE + 1e-9))
        sure = sure.join(names.select(F.col("r_name").alias("e"), F.col("m_name").alias("m_fuzzy")), "e").select(F.col("r").alias("r_name"), "m_fuzzy")
        out = out.join(sure, "r_name", "left")
    else:
        out = out.withColumn("m_fuzzy", F.lit(None).cast(entities.schema[key].dataType))
    method = F.when(F.col("m_exact").isNotNull(), "exact").when(F.col("m_block").isNotNull(), "block").when(F.col("m_name").isNotNull(), "name").when(F.col("m_fuzzy").isNotNull(), "fuzzy")
    out = out.withColumn("method", method)
    return out.select("record_id", F.coalesce("m_exact", "m_block", "m_name", "m_fuzzy").alias("match"), "method", confidence_of(F.col("method")).alias("confidence"))


def canonical_id(first: Column, number: Column, other: Column) -> Column:
    """The trimmed first id, else PUBCHEM:number over 0, else CHEMBL:other, else null."""
    return F.coalesce(F.nullif(F.trim(first), F.lit("")), F.when(number > 0, F.concat(F.lit("PUBCHEM:"), number.cast("string"))), F.concat(F.lit("CHEMBL:"), F.nullif(F.trim(other), F.lit(""))))


def ingested(records: DataFrame, key: str, fields: Sequence[str], rank: str) -> tuple[DataFrame, DataFrame]:
    """Records of ranked sources merged by key: (per field the value of the best-ranked source, conflicts(key, field, kept, other))."""
    merged = records.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(rank).alias("r"), F.col(c).alias("v"))))["v"].alias(c) for c in fields], F.array_join(F.transform(F.sort_array(F.collect_set(rank)), lambda x: x.cast("string")), "|").alias("sources"))
    conflicts = records.select(key, F.lit("").alias("field"), F.lit("").alias("kept"), F.lit("").alias("other")).limit(0)
    for c in fields:
        kept = merged.select(key, F.col(c).cast("string").alias("kept"))
        part = records.select(key, F.col(c).cast("string").alias("other")).where("other is not null").join(kept, key).where("other <> kept").select(key, F.lit(c).alias("field"), "kept", "other").distinct()
        conflicts = conflicts.unionByName(part)
    return merged, conflicts


def without_source(mapping: DataFrame, sources: str, gone: str) -> DataFrame:
    """Entries that other sources still hold, with the source taken out of the pipe-joined list."""
    left = F.array_remove(F.split(sources, r"\|"), gone)
    return mapping.withColumn(sources, F.array_join(left, "|")).where(F.col(sources) != "")


def as_of(log: DataFrame, key: str, when: str, fields: Sequence[str], action: str, at: object) -> DataFrame:
    """State of each key at a time from a log of changes: the last value that isn't null of each field; removed keys are gone."""
    past = log.where(F.col(when) <= F.lit(at))
    values = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(when))).alias(c) for c in fields]
    return past.groupBy(key).agg(*values, F.max_by(action, when).alias("_last")).where("_last not in ('remove', 'forget')").drop("_last")


def confident(mapping: DataFrame, ids: DataFrame, key: str, confidence: str, least: float) -> DataFrame:
    """ids with their entries of at least that confidence; others, and null keys, are left out."""
    return ids.join(mapping.where(F.col(confidence) >= least), key)


def changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change): added, removed or modified keys."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256).alias(name))

    both = digest(old, "_a").join(digest(new, "_b"), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def thresholds(df: DataFrame, value: str, *, high: float = 0.95, low: float = 0.5, least: int = 10) -> DataFrame:
    """high and low quantiles and the population deviation of values in 0 to 1, to four places; null under `least` values."""
    own = df.where(F.col(value).between(0, 1)).agg(F.count("*").alias("n"), F.stddev_pop(value).alias("std"))
    own = own.join(quantiles(df.where(F.col(value).between(0, 1)), value, {"high": high, "low": low}))
    return own.select("n", *[F.when(F.col("n") >= least, F.round(c, 4)).alias(c) for c in ("high", "low", "std")])


def name_index(df: DataFrame, name: str, key: str) -> DataFrame:
    """name -> how many keys it has, and the smallest."""
    return df.groupBy(name).agg(F.countDistinct(key).alias("n_keys"), F.min(key).alias("first_key"))


def latest_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Of each key the row of the highest version, which must be unique in it; null versions come last."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(version).desc()))
    at = unused("_r", df)
    return df.withColumn(at, rank).where(F.col(at) == 1).drop(at)
