"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate, from a hash of its id, over its
quality weight. Within a source documents come in order of their keys; whole
epochs of the source come first and the rest of its target is a prefix of that
order. The prefix sum has two levels: sums of key ranges, then the order inside
the one range where the target is reached. So no source is ever sorted or
gathered as a whole, texts aren't shuffled, and each text is read once for its
size and weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: A word and the white space before it.
WORD_FROM_LAST = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Key ranges of each source; the one where a target is reached is put in order by one task.
RANGES = 1 << 16
#: Sources up to this many are broadcast to the documents; beyond it both sides are shuffled.
BROADCAST_SOURCES = 200_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: Column) -> Column:
    """A quality weight from 0.25 to 1 by the share of characters that aren't !*$%&#."""
    n = F.length(text)
    return F.when(n > 0, 0.25 + 0.75 * F.length(F.translate(text, "!*$%&#", "")) / n).otherwise(1.0)


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of (source_key, source, source_size): one row per source, ranked in one task.

    Sources by code point, null last, weigh `weights` in turn and share `share`
    times the sum of all sizes. A target stops at `most` times its source's
    size and the excess goes to the others by weight. share must not exceed most.
    """
    if share > most:
        raise ValueError("share must not exceed most")
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source")))
    table = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("weight", F.element_at(table, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    out = out.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("level", "source_key").rowsBetween(W.unboundedPreceding, -1)
    capped, weighed = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("cap", "weight"))
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    out = out.withColumn("free", (total - capped) / (F.sum("weight").over(everything) - weighed))
    # Sources fill in order of their level; the first that doesn't fill sets the level of all later ones.
    water = F.min(F.when(F.col("level") > F.col("free"), F.struct("level", "source_key", "free"))).over(everything)["free"]
    return out.withColumn("water", water).select("source_key", "source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water"))).alias("target"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None, weights: tuple[float, ...], share: float, most: float, seed: int, keep_text: bool) -> DataFrame:
    """(row, size, source_size, target, taken) where row holds docs' columns, the text only on request."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    keep = [c for c in docs.columns if keep_text or c != text_col]
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    quality = plain_share(text) if quality is None else quality
    weight = F.when(quality > 0, quality.cast("double")).otherwise(1.0)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    uniform = (F.conv(F.substring(F.col("digest"), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    own = docs.select(row.alias("row"), words_in(text).alias("size"), F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source)).alias("key"), digest.alias("digest"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("tie"), weight.alias("weight"))
    own = own.withColumn("draw", -F.log(uniform) / F.col("weight")).drop("weight")
    own = scratch.write(own.withColumn("range", F.least(F.floor(RANGES * (1 - F.exp(-F.col("draw")))), F.lit(RANGES - 1)).cast("int")), "own")
    ranges = scratch.write(own.groupBy(F.col("key").alias("source_key"), "range").agg(F.sum("size").alias("n")), "ranges")
    sizes = ranges.groupBy("source_key").agg(F.sum("n").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("source_key") == "0", None).otherwise(F.expr("substring(source_key, 2)")))
    targets = source_targets(sizes, weights=weights, share=share, most=most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long"))
    targets = targets.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = W.partitionBy("source_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    reached = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(targets, "source_key")
    reached = reached.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")) & (F.col("rest") > 0))
    plan = targets.join(reached.select("source_key", F.col("range").alias("edge"), "before"), "source_key", "left")
    plan = scratch.write(plan.select(F.col("source_key").alias("key"), "source_size", "target", "epochs", "rest", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before")), "plan")
    own = own.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, "key")
    result = ["row", "size", "source_size", "target"]
    whole = F.col("epochs") * F.col("size")
    clear = own.where("range <> edge").select(*result, (whole + F.when(F.col("range") < F.col("edge"), F.col("size")).otherwise(0)).alias("taken"))
    order = W.partitionBy("key").orderBy("draw", "digest", "tie").rowsBetween(W.unboundedPreceding, -1)
    edge = own.where("range = edge").withColumn("first", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("before"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("first")))
    return clear.unionByName(edge.select(*result, (whole + part).alias("taken")))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0, keep_text: bool = True) -> DataFrame:
    """docs with size, source_size, target and taken: how many words of each document the mix takes, repeats counted.

    size is the number of words of the text (null: 0). A source gives
    floor(target / source_size) whole epochs; the rest, rounded to a word, is
    the first words of its order of keys, so the last document taken may be
    taken in part and a source's taken words are its target to half a word.
    Texts are written beside their sizes only if they are kept.
    quality is a column of weights over 0 (null and others count as 1); larger
    ones come earlier. Runs with one seed agree.

    Null sources are a source. Null ids and repeated ids draw by their text as
    a tiebreak; rows that repeat both are interchangeable. Columns of docs named
    as the results are replaced, all others stay, whatever their names. An empty
    table gives no rows.
    """
    names = ["size", "source_size", "target", "taken"]
    mixed = _mixed(docs, id_col, text_col, source_col, quality, weights, share, most, seed, keep_text)
    return mixed.select(*[F.col("row")[c].alias(c) for c in docs.columns if (keep_text or c != text_col) and c not in names], *names)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The mix itself, in docs' columns: a row for each time a document is taken.

    Parameters, nulls, ties and repeated rows are as in mix_sources. The last
    document of a source may be cut: its text ends after a word and is as it was
    up to there. Documents without words are never taken; all columns but a cut
    text keep their values, whatever their names.
    """
    mixed = _mixed(docs, id_col, text_col, source_col, quality, weights, share, most, seed, True).where("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    mixed = mixed.withColumn("copy", copies).withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    text = F.col("row")[text_col]
    cut = F.array_join(F.slice(F.regexp_extract_all(text.cast("string"), F.lit(f"({WORD_FROM_LAST})"), 1), F.lit(1), F.col("words").cast("int")), "")
    return mixed.select(*[(F.when(F.col("words") == F.col("size"), text).otherwise(cut) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
