"""Loading of cleaned batches into keyed tables: what each table refuses, which of repeated rows counts, how a known row changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.operators.joins import split_valid


OVERWRITE, KEEP, FILL = "overwrite", "keep", "fill"


@dataclass(frozen=True)
class Rule:
    """How a table takes a batch.

    keys: its key; a row with a null in it is rejected. valid: further
    conditions by name. best: of a batch's rows of a key the first in this order
    counts, ties by all columns. prepare: what happens to a batch before that.
    known: what happens to a known row. OVERWRITE: the batch's values replace
    its own, nulls too; KEEP: values that aren't null do; FILL: only its nulls
    are filled. Columns that a batch lacks stay in any case.
    """

    keys: tuple[str, ...]
    valid: Callable[[], dict[str, Column]] = dict
    best: Callable[[], Sequence[Column]] = tuple
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    known: str = "overwrite"


def ordered_ends(a: str, b: str) -> Callable[[DataFrame], DataFrame]:
    """Puts the lesser end of a pair first."""
    return lambda df: df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def merged_by_name(key: str, name: str) -> Callable[[DataFrame], DataFrame]:
    """Gives rows without a key that of the rows of their name, in any case, if these have one only."""

    def run(df: DataFrame) -> DataFrame:
        low = F.lower(F.trim(name))
        known = df.where(F.col(key).isNotNull() & F.col(name).isNotNull()).groupBy(low.alias("_low")).agg(F.min(key).alias("_key"), F.max(key).alias("_last")).where("_key = _last").drop("_last")
        return df.withColumn("_low", low).join(known, "_low", "left").withColumn(key, F.coalesce(key, "_key")).select(*df.columns)

    return run


RULES: dict[str, Rule] = {
    "drugs": Rule(("inchikey",), valid=lambda: {"name": F.trim("name") != ""}),
    "proteins": Rule(("uniprot_id",), valid=lambda: {"uniprot_id": F.trim("uniprot_id") != ""}),
    "drug_protein": Rule(("drug_id", "protein_id", "source"), valid=lambda: {"activity_value": F.coalesce(F.col("activity_value") >= 0, F.lit(True))}, best=lambda: [F.col("activity_value").asc_nulls_last()]),
    "protein_pairs": Rule(("protein_a", "protein_b"), valid=lambda: {"self": F.col("protein_a") != F.col("protein_b"), "score": F.col("score").between(0, 1000)}, best=lambda: [F.col("score").desc()], prepare=ordered_ends("protein_a", "protein_b")),
    "gene_disease": Rule(("gene_symbol", "disease_id", "source"), valid=lambda: {"score": F.coalesce(F.col("score").between(0, 1), F.lit(True))}, best=lambda: [F.col("score").desc_nulls_last()]),
    "entity_mapping": Rule(("canonical_id",), prepare=merged_by_name("canonical_id", "name")),
    "compound_properties": Rule(("inchikey",), valid=lambda: {"weight": F.coalesce(F.col("weight") > 0, F.lit(True))}),
    "runs": Rule(("run_id",), best=lambda: [F.col("finished").desc_nulls_last()]),
}


def loaded(table: DataFrame, batch: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(the table after a batch, the batch's rejected rows with a reason).

    table has one row for each key and batch its keys and what it has of its
    other columns. Rows of the batch that repeat a key give one row, the rule's
    best. Loading a batch twice changes nothing more. Either may be empty; other
    columns of the batch are ignored, whatever their names.
    """
    given = [c for c in table.columns if c in batch.columns]
    batch = rule.prepare(batch.select(*given))
    keyed = {f"no {k}": F.col(k).isNotNull() for k in rule.keys}
    good, bad = split_valid(batch, keyed | rule.valid())
    order = [*rule.best(), *[F.col(c).asc_nulls_last() for c in given]]
    place = {c: f"_{i}" for i, c in enumerate(given)}
    first = good.select("*", F.row_number().over(W.partitionBy(*rule.keys).orderBy(*order)).alias("_row")).where("_row = 1").drop("_row")
    new = first.select(*[F.col(c).alias(place[c]) for c in given], F.lit(True).alias("_new"))
    own = table.select(F.struct(*table.columns).alias("_own"))
    same = [F.col(f"_own.{k}") == F.col(place[k]) for k in rule.keys]
    both = own.join(new, same, "full_outer")

    def after(c: str) -> Column:
        old = F.col("_own")[c]
        if c not in place:
            return old
        value = F.col(place[c])
        if c in rule.keys or rule.known == KEEP:
            return F.coalesce(value, old)
        return F.coalesce(old, value) if rule.known == FILL else F.when(F.col("_new"), value).otherwise(old)

    return both.select(*[after(c).alias(c) for c in table.columns]), bad
