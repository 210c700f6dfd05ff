"""Identifier mappings out of alias tables, and pairs of one organism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.scalars import UNIPROT


def accession_rank(c: Column) -> Column:
    """Of several accessions of one entity the one to take sorts first: six-letter ones that begin with O, P or Q and a digit, ten-letter ones of that kind, others; then shorter, then by name."""
    reviewed = c.rlike("^[OPQ][0-9]")
    return F.struct(F.when(reviewed & (F.length(c) == 6), 0).when(reviewed & (F.length(c) == 10), 1).otherwise(2).alias("kind"), F.length(c).alias("length"), c.alias("accession"))


def alias_mapping(aliases: DataFrame, *, id: str = "string_protein_id", alias: str = "alias", source: str = "source", wanted: str = "UniProt_AC") -> tuple[DataFrame, DataFrame]:
    """(id, accession) of each id by the aliases of exactly one source, and (id, alias, source, reason) of the rows that say nothing.

    Ids and aliases are trimmed and upper-cased. Rows of another source, without
    an id or an alias, isoforms (a number after a hyphen) and what has no
    accession's form are left out; of several accessions the first by
    accession_rank() counts. Other columns are ignored.
    """
    def tidy(c: str) -> Column:
        return F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))

    own = aliases.select(tidy(id).alias("id"), tidy(alias).alias("alias"), F.trim(F.col(source)).alias("source"))
    reason = F.when(~F.coalesce(F.col("source") == wanted, F.lit(False)), "source").when(F.col("id").isNull(), "no id").when(F.col("alias").isNull(), "no alias").when(F.col("alias").rlike(r"-\d+$"), "isoform").when(~F.col("alias").rlike(UNIPROT), "form")
    own = own.withColumn("reason", reason)
    good = own.where("reason is null").groupBy("id").agg(F.min(accession_rank(F.col("alias"))).alias("best"))
    return good.select("id", F.col("best.accession").alias("accession")), own.where("reason is not null")


def of_organism(pairs: DataFrame, a: str, b: str, organism: str) -> tuple[DataFrame, DataFrame]:
    """(pairs whose ends both begin with `organism.`, the others). Null ends belong to no organism."""
    def fits(c: str) -> Column:
        return F.coalesce(F.col(c).startswith(f"{organism}."), F.lit(False))

    own = fits(a) & fits(b)
    return pairs.where(own), pairs.where(~own)
