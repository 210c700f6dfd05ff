"""Protein identity: a cascade over accession, network id, gene with organism and guarded names, and a mapping built from ranked sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.operators.resolve import NEAR_TIE, alike_names

# How sure each method is.
CONFIDENCE = {"accession": 1.0, "network": 0.95, "gene": 0.9, "name": 0.6}


def name_cutoff(base: float, floor: float) -> float:
    """How alike protein names must be."""
    return min(1.05 * max(base, floor), 0.99)


def family_member(name: Column) -> Column:
    """The number or Greek or single letter that ends a name and tells members of a family apart; '' without one."""
    return F.regexp_extract(F.lower(F.trim(name)), r"(?:^|[\s-])([0-9]+[a-z]?|[a-z]|alpha|beta|gamma|delta)$", 1)


def _once(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys that lead to one value."""
    own = df.where(" and ".join(f"{k} is not null" for k in keys))
    return own.groupBy(*keys).agg(F.min(value).alias(out), F.max(value).alias("_last")).where(F.col(out) == F.col("_last")).drop("_last")


def resolved(records: DataFrame, entities: DataFrame, *, base: float = 0.85, floor: float = 0.9, least: int = 6) -> DataFrame:
    """(record_id, match, method, confidence) of records(record_id, accession, network_id, gene, organism, name).

    entities has the same columns but record_id; match is an accession. The
    first that hits of: accession; network id; gene (any case) and organism,
    each refused where it leads to several accessions; the most alike name of
    `least` letters or more in the same organism with the same family member,
    refused where another comes within NEAR_TIE. Nulls match nothing; repeated
    records are each given.
    """
    e = entities.select("accession", "network_id", F.lower("gene").alias("gene"), "organism", "name").distinct()
    r = records.select("record_id", F.col("accession").alias("own"), "network_id", F.lower("gene").alias("gene"), "organism", "name")
    out = r.join(e.where("accession is not null").select(F.col("accession").alias("own"), F.col("accession").alias("m1")).distinct(), "own", "left")
    out = out.join(_once(e, ["network_id"], "accession", "m2"), "network_id", "left").join(_once(e, ["gene", "organism"], "accession", "m3"), ["gene", "organism"], "left")
    left = out.where(F.col("m1").isNull() & F.col("m2").isNull() & F.col("m3").isNull() & (F.length("name") >= least) & F.col("organism").isNotNull())
    named = _once(e.where(F.length("name") >= least), ["name", "organism"], "accession", "m4")
    # Asked for at the cutoff itself, which leaves fewer pairs to compare than base.
    cutoff = name_cutoff(base, floor)
    near = alike_names(left.select(F.col("name").alias("r"), "organism"), named.select(F.col("name").alias("e"), "organism"), base=max(base, cutoff), within="organism").where(F.col("s") >= cutoff)
    near = near.where(family_member(F.col("r")) == family_member(F.col("e")))
    near = near.join(named.withColumnRenamed("name", "e"), ["e", "organism"]).select(F.col("r").alias("name"), "organism", "m4", "s", "e")
    order = W.partitionBy("name", "organism").orderBy(F.col("s").desc(), "e")
    top = near.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("s").over(order)).where("k = 1")
    top = top.where(F.col("next").isNull() | (F.col("s") - F.col("next") > NEAR_TIE + 1e-9)).select("name", "organism", "m4")
    best = left.select("name", "organism").distinct().join(top, ["name", "organism"])
    out = out.join(best, ["name", "organism"], "left")
    method = F.when(F.col("m1").isNotNull(), "accession").when(F.col("m2").isNotNull(), "network").when(F.col("m3").isNotNull(), "gene").when(F.col("m4").isNotNull(), "name")
    sure = F.create_map(*[F.lit(x) for pair in sorted(CONFIDENCE.items()) for x in pair])
    return out.select("record_id", F.coalesce("m1", "m2", "m3", "m4").alias("match"), method.alias("method"), sure[method].alias("confidence"))


def built_mapping(sources: DataFrame) -> DataFrame:
    """(entry, accession, network_id, gene, organism, provisional, sources) from rows (rank, source, accession, network_id, gene, organism).

    Rows belong together by accession; rows without one take that of their
    network id, if it has one only, whichever source came first. What is left is
    a provisional entry by network id, until a source brings its accession. Of
    each field the value of the best-ranked source counts, ties by value; rows
    with neither id are left out.
    """
    lent = _once(sources, ["network_id"], "accession", "_lent")
    own = sources.where("accession is not null or network_id is not null").join(lent, "network_id", "left")
    own = own.withColumn("accession", F.coalesce("accession", "_lent")).withColumn("entry", F.coalesce("accession", F.concat(F.lit("PROVISIONAL:"), "network_id")))
    fields = [F.min(F.when(F.col(c).isNotNull(), F.struct("rank", c)))[c].alias(c) for c in ("accession", "network_id", "gene", "organism")]
    names = F.array_join(F.array_sort(F.collect_set("source")), "|")
    return own.groupBy("entry").agg(*fields, names.alias("sources")).withColumn("provisional", F.col("accession").isNull())
