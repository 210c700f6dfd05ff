"""Scored pairs of a network file, gene crosswalk files whose columns go by several names, sizes of data sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The names that columns of gene crosswalk files go by.
CROSSWALK_COLUMNS = {
    "symbol": ("Approved symbol", "Approved Symbol", "symbol", "Symbol", "HGNC_SYMBOL"),
    "ncbi_gene_id": ("NCBI Gene ID", "NCBI Gene ID(supplied by NCBI)", "entrez_id", "ncbi_gene_id"),
    "uniprot_id": ("UniProt ID", "UniProt ID(supplied by UniProt)", "uniprot_ids", "uniprot_id"),
    "gene_mim": ("OMIM ID", "OMIM ID(supplied by OMIM)", "omim_id", "gene_mim"),
}


def scored_network(pairs: DataFrame, a: str, b: str, score: str, *, organism: str, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(protein_a, protein_b, score, n) of unordered pairs of one organism, each once with its highest score and how many rows it stands for; (a, b, score, reason) of the rows left out.

    Left out are rows whose score isn't a whole number from 0 to `most`, whose
    ends don't both begin with `organism.`, and pairs of a protein with itself.
    Ends are trimmed, the lesser one first.
    """
    one, two = F.trim(F.col(a)), F.trim(F.col(b))
    value = F.col(score).cast("string").try_cast("int")
    mine = F.coalesce(one.startswith(f"{organism}.") & two.startswith(f"{organism}."), F.lit(False))
    reason = F.when(~F.coalesce(value.between(0, most), F.lit(False)), "score").when(~mine, "organism").when(one == two, "itself")
    own = pairs.select(one.alias("a"), two.alias("b"), value.alias("value"), F.col(score).alias("score"), reason.alias("reason"))
    good = own.where("reason is null").groupBy(F.least("a", "b").alias("protein_a"), F.greatest("a", "b").alias("protein_b")).agg(F.max("value").alias("score"), F.count("*").alias("n"))
    return good, own.where("reason is not null").select("a", "b", "score", "reason")


def named_columns(df: DataFrame, names: Mapping[str, Sequence[str]], *, required: Sequence[str] = ()) -> DataFrame:
    """The columns of df by what they are, each under the first of its names that df has; null for one that is nowhere. A required one that is nowhere raises ValueError."""
    held = {what: next((n for n in others if n in df.columns), None) for what, others in names.items()}
    if gone := [what for what in required if held[what] is None]:
        raise ValueError(f"no column of {', '.join(gone)}")
    return df.select(*[(F.col(f"`{n}`") if n else F.lit(None).cast("string")).alias(what) for what, n in held.items()])


def gene_crosswalk(df: DataFrame) -> DataFrame:
    """(symbol, ncbi_gene_id, uniprot_id, gene_mim) by upper-case symbol; of lists of ids (by , or |) the first, of repeated symbols the row with most ids, then the least."""
    def first(c: str) -> Column:
        return F.nullif(F.trim(F.element_at(F.split(F.trim(F.col(c)), r"[,|]"), 1)), F.lit(""))

    fields = [c for c in CROSSWALK_COLUMNS if c != "symbol"]
    own = named_columns(df, CROSSWALK_COLUMNS, required=["symbol"])
    own = own.select(F.nullif(F.upper(F.trim("symbol")), F.lit("")).alias("symbol"), *[first(c).alias(c) for c in fields]).where("symbol is not null")
    empty = sum((F.col(c).isNull().cast("int") for c in fields), F.lit(0))
    best = own.groupBy("symbol").agg(F.min(F.struct(empty.alias("e"), *[F.col(c) for c in fields])).alias("r"))
    return best.select("symbol", *[F.col("r")[c].alias(c) for c in fields])


def dataset_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, rows, columns, complete): complete are the rows without a null."""
    out = None
    for name, df in sorted(tables.items()):
        whole = F.count_if(F.lit(True) if not df.columns else ~F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in df.columns]).contains("true"))
        part = df.agg(F.count("*").alias("rows"), whole.alias("complete")).select(F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"), "complete")
        out = part if out is None else out.unionByName(part)
    return out
