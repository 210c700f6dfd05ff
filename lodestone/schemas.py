"""Contracts of the cleaned source tables: columns, types, which must be there, which alternatives do, least rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

_TYPES = {"string": T.StringType(), "int64": T.LongType(), "float64": T.DoubleType(), "bool": T.BooleanType()}


@dataclass(frozen=True)
class Contract:
    """required and optional are 'name:type' words, with ! where null isn't allowed; any_of are groups of which one column must be there."""

    required: str
    optional: str = ""
    any_of: tuple[tuple[str, ...], ...] = field(default=())
    least_rows: int = 0

    def fields(self, words: str) -> list[T.StructField]:
        out = []
        for word in words.split():
            name, kind = word.split(":")
            out.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
        return out

    @property
    def schema(self) -> T.StructType:
        return T.StructType(self.fields(f"{self.required} {self.optional}"))


# Fixed values of the tables' formats.
CONTRACTS: dict[str, Contract] = {
    "chembl_drugs": Contract("chembl_id:string! inchikey:string!", "name:string! smiles:string molecular_weight:float64 max_phase:int64 is_fda_approved:bool is_globally_approved:bool indication:string indication_source:string mechanism_of_action:string", (), 1),
    "chembl_activities": Contract("molecule_chembl_id:string! target_chembl_id:string! pchembl_value:float64 standard_relation:string", "uniprot_id:string target_name:string activity_type:string activity_value:float64 activity_units:string chembl_id:string", (), 1),
    "drugs": Contract("name:string! inchikey:string!", "drugbank_id:string chembl_id:string pubchem_cid:int64 smiles:string molecular_weight:float64 molecular_formula:string indication:string mechanism_of_action:string groups:string is_fda_approved:bool is_withdrawn:bool max_phase:int64 drug_type:string cas_number:string logp:float64 tpsa:float64", (("drugbank_id", "chembl_id"),)),
    "interactions": Contract("drugbank_id:string! uniprot_id:string! action_type:string", "target_name:string target_chembl_id:string"),
    "indications": Contract("drugbank_id:string! disease_id:string!", "drug_inchikey:string drug_name:string disease_name:string doid_id:string omim_disease_id:string indication:string indication_type:string source:string"),
    "uniprot_proteins": Contract("gene_symbol:string", "uniprot_id:string uniprot_ac:string accession:string protein_name:string ncbi_gene_id:int64 chromosome:string sequence:string function:string organism:string", (("uniprot_ac", "accession", "uniprot_id"),), 1),
    "string_ppi": Contract("combined_score:int64", "string_id_a:string string_id_b:string uniprot_id_a:string uniprot_id_b:string protein_a:string protein_b:string score:int64", (("protein_a", "uniprot_id_a", "string_id_a"), ("protein_b", "uniprot_id_b", "string_id_b")), 1),
    "disgenet_gda": Contract("gene_symbol:string! disease_id:string! score:float64", "gene_id:int64 ncbi_gene_id:int64 disease_name:string source:string year:int64", (("gene_id", "ncbi_gene_id"),), 1),
    "omim_gda": Contract("gene_mim:string! gene_symbol:string! disease_id:string! disease_name:string!", "is_susceptibility:bool", (), 1),
    "omim_susceptibility": Contract("gene_mim:string! gene_symbol:string! disease_id:string! disease_name:string!", "is_susceptibility:bool"),
    "pubchem_enrichment": Contract("inchikey:string! canonical_smiles:string", "pubchem_cid:int64 iupac_name:string molecular_weight:float64 molecular_formula:string logp:float64 tpsa:float64 heavy_atom_count:int64 complexity:float64"),
}


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, broken): missing columns and alternatives, wrong types, nulls where none may be, too few rows; only what is broken."""
    spark, found, there = df.sparkSession, [], set(df.columns)
    for f in contract.fields(contract.required):
        if f.name not in there:
            found.append((f"missing:{f.name}", 1))
    for f in contract.schema.fields:
        if f.name in there and df.schema[f.name].dataType != f.dataType:
            found.append((f"type:{f.name}", 1))
    found += [("any_of:" + "|".join(g), 1) for g in contract.any_of if not there & set(g)]
    fixed = spark.createDataFrame(found, "rule string, broken long")
    strict = [f.name for f in contract.schema.fields if not f.nullable and f.name in there]
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in strict])
    parts = [F.struct(F.lit("rows").alias("rule"), F.greatest(F.lit(0), contract.least_rows - F.col("n")).cast("long").alias("broken"))]
    parts += [F.struct(F.lit(f"null:{c}").alias("rule"), F.col(c).alias("broken")) for c in strict]
    return fixed.unionByName(counts.select(F.explode(F.array(*parts)).alias("r")).select("r.*").where("broken > 0"))
