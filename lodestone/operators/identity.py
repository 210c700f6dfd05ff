"""Identity of graph entities: mappings per type of entity, lookups over several identifier systems, clusters of records that share identifiers.

Every operator gives what it refuses as rows with a reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.scalars import INCHIKEY
from lodestone.operators.components import connected_components
from lodestone.shared import Scratch

# How sure a mapping is by what it rests on, and from where on it counts.
KEYED, UNKEYED, UNMATCHED = 0.99, 0.50, 0.80
NCBI, ENSEMBL, HGNC, OTHER_GENE, CROSSWALKED = 0.95, 0.85, 0.70, 0.50, 0.99
DISEASE, OTHER_DISEASE = 0.90, 0.50
REJECTED_UNDER = 0.50

# Prefixes of disease identifiers and the system that each names.
DISEASE_SYSTEMS = {"DOID:": "doid", "OMIM:": "omim_id", "MESH:": "mesh_id", "EFO:": "efo_id", "HP:": "hpo_id", "ORPHANET:": "orphanet_id", "SNOMED": "snomed_ct", "SCTID:": "snomed_ct", "ICD-10:": "icd_10", "ICD10:": "icd_10"}


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def compound_mappings(records: DataFrame, *, record_id: str, key: Column, name: str, order: Sequence[Column], identifiers: dict[str, Column], refused: dict[str, Column], flags: dict[str, Column], source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mappings, aliases, rejects) of one source's records.

    A record without an id goes as `missing id`, one that repeats an id of an
    earlier one in `order` as `repeated id`, then the first of `refused` that
    holds names why. Others are known by their key (null: none), or else by
    UNRESOLVED:source:id, less sure and to be reviewed. Records of a key are one
    mapping: the first one's name, flags of any, the highest confidence.

    mappings: canonical_id, name, confidence, needs_review, flags (sorted), n
    records. aliases: system, value, canonical_id of the record's id, its key and
    `identifiers` (text or arrays of text; empty ones are none). rejects:
    record_id, reason. `order` must be unique for the records of an id.
    """
    own = records.select(_filled(F.col(record_id).cast("string")).alias("record_id"), _filled(key).alias("key"), F.col(name).alias("name"), F.struct(*order).alias("place"), *[c.alias(f"id_{s}") for s, c in identifiers.items()], F.coalesce(*[F.when(c, F.lit(s)) for s, c in refused.items()], F.lit(None).cast("string")).alias("why"), F.array_sort(F.filter(F.array(*[F.when(c, F.lit(s)) for s, c in flags.items()], F.lit(None).cast("string")), lambda x: x.isNotNull())).alias("flags"))
    first = own.where("record_id is not null").groupBy("record_id").agg(F.min("place").alias("first"))
    reason = F.when(F.col("record_id").isNull(), "missing id").when(F.col("place") > F.col("first"), "repeated id").otherwise(F.col("why"))
    own = own.join(first, "record_id", "left").withColumn("reason", reason).withColumn("canonical_id", F.coalesce("key", F.concat(F.lit(f"UNRESOLVED:{source}:"), "record_id")))
    good = own.where("reason is null")
    keyed = F.col("key").isNotNull()
    mappings = good.groupBy("canonical_id").agg(
        F.min_by("name", F.struct("place", "record_id")).alias("name"),
        F.max(F.when(keyed, KEYED).otherwise(UNKEYED)).alias("confidence"),
        F.bool_or(~keyed).alias("needs_review"),
        F.array_sort(F.flatten(F.collect_set("flags"))).alias("flags"),
        F.count("*").alias("n"),
    )
    mappings = mappings.withColumn("flags", F.array_distinct("flags"))
    values = [F.struct(F.lit("record_id").alias("system"), F.array("record_id").alias("values")), F.struct(F.lit("key").alias("system"), F.array("key").alias("values"))]
    for s in identifiers:
        kind = own.schema[f"id_{s}"].dataType.typeName()
        values.append(F.struct(F.lit(s).alias("system"), (F.col(f"id_{s}") if kind == "array" else F.array(F.col(f"id_{s}").cast("string"))).alias("values")))
    aliases = good.select("canonical_id", F.explode(F.array(*values)).alias("v")).select("canonical_id", "v.system", F.explode("v.values").alias("value"))
    aliases = aliases.select("system", _filled(F.col("value")).alias("value"), "canonical_id").where("value is not null").distinct()
    return mappings, aliases, own.where("reason is not null").select("record_id", "reason")


def alias_conflicts(aliases: DataFrame, shared: Sequence[str] = ()) -> DataFrame:
    """(system, value, n, first_id, last_id) of the aliases that name more than one entity, but for systems whose values are shared by nature."""
    own = aliases.where(~F.col("system").isin(*shared)) if shared else aliases
    found = own.groupBy("system", "value").agg(F.countDistinct("canonical_id").alias("n"), F.min("canonical_id").alias("first_id"), F.max("canonical_id").alias("last_id"))
    return found.where("n > 1")


def looked_up(ids: DataFrame, aliases: DataFrame, mappings: DataFrame, *, least: float = REJECTED_UNDER, reviewed: bool = False, without: Sequence[str] = ()) -> DataFrame:
    """ids(system, value) with canonical_id: the surest mapping of that alias, ties to the smaller id; null where there is none.

    Mappings under `least`, with a flag of `without`, and with reviewed those
    that need review are passed over. ids may repeat; a null value has none.
    """
    fit = mappings.where(F.col("confidence") >= least)
    fit = fit.where(~F.col("needs_review")) if reviewed else fit
    fit = fit.where(~F.arrays_overlap("flags", F.array(*[F.lit(x) for x in without]))) if without else fit
    best = aliases.join(fit.select("canonical_id", "confidence"), "canonical_id").groupBy("system", "value").agg(F.min_by("canonical_id", F.struct(-F.col("confidence"), F.col("canonical_id"))).alias("canonical_id"))
    return ids.join(best, ["system", "value"], "left")


def graph_ids(triples: DataFrame, label: str) -> DataFrame:
    """The distinct trimmed ids of a label at either end of triples(head_type, head_id, tail_type, tail_id); null, empty and nan ones are left out."""
    both = triples.where(F.col("head_type") == label).select(F.col("head_id").alias("id")).unionByName(triples.where(F.col("tail_type") == label).select(F.col("tail_id").alias("id")))
    return both.select(_filled(F.col("id").cast("string")).alias("id")).where("id is not null and lower(id) <> 'nan'").distinct()


def compound_system(c: Column) -> Column:
    """(system, value) that a graph's compound id names by its form, after a `Label::`; null for an unknown form."""
    s = F.regexp_replace(F.trim(c), r"^.*?::", "")
    up = F.upper(s)

    def named(system: str, value: Column) -> Column:
        return F.struct(F.lit(system).alias("system"), value.alias("value"))

    return (
        F.when(up.rlike(INCHIKEY), named("key", up))
        .when(up.rlike(r"^DB\d+$"), named("record_id", up))
        .when(up.rlike(r"^CHEMBL\d+$"), named("chembl_id", up))
        .when(up.rlike(r"^CID\d+$"), named("pubchem_cid", F.substr(up, F.lit(4))))
        .when(s.rlike(r"^\d+$"), named("pubchem_cid", s))
        .when(up.startswith("CHEBI:"), named("chebi_id", F.substr(up, F.lit(7))))
    )


def graph_compounds(triples: DataFrame, aliases: DataFrame, mappings: DataFrame, *, label: str = "Compound", least: float = REJECTED_UNDER, placeholder: float = UNMATCHED) -> DataFrame:
    """(id, canonical_id, confidence, needs_review, matched) of the compounds of a graph.

    An id is looked up in the system that its form names; others get
    UNRESOLVED:GRAPH:id, to be reviewed.
    """
    own = graph_ids(triples, label).withColumn("named", compound_system(F.col("id"))).select("id", "named.system", "named.value")
    found = looked_up(own, aliases, mappings, least=least).join(mappings.select("canonical_id", F.col("confidence").alias("sure"), "needs_review"), "canonical_id", "left")
    hit = F.col("canonical_id").isNotNull()
    return found.select("id", F.coalesce("canonical_id", F.concat(F.lit("UNRESOLVED:GRAPH:"), "id")).alias("canonical_id"), F.coalesce("sure", F.lit(placeholder)).alias("confidence"), F.coalesce("needs_review", F.lit(True)).alias("needs_review"), hit.alias("matched"))


def graph_diseases(triples: DataFrame, *, label: str = "Disease") -> DataFrame:
    """(id, system, value, confidence, needs_review): the ontology that a disease id's prefix names, in any case, and the id there."""
    own = graph_ids(triples, label)
    up = F.upper("id")
    system = F.coalesce(*[F.when(up.startswith(p), F.lit(s)) for p, s in DISEASE_SYSTEMS.items()])
    value = F.regexp_replace("id", "^[^:]*:", "")
    return own.select("id", system.alias("system"), F.when(system.isNotNull(), value).alias("value"), F.when(system.isNotNull(), DISEASE).otherwise(OTHER_DISEASE).alias("confidence"), system.isNull().alias("needs_review"))


def graph_genes(triples: DataFrame, crosswalk: DataFrame, *, label: str = "Gene") -> DataFrame:
    """(id, canonical_id, system, confidence, needs_review) of the genes of a graph.

    Numbers are NCBI ids. An Ensembl id counts by the number that
    crosswalk(ensembl_id, ncbi_gene_id) has for it (the smallest of several),
    else as it is, to be reviewed; HGNC ids and others are to be reviewed.
    """
    own = graph_ids(triples, label)
    up = F.upper("id")
    known = crosswalk.where("ncbi_gene_id is not null").groupBy(F.upper("ensembl_id").alias("up")).agg(F.min(F.col("ncbi_gene_id").cast("long")).cast("string").alias("number"))
    own = own.withColumn("up", up).join(known, "up", "left")
    system = F.when(up.startswith("ENSG"), "ensembl_id").when(F.col("id").rlike(r"^\d+$"), "ncbi_gene_id").when(up.startswith("HGNC:"), "hgnc_id")
    crossed = up.startswith("ENSG") & F.col("number").isNotNull()
    sure = F.when(crossed, CROSSWALKED).when(system == "ensembl_id", ENSEMBL).when(system == "ncbi_gene_id", NCBI).when(system == "hgnc_id", HGNC).otherwise(OTHER_GENE)
    return own.select("id", F.when(crossed, F.col("number")).otherwise(F.col("id")).alias("canonical_id"), system.alias("system"), sure.alias("confidence"), (~(crossed | F.coalesce(system == "ncbi_gene_id", F.lit(False)))).alias("needs_review"))


def merged_mappings(mappings: DataFrame, key: str) -> DataFrame:
    """(canonical_id, survivor) of mappings that share a key: the surest, ties to the smaller id; those without a key are their own."""
    best = mappings.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("canonical_id", F.struct(-F.col("confidence"), F.col("canonical_id"))).alias("survivor"))
    return mappings.join(best, key, "left").select("canonical_id", F.coalesce("survivor", "canonical_id").alias("survivor"))


def identity_clusters(claims: DataFrame, keys: DataFrame, *, max_rounds: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, rejects, conflicts) of records that share identifiers.

    claims: record, system, value; keys: record, key, a record's primary key, of
    which it should have one. Records with a common (system, value) are joined,
    at any distance, to a cluster.

    A cluster of one key is that entity; one without a key is named by its
    smallest record, as UNRESOLVED:record. A cluster of several keys is split: a
    record with a key keeps its own, one without goes to the key that the fewest
    shared identifiers away leads to, and is refused where two keys are as near.
    Records with two keys of their own are refused, and their claims join nothing.

    entities: record, cluster (smallest record), canonical_id, how (`key`,
    `cluster`, `nearest` or `none`). rejects: record, cluster, reason, first_key,
    last_key. conflicts: system, value, n records, first_id, last_id of the
    identifiers that records of different entities hold. Null records, systems
    and values claim nothing; repeated rows count once; a record without any
    claim is a cluster alone.

    No step holds a cluster's or an identifier's rows together: each identifier
    links its records to the smallest one, and a round of the search combines
    what an identifier's holders know to the least and the greatest key.
    """
    scratch = Scratch(claims.sparkSession, "identity")
    own = scratch.write(claims.select("record", "system", "value").where("record is not null and system is not null and value is not null").distinct(), "claims")
    held = keys.where("record is not null and key is not null").groupBy("record").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    records = own.select("record").unionByName(keys.where("record is not null").select("record")).distinct().join(held, "record", "left")
    live = scratch.write(own.join(held.where("first_key <> last_key"), "record", "left_anti"), "live")
    heads = live.groupBy("system", "value").agg(F.min("record").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = live.join(heads, ["system", "value"]).where("record <> head").select(F.col("record").alias("a"), F.col("head").alias("b"))
    found = connected_components(links)
    records = records.join(found.withColumnRenamed("node", "record"), "record", "left").withColumn("cluster", F.coalesce("component", "record")).drop("component")
    records = scratch.write(records, "records")
    sure = F.col("first_key") == F.col("last_key")
    of = records.where(sure).groupBy("cluster").agg(F.min("first_key").alias("one"), F.max("first_key").alias("other"))
    records = scratch.write(records.join(of, "cluster", "left"), "keyed")
    mixed = F.col("one") != F.col("other")
    plain = records.where("one is null or one = other")
    split = scratch.write(records.where(mixed), "split")
    near = scratch.write(split.where(sure).select("record", F.col("first_key").alias("low"), F.col("last_key").alias("high")), "near0")
    if not near.isEmpty():
        inside = scratch.write(live.join(split.select("record"), "record", "left_semi"), "inside")
        front = near
        for turn in range(1, max_rounds + 1):
            known = inside.join(front, "record").groupBy("system", "value").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            open_records = inside.join(split.where("first_key is null").select("record"), "record", "left_semi").join(near.select("record"), "record", "left_anti")
            front = scratch.write(open_records.join(known, ["system", "value"]).groupBy("record").agg(F.min("low").alias("low"), F.max("high").alias("high")), f"front{turn}")
            if front.isEmpty():
                break
            near = near.unionByName(front)
        else:
            raise RuntimeError(f"records unreached after {max_rounds} rounds")
    many = F.col("first_key") != F.col("last_key")
    told = split.join(near, "record", "left").select("record", "cluster", "first_key", "last_key", "low", "high").unionByName(plain.select("record", "cluster", "first_key", "last_key", F.col("one").alias("low"), F.col("one").alias("high")))
    two = F.coalesce(many, F.lit(False))
    unsure = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    told = scratch.write(told.withColumn("reason", F.when(two, "two keys").when(unsure, "two keys as near")), "told")
    clusters = of.where("one <> other").select("cluster", F.lit(True).alias("is_mixed"))
    rejects = told.where("reason is not null").select("record", "cluster", "reason", F.when(F.col("reason") == "two keys", F.col("first_key")).otherwise(F.col("low")).alias("first_key"), F.when(F.col("reason") == "two keys", F.col("last_key")).otherwise(F.col("high")).alias("last_key"))
    how = F.when(F.col("first_key").isNotNull(), "key").when(F.col("low").isNull(), "none").when(F.col("is_mixed"), "nearest").otherwise("cluster")
    entities = told.where("reason is null").join(clusters, "cluster", "left").select("record", "cluster", F.coalesce("low", F.concat(F.lit("UNRESOLVED:"), F.col("cluster").cast("string"))).alias("canonical_id"), how.alias("how"))
    entities = scratch.write(entities, "entities")
    conflicts = own.join(entities, "record").groupBy("system", "value").agg(F.count("*").alias("n"), F.min("canonical_id").alias("first_id"), F.max("canonical_id").alias("last_id")).where("first_id <> last_id")
    return entities, rejects, conflicts
