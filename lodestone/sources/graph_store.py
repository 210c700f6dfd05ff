"""Property graphs as tables on disk: nodes by label, edges by relation, so a reader of some labels or relations opens only those."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """nodes(label, id, ...) and edges(src_label, src_id, rel, dst_label, dst_id, ...) to folder/nodes and folder/edges, which are replaced."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str, *, labels: Sequence[str] | None = None, rels: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the labels and relations asked for, or all."""
    nodes, edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    return nodes if labels is None else nodes.where(F.col("label").isin(*labels)), edges if rels is None else edges.where(F.col("rel").isin(*rels))


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fault, n) of what keeps tables from being loaded as a graph: null ids, ids that a label has twice, ends that aren't nodes. No rows: nothing."""
    twice = nodes.where("id is not null").groupBy("label", "id").count().where("count > 1")
    known = nodes.select("label", "id").distinct()
    loose = [edges.join(known.select(F.col("label").alias(f"{e}_label"), F.col("id").alias(f"{e}_id")), [f"{e}_label", f"{e}_id"], "left_anti") for e in ("src", "dst")]
    parts = [("null id", nodes.where("id is null")), ("repeated id", twice), ("missing source", loose[0]), ("missing target", loose[1])]
    out = None
    for name, rows in parts:
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")


def export_tables(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """write_graph of tables without faults; others raise ValueError with them and nothing is written."""
    found = faults(nodes, edges).collect()
    if found:
        raise ValueError("; ".join(f"{r['fault']}: {r['n']}" for r in sorted(found)))
    write_graph(nodes, edges, folder)


def written_back(edges: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the confirmed pairs added, the pairs that are new), both with edges' columns; a pair that is there already changes nothing, repeats count once."""
    keys = ["src_label", "src_id", "rel", "dst_label", "dst_id"]
    new = confirmed.select(*edges.columns).dropDuplicates(keys).join(edges.select(*keys), keys, "left_anti").select(*edges.columns)
    return edges.unionByName(new), new
