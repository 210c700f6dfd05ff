"""Table loads, protein identity, reports, stores and paged services on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import scalars as S
from lodestone.functions.text import unicode_key
from lodestone.operators import graph as G, proteins as P, reports as Q, tables as L
from lodestone.operators.ordered import placed
from lodestone.plans.base import Registry, Tables
from lodestone.plans.graph_queries import edges, nodes
from lodestone.shared import Scratch
from lodestone.sources import graph_store, paged, readers, sinks

registry = Registry()
C = F.col


# -- loads of keyed tables -----------------------------------------------------


@registry.add("""
WITH t AS (SELECT 'K' || c_custkey AS inchikey, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS weight FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT 'K' || c_custkey AS inchikey, CASE WHEN c_custkey % 7 > 0 THEN upper(c_mktsegment) ELSE ' ' END AS name, CASE WHEN c_custkey % 5 > 0 THEN 1.0::DOUBLE END AS weight FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 7 > 0)
SELECT inchikey, name, weight FROM b UNION ALL SELECT * FROM t ANTI JOIN b USING (inchikey)""")
def load_drugs(t: Tables) -> DataFrame:
    key = F.concat(F.lit("K"), "c_custkey")
    table = t.customer.where("c_custkey % 2 = 0").select(key.alias("inchikey"), C("c_name").alias("name"), F.when(C("c_custkey") % 3 > 0, C("c_acctbal")).alias("weight"))
    batch = t.customer.where("c_custkey % 3 = 0").select(key.alias("inchikey"), F.when(C("c_custkey") % 7 > 0, F.upper("c_mktsegment")).otherwise(" ").alias("name"), F.when(C("c_custkey") % 5 > 0, F.lit(1.0)).alias("weight"))
    return L.loaded(table, batch, L.RULES["drugs"])[0]


@registry.add("""
SELECT drug_id, protein_id, source, activity_value FROM (
  SELECT l_partkey AS drug_id, l_suppkey AS protein_id, l_returnflag AS source, l_extendedprice AS activity_value, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def load_drug_proteins(t: Tables) -> DataFrame:
    batch = t.lineitem.select(C("l_partkey").alias("drug_id"), C("l_suppkey").alias("protein_id"), C("l_returnflag").alias("source"), C("l_extendedprice").alias("activity_value"))
    return L.loaded(batch.limit(0), batch, L.RULES["drug_protein"])[0]


@registry.add("""
WITH b AS (SELECT least(o_custkey, o_orderkey) AS protein_a, greatest(o_custkey, o_orderkey) AS protein_b, CAST(floor(o_totalprice / 400) AS BIGINT) AS score FROM orders),
t AS (SELECT c_custkey AS protein_a, c_custkey + 1 AS protein_b, 7::BIGINT AS score FROM customer),
n AS (SELECT protein_a, protein_b, max(score) AS score FROM b WHERE protein_a <> protein_b AND score BETWEEN 0 AND 1000 GROUP BY ALL)
SELECT protein_a, protein_b, coalesce(n.score, t.score) AS score FROM t FULL JOIN n USING (protein_a, protein_b)""")
def load_protein_pairs(t: Tables) -> DataFrame:
    batch = t.orders.select(C("o_orderkey").alias("protein_a"), C("o_custkey").alias("protein_b"), F.floor(C("o_totalprice") / 400).alias("score"))
    table = t.customer.select(C("c_custkey").alias("protein_a"), (C("c_custkey") + 1).alias("protein_b"), F.lit(7).cast("long").alias("score"))
    return L.loaded(table, batch, L.RULES["protein_pairs"])[0]


@registry.add("SELECT reason, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN o_orderkey = o_custkey THEN 'self' END, CASE WHEN floor(o_totalprice / 400) NOT BETWEEN 0 AND 1000 THEN 'score' END) AS reason FROM orders) WHERE reason <> '' GROUP BY reason")
def refused_protein_pairs(t: Tables) -> DataFrame:
    batch = t.orders.select(C("o_orderkey").alias("protein_a"), C("o_custkey").alias("protein_b"), F.floor(C("o_totalprice") / 400).alias("score"))
    return L.loaded(batch.limit(0), batch, L.RULES["protein_pairs"])[1].groupBy("reason").agg(F.count("*").alias("n"))


@registry.add("SELECT p_brand AS gene_symbol, p_type AS disease_id, 'x' AS source, max(p_size / 50.0) AS score FROM part WHERE p_size BETWEEN 0 AND 50 GROUP BY ALL")
def load_gene_diseases(t: Tables) -> DataFrame:
    batch = t.part.select(C("p_brand").alias("gene_symbol"), C("p_type").alias("disease_id"), F.lit("x").alias("source"), (C("p_size") / 50.0).alias("score"))
    return L.loaded(batch.limit(0), batch, L.RULES["gene_disease"])[0]


@registry.add("""
WITH b AS (SELECT CASE WHEN c_custkey % 4 > 0 THEN 'E' || c_custkey // 4 END AS canonical_id, 'Name ' || c_custkey // 4 AS name, CASE WHEN c_custkey % 4 IN (0, 2) THEN c_custkey END AS cid FROM customer),
f AS (SELECT coalesce(b.canonical_id, k.canonical_id) AS canonical_id, b.name, b.cid FROM b LEFT JOIN (SELECT DISTINCT name, canonical_id FROM b WHERE canonical_id IS NOT NULL) k ON k.name = b.name)
SELECT canonical_id, arg_min(name, coalesce(cid, 9e15)) AS name, arg_min(CASE WHEN cid IS NOT NULL THEN cid END, coalesce(cid, 9e15)) AS cid FROM f WHERE canonical_id IS NOT NULL GROUP BY canonical_id""")
def load_entity_mapping(t: Tables) -> DataFrame:
    group = F.floor(C("c_custkey") / 4).cast("string")
    batch = t.customer.select(F.when(C("c_custkey") % 4 > 0, F.concat(F.lit("E"), group)).alias("canonical_id"), F.concat(F.lit("Name "), group).alias("name"), F.when((C("c_custkey") % 4).isin(0, 2), C("c_custkey")).alias("cid"))
    return L.loaded(batch.limit(0), batch, L.RULES["entity_mapping"])[0]


@registry.add("SELECT 'run' || user_id AS run_id, max(ts) AS finished FROM events GROUP BY user_id")
def load_runs(t: Tables) -> DataFrame:
    batch = t.events.select(F.concat(F.lit("run"), "user_id").alias("run_id"), C("ts").alias("finished"))
    once = L.loaded(batch.limit(0), batch, L.RULES["runs"])[0]
    return L.loaded(once, batch, L.RULES["runs"])[0]


# Each of these loads a batch twice into a table that holds some of its keys.


def _twice(table: DataFrame, batch: DataFrame, rule: str) -> DataFrame:
    return L.loaded(L.loaded(table, batch, L.RULES[rule])[0], batch, L.RULES[rule])[0]


@registry.add("""
WITH t AS (SELECT 'P' || s_suppkey AS uniprot_id, s_name AS name, 'gene' || s_nationkey AS gene, s_acctbal AS mass FROM supplier WHERE s_suppkey % 2 = 0),
b AS (SELECT CASE WHEN s_suppkey % 10 = 9 THEN ' ' ELSE 'P' || s_suppkey END AS uniprot_id, CASE WHEN s_suppkey % 4 > 0 THEN upper(s_name) END AS name, 'gene' || s_nationkey % 5 AS gene FROM supplier WHERE s_suppkey % 3 = 0)
SELECT b.uniprot_id, b.name, b.gene, t.mass FROM b LEFT JOIN t USING (uniprot_id) WHERE b.uniprot_id <> ' ' UNION ALL SELECT * FROM t ANTI JOIN b USING (uniprot_id)""")
def reload_proteins(t: Tables) -> DataFrame:
    """The batch has no masses: known ones stay."""
    k, text = C("s_suppkey"), C("s_suppkey").cast("string")
    table = t.supplier.where(k % 2 == 0).select(F.concat(F.lit("P"), text).alias("uniprot_id"), C("s_name").alias("name"), F.concat(F.lit("gene"), C("s_nationkey").cast("string")).alias("gene"), C("s_acctbal").alias("mass"))
    batch = t.supplier.where(k % 3 == 0).select(F.when(k % 10 == 9, " ").otherwise(F.concat(F.lit("P"), text)).alias("uniprot_id"), F.when(k % 4 > 0, F.upper("s_name")).alias("name"), F.concat(F.lit("gene"), (C("s_nationkey") % 5).cast("string")).alias("gene"))
    return _twice(table, batch, "proteins")


@registry.add("""
WITH l AS (SELECT l_partkey AS drug_id, l_suppkey AS protein_id, l_returnflag AS source, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice - 5000 END AS activity_value, l_linenumber, l_orderkey FROM lineitem),
t AS (SELECT drug_id, protein_id, source, max(1.0::DOUBLE) AS activity_value FROM l WHERE drug_id % 2 = 0 GROUP BY ALL),
b AS (SELECT drug_id, protein_id, source, min(activity_value) AS activity_value FROM l WHERE coalesce(activity_value >= 0, true) GROUP BY ALL)
SELECT * FROM b UNION ALL SELECT * FROM t ANTI JOIN b USING (drug_id, protein_id, source)""")
def reload_drug_proteins(t: Tables) -> DataFrame:
    batch = t.lineitem.select(C("l_partkey").alias("drug_id"), C("l_suppkey").alias("protein_id"), C("l_returnflag").alias("source"), F.when(C("l_linenumber") % 3 > 0, C("l_extendedprice") - 5000).alias("activity_value"))
    table = batch.where("drug_id % 2 = 0").select("drug_id", "protein_id", "source").distinct().withColumn("activity_value", F.lit(1.0))
    return _twice(table, batch, "drug_protein")


@registry.add("""
WITH b AS (SELECT p_brand AS gene_symbol, CASE WHEN p_partkey % 9 > 0 THEN p_type END AS disease_id, 'x' AS source, CASE WHEN p_partkey % 4 > 0 THEN p_size / 45.0 END AS score FROM part),
n AS (SELECT gene_symbol, disease_id, source, max(score) AS score FROM b WHERE disease_id IS NOT NULL AND coalesce(score BETWEEN 0 AND 1, true) GROUP BY ALL),
t AS (SELECT DISTINCT p_brand AS gene_symbol, p_type AS disease_id, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE 'y' END AS source, -1.0::DOUBLE AS score FROM part WHERE p_size < 30)
SELECT * FROM n UNION ALL SELECT * FROM t ANTI JOIN n USING (gene_symbol, disease_id, source)""")
def reload_gene_diseases(t: Tables) -> DataFrame:
    k = C("p_partkey")
    batch = t.part.select(C("p_brand").alias("gene_symbol"), F.when(k % 9 > 0, C("p_type")).alias("disease_id"), F.lit("x").alias("source"), F.when(k % 4 > 0, C("p_size") / 45.0).alias("score"))
    table = t.part.where("p_size < 30").select(C("p_brand").alias("gene_symbol"), C("p_type").alias("disease_id"), F.when(C("p_size") % 2 == 0, "x").otherwise("y").alias("source")).distinct().withColumn("score", F.lit(-1.0))
    return _twice(table, batch, "gene_disease")


@registry.add("""
WITH t AS (SELECT 'E' || c_custkey AS canonical_id, 'old ' || c_name AS name, c_custkey AS cid FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT CASE WHEN c_custkey % 5 > 0 THEN 'E' || c_custkey END AS canonical_id, 'Name ' || CAST(floor(c_custkey / 5) AS BIGINT) * 5 AS name, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 10 END AS cid FROM customer WHERE c_custkey % 5 IN (0, 1)),
k AS (SELECT name, min(canonical_id) AS id FROM b WHERE canonical_id IS NOT NULL GROUP BY name HAVING count(DISTINCT canonical_id) = 1),
f AS (SELECT coalesce(b.canonical_id, k.id) AS canonical_id, b.name, b.cid FROM b LEFT JOIN k USING (name)),
n AS (SELECT canonical_id, name, cid FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY name, cid NULLS LAST) AS r FROM f WHERE canonical_id IS NOT NULL) WHERE r = 1)
SELECT * FROM n UNION ALL SELECT * FROM t ANTI JOIN n USING (canonical_id)""")
def reload_entity_mapping(t: Tables) -> DataFrame:
    """A batch whose rows without an id take that of their name; its nulls replace known numbers."""
    k, text = C("c_custkey"), C("c_custkey").cast("string")
    table = t.customer.where(k % 2 == 0).select(F.concat(F.lit("E"), text).alias("canonical_id"), F.concat(F.lit("old "), "c_name").alias("name"), k.alias("cid"))
    batch = t.customer.where((k % 5).isin(0, 1)).select(F.when(k % 5 > 0, F.concat(F.lit("E"), text)).alias("canonical_id"), F.concat(F.lit("Name "), (F.floor(k / 5) * 5).cast("string")).alias("name"), F.when(k % 3 > 0, k * 10).alias("cid"))
    return _twice(table, batch, "entity_mapping")


@registry.add("""
WITH t AS (SELECT 'K' || p_partkey AS inchikey, p_retailprice AS weight, p_type AS formula FROM part WHERE p_partkey % 3 = 0),
b AS (SELECT 'K' || p_partkey AS inchikey, CASE WHEN p_partkey % 4 > 0 THEN p_size - 5.0::DOUBLE END AS weight FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT * FROM b WHERE coalesce(weight > 0, true))
SELECT n.inchikey, n.weight, t.formula FROM n LEFT JOIN t USING (inchikey) UNION ALL SELECT * FROM t ANTI JOIN n USING (inchikey)""")
def reload_compound_properties(t: Tables) -> DataFrame:
    key = F.concat(F.lit("K"), C("p_partkey").cast("string"))
    table = t.part.where("p_partkey % 3 = 0").select(key.alias("inchikey"), C("p_retailprice").alias("weight"), C("p_type").alias("formula"))
    batch = t.part.where("p_partkey % 2 = 0").select(key.alias("inchikey"), F.when(C("p_partkey") % 4 > 0, C("p_size") - 5.0).alias("weight"))
    return _twice(table, batch, "compound_properties")


# -- protein identity ------------------------------------------------------------


@registry.add("""
SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 5 < 4 THEN 'A' || s_suppkey END AS match, CASE s_suppkey % 5 WHEN 0 THEN 'accession' WHEN 1 THEN 'network' WHEN 2 THEN 'gene' WHEN 3 THEN 'name' END AS method,
       CASE s_suppkey % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 0.6::DOUBLE END AS confidence FROM supplier""")
def protein_cascade(t: Tables) -> DataFrame:
    n, key = C("s_suppkey") % 5, C("s_suppkey").cast("string")
    name = F.md5(C("s_name").cast("binary"))
    e = t.supplier.select(F.concat(F.lit("A"), key).alias("accession"), F.concat(F.lit("9606."), key).alias("network_id"), F.concat(F.lit("g"), key).alias("gene"), C("s_nationkey").cast("string").alias("organism"), name.alias("name"))
    r = t.supplier.select(C("s_suppkey").alias("record_id"), F.when(n == 0, F.concat(F.lit("A"), key)).alias("accession"), F.when(n == 1, F.concat(F.lit("9606."), key)).alias("network_id"), F.when(n == 2, F.concat(F.lit("G"), key)).alias("gene"), C("s_nationkey").cast("string").alias("organism"), F.when(n == 3, F.concat(name, F.lit("x"))).when(n == 4, F.lit("nothing like it")).alias("name"))
    return P.resolved(r, e)


@registry.add("""
WITH s AS (
  SELECT 1 AS rank, 'u' AS source, 'A' || c_custkey AS accession, CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_custkey END AS network_id, c_mktsegment AS gene FROM customer WHERE c_custkey % 3 > 0
  UNION ALL SELECT 2, 's', NULL, 'N' || c_custkey, lower(c_mktsegment) FROM customer),
l AS (SELECT network_id, min(accession) AS lent FROM s WHERE network_id IS NOT NULL AND accession IS NOT NULL GROUP BY 1),
e AS (SELECT rank, source, coalesce(accession, lent) AS accession, network_id, gene, coalesce(accession, lent, 'PROVISIONAL:' || network_id) AS entry FROM s LEFT JOIN l USING (network_id))
SELECT entry, min(accession) AS accession, min(network_id) AS network_id, arg_min(gene, rank) AS gene, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, min(accession) IS NULL AS provisional FROM e GROUP BY entry""")
def protein_mapping(t: Tables) -> DataFrame:
    key = C("c_custkey").cast("string")
    none = F.lit(None).cast("string")
    known = t.customer.where("c_custkey % 3 > 0").select(F.lit(1).alias("rank"), F.lit("u").alias("source"), F.concat(F.lit("A"), key).alias("accession"), F.when(C("c_custkey") % 2 == 0, F.concat(F.lit("N"), key)).alias("network_id"), C("c_mktsegment").alias("gene"), none.alias("organism"))
    alias = t.customer.select(F.lit(2).alias("rank"), F.lit("s").alias("source"), none.alias("accession"), F.concat(F.lit("N"), key).alias("network_id"), F.lower("c_mktsegment").alias("gene"), none.alias("organism"))
    return P.built_mapping(known.unionByName(alias)).drop("organism")


# -- reports -----------------------------------------------------------------------


@registry.add(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS filled, count(v) AS \"distinct\", count(*) FILTER (v IS NOT NULL AND n > 1) AS repeated FROM (SELECT {c} AS v, count(*) AS n FROM documents GROUP BY 1)" for c in ("source", "lang", "text")))
def cardinalities(t: Tables) -> DataFrame:
    return Q.snapshot(t.documents, ["source", "lang", "text"])


@registry.add("SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS stale FROM events GROUP BY event_type")
def stale_events(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts")).first()[0]
    return Q.stale(t.events, "event_type", "ts", F.lit(now), 1.0).withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


@registry.add("SELECT event_id, count(*) OVER w AS recent, count(*) OVER w > 40 AS refused FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)")
def call_rates(t: Tables) -> DataFrame:
    return Q.over_rate(t.events, "event_type", "ts", seconds=86400, most=40).select("event_id", "recent", "refused")


@registry.add("""
SELECT event_id, value, event_type = 'click' AS label, row_number() OVER (ORDER BY value DESC, event_id) AS rank, round(1 - (row_number() OVER (ORDER BY value DESC, event_id) - 1) / count(*) OVER (), 9) AS percentile,
       (value >= 50)::INT AS predicted, CASE WHEN value >= 50 AND event_type = 'click' THEN 'tp' WHEN value >= 50 THEN 'fp' WHEN event_type = 'click' THEN 'fn' ELSE 'tn' END AS kind FROM events WHERE value IS NOT NULL""")
def prediction_breakdown(t: Tables) -> DataFrame:
    own = t.events.select("event_id", "value", (C("event_type") == "click").cast("int").alias("label"))
    return Q.breakdown(own, "event_id", "value", "label", threshold=50).withColumns({"percentile": F.round("percentile", 9), "label": C("label") == 1})


@registry.add("""
WITH a AS (SELECT c_custkey AS k, c_acctbal AS s, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_custkey % 5 > 0), b AS (SELECT c_custkey AS k, -c_acctbal AS s, row_number() OVER (ORDER BY -c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_custkey % 7 > 0)
SELECT coalesce(a.k, b.k) AS c_custkey, round(b.s - a.s, 6) AS score_change, b.r - a.r AS rank_change, CASE WHEN a.k IS NULL THEN 'after' WHEN b.k IS NULL THEN 'before' END AS only FROM a FULL JOIN b ON a.k = b.k""")
def prediction_changes(t: Tables) -> DataFrame:
    own = t.customer.select("c_custkey", C("c_acctbal").alias("s"), F.lit(0).alias("y"))
    one = Q.breakdown(own.where("c_custkey % 5 > 0"), "c_custkey", "s", "y", threshold=0)
    two = Q.breakdown(own.where("c_custkey % 7 > 0").withColumn("s", -C("s")), "c_custkey", "s", "y", threshold=0)
    return Q.run_changes(one, two, "c_custkey", "s", "rank").withColumn("score_change", F.round("score_change", 6))


@registry.add("""
WITH p AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT c, s, c_acctbal, s_acctbal, [CAST(c_nationkey % 5 AS VARCHAR), CAST(c_custkey % 5 AS VARCHAR)] AS x, [CAST(s_nationkey % 5 AS VARCHAR), CAST(s_suppkey % 3 AS VARCHAR)] AS y FROM p LEFT JOIN customer ON c_custkey = c LEFT JOIN supplier ON s_suppkey = s)
SELECT c, s, c_acctbal, s_acctbal, round(len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(list_concat(x, y))), 9) AS overlap FROM f""")
def supplemented_pairs(t: Tables) -> DataFrame:
    pairs = t.orders.join(t.lineitem, C("l_orderkey") == C("o_orderkey")).select(C("o_custkey").alias("c"), C("l_suppkey").alias("s")).distinct()
    left = t.customer.select(C("c_custkey").alias("c"), "c_acctbal", F.array((C("c_nationkey") % 5).cast("string"), (C("c_custkey") % 5).cast("string")).alias("x"))
    right = t.supplier.select(C("s_suppkey").alias("s"), "s_acctbal", F.array((C("s_nationkey") % 5).cast("string"), (C("s_suppkey") % 3).cast("string")).alias("y"))
    return Q.supplemented(pairs, "c", left, "s", right, sets=("x", "y")).withColumn("overlap", F.round("overlap", 9))


@registry.add("SELECT coalesce(c_custkey, s_suppkey) AS k, c_name AS name, c_nationkey AS nation, s_name AS name_2 FROM customer FULL JOIN supplier ON s_suppkey = c_custkey")
def tables_beside(t: Tables) -> DataFrame:
    one = t.customer.select(C("c_custkey").alias("k"), C("c_name").alias("name"), C("c_nationkey").alias("nation"))
    return Q.beside(one, t.supplier.select(C("s_suppkey").alias("k"), C("s_name").alias("name")), "k")


@registry.add("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 6) AS score FROM embeddings")
def scored_vectors(t: Tables) -> DataFrame:
    def predict(batch):
        import numpy as np
        import pandas as pd

        m = np.array(batch["embedding"].tolist(), dtype=float)
        return pd.Series(m @ np.arange(1, m.shape[1] + 1), index=batch.index)

    return Q.scored(t.embeddings.select("vec_id", "embedding"), predict, ["embedding"]).select("vec_id", F.round("score", 6).alias("score"))


@registry.add("""
SELECT 'C' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'ABCDEFGHIJKLMN-OPQRSTUVWX-Y' END AS inchikey, CASE WHEN p_partkey % 4 > 0 THEN 'part ' || p_partkey END AS name, 'C2H6O' AS formula,
       CASE WHEN p_size <= 4 THEN p_size END AS phase, p_size % 2 = 0 AS approved, CASE WHEN p_size > 9 THEN p_retailprice END AS weight, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 4 = 0 THEN 'unidentified' END AS reason FROM part""")
def standard_drug_records(t: Tables) -> DataFrame:
    key = C("p_partkey")
    raw = t.part.select(
        F.concat(F.lit("C"), key).alias("id"),
        F.when(key % 3 == 0, " abcdefghijklmnopqrstuvwxy ").otherwise("none").alias("inchikey"),
        F.when(key % 4 > 0, F.concat(F.lit("  Part  "), key)).otherwise("N/A").alias("name"),
        F.lit("OC2H6").alias("formula"),
        C("p_size").cast("string").alias("phase"),
        F.when(C("p_size") % 2 == 0, " Yes").otherwise("no").alias("approved"),
        F.when(C("p_size") > 9, C("p_retailprice").cast("string")).otherwise("-1").alias("weight"),
    )
    return Q.standard_records(raw)


# -- stores, files and services ------------------------------------------------------


@registry.add("SELECT 'Customer' AS src_label, o_custkey AS src_id, 'placed' AS rel, 'Order' AS dst_label, o_orderkey AS dst_id, 0.9::DOUBLE AS confidence FROM orders UNION ALL SELECT DISTINCT 'Order', l_orderkey, 'contains', 'Part', l_partkey, 0.8::DOUBLE FROM lineitem")
def graph_store_relations(t: Tables) -> DataFrame:
    folder = Scratch(t.spark, "graph").folder("store")
    graph_store.write_graph(nodes(t), edges(t), folder)
    _, kept = graph_store.read_graph(t.spark, folder, rels=["placed", "contains"])
    return kept.select("src_label", "src_id", "rel", "dst_label", "dst_id", "confidence")


@registry.add("""
WITH n AS (SELECT 'Customer' AS label, c_custkey AS id FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT 'Order', o_orderkey FROM orders UNION ALL SELECT 'Order', o_orderkey FROM orders WHERE o_orderkey % 100 = 0)
SELECT * FROM (SELECT 'repeated id' AS fault, count(*) AS n FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT 'missing source', count(*) FROM orders WHERE o_custkey NOT IN (SELECT id FROM n WHERE label = 'Customer')) WHERE n > 0""")
def graph_faults(t: Tables) -> DataFrame:
    order = t.orders.select(F.lit("Order").alias("label"), C("o_orderkey").alias("id"))
    own = t.customer.where("c_custkey % 10 > 0").select(F.lit("Customer").alias("label"), C("c_custkey").alias("id")).unionByName(order).unionByName(order.where("id % 100 = 0"))
    return graph_store.faults(own, edges(t).where("rel = 'placed'"))


@registry.add("SELECT count(*) AS edges, count(*) FILTER (fresh) AS fresh FROM (SELECT DISTINCT s, d, fresh FROM (SELECT o_custkey AS s, o_orderkey AS d, false AS fresh FROM orders UNION ALL SELECT c_custkey, c_custkey * 4, true FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey = c_custkey * 4)))")
def written_back_edges(t: Tables) -> DataFrame:
    own = edges(t).where("rel = 'placed'")
    confirmed = t.customer.select(F.lit("Customer").alias("src_label"), C("c_custkey").alias("src_id"), F.lit("placed").alias("rel"), F.lit("Order").alias("dst_label"), (C("c_custkey") * 4).alias("dst_id"), F.lit(1.0).alias("confidence"))
    after, new = graph_store.written_back(own, confirmed.unionByName(confirmed))
    return after.agg(F.count("*").alias("edges")).join(new.agg(F.count("*").alias("fresh")))


@registry.add("SELECT (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 1000 AS chunk, o_orderkey FROM orders")
def export_chunks(t: Tables) -> DataFrame:
    own = placed(t.orders.select("o_orderkey", "o_totalprice"), [C("o_totalprice"), C("o_orderkey")])
    folder = Scratch(t.spark, "export").folder("chunks")
    sinks.write_chunks(own.select("o_orderkey", "o_totalprice", "position"), folder, "position", 1000)
    return t.spark.read.schema("o_orderkey long, o_totalprice double, chunk long").option("header", True).csv(folder).select("chunk", "o_orderkey")


@registry.add("SELECT c_custkey, c_name || chr(10) || '\"' || c_mktsegment AS name, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance FROM customer")
def csv_scan(t: Tables) -> DataFrame:
    folder = Scratch(t.spark, "csv").folder("files")
    own = t.customer.select("c_custkey", F.concat("c_name", F.lit('\n"'), "c_mktsegment").alias("name"), F.when(C("c_custkey") % 3 > 0, C("c_acctbal").cast("string")).otherwise("N/A").alias("balance"))
    own.write.option("header", True).option("compression", "gzip").option("escape", '"').csv(folder)
    return readers.typed_csv(t.spark, folder, "c_custkey long, name string, balance double", multi_line=True)[0]


@registry.add("SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_quantity AS quantity FROM lineitem")
def json_children(t: Tables) -> DataFrame:
    folder = Scratch(t.spark, "json").folder("files")
    line = F.struct(C("l_linenumber").alias("line"), F.struct(C("l_partkey").alias("part"), C("l_quantity").alias("quantity")).alias("what"))
    t.lineitem.groupBy(C("l_orderkey").alias("id")).agg(F.collect_list(line).alias("lines")).write.json(folder)
    good, _ = readers.json_lines(t.spark, folder, "id long, lines array<struct<line: int, what: struct<part: long, quantity: double>>>")
    return readers.children(good, "id", "lines").select("id", "line", "what.part", "what.quantity")


@registry.add("SELECT o_orderkey AS id, o_orderpriority AS name, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def xml_children(t: Tables) -> DataFrame:
    folder = Scratch(t.spark, "xml").folder("files")
    parts = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(C("l_linenumber").alias("number"))).alias("target"))
    own = t.orders.join(parts, C("l_orderkey") == C("o_orderkey")).select(C("o_orderkey").alias("id"), C("o_orderpriority").alias("name"), F.struct("target").alias("targets"))
    own.write.format("xml").option("rowTag", "drug").option("rootTag", "drugs").save(folder)
    rows = readers.xml_rows(t.spark, folder, "drug", "id long, name string, targets struct<target: array<struct<number: int>>>")
    one = readers.children(rows.select("id", "name", C("targets.target").alias("target")), "id", "target")
    return one.join(rows.select("id", "name"), "id").groupBy("id", "name").agg(F.sum("number").alias("lines"), F.count("*").alias("n"))


@registry.add("SELECT n_nationkey, i // 10 AS page, n_nationkey * 1000 + i AS item FROM nation, range(100) r(i) WHERE i < n_nationkey * 7 % 45")
def paged_items(t: Tables) -> DataFrame:
    fetch = paged.by_offset(lambda key, at, size: [{"item": key * 1000 + i} for i in range(at, min(at + size, key * 7 % 45))], 10)
    return paged.paged(t.nation, "n_nationkey", paged.patient(fetch), "item long", most_pages=10)[0]


@registry.add("SELECT doc_id, lower(strip_accents(text)) AS name FROM documents")
def unicode_names(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", unicode_key(C("text")).alias("name"))


@registry.add("SELECT DISTINCT organism, count(*) AS n FROM (SELECT CASE WHEN s_nationkey % 3 = 0 THEN 'Homo sapiens' WHEN s_nationkey % 3 = 1 THEN 'Mus musculus' ELSE 'nation ' || s_nationkey END AS organism FROM supplier) GROUP BY organism")
def organisms(t: Tables) -> DataFrame:
    raw = F.when(C("s_nationkey") % 3 == 0, " HUMAN ").when(C("s_nationkey") % 3 == 1, "mouse").otherwise(F.concat(F.lit("nation "), "s_nationkey"))
    own = t.supplier.select(S.organism(raw, {"human": "Homo sapiens", "mouse": "Mus musculus"}).alias("organism"))
    return own.groupBy("organism").agg(F.count("*").alias("n"))


@registry.add("""
WITH RECURSIVE x AS (
  SELECT 'Customer' AS sl, o_custkey AS s, 'placed' AS rel, 'Order' AS dl, o_orderkey AS d FROM orders
  UNION SELECT 'Order', l_orderkey, 'contains', 'Part', l_partkey FROM lineitem UNION SELECT 'Part', l_partkey, 'from', 'Supplier', l_suppkey FROM lineitem),
one AS (SELECT * FROM x WHERE sl = 'Customer' AND s = 1)
SELECT 1 AS depth, sl AS src_label, s AS src_id, rel, dl AS dst_label, d AS dst_id FROM one UNION SELECT 2, x.* FROM x WHERE (sl, s) IN (SELECT dl, d FROM one)""")
def graph_explored(t: Tables) -> DataFrame:
    start = t.spark.createDataFrame([("Customer", 1)], "label string, id long")
    return G.explored(edges(t), start, max_depth=2).select("depth", "src_label", "src_id", "rel", "dst_label", "dst_id")
