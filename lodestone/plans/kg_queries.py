"""Identity of graph entities, match methods, state of resolvers, splits, paths, scores, stores and streams on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import scalars as S
from lodestone.functions.registry import Cleaning
from lodestone.operators import graph as G, identity as I, matching as M, paths as P, vectors as V
from lodestone.operators.components import connected_components
from lodestone.plans.base import Registry, Tables
from lodestone.shared import Scratch
from lodestone.sources.aliases import alias_mapping, of_organism
from lodestone.sources.nested import Level, child_tables, interactions, parsed_once
from lodestone.sources.sinks import replace_partitions
from lodestone.sources.sql_source import read_sqlite, write_sqlite
from lodestone.streaming.committed import Committed, pairs_sink, run_batches
from lodestone.streaming.resolver import ResolverState

registry = Registry()
C = F.col


# -- mappings of compounds, diseases and genes ---------------------------------

_RECORDS = """
r AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN ' ' WHEN p_partkey % 10 = 9 THEN 'DB' || (p_partkey - 9) ELSE 'DB' || p_partkey END AS rid,
             CASE WHEN p_partkey % 3 > 0 THEN 'K' || CAST(floor(p_partkey / 4) AS BIGINT) END AS key, p_name, p_size, p_brand, p_type FROM part),
w AS (SELECT *, nullif(trim(rid), '') AS record_id, min(p_partkey) OVER (PARTITION BY rid) AS f FROM r),
j AS (SELECT *, CASE WHEN record_id IS NULL THEN 'missing id' WHEN p_partkey > f THEN 'repeated id' WHEN p_size = 1 THEN 'withdrawn' WHEN p_size = 2 THEN 'deprecated' END AS reason, coalesce(key, 'UNRESOLVED:PARTS:' || record_id) AS canonical_id FROM w),
m AS (SELECT canonical_id, arg_min(p_name, p_partkey) AS name, max(CASE WHEN key IS NULL THEN 0.5::DOUBLE ELSE 0.99::DOUBLE END) AS confidence, bool_or(key IS NULL) AS needs_review,
             array_to_string(list_filter([CASE WHEN bool_or(p_size > 40) THEN 'illicit' END, CASE WHEN bool_or(p_brand = 'Brand#1') THEN 'kept' END], lambda x: x IS NOT NULL), ',') AS flags, count(*) AS n
      FROM j WHERE reason IS NULL GROUP BY canonical_id),
a AS (SELECT DISTINCT system, value, canonical_id FROM (
  SELECT canonical_id, 'record_id' AS system, record_id AS value FROM j WHERE reason IS NULL UNION ALL SELECT canonical_id, 'key', key FROM j WHERE reason IS NULL
  UNION ALL SELECT canonical_id, 'chembl_id', 'CHEMBL' || p_partkey % 500 FROM j WHERE reason IS NULL UNION ALL SELECT canonical_id, 'class', unnest([p_brand, p_type]) FROM j WHERE reason IS NULL) WHERE value IS NOT NULL)
"""


def _compounds(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = C("p_partkey")
    rid = F.when(k % 50 == 0, " ").when(k % 10 == 9, F.concat(F.lit("DB"), (k - 9).cast("string"))).otherwise(F.concat(F.lit("DB"), k.cast("string")))
    key = F.when(k % 3 > 0, F.concat(F.lit("K"), F.floor(k / 4).cast("string")))
    return I.compound_mappings(
        t.part.withColumn("rid", rid), record_id="rid", key=key, name="p_name", order=[k], source="PARTS",
        identifiers={"chembl_id": F.concat(F.lit("CHEMBL"), (k % 500).cast("string")), "class": F.array("p_brand", "p_type")},
        refused={"withdrawn": C("p_size") == 1, "deprecated": C("p_size") == 2}, flags={"illicit": C("p_size") > 40, "kept": C("p_brand") == "Brand#1"},
    )


@registry.add(f"WITH {_RECORDS} SELECT * FROM m")
def kg_compounds(t: Tables) -> DataFrame:
    return _compounds(t)[0].withColumn("flags", F.array_join("flags", ","))


@registry.add(f"WITH {_RECORDS} SELECT record_id, reason FROM j WHERE reason IS NOT NULL")
def kg_compound_rejects(t: Tables) -> DataFrame:
    return _compounds(t)[2]


@registry.add(f"WITH {_RECORDS} SELECT system, value, count(DISTINCT canonical_id) AS n, min(canonical_id) AS first_id, max(canonical_id) AS last_id FROM a WHERE system <> 'class' GROUP BY ALL HAVING count(DISTINCT canonical_id) > 1")
def kg_alias_conflicts(t: Tables) -> DataFrame:
    return I.alias_conflicts(_compounds(t)[1], ["class"])


_TRIPLES = """
t AS (SELECT 'Compound' AS head_type, CASE l_orderkey % 4 WHEN 0 THEN 'Compound::DB' || l_partkey WHEN 1 THEN ' chembl' || l_partkey % 700 || ' ' WHEN 2 THEN 'CID' || l_partkey ELSE 'name ' || l_suppkey END AS head_id,
             CASE l_linenumber % 2 WHEN 0 THEN 'Disease' ELSE 'Gene' END AS tail_type,
             CASE WHEN l_linenumber % 2 = 0 THEN CASE l_suppkey % 5 WHEN 0 THEN 'doid:' WHEN 1 THEN 'MESH:D' WHEN 2 THEN 'SNOMED CT:' WHEN 3 THEN 'ICD10:' ELSE 'x' END || l_suppkey
                  ELSE CASE l_suppkey % 5 WHEN 0 THEN 'ENSG' WHEN 1 THEN 'HGNC:' WHEN 2 THEN 'nan' WHEN 3 THEN 'G-' ELSE '' END || CASE WHEN l_suppkey % 5 = 2 THEN '' ELSE '' || l_suppkey END END AS tail_id
      FROM lineitem)
"""


def _triples(t: Tables) -> DataFrame:
    s, p = C("l_suppkey"), C("l_partkey")
    text, odd = s.cast("string"), C("l_linenumber") % 2 == 1
    order = C("l_orderkey") % 4
    head = F.when(order == 0, F.concat(F.lit("Compound::DB"), p.cast("string"))).when(order == 1, F.concat(F.lit(" chembl"), (p % 700).cast("string"), F.lit(" "))).when(order == 2, F.concat(F.lit("CID"), p.cast("string"))).otherwise(F.concat(F.lit("name "), text))
    kind = s % 5
    disease = F.concat(F.when(kind == 0, "doid:").when(kind == 1, "MESH:D").when(kind == 2, "SNOMED CT:").when(kind == 3, "ICD10:").otherwise("x"), text)
    gene = F.concat(F.when(kind == 0, "ENSG").when(kind == 1, "HGNC:").when(kind == 2, "nan").when(kind == 3, "G-").otherwise(""), F.when(kind == 2, "").otherwise(text))
    return t.lineitem.select(F.lit("Compound").alias("head_type"), head.alias("head_id"), F.when(odd, "Gene").otherwise("Disease").alias("tail_type"), F.when(odd, gene).otherwise(disease).alias("tail_id"))


@registry.add(rf"""
WITH {_RECORDS}, {_TRIPLES},
g AS (SELECT DISTINCT trim(head_id) AS id FROM t),
d AS (SELECT id, regexp_replace(upper(id), '^.*?::', '') AS u FROM g),
n AS (SELECT id, CASE WHEN regexp_matches(u, '^DB\d+$') THEN 'record_id' WHEN regexp_matches(u, '^CHEMBL\d+$') THEN 'chembl_id' WHEN regexp_matches(u, '^CID\d+$') THEN 'pubchem_cid' END AS system, CASE WHEN u LIKE 'CID%' THEN substr(u, 4) ELSE u END AS value FROM d),
l AS (SELECT system, value, arg_min(a.canonical_id, (-m.confidence, a.canonical_id)) AS c FROM a JOIN m USING (canonical_id) GROUP BY ALL)
SELECT n.id, coalesce(l.c, 'UNRESOLVED:GRAPH:' || n.id) AS canonical_id, coalesce(m.confidence, 0.8::DOUBLE) AS confidence, coalesce(m.needs_review, true) AS needs_review, l.c IS NOT NULL AS matched
FROM n LEFT JOIN l ON l.system = n.system AND l.value = n.value LEFT JOIN m ON m.canonical_id = l.c""")
def kg_graph_compounds(t: Tables) -> DataFrame:
    mappings, aliases, _ = _compounds(t)
    return I.graph_compounds(_triples(t), aliases, mappings)


@registry.add(rf"""
WITH {_TRIPLES}, g AS (SELECT DISTINCT trim(tail_id) AS id FROM t WHERE tail_type = 'Disease')
SELECT id, s AS system, CASE WHEN s IS NOT NULL THEN regexp_replace(id, '^[^:]*:', '') END AS value, CASE WHEN s IS NULL THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence, s IS NULL AS needs_review
FROM (SELECT id, CASE WHEN upper(id) LIKE 'DOID:%' THEN 'doid' WHEN upper(id) LIKE 'MESH:%' THEN 'mesh_id' WHEN upper(id) LIKE 'SNOMED%' THEN 'snomed_ct' WHEN upper(id) LIKE 'ICD10:%' THEN 'icd_10' END AS s FROM g)""")
def kg_graph_diseases(t: Tables) -> DataFrame:
    return I.graph_diseases(_triples(t))


@registry.add(rf"""
WITH {_TRIPLES}, g AS (SELECT DISTINCT trim(tail_id) AS id FROM t WHERE tail_type = 'Gene' AND trim(tail_id) NOT IN ('', 'nan')),
x AS (SELECT 'ENSG' || s_suppkey AS e, '' || min(s_nationkey * 1000 + s_suppkey) AS n FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT id, coalesce(n, id) AS canonical_id, s AS system, CASE WHEN n IS NOT NULL THEN 0.99::DOUBLE WHEN s = 'ensembl_id' THEN 0.85::DOUBLE WHEN s = 'ncbi_gene_id' THEN 0.95::DOUBLE WHEN s = 'hgnc_id' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
       NOT (n IS NOT NULL OR coalesce(s = 'ncbi_gene_id', false)) AS needs_review
FROM (SELECT id, n, CASE WHEN id LIKE 'ENSG%' THEN 'ensembl_id' WHEN regexp_matches(id, '^\d+$') THEN 'ncbi_gene_id' WHEN id LIKE 'HGNC:%' THEN 'hgnc_id' END AS s FROM g LEFT JOIN x ON e = id)""")
def kg_graph_genes(t: Tables) -> DataFrame:
    crosswalk = t.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("ENSG"), "s_suppkey").alias("ensembl_id"), (C("s_nationkey") * 1000 + C("s_suppkey")).cast("string").alias("ncbi_gene_id"))
    return I.graph_genes(_triples(t), crosswalk)


# -- clusters of records that share identifiers ---------------------------------

_CLAIMS = """
claims AS (SELECT c_custkey AS record, 'pair' AS system, '' || CAST(floor(c_custkey / 3) AS BIGINT) AS value FROM customer WHERE c_custkey % 2 = 0
           UNION ALL SELECT c_custkey, 'home', c_nationkey || ':' || c_mktsegment || ':' || CAST(floor(c_custkey / 40) AS BIGINT) FROM customer
           UNION ALL SELECT c_custkey, 'next', '' || CAST(floor((c_custkey + 1) / 4) AS BIGINT) FROM customer WHERE c_custkey % 5 = 0),
keys AS (SELECT c_custkey AS record, 'K' || CAST(floor(c_custkey / 30) AS BIGINT) AS key FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'L' FROM customer WHERE c_custkey % 100 = 0),
two AS (SELECT record, min(key) AS a, max(key) AS b FROM keys GROUP BY record),
live AS (SELECT * FROM claims WHERE record NOT IN (SELECT record FROM two WHERE a <> b)),
near AS (SELECT DISTINCT x.record AS a, y.record AS b FROM live x JOIN live y USING (system, value)),
"""
_CLUSTERS = f"""
WITH RECURSIVE {_CLAIMS}
reach AS (SELECT c_custkey AS record, c_custkey AS other FROM customer UNION SELECT r.record, n.b FROM reach r JOIN near n ON n.a = r.other),
cluster AS (SELECT record, min(other) AS cluster FROM reach GROUP BY record),
sure AS (SELECT record, a AS key FROM two WHERE a = b),
walk AS (SELECT record, key, 0 AS d FROM sure UNION SELECT n.b, w.key, d + 1 FROM walk w JOIN near n ON n.a = w.record WHERE d < 12 AND n.b NOT IN (SELECT record FROM sure)),
least AS (SELECT record, min(d) AS d FROM walk GROUP BY record),
best AS (SELECT record, min(key) AS low, max(key) AS high FROM walk JOIN least USING (record, d) GROUP BY record),
of AS (SELECT cluster, min(key) AS one, max(key) AS other FROM sure JOIN cluster USING (record) GROUP BY cluster),
told AS (
  SELECT c.record, c.cluster, t.a, t.b, CASE WHEN o.one = o.other THEN o.one ELSE n.low END AS low, CASE WHEN o.one = o.other THEN o.one ELSE n.high END AS high, o.one <> o.other AS mixed
  FROM cluster c LEFT JOIN two t USING (record) LEFT JOIN of o USING (cluster) LEFT JOIN best n USING (record)
),
entities AS (
  SELECT record, cluster, coalesce(low, 'UNRESOLVED:' || cluster) AS canonical_id, CASE WHEN a IS NOT NULL THEN 'key' WHEN low IS NULL THEN 'none' WHEN mixed THEN 'nearest' ELSE 'cluster' END AS how
  FROM told WHERE NOT coalesce(a <> b, false) AND NOT coalesce(low <> high, false)
)
"""


def _identities(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = C("c_custkey")

    def part(n: int) -> F.Column:
        return F.floor(k / n).cast("string")

    claims = t.customer.where(k % 2 == 0).select(k.alias("record"), F.lit("pair").alias("system"), part(3).alias("value"))
    claims = claims.unionByName(t.customer.select(k.alias("record"), F.lit("home").alias("system"), F.concat_ws(":", C("c_nationkey").cast("string"), "c_mktsegment", part(40)).alias("value")))
    claims = claims.unionByName(t.customer.where(k % 5 == 0).select(k.alias("record"), F.lit("next").alias("system"), F.floor((k + 1) / 4).cast("string").alias("value")))
    keys = t.customer.where(k % 4 == 0).select(k.alias("record"), F.concat(F.lit("K"), part(30)).alias("key")).unionByName(t.customer.where(k % 100 == 0).select(k.alias("record"), F.lit("L").alias("key")))
    return I.identity_clusters(claims, keys)


@registry.add(f"{_CLUSTERS} SELECT * FROM entities")
def kg_identity_clusters(t: Tables) -> DataFrame:
    return _identities(t)[0]


@registry.add(f"{_CLUSTERS} SELECT record, cluster, CASE WHEN a <> b THEN 'two keys' ELSE 'two keys as near' END AS reason, CASE WHEN a <> b THEN a ELSE low END AS first_key, CASE WHEN a <> b THEN b ELSE high END AS last_key FROM told WHERE a <> b OR low <> high")
def kg_identity_rejects(t: Tables) -> DataFrame:
    return _identities(t)[1]


@registry.add(f"{_CLUSTERS} SELECT system, value, count(*) AS n, min(canonical_id) AS first_id, max(canonical_id) AS last_id FROM (SELECT DISTINCT * FROM claims) JOIN entities USING (record) GROUP BY system, value HAVING min(canonical_id) <> max(canonical_id)")
def kg_identity_conflicts(t: Tables) -> DataFrame:
    return _identities(t)[2]


# -- splits of whole components --------------------------------------------------


@registry.add("""
WITH RECURSIVE c AS (SELECT o_custkey AS component, count(*) + 1 AS size FROM orders GROUP BY o_custkey),
p AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS i FROM c),
target AS (SELECT CAST(floor(sum(size) * 0.8::DOUBLE) AS BIGINT) AS a, CAST(floor(sum(size) * 0.1::DOUBLE) AS BIGINT) AS b, sum(size)::BIGINT AS n FROM c),
turn AS (
  SELECT 0::BIGINT AS i, a, b, n - a - b AS c, '' AS split FROM target
  UNION ALL
  SELECT t.i + 1, a - CASE WHEN w = 'train' THEN size ELSE 0 END, b - CASE WHEN w = 'val' THEN size ELSE 0 END, c - CASE WHEN w = 'test' THEN size ELSE 0 END, w
  FROM (SELECT turn.*, p.size, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END AS w FROM turn JOIN p ON p.i = turn.i + 1) t
)
SELECT component, size, split FROM turn JOIN p USING (i)""")
def component_split_by_need(t: Tables) -> DataFrame:
    """Customers with their orders: as many components as customers who ordered."""
    pairs = t.orders.select(C("o_custkey").alias("a"), (C("o_orderkey") + 1_000_000_000_000).alias("b"))
    found = connected_components(pairs)
    return G.component_split(found.unionByName(found.select(C("component").alias("node"), "component").distinct()))


_CHAINS = """
WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_custkey % 3 > 0),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM reach r JOIN s ON s.a = r.other),
"""


@registry.add(f"{_CHAINS} c AS (SELECT node, min(other) AS component FROM reach GROUP BY node) SELECT node, component FROM c WHERE node <> component")
def components_of_chains(t: Tables) -> DataFrame:
    return connected_components(t.orders.where("o_custkey % 3 > 0").select(C("o_orderkey").alias("a"), (C("o_orderkey") + 1).alias("b")))


# -- state kept between runs, sinks that write once ----------------------------


def _records(t: Tables) -> DataFrame:
    k = C("o_orderkey")
    key = F.when(k % 3 > 0, F.concat(F.lit("C"), C("o_custkey").cast("string")))
    name = F.when(k % 7 > 0, F.concat(F.lit("name "), F.when(k % 11 == 0, F.floor(C("o_custkey") / 2)).otherwise(C("o_custkey") * 10).cast("string")))
    return t.orders.select(key.alias("key"), name.alias("name"), C("o_orderpriority").alias("source"), (k % 4).alias("rank"), F.when(k % 5 > 0, C("o_orderstatus")).alias("status"), F.when(k % 2 > 0, C("o_totalprice")).alias("price"), (k % 3).alias("load"))


_STATE = """
r AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN 'C' || o_custkey END AS key, CASE WHEN o_orderkey % 7 > 0 THEN 'name ' || CASE WHEN o_orderkey % 11 = 0 THEN CAST(floor(o_custkey / 2) AS BIGINT) ELSE o_custkey * 10 END END AS name,
             o_orderpriority AS source, o_orderkey % 4 AS rank, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 2 > 0 THEN o_totalprice END AS price FROM orders),
i AS (SELECT name, min(key) AS low, max(key) AS high FROM r WHERE key IS NOT NULL AND name IS NOT NULL GROUP BY name),
x AS (SELECT r.*, CASE WHEN r.key IS NOT NULL THEN r.key WHEN low = high THEN low END AS k, low, high FROM r LEFT JOIN i USING (name))
"""


def _state(t: Tables):
    """A stream of three batches through a state in the shared folder, started again after the first two."""
    folder = Scratch(t.spark, "resolver").folder("run")
    records = _records(t)
    state = ResolverState(t.spark, f"{folder}/state", {"status": "string", "price": "double"}, merge_after=2)
    for load in range(3):
        records.where(C("load") == load).drop("load").write.mode("append").parquet(f"{folder}/records")
        if load:
            stream = t.spark.readStream.schema(records.drop("load").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/records")
            run_batches(stream, state.apply, f"{folder}/checkpoint")
    return state


@registry.add(f"WITH {_STATE} SELECT k AS key, arg_min(status, (rank, status)) FILTER (status IS NOT NULL) AS status, arg_min(price, (rank, price)) FILTER (price IS NOT NULL) AS price, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, count(*) AS n FROM x WHERE k IS NOT NULL GROUP BY k")
def resolver_state(t: Tables) -> DataFrame:
    return _state(t).entries()


@registry.add(f"WITH {_STATE} SELECT name, CASE WHEN name IS NULL THEN 'no name' WHEN low IS NULL THEN 'unknown name' ELSE 'several keys' END AS reason, count(*) AS n FROM x WHERE k IS NULL GROUP BY ALL")
def resolver_unresolved(t: Tables) -> DataFrame:
    return _state(t).unresolved()


@registry.add("SELECT s_suppkey, n_nationkey, round(s_acctbal * (n_regionkey + 1), 2) AS score FROM supplier CROSS JOIN nation WHERE s_nationkey <> n_nationkey")
def streamed_pairs(t: Tables) -> DataFrame:
    folder = Scratch(t.spark, "pairs").folder("run")
    left = t.supplier.select("s_suppkey", "s_acctbal")
    left.repartition(3, "s_suppkey").write.parquet(f"{folder}/left")
    tables = Committed(t.spark, f"{folder}/out")
    known = t.supplier.select("s_suppkey", C("s_nationkey").alias("n_nationkey"))
    sink = pairs_sink(tables, t.nation.select("n_nationkey", "n_regionkey"), lambda p: p.select("s_suppkey", "n_nationkey", F.round(C("s_acctbal") * (C("n_regionkey") + 1), 2).alias("score")), known=known, on=["s_suppkey", "n_nationkey"])
    run_batches(t.spark.readStream.schema(left.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/left"), sink, f"{folder}/checkpoint")
    return tables.read("pairs", "s_suppkey bigint, n_nationkey int, score double", format="csv")


# -- match methods ----------------------------------------------------------------


@registry.add("""
WITH e AS (SELECT p_partkey AS k, md5(p_name || p_partkey) AS key, 'part ' || md5('' || p_partkey) AS name, 'C' || p_partkey * 7 AS structure FROM part),
r AS (SELECT p_partkey AS record_id, p_partkey % 9 AS c, p_partkey AS k FROM part)
SELECT record_id, CASE WHEN c < 7 THEN key END AS match,
       ['exact', 'block', 'name', 'abbreviation', 'fuzzy', 'structure', 'xref', NULL, NULL][c + 1] AS method,
       [1.0, 0.9, 0.85, 0.9, 0.7, 0.5, 0.6, 0.0, 0.0][c + 1]::DOUBLE AS confidence, c BETWEEN 3 AND 6 AS needs_review
FROM r JOIN e USING (k)""")
def match_methods(t: Tables) -> DataFrame:
    """A record for each part, by its number to be found by each of the methods, by an abbreviation of two parts, or by none."""
    p, k = t.part, C("p_partkey")
    c, text = k % 9, k.cast("string")
    key = F.md5(F.concat("p_name", text).cast("binary"))
    name = F.concat(F.lit("part "), F.md5(text.cast("binary")))
    entities = p.select(key.alias("key"), name.alias("name"), F.concat(F.lit("C"), (k * 7).cast("string")).alias("structure"))
    r_key = F.when(c == 0, key).when(c == 1, F.concat(F.substring(key, 1, 14), F.lit("zzz")))
    r_name = F.when(c == 2, name).when(c == 3, F.concat(F.lit("ab"), text)).when(c == 4, F.concat(name, F.lit("x"))).when(c == 6, F.concat(F.lit("known elsewhere "), text)).when(c == 7, F.concat(F.lit("ab"), text)).otherwise(F.concat(F.lit("#"), text))
    records = p.select(k.alias("id"), r_key.alias("key"), r_name.alias("name"), F.when(c == 5, F.concat(F.lit(" C"), (k * 7).cast("string"))).alias("structure"))
    short = p.where(c.isin(3, 7)).select(F.concat(F.lit("AB"), text).alias("abbreviation"), F.when(c == 3, F.lit("an older reading")).otherwise(name).alias("name"))
    more = p.where(c.isin(3, 7)).select(F.concat(F.lit("ab"), text).alias("abbreviation"), name.alias("name")).unionByName(p.where(c == 7).select(F.concat(F.lit("ab"), text).alias("abbreviation"), F.lit("another").alias("name")))
    xrefs = p.where(c == 6).select(F.concat(F.lit("known elsewhere "), text).alias("name"), key.alias("key"))
    return M.match_records(records, entities, record_id="id", key="key", name="name", structure="structure", expansions=M.expansions_with(short, more), xrefs=xrefs)


# -- paths ---------------------------------------------------------------------------


def _links(t: Tables) -> DataFrame:
    k = C("o_orderkey")
    return t.orders.where("o_custkey % 3 > 0").select(k.alias("a"), (k + 1).alias("b")).unionByName(t.orders.where("o_custkey % 5 = 0").select(k.alias("a"), (k + 3).alias("b"))).unionByName(t.orders.where("o_custkey % 7 = 0").select(k.alias("a"), (k + 4).alias("b")))


_LINKS = "e AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_custkey % 3 > 0 UNION SELECT o_orderkey, o_orderkey + 3 FROM orders WHERE o_custkey % 5 = 0 UNION SELECT o_orderkey, o_orderkey + 4 FROM orders WHERE o_custkey % 7 = 0)"


@registry.add(f"""
WITH RECURSIVE {_LINKS}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT o_orderkey AS source, o_orderkey + o_orderkey % 8 AS target FROM orders WHERE o_orderkey % 3 = 0),
p AS (SELECT source, target, [source] AS path FROM w UNION ALL SELECT source, target, list_append(path, s.b) FROM p JOIN s ON s.a = path[-1] WHERE len(path) <= 4 AND path[-1] <> target AND NOT list_contains(path, s.b)),
f AS (SELECT source, target, path, row_number() OVER (PARTITION BY source, target ORDER BY len(path), path) AS r FROM p WHERE path[-1] = target)
SELECT source, target, len(path)::INT - 1 AS length, array_to_string(path, '>') AS path FROM f WHERE r = 1""")
def shortest_path_nodes(t: Tables) -> DataFrame:
    k = C("o_orderkey")
    pairs = t.orders.where(k % 3 == 0).select(k.alias("source"), (k + k % 8).alias("target"))
    return P.shortest_paths(_links(t), pairs, max_depth=4).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@registry.add(f"""
WITH RECURSIVE {_LINKS}, st AS (SELECT o_orderkey AS n FROM orders WHERE o_custkey % 4 = 0),
o AS (SELECT n AS start, n AS node, 0 AS d FROM st UNION SELECT start, b, d + 1 FROM o JOIN e ON a = node WHERE d < 3),
i AS (SELECT n AS start, n AS node, 0 AS d FROM st UNION SELECT start, a, d + 1 FROM i JOIN e ON b = node WHERE d < 3),
x AS (SELECT start, node, min(d) AS d FROM o GROUP BY ALL), y AS (SELECT start, node, min(d) AS d FROM i GROUP BY ALL)
SELECT start, node, least(x.d, y.d) AS depth, x.d AS outward, y.d AS inward FROM x FULL JOIN y USING (start, node)""")
def node_neighbourhoods(t: Tables) -> DataFrame:
    return P.neighbourhoods(_links(t), t.orders.where("o_custkey % 4 = 0").select(C("o_orderkey").alias("node")), max_depth=3)


# -- scores ----------------------------------------------------------------------------

_VECTORS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(C("vec_id").alias("id"), C("embedding").alias("vector"))


@registry.add(f"""
WITH {_VECTORS}, p AS (SELECT q.id AS query_id, c.id, list_inner_product(q.e, c.e) AS s FROM v q JOIN v c ON q.id <> c.id)
SELECT query_id, rank::INT AS rank, id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p) WHERE rank <= 5""")
def vector_top_products(t: Tables) -> DataFrame:
    return V.top_products(_vectors(t), _vectors(t), k=5).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@registry.add(f"""
WITH {_VECTORS}, p AS (SELECT q.id AS query_id, c.id, list_inner_product(q.e, c.e) / sqrt(len(q.e)) AS s FROM v q JOIN v c ON q.id <> c.id)
SELECT query_id, rank::INT AS rank, id, round(w, 7) AS weight FROM (SELECT query_id, id, exp(s) / sum(exp(s)) OVER (PARTITION BY query_id) AS w, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p) WHERE rank <= 3""")
def vector_attention(t: Tables) -> DataFrame:
    return V.top_products(_vectors(t), _vectors(t), k=3, attention=True).select("query_id", "rank", "id", F.round("weight", 7).alias("weight"))


def _temperature_sql(rounds: int) -> str:
    out = "WITH d AS (SELECT l_returnflag AS k, (l_quantity - 25) / 3 AS z, CASE WHEN hash_part < l_quantity THEN 1 ELSE 0 END AS y FROM (SELECT *, l_orderkey * 7 % 50 AS hash_part FROM lineitem)), t0 AS (SELECT k, 1.0::DOUBLE AS s FROM d GROUP BY k)"
    for i in range(rounds):
        out += f", t{i + 1} AS (SELECT k, least(greatest(least(greatest(s - sum(z * (p - y)) / (sum(z * z * p * (1 - p)) + 1e-12), s / 2), s * 2), 0.05::DOUBLE), 20.0::DOUBLE) AS s FROM (SELECT d.k, s, z, y, 1 / (1 + exp(-z * s)) AS p FROM d JOIN t{i} t ON t.k = d.k) GROUP BY k, s)"
    loss = "avg(greatest(z * {0}, 0) - z * {0} * y + ln(1 + exp(-abs(z * {0}))))"
    return out + f" SELECT d.k AS l_returnflag, round(1 / s, 6) AS temperature, round({loss.format('1.0')}, 6) AS loss_before, round({loss.format('s')}, 6) AS loss_after, count(*) AS n FROM d JOIN t{rounds} t ON t.k = d.k GROUP BY d.k, s"


@registry.add(_temperature_sql(12))
def temperature_fit(t: Tables) -> DataFrame:
    own = t.lineitem.select("l_returnflag", ((C("l_quantity") - 25) / 3).alias("z"), (C("l_orderkey") * 7 % 50 < C("l_quantity")).cast("int").alias("y"))
    return V.fitted_temperature(own, "z", "y", by="l_returnflag").select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("temperature", "loss_before", "loss_after")], "n")


# -- stores: SQL tables, nested records, replaced partitions ------------------------------


@registry.add("SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey >= 20 AND o_orderstatus IN ('F', 'O')")
def sql_table_scan(t: Tables) -> DataFrame:
    folder = Scratch(t.spark, "sql").folder("files")
    # Writing is an action; the counts that it gives back are a row for each file.
    write_sqlite(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), folder, "orders").collect()
    found = read_sqlite(t.spark, folder, "orders", rows=500)
    return found.where((C("o_custkey") >= 20) & C("o_orderstatus").isin("F", "O")).select("o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice")


_SCHEMA = "id bigint, status string, lines array<struct<part: bigint, price: double, marks: array<struct<kind: string, value: double>>>>, others array<struct<id: bigint, why: string>>"


def _nested(t: Tables):
    """Orders as JSON texts: lines with marks, and other orders that they go with; every hundredth is broken."""
    marks = F.array(F.struct(F.lit("discount").alias("kind"), C("l_discount").alias("value")), F.when(C("l_tax") > 0.04, F.struct(F.lit("tax").alias("kind"), C("l_tax").alias("value"))))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(C("l_linenumber").alias("n"), C("l_partkey").alias("part"), C("l_extendedprice").alias("price"), marks.alias("marks")))).alias("x"))
    k = C("o_orderkey")
    others = F.transform(F.array(k, k + 1, k - 1, k * 1000 + 7), lambda x: F.struct(x.alias("id"), F.concat(F.lit("with "), F.least(k, x).cast("string")).alias("why")))
    own = t.orders.join(lines, k == C("l_orderkey"), "left")
    text = F.to_json(F.struct(k.alias("id"), C("o_orderstatus").alias("status"), F.transform("x", lambda r: F.struct(r["part"].alias("part"), r["price"].alias("price"), r["marks"].alias("marks"))).alias("lines"), others.alias("others")))
    records, broken = parsed_once(own.select(F.when(k % 100 == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("text")), "text", _SCHEMA, id="id")
    tables = child_tables(records, {"line": Level("lines", {"part": "item.part", "price": "item.price"}, {"mark": Level("marks", {"kind": "item.kind", "value": "item.value"})}), "other": Level("others", {"other": "item.id", "why": "item.why"})})
    return records, broken, tables


_LINES = "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS line_at FROM lineitem WHERE l_orderkey % 100 > 0 AND l_orderkey IN (SELECT o_orderkey FROM orders))"


@registry.add(f"WITH {_LINES} SELECT l_orderkey AS id, line_at::INT AS line_at, l_partkey AS part, l_extendedprice AS price FROM l")
def nested_lines(t: Tables) -> DataFrame:
    return _nested(t)[2]["line"]


@registry.add(f"WITH {_LINES} SELECT l_orderkey AS id, line_at::INT AS line_at, 0 AS mark_at, 'discount' AS kind, l_discount AS value FROM l UNION ALL SELECT l_orderkey, line_at::INT, 1, 'tax', l_tax FROM l WHERE l_tax > 0.04")
def nested_marks(t: Tables) -> DataFrame:
    return _nested(t)[2]["mark"]


@registry.add("""
WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 100 > 0)
SELECT DISTINCT x.k AS a, y.k AS b, 'with ' || x.k AS text FROM o x JOIN o y ON y.k = x.k + 1 OR y.k = x.k * 1000 + 7""")
def nested_interactions(t: Tables) -> DataFrame:
    records, _, tables = _nested(t)
    return interactions(tables["other"], records, id="id", other="other", text="why")[0]


@registry.add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 1000")
def replaced_partitions(t: Tables) -> DataFrame:
    path = Scratch(t.spark, "replaced").folder("table")
    own = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    own.write.partitionBy("o_orderstatus").parquet(path)
    schema = own.schema
    staged = t.spark.read.schema(schema).parquet(path).where("o_orderstatus = 'F' and o_totalprice > 1000").withColumn("o_totalprice", F.round(C("o_totalprice") * 2, 2))
    replace_partitions(staged, path, ["o_orderstatus"], {"price": C("o_totalprice") > 0})
    return t.spark.read.schema(schema).parquet(path)


# -- aliases, organisms, tissues, packed columns, cleaning in parts -----------------------


@registry.add("""
WITH x AS (SELECT '9606.P' || l_suppkey AS id, CASE WHEN l_linenumber = 5 THEN 'BLAST_UniProt_AC' ELSE 'UniProt_AC' END AS source,
                  CASE l_linenumber WHEN 1 THEN 'A0A' || lpad('' || l_partkey % 1000, 3, '0') || 'AB12' WHEN 2 THEN 'Q' || lpad('' || l_partkey % 10, 1, '0') || 'AB' || 'C' || l_partkey % 10 WHEN 3 THEN 'P12345-2' WHEN 4 THEN 'GENE' || l_partkey ELSE 'P00000' END AS a FROM lineitem),
v AS (SELECT upper(id) AS id, a, CASE WHEN regexp_matches(a, '^[OPQ][0-9]') AND length(a) = 6 THEN 0 WHEN regexp_matches(a, '^[OPQ][0-9]') AND length(a) = 10 THEN 1 ELSE 2 END AS kind
      FROM x WHERE source = 'UniProt_AC' AND NOT regexp_matches(a, '-\\d+$') AND regexp_matches(a, '^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$'))
SELECT id, arg_min(a, (kind, length(a), a)) AS accession FROM v GROUP BY id""")
def alias_accessions(t: Tables) -> DataFrame:
    n, p = C("l_linenumber"), C("l_partkey")
    digit = (p % 10).cast("string")
    alias = F.when(n == 1, F.concat(F.lit(" a0a"), F.lpad((p % 1000).cast("string"), 3, "0"), F.lit("ab12"))).when(n == 2, F.concat(F.lit("Q"), digit, F.lit("ABC"), digit)).when(n == 3, "P12345-2").when(n == 4, F.concat(F.lit("GENE"), p.cast("string"))).otherwise("P00000")
    rows = t.lineitem.select(F.concat(F.lit("9606.p"), C("l_suppkey").cast("string")).alias("string_protein_id"), alias.alias("alias"), F.when(n == 5, "BLAST_UniProt_AC").otherwise(" UniProt_AC ").alias("source"))
    return alias_mapping(rows)[0]


@registry.add("SELECT kept, count(*) AS n FROM (SELECT l_partkey % 3 > 0 AND l_suppkey % 4 > 0 AS kept FROM lineitem) GROUP BY kept")
def organism_pairs(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.when(C("l_partkey") % 3 > 0, F.concat(F.lit("9606.P"), C("l_partkey").cast("string"))).otherwise("10090.P").alias("a"), F.when(C("l_suppkey") % 4 > 0, F.concat(F.lit("9606.S"), C("l_suppkey").cast("string"))).alias("b"))
    kept, rest = of_organism(pairs, "a", "b", "9606")
    return kept.groupBy(F.lit(True).alias("kept")).agg(F.count("*").alias("n")).unionByName(rest.groupBy(F.lit(False).alias("kept")).agg(F.count("*").alias("n")))


@registry.add("""
SELECT p_partkey, lower(p_type) || '_tissue' AS tissue, CASE WHEN lower(p_type) = 'small' THEN 'ID:1' WHEN lower(p_type) = 'large' THEN 'ID:2' END AS known FROM part""")
def tissue_keys(t: Tables) -> DataFrame:
    raw = F.concat(F.when(C("p_partkey") % 2 == 0, " Primary ").otherwise("normal  "), C("p_type"), F.lit(" (cell line 7)  tissue "))
    return t.part.select("p_partkey", S.tissue(raw).alias("tissue"), S.tissue(raw, {"small_tissue": "ID:1", "large_tissue": "ID:2"}).alias("known"))


@registry.add("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS p, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS c, o_orderkey % 12 = 0 AS empty FROM orders")
def packed_columns(t: Tables) -> DataFrame:
    """Columns packed to JSON text, and taken out of it again."""
    k = C("o_orderkey")
    own = t.orders.select(k, F.when(k % 3 > 0, C("o_orderpriority")).alias("p"), F.when(k % 4 > 0, C("o_custkey")).alias("c"))
    text = own.select("o_orderkey", S.packed(["p", "c"]).alias("text"))
    return text.select("o_orderkey", S.unpacked(C("text"), "p string, c bigint").alias("x"), C("text").isNull().alias("empty")).select("o_orderkey", "x.p", "x.c", "empty")


@registry.add("SELECT c_custkey, upper(c_name) AS c_name, coalesce(c_acctbal, 0) AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'")
def cleaned_in_parts(t: Tables) -> DataFrame:
    """Cleaning steps over parts of a table, each written once it is done; run again, what is written is passed over."""
    steps = Cleaning()
    steps.register("drop")(lambda df: df.where("c_mktsegment <> 'BUILDING'"))
    steps.register("names")(lambda df: df.withColumn("c_name", F.upper("c_name")))
    steps.register("fill")(lambda df: df.fillna(0.0, ["c_acctbal"]))
    tables = Committed(t.spark, Scratch(t.spark, "cleaned").folder("parts"))
    for _ in range(2):
        out = steps.run_in_parts(t.customer, tables, by=["c_custkey"], parts=3)
    return out.select("c_custkey", "c_name", "c_acctbal")
