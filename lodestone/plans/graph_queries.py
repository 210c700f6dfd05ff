"""Graph, source and streaming queries on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import scalars as S
from lodestone.operators import graph as G
from lodestone.operators.components import connected_components
from lodestone.plans.base import Registry, Tables
from lodestone.sources import readers, sinks
from lodestone.streaming import incremental

registry = Registry()
C = F.col

_EDGES = """
e AS (
  SELECT 'Customer' AS src_label, o_custkey AS src_id, 'placed' AS rel, 'Order' AS dst_label, o_orderkey AS dst_id, 0.9::DOUBLE AS confidence FROM orders
  UNION ALL SELECT DISTINCT 'Order', l_orderkey, 'contains', 'Part', l_partkey, 0.8::DOUBLE FROM lineitem
  UNION ALL SELECT DISTINCT 'Part', l_partkey, 'from', 'Supplier', l_suppkey, 0.7::DOUBLE FROM lineitem
)"""
_NODES = """
n AS (
  SELECT 'Customer' AS label, c_custkey AS id FROM customer UNION ALL SELECT 'Order', o_orderkey FROM orders
  UNION ALL SELECT 'Part', p_partkey FROM part UNION ALL SELECT 'Supplier', s_suppkey FROM supplier
)"""


def edges(t: Tables) -> DataFrame:
    def own(df: DataFrame, a: str, s: str, rel: str, b: str, d: str, conf: float) -> DataFrame:
        return df.select(F.lit(a).alias("src_label"), C(s).alias("src_id"), F.lit(rel).alias("rel"), F.lit(b).alias("dst_label"), C(d).alias("dst_id"), F.lit(conf).alias("confidence"))

    line = t.lineitem
    parts = [
        own(t.orders, "Customer", "o_custkey", "placed", "Order", "o_orderkey", 0.9),
        own(line.select("l_orderkey", "l_partkey").distinct(), "Order", "l_orderkey", "contains", "Part", "l_partkey", 0.8),
        own(line.select("l_partkey", "l_suppkey").distinct(), "Part", "l_partkey", "from", "Supplier", "l_suppkey", 0.7),
    ]
    return reduce(DataFrame.unionByName, parts)


def nodes(t: Tables) -> DataFrame:
    keys = (("Customer", t.customer, "c_custkey"), ("Order", t.orders, "o_orderkey"), ("Part", t.part, "p_partkey"), ("Supplier", t.supplier, "s_suppkey"))
    return reduce(DataFrame.unionByName, [df.select(F.lit(label).alias("label"), C(k).alias("id")) for label, df, k in keys])


@registry.add(f"WITH {_EDGES} SELECT label, count(*) AS n FROM (SELECT src_label AS label, src_id FROM e UNION SELECT dst_label, dst_id FROM e) GROUP BY label")
def graph_entity_counts(t: Tables) -> DataFrame:
    return G.entity_counts(edges(t))


@registry.add(f"WITH {_EDGES} SELECT rel, count(*) AS n, count(DISTINCT src_id) AS sources, count(DISTINCT dst_id) AS targets FROM e GROUP BY rel")
def graph_relation_summary(t: Tables) -> DataFrame:
    return G.relation_summary(edges(t))


@registry.add(f"""
WITH {_EDGES}, {_NODES}, d AS (SELECT n.label, n.id, count(e.rel) AS k FROM n LEFT JOIN e ON e.src_label = n.label AND e.src_id = n.id GROUP BY ALL),
x AS (SELECT src_label AS label, src_id AS id FROM e UNION SELECT dst_label, dst_id FROM e)
SELECT count(*) AS nodes, CAST(sum(k) AS BIGINT) AS edges, round(avg(k), 9) AS avg_degree, max(k) AS max_degree, min(k) AS min_degree, count(*) FILTER (x.id IS NULL) AS isolated, round(sum(k) / (count(*) * (count(*) - 1.0)), 12) AS density
FROM d LEFT JOIN x USING (label, id)""")
def graph_statistics(t: Tables) -> DataFrame:
    return G.statistics(nodes(t), edges(t)).withColumns({"avg_degree": F.round("avg_degree", 9), "density": F.round("density", 12)})


@registry.add(f"WITH {_EDGES} SELECT src_label, rel, dst_label, count(*) AS n FROM e WHERE rel <> 'placed' GROUP BY ALL")
def graph_wrong_directions(t: Tables) -> DataFrame:
    return G.wrong_directions(edges(t), [("Customer", "placed", "Order"), ("Part", "contains", "Order")])


@registry.add(f"WITH {_EDGES} SELECT dst_label AS start_label, count(*) AS n, round(sum(confidence), 4) AS c FROM e GROUP BY 1")
def graph_reverse_edges(t: Tables) -> DataFrame:
    both = G.with_reverse(edges(t)).where(C("rel").startswith("rev_"))
    return both.groupBy(C("src_label").alias("start_label")).agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("c"))


@registry.add(f"""
WITH {_EDGES}, h1 AS (SELECT src_id AS s, dst_id AS a FROM e WHERE rel = 'placed'), h2 AS (SELECT h1.s, e.dst_id AS a, count(*) AS p FROM h1 JOIN e ON e.rel = 'contains' AND e.src_id = h1.a GROUP BY ALL),
h3 AS (SELECT h2.s, e.dst_id AS a, CAST(sum(p) AS BIGINT) AS p FROM h2 JOIN e ON e.rel = 'from' AND e.src_id = h2.a GROUP BY ALL)
SELECT s AS start, a AS "end", 3 AS hops, round(0.9 * 0.8 * 0.7, 9) AS score, p AS paths FROM h3""")
def graph_three_hops(t: Tables) -> DataFrame:
    return G.hop_scores(edges(t), "Customer", "Supplier", max_hops=3, middle=["Order", "Part"]).withColumn("score", F.round("score", 9))


@registry.add("""
WITH e AS (SELECT l_partkey AS p, l_suppkey AS s, max(l_quantity) / 50 AS c FROM lineitem GROUP BY ALL),
w AS (SELECT '1>s' || x.s || '>2' AS path, 2 AS hops, pow(x.c * y.c, 0.5) AS score FROM e x JOIN e y ON y.s = x.s AND y.p = 2 WHERE x.p = 1
      UNION ALL SELECT '1>s' || x.s || '>' || m.p || '>s' || z.s || '>2', 4, pow(x.c * m.c * z.c * y.c, 0.25) FROM e x JOIN e m ON m.s = x.s AND m.p NOT IN (1, 2) JOIN e z ON z.p = m.p AND z.s <> m.s JOIN e y ON y.s = z.s AND y.p = 2 WHERE x.p = 1)
SELECT path, hops, round(score, 9) AS score FROM w WHERE score >= 0.001""")
def graph_bounded_paths(t: Tables) -> DataFrame:
    e = t.lineitem.select(C("l_partkey").cast("string").alias("a"), F.concat(F.lit("s"), C("l_suppkey").cast("string")).alias("b"), "l_quantity").groupBy("a", "b").agg((F.max("l_quantity") / 50).alias("confidence"))
    e = e.withColumn("id", F.concat("a", F.lit("-"), F.substring("b", 2, 20)))
    return G.bounded_paths(e, C("node") == "1", C("node") == "2", max_depth=4, top=None).withColumn("score", F.round("score", 9))


def _sales(t: Tables) -> DataFrame:
    return t.lineitem.select(C("l_partkey").alias("a"), (C("l_suppkey") + 10000000).alias("b"))


@registry.add("""
WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 10000000 AS b FROM lineitem), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
d1 AS (SELECT DISTINCT b AS node FROM s WHERE a = 1), d2 AS (SELECT DISTINCT s.b AS node FROM d1 JOIN s ON s.a = d1.node WHERE s.b <> 1 AND s.b NOT IN (SELECT node FROM d1))
SELECT 1 AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2""")
def graph_bfs(t: Tables) -> DataFrame:
    return G.bfs(_sales(t), t.spark.createDataFrame([(1,)], "node long"), max_depth=2)


@registry.add("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 10000000 AS b FROM lineitem), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT 1 AS node, 0 AS depth UNION SELECT s.b, depth + 1 FROM r JOIN s ON s.a = r.node WHERE depth < 4)
SELECT node, min(depth) AS depth FROM r WHERE node > 1 AND node IN (SELECT p_partkey FROM part) GROUP BY node""")
def graph_shortest_lengths(t: Tables) -> DataFrame:
    goals = t.part.where("p_partkey > 1").select(C("p_partkey").alias("node"))
    return G.shortest_lengths(_sales(t), t.spark.createDataFrame([(1,)], "node long"), goals, max_depth=4)


@registry.add(f"WITH {_EDGES} SELECT * FROM (SELECT 'in' AS direction, rel, src_label AS label, src_id AS id, confidence FROM e WHERE dst_label = 'Part' AND dst_id = 7 UNION ALL SELECT 'out', rel, dst_label, dst_id, confidence FROM e WHERE src_label = 'Part' AND src_id = 7) ORDER BY confidence DESC, direction, rel, label, id LIMIT 20")
def graph_neighbours(t: Tables) -> DataFrame:
    return G.neighbours(edges(t), "Part", 7, most=20)


#: Labels that fall to the least one in reach, round by round; a round's rows are the nodes whose label fell.
_COMPONENTS = """
WITH RECURSIVE d AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 10000000 AS b FROM lineitem), s AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
found(node, component) USING KEY (node) AS (
  SELECT a, a FROM s GROUP BY a
  UNION
  SELECT s.b, min(f.component) FROM found f JOIN s ON s.a = f.node JOIN recurring.found r ON r.node = s.b WHERE f.component < r.component GROUP BY s.b
)"""


@registry.add(f"{_COMPONENTS} SELECT node, component FROM found WHERE node <> component")
def graph_components(t: Tables) -> DataFrame:
    return connected_components(_sales(t).distinct())


@registry.add(f"""{_COMPONENTS},
p AS (SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS i FROM found GROUP BY component),
target AS (SELECT CAST(floor(sum(size) * 0.8::DOUBLE) AS BIGINT) AS a, CAST(floor(sum(size) * 0.1::DOUBLE) AS BIGINT) AS b, sum(size)::BIGINT AS n FROM p),
turn AS (
  SELECT 0::BIGINT AS i, a, b, n - a - b AS c, '' AS split FROM target
  UNION ALL
  SELECT t.i + 1, a - CASE WHEN w = 'train' THEN size ELSE 0 END, b - CASE WHEN w = 'val' THEN size ELSE 0 END, c - CASE WHEN w = 'test' THEN size ELSE 0 END, w
  FROM (SELECT turn.*, p.size, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END AS w FROM turn JOIN p ON p.i = turn.i + 1) t
)
SELECT component, size, split FROM turn JOIN p USING (i)""")
def graph_component_split(t: Tables) -> DataFrame:
    found = connected_components(_sales(t).distinct())
    return G.component_split(found.unionByName(found.select(C("component").alias("node"), "component").distinct()))


@registry.add(f"WITH {_EDGES} SELECT * EXCLUDE (d) FROM (SELECT e.*, CASE WHEN CAST('0x' || substr(md5('0:' || src_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split, CASE WHEN CAST('0x' || substr(md5('0:' || dst_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS d FROM e) WHERE split = d")
def graph_node_disjoint(t: Tables) -> DataFrame:
    return G.node_disjoint_edges(edges(t), S.hash_split(C("src_id")), S.hash_split(C("dst_id")))


@registry.add("SELECT DISTINCT 'Customer' AS src_label, c_custkey AS src_id, 'same_nation' AS rel, 'Supplier' AS dst_label, s_suppkey AS dst_id FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def graph_derived_edges(t: Tables) -> DataFrame:
    left = t.customer.select(C("c_custkey").alias("src_id"), C("c_nationkey").alias("via"))
    return G.derived_edges(left, t.supplier.select(C("s_suppkey").alias("dst_id"), C("s_nationkey").alias("via")), "via", "same_nation", ("Customer", "Supplier"))


@registry.add(f"WITH {_EDGES} SELECT src_label, rel, dst_label, count(*) AS pairs, CAST(sum(CAST('0x' || substr(md5(src_id || '-' || dst_id), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM (SELECT DISTINCT src_label, rel, dst_label, src_id, dst_id FROM e) GROUP BY ALL")
def graph_edge_lists(t: Tables) -> DataFrame:
    return G.edge_lists(edges(t))


@registry.add("SELECT 'Customer' AS label, coalesce(a.c_custkey, b.o_custkey) AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, p) AS name FROM customer a FULL JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) b ON a.c_custkey = b.o_custkey")
def graph_merged_nodes(t: Tables) -> DataFrame:
    one = t.customer.select(F.lit("Customer").alias("label"), C("c_custkey").alias("id"), F.when(C("c_custkey") % 2 == 0, C("c_name")).alias("name"))
    two = t.orders.groupBy(C("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("name")).select(F.lit("Customer").alias("label"), "id", "name")
    return G.merged_nodes([one, two], ["name"])


@registry.add("SELECT 'Customer' AS src_label, o_custkey AS src_id, 'bought' AS rel, 'Part' AS dst_label, l_partkey AS dst_id, max(l_discount) AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey WHERE p_size < 25 GROUP BY ALL")
def graph_merged_edges(t: Tables) -> DataFrame:
    e = t.orders.join(t.lineitem, C("l_orderkey") == C("o_orderkey")).select(F.lit("Customer").alias("src_label"), C("o_custkey").alias("src_id"), F.lit("bought").alias("rel"), F.lit("Part").alias("dst_label"), C("l_partkey").alias("dst_id"), C("l_discount").alias("confidence"))
    n = t.customer.select(F.lit("Customer").alias("label"), C("c_custkey").alias("id")).unionByName(t.part.where("p_size < 25").select(F.lit("Part").alias("label"), C("p_partkey").alias("id")))
    return G.merged_edges(e, n)


@registry.add()
def graph_negatives(t: Tables) -> DataFrame:
    known = t.orders.join(t.lineitem, C("l_orderkey") == C("o_orderkey")).select(C("o_custkey").alias("c"), C("l_partkey").alias("p"))
    return G.weighted_negatives(t.customer.select(C("c_custkey").alias("c")), t.part.select(C("p_partkey").alias("p")), known, "c", "p", 5)


# -- sources and sinks -------------------------------------------------------


@registry.add("SELECT 'Gene' AS head_type, CAST(s_suppkey AS VARCHAR) AS head_id, 'SRC' AS relation_source, 'binds' AS relation_name, 'Compound' AS tail_type, s_name AS tail_id FROM supplier")
def triple_parsing(t: Tables) -> DataFrame:
    raw = t.supplier.select(F.concat(F.lit("Gene::"), C("s_suppkey").cast("string")).alias("head"), F.lit("SRC::binds::Gene:Compound").alias("relation"), F.concat(F.lit("Compound::"), "s_name").alias("tail"))
    return readers.triples(raw)


@registry.add("SELECT n_nationkey, n_name AS name, CAST(100000 + n_nationkey AS VARCHAR) AS mim, n_nationkey % 4 AS mapping_key FROM nation")
def phenotype_parsing(t: Tables) -> DataFrame:
    raw = t.nation.select("n_nationkey", F.concat("n_name", F.lit(", "), (C("n_nationkey") + 100000).cast("string"), F.lit(" ("), (C("n_nationkey") % 4).cast("string"), F.lit(")")).alias("raw"))
    return readers.phenotypes(raw, "raw").drop("raw")


@registry.add("SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title_chars FROM pages")
def html_fields(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).cast("long").alias("title_chars"))


@registry.add("SELECT 'MERGE (n:Nation {id: ''' || n_nationkey || '''}) SET n.n_name = ''' || n_name || '''' AS statement FROM nation")
def cypher_export(t: Tables) -> DataFrame:
    return sinks.cypher_statements(t.nation.select(F.lit("Nation").alias("label"), C("n_nationkey").alias("id"), "n_name"), ["n_name"])


@registry.add("SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256(CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment}) AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM customer")
def table_digest(t: Tables) -> DataFrame:
    return sinks.digest(t.customer)


# -- streams -----------------------------------------------------------------


@registry.add("SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(t: Tables) -> DataFrame:
    out = incremental.windowed(t.events, "ts", ["event_type"], "value", width="1 day")
    return out.select("event_type", F.unix_timestamp("start").alias("start"), "n", F.round("total", 4).alias("total"))


@registry.add("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id, n""")
def event_sessions(t: Tables) -> DataFrame:
    return incremental.sessions(t.events, "ts", "user_id", gap="6 hours").groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@registry.add("SELECT l_partkey, max(l_discount) AS l_discount, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY l_partkey")
def incremental_merge(t: Tables) -> DataFrame:
    own = t.lineitem.select("l_partkey", "l_discount", "l_linenumber")
    return incremental.merged_stream(own, ["l_partkey"], "l_discount", "l_linenumber")
