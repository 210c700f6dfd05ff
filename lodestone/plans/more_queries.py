"""Set operations, sampling, splits and the rest on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.operators import graph as G, joins as J, rank as R, resolve as E, sampling as N
from lodestone.operators.ordered import quantiles
from lodestone.plans.base import Registry, Tables

registry = Registry()
C = F.col


def _share(*keys: str) -> str:
    return "CAST('0x' || substr(md5('0:' || " + " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "), 1, 8) AS BIGINT) / 4294967296.0"


@registry.add("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_all_rows(t: Tables) -> DataFrame:
    return t.nation.select(C("n_nationkey").alias("k"), C("n_name").alias("name")).unionByName(t.region.select(C("r_regionkey").alias("k"), C("r_name").alias("name")))


@registry.add("SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
def union_distinct(t: Tables) -> DataFrame:
    return t.orders.select(C("o_custkey").alias("id")).unionByName(t.events.select(C("user_id").alias("id"))).distinct()


@registry.add("SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def set_difference(t: Tables) -> DataFrame:
    return t.customer.select(C("c_custkey").alias("id")).exceptAll(t.events.select(C("user_id").alias("id")).distinct())


@registry.add("SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def set_intersection(t: Tables) -> DataFrame:
    return t.orders.select(C("o_custkey").alias("id")).intersect(t.events.select(C("user_id").alias("id")))


@registry.add("SELECT s_suppkey, p_partkey FROM (SELECT s_suppkey, [s_nationkey, s_nationkey % 5 + 30] AS cl FROM supplier) JOIN (SELECT p_partkey, [p_size % 25, p_size % 5 + 30] AS cp FROM part) ON len(list_intersect(cl, cp)) = 0")
def wrong_class_pairs(t: Tables) -> DataFrame:
    left = t.supplier.select("s_suppkey", F.array("s_nationkey", C("s_nationkey") % 5 + 30).alias("cl"))
    right = t.part.select("p_partkey", F.array(C("p_size") % 25, C("p_size") % 5 + 30).alias("cl"))
    return N.disjoint_class_pairs(left, right, "s_suppkey", "p_partkey", "cl")


@registry.add("SELECT l_suppkey, l_partkey, max(CASE WHEN l_linenumber >= 3 THEN 0.95::DOUBLE WHEN l_linenumber = 2 THEN 0.8::DOUBLE WHEN l_linenumber = 1 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END) AS confidence FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def graded_negatives(t: Tables) -> DataFrame:
    return N.graded_negatives(t.lineitem.where("l_returnflag = 'R'"), "l_suppkey", "l_partkey", C("l_linenumber"))


@registry.add(f"""
WITH a AS (SELECT *, 'a' AS strategy FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') ORDER BY {_share('l_suppkey', 'l_partkey')}, l_suppkey, l_partkey LIMIT 120),
b AS (SELECT *, 'b' AS strategy FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY {_share('l_suppkey', 'l_partkey')}, l_suppkey, l_partkey LIMIT 80)
SELECT l_suppkey, l_partkey, min(strategy) AS strategy FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def blended_negatives(t: Tables) -> DataFrame:
    part = {f: t.lineitem.where(C("l_returnflag") == f) for f in "AR"}
    return N.blended({"a": (part["A"], 0.6), "b": (part["R"], 0.4)}, "l_suppkey", "l_partkey", 200)


@registry.add(f"SELECT split, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM (SELECT o_custkey, CASE WHEN {_share('o_custkey')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders) GROUP BY split")
def key_aware_split(t: Tables) -> DataFrame:
    return N.key_aware_split(t.orders, "o_custkey").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("keys"))


@registry.add(f"""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings ORDER BY {_share('vec_id')}, vec_id LIMIT 100),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM s)
SELECT 100::BIGINT AS n, round(avg(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / a.l / b.l), 9) AS mean_cosine FROM u a JOIN u b ON a.vec_id < b.vec_id""")
def mean_pairwise_cosine(t: Tables) -> DataFrame:
    return N.pairwise_cosine(t.embeddings, "vec_id", "embedding").withColumn("mean_cosine", F.round("mean_cosine", 9))


@registry.add("SELECT w.want, count(*) AS n, min(p_partkey) AS first FROM (SELECT DISTINCT upper(substr(p_name, 1, 5)) AS want FROM part) w JOIN part ON starts_with(lower(p_name), lower(w.want)) GROUP BY w.want")
def prefix_validation(t: Tables) -> DataFrame:
    wanted = t.part.select(F.upper(F.substring("p_name", 1, 5)).alias("want")).distinct()
    return N.prefix_matches(wanted, t.part, "want", "p_name").groupBy("want").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@registry.add("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END NULLS LAST, c_custkey) AS place FROM customer")
def missing_ranks_last(t: Tables) -> DataFrame:
    own = t.customer.select("c_custkey", F.when(C("c_custkey") % 3 == 0, C("c_nationkey")).alias("r"))
    return N.ranked_last_missing(own, "r", "c_custkey").select("c_custkey", "place")


@registry.add("SELECT DISTINCT o_custkey AS a, l_partkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'N') AND l_quantity >= 45")
def positive_pairs(t: Tables) -> DataFrame:
    own = t.lineitem.where(C("l_returnflag").isin("A", "N") & (C("l_quantity") >= 45)).join(t.orders, C("o_orderkey") == C("l_orderkey"))
    return own.select(C("o_custkey").alias("a"), C("l_partkey").alias("b")).distinct()


@registry.add("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND event_id < (SELECT max(event_id) - 5000 FROM events) AND user_id NOT IN (SELECT o_custkey FROM orders))")
def retention_cleanup(t: Tables) -> DataFrame:
    last = t.events.agg((F.max("event_id") - 5000).alias("bound"))
    old = t.events.where("event_type = 'error'").join(F.broadcast(last)).where("event_id < bound")
    return t.events.join(J.orphans(old, "user_id", t.orders, "o_custkey"), "event_id", "left_anti").select("event_id")


@registry.add("SELECT l_returnflag || l_linestatus AS source, count(*) AS n, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY 1")
def source_attribution(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("source")).agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"))


@registry.add("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_versions(t: Tables) -> DataFrame:
    return E.latest_version(t.events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@registry.add("SELECT o_custkey, round(CASE WHEN bool_or(o_orderstatus = 'P') THEN 0.1 ELSE 0.85 END - least(0.2, 0.02 * count(*) FILTER (o_totalprice > 300000)), 9) AS safety FROM orders GROUP BY o_custkey")
def safety_scores(t: Tables) -> DataFrame:
    base = F.when(F.bool_or(C("o_orderstatus") == "P"), 0.1).otherwise(0.85)
    return t.orders.groupBy("o_custkey").agg(F.round(base - F.least(F.lit(0.2), 0.02 * F.count_if(C("o_totalprice") > 300000)), 9).alias("safety"))


@registry.add("SELECT o_orderpriority, total, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS total, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r BETWEEN 11 AND 15")
def pages_with_totals(t: Tables) -> DataFrame:
    totals = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("total"))
    page = R.top_per_group(t.orders, ["o_orderpriority"], [C("o_totalprice").desc(), C("o_orderkey")], 15).where("rank >= 11")
    return page.join(totals, "o_orderpriority").select("o_orderpriority", "total", "o_orderkey")


@registry.add("SELECT vec_id, round(1 / (1 + exp(-(label - 5) / 2.5)), 9) AS p FROM embeddings")
def temperature_scaling(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(R.temperature_scaled(C("label") - 5, 2.5), 9).alias("p"))


@registry.add("SELECT label, id, out_degree FROM (SELECT 'C' AS label, c_custkey AS id, count(o_orderkey) AS out_degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def node_degrees(t: Tables) -> DataFrame:
    e = t.orders.select(F.lit("C").alias("src_label"), C("o_custkey").alias("src_id"))
    return G.degrees(t.customer.select(F.lit("C").alias("label"), C("c_custkey").alias("id")), e)


@registry.add("SELECT o_custkey, round(sum(o_totalprice * w) / sum(w), 4) AS v FROM (SELECT o_custkey, o_totalprice, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS w FROM orders) GROUP BY o_custkey")
def priority_weighted_mean(t: Tables) -> DataFrame:
    w = 6 - F.substring("o_orderpriority", 1, 1).cast("int")
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum(C("o_totalprice") * w) / F.sum(w), 4).alias("v"))


@registry.add("SELECT split, count(*) AS n FROM (SELECT CASE WHEN v <= q1 THEN 'early' WHEN v <= q2 THEN 'middle' ELSE 'late' END AS split FROM (SELECT event_id AS v FROM events), (SELECT quantile_cont(event_id, 0.8) AS q1, quantile_cont(event_id, 0.9) AS q2 FROM events)) GROUP BY split")
def time_ordered_split(t: Tables) -> DataFrame:
    q = quantiles(t.events, "event_id", {"q1": 0.8, "q2": 0.9})
    split = F.when(C("event_id") <= C("q1"), "early").when(C("event_id") <= C("q2"), "middle").otherwise("late")
    return t.events.join(F.broadcast(q)).groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@registry.add("""
WITH g AS (SELECT l_extendedprice AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(p * (below + n / 2.0)) / sum(p) / sum(n), 9) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM b""")
def auc_of_lines(t: Tables) -> DataFrame:
    own = t.lineitem.select(C("l_extendedprice").alias("s"), (C("l_returnflag") == "R").alias("y"))
    return R.auc(own, "s", "y").withColumn("auc", F.round("auc", 9))


@registry.add("""
WITH p AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS i FROM (SELECT DISTINCT l_partkey FROM lineitem)),
s AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS i FROM (SELECT DISTINCT l_suppkey FROM lineitem))
SELECT DISTINCT p.i AS src, s.i AS dst FROM lineitem JOIN p USING (l_partkey) JOIN s USING (l_suppkey)""")
def edge_index_maps(t: Tables) -> DataFrame:
    line = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    src = J.dense_index(line.withColumn("kind", F.lit("Part")), "kind", "l_partkey").select("l_partkey", C("index").alias("src"))
    dst = J.dense_index(line.withColumn("kind", F.lit("Supplier")), "kind", "l_suppkey").select("l_suppkey", C("index").alias("dst"))
    return line.join(src, "l_partkey").join(dst, "l_suppkey").select("src", "dst")


@registry.add("SELECT p_partkey, p_name, CASE WHEN p_size <= 10 THEN 'small' ELSE p_type END AS kind FROM part WHERE p_size <= 10 OR p_type IN ('PROMO', 'ECONOMY')")
def labelled_projection(t: Tables) -> DataFrame:
    kept = t.part.where((C("p_size") <= 10) | C("p_type").isin("PROMO", "ECONOMY"))
    return kept.select("p_partkey", "p_name", F.when(C("p_size") <= 10, "small").otherwise(C("p_type")).alias("kind"))
