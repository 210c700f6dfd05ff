"""Deduplication, aggregation, joins, entity matching and ranking on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.operators import aggregate as A, dedup as D, joins as J, rank as R, resolve as E
from lodestone.plans.base import Registry, Tables

registry = Registry()
C = F.col
PAIRS = "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_extendedprice AS s, l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_partkey <> l_suppkey"


def _pairs(t: Tables) -> DataFrame:
    own = t.lineitem.select(C("l_partkey").alias("a"), C("l_suppkey").alias("b"), C("l_extendedprice").alias("s"), C("l_orderkey").alias("o"), C("l_linenumber").alias("n"))
    return own


@registry.add(f"SELECT a, b, s, o, n FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY s DESC, o, n) AS r FROM ({PAIRS})) WHERE r = 1 ORDER BY s DESC, a, b LIMIT 100")
def best_pairs_topk(t: Tables) -> DataFrame:
    return R.top(D.best_pairs(_pairs(t), "a", "b", "s", [C("o"), C("n")]), [C("s").desc(), C("a"), C("b")], 100)


@registry.add("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'P')::INT + (o_totalprice > 1000)::INT DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def most_complete_rows(t: Tables) -> DataFrame:
    own = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.when(C("o_orderstatus") != "P", C("o_orderstatus")).alias("x"), F.when(C("o_totalprice") > 1000, C("o_totalprice")).alias("y"))
    best = D.best_per_key(own, ["o_custkey"], [D.completeness(["x", "y"]).desc(), C("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


@registry.add("SELECT o_custkey, arg_min(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END) AS status, arg_min(CASE WHEN o_orderpriority NOT LIKE '4%' THEN o_orderpriority END, CASE WHEN o_orderpriority NOT LIKE '4%' THEN o_orderkey END) AS priority FROM orders GROUP BY o_custkey")
def first_filled_fields(t: Tables) -> DataFrame:
    own = t.orders.select("o_custkey", "o_orderkey", F.when(C("o_orderstatus") != "P", C("o_orderstatus")).alias("status"), F.when(~C("o_orderpriority").startswith("4"), C("o_orderpriority")).otherwise("  ").alias("priority"))
    return D.merged_fields(own, ["o_custkey"], C("o_orderkey"), ["status", "priority"])


@registry.add("SELECT o_orderkey, (r = 1) AS first FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice, o_orderkey) AS r FROM orders)")
def marked_duplicates(t: Tables) -> DataFrame:
    return D.best_per_key(t.orders, ["o_custkey", "o_orderstatus"], [C("o_totalprice"), C("o_orderkey")], mark="first").select("o_orderkey", "first")


@registry.add("SELECT o_orderkey FROM (SELECT o_orderkey, k, row_number() OVER (PARTITION BY k ORDER BY o_orderkey) AS r FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS k FROM orders)) WHERE k IS NULL OR r = 1")
def null_keys_kept(t: Tables) -> DataFrame:
    own = t.orders.select("o_orderkey", F.when(C("o_custkey") % 3 != 0, C("o_custkey")).alias("k"))
    return D.best_per_key(own, ["k"], [C("o_orderkey")]).select("o_orderkey")


@registry.add("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def last_occurrence(t: Tables) -> DataFrame:
    return D.last_per_key(t.events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@registry.add("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, event_id) AS r FROM events) WHERE r = 1")
def priority_dedup(t: Tables) -> DataFrame:
    return D.by_priority(t.events, ["user_id"], "event_type", ["purchase", "signup"], [C("event_id")]).select("user_id", "event_id")


@registry.add("SELECT substr(p_brand, 1, 7) AS prefix, count(DISTINCT right(p_brand, 1)) AS versions FROM part GROUP BY 1 HAVING count(DISTINCT right(p_brand, 1)) > 1")
def mixed_key_versions(t: Tables) -> DataFrame:
    return D.mixed_versions(t.part, "p_brand", 7)


@registry.add("SELECT o_totalprice, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t: Tables) -> DataFrame:
    return D.duplicate_values(t.orders, "o_totalprice")


@registry.add("""
WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS median, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_suppkey)
SELECT l.l_suppkey, round(any_value(m.median), 4) AS median, any_value(m.n) AS n, arg_min(l.l_orderkey, (abs(l.l_extendedprice - m.median), l.l_orderkey)) AS representative
FROM lineitem l JOIN m USING (l_suppkey) WHERE l.l_extendedprice > 0 GROUP BY l.l_suppkey""")
def median_representative(t: Tables) -> DataFrame:
    return A.median_with_representative(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_orderkey").withColumn("median", F.round("median", 4))


@registry.add(f"SELECT a, b, round(avg(s), 6) AS score, count(*) AS n FROM ({PAIRS}) GROUP BY a, b")
def mean_pair_scores(t: Tables) -> DataFrame:
    return A.pair_scores(D.canonical_pair(_pairs(t), "a", "b"), "a", "b", "s", "o").withColumn("score", F.round("score", 6))


@registry.add("SELECT l_partkey, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax, arg_min(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, CASE WHEN l_returnflag <> 'N' THEN (l_orderkey * 8 + l_linenumber) * 100000000 + CAST(l_extendedprice * 100 AS BIGINT) END) AS flag, count(*) AS evidence_count FROM lineitem GROUP BY l_partkey")
def channel_maxima(t: Tables) -> DataFrame:
    order = (C("l_orderkey") * 8 + C("l_linenumber")) * 100000000 + F.round(C("l_extendedprice") * 100).cast("long")
    own = t.lineitem.withColumn("order", order).withColumn("flag", F.when(C("l_returnflag") != "N", C("l_returnflag")).otherwise(" "))
    return A.channel_maxima(own, ["l_partkey"], ["l_quantity", "l_discount", "l_tax"], "flag", "order")


@registry.add("""
SELECT l_partkey, count(*) AS n, count(*) FILTER (l_quantity >= 25) AS n_over, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.75), 6) AS p75
FROM lineitem GROUP BY l_partkey HAVING count(*) >= 3 AND count(*) FILTER (l_quantity >= 25) >= greatest(2.0, count(*) * 0.25)""")
def expression_groups(t: Tables) -> DataFrame:
    out = A.expression_statistics(t.lineitem, ["l_partkey"], "l_quantity", C("l_returnflag") == "A", threshold=25)
    return out.select("l_partkey", "n", "n_over", F.round("median", 6).alias("median"), F.round("p75", 6).alias("p75"))


# A tail of Student's distribution is a share of the integral of a power of the cosine, here by Simpson's rule.
@registry.add("""
WITH g AS (
  SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_quantity >= 25) AS n_over, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag <> 'A') AS nb,
         avg(l_quantity) FILTER (l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (l_returnflag <> 'A') AS mb, var_samp(l_quantity) FILTER (l_returnflag = 'A') / count(*) FILTER (l_returnflag = 'A') AS ea, var_samp(l_quantity) FILTER (l_returnflag <> 'A') / count(*) FILTER (l_returnflag <> 'A') AS eb
  FROM lineitem GROUP BY l_suppkey),
t AS (SELECT l_suppkey, (ma - mb) / sqrt(ea + eb) AS t, (ea + eb) * (ea + eb) / (ea * ea / (na - 1) + eb * eb / (nb - 1)) AS df FROM g WHERE n >= 3 AND n_over >= greatest(2.0, n * 0.25) AND na >= 2 AND nb >= 2 AND ea + eb > 0),
w AS (SELECT list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) AS w),
p AS (
  SELECT l_suppkey, t, 1 - atan(abs(t) / sqrt(df)) * list_sum(list_transform(range(0, 2001), lambda i: w[i + 1] * pow(cos(atan(abs(t) / sqrt(df)) * i / 2000), df - 1)))
         / (pi() / 2 * list_sum(list_transform(range(0, 2001), lambda i: w[i + 1] * pow(greatest(cos(pi() / 2 * i / 2000), 0.0), df - 1)))) AS p FROM t, w),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, l_suppkey) AS raw FROM p)
SELECT l_suppkey, round(t, 6) AS t, round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY p DESC, l_suppkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS fdr FROM r""")
def welch_fdr(t: Tables) -> DataFrame:
    stats = A.expression_statistics(t.lineitem, ["l_suppkey"], "l_quantity", C("l_returnflag") == "A", threshold=25)
    return A.benjamini_hochberg(A.welch(stats), "p", "l_suppkey").select("l_suppkey", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"))


@registry.add("""
WITH s AS (SELECT l_suppkey, count(*) AS n, min(l_discount) + 1.0 / (count(*) + l_suppkey) AS p FROM lineitem GROUP BY l_suppkey),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, l_suppkey) AS raw FROM s)
SELECT l_suppkey, round(least(1.0, min(raw) OVER (ORDER BY p DESC, l_suppkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS fdr FROM r""")
def step_up_fdr(t: Tables) -> DataFrame:
    own = t.lineitem.groupBy("l_suppkey").agg((F.min("l_discount") + 1.0 / (F.count("*") + C("l_suppkey"))).alias("p"))
    return A.benjamini_hochberg(own, "p", "l_suppkey").select("l_suppkey", F.round("fdr", 9).alias("fdr"))


@registry.add("SELECT l_partkey, max(l_discount) AS l_discount, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS l_returnflag, arg_min(l_orderkey, (-l_discount, l_orderkey)) AS best_row FROM lineitem GROUP BY l_partkey")
def merged_evidence(t: Tables) -> DataFrame:
    return A.merged_edges(t.lineitem, ["l_partkey"], "l_discount", "l_linenumber", "l_returnflag", "l_orderkey")


@registry.add("SELECT l_suppkey, round(avg(l_discount), 9) AS l_discount, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY l_suppkey")
def averaged_evidence(t: Tables) -> DataFrame:
    return A.merged_edges(t.lineitem, ["l_suppkey"], "l_discount", "l_linenumber", "l_returnflag", "l_orderkey", how="average").select("l_suppkey", F.round("l_discount", 9).alias("l_discount"), "l_linenumber")


@registry.add("SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS total, max(l_extendedprice) AS highest, min(l_tax) AS lowest, bool_or(l_returnflag = 'R') AS any_flag FROM lineitem GROUP BY l_partkey")
def evidence_rollup(t: Tables) -> DataFrame:
    return A.evidence_rollup(t.lineitem, ["l_partkey"], total="l_quantity", highest="l_extendedprice", lowest="l_tax", flag=C("l_returnflag") == "R")


@registry.add("SELECT l_partkey, round(greatest(0.0, least(1.0, max(l_discount * 10 * CASE l_returnflag WHEN 'A' THEN 0.9 WHEN 'N' THEN 0.7 ELSE 0.5 END))), 9) AS confidence FROM lineitem GROUP BY l_partkey")
def reliable_confidence(t: Tables) -> DataFrame:
    own = t.lineitem.withColumn("conf", C("l_discount") * 10)
    return A.reliable_confidence(own, ["l_partkey"], "conf", "l_returnflag", {"A": 0.9, "N": 0.7}).withColumn("confidence", F.round("confidence", 9))


@registry.add("SELECT c_nationkey, choice, votes, row_number() OVER (PARTITION BY c_nationkey ORDER BY votes DESC, choice) AS rank FROM (SELECT c_nationkey, substr(c_mktsegment, 1, 1) AS choice, count(*) AS votes FROM customer GROUP BY 1, 2)")
def class_votes(t: Tables) -> DataFrame:
    return A.vote_counts(t.customer, "c_nationkey", F.substring("c_mktsegment", 1, 1))


@registry.add("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events")
def score_distribution(t: Tables) -> DataFrame:
    out = A.score_distribution(t.events, "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "median", "q75")})


@registry.add("""
SELECT check_name, broken, rows, broken / rows AS share FROM (
  SELECT 'price_over_1000' AS check_name, count(*) FILTER (NOT o_totalprice > 1000) AS broken, count(*) AS rows FROM orders
  UNION ALL SELECT 'priority_format', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$')), count(*) FROM orders
  UNION ALL SELECT 'status_known', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')), count(*) FROM orders)""")
def quality_report(t: Tables) -> DataFrame:
    return A.quality_report(t.orders, {"price_over_1000": C("o_totalprice") > 1000, "priority_format": C("o_orderpriority").rlike("^[1-5]-[A-Z ]+$"), "status_known": C("o_orderstatus").isin("F", "O")})


@registry.add("SELECT completeness, uniqueness, round(validity, 9) AS validity, round((completeness + uniqueness + validity) / 3, 9) AS score FROM (SELECT 1.0::DOUBLE AS completeness, count(DISTINCT o_orderkey) / count(*) AS uniqueness, avg((o_totalprice > 100000)::INT) AS validity FROM orders)")
def quality_score(t: Tables) -> DataFrame:
    out = A.quality_score(t.orders, ["o_custkey", "o_orderstatus"], "o_orderkey", C("o_totalprice") > 100000)
    return out.withColumns({c: F.round(c, 9) for c in ("validity", "score")})


@registry.add("SELECT c_mktsegment, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY c_mktsegment")
def label_shares(t: Tables) -> DataFrame:
    return A.shares(t.customer, "c_mktsegment")


@registry.add("""
SELECT 'no_self_pairs' AS gate, CAST(count(*) FILTER (l_partkey = l_suppkey) AS DOUBLE) AS value, count(*) FILTER (l_partkey = l_suppkey) = 0 AS passed FROM lineitem
UNION ALL SELECT 'rows', CAST(count(*) AS DOUBLE), count(*) >= 1000 FROM lineitem
UNION ALL SELECT 'null_keys', CAST(count(*) FILTER (l_orderkey IS NULL) AS DOUBLE), count(*) FILTER (l_orderkey IS NULL) = 0 FROM lineitem""")
def exit_gates(t: Tables) -> DataFrame:
    return A.gates(t.lineitem, {"no_self_pairs": (F.count_if(C("l_partkey") == C("l_suppkey")), C("no_self_pairs") == 0), "rows": (F.count("*"), C("rows") >= 1000), "null_keys": (F.count_if(C("l_orderkey").isNull()), C("null_keys") == 0)})


@registry.add("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def action_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "event_type").limit(3)


@registry.add("SELECT min(o_orderkey) FILTER (r = 1) AS kept, count(*) FILTER (r > 1) AS others, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) GROUP BY o_custkey HAVING count(*) FILTER (r > 1) > 0")
def filtered_aggregates(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    own = t.orders.withColumn("r", F.row_number().over(W.partitionBy("o_custkey").orderBy(C("o_totalprice").desc(), "o_orderkey")))
    return own.groupBy("o_custkey").agg(F.min(F.when(C("r") == 1, C("o_orderkey"))).alias("kept"), F.count_if(C("r") > 1).alias("others")).where("others > 0")


# -- joins -------------------------------------------------------------------


@registry.add("SELECT p.p_partkey, p.p_name, p.p_retailprice - 1 AS p_retailprice FROM part p")
def replaced_detail(t: Tables) -> DataFrame:
    detail = t.part.select("p_partkey", (C("p_retailprice") - 1).alias("p_retailprice"))
    return J.replaced_columns(t.part.select("p_partkey", "p_name", "p_retailprice"), detail, ["p_partkey"], ["p_retailprice"]).select("p_partkey", "p_name", "p_retailprice")


@registry.add("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS group_n, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS group_mean FROM orders")
def group_statistics(t: Tables) -> DataFrame:
    return J.group_statistics(t.orders, "o_custkey", "o_totalprice").select("o_orderkey", "group_n", F.round("group_mean", 4).alias("group_mean"))


@registry.add("SELECT coalesce(reason, 'mapped') AS reason, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 4 = 0 AND l_suppkey % 4 = 0 THEN 'both' WHEN l_partkey % 4 = 0 THEN 'first' WHEN l_suppkey % 4 = 0 THEN 'second' END AS reason FROM lineitem) GROUP BY 1")
def translated_ends(t: Tables) -> DataFrame:
    mapping = t.part.where("p_partkey % 4 <> 0").select(C("p_partkey").alias("from"), (C("p_partkey") + 1000000).alias("to"))
    good, bad = J.translated_ends(_pairs(t).select("a", "b"), mapping, "a", "b", source="from", target="to")
    return good.select(F.lit("mapped").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@registry.add("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS index FROM customer")
def dense_indices(t: Tables) -> DataFrame:
    return J.dense_index(t.customer, "c_mktsegment", "c_custkey")


@registry.add("SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'nation ' || n_name) AS found FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def two_level_lookup(t: Tables) -> DataFrame:
    direct = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    second = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey")).select("c_custkey", F.concat(F.lit("nation "), "n_name").alias("v"))
    own = t.orders.select("o_orderkey", C("o_custkey").alias("k"))
    return J.first_of(own, [(direct, "c_custkey", "c_name"), (second, "c_custkey", "v")], "k", "found").select("o_orderkey", "found")


@registry.add("SELECT c_custkey AS id, arg_min(o_orderkey, (rank, o_orderkey)) AS primary_id, coalesce(array_to_string(list_transform(list_sort(list_distinct(list(CASE WHEN o_orderkey IS NOT NULL THEN {'rank': rank, 'o': o_orderkey} END))), lambda s: CAST(s.o AS VARCHAR)), '|'), '') AS all_ids FROM (SELECT c_custkey FROM customer) LEFT JOIN (SELECT o_custkey, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey")
def crosswalk_translate(t: Tables) -> DataFrame:
    walk = t.orders.select(F.lit("customer").alias("src_ns"), C("o_custkey").alias("src_id"), F.lit("order").alias("dst_ns"), C("o_orderkey").alias("dst_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"))
    return J.translate(walk, t.customer.select(C("c_custkey").alias("id")), "customer", "order")


@registry.add("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT s_suppkey AS k, s_name AS v FROM supplier) b ON a.k = b.k")
def crosswalk_merge(t: Tables) -> DataFrame:
    one = t.customer.where("c_custkey % 2 = 0").select(C("c_custkey").alias("k"), C("c_name").alias("v"))
    other = t.supplier.select(C("s_suppkey").alias("k"), C("s_name").alias("v"))
    return J.merged_crosswalks(one, other, "k", "v", "keep_self")


@registry.add("""
SELECT region.r_name, nation.n_name, cr.r_name AS buyer_region, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region cr ON cr.r_regionkey = cn.n_regionkey
WHERE l_quantity >= 10 AND p_type IN ('ECONOMY', 'PROMO') GROUP BY ALL""")
def nine_table_join(t: Tables) -> DataFrame:
    own = t.lineitem.where("l_quantity >= 10").join(t.orders, C("o_orderkey") == C("l_orderkey")).join(t.customer, C("c_custkey") == C("o_custkey")).join(t.part.where(C("p_type").isin("ECONOMY", "PROMO")), C("p_partkey") == C("l_partkey"))
    own = own.join(t.supplier, C("s_suppkey") == C("l_suppkey"), "left").join(t.nation, C("n_nationkey") == C("s_nationkey"), "left").join(t.region, C("r_regionkey") == C("n_regionkey"), "left")
    buyer = t.nation.join(t.region.select("r_regionkey", C("r_name").alias("buyer_region")), C("r_regionkey") == C("n_regionkey")).select(C("n_nationkey").alias("buyer_nation"), "buyer_region")
    own = own.join(buyer, C("buyer_nation") == C("c_nationkey"))
    return own.groupBy("r_name", "n_name", "buyer_region").agg(F.count("*").alias("n"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 4).alias("revenue"))


@registry.add("SELECT o_custkey, event_type, count(*) AS n FROM orders JOIN events ON user_id = o_custkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, event_type")
def fan_out_join(t: Tables) -> DataFrame:
    return t.orders.join(t.events, C("user_id") == C("o_custkey")).join(t.customer, C("c_custkey") == C("o_custkey"), "left").groupBy("o_custkey", "event_type").agg(F.count("*").alias("n"))


@registry.add("SELECT c_custkey, (SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders WHERE o_custkey = c_custkey) AS statuses FROM customer")
def correlated_lists(t: Tables) -> DataFrame:
    lists = J.joined_values(t.orders, "o_custkey", "o_orderstatus", "statuses").withColumnRenamed("o_custkey", "c_custkey")
    return t.customer.select("c_custkey").join(lists, "c_custkey", "left")


@registry.add("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') THEN 'partial' WHEN bool_or(o_orderstatus = 'F') THEN 'met' WHEN bool_or(o_orderstatus = 'O') THEN 'not_met' ELSE 'unknown' END AS outcome FROM orders GROUP BY o_custkey")
def outcome_classes(t: Tables) -> DataFrame:
    return J.outcome_class(t.orders, "o_custkey", C("o_orderstatus") == "F", C("o_orderstatus") == "O")


@registry.add("SELECT c_custkey, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AS bought FROM customer")
def existence_flags(t: Tables) -> DataFrame:
    buyers = t.events.where("event_type = 'purchase'").select(C("user_id").alias("c_custkey"))
    return J.with_existence(t.customer.select("c_custkey"), ["c_custkey"], buyers, "bought")


@registry.add("SELECT event_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)")
def integrity_orphans(t: Tables) -> DataFrame:
    return J.orphans(t.events, "user_id", t.orders, "o_custkey").select("event_id")


@registry.add("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_count(t: Tables) -> DataFrame:
    return J.orphans(t.customer, "c_custkey", t.orders, "o_custkey").agg(F.count("*").alias("n"))


@registry.add("""
WITH p AS (SELECT c_name, p_name, c_custkey, p_partkey, p_retailprice / (1 + abs(c_custkey * 7 - p_partkey) % 100) AS score FROM customer CROSS JOIN part),
known AS (SELECT DISTINCT lower(c_name) AS a, lower(p_name) AS b FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
SELECT c_custkey, p_partkey, round(score, 9) AS score FROM p WHERE NOT EXISTS (SELECT 1 FROM known WHERE a = lower(c_name) AND b = lower(p_name)) ORDER BY p.score DESC, c_custkey, p_partkey LIMIT 50""")
def novel_pairs(t: Tables) -> DataFrame:
    known = t.customer.join(t.orders, C("o_custkey") == C("c_custkey")).join(t.lineitem, C("l_orderkey") == C("o_orderkey")).join(t.part, C("p_partkey") == C("l_partkey")).select("c_name", "p_name")
    score = C("p_retailprice") / (1 + F.abs(C("c_custkey") * 7 - C("p_partkey")) % 100)
    best = J.top_unseen_pairs(t.customer.select("c_custkey", "c_name"), t.part.select("p_partkey", "p_name", "p_retailprice"), known, "c_name", "p_name", bound=F.greatest("p_retailprice", F.lit(0.0)), score=score, ties=["c_custkey", "p_partkey"], k=50)
    return best.select("c_custkey", "p_partkey", F.round("score", 9).alias("score"))


@registry.add("SELECT r_name, n_name, length(r_name) * n_nationkey AS score FROM region CROSS JOIN nation")
def all_pair_scores(t: Tables) -> DataFrame:
    return J.all_pairs(t.region, t.nation).select("r_name", "n_name", (F.length("r_name") * C("n_nationkey")).alias("score"))


@registry.add("SELECT DISTINCT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON (a.p_partkey = b.p_partkey + 1 OR a.p_partkey = b.p_partkey - 3) AND a.p_partkey < b.p_partkey")
def alias_pairs(t: Tables) -> DataFrame:
    return J.alias_pairs(t.part.withColumn("aliases", F.array(C("p_partkey") + 1, C("p_partkey") - 3)), "p_partkey", "aliases")


@registry.add("""
WITH ch AS (SELECT c_custkey, c_name || '*' AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 5.0 END AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey < 10)
SELECT coalesce(t.c_custkey, ch.c_custkey) AS c_custkey, coalesce(ch.c_name, t.c_name) AS c_name, coalesce(ch.c_acctbal, t.c_acctbal) AS c_acctbal FROM customer t FULL JOIN ch ON t.c_custkey = ch.c_custkey""")
def keyed_upsert(t: Tables) -> DataFrame:
    table = t.customer.select("c_custkey", "c_name", "c_acctbal")
    changed = table.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), F.when(C("c_custkey") % 2 == 0, 5.0).alias("c_acctbal"), F.lit(2).alias("v"))
    old = changed.withColumn("v", F.lit(1)).withColumn("c_name", F.lit("stale"))
    new = table.where("c_custkey < 10").select((C("c_custkey") + 1000000).alias("c_custkey"), "c_name", "c_acctbal", F.lit(2).alias("v"))
    return J.upserted(table, changed.unionByName(old).unionByName(new), ["c_custkey"], C("v"))


@registry.add("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN n = 1 THEN p END) AS segment FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def conditional_fill(t: Tables) -> DataFrame:
    table = t.customer.select("c_custkey", F.when(C("c_custkey") % 2 == 0, C("c_mktsegment")).alias("segment"))
    return J.filled_from(table, t.orders.select(C("o_custkey").alias("c_custkey"), C("o_orderpriority").alias("segment")), "c_custkey", "segment")


@registry.add("SELECT reason, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN NOT o_totalprice > 50000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END], lambda x: x IS NOT NULL), ',') AS reason FROM orders) WHERE reason <> '' GROUP BY reason")
def quarantined_rows(t: Tables) -> DataFrame:
    _, bad = J.split_valid(t.orders, {"price": C("o_totalprice") > 50000, "status": C("o_orderstatus").isin("F", "O")})
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@registry.add("SELECT c_custkey, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_distinct_counts(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, C("o_custkey") == C("c_custkey"), "left").groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("n"))


# -- entities ----------------------------------------------------------------


@registry.add("""
WITH e AS (SELECT s_suppkey, md5(s_name) AS k, lower(s_name) AS nm FROM supplier),
r AS (SELECT s_suppkey AS record_id, CASE s_suppkey % 4 WHEN 0 THEN md5(s_name) WHEN 1 THEN substr(md5(s_name), 1, 14) || 'zzz' ELSE 'none' || s_suppkey END AS k, CASE s_suppkey % 4 WHEN 2 THEN lower(s_name) WHEN 3 THEN 'nobody ' || s_suppkey ELSE 'x' END AS nm FROM supplier)
SELECT record_id, CASE WHEN record_id % 4 < 3 THEN e.k END AS match, CASE record_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'block' WHEN 2 THEN 'name' END AS method, CASE record_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.85::DOUBLE END AS confidence
FROM r JOIN e ON e.s_suppkey = r.record_id""")
def entity_cascade(t: Tables) -> DataFrame:
    s, n = t.supplier, C("s_suppkey") % 4
    digest = F.md5(C("s_name").cast("binary"))
    e = s.select(digest.alias("k"), F.lower("s_name").alias("nm"))
    key = F.when(n == 0, digest).when(n == 1, F.concat(F.substring(digest, 1, 14), F.lit("zzz"))).otherwise(F.concat(F.lit("none"), C("s_suppkey").cast("string")))
    name = F.when(n == 2, F.lower("s_name")).when(n == 3, F.concat(F.lit("nobody "), C("s_suppkey").cast("string"))).otherwise("x")
    return E.cascade(s.select("s_suppkey", key.alias("k"), name.alias("nm")), e, record_id="s_suppkey", key="k", name="nm")


@registry.add()
def fuzzy_names(t: Tables) -> DataFrame:
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").cast("string").alias("k"))
    r = names.select(C("k").alias("id"), F.concat(F.lit("?"), "k").alias("k"), F.concat("p_name", F.lit("s")).alias("p_name"))
    return E.cascade(r, names, record_id="id", key="k", name="p_name", block=99)


@registry.add("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_nationkey > 5 THEN 'PUBCHEM:' || c_nationkey END, 'CHEMBL:' || c_mktsegment) AS id FROM customer")
def canonical_ids(t: Tables) -> DataFrame:
    first = F.when(C("c_custkey") % 3 == 0, F.concat(F.lit(" "), "c_name"))
    return t.customer.select("c_custkey", E.canonical_id(first, F.when(C("c_nationkey") > 5, C("c_nationkey")).otherwise(0), C("c_mktsegment")).alias("id"))


@registry.add("SELECT p_brand, arg_min(p_type, (p_size, p_type)) AS p_type, arg_min(CASE WHEN p_size > 10 THEN p_name END, CASE WHEN p_size > 10 THEN (p_size, p_name) END) AS p_name FROM part GROUP BY p_brand")
def ingested_entities(t: Tables) -> DataFrame:
    own = t.part.select("p_brand", "p_type", F.when(C("p_size") > 10, C("p_name")).alias("p_name"), "p_size")
    return E.ingested(own, "p_brand", ["p_type", "p_name"], "p_size")[0].drop("sources")


@registry.add("WITH m AS (SELECT p_brand, arg_min(p_type, (p_size, p_type)) AS kept FROM part GROUP BY p_brand) SELECT DISTINCT p_brand, 'p_type' AS field, kept, p_type AS other FROM part JOIN m USING (p_brand) WHERE p_type <> kept")
def merge_conflicts(t: Tables) -> DataFrame:
    return E.ingested(t.part.select("p_brand", "p_type", "p_size"), "p_brand", ["p_type"], "p_size")[1]


@registry.add("SELECT o_custkey, array_to_string(list_filter(s, lambda x: x <> '5-LOW'), '|') AS sources FROM (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS s FROM orders GROUP BY o_custkey) WHERE array_to_string(list_filter(s, lambda x: x <> '5-LOW'), '|') <> ''")
def removed_source(t: Tables) -> DataFrame:
    mapping = t.orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("sources"))
    return E.without_source(mapping, "sources", "5-LOW")


@registry.add("SELECT user_id, arg_max(CASE WHEN value > 50 THEN value END, CASE WHEN value > 50 THEN event_id END) AS value FROM events WHERE event_id <= 8000 GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def state_as_of(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "event_id", F.when(C("value") > 50, C("value")).alias("value"), F.when(C("event_type") == "error", "remove").otherwise("merge").alias("action"))
    return E.as_of(log, "user_id", "event_id", ["value"], "action", 8000)


@registry.add("SELECT p_name, count(DISTINCT p_partkey) AS n_keys, min(p_partkey) AS first_key FROM part GROUP BY p_name")
def name_index(t: Tables) -> DataFrame:
    return E.name_index(t.part, "p_name", "p_partkey")


@registry.add("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND c_custkey IN (SELECT o_custkey FROM orders)")
def confident_lookup(t: Tables) -> DataFrame:
    ids = t.orders.select(C("o_custkey").alias("c_custkey")).distinct()
    return E.confident(t.customer, ids, "c_custkey", "c_acctbal", 5000).select("c_custkey", "c_acctbal")


@registry.add("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'removed' WHEN c_custkey % 5 = 0 THEN 'modified' END AS change FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0")
def mapping_changes(t: Tables) -> DataFrame:
    new = t.customer.where("c_custkey % 7 <> 0").withColumn("c_name", F.when(C("c_custkey") % 5 == 0, "new").otherwise(C("c_name")))
    return E.changes(t.customer, new, "c_custkey", ["c_name", "c_mktsegment"])


@registry.add("SELECT count(*) AS n, round(quantile_cont(v, 0.95), 4) AS high, round(quantile_cont(v, 0.5), 4) AS low, round(stddev_pop(v), 4) AS std FROM (SELECT value / 100 AS v FROM events) WHERE v BETWEEN 0 AND 1")
def calibrated_thresholds(t: Tables) -> DataFrame:
    return E.thresholds(t.events.select((C("value") / 100).alias("v")), "v")


# -- ranking -----------------------------------------------------------------


@registry.add("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_group(t: Tables) -> DataFrame:
    return R.top_per_group(t.orders, ["o_custkey"], [C("o_totalprice").desc(), C("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@registry.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged_ranking(t: Tables) -> DataFrame:
    return R.page(t.orders.select("o_orderkey", "o_totalprice"), [C("o_totalprice").desc(), C("o_orderkey")], offset=40, limit=20)


@registry.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 400000 OR (o_totalprice = 400000 AND o_orderkey > 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def keyset_page(t: Tables) -> DataFrame:
    return R.page_after(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", after=(400000.0, 0), limit=20)


@registry.add("""
WITH s AS (SELECT n_chars AS score, quality AS y FROM labels JOIN documents USING (doc_id)),
g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY score),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(p * (below + n / 2.0)) / sum(p) / sum(n), 9) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM b""")
def ranking_auc(t: Tables) -> DataFrame:
    own = t.labels.join(t.documents, "doc_id").select(C("n_chars").alias("score"), C("quality").alias("y"))
    return R.auc(own, "score", "y").withColumn("auc", F.round("auc", 9))


@registry.add("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS avg_rank FROM events")
def average_ranks(t: Tables) -> DataFrame:
    return R.average_ranks(t.events, "value", ["event_type"]).select("event_id", "avg_rank")


@registry.add("""
WITH r AS (SELECT o_custkey, (o_orderstatus = 'F')::INT AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey, count(*) FILTER (y = 1 AND r <= 5) / 5 AS precision_at_k, CASE WHEN sum(y) > 0 THEN count(*) FILTER (y = 1 AND r <= 5) / sum(y) END AS recall_at_k,
       coalesce(1.0::DOUBLE / min(CASE WHEN y = 1 THEN r END), 0.0) AS reciprocal_rank, (count(*) FILTER (y = 1 AND r <= 5) > 0)::INT AS hit_at_k
FROM r GROUP BY o_custkey""")
def ranking_metrics(t: Tables) -> DataFrame:
    own = t.orders.withColumn("y", (C("o_orderstatus") == "F").cast("int"))
    return R.ranking_metrics(own, "o_custkey", "o_orderkey", "o_totalprice", "y", 5)


@registry.add("WITH g AS (SELECT round(n_chars, 12) AS s, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT CAST(sum(CASE WHEN p > 0 THEN n ELSE 0 END) AS BIGINT) AS leaked, sum(CASE WHEN p > 0 THEN n ELSE 0 END) / (sum(p) * sum(n)) AS ratio FROM g")
def score_leakage(t: Tables) -> DataFrame:
    return R.leakage(t.labels.join(t.documents, "doc_id").select(C("n_chars").cast("double").alias("s0"), C("toxic").alias("y")), "s0", "y")


@registry.add("""
WITH d AS (SELECT b, c_acctbal AS v, (CAST('0x' || substr(md5(b || ':' || c_custkey), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u FROM customer, range(50) r(b)),
w AS (SELECT b, v, (u > 0.36787944117144233)::INT + (u > 0.7357588823428847)::INT + (u > 0.9196986029286058)::INT + (u > 0.9810118431238462)::INT + (u > 0.9963401531726563)::INT + (u > 0.9994058151824183)::INT AS w FROM d),
m AS (SELECT b, sum(w * v) / sum(w) AS m FROM w GROUP BY b)
SELECT round(avg(m), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""")
def bootstrap_interval(t: Tables) -> DataFrame:
    return R.bootstrap(t.customer, "c_acctbal", "c_custkey", resamples=50).select(*[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@registry.add("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_totalprice DESC, o_orderkey) AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY o_custkey")
def limited_lists(t: Tables) -> DataFrame:
    return R.limited_lists(t.orders, "o_custkey", "o_orderkey", "o_totalprice", 3)


@registry.add("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) + 0.5 - CAST(z[2] AS DOUBLE)))), 6) AS distance, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_scores(t: Tables) -> DataFrame:
    a, b = t.embeddings.select("vec_id", C("embedding").alias("x")), t.embeddings.select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("y"))
    half = F.transform("x", lambda _: F.lit(0.5))
    return a.join(b, "vec_id").select("vec_id", F.round(R.translation_score(C("x"), half, C("y")), 6).alias("distance"), F.round(R.cosine(C("x"), C("y")), 6).alias("cosine"))


@registry.add("SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CAST(a.before AS DOUBLE) AS before, CAST(b.after AS DOUBLE) AS after, CAST(b.after - a.before AS DOUBLE) AS delta FROM (SELECT o_custkey, count(*) AS before FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS after FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.o_custkey = b.o_custkey")
def metric_delta(t: Tables) -> DataFrame:
    def n(s: str) -> DataFrame:
        return t.orders.where(C("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"))

    return R.metric_delta(n("F"), n("O"), "o_custkey", "n")


@registry.add("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def ordered_turns(t: Tables) -> DataFrame:
    own = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return own.select("conv_id", "turns", F.array_join(C("l.role"), ">").alias("roles"))
