"""Scalar rules, predicates and splits on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import scalars as S
from lodestone.plans.base import Registry, Tables

registry = Registry()
C = F.col


@registry.add("SELECT n_nationkey, CASE WHEN NOT (lower(trim(CASE WHEN n_nationkey % 3 = 0 THEN ' N/A ' ELSE n_name END)) IN ('', '-', 'n/a', 'na', 'nan', 'none', 'null', 'unknown')) THEN n_name END AS name FROM nation")
def nullish_values(t: Tables) -> DataFrame:
    raw = F.when(C("n_nationkey") % 3 == 0, " N/A ").otherwise(C("n_name"))
    return t.nation.select("n_nationkey", S.nullish_to_null(raw).alias("name"))


@registry.add("SELECT c_custkey, substr(coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END, 'unspecified'), 1, 6) AS segment FROM customer")
def filled_defaults(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.fill_null(F.when(C("c_custkey") % 4 != 0, C("c_mktsegment")), "unspecified", 6).alias("segment"))


@registry.add("SELECT p_partkey, upper(substr(translate(md5(p_name), '0123456789', 'ghijklmnop'), 1, 14)) || '-' || upper(substr(translate(md5(p_name), '0123456789', 'ghijklmnop'), 15, 10)) || '-' || upper(substr(translate(md5(p_name), '0123456789', 'ghijklmnop'), 25, 1)) AS k FROM part")
def structure_keys(t: Tables) -> DataFrame:
    letters = F.translate(F.md5(C("p_name").cast("binary")), "0123456789", "ghijklmnop")
    return t.part.select("p_partkey", S.inchikey(F.concat(F.lit("  "), F.substring(letters, 1, 25))).alias("k"))


@registry.add("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'P' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 5, '0') END AS accession FROM supplier")
def accessions(t: Tables) -> DataFrame:
    raw = F.when(C("s_suppkey") % 2 == 0, F.concat(F.lit(" p"), F.lpad((C("s_suppkey") % 10000).cast("string"), 5, "0"), F.lit("-2"))).otherwise(F.lit("bad id"))
    return t.supplier.select("s_suppkey", S.uniprot(raw).alias("accession"))


@registry.add("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9/-]+', ' ', 'g'), '-+', '-', 'g'), ' +', ' ', 'g')) AS name FROM part")
def normal_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.normal_name(F.concat("p_name", F.lit(" & "), "p_brand")).alias("name"))


@registry.add("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'OMIM:' || (100000 + n_nationkey) WHEN 1 THEN 'DOID:' || n_nationkey ELSE 'C' || lpad(CAST(n_nationkey AS VARCHAR), 7, '0') END AS disease FROM nation")
def disease_ids(t: Tables) -> DataFrame:
    n = C("n_nationkey")
    raw = F.when(n % 3 == 0, F.concat(F.lit("mim:"), (n + 100000).cast("string"))).when(n % 3 == 1, F.concat(F.lit(" doid_"), n.cast("string"))).otherwise(F.concat(F.lit("c"), F.lpad(n.cast("string"), 7, "0")))
    return t.nation.select("n_nationkey", S.disease_id(raw).alias("disease"))


@registry.add("SELECT p_partkey, p_partkey + 1 AS cid FROM part")
def compound_numbers(t: Tables) -> DataFrame:
    raw = F.concat(F.when(C("p_partkey") % 2 == 0, "CIDm").otherwise("CIDs"), F.lpad((C("p_partkey") + 1).cast("string"), 8, "0"))
    return t.part.select("p_partkey", S.stitch_cid(raw).alias("cid"))


@registry.add("SELECT p_partkey, 'C' || (p_size + 1) || 'H' || (p_size + 2) || 'N2O' AS formula FROM part")
def hill_formulas(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("NON"), F.lit("H"), (C("p_size") + 2).cast("string"), F.lit("C"), (C("p_size") + 1).cast("string"))
    return t.part.select("p_partkey", S.hill_formula(raw).alias("formula"))


@registry.add("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS priority FROM orders")
def fuzzy_choices(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.fuzzy_choice(F.regexp_replace("o_orderpriority", "^[0-9]-", ""), ["urgent", "high", "medium", "low"], most=1).alias("priority"))


@registry.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       round(least(CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_quantity BETWEEN 0 AND 14 THEN pow(10.0, 9 - l_quantity) END WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity * 1000.0 ELSE l_quantity * 1000000.0 END, 1e9), 6) AS nm
FROM lineitem""")
def unit_conversion(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(x) for x in ("p", "nM", "uM", "mM")]), (C("l_linenumber") % 4 + 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(S.to_nanomolar(C("l_quantity"), unit), 6).alias("nm"))


@registry.add("SELECT event_id, round(CASE WHEN event_type = 'view' THEN value ELSE log2(value + 1) END, 9) AS level FROM events")
def log2_levels(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(S.log2_expression(C("value"), F.when(C("event_type") == "view", "log2 ratio").otherwise("counts")), 9).alias("level"))


@registry.add("SELECT doc_id, CAST(nullif(regexp_extract(text, '\\b((19|20)[0-9]{2})\\b', 1), '') AS INTEGER) AS year FROM documents")
def years_in_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.year_of(C("text")).alias("year"))


@registry.add("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '\\b[0-9]{9,16}\\b', '[number]', 'g')) AS masked_md5 FROM documents")
def masked_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(S.masked(C("text")).cast("binary")).alias("masked_md5"))


@registry.add("SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR) || chr(31) || c_name || chr(31) || coalesce(c_mktsegment, '')) AS fingerprint FROM customer")
def row_fingerprints(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.fingerprint(C("c_custkey"), C("c_name"), C("c_mktsegment")).alias("fingerprint"))


@registry.add("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(nullif(trim(o_orderpriority), '')))), '|') AS sources FROM orders GROUP BY o_custkey")
def joined_source_lists(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(S.joined_sources(C("o_orderpriority")).alias("sources"))


@registry.add("SELECT tier, count(*) AS n FROM (SELECT CASE WHEN s < 0.06 THEN 'sub_weak' WHEN s < 0.3 THEN 'weak' WHEN s < 0.5 THEN 'strong' ELSE 'very_strong' END AS tier FROM (SELECT l_quantity / 50.0 AS s FROM lineitem)) GROUP BY tier")
def confidence_tiers(t: Tables) -> DataFrame:
    return t.lineitem.select(S.tier(C("l_quantity") / 50.0).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@registry.add("SELECT grade, count(*) AS n FROM (SELECT CASE WHEN l_discount < 0.02 THEN NULL WHEN l_discount < 0.06 THEN 'weak' ELSE 'standard' END AS grade FROM lineitem) GROUP BY grade")
def weak_evidence(t: Tables) -> DataFrame:
    return t.lineitem.select(S.weak_escape(C("l_discount"), 0.02, 0.06).alias("grade")).groupBy("grade").agg(F.count("*").alias("n"))


@registry.add("SELECT class, count(*) AS n FROM (SELECT CASE WHEN l_tax < 0.01 THEN 'strong' WHEN l_tax < 0.05 THEN 'moderate' WHEN l_quantity >= 40 THEN 'strong' WHEN l_quantity >= 20 THEN 'moderate' ELSE 'weak' END AS class FROM lineitem) GROUP BY class")
def evidence_classes(t: Tables) -> DataFrame:
    return t.lineitem.select(S.evidence_class(C("l_tax"), C("l_quantity"), strong=40, moderate=20).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@registry.add("""
SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 200) THEN 'red' WHEN sum(value) / 100 <= 5 AND count(*) <= 3 THEN 'green' WHEN sum(value) / 100 <= 20 AND count(*) <= 60 AND count(*) / 6.0 <= 10 THEN 'yellow' ELSE 'red' END AS tier
FROM events GROUP BY user_id""")
def safety_tiers(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id").agg((F.sum("value") / 100).alias("w"), F.count("*").alias("n"), F.bool_or((C("event_type") == "error") & (C("value") > 200)).alias("bad"))
    return per.select("user_id", S.safety_tier(C("w"), F.when(C("n") <= 3, C("n")).otherwise(F.greatest(F.lit(3.5), C("n") / 6.0)), C("bad")).alias("tier"))


@registry.add("SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS approved FROM customer")
def approval_tokens(t: Tables) -> DataFrame:
    groups = F.element_at(F.array(F.lit("approved; withdrawn"), F.lit("Illicit|vet"), F.lit("nutraceutical")), (C("c_nationkey") % 3 + 1).cast("int"))
    return t.customer.select("c_custkey", S.approval(groups).alias("approved"))


@registry.add("SELECT p_partkey, round(((p_size / 50.0) * 2.0 + CASE WHEN p_partkey % 5 <> 0 THEN (p_retailprice / 2000.0) * 1.0 ELSE 0 END) / (2.0 + CASE WHEN p_partkey % 5 <> 0 THEN 1.0 ELSE 0 END), 9) AS score FROM part")
def weighted_scores(t: Tables) -> DataFrame:
    price = F.when(C("p_partkey") % 5 != 0, C("p_retailprice") / 2000.0)
    return t.part.select("p_partkey", F.round(S.weighted_mean([(C("p_size") / 50.0, 2.0), (price, 1.0), (C("p_size") * 0.0, 0.0)]), 9).alias("score"))


@registry.add("SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN 1.0 WHEN p_size <= 30 THEN 1.0 + (p_size - 10) * ((0.4 - 1.0) / 20) WHEN p_size <= 50 THEN 0.4 + (p_size - 30) * ((0.0 - 0.4) / 20) ELSE 0.0 END, 9) AS market, round(0.6 * (p_size / 50.0) + 0.4 * exp(-(p_partkey % 7) / 3.0), 9) AS need FROM part")
def market_scores(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(S.piecewise(C("p_size"), [(10, 1.0), (30, 0.4), (50, 0.0)]), 9).alias("market"), F.round(S.unmet_need(C("p_size") / 50.0, C("p_partkey") % 7, 3.0), 9).alias("need"))


@registry.add("SELECT o_custkey, round(greatest(0.0, least(1.0, 0.3 + least(0.05 * ln(1 + count(*)), 0.2) + least(count(DISTINCT o_orderpriority) * 0.02, 0.1))), 9) AS score FROM orders GROUP BY o_custkey")
def evidence_scores(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("k"))
    return per.select("o_custkey", F.round(S.evidence_score(F.lit(0.3), C("n"), C("k"), paper_weight=0.05, paper_cap=0.2, evidence_weight=0.02, evidence_cap=0.1), 9).alias("score"))


@registry.add("SELECT l_quantity, round(max(1 + (q * ln(q) + (1 - q) * ln(1 - q)) / ln(2)), 9) AS certainty FROM (SELECT l_quantity, least(1 - 1e-12, greatest(1e-12, l_quantity / 51.0)) AS q FROM lineitem) GROUP BY l_quantity")
def certainties(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_quantity").agg(F.round(F.max(S.certainty(C("l_quantity") / 51.0)), 9).alias("certainty"))


@registry.add("SELECT c_custkey, CASE WHEN s < 0.2 THEN 'test' WHEN s < 0.2 + 0.1 THEN 'validate' ELSE 'train' END AS split FROM (SELECT c_custkey, CAST('0x' || substr(md5('7:' || c_custkey), 1, 8) AS BIGINT) / 4294967296.0 AS s FROM customer)")
def hash_splits(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.hash_split(C("c_custkey"), seed=7, test=0.2, validate=0.1).alias("split"))


@registry.add("SELECT split, count(*) AS n FROM (SELECT CASE WHEN y <= 1996 THEN 'train' WHEN y <= 1998 THEN 'val' ELSE 'test' END AS split FROM (SELECT year(o_orderdate) AS y FROM orders)) GROUP BY split")
def temporal_splits(t: Tables) -> DataFrame:
    return t.orders.select(S.temporal_split(F.year("o_orderdate"), 1998).alias("split")).groupBy("split").agg(F.count("*").alias("n"))


@registry.add("SELECT label, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS label FROM orders) GROUP BY label")
def mapped_labels(t: Tables) -> DataFrame:
    return t.orders.select(S.mapped(C("o_orderstatus"), {"F": "finished", "O": "open"}, "other").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@registry.add("SELECT count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_discount >= 0.03 AND l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 45")
def membership_filters(t: Tables) -> DataFrame:
    kept = t.lineitem.where((C("l_discount") >= 0.03) & C("l_returnflag").isin("A", "R") & C("l_quantity").between(5, 45))
    return kept.agg(F.count("*").alias("n"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"))


@registry.add("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate IS NULL OR o_orderdate >= DATE '2000-01-01' - INTERVAL 36 MONTH GROUP BY o_orderstatus")
def age_filter(t: Tables) -> DataFrame:
    old = F.add_months(F.lit("2000-01-01").cast("date"), -36)
    return t.orders.where(C("o_orderdate").isNull() | (F.to_date("o_orderdate") >= old)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@registry.add("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def exploded_lists(t: Tables) -> DataFrame:
    return t.part.select(F.explode_outer(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@registry.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@registry.add("SELECT doc_id, length(trim(regexp_replace(regexp_replace(trim(regexp_replace(text, '[\\x00-\\x1F\\x7F]+', ' ', 'g')), '^[A-Z ]+:\\s*', ''), ' +', ' ', 'g'))) AS n FROM documents")
def cleaned_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(S.clean_text(C("text"), longest=1 << 30)).cast("long").alias("n"))
