"""Readers, sinks, contracts, registries and streams over files that Spark writes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone import schemas
from lodestone.functions import registry as R, scalars as S
from lodestone.plans.base import Registry, Tables
from lodestone.plans.graph_queries import edges
from lodestone.shared import Scratch
from lodestone.sources import readers, sinks
from lodestone.sources.networks import dataset_sizes, gene_crosswalk, scored_network
from lodestone.streaming import incremental
from lodestone.streaming.committed import Committed, once, run_batches

registry = Registry()
C = F.col


def _folder(t: Tables, name: str) -> str:
    return Scratch(t.spark, name).folder("files")


# -- readers ----------------------------------------------------------------------


@registry.add("SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 11 > 0")
def tsv_scan(t: Tables) -> DataFrame:
    """Gzip files, tabs, a BOM before the header, placeholders for nulls; every eleventh price isn't a number, and its row is rejected."""
    folder, k = _folder(t, "tsv"), C("o_orderkey")
    price = F.when(k % 11 == 0, "dear").when(k % 5 == 0, "n/a").otherwise(C("o_totalprice").cast("string"))
    own = t.orders.select(k.cast("string").alias("﻿o_orderkey"), F.when(k % 7 == 0, "NULL").otherwise(C("o_orderstatus")).alias("status"), price.alias("price"))
    own.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(folder)
    return readers.typed_csv(t.spark, folder, "o_orderkey long, status string, price double", sep="\t")[0]


@registry.add("SELECT o_orderkey || '	' || coalesce(CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END, '') || '	dear' AS record FROM orders WHERE o_orderkey % 11 = 0")
def tsv_rejects(t: Tables) -> DataFrame:
    folder, k = _folder(t, "tsv"), C("o_orderkey")
    own = t.orders.select(k, F.when(k % 7 == 0, "NULL").otherwise(C("o_orderstatus")).alias("status"), F.when(k % 11 == 0, "dear").otherwise("1.5").alias("price"))
    own.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(folder)
    return readers.typed_csv(t.spark, folder, "o_orderkey long, status string, price double", sep="\t")[1].select(C("_corrupt").alias("record"))


@registry.add("SELECT '9606.P' || l_partkey AS protein1, '9606.P' || l_suppkey AS protein2, CASE WHEN l_linenumber > 1 THEN '' || l_linenumber * 100 END AS combined_score FROM lineitem")
def spaced_scan(t: Tables) -> DataFrame:
    """Gzip files parted by runs of spaces; the first line of each order lacks its score."""
    folder = _folder(t, "spaced")
    line = F.concat(F.lit("9606.P"), C("l_partkey").cast("string"), F.lit("   9606.P"), C("l_suppkey").cast("string"), F.when(C("l_linenumber") > 1, F.concat(F.lit(" "), (C("l_linenumber") * 100).cast("string"))).otherwise(""))
    t.lineitem.select(line.alias("value")).unionByName(t.spark.range(1).select(F.lit("protein1 protein2 combined_score").alias("value"))).write.option("compression", "gzip").text(folder)
    return readers.spaced_table(t.spark, folder, ["protein1", "protein2", "combined_score"])


@registry.add("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 9 > 0")
def commented_scan(t: Tables) -> DataFrame:
    """Tabs, and lines that are comments; blank fields are null."""
    folder, k = _folder(t, "commented"), C("c_custkey")
    line = F.concat(F.when(k % 9 == 0, "# ").otherwise(""), k.cast("string"), F.lit("\t"), F.when(k % 4 == 0, " ").otherwise(C("c_mktsegment")))
    t.customer.select(line.alias("value")).write.text(folder)
    return readers.commented_tsv(t.spark, folder, ["id", "segment"])


@registry.add("""
SELECT 'P' || p_partkey || '_HUMAN' AS id, 'A' || p_partkey || '|B' || p_size AS accessions, CASE WHEN p_partkey % 3 > 0 THEN 'G' || p_size END AS gene, 'Homo sapiens' AS organism, 9606::BIGINT AS taxon, p_type || 'X' AS sequence FROM part""")
def flat_scan(t: Tables) -> DataFrame:
    """Records of coded lines, each of several lines."""
    folder, k = _folder(t, "flat"), C("p_partkey").cast("string")
    gene = F.when(C("p_partkey") % 3 > 0, F.concat(F.lit("GN   Name=G"), C("p_size").cast("string"), F.lit("; Synonyms=Z;\n"))).otherwise("")
    record = F.concat(F.lit("ID   P"), k, F.lit("_HUMAN  Reviewed;\nAC   A"), k, F.lit(";\nAC   B"), C("p_size").cast("string"), F.lit(";\n"), gene, F.lit("OS   Homo sapiens (Human).\nOX   NCBI_TaxID=9606;\nSQ   SEQUENCE   4 AA;\n     "), C("p_type"), F.lit(" X\n//"))
    t.part.select(record.alias("value")).write.text(folder)
    return readers.flat_records(t.spark, folder)


@registry.add("SELECT 'GSM' || l_suppkey AS sample_id, CASE WHEN l_suppkey % 2 = 0 THEN 'supplier ' || l_suppkey END AS title, 'p' || l_partkey AS id_ref, CASE WHEN l_linenumber < 5 THEN l_quantity END AS value FROM lineitem")
def soft_scan(t: Tables) -> DataFrame:
    """A sample with a table for each supplier; values of some lines aren't numbers."""
    folder, s = _folder(t, "soft"), C("l_suppkey")
    row = F.concat(F.lit("p"), C("l_partkey").cast("string"), F.lit("\t"), F.when(C("l_linenumber") < 5, C("l_quantity").cast("string")).otherwise("null"))
    own = t.lineitem.groupBy("l_suppkey").agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    text = F.concat(F.lit("^SAMPLE = GSM"), s.cast("string"), F.lit("\n"), F.when(s % 2 == 0, F.concat(F.lit("!Sample_title = supplier "), s.cast("string"), F.lit("\n"))).otherwise(""), F.lit("!sample_table_begin\nID_REF\tVALUE\n"), C("rows"), F.lit("\n!sample_table_end"))
    own.select(text.alias("value")).write.text(folder)
    return readers.soft_samples(t.spark, folder)


@registry.add("SELECT count(*) AS files, CAST((SELECT count(*) FROM region) AS BIGINT) AS rows FROM range(1)")
def newest_file(t: Tables) -> DataFrame:
    """The last of three files by time of change, read."""
    folder = _folder(t, "newest")
    for k in range(3):
        t.region.where(C("r_regionkey") >= 2 - k if k < 2 else F.lit(True)).coalesce(1).write.mode("append").option("header", True).csv(folder)
    newest = readers.latest_file(t.spark, folder, "*.csv")
    path = newest.first()["path"]
    return newest.agg(F.count("*").alias("files")).join(t.spark.read.option("header", True).csv(path).agg(F.count("*").alias("rows")))


# -- sinks ---------------------------------------------------------------------------


@registry.add("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def partitioned_sink(t: Tables) -> DataFrame:
    """A table in folders by a column, of which a filter reads one."""
    folder, own = _folder(t, "parquet"), t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    sinks.write_parquet(own, folder, by=["l_returnflag"], files=4)
    return t.spark.read.schema(own.schema).parquet(folder).where("l_returnflag = 'R'")


@registry.add("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority) END, o_orderstatus) AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upserted_files(t: Tables) -> DataFrame:
    """Files upserted to new files."""
    folder, k = _folder(t, "upserted"), C("o_orderkey")
    sinks.write_parquet(t.orders.where(k % 2 == 0).select(k, C("o_orderstatus").alias("status")), f"{folder}/old")
    changes = t.orders.where(k % 3 == 0).select(k, F.upper("o_orderpriority").alias("status"), F.lit(2).alias("v"))
    return sinks.write_upsert(f"{folder}/old", f"{folder}/new", changes.unionByName(changes.withColumns({"v": F.lit(1), "status": F.lit("older")})), ["o_orderkey"], C("v"))


@registry.add("SELECT json_extract_string(row, '$.o_orderkey')::BIGINT AS o_orderkey, reason FROM (SELECT to_json({o_orderkey: o_orderkey}) AS row, array_to_string(list_filter([CASE WHEN o_totalprice <= 50000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END], lambda x: x IS NOT NULL), ',') AS reason FROM orders) WHERE reason <> ''")
def rejected_files(t: Tables) -> DataFrame:
    """Rows that break a rule as JSON texts in a folder of their own, read again."""
    folder = _folder(t, "rejected")
    sinks.write_with_rejects(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), {"price": C("o_totalprice") > 50000, "status": C("o_orderstatus") != "P"}, f"{folder}/good", f"{folder}/bad")
    bad = t.spark.read.schema("row string, reason string").json(f"{folder}/bad")
    return bad.select(F.get_json_object("row", "$.o_orderkey").cast("long").alias("o_orderkey"), "reason")


@registry.add("SELECT 'COMPLETE' AS event, kind, name, (SELECT count(*) FROM orders) AS rows FROM (VALUES ('input', 'orders'), ('input', 'customer'), ('output', 'sales')) v(kind, name)")
def lineage_events(t: Tables) -> DataFrame:
    """The lineage of a join's run, written as JSON and taken apart."""
    folder = _folder(t, "lineage")
    out = t.orders.join(t.customer, C("o_custkey") == C("c_custkey"), "left").agg(F.count("*").alias("rows"))
    event = sinks.lineage("sales", ["orders", "customer"], ["sales"])
    text = t.spark.createDataFrame([(event["eventType"], [x["name"] for x in event["inputs"]], [x["name"] for x in event["outputs"]])], "event string, inputs array<string>, outputs array<string>")
    text.write.json(folder)
    read = t.spark.read.schema(text.schema).json(folder)
    named = read.select("event", F.lit("input").alias("kind"), F.explode("inputs").alias("name")).unionByName(read.select("event", F.lit("output").alias("kind"), F.explode("outputs").alias("name")))
    return named.join(out)


# -- contracts and registries -----------------------------------------------------------


@registry.add("""
SELECT * FROM (SELECT 'null:gene_symbol' AS rule, count(*) FILTER (p_size % 10 = 0) AS broken FROM part UNION ALL SELECT 'null:disease_id', count(*) FILTER (p_size % 7 = 0) FROM part UNION ALL SELECT 'type:score', 1 UNION ALL SELECT 'any_of:gene_id|ncbi_gene_id', 1) WHERE broken > 0""")
def contract_faults(t: Tables) -> DataFrame:
    size = C("p_size")
    own = t.part.select(F.when(size % 10 > 0, C("p_brand")).alias("gene_symbol"), F.when(size % 7 > 0, C("p_type")).alias("disease_id"), size.cast("string").alias("score"))
    return schemas.violations(own, schemas.CONTRACTS["disgenet_gda"])


@registry.add("SELECT upper(trim(c_mktsegment)) AS segment, c_custkey, round(c_acctbal, 0) AS balance, 'names,rounded' AS ran FROM customer WHERE c_acctbal >= 0")
def registered_steps(t: Tables) -> DataFrame:
    """Cleaning steps by name, one of them passed over, with a hook before and one after each."""
    steps, ran = R.Cleaning(), []
    steps.register("names")(lambda df: df.withColumn("segment", F.upper(F.trim("segment"))))
    steps.register("doubled")(lambda df: df.withColumn("balance", C("balance") * 2))
    steps.register("rounded")(lambda df: df.withColumn("balance", F.round("balance", 0)))
    steps.before.append(lambda name, df: df.where("balance >= 0"))
    steps.after.append(lambda name, df: ran.append(name) or df)
    out = steps.run(t.customer.select(C("c_mktsegment").alias("segment"), "c_custkey", C("c_acctbal").alias("balance")), skip=["doubled"])
    return out.withColumn("ran", F.lit(",".join(ran)))


@registry.add("SELECT l_returnflag, avg(l_quantity) AS mean, count(*) AS rows FROM lineitem GROUP BY l_returnflag ORDER BY mean DESC, l_returnflag LIMIT 1")
def registered_metrics(t: Tables) -> DataFrame:
    metrics = R.Metrics()
    metrics.register("mean")(lambda: F.avg("l_quantity"))
    metrics.register("rows", higher_is_better=False)(lambda: F.count("*"))
    return metrics.best(metrics.evaluate(t.lineitem, ["l_returnflag"]), "l_returnflag", "mean")


@registry.add("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS label, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM orders WHERE o_orderstatus IN ('F', 'O')")
def registered_labels(t: Tables) -> DataFrame:
    labels, methods = R.Labels(), R.Methods()
    for name, label, sure in (("F", "done", 1.0), ("O", "open", 0.5)):
        labels.register(name, label)
        methods.register(label, sure)
    return labels.rename(t.orders.select("o_orderkey", C("o_orderstatus").alias("label")), "label").withColumn("confidence", methods.confidence(C("label")))


@registry.add("""
SELECT 'Customer' AS label, count(DISTINCT c_custkey) AS n FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'edges', count(*) FROM orders""")
def registered_loaders(t: Tables) -> DataFrame:
    """Two sources by name, read from their files, to one graph."""
    loaders = R.Loaders()

    def graph(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        n = df.select("label", "id")
        return n, df.where("target is not null").select("label", "id", "target")

    loaders.register("customers", lambda spark, path: spark.read.parquet(path).select(F.lit("Customer").alias("label"), C("c_custkey").alias("id"), F.lit(None).cast("long").alias("target")), graph)
    loaders.register("orders", lambda spark, path: spark.read.parquet(path).select(F.lit("Order").alias("label"), C("o_orderkey").alias("id"), C("o_custkey").alias("target")), graph)
    n, e = loaders.load(t.spark, {"customers": f"{t.folder}/customer.parquet", "orders": f"{t.folder}/orders.parquet"})
    return n.groupBy("label").agg(F.countDistinct("id").alias("n")).unionByName(e.agg(F.count("*").alias("n")).select(F.lit("edges").alias("label"), "n"))


@registry.add("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'known' WHEN c_custkey % 3 = 1 THEN reverse(c_name) END AS key FROM customer")
def converted_names(t: Tables) -> DataFrame:
    """An injected converter fills keys that aren't known; where it fails they stay null."""
    def convert(text: str) -> str | None:
        if int(text.rpartition("#")[2]) % 3 == 2:
            raise ValueError(text)
        return text[::-1]

    k = C("c_custkey")
    own = t.customer.select("c_custkey", F.concat("c_name", F.lit("#"), k.cast("string")).alias("name"), "c_name", F.when(k % 3 == 0, "known").alias("key"))
    own = R.converted(own, "name", "key", convert)
    return own.select("c_custkey", F.when(C("key") == "known", C("key")).otherwise(F.regexp_replace("key", "^[0-9]+#", "")).alias("key"))


@registry.add("SELECT o_orderstatus, count(*) AS n FROM orders WHERE regexp_matches(o_orderpriority, '^[12]') GROUP BY o_orderstatus")
def read_only_queries(t: Tables) -> DataFrame:
    """A user's query with a pattern, through the door that only lets reading queries in."""
    t.orders.createOrReplaceTempView("lodestone_orders")
    return R.read_only_sql(t.spark, "SELECT o_orderstatus, count(*) AS n FROM lodestone_orders WHERE o_orderpriority rlike '^[12]' GROUP BY o_orderstatus")


# -- streams ---------------------------------------------------------------------------------


@registry.add("SELECT l_suppkey, max(l_discount) AS l_discount, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY l_suppkey")
def streamed_groups(t: Tables) -> DataFrame:
    """Groups kept up to date over a stream of files, whose state Spark keeps; the last state of each is read from what the stream wrote."""
    folder = _folder(t, "groups")
    own = t.lineitem.select("l_suppkey", "l_discount", C("l_linenumber").cast("long").alias("l_linenumber"))
    own.repartition(3).write.parquet(f"{folder}/in")
    tables = Committed(t.spark, f"{folder}/out")
    stream = incremental.merged_stream(incremental.stream_parquet(t.spark, f"{folder}/in", own.schema), ["l_suppkey"], "l_discount", "l_linenumber")
    work = once(tables, lambda batch, number: tables.write(batch.withColumn("batch", F.lit(number)), "groups", number))
    query = stream.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = tables.read("groups", "l_suppkey bigint, l_discount double, l_linenumber bigint, batch int")
    return rows.groupBy("l_suppkey").agg(*[F.max_by(c, "batch").alias(c) for c in ("l_discount", "l_linenumber")])


@registry.add("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def streamed_parts(t: Tables) -> DataFrame:
    """A table taken by a stream file by file, each counted once; the parts' counts added up."""
    folder = _folder(t, "parts")
    own = t.events.select("event_type", "ts")
    own.repartition(4).write.parquet(f"{folder}/in")
    tables = Committed(t.spark, f"{folder}/out")
    work = once(tables, lambda batch, number: tables.write(batch.groupBy("event_type", F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("n")), "counts", number))
    run_batches(incremental.stream_parquet(t.spark, f"{folder}/in", own.schema), work, f"{folder}/checkpoint")
    return tables.read("counts", "event_type string, start timestamp, n bigint").groupBy("event_type", "start").agg(F.sum("n").alias("n"))


# -- networks, crosswalks, sizes, bulk loads ---------------------------------------------------

_PAIRS = """
p AS (SELECT CASE WHEN l_partkey % 9 > 0 THEN '9606.P' ELSE '10090.P' END || l_partkey % 50 AS a, CASE WHEN l_suppkey % 8 > 0 THEN '9606.P' ELSE '7.P' END || l_suppkey % 50 AS b,
             CASE WHEN l_linenumber = 7 THEN 'high' ELSE '' || CAST(floor(l_extendedprice / 60) AS BIGINT) END AS score FROM lineitem),
r AS (SELECT *, CASE WHEN NOT coalesce(try_cast(score AS INTEGER) BETWEEN 0 AND 1000, false) THEN 'score' WHEN NOT (a LIKE '9606.%' AND b LIKE '9606.%') THEN 'organism' WHEN a = b THEN 'itself' END AS reason FROM p)"""


def _network(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = F.concat(F.when(C("l_partkey") % 9 > 0, "9606.P").otherwise("10090.P"), (C("l_partkey") % 50).cast("string"))
    b = F.concat(F.when(C("l_suppkey") % 8 > 0, " 9606.P").otherwise("7.P"), (C("l_suppkey") % 50).cast("string"))
    score = F.when(C("l_linenumber") == 7, "high").otherwise(F.floor(C("l_extendedprice") / 60).cast("string"))
    folder = _folder(t, "network")
    line = F.concat_ws("\t", a, b, score)
    t.lineitem.select(line.alias("value")).write.option("compression", "gzip").text(folder)
    return scored_network(readers.commented_tsv(t.spark, folder, ["a", "b", "score"]), "a", "b", "score", organism="9606")


@registry.add(f"WITH {_PAIRS} SELECT least(a, b) AS protein_a, greatest(a, b) AS protein_b, max(score::INTEGER) AS score, count(*) AS n FROM r WHERE reason IS NULL GROUP BY ALL")
def network_scan(t: Tables) -> DataFrame:
    return _network(t)[0]


@registry.add(f"WITH {_PAIRS} SELECT a, b, score, reason FROM r WHERE reason IS NOT NULL")
def network_rejects(t: Tables) -> DataFrame:
    return _network(t)[1]


@registry.add("""
WITH x AS (SELECT upper(p_brand || p_size) AS symbol, CASE WHEN p_partkey % 3 > 0 THEN '' || p_partkey END AS ncbi_gene_id, CASE WHEN p_partkey % 4 > 0 THEN 'Q' || p_partkey END AS uniprot_id, CASE WHEN p_partkey % 5 > 0 THEN '' || p_size END AS gene_mim FROM part)
SELECT symbol, ncbi_gene_id, uniprot_id, gene_mim FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY (ncbi_gene_id IS NULL)::INT + (uniprot_id IS NULL)::INT + (gene_mim IS NULL)::INT, ncbi_gene_id NULLS FIRST, uniprot_id NULLS FIRST, gene_mim NULLS FIRST) AS i FROM x) WHERE i = 1""")
def gene_crosswalk_scan(t: Tables) -> DataFrame:
    folder, k = _folder(t, "crosswalk"), C("p_partkey")
    own = t.part.select(
        F.concat(F.lit(" "), F.lower("p_brand"), C("p_size").cast("string")).alias("Approved symbol"), F.when(k % 3 > 0, k.cast("string")).alias("entrez_id"),
        F.when(k % 4 > 0, F.concat(F.lit("Q"), k.cast("string"), F.lit("|A1|B2"))).alias("uniprot_ids"), F.when(k % 5 > 0, F.concat(C("p_size").cast("string"), F.lit(", 7"))).alias("omim_id"),
    )
    own.write.option("header", True).option("sep", "\t").csv(folder)
    return gene_crosswalk(t.spark.read.option("header", True).option("sep", "\t").csv(folder))


@registry.add("""
SELECT 'labels' AS dataset, count(*) AS rows, 3 AS columns, count(*) FILTER (doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL) AS complete FROM labels
UNION ALL SELECT 'nation', count(*), 3, count(*) FILTER (n_nationkey IS NOT NULL AND n_name IS NOT NULL AND n_regionkey IS NOT NULL) FROM nation
UNION ALL SELECT 'orders', count(*), 6, count(*) FILTER (o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL) FROM orders""")
def data_set_sizes(t: Tables) -> DataFrame:
    return dataset_sizes({n: getattr(t, n) for n in ("orders", "nation", "labels")})


@registry.add("SELECT 'Order' AS src_label, 'contains' AS rel, 'Part' AS dst_label, l_orderkey AS src_id, l_partkey AS dst_id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def bulk_loaded_edges(t: Tables) -> DataFrame:
    """Edges in folders by their kind, of which a reader of one kind reads one."""
    folder, own = _folder(t, "bulk"), edges(t)
    sinks.write_parquet(own, folder, by=["src_label", "rel", "dst_label"])
    kept = t.spark.read.schema(own.schema).parquet(folder).where("src_label = 'Order' and rel = 'contains' and dst_label = 'Part'")
    return kept.select("src_label", "rel", "dst_label", "src_id", "dst_id")


@registry.add("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber < 6 THEN l_discount END AS score, CASE l_returnflag WHEN 'N' THEN 'CURATED' WHEN 'R' THEN 'BEFREE' ELSE 'NEW' END AS source,
                  CASE WHEN l_linenumber % 3 > 0 THEN 2000 + l_partkey % 20 END AS year,
                  list_sort(list_distinct(list_filter([l_partkey % 13 * k FOR k IN range(0, l_quantity::BIGINT % 15)], lambda v: v IS NOT NULL))) AS ids FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, len(ids)::INT AS papers, CASE WHEN len(ids) >= 10 AND coalesce(year >= 2010, true) THEN 'robust' WHEN len(ids) >= 3 THEN 'moderate' WHEN len(ids) >= 1 THEN 'limited' ELSE 'unsupported' END AS strength,
       round(score * CASE source WHEN 'CURATED' THEN 1.0 WHEN 'BEFREE' THEN 0.5 ELSE 0.3 END::DOUBLE, 9) AS normalised FROM x""")
def normalised_evidence(t: Tables) -> DataFrame:
    """Papers in a text with blanks, repeats and words; strength by their number and year; scores by the weight of their source."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.when(k < C("l_quantity").cast("long") % 15, (C("l_partkey") % 13 * k).cast("string")))
    text = F.concat(F.lit("; pmid;"), F.array_join(numbers, " ; "), F.lit(";;-4"))
    source = F.when(C("l_returnflag") == "N", "CURATED").when(C("l_returnflag") == "R", "BEFREE").otherwise("NEW")
    papers = F.size(S.paper_ids(text))
    year = F.when(C("l_linenumber") % 3 > 0, 2000 + C("l_partkey") % 20)
    normal = S.source_weighted(F.when(C("l_linenumber") < 6, C("l_discount")), source, {"CURATED": 1.0, "BEFREE": 0.5})
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", papers.alias("papers"), S.evidence_strength(papers, year).alias("strength"), F.round(normal, 9).alias("normalised"))
