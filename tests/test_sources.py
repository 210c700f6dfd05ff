"""Readers, sinks, contracts and streams on small files."""

import gzip
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import joins as J
from lodestone.operators.components import connected_components
from lodestone.sources import readers, sinks
from lodestone.streaming import incremental


def write(path, text, zipped=False):
    (gzip.open(path, "wt", encoding="utf-8") if zipped else open(path, "w", encoding="utf-8")).write(text)
    return str(path)


def test_typed_csv(spark, tmp_path):
    p = write(tmp_path / "a.tsv.gz", "id\tname\tscore\n1\tx\t0.5\n2\tN/A\t\nz\ty\t1\n", True)
    good, bad = readers.typed_csv(spark, p, "id int, name string, score double", sep="\t")
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, "x", 0.5), (2, None, None)]
    assert good.where("id is null").count() == 0 and bad.count() == 1


def test_text_tables(spark, tmp_path):
    p = write(tmp_path / "links.txt.gz", "protein1 protein2 combined_score\n9606.A  9606.B 900\n9606.A 9606.C\n\n", True)
    rows = readers.spaced_table(spark, p, ["protein1", "protein2", "combined_score"]).collect()
    assert sorted(map(tuple, rows), key=str) == [("9606.A", "9606.B", "900"), ("9606.A", "9606.C", None)]
    p = write(tmp_path / "morbid.txt", "# comment\nAbc, 123456 (3)\tGENE\t\n")
    (row,) = readers.phenotypes(readers.commented_tsv(spark, p, ["phenotype", "gene", "more"]), "phenotype").collect()
    assert (row["name"], row["mim"], row["mapping_key"], row["more"]) == ("Abc", "123456", 3, None)


def test_json_xml(spark, tmp_path):
    p = write(tmp_path / "x.jsonl.gz", '{"id": 1, "t": "a"}\n{"id": \n{"id": 2}\n', True)
    good, bad = readers.json_lines(spark, p, "id long, t string")
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (2, None)] and bad.count() == 1
    p = write(tmp_path / "d.xml", "<drugs><drug><name>A</name><target><id>1</id></target><target><id>2</id></target></drug><drug><name>B</name></drug></drugs>")
    rows = readers.xml_rows(spark, p, "drug", "name string, target array<struct<id: long>>").select("name", F.size(F.coalesce("target", F.array())).alias("n")).collect()
    assert sorted(map(tuple, rows)) == [("A", 2), ("B", 0)]


def test_record_formats(spark, tmp_path):
    p = write(tmp_path / "u.dat", "ID   P1_HUMAN  Reviewed;\nAC   P11111; Q22222;\nAC   A33333;\nGN   Name=ABC1; Synonyms=X;\nOS   Homo sapiens (Human).\nOX   NCBI_TaxID=9606;\nSQ   SEQUENCE   4 AA;\n     MK VL\n//\nID   P2_HUMAN\nAC   B1;\n//\n")
    rows = {r["id"]: r for r in readers.flat_records(spark, p).collect()}
    assert (rows["P1_HUMAN"]["accessions"], rows["P1_HUMAN"]["gene"], rows["P1_HUMAN"]["taxon"], rows["P1_HUMAN"]["sequence"]) == ("P11111|Q22222|A33333", "ABC1", 9606, "MKVL")
    assert rows["P2_HUMAN"]["gene"] is None
    p = write(tmp_path / "g.soft", "^SAMPLE = GSM1\n!Sample_title = liver\n!sample_table_begin\nID_REF\tVALUE\np1\t1.5\np2\tnull\n!sample_table_end\n^SAMPLE = GSM2\n!sample_table_begin\nVALUE\tID_REF\n2\tp1\n!sample_table_end\n")
    assert sorted((r["sample_id"], r["title"], r["id_ref"], r["value"]) for r in readers.soft_samples(spark, p).collect()) == [("GSM1", "liver", "p1", 1.5), ("GSM1", "liver", "p2", None), ("GSM2", None, "p1", 2.0)]


def test_sqlite_and_latest(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("create table t (a int, b text)")
        db.executemany("insert into t values (?, ?)", [(i, f"n{i}") for i in range(25)])
    assert readers.sqlite_table(spark, str(tmp_path / "a.db"), "select a, b from t where a % 2 = 0", "a long, b string", batch=4).count() == 13
    write(tmp_path / "top_1.csv", "x")
    write(tmp_path / "top_2.csv", "yy")
    import os

    os.utime(tmp_path / "top_1.csv", (2_000_000_000, 2_000_000_000))
    assert readers.latest_file(spark, str(tmp_path), "top_*.csv").first()["path"].endswith("top_1.csv")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b'"), (1, "a"), (3, None)], "id long, name string")
    d = sinks.write_csv_with_digest(df, str(tmp_path / "csv"), ["id"]).first()
    assert d["rows"] == 3 and d["digest"] == sinks.digest(df.repartition(3)).first()["digest"] == spark.read.json(str(tmp_path / "csv_digest")).first()["digest"]
    sinks.write_parquet(df, str(tmp_path / "t"))
    new = sinks.write_upsert(str(tmp_path / "t"), str(tmp_path / "t2"), spark.createDataFrame([(3, "c", 1), (3, "cc", 2), (4, "d", 1)], "id long, name string, v int"), ["id"], F.col("v"))
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "b'"), (3, "cc"), (4, "d")]
    sinks.write_with_rejects(df, {"named": F.col("name").isNotNull()}, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2
    assert spark.read.json(str(tmp_path / "bad")).first()["reason"] == "named"
    assert "b\\'" in sinks.cypher_statements(df.where("id = 2").withColumn("label", F.lit("X")), ["name"]).first()[0]
    assert sinks.lineage("j", ["a"], ["b"])["outputs"][0]["name"] == "b"


def test_contracts(spark):
    df = spark.createDataFrame([("CHEMBL1", None), (None, "K")], "chembl_id string, inchikey string")
    assert {(r["rule"], r["broken"]) for r in schemas.violations(df, schemas.CONTRACTS["chembl_drugs"]).collect()} == {("null:chembl_id", 1), ("null:inchikey", 1)}
    rules = {r["rule"] for r in schemas.violations(df.limit(0).select("chembl_id"), schemas.CONTRACTS["drugs"]).collect()}
    assert rules == {"missing:name", "missing:inchikey"}
    assert {r["rule"] for r in schemas.violations(df.select(F.lit("x").alias("gene_symbol")).limit(0), schemas.CONTRACTS["uniprot_proteins"]).collect()} == {"any_of:uniprot_ac|accession|uniprot_id", "rows"}


def test_streams(spark, tmp_path):
    df = spark.range(0, 60).selectExpr("id % 7 as k", "id / 60.0 as c", "1 as n")
    for i in range(3):
        df.where(f"k % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.merged_stream(incremental.stream_parquet(spark, str(tmp_path / "in"), df.schema), ["k"], "c", "n")
    got = incremental.run_to_table(stream, "merged_edges", str(tmp_path / "ck"))
    want = incremental.merged_stream(df, ["k"], "c", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_components_and_empty(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert connected_components(e.limit(0)).count() == 0


def test_crosswalk_clash(spark):
    a, b = (spark.createDataFrame([(1, v)], "k long, v string") for v in "xy")
    assert sorted(r["v"] for r in J.merged_crosswalks(a, b, "k", "v", "keep_both").collect()) == ["x", "y"]
    assert J.merged_crosswalks(a, b, "k", "v", "keep_other").first()["v"] == "y"
    with pytest.raises(Exception, match="disagree"):
        J.merged_crosswalks(a, b, "k", "v", "error").collect()


def test_networks_and_crosswalks(spark):
    from lodestone.sources import networks

    rows = [("9606.B", " 9606.A", "700"), ("9606.A", "9606.B", "900"), ("9606.A", "9606.A", "5"), ("7.A", "9606.A", "5"), (None, "9606.A", "5"), ("9606.A", "9606.C", "1001"), ("9606.A", "9606.C", "x"), ("9606.A", "9606.C", None)]
    good, bad = networks.scored_network(spark.createDataFrame(rows, "x string, y string, s string"), "x", "y", "s", organism="9606")
    assert [tuple(r) for r in good.collect()] == [("9606.A", "9606.B", 900, 2)]
    assert sorted(r["reason"] for r in bad.collect()) == ["itself", "organism", "organism", "score", "score", "score"]
    genes = spark.createDataFrame([("abc", "1", "Q1|Q2"), ("ABC ", None, "Q0"), (None, "2", "Q3"), (" ", "2", "Q3")], "`Approved symbol` string, entrez_id string, uniprot_ids string")
    assert [tuple(r) for r in networks.gene_crosswalk(genes).collect()] == [("ABC", "1", "Q1", None)]
    with pytest.raises(ValueError, match="symbol"):
        networks.gene_crosswalk(genes.drop("Approved symbol"))
    sizes = networks.dataset_sizes({"b": genes, "a": genes.limit(0)})
    assert [tuple(r) for r in sizes.collect()] == [("a", 0, 3, 0), ("b", 4, 3, 2)]
