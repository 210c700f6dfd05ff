"""Table loads, protein identity, reports, paged services, graph stores and registries on small tables with nulls, ties, repeats and none."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import registry as R
from lodestone.operators import graph as G, proteins as P, reports as Q, tables as L
from lodestone.sources import graph_store, paged, readers
from tests.test_resolve import ratio


def test_loads(spark):
    table = spark.createDataFrame([("K1", "a", 1.0), ("K2", "b", None)], "inchikey string, name string, weight double")
    batch = spark.createDataFrame([("K2", "bb", 2.0), ("K3", " ", 1.0), (None, "x", 1.0), ("K1", "z", None), ("K1", "z", None), ("K4", None, 1.0)], table.schema)
    after, bad = L.loaded(table, batch, L.RULES["drugs"])
    assert sorted(map(tuple, after.collect())) == [("K1", "z", None), ("K2", "bb", 2.0)]
    assert sorted(r["reason"] for r in bad.collect()) == ["name", "name", "no inchikey"]
    again = L.loaded(after, batch, L.RULES["drugs"])[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
    assert L.loaded(table.limit(0), batch.limit(0), L.RULES["drugs"])[0].count() == 0
    part = batch.drop("weight").withColumns({"_own": F.lit(1), "_new": F.lit(1), "_row": F.lit(1), "_0": F.lit(1)})
    assert sorted(map(tuple, L.loaded(table, part, L.RULES["drugs"])[0].collect())) == [("K1", "z", 1.0), ("K2", "bb", None)]
    for known, want in ((L.KEEP, [("K1", "z", 1.0), ("K2", "bb", 2.0)]), (L.FILL, [("K1", "a", 1.0), ("K2", "b", 2.0)])):
        rule = L.Rule(("inchikey",), valid=lambda: {"name": F.trim("name") != ""}, known=known)
        assert sorted(map(tuple, L.loaded(table, batch, rule)[0].collect())) == want


def test_pairs_and_mapping(spark):
    none = spark.createDataFrame([], "protein_a string, protein_b string, score int")
    batch = spark.createDataFrame([("B", "A", 400), ("A", "B", 900), ("C", "C", 1), ("A", "C", 1001), (None, "A", 3)], none.schema)
    after, bad = L.loaded(none, batch, L.RULES["protein_pairs"])
    assert [tuple(r) for r in after.collect()] == [("A", "B", 900)]
    # The lesser end of a pair with a null is the other one, so the greater is repeated and the pair is its own.
    assert sorted(r["reason"] for r in bad.collect()) == ["score", "self", "self"]
    table = spark.createDataFrame([("E1", "Aspirin", None)], "canonical_id string, name string, cid int")
    batch = spark.createDataFrame([(None, " aspirin", 7), ("E1", "ASPIRIN", 9), (None, "unknown", 1), (None, None, 2)], table.schema)
    after, bad = L.loaded(table, batch, L.RULES["entity_mapping"])
    assert [tuple(r) for r in after.collect()] == [("E1", " aspirin", 7)]
    assert bad.count() == 2


def test_protein_names_by_hand(spark):
    rng = random.Random(4)
    stems = ["kinase", "receptor", "alpha", "beta", "subunit", "2", "3", "b", "transport"]
    make = lambda: " ".join(rng.choice(stems) for _ in range(rng.randint(3, 7)))
    entities = [(f"A{i}", f"N{i}", f"G{i % 40}", str(i % 3), make()) for i in range(200)] + [("A900", None, None, None, None)]
    records = []
    for i in range(150):
        name = list(make())
        if i % 2:
            name[rng.randrange(len(name))] = "x"
        records.append((i, "A5" if i == 0 else None, "N7" if i == 1 else None, "g3" if i == 2 else None, str(i % 3), "".join(name)))
    records += [(200, None, None, None, None, None), (200, None, None, None, None, None)]
    got = {r["record_id"]: (r["match"], r["method"]) for r in P.resolved(spark.createDataFrame(records, "record_id int, accession string, network_id string, gene string, organism string, name string"), spark.createDataFrame(entities, "accession string, network_id string, gene string, organism string, name string")).collect()}

    def only(key):
        found = {}
        for e in entities:
            if None not in key(e):
                found.setdefault(key(e), set()).add(e[0])
        return {k: min(v) for k, v in found.items() if len(v) == 1}

    import re

    member = lambda s: (re.search(r"(?:^|[\s-])([0-9]+[a-z]?|[a-z]|alpha|beta|gamma|delta)$", s.strip()) or [None, ""])[1]
    genes, names = only(lambda e: (e[2] and e[2].lower(), e[3])), only(lambda e: (e[4], e[3]))
    for i, accession, network, gene, organism, name in records:
        if accession or network:
            want = ("A5", "accession") if accession else ("A7", "network")
        elif gene and (gene, organism) in genes:
            want = (genes[gene, organism], "gene")
        else:
            near = sorted(((ratio(name, n), n) for n, o in names if name and o == organism and ratio(name, n) >= P.name_cutoff(0.85, 0.9) and member(name) == member(n)), reverse=True)
            sure = near and (len(near) == 1 or near[0][0] - near[1][0] > 0.01 + 1e-9)
            want = (names[near[0][1], organism], "name") if sure else (None, None)
        assert got[i] == want, (i, name)
    assert sum(m == "name" for _, m in got.values()) > 5


def test_mapping_promotes_later(spark):
    rows = [(2, "s", None, "N1", "g1", None), (1, "u", "A1", "N1", None, "human"), (2, "s", None, "N2", "g2", None), (3, "x", None, None, "lost", None), (2, "s", None, "N1", "g1", None)]
    got = {r["entry"]: r for r in P.built_mapping(spark.createDataFrame(rows, "rank int, source string, accession string, network_id string, gene string, organism string")).collect()}
    assert set(got) == {"A1", "PROVISIONAL:N2"} and got["A1"]["gene"] == "g1" and got["A1"]["sources"] == "s|u" and got["PROVISIONAL:N2"]["provisional"]


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 2), ("b", None)], "k string, v int")
    got = {r["column"]: tuple(r)[1:] for r in Q.snapshot(df, ["k", "v"]).collect()}
    assert got == {"k": (4, 3, 2, 1), "v": (4, 3, 2, 1)}
    assert [tuple(r)[1:] for r in Q.snapshot(df.limit(0), ["k"]).collect()] == [(0, 0, 0, 0)]
    times = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("b", None)], "k string, t string").withColumn("t", F.to_timestamp("t"))
    got = {r["k"]: r["stale"] for r in Q.stale(times, "k", "t", F.lit("2024-01-02 02:00:00"), 2).collect()}
    assert got == {"a": False, "b": True}
    calls = spark.createDataFrame([("u", i) for i in [0, 0, 30, 59, 60, 200]] + [("v", 5), ("v", None)], "k string, s int").withColumn("t", F.timestamp_seconds("s"))
    got = sorted((r["k"], r["s"], r["recent"], r["refused"]) for r in Q.over_rate(calls, "k", "t", seconds=60, most=3).collect())
    assert got == [("u", 0, 2, False), ("u", 0, 2, False), ("u", 30, 3, False), ("u", 59, 4, True), ("u", 60, 3, False), ("u", 200, 1, False), ("v", 5, 1, False)]
    one = spark.createDataFrame([(1, 0.9, 1), (2, 0.9, 0), (3, 0.1, 1), (4, None, 1), (5, 0.05, 0)], "id int, s double, y int")
    rows = {r["id"]: (r["rank"], r["percentile"], r["kind"]) for r in Q.breakdown(one, "id", "s", "y", threshold=0.5).collect()}
    assert rows == {1: (1, 1.0, "tp"), 2: (2, 0.75, "fp"), 3: (3, 0.5, "fn"), 5: (4, 0.25, "tn")}
    scored = Q.scored(one, lambda b: b["id"] * 2.0, ["id"], out="p")
    assert sorted(r["p"] for r in scored.collect()) == [2.0, 4.0, 6.0, 8.0, 10.0] and Q.scored(one.limit(0), lambda b: b["id"], ["id"]).count() == 0
    pairs = spark.createDataFrame([(1, 9), (2, 9), (3, 8)], "a int, b int")
    left = spark.createDataFrame([(1, ["x", "y", "x"]), (2, None)], "a int, p array<string>")
    right = spark.createDataFrame([(9, ["y", "z"])], "b int, q array<string>")
    assert {r["a"]: r["overlap"] for r in Q.supplemented(pairs, "a", left, "b", right, sets=("p", "q")).collect()} == {1: pytest.approx(1 / 3), 2: 0.0, 3: 0.0}


def test_paged(spark):
    sizes, asked = {1: 0, 2: 3, 3: 7}, []

    def pages(key, at, size):
        return [{"id": i} if i != 5 else {"id": "five"} for i in range(at, min(at + size, sizes[key]))]

    good, bad = paged.paged(spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "k int"), "k", paged.by_offset(pages, 3), "id long")
    assert sorted((r["k"], r["page"], r["id"]) for r in good.collect()) == [(2, 0, 0), (2, 0, 1), (2, 0, 2), (3, 0, 0), (3, 0, 1), (3, 0, 2), (3, 1, 3), (3, 1, 4), (3, 2, 6)]
    assert [(r["k"], r["record"]) for r in bad.collect()] == [(3, '{"id": "five"}')]
    with pytest.raises(Exception, match="more than 1 pages"):
        paged.paged(spark.createDataFrame([(3,)], "k int"), "k", paged.by_offset(pages, 3), "id long", most_pages=1)[0].collect()

    def failing(key, at):
        asked.append(at)
        if len(asked) < 3:
            raise paged.Unavailable(after=4.0 if len(asked) == 1 else None)
        return [{"id": 1}], None

    waits = []
    assert paged.patient(failing, sleep=waits.append)(1, None) == ([{"id": 1}], None) and waits == [4.0, 1.0]
    with pytest.raises(paged.Unavailable):
        paged.patient(lambda k, a: (_ for _ in ()).throw(paged.Unavailable()), tries=2, sleep=waits.append)(1, None)


def test_graph_store(spark, tmp_path):
    nodes = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "label string, id long")
    edges = spark.createDataFrame([("A", 1, "r", "B", 1), ("A", 2, "s", "A", 1)], "src_label string, src_id long, rel string, dst_label string, dst_id long")
    graph_store.export_tables(nodes, edges, str(tmp_path / "g"))
    n, e = graph_store.read_graph(spark, str(tmp_path / "g"), labels=["A"], rels=["s"])
    assert n.count() == 2 and e.select(*edges.columns).collect() == [("A", 2, "s", "A", 1)]
    with pytest.raises(ValueError, match="missing target: 1; null id: 1; repeated id: 1"):
        graph_store.export_tables(nodes.unionByName(spark.createDataFrame([("A", 1), ("A", None)], nodes.schema)), edges.unionByName(spark.createDataFrame([("A", 1, "r", "B", 7)], edges.schema)), str(tmp_path / "h"))
    after, new = graph_store.written_back(edges, edges.unionByName(spark.createDataFrame([("A", 1, "t", "A", 2)] * 2, edges.schema)))
    assert after.count() == 3 and new.collect() == [("A", 1, "t", "A", 2)]
    walk = G.explored(edges, spark.createDataFrame([("A", 2)], "label string, id long"), max_depth=3)
    assert sorted((r["depth"], r["src_id"], r["rel"]) for r in walk.collect()) == [(1, 2, "s"), (2, 1, "r")]


def test_csv_with_line_ends(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text(f'﻿id,name,score\n{i},"a\nb ""c""",1.5\nx,y,2\n7,N/A,\n8,only\nid,name,score\n', encoding="utf-8")
    good, bad = readers.typed_csv(spark, str(tmp_path), "id int, name string, score double", multi_line=True)
    assert sorted(map(tuple, good.collect()), key=str) == [(0, 'a\nb "c"', 1.5), (1, 'a\nb "c"', 1.5), (7, None, None), (7, None, None)]
    assert bad.count() == 6
    single, bad = readers.typed_csv(spark, str(tmp_path), "id int, name string, score double")
    assert sorted(r["id"] for r in single.collect()) == [7, 7]


def test_registries(spark):
    m = R.Methods()
    m.register("exact", 1.0)
    with pytest.raises(ValueError):
        m.register("exact", 0.5)
    with pytest.raises(ValueError):
        m.register("odd", 2)
    df = spark.createDataFrame([("exact", "1"), ("other", "x"), (None, None)], "method string, raw string")
    assert [r[0] for r in df.select(m.confidence(F.col("method"))).collect()] == [1.0, None, None]
    assert [r[0] for r in df.select(R.Methods().confidence(F.col("method"))).collect()] == [None] * 3
    told, a = [], R.Alerts()
    a.register("e", lambda d: 1 / 0)
    a.register("e", told.append)
    assert a.tell("e", {"x": 1}) == 1 and told == [{"x": 1}] and a.tell("nobody", {}) == 0
    got = R.converted(df.withColumn("n", F.when(F.col("method") == "other", "kept")), "raw", "n", lambda v: str(int(v) + 1)).select("n").collect()
    assert [r[0] for r in got] == ["2", "kept", None]
    loaders = R.Loaders()
    node = lambda d: d.selectExpr("'N' label", "id")
    loaders.register("one", lambda s, p: s.range(int(p)), lambda d: (node(d), d.selectExpr("id a", "id b")))
    n, e = loaders.load(spark, {"one": "3"})
    assert n.count() == 3 and e.columns == ["a", "b"]
    with pytest.raises(KeyError):
        loaders.load(spark, {"two": "3"})


def test_alerts_of_a_stream(spark, tmp_path):
    import time

    told, a = [], R.Alerts()
    a.register("progress", told.append)
    listener = a.watch(spark)
    spark.range(5).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    for _ in range(50):
        if any(x["rows"] == 5 for x in told):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert any(x["rows"] == 5 for x in told)


def test_beside(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = Q.beside(one, spark.createDataFrame([(2, "c", 5), (3, None, 6)], "k int, v string, w int"), "k")
    assert got.columns == ["k", "v", "v_2", "w"] and sorted(map(tuple, got.collect())) == [(1, "a", None, None), (2, "b", "c", 5), (3, None, None, 6)]


def test_text_and_censoring(spark):
    from lodestone.functions import scalars as S, text

    row = spark.createDataFrame([("Ångström ﬁlm", None, ">", 5.0)], "a string, b string, r string, v double").select(text.unicode_key("a").alias("a"), text.unicode_key("b").alias("b"), S.is_censored(F.col("r"), F.col("v")).alias("c"), S.is_censored(F.lit("="), F.col("v")).alias("d")).first()
    assert tuple(row) == ("angstrom film", None, True, False)
