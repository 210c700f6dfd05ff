"""Operators of the core on nulls, ties, repeated rows, clashing names and empty tables: each case with its defined result."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import aggregate as A, dedup as D, graph as G, joins as J, ordered as O, rank as R, reports as Q, resolve as E, sampling as N

#: Names that operators use inside.
CLASHES = ["_rank", "_r", "_part", "_part_0", "_from", "_d", "_t", "_s", "_p", "_q", "_v", "_n", "_new0", "_in_new", "_load", "_low", "_key"]


def wide(spark, rows, schema):
    """A frame with columns of clashing names, each of its own value."""
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def kept(df):
    """That the clashing columns came through as they were; rows without them, with None first."""
    assert set(CLASHES) <= set(df.columns)
    rows = df.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    names = [c for c in df.columns if c not in CLASHES]
    return sorted((tuple(r[c] for c in names) for r in rows), key=lambda t: [(x is not None, str(x)) for x in t])


EDGES = "src_label string, src_id long, rel string, dst_label string, dst_id long, confidence double"
LINKS = [("A", 1, "r", "B", 1, 0.5), ("A", 1, "r", "B", 1, 0.9), ("A", 1, "r", "B", 1, None), ("A", None, "r", "B", 1, 0.1), ("B", 1, "q", "A", 1, None), ("A", 2, "r", "B", 7, 0.3), ("A", 1, "r", "B", None, 0.2)]


def test_best_rows(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), ("b", None, "w"), (None, 5, "n"), (None, 5, "n"), ("c", 2, "t"), ("c", 2, "t")]
    df = wide(spark, rows, "k string, v long, s string")
    best = D.best_per_key(df, ["k"], [F.col("v").desc(), F.col("s")])
    assert kept(best) == [(None, 5, "n"), (None, 5, "n"), ("a", 1, "x"), ("b", None, "w"), ("c", 2, "t")]
    assert len(kept(D.best_per_key(df, ["k"], [F.col("v").desc(), F.col("s")], null_keys="drop"))) == 3
    marked = kept(D.best_per_key(df, ["k"], [F.col("v").desc(), F.col("s")], mark="first"))
    assert len(marked) == len(rows) and sum(r[3] for r in marked) == 5
    assert D.best_per_key(df.limit(0), ["k"], [F.col("v")]).count() == 0
    assert kept(D.most_complete(df, "k", [F.col("s")]))[2] == ("a", 1, "x")
    assert kept(D.by_priority(df, ["k"], "s", ["y", "x"], [F.col("s")]))[2:] == [("a", 1, "y"), ("b", None, "w"), ("c", 2, "t")]
    assert kept(E.latest_version(df.where("k = 'a'"), ["k"], "v"))[0][:2] == ("a", 1)


def test_pairs_and_merged_fields(spark):
    df = wide(spark, [("b", "a", 1.0), ("a", "b", 3.0), ("a", "a", 9.0), (None, "a", 9.0), ("a", None, 2.0)], "a string, b string, s double")
    assert kept(D.best_pairs(df, "a", "b", "s", [F.col("s")])) == [("a", "b", 3.0)]
    fields = D.merged_fields(spark.createDataFrame([("k", 1, None, " "), ("k", 2, "x", "p"), ("k", 3, "y", "q"), (None, 1, "z", None)], "k string, o int, f string, g string"), ["k"], F.col("o"), ["f", "g"])
    assert sorted(map(tuple, fields.collect()), key=str) == [("k", "x", "p"), (None, "z", None)]
    assert D.merged_fields(fields.limit(0).withColumn("o", F.lit(1)), ["k"], F.col("o"), ["f"]).count() == 0


def test_merged_graph(spark):
    one = wide(spark, [("A", 1, None), ("A", 1, "x"), ("A", None, "z")], "label string, id long, name string")
    two = wide(spark, [("A", 1, "y"), ("A", 3, "y")], "label string, id long, name string")
    nodes = G.merged_nodes([one, two], ["name"])
    assert sorted(map(tuple, nodes.collect())) == [("A", 1, "x"), ("A", 3, "y")]
    edges = wide(spark, LINKS, EDGES)
    known = spark.createDataFrame([("A", 1), ("B", 1), ("B", 1), ("A", None)], "label string, id long")
    assert sorted(map(tuple, G.merged_edges(edges, known).collect())) == [("A", 1, "B", 1, "r", 0.9), ("B", 1, "A", 1, "q", None)]
    assert G.merged_edges(edges.limit(0), known).count() == 0 and G.merged_edges(edges, known.limit(0)).count() == 0


def test_reverse_and_lists_of_edges(spark):
    edges = wide(spark, LINKS, EDGES)
    both = G.with_reverse(edges)
    assert both.count() == 2 * len(LINKS) and both.where("rel like 'rev_%'").count() == len(LINKS)
    lists = {(r.src_label, r.rel, r.dst_label): r.pairs for r in G.edge_lists(edges.where("src_id is not null and dst_id is not null")).collect()}
    assert lists == {("A", "r", "B"): 2, ("B", "q", "A"): 1}
    again = {tuple(r) for r in G.edge_lists(edges.unionByName(edges).where("src_id is not null and dst_id is not null")).collect()}
    assert again == {tuple(r) for r in G.edge_lists(edges.where("src_id is not null and dst_id is not null")).collect()}
    for f in (G.with_reverse, G.edge_lists, G.relation_summary, G.entity_counts):
        assert f(edges.limit(0)).count() == 0


def test_disjoint_edges(spark):
    edges = wide(spark, LINKS, EDGES).withColumn("split", F.lit("own"))
    side = lambda c: F.when(F.col(c) < 2, "train").when(F.col(c) >= 2, "test")
    got = G.node_disjoint_edges(edges, side("src_id"), side("dst_id"))
    assert sorted((r[1], r[4], r[-1] or "") for r in kept(got) if r[1] is not None) == [(1, 1, "train")] * 4 + [(2, 7, "test")]
    assert G.node_disjoint_edges(edges.limit(0), side("src_id"), side("dst_id")).count() == 0


def test_derived_edges_and_paths(spark):
    left = wide(spark, [(1, "x"), (1, "x"), (2, None), (None, "x")], "src_id long, via string")
    right = spark.createDataFrame([(7, "x"), (8, None)], "dst_id long, via string")
    got = G.derived_edges(left, right, "via", "r", ("A", "B"))
    assert sorted(map(tuple, got.collect()), key=str) == [("A", 1, "r", "B", 7), ("A", None, "r", "B", 7)]
    edges = spark.createDataFrame([("e1", 1, 2, 0.5), ("e2", 2, 3, None), ("e2", 2, 3, None), ("e3", 1, 3, 0.1)], "id string, a long, b long, confidence double")
    paths = G.bounded_paths(edges, F.col("node") == 1, F.col("node") == 3, max_depth=2)
    assert [(r.path, r.hops) for r in paths.collect()] == [("1>2>3", 2), ("1>3", 1)]
    assert G.bounded_paths(edges.limit(0), F.col("node") == 1, F.col("node") == 3).count() == 0


def test_ingestion(spark):
    rows = [("k", 1, "a", None), ("k", 2, "b", "p"), ("k", 2, "c", "q"), ("k", 1, "a", None), (None, 1, "z", "z"), ("m", 1, None, None)]
    records = wide(spark, rows, "k string, src int, f string, g string")
    merged, conflicts = E.ingested(records, "k", ["f", "g"], "src")
    assert sorted(map(tuple, merged.collect())) == [("k", "a", "p", "1|2"), ("m", None, None, "1")]
    assert sorted(map(tuple, conflicts.collect())) == [("k", "f", "a", "b"), ("k", "f", "a", "c"), ("k", "g", "p", "q")]
    merged, conflicts = E.ingested(records, "k", [], "src")
    assert sorted(map(tuple, merged.collect())) == [("k", "1|2"), ("m", "1")] and conflicts.count() == 0
    for part in E.ingested(records.limit(0), "k", ["f"], "src"):
        assert part.count() == 0
    mapping = wide(spark, [("a", "x|y"), ("b", "y"), ("c", None), ("d", "x")], "k string, sources string")
    assert kept(E.without_source(mapping, "sources", "y")) == [("a", "x"), ("d", "x")]


def test_state_as_of(spark):
    log = wide(spark, [("k", 1, "set", "a"), ("k", 2, "set", None), ("k", 9, "set", "late"), ("m", 1, "set", "b"), ("m", 3, "remove", None), (None, 1, "set", "n"), ("t", None, "set", "x")], "k string, at int, action string, v string")
    assert sorted(map(tuple, E.as_of(log, "k", "at", ["v"], "action", 5).collect()), key=str) == [("k", "a"), (None, "n")]
    assert E.as_of(log.limit(0), "k", "at", ["v"], "action", 5).count() == 0


def test_joins_keep_other_columns(spark):
    table = wide(spark, [("a", None), ("b", 2), (None, 3)], "k string, v long")
    staging = spark.createDataFrame([("a", 7), ("b", 8), ("c", 9), ("c", 1), (None, 4)], "k string, v long")
    assert kept(J.filled_from(table, staging, "k", "v")) == [(None, 3), ("a", 7), ("b", 2)]
    changes = wide(spark, [("a", 5), ("z", 6), ("z", 7)], "k string, v long")
    assert kept(J.upserted(table, changes, ["k"], F.col("v"))) == [(None, 3), ("a", 5), ("b", 2), ("z", 7)]
    pairs = J.all_pairs(table.withColumnRenamed("k", "x").select("x", "_p", "_q"), spark.createDataFrame([(1,), (1,)], "y long"))
    assert pairs.columns == ["x", "_p", "_q", "y"] and pairs.count() == 6
    assert J.all_pairs(table.limit(0), staging.select(F.col("k").alias("o"))).count() == 0


def test_orders_keep_other_columns(spark):
    df = wide(spark, [("a", 2.0), ("b", 1.0), ("c", None), ("d", 1.0)], "k string, s double")
    got = kept(O.placed(df, [F.col("s"), F.col("k")], sums={"s": "before"}, total="all"))
    assert [(r[0], r[3], r[4], r[2]) for r in got] == [("a", 3, 2.0, 4), ("b", 1, 0.0, 4), ("c", 0, 0.0, 4), ("d", 2, 1.0, 4)]
    assert kept(O.least_after(df.where("s is not null"), [F.col("s"), F.col("k")], "s", "least"))[0] == ("a", 2.0, 2.0)
    ranks = {r[0]: r[2] for r in kept(R.average_ranks(df, "s"))}
    assert ranks == {"c": 1.0, "b": 2.5, "d": 2.5, "a": 4.0}
    grouped = {r[0]: r[2] for r in kept(R.average_ranks(df.withColumn("s", F.coalesce("s", F.lit(0.0))), "s", ["_r"]))}
    assert grouped == ranks
    for f in (lambda d: O.placed(d, [F.col("s")]), lambda d: R.average_ranks(d, "s"), lambda d: A.benjamini_hochberg(d, "s", "k")):
        assert f(df.limit(0)).count() == 0


def test_rates_and_prefixes_keep_other_columns(spark):
    calls = wide(spark, [("k", 0), ("k", 0), ("k", 59), ("k", 60), ("k", 119), (None, 5), ("k", None)], "k string, at long").withColumn("t", F.timestamp_seconds("at"))
    got = kept(Q.over_rate(calls, "k", "t", seconds=60, most=2).drop("t"))
    assert got == [(None, 5, 1, False), ("k", 0, 2, False), ("k", 0, 2, False), ("k", 119, 2, False), ("k", 59, 3, True), ("k", 60, 2, False)]
    assert Q.over_rate(calls.limit(0), "k", "t").count() == 0
    wanted, names = wide(spark, [("Asp",), ("as",), (None,)], "w string"), spark.createDataFrame([("aspirin",), ("ASPEN",), (None,), ("basp",)], "name string")
    assert sorted(r["name"] for r in N.prefix_matches(wanted, names, "w", "name").collect()) == ["ASPEN", "aspirin"]


@pytest.mark.parametrize("how", ["mean", "max", "first"])
def test_pair_scores(spark, how):
    df = wide(spark, [("a", "b", 1.0, 2), ("a", "b", 3.0, 1), ("a", "b", None, 0), (None, "b", 1.0, 1)], "a string, b string, s double, o int")
    want = {"mean": 2.0, "max": 3.0, "first": None}[how]
    assert sorted(map(tuple, A.pair_scores(df, "a", "b", "s", "o", how=how).collect()), key=str) == [("a", "b", want, 3), (None, "b", 1.0, 1)]
    assert A.pair_scores(df.limit(0), "a", "b", "s", "o", how=how).count() == 0


def test_scopes_drop_their_own_tables(spark):
    import os

    from lodestone.shared import Scratch, scope

    here = lambda x: os.path.exists(x.root.removeprefix("file://") + "/t")
    outer = Scratch(spark, "outer")
    outer.write(spark.range(3), "t")
    with scope():
        one = Scratch(spark, "one")
        one.write(spark.range(3), "t")
        with scope():
            two = Scratch(spark, "two")
            two.write(spark.range(3), "t")
            assert here(two)
        assert not here(two) and here(one)
    assert not here(one) and here(outer)
    outer.drop()
