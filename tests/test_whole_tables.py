"""Queries over whole tables, against SQL on tables whose ids go beyond the bounds of the bounded queries."""

import duckdb
import pytest

from lodestone.operators import graph as G, joins as J
from lodestone.plans import registry
from tests.test_registry import FOLDER, TABLES, same

LARGER = FOLDER.replace("sf0.001", "sf0.01")
WHOLE = ["graph_three_hops", "graph_bounded_paths", "graph_bfs", "graph_shortest_lengths", "graph_derived_edges", "novel_pairs", "wrong_class_pairs", "crosswalk_translate"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    same(registry.queries()[name](spark, LARGER).toPandas(), duck.execute(registry.oracle_sql()[name]).df())


def test_negatives_of_every_customer(spark):
    duck = duckdb.connect()
    known = set(duck.execute(f"SELECT DISTINCT o_custkey, l_partkey FROM '{FOLDER}/orders.parquet' JOIN '{FOLDER}/lineitem.parquet' ON l_orderkey = o_orderkey").fetchall())
    customers = {r[0] for r in duck.execute(f"SELECT c_custkey FROM '{FOLDER}/customer.parquet'").fetchall()}
    got = [tuple(r) for r in registry.queries()["graph_negatives"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) == 5 * len(customers) and {c for c, _ in got} == customers
    assert not known & set(got)


def test_negatives_where_few_are_left(spark):
    left = spark.createDataFrame([(i,) for i in range(3)], "c long")
    right = spark.createDataFrame([(i,) for i in range(400)], "p long")
    known = spark.createDataFrame([(0, p) for p in range(397)] + [(1, p) for p in range(400)], "c long, p long")
    got = [tuple(r) for r in G.weighted_negatives(left, right, known, "c", "p", 5).collect()]
    assert sorted(r for r in got if r[0] < 2) == [(0, 397), (0, 398), (0, 399)]
    assert len({r for r in got if r[0] == 2}) == 5 == len(got) - 3


def test_negatives_prefer_small_degrees(spark):
    left = spark.createDataFrame([(i,) for i in range(2000)], "c long")
    known = spark.createDataFrame([(-1 - i, 0) for i in range(8)], "c long, p long")
    right = spark.createDataFrame([(i,) for i in range(5)], "p long")
    first = [r["p"] for r in G.weighted_negatives(left, right, known, "c", "p", 1).collect()]
    assert 0.03 < first.count(0) / len(first) < 0.07  # 0.1 / (0.1 + 4 * 0.5)


def test_top_unseen_pairs_take_more_rows(spark):
    from pyspark.sql import functions as F

    left = spark.createDataFrame([(i, f"L{i}") for i in range(4)], "i long, a string")
    right = spark.createDataFrame([(j, f"r{j}", 100.0 - j) for j in range(50)], "j long, b string, top double")
    known = spark.createDataFrame([(f"l{i}", f"R{j}") for i in range(4) for j in range(40)], "a string, b string")
    got = J.top_unseen_pairs(left, right, known, "a", "b", bound=F.col("top"), score=F.col("top") / (1 + F.col("i")), ties=["i", "j"], k=6, block=2)
    assert [(r["i"], r["j"]) for r in got.collect()] == [(0, j) for j in range(40, 46)]


def test_components_of_every_line(spark):
    pairs = duckdb.connect().execute(f"SELECT DISTINCT l_partkey, l_suppkey + 10000000 FROM '{FOLDER}/lineitem.parquet'").fetchall()
    root = {n: n for pair in pairs for n in pair}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in registry.queries()["graph_components"](spark, FOLDER).collect()}
    assert got == {n: top(n) for n in root if top(n) != n}
    sizes = {r["component"]: r["size"] for r in registry.queries()["graph_component_split"](spark, FOLDER).collect()}
    assert sizes == {c: list(got.values()).count(c) + 1 for c in set(got.values())}  # with the component's own first node
