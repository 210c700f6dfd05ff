"""What grew faster than the input or its result: brute force on odd rows, and plans without the step that did."""

import random

from pyspark.sql import functions as F

from lodestone.operators import graph as G, joins as J, reports as Q, sampling as N


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_disjoint_class_pairs_by_brute_force(spark):
    """Without an anti-join against all pairs that share a class."""
    rng = random.Random(1)
    left = [(rng.randrange(30), [rng.choice([*range(90), None]) for _ in range(rng.randint(0, 5))]) for _ in range(40)] + [(None, [1]), (99, None), (7, [1, 2]), (7, [3])]
    right = [(rng.randrange(30), [rng.choice([*range(90), None]) for _ in range(rng.randint(0, 5))]) for _ in range(40)] + [(None, [1, 2]), (98, None), (5, [3])]

    def whole(rows):
        out = {}
        for k, cl in rows:
            out.setdefault(k, set()).update(c for c in cl or [] if c is not None and k is not None)
        return out

    x, y = whole(left), whole(right)
    want = sorted(((a, b) for a, _ in left for b, _ in right if not x[a] & y[b]), key=str)
    got = N.disjoint_class_pairs(*(spark.createDataFrame(rows, f"{k} long, cl array<long>") for rows, k in ((left, "a"), (right, "b"))), "a", "b", "cl")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert "LeftAnti" not in plan(got)


def test_pairs_are_dealt_over_tasks(spark):
    """2 MB of rows that make 16 million pairs are not put together by bytes."""
    left, right = spark.range(4000).toDF("a"), spark.range(4000).toDF("b")
    pairs = J.all_pairs(left, right)
    assert pairs.rdd.getNumPartitions() == 16 and pairs.count() == 16_000_000
    assert J.all_pairs(left.limit(0), right).count() == 0


def test_rates_by_brute_force(spark):
    """Calls at one time, at the edges of a span and before 1970; a running sum and no frame that is counted anew for each row."""
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), 0.0 + rng.choice([-70, -61, -60, -1, 0, 59, 60, 61, 119, 120, 180, *range(0, 400, 7)]) + rng.choice([0, 0, 0.000001, 0.999999])) for i in range(400)] + [(400, None, 5.0), (401, None, 6.0), (402, "a", None)]
    df = spark.createDataFrame(rows, "i int, k string, at double").withColumn("at", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long")))
    got = Q.over_rate(df, "k", "at", seconds=60, most=9)
    micro = [(i, k, None if t is None else round(t * 1e6)) for i, k, t in rows]
    want = {i: sum(k == k2 and u is not None and t - 60_000_000 < u <= t for _, k2, u in micro) for i, k, t in micro if t is not None}
    assert {r["i"]: (r["recent"], r["refused"]) for r in got.collect()} == {i: (n, n > 9) for i, n in want.items()}
    assert "unboundedpreceding$(), currentrow$()" in plan(got)


def test_derived_edges_once_and_by_blocks(spark, monkeypatch):
    """Ends that share several values, or come in several rows, give one edge without a shuffle of the edges; a common value is dealt out."""
    monkeypatch.setattr(G, "VALUE_PAIRS", 50)
    rng = random.Random(5)
    left = [(rng.randrange(60), rng.choice([1, 1, 1, 2, 3, 4, None])) for _ in range(150)]
    right = [(rng.randrange(60), rng.choice([1, 1, 1, 2, 3, 5, None])) for _ in range(150)]
    got = G.derived_edges(spark.createDataFrame(left, "src_id long, via int"), spark.createDataFrame(right, "dst_id long, via int"), "via", "same", ("A", "B"))
    want = sorted({("A", a, "same", "B", b) for a, v in left for b, w in right if v == w and v is not None})
    assert sorted(tuple(r) for r in got.collect()) == want
    top = plan(got).split("Join")[0]
    assert "Aggregate" not in top


def test_negatives_without_short_ids_join_no_pairs(spark):
    """Where draws suffice no pairs of all ids are planned beside them; ids are dealt over tasks by their draws."""
    left, right = spark.range(300).toDF("c"), spark.range(500).toDF("p")
    known = spark.range(300).select(F.col("id").alias("c"), F.col("id").alias("p"))
    got = G.weighted_negatives(left, right, known, "c", "p", 5)
    assert "Join" not in plan(got)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 1500 and not any(c == p for c, p in rows)


def test_unseen_pairs_look_up_few_known(spark, monkeypatch):
    """Known pairs are narrowed to the names of a round's first pairs; where those don't do, all count, with the same result."""
    left = spark.createDataFrame([(i, f"L{i}" if i % 7 else None) for i in range(60)], "i long, a string")
    right = spark.createDataFrame([(j, f"r{j}", 1000.0 - j) for j in range(80)], "j long, b string, top double")
    known = spark.createDataFrame([(f"l{i}", f"R{j}") for i in range(60) for j in range(80) if j < 30 or (i + j) % 3], "a string, b string")
    seen, own = [], J.unseen_pairs

    def looked(pairs, told, a, b):
        seen.append(told.count())
        return own(pairs, told, a, b)

    monkeypatch.setattr(J, "unseen_pairs", looked)
    score = F.col("top") / (1 + F.col("i"))
    pairs = [((1000.0 - j) / (1 + i), i, j) for i in range(60) for j in range(80) if i % 7 == 0 or not (j < 30 or (i + j) % 3)]
    want = [(i, j) for _, i, j in sorted(pairs, key=lambda x: (-x[0], *x[1:]))[:8]]
    for first in (20_000, 0):
        monkeypatch.setattr(J, "FIRST", first)
        got = J.top_unseen_pairs(left, right, known, "a", "b", bound=F.col("top"), score=score, ties=["i", "j"], k=8)
        assert [(r["i"], r["j"]) for r in got.collect()] == want
    assert seen[0] < known.count() / 3 < seen[-1]


def test_protein_names_are_compared_at_their_cutoff(spark, monkeypatch):
    """A lower threshold would find, and throw away, pairs that the cutoff doesn't let through."""
    from lodestone.operators import proteins as P

    asked, own = [], P.alike_names
    monkeypatch.setattr(P, "alike_names", lambda *a, base, **b: asked.append(base) or own(*a, base=base, **b))
    e = spark.createDataFrame([("A", "a protein of many letters 1"), ("B", "b protein of some letters 2")], "accession string, name string").select("accession", F.lit(None).cast("string").alias("network_id"), F.lit(None).cast("string").alias("gene"), F.lit("h").alias("organism"), "name")
    r = spark.createDataFrame([(1, "a protein of many lettersx 1"), (2, "a protain of sane lettens 2"), (3, None)], "record_id int, name string").select("record_id", F.lit(None).cast("string").alias("accession"), F.lit(None).cast("string").alias("network_id"), F.lit(None).cast("string").alias("gene"), F.lit("h").alias("organism"), "name")
    assert sorted((x.record_id, x.match) for x in P.resolved(r, e).collect()) == [(1, "A"), (2, None), (3, None)]
    assert asked == [P.name_cutoff(0.85, 0.9)]


def test_products_shuffle_no_vectors(spark, monkeypatch):
    """Blocks meet where they are read, candidates in several parts; ties across blocks go to smaller ids, weights are of all candidates."""
    import numpy as np

    from lodestone.operators import vectors as V

    monkeypatch.setattr(V, "HELD", 700)
    v = np.round(np.random.default_rng(4).normal(size=(60, 4)), 1)
    v[20:40] = v[:20]
    frames = [spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], f"id long, vector array<{kind}>").repartition(3) for kind in ("double", "float")]
    for attention in (False, True):
        got = V.top_products(*frames, k=7, attention=attention, block=8)
        assert "FlatMapGroups" not in plan(got) and "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()
        rows = got.collect()
        score = v @ v.astype(np.float32).astype(float).T * (0.5 if attention else 1)
        np.fill_diagonal(score, -np.inf)
        weight = np.exp(score) / np.exp(score).sum(1, keepdims=True)
        want = {(q, n + 1): int(i) for q in range(60) for n, i in enumerate(np.lexsort((np.arange(60), -np.round(score[q], 12)))[:7])}
        assert len(rows) == 420 and {(r["query_id"], r["rank"]) for r in rows} == want.keys()
        for r in rows:
            assert abs(r["score"] - score[r["query_id"], want[r["query_id"], r["rank"]]]) < 1e-12
            assert r["weight"] is None if not attention else abs(r["weight"] - weight[r["query_id"], r["id"]]) < 1e-9
