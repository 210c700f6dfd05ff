"""Identity, splits, match methods, paths, states and stores on odd rows and against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G, identity as I

CLASHES = ["cluster", "low", "high", "n", "position", "i", "first", "head", "reason"]


def clashing(df):
    return df.withColumns({c: F.lit("z") for c in CLASHES if c not in df.columns})


def greedy(sizes, train=0.8, val=0.1):
    total = sum(n for _, n in sizes)
    lack = [int(total * train), int(total * val)]
    lack.append(total - sum(lack))
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = max(range(3), key=lambda k: (lack[k], -k))
        lack[k] -= n
        out[name] = ("train", "val", "test")[k]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_component_split_is_greedy(spark, seed):
    rng = random.Random(seed)
    sizes = [(c, rng.choice([1, 1, 1, 2, 2, 3, 7, 40][: seed + 2])) for c in range(rng.choice([1, 2, 50, 400]))]
    if seed == 5:
        sizes.append((1000, 5000))
    frame = clashing(spark.createDataFrame(sizes, "component long, n long")).withColumnRenamed("n", "members")
    train = rng.choice([0.8, 0.5, 0.34])
    got = {r.component: r.split for r in G.component_split(frame, size="members", train=train).collect()}
    assert got == greedy(sizes, train)


def test_component_split_of_members(spark):
    rows = [(c,) for c in (1, 1, 1, 2, None, 3, 3)]
    got = G.component_split(spark.createDataFrame(rows, "component long"), train=0.5, val=0.25)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, "train"), (2, 1, "val"), (3, 2, "test")]
    assert G.component_split(got.limit(0).select("component")).count() == 0


def test_identity_clusters_by_hand(spark):
    claims = [("a", "x", "1"), ("b", "x", "1"), ("b", "y", "2"), ("c", "y", "2"), ("c", "y", "2"), ("d", "y", "3"), ("e", "x", "4"), ("f", "x", "4"), ("f", "z", "5"), ("g", "z", "5"), (None, "x", "1"), ("h", None, "1"), ("i", "x", None), ("m", "x", "7"), ("n", "x", "7"), ("o", "x", "7")]
    keys = [("a", "K1"), ("a", "K1"), ("c", "K2"), ("e", "K3"), ("j", "K4"), ("j", "K5"), ("k", None), ("m", "K8"), ("m", "K9"), (None, "K1")]
    c = clashing(spark.createDataFrame(claims, "record string, system string, value string"))
    k = clashing(spark.createDataFrame(keys, "record string, key string"))
    entities, rejects, conflicts = I.identity_clusters(c, k)
    assert {r.record: (r.cluster, r.canonical_id, r.how) for r in entities.collect()} == {
        "a": ("a", "K1", "key"), "c": ("a", "K2", "key"), "d": ("d", "UNRESOLVED:d", "none"), "e": ("e", "K3", "key"), "f": ("e", "K3", "cluster"), "g": ("e", "K3", "cluster"),
        "k": ("k", "UNRESOLVED:k", "none"), "n": ("n", "UNRESOLVED:n", "none"), "o": ("n", "UNRESOLVED:n", "none"),
    }
    assert sorted(tuple(r) for r in rejects.collect()) == [("b", "a", "two keys as near", "K1", "K2"), ("j", "j", "two keys", "K4", "K5"), ("m", "m", "two keys", "K8", "K9")]
    assert conflicts.count() == 0
    more = c.unionByName(clashing(spark.createDataFrame([("a", "q", "9"), ("b", "q", "9"), ("c", "r", "8"), ("d", "r", "8"), ("a", "s", "0"), ("c", "s", "0")], "record string, system string, value string")))
    entities, rejects, conflicts = I.identity_clusters(more, k)
    found = {r.record: (r.canonical_id, r.how) for r in entities.collect()}
    assert found["d"] == ("K2", "nearest") and "b" not in found
    assert [tuple(r) for r in conflicts.collect()] == [("s", "0", 2, "K1", "K2")]
    for part in I.identity_clusters(c.limit(0), k.limit(0)):
        assert part.count() == 0


def test_identity_clusters_of_a_hub(spark):
    """An identifier that all records hold, with two keys: each is refused but those with a key or with a nearer one."""
    claims = spark.range(200).selectExpr("id as record", "'hub' as system", "'1' as value").unionByName(spark.range(50).selectExpr("1000 + id as record", "'chain' as system", "'c' || id as value"))
    claims = claims.unionByName(spark.range(50).selectExpr("case when id = 0 then 0 else 999 + id end as record", "'chain' as system", "'c' || id as value"))
    keys = spark.createDataFrame([(0, "A"), (1, "B")], "record long, key string")
    entities, rejects, _ = I.identity_clusters(claims, keys)
    found = {r.record: r.canonical_id for r in entities.collect()}
    assert found == {0: "A", 1: "B"} | {1000 + i: "A" for i in range(50)}
    assert {r.record for r in rejects.collect()} == set(range(2, 200))


def test_compound_mappings_by_hand(spark):
    rows = [(1, "a", "K1", "first", False, ["x", " "]), (2, "a", "K1", "again", False, ["q"]), (3, "b", "K1", "second", True, ["x", "y"]), (4, "c", None, "loose", False, None), (5, " ", "K2", "no id", False, []), (6, None, "K2", "no id", False, []), (7, "d", "K3", "gone", None, ["z"])]
    df = clashing(spark.createDataFrame(rows, "place long, id string, k string, name string, bad boolean, others array<string>"))
    mappings, aliases, rejects = I.compound_mappings(df, record_id="id", key=F.col("k"), name="name", order=[F.col("place")], identifiers={"other": F.col("others")}, refused={"gone": F.col("name") == "gone"}, flags={"bad": F.col("bad")}, source="S")
    assert sorted(tuple(r) for r in mappings.collect()) == [("K1", "first", 0.99, False, ["bad"], 2), ("UNRESOLVED:S:c", "loose", 0.5, True, [], 1)]
    assert sorted((str(r.record_id), r.reason) for r in rejects.collect()) == [("None", "missing id"), ("None", "missing id"), ("a", "repeated id"), ("d", "gone")]
    assert sorted(tuple(r) for r in aliases.collect()) == [("key", "K1", "K1"), ("other", "x", "K1"), ("other", "y", "K1"), ("record_id", "a", "K1"), ("record_id", "b", "K1"), ("record_id", "c", "UNRESOLVED:S:c")]
    ids = spark.createDataFrame([("other", "x"), ("record_id", "c"), ("record_id", None), ("none", "x")], "system string, value string")
    look = lambda **how: sorted((r.system, r.value or "", r.canonical_id) for r in I.looked_up(ids, aliases, mappings, **how).collect())
    assert look() == [("none", "x", None), ("other", "x", "K1"), ("record_id", "", None), ("record_id", "c", "UNRESOLVED:S:c")]
    assert look(reviewed=True)[3] == ("record_id", "c", None) and look(without=["bad"])[1] == ("other", "x", None)


RECORDS = [("K1", "aspirin", "s1", 2, "x"), (None, "aspirin", "s2", 1, "y"), ("K2", "other", "s1", 1, None), (None, "other", "s3", 1, "z"), ("K3", "other", "s1", 1, "q"), (None, "nobody", "s1", 1, "w"), (None, None, "s1", 1, "v"), (None, " ", None, None, "u"), ("K1", None, "s9", 1, None), (" ", "aspirin", "s1", 3, "a")]
SCHEMA = "key string, name string, source string, rank long, value string"


def test_resolver_state_in_any_batches(spark, tmp_path):
    from lodestone.streaming.resolver import ResolverState

    def run(name, cuts, order, **how):
        state = ResolverState(spark, f"{tmp_path}/{name}", {"value": "string"}, **how)
        rows = [RECORDS[i] for i in order]
        for number, (lo, hi) in enumerate(cuts):
            batch = clashing(spark.createDataFrame(rows[lo:hi], SCHEMA))
            state.apply(batch, number)
            state.apply(batch, number)  # a batch that comes again
        return sorted(tuple(r) for r in state.entries().collect()), sorted((str(r.name), r.reason, r.n) for r in state.unresolved().collect()), state

    entries, rest, one = run("one", [(0, 10)], range(10))
    assert entries == [("K1", "y", "s1|s2|s9", 4), ("K2", None, "s1", 1), ("K3", "q", "s1", 1)]
    assert rest == [("None", "no name", 2), ("nobody", "unknown name", 1), ("other", "several keys", 1)]
    for cuts, order, how in (([(0, 3), (3, 3), (3, 10)], range(9, -1, -1), {}), ([(i, i + 1) for i in range(10)], [1, 3, 0, 2, 5, 4, 9, 8, 7, 6], {"merge_after": 3})):
        more, left, state = run(f"many{len(cuts)}", cuts, order, **how)
        assert (more, left) == (entries, rest)
    assert len(state.tables.batches("bases")) == 3
    with pytest.raises(ValueError):
        one.apply(spark.createDataFrame(RECORDS[:2], SCHEMA), 0)
    state.snapshot(f"{tmp_path}/snapshot")
    again = ResolverState.restore(spark, f"{tmp_path}/snapshot", f"{tmp_path}/again", {"value": "string"})
    assert sorted(tuple(r) for r in again.entries().collect()) == entries
    again.apply(spark.createDataFrame([("K9", "nobody", "s1", 1, None)], SCHEMA), 0)
    assert ("K9", "w", "s1", 2) in [tuple(r) for r in again.entries().collect()]
    state.snapshot(f"{tmp_path}/hidden", hidden=["value"])
    hidden = ResolverState.restore(spark, f"{tmp_path}/hidden", f"{tmp_path}/masked", {"value": "string"})
    assert {(r.key, r.value, r.n) for r in hidden.entries().collect()} == {("K1", None, 4), ("K2", None, 1), ("K3", None, 1)}
    assert not {r.name for r in hidden.unresolved().collect()} & {"nobody", "other"}


def test_stream_killed_before_its_commit_writes_once(spark, tmp_path):
    from lodestone.streaming.committed import Committed, pairs_sink, run_batches

    for i in range(3):
        spark.createDataFrame([(2 * i,), (2 * i + 1,)], "a long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/left")
    tables = Committed(spark, f"{tmp_path}/out")
    right = spark.range(3).withColumnRenamed("id", "b")
    sink = pairs_sink(tables, right, lambda p: p.withColumn("s", F.col("a") * F.col("b")), known=spark.createDataFrame([(1, 2), (9, 9)], "a long, b long"), on=["a", "b"], format="parquet")
    stream = lambda: spark.readStream.schema("a long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/left")
    commit = tables.commit

    def killed(number, *args, **how):
        if number == 1:
            raise RuntimeError("killed after the write, before the commit")
        commit(number, *args, **how)

    tables.commit = killed
    with pytest.raises(Exception, match="killed"):
        run_batches(stream(), sink, f"{tmp_path}/checkpoint")
    assert tables.batches() == [0] and tables.read("pairs", "a long, b long, s long").count() in (5, 6)
    tables.commit = commit
    run_batches(stream(), sink, f"{tmp_path}/checkpoint")
    got = sorted(tuple(r) for r in tables.read("pairs", "a long, b long, s long").collect())
    assert got == [(a, b, a * b) for a in range(6) for b in range(3) if (a, b) != (1, 2)]
    query = run_batches(stream(), sink, f"{tmp_path}/checkpoint", every="1 second")
    query.processAllAvailable()
    query.stop()
    assert tables.read("pairs", "a long, b long, s long").count() == 17


def test_match_methods_by_hand(spark):
    from lodestone.operators.matching import expansions_with, match_records

    entities = [("AAAAAAAAAAAAAA-X", "aspirin", "CC"), ("AAAAAAAAAAAAAA-Y", "other", "C1"), ("B", "methotrexate", "C2"), ("C", "twin", "CN"), ("D", "twin", "CN"), ("E", "ibuprofen tablets", None), (None, "keyless", "C9"), ("F", None, " ")]
    records = [(1, "B", "aspirin", None), (2, "AAAAAAAAAAAAAA-Z", None, None), (3, None, " aspirin ", None), (4, None, "mtx", None), (5, None, "ibuprofen tablet", "C2"), (6, None, "twin", "CN"), (7, "none", "lost", "C1"), (8, None, "trade name", None), (9, None, None, None), (9, None, None, None), (10, "", "", ""), (11, "B2", "two", None), (12, None, "keyless", "C9")]
    e = clashing(spark.createDataFrame(entities, "key string, name string, s string"))
    r = clashing(spark.createDataFrame(records, "id long, key string, name string, s string"))
    table = spark.createDataFrame([("MTX", "old name"), ("two", "aspirin"), ("two", "other"), ("aspirin", "aspirin"), (None, "x"), ("", "x")], "abbreviation string, name string")
    more = spark.createDataFrame([("mtx ", "Methotrexate")], "abbreviation string, name string")
    xrefs = spark.createDataFrame([("trade name", "C"), ("lost", "nowhere"), ("two", "B"), ("two", "C")], "name string, key string")
    got = match_records(r, e, record_id="id", key="key", name="name", structure="s", expansions=expansions_with(table, more), xrefs=xrefs)
    want = {1: ("B", "exact", 1.0, False), 2: ("AAAAAAAAAAAAAA-X", "block", 0.9, False), 3: ("AAAAAAAAAAAAAA-X", "name", 0.85, False), 4: ("B", "abbreviation", 0.9, True), 5: ("E", "fuzzy", 0.7, True), 7: ("AAAAAAAAAAAAAA-Y", "structure", 0.5, True), 8: ("C", "xref", 0.6, True)}
    rows = got.collect()
    assert len(rows) == len(records)
    for x in rows:
        assert tuple(x)[1:] == want.get(x.record_id, (None, None, 0.0, False)), x
    assert match_records(r.limit(0), e, record_id="id", key="key", name="name").count() == 0
    assert match_records(r, e.limit(0), record_id="id", key="key", name="name", fuzzy=None).where("match is not null").count() == 0


def test_shortest_paths_by_brute_force(spark):
    from lodestone.operators.paths import neighbourhoods, shortest_paths

    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(1, 1), (None, 3), (4, None), (7, 8), (7, 8), (8, 7)] + [(100 + i, 101 + i) for i in range(8)]
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(120)] + [(3, 3), (None, 1), (5, None), (999, 1), (999, 999), (100, 105), (100, 106), (105, 100)]
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s, t in pairs:
        if s is None or t is None:
            continue
        front = [[s]]
        for _ in range(6):
            if hits := [p for p in front if p[-1] == t]:
                want[s, t] = min(hits)
                break
            front = [[*p, n] for p in front for n in sorted(near.get(p[-1], ())) if n not in p]
    e, p = (spark.createDataFrame(x, f"{n[0]} long, {n[1]} long") for x, n in ((edges, ("a", "b")), (pairs, ("source", "target"))))
    got = {(r.source, r.target): r.path for r in shortest_paths(e, p, max_depth=5).collect()}
    assert got == {k: v for k, v in want.items() if len(v) <= 6}
    assert shortest_paths(e.limit(0), p).where("length > 0").count() == 0 and shortest_paths(e, p.limit(0)).count() == 0
    around = {(r.start, r.node): tuple(r)[2:] for r in neighbourhoods(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (3, 5), (5, None)], "a long, b long"), spark.createDataFrame([(1,), (1,), (None,), (77,)], "node long")).collect()}
    assert around == {(1, 1): (0, 0, 0), (1, 2): (1, 1, 2), (1, 3): (1, 2, 1), (1, 4): (1, None, 1), (77, 77): (0, 0, 0)}


def test_top_products_against_numpy(spark):
    import numpy as np

    from lodestone.operators.vectors import top_products

    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(70, 6)), 2)
    v[10] = v[11]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [1.0]), (903, [float("nan")] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").withColumns({c: F.lit("z") for c in ("rank", "side", "p", "q", "score")})
    for block in (2048, 16):
        got = top_products(frame.where("id < 20 or id >= 900 or id is null"), frame, k=4, attention=True, block=block)
        own = {}
        for r in got.collect():
            own.setdefault(r.query_id, []).append((r["rank"], r.id, r.score, r.weight))
        assert set(own) == set(range(20))
        for i in range(20):
            s = v @ v[i] / 6**0.5
            s[i] = -np.inf
            best = sorted(range(70), key=lambda j: (-s[j], j))[:4]
            weight = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            assert [x[:2] for x in sorted(own[i])] == [(n, j) for n, j in enumerate(best, 1)]
            assert np.allclose([x[2:] for x in sorted(own[i])], [(s[j], weight[j]) for j in best])
    assert top_products(frame.limit(0), frame).count() == 0 and top_products(frame, frame.limit(0)).count() == 0


def test_temperature_is_the_least_loss(spark):
    import numpy as np

    from lodestone.operators.vectors import fitted_temperature

    rng = np.random.default_rng(7)
    rows = []
    for name, t in (("a", 0.5), ("b", 3.0), (None, 1.0)):
        z = rng.normal(size=600) * 3
        rows += [(name, float(x), int(rng.random() < 1 / (1 + np.exp(-x / t)))) for x in z]
    rows += [("one", 2.0, 1), ("one", 3.0, 1), ("zero", 0.0, 1), ("zero", 0.0, 0), ("a", None, 1), ("a", 1.0, None), ("a", 1.0, 7), ("a", float("nan"), 1), ("gone", None, 1)]
    got = {r.k: (r.temperature, r.loss_before, r.loss_after, r.n) for r in fitted_temperature(spark.createDataFrame(rows, "k string, z double, y int"), "z", "y", by="k").collect()}
    assert set(got) == {"a", "b", None, "one", "zero"} and 0.05 <= got["one"][0] < 0.2 and got["zero"][0] == 1
    for name in ("a", "b", None):
        own = np.array([(z, y) for k, z, y in rows if k == name and z is not None and z == z and y in (0, 1)])
        loss = lambda t, own=own: np.mean(np.logaddexp(0, own[:, 0] / t) - own[:, 1] * own[:, 0] / t)
        grid = np.exp(np.linspace(np.log(0.1), np.log(10), 4000))
        best = grid[np.argmin([loss(t) for t in grid])]
        assert got[name][0] == pytest.approx(best, rel=2e-3) and got[name][2] == pytest.approx(loss(best), abs=1e-6) and got[name][1] == pytest.approx(loss(1.0)) and got[name][3] == len(own)
    assert fitted_temperature(spark.createDataFrame([], "z double, y int"), "z", "y").count() == 0


def test_sqlite_partitions_and_filters(spark, tmp_path):
    import sqlite3

    from lodestone.sources.sql_source import SqliteReader, condition, read_sqlite, write_sqlite
    from pyspark.sql import types as T
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains

    rows = [(i, f"n'{i % 5}" if i % 7 else None, i / 4 if i % 3 else None) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, name string, value double")
    written = write_sqlite(frame, f"file://{tmp_path}/files", "a \"table\"", files=3).collect()
    assert sum(r.rows for r in written) == 1000 and len({r.file for r in written}) == 3
    assert sum(r.rows for r in write_sqlite(frame, f"{tmp_path}/files", "a \"table\"", files=3).collect()) == 1000  # again: the same files
    found = read_sqlite(spark, f"{tmp_path}/files", "a \"table\"", rows=100)
    assert found.dtypes == frame.dtypes and found.rdd.getNumPartitions() >= 10
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, frame.collect()))
    kept = found.where((F.col("id") > 100) & F.col("name").isin("n'1", "n'2") & F.col("value").isNotNull() & F.col("name").contains("1"))
    assert {r.id for r in kept.collect()} == {i for i, n, v in rows if i > 100 and n == "n'1" and v is not None}
    reader = SqliteReader(T.StructType.fromDDL("id long, name string"), {"table": "a \"table\"", "path": f"{tmp_path}/files", "rowspartition": "100"})
    assert [type(f).__name__ for f in reader.pushFilters([GreaterThan(("id",), 990), In(("name",), ("n'1",)), StringContains(("name",), "1"), IsNotNull(("id",)), EqualTo(("value",), 1.5)])] == ["StringContains", "EqualTo"]
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == sum(i > 990 and n == "n'1" for i, n, _ in rows)
    assert condition(EqualTo(("a", "b"), 1)) is None and condition(EqualTo(("a",), True)) is None
    with sqlite3.connect(f"{tmp_path}/gaps.sqlite") as db:
        db.execute("CREATE TABLE t (x INT, y TEXT)")
        db.executemany("INSERT INTO t (rowid, x, y) VALUES (?, ?, ?)", [(1, 1, "a"), (10**9, 2, None)])
        db.execute("CREATE TABLE none (x INT)")
    assert sorted(map(tuple, read_sqlite(spark, f"{tmp_path}/gaps.sqlite", "t", rows=10**8).collect())) == [(1, "a"), (2, None)]
    assert read_sqlite(spark, f"{tmp_path}/gaps.sqlite", "none").count() == 0


def test_nested_levels_on_odd_records(spark):
    from lodestone.sources.nested import Level, child_tables, interactions, parsed_once

    texts = ['{"id": 1, "in": {"xs": [{"n": "a", "ys": [{"m": 1}, null, {"m": 2}]}, null, {"n": null, "ys": []}]}}', '{"id": 2, "in": null}', '{"id": 3, "in": {"xs": []}}', "{broken", None, '{"in": {"xs": []}}']
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    records, broken = parsed_once(frame, "text", "id bigint, in struct<xs: array<struct<n: string, ys: array<struct<m: int>>>>>", id="id")
    assert sorted(r.id for r in records.collect()) == [1, 2, 3] and sorted(str(r.text) for r in broken.collect()) == sorted(map(str, texts[3:]))
    tables = child_tables(records, {"x": Level("in.xs", {"n": "item.n"}, {"y": Level("ys", {"m": "item.m"})})})
    assert sorted(map(tuple, tables["x"].collect())) == [(1, 0, "a"), (1, 2, None)] and sorted(map(tuple, tables["y"].collect())) == [(1, 0, 0, 1), (1, 0, 2, 2)]
    pairs = spark.createDataFrame([(1, 2, None), (2, 1, "z"), (1, 1, "q"), (1, None, "q"), (1, 9, "q"), (2, 1, "b")], "id long, other long, why string")
    good, bad = interactions(pairs, records, id="id", other="other", text="why")
    assert [tuple(r) for r in good.collect()] == [(1, 2, "b")] and sorted(r.reason for r in bad.collect()) == ["itself", "no other", "unknown"]


def test_replaced_partitions_keep_other_files(spark, tmp_path):
    import os

    from lodestone.sources.sinks import replace_partitions

    path = f"{tmp_path}/table"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x long, k string").write.partitionBy("k").parquet(path)
    files = lambda k: sorted(os.listdir(f"{path}/k={k}"))
    before = files("b"), files("__HIVE_DEFAULT_PARTITION__")
    table = spark.read.schema("x long, k string").parquet(path)
    with pytest.raises(ValueError, match=r"small \(1\)"):
        replace_partitions(table.withColumn("x", F.when(F.col("x") > 1, F.col("x"))), path, ["k"], {"small": F.col("x") > 0})
    assert sorted(map(str, (r.x for r in table.collect()))) == ["1", "2", "3"]
    done = replace_partitions(table.where("k = 'a'").withColumn("x", F.col("x") + 9).unionByName(spark.createDataFrame([(5, "new")], "x long, k string")), path, ["k"], {"small": F.col("x") > 0})
    assert sorted((r.k, r.rows) for r in done.collect()) == [("a", 1), ("new", 1)]
    assert sorted((str(r.k), r.x) for r in spark.read.schema("x long, k string").parquet(path).collect()) == [("None", 3), ("a", 10), ("b", 2), ("new", 5)]
    assert (files("b"), files("__HIVE_DEFAULT_PARTITION__")) == before
