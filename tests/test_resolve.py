"""Fuzzy matching against all pairs on small tables."""

import random

from pyspark.sql import functions as F

from lodestone.operators import resolve as E


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 2 * common(a, b) / (len(a) + len(b))


def threshold(name):
    n = len(name)
    return 1.0 if n < 4 else 0.92 if n < 8 else 0.88 if n <= 14 else 0.85


def names(n, seed):
    rng = random.Random(seed)
    stems = ["acid", "acetic", "sodium", "benzo", "ate", "chloride", "ben", "x", "ab", "aaaa", "methyl", "di"]
    out = []
    for _ in range(n):
        s = list(rng.choice(" -").join(rng.choice(stems) for _ in range(rng.randint(1, 4))))
        for _ in range(rng.choice([0, 0, 1, 2])):
            s[rng.randrange(len(s))] = rng.choice(["", "q", "e", "aa"])
        out.append("".join(s).strip() or "y")
    return out


def test_alike_names_are_all_found(spark):
    left, right = sorted(set(names(400, 1))), sorted(set(names(500, 2)))
    got = {(r["r"], r["e"]): r["s"] for r in E.alike_names(spark.createDataFrame([(x,) for x in [*left, None, "", " "]], "r string"), spark.createDataFrame([(x,) for x in [*right, None, ""]], "e string")).collect()}
    want = {(a, b): ratio(a, b) for a in left for b in right if ratio(a, b) >= threshold(a)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 40


def test_cascade_by_hand(spark):
    entities = [(f"K{i:04d}", x) for i, x in enumerate(names(200, 5))] + [("K9999", "acetic acid"), ("K9998", None)]
    records = [(i, f"R{i}", x) for i, x in enumerate(names(120, 6))] + [(500, "R500", "acid acetik"), (501, None, None), (502, "K9999", None), (502, "K9999", None)]
    frames = spark.createDataFrame(records, "id int, k string, nm string"), spark.createDataFrame(entities, "k string, nm string")
    got = sorted(((r["record_id"], r["match"], r["method"]) for r in E.cascade(*frames, record_id="id", key="k", name="nm", block=6).collect()), key=str)
    keys = {}
    for k, x in entities:
        if x is not None:
            keys.setdefault(x, set()).add(k)
    single = {x: min(ks) for x, ks in keys.items() if len(ks) == 1}
    want = []
    for i, k, x in records:
        if k == "K9999":
            want.append((i, k, "exact"))
        elif x is None:
            want.append((i, None, None))
        elif x in single:
            want.append((i, single[x], "name"))
        else:
            near = sorted(((ratio(x, e), e) for e in single if ratio(x, e) >= threshold(x)), reverse=True)
            sure = near and (len(near) == 1 or near[0][0] - near[1][0] > 0.01 + 1e-9)
            want.append((i, single[near[0][1]], "fuzzy") if sure else (i, None, None))
    assert got == sorted(want, key=str)
    assert any(m == "fuzzy" for _, _, m in got)


def test_similarity_ignores_order(spark):
    row = spark.createDataFrame([("acetic acid", "acid acetic", None)], "a string, b string, c string").select(E.similarity(F.col("a"), F.col("b")).alias("x"), E.similarity(F.col("a"), F.col("c")).alias("y")).first()
    assert row["x"] == 1.0 and row["y"] is None


def test_alike_names_by_blocks_and_by_join(spark):
    """Both ways find what brute force does, with repeated letters, other alphabets, long names and a group to stay in."""
    rng = random.Random(9)
    long = ["".join(rng.choice("ab 1é𝛼") for _ in range(rng.randint(60, 90))) for _ in range(25)]
    left, right = ([(x, g) for x in sorted({*names(150, s), *(x[:i] + "z" + x[i:] for i, x in enumerate(long)), *long[:5], "a", "b", "aa", " a  b "}) for g in ("u", "v")] for s in (1, 2))
    right = [x for x in right if hash(x[1]) is not None and len(x[0]) % 7 > 0] + [("acid", "w"), ("acid", None)]
    l = spark.createDataFrame([*left, (None, "u"), ("", "v"), ("acid", None)], "r string, g string")
    r = spark.createDataFrame(right, "e string, g string")
    for base in (0.85, 0.6):
        want = {(a, b, g): ratio(a, b) for a, g in left for b, h in right if g == h and ratio(a, b) >= max(base, threshold(a) if len(a) <= 14 else base)}
        for blocks in (True, False, None):
            got = {(x.r, x.e, x.g): x.s for x in E.alike_names(l, r, base=base, within="g", blocks=blocks).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_names_without_rare_letters_are_not_joined(spark):
    """Digests share their pairs of letters with most others: the plan has no join that would meet these pairs."""
    own = spark.range(300).select(F.md5(F.col("id").cast("string").cast("binary")).alias("e"))
    near = E.alike_names(own.select(F.concat("e", F.lit("x")).alias("r")), own)
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.where(F.col("r") == F.concat("e", F.lit("x"))).count() == near.count() == 300
