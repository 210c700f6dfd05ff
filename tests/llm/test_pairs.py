"""Near duplicates, repeated strings, top-k products against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.near_dedup import near_duplicates, one_per_group
from lodestone.llm.suffix_dedup import repeated_strings
from lodestone.llm.topk import top_k_products


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def families(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 2, 3, 6, 9, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, " \t\n")]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rows = families(k)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n_shingles int")
    got = {r["doc_id"]: r for r in near_duplicates(docs, shingle=k, percent=percent).collect()}
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    kept = one_per_group(docs, shingle=k, percent=percent)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if find(i) == i)


def test_near_duplicates_large_group(spark):
    """A family whose members link only through some others, larger than a block."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(700):
        copy = list(base)
        for i in rng.sample(range(60), rng.choice([0, 1, 2, 3])):
            copy[i] = f"x{rng.randrange(400)}"
        rows.append((n, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, shingle=3, percent=85).collect()}
    sets = [shingles(t, 3) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
    assert got == dict(enumerate(label))


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "a b c d")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()), key=str)
    assert got == [(7, 7, True), (7, 7, True), (9, 7, False), (None, None, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


def removed_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("length", [64, 100, 400])
def test_repeated_strings(spark, length):
    rng = random.Random(length)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [noise(n) for n in (length - 3, length - 1, length, length + 1, 3 * length, 900)]
    texts = [None, "", "a" * 1500, "ab" * 700, noise(50), passages[2], passages[4], passages[4]]
    for _ in range(40):
        text = noise(rng.randint(0, 500))
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            text += p[a : len(p) - rng.randint(0, len(p) // 3)] + noise(rng.randint(0, 300))
        texts.append(text)
    line = noise(70) + "\n"
    texts += [line * 30, noise(10) + line * 3, texts[-1]]
    rows = [(i, t, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string").repartition(3)
    got = {r["doc_id"]: r for r in repeated_strings(docs, length=length).collect()}
    want = dict(enumerate(removed_by_hand(texts, length)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    for i, r in got.items():
        assert r["doc"] == "z" and sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True)) == want[i][1]


def test_repeated_strings_edges(spark):
    docs = spark.createDataFrame([(None, "q" * 500), (None, "r" * 399), (1, "xyz" * 200), (1, "xyz" * 200)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in repeated_strings(docs).collect()) == [0, 500, 600, 600]
    assert repeated_strings(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeated_strings(docs, length=10)


@pytest.mark.parametrize("shape", ["unit", "skewed", "integers"])
def test_top_k(spark, shape):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if shape == "unit" else x * rng.pareto(1.0, (600, 1)) if shape == "skewed" else np.round(x)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [float("nan")] * 8), (602, [None] * 8), (620, [1.0, 2.0]), (640, [3.0, -1.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k_products(frame, F.col("vec_id") % 20 == 0, k=7, scale=64).orderBy("query_id", "rank").collect()]
    q = {i: np.floor(64 * np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for i in sorted(k for k in q if k % 20 == 0):
        scores = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))
        want += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:7], 1)]
    assert got == want
    assert top_k_products(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
