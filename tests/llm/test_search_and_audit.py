"""SimHash components by brute force, ranked search and divergence against plain definitions on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import queries
from lodestone.llm.divergence import shares, source_divergence
from lodestone.llm.lexical import lengths, rank_documents
from lodestone.llm.simhash import Forest, blocks_for, fingerprints, linked_fingerprints, shard_masks, simhash_components
from tests.test_registry import FOLDER

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    """{value: set of its component}, by comparing all with all."""
    values = np.array(sorted(set(values)), np.uint64)
    label = np.arange(len(values))
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius)
        for x in set(label[near].tolist()):
            label[label == x] = label[i]
    return {int(v): int(k) for v, k in zip(values, label, strict=True)}


def held(rows):
    """doc_id -> (fingerprint, component_id) by definition."""
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    group = plain_components([p for d, p in prints if d is not None], 4)
    least = {}
    for d, p in prints:
        if d is not None:
            least[group[p]] = min(d, least.get(group[p], d))
    return sorted((d is None, d, f"{p:016x}", None if d is None else least[group[p]]) for d, p in prints)


def rows_of(frame):
    return sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in frame.collect())


def test_op12_by_brute_force(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    got = queries.op12_simhash(spark, FOLDER)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert rows_of(got) == held(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)))


def test_simhash_on_odd_rows(spark):
    long = "a word of many " * 40000
    rows = [(5, "x y"), (3, "X  y"), (9, None), (8, " \n"), (7, ""), (1, long), (2, long + "end"), (4, "a b c d"), (4, "a b c d"), (4, "other words stand in this one here"), (6, "é ü Ä ß")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    more = frame.withColumns({c: F.lit("z") for c in ("value", "fingerprint", "component_id", "node", "key", "choice")})
    assert rows_of(simhash_components(more)) == held(rows)
    assert simhash_components(frame.limit(0)).count() == 0
    none = simhash_components(spark.createDataFrame([(None, "x y"), (5, "x y")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in none) == [(0, 0), (5, 5)]
    assert fingerprints(pa.array(["one two three"], pa.string())).tolist() == [plain_fingerprint("one two three")]


@pytest.mark.parametrize("blocks", [5, 6, 7])
@pytest.mark.parametrize("tree", [5, 40, 8192])
def test_links_of_balls(spark, blocks, tree):
    rng = np.random.default_rng(blocks * 100 + tree)

    def near(centre, flips):
        for b in rng.choice(64, flips, replace=False):
            centre ^= 1 << int(b)
        return centre

    centres = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    values = [near(c, int(f)) for c in centres for f in rng.integers(0, 7, 40)] + [int(x) for x in rng.integers(0, 1 << 63, 60)] + [0, (1 << 64) - 1]
    values = sorted(set(values))
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in linked_fingerprints(frame, 4, blocks=blocks, tree=tree).collect()}
    got |= {c: c for c in got.values()}  # a component's smallest node is no row of its own
    want = plain_components(values, 4)
    size = Counter(want.values())
    assert set(got) == {v for v in values if size[want[v]] > 1}
    assert len({(got[v], want[v]) for v in got}) == len(set(got.values())) == len({want[v] for v in got})


def test_forest_finds_every_neighbour():
    rng = np.random.default_rng(1)
    unit = np.sort(rng.integers(0, 4, 300))
    values = rng.permutation(1 << 10)[:300].astype(np.uint64)
    forest, root = Forest(values, unit), np.searchsorted(unit, unit)
    found = {(int(q), int(n)) for a, b in forest.search(values, root, 3) for q, n in zip(a, b, strict=True)}
    assert found == {(i, j) for i in range(300) for j in range(300) if unit[i] == unit[j] and int(values[i] ^ values[j]).bit_count() <= 3}


def test_masks_cover_the_radius():
    for blocks in (5, 6, 7):
        masks = [m % (1 << 64) for m in shard_masks(blocks, 4)]
        edges = [64 * i // blocks for i in range(blocks + 1)]
        for hit in range(1 << blocks):
            if hit.bit_count() <= 4:
                flips = sum(1 << edges[i] for i in range(blocks) if hit >> i & 1)
                assert any(flips & m == 0 for m in masks)
    assert [blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**12)] == [5, 5, 6, 7]


def test_shares_are_exact():
    counts, total = np.array([[0, 1, 10**15], [7, 3 * 10**15, 5]]), np.array([10**15 + 1, 4 * 10**15])
    want = [[1 + 10**9 * (int(c) + 5) // (int(n) + 15) for c in row] for row, n in zip(counts, total, strict=True)]
    assert shares(counts, total, 3).tolist() == want


def plain_divergence(rows, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    docs, count, total = Counter(), {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = terms(text)
        docs.update((lang, t) for t in set(own))
        count.setdefault((lang, source), Counter()).update(own)
        total.setdefault(lang, Counter()).update(own)
    out = []
    share = lambda c, kept, t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))
    for (lang, source), c in count.items():
        kept = [t for t in total[lang] if docs[lang, t] >= least]
        pairs = [(sum(abs(share(c, kept, t) - share(o, kept, t)) for t in kept), s) for (m, s), o in count.items() if m == lang and s != source]
        more = [(share(c, kept, t) - share(total[lang], kept, t), t) for t in kept if c[t]]
        for part, found, limit in (("pair", pairs, None), ("term", [x for x in more if x[0] > 0], top)):
            out += [(lang, source, part, item, v, i) for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit], 1)]
    return sorted(out)


def test_divergence_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = ["Ab", "cd", "é", "日本", "x1y", "zz", "q", "ß-t", "ab"]
    rows = [(" ".join(rng.choice(words, int(rng.integers(0, 9)))), *[str(x) for x in rng.choice(["en", "de"], 1)], f"s{int(rng.integers(0, 7))}") for _ in range(150)]
    rows += [(None, "en", "s0"), ("ab", None, "s1"), ("ab ab", None, None), ("", "xx", "only"), ("only once", "fr", "a"), ("7 8", "fr", None), ("ab " * 30000, "en", "s9"), ("ab", "en", "s9"), ("ab", "en", "s9")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("n", "term", "kind", "tile", "block", "value", "rank", "size")}).repartition(3)
    want = plain_divergence(rows, 3, 4)
    for how in ({}, {"terms": 2, "groups": 2}, {"terms": 3, "groups": 3}):
        got = source_divergence(frame, min_docs=3, top=4, **how)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert source_divergence(frame.limit(0)).count() == 0


def plain_ranking(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for i, ts in asked.items():
        found = []
        for d, c, size in own:
            m = 100 - 25 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in ts if c[t])
            if s > 0 and d is not None and i is not None:
                found.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_ranking_on_odd_rows(spark):
    rng = np.random.default_rng(5)
    words = ["Ab", "cd", "é", "日本", "x1y", "zz", "q", "ß-t", "ab", "rare1", "rare2"]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(int(rng.integers(-50, 50)) * 10**14, text(int(rng.integers(0, 12)))) for _ in range(200)]
    docs += [(None, "ab cd"), (3, None), (4, ""), (5, "ab " * 20000), (6, "only"), (7, "ab cd q"), (8, "ab cd q"), (8, "ab cd q")]
    items = [(1, "ab Q q rare1"), (2, None), (3, ""), (None, "ab"), (4, "unheard of"), (5, "only é 日本"), (6, "zz"), (6, "zz cd"), (7, "ab " * 50)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "term", "times", "item_id", "score", "rank")}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "term", "times", "doc_id")})
    want = plain_ranking(docs, items, 5)
    for how in ({}, {"window": 7}, {"block_items": 2, "window": 64}, {"vocabulary": 3, "block_terms": 4}):
        got = rank_documents(d, i, k=5, **how)
        assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == want, how
    assert rank_documents(d.limit(0), i).count() == 0 and rank_documents(d, i.limit(0)).count() == 0


def test_lengths_beyond_64_bits():
    assert lengths(np.array([10**9, 3]), 10**12, 10**13).tolist() == [75 + 25 * 10**9 // 10, 75 + 75 // 10]
