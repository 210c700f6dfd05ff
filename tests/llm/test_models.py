"""Toxicity, quality, licences and the pipeline: held-out accuracy and brute force on small tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import licenses, quality, queries, toxicity
from lodestone.llm.linear import logistic, sigmoid
from tests.test_registry import FOLDER

WORDS = ["".join(random.Random(i).choice("bcdfglmnprst") + random.Random(i * 7 + k).choice("aeiou") for k in range(3)) for i in range(400)]
BAD = ["zorkface", "grumblewit", "snarlpox", "vilehead"]


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.choice([5, 30, 120, 400]))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        poor = rng.random() < 0.3
        text = " ".join(w + rng.choice(["***", "%%%"]) for w in words) if poor else " ".join(words)
        out.append((i, text, rng.choice(["en", "fr"]), f"s{i % 5}", int(toxic), int(not poor)))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = texts(900, 3)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[5], r[4]) for r in rows if r[0] < 600], "doc_id long, quality int, toxic int")
    return rows, docs.cache(), labels.cache()


def test_toxicity_held_out(spark, corpus):
    rows, docs, labels = corpus
    model = toxicity.train_toxicity(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [r for r in rows if r[0] >= 600]
    right = np.mean([(got[r[0]] >= 0.5) == bool(r[4]) for r in held])
    assert right > 0.95
    again = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs.withColumnRenamed("source", "toxicity"), model).collect()}
    assert again == got
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "zorkface " * 50_000), (4, "!!! 123")], "doc_id long, text string")
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(odd, model).collect()}
    assert scores[1] == scores[2] == scores[4] < 0.5 < scores[None]


def test_toxicity_without_labels(spark, corpus):
    _, docs, labels = corpus
    for own in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.train_toxicity(docs, own)
        assert toxicity.score_toxicity(docs, model).agg(F.max("toxicity")).first()[0] < 0.5
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_quality_held_out(spark, corpus):
    rows, docs, labels = corpus
    model = quality.train_quality(docs, labels)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(docs, model).collect()}
    assert np.mean([(got[r[0]] >= 0.5) == bool(r[5]) for r in rows if r[0] >= 600]) > 0.97
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "en", "s0"), (None, "a " * 200_000, "xx", None)], docs.schema)
    assert all(0 <= r["quality_score"] <= 1 for r in quality.score_quality(odd, model).collect())
    assert quality.score_quality(odd, model, keep_text=True).columns == [*odd.columns, "text_score", "meta_score", "quality_score"]
    only = quality.train_quality(docs, labels.where("quality = 1"))
    assert quality.score_quality(docs, only).agg(F.min("quality_score")).first()[0] > 0.5
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_logistic():
    z = np.linspace(-6, 6, 400)
    y = (np.random.default_rng(0).random(400) < sigmoid(2 * z - 1)).astype(float)
    noise = np.random.default_rng(1).normal(size=400)
    b, a, none = logistic(np.stack([z, noise], 1), y, np.ones(400))
    assert 1 < a < 4 and -3 < b < 0.5 and 0 <= none < 1
    assert logistic(-z[:, None], y, np.ones(400))[1] == 0


def test_quality_counts_by_hand(spark):
    """A round's counts in Spark against plain loops over the rows."""
    rows = [(i, t, lang, source, len(t)) for i, t, lang, source, *_ in texts(120, 8)] + [(500, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string, source string, n_chars long").repartition(3)
    base = docs.select((F.col("id") % 3).alias("fold"), F.when(F.col("id") < 60, F.col("id") % 2).otherwise(-1).cast("long").alias("label"), *quality._named(docs, "text", "lang", "source", "n_chars"))
    rows = base.collect()
    columns = [pa.array([float(r[c]) if c == "size" else r[c] for r in rows]) for c in ("lang", "source", "size")]
    meta = quality._meta(pa.RecordBatch.from_arrays(columns, names=["lang", "source", "size"]), 0).tolist()
    assert all(m[:2] == [r["lang"], r["source"]] and m[2] == int(quality.size_class(np.array([r["size"]]))[0]) for m, r in zip(meta, rows, strict=True))
    assert len({tuple(m[3:]) for m in meta}) == len({tuple(m[:3]) for m in meta})
    local = [(r["fold"], r["label"], r["text"], m) for r, m in zip(rows, meta, strict=True)]

    def features(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.array([0, len(raw)])
        return quality.trigrams(raw, ends), quality.layout_classes(quality.layout(raw, ends))[0]

    def plain(pick, fold):
        c = quality.Counts.none()
        for own, label, text, meta in local:
            if own != fold:
                continue
            grams, classes = features(text)
            for_text, for_meta = pick(label, grams, classes, meta)
            c.docs += [[for_text == 0, for_text == 1], [for_meta == 0, for_meta == 1]]
            if for_text >= 0:
                for g in grams:
                    c.grams[for_text, g] += 1 / len(grams)
                for k, v in enumerate(classes):
                    c.layout[for_text, k, v] += 1
            if for_meta >= 0:
                for k, v in enumerate(meta):
                    c.meta[for_meta, k, v] += 1
        return c

    def close(a, b):
        assert all(np.allclose(x, y) for x, y in zip(a.arrays(), b.arrays(), strict=True))

    parts = quality._counts(base.where("label >= 0"))
    for fold in range(3):
        close(parts[fold], plain(lambda label, *_: (label, label), fold))
    views = quality.Views.of(quality._added(*parts.values()), 0.5)
    views.text_scale = views.meta_scale = (0.1, 0.8)
    limits = quality.Sure(-0.5, 0.7), quality.Sure(-0.1, 0.2)

    def told(label, grams, classes, meta):
        if label >= 0:
            return -1, -1
        text = quality.GRAM_WEIGHT * (np.mean([views.grams[g] for g in grams]) if len(grams) else 0) + sum(views.layout[k, v] for k, v in enumerate(classes))
        page = views.prior + sum(views.meta[k, v] for k, v in enumerate(meta))
        say = lambda z, own: 1 if 0.1 + 0.8 * z >= own.high else 0 if 0.1 + 0.8 * z <= own.low else -1
        return say(page, limits[1]), say(text, limits[0])

    found = quality._counts(base.where("label < 0"), views, limits)
    for fold in range(3):
        close(found[fold], plain(told, fold))


def test_pseudo_labels_and_their_worth():
    z, weight = np.array([-9.0, -3, -1, 0, 1, 2, 8]), np.ones(7)
    limits = quality.Sure.of(z, weight, 0.97, 0.1)
    assert (limits.low, limits.high) == pytest.approx((-np.log(0.97 / 0.03), np.log(0.97 / 0.03)))  # all that is sure, though more than a tenth
    assert quality.Sure.of(z / 10, weight, 0.97, 0.1) == quality.Sure(-0.9, 0.8)  # nothing is sure: the surest of each kind
    assert quality.Sure.of(np.zeros(7), weight, 0.97, 0.1).picked(np.zeros(7)).tolist() == [-1] * 7
    picked, y = np.array([1] * 40 + [0] * 10 + [-1] * 50), np.array([1] * 40 + [0] * 30 + [1] * 30)
    zero, one = quality.worth(picked, y, np.ones(100))
    assert zero == pytest.approx(((10 + 0.3) / 11 - 0.3) / 0.7) and one == pytest.approx(((40 + 0.7) / 41 - 0.7) / 0.3)
    assert quality.worth(1 - picked, y, np.ones(100))[1] == 0.0


def test_quality_views_exchange(spark):
    """Both views give pseudo-labels on the small tables, and the query scores as whole rows do; without a trained column it raises."""
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.train_quality(docs, labels.where(~queries.held_out()))
    for view in ("text", "metadata"):
        assert sum(n for v, _, n, _ in model.exchanged if v == view) > 0
    want = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(docs, model).collect()}
    got = {r["doc_id"]: r["score"] for r in queries.op9_quality(spark, FOLDER).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)
    with pytest.raises(ValueError, match="n_chars"):
        quality.score_quality(docs.drop("n_chars"), model)


def test_risks_and_steps_by_hand(spark):
    """Sums over patterns in Spark against the definition on single texts, and a step against numerical gradients."""
    rng = np.random.default_rng(4)
    x = (rng.random((40, 5)) < 0.3).astype(float)
    positive, prior, w = np.arange(40) < 9, 0.2, rng.normal(size=6)
    rows = [(np.flatnonzero(r).astype(np.int32).tobytes(), int(p), int(not p)) for r, p in zip(x, positive, strict=True)]
    patterns = spark.createDataFrame([(bytearray(a), b, c) for a, b, c in rows], "pattern binary, positive long, unlabelled long")
    summed = toxicity._summed(patterns)
    loss = lambda w, of, sign: np.logaddexp(0, sign * (x[of] @ w[:5] + w[5]))

    def gradient(f):
        return np.array([(f(w + 1e-6 * e) - f(w - 1e-6 * e)) / 2e-6 for e in np.eye(6)])

    total = summed(w)
    parts = (lambda v: loss(v, positive, -1).sum(), lambda v: loss(v, positive, 1).sum(), lambda v: loss(v, ~positive, 1).sum())
    assert np.allclose(total[-3:], [f(w) for f in parts])
    assert np.allclose(total[:18], np.concatenate([gradient(f) for f in parts]), atol=1e-4)
    seen = []
    toxicity.nnpu(lambda v: seen.append(v.copy()) or summed(v), 5, 9, 31, prior, steps=3)
    for before, after in zip(seen[:-1], seen[1:], strict=True):
        w = before
        clean = lambda v: loss(v, ~positive, 1).mean() - prior * loss(v, positive, 1).mean()
        g = gradient(lambda v: prior * loss(v, positive, -1).mean() + clean(v)) if clean(w) >= 0 else -gradient(clean)
        if before is seen[0]:  # the first step of Adam goes against the gradient's signs
            assert (np.sign(after - before) == -np.sign(g)).all()


def test_toxicity_prior(spark, corpus):
    """Labels that aren't a random sample: the share of toxic texts can be given."""
    rows, docs, labels = corpus
    model = toxicity.train_toxicity(docs, labels.where("toxic = 1 or doc_id % 5 = 0"), prior=0.25)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert model.prior == 0.25 and np.mean([(got[r[0]] >= 0.5) == bool(r[4]) for r in rows]) > 0.95


def test_models_clashing_names(spark, corpus):
    _, docs, labels = corpus
    model = toxicity.train_toxicity(docs, labels)
    odd = docs.select("*", *[F.lit(1).alias(c) for c in ("_text", "id", "label", "mark", "c0", "size")])
    scored = toxicity.score_toxicity(odd, model)
    assert scored.columns == [*[c for c in odd.columns if c != "text"], "toxicity"] and scored.count() == docs.count()
    scored = quality.score_quality(odd, quality.train_quality(odd, labels))
    assert scored.columns == [*[c for c in odd.columns if c != "text"], "text_score", "meta_score", "quality_score"] and scored.count() == docs.count()
    assert quality.score_quality(docs, quality.train_quality(docs, labels.limit(0))).where("quality_score <> 0.5").count() == 0


def cosine_by_hand(text, kind):
    import math

    def terms(t):
        return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())

    wordings = [(k, n, terms(t)) for k, n, t in licenses.templates()]
    df = {}
    for _, _, ws in wordings:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    idf = lambda w: math.log((1 + len(wordings)) / (1 + df.get(w, len(wordings) / 10))) + 1
    vec = lambda ws: {w: (1 + math.log(ws.count(w))) * idf(w) for w in set(ws)}
    own, best = vec(terms(text)), {}
    for k, name, ws in wordings:
        if k == kind:
            v = vec(ws)
            dot = sum(x * v.get(w, 0) for w, x in own.items())
            length = math.sqrt(sum(x * x for x in own.values()) * sum(x * x for x in v.values()))
            best[name] = max(best.get(name, 0), dot / length if length else 0)
    score, name = min((-s, n) for n, s in best.items())
    return (name, -score) if -score >= 0.7 else (None, None)


def test_licenses(spark):
    lines = ["Released under the MIT License.", "Licensed under Apache License Version 2.0", "no terms here", "Copyright 2020 somebody. All rights reserved.", "a driver's license is needed to drive a car in most of the world", "", "# SPDX-License-Identifier: GPL-2.0-only", "this work is under a free public license of the author"]
    rows = [(i, f"first line\n{line}\r\nlast", f"a/b/f{i}") for i, line in enumerate(lines)]
    rows += [(10, None, "a/b/c/x"), (11, "plain", "a/b/c/d/y"), (12, "plain", "z/y"), (13, "plain", None), (14, "plain", "top"), (None, "plain", "a/q")]
    full = {name: text for kind, name, text in licenses.templates() if kind == licenses.FILE}
    rows += [(20, full["GPL-3.0"], "a/b/c/LICENSE"), (21, "Copyright (c) 2020 Jane Doe\n\n" + full["MIT"], "a/license.txt"), (12, "plain", "z/y")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, path string, license string, key int")
    got = [r.asDict() for r in licenses.scan_licenses(docs, F.col("path")).collect()]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, line in enumerate(lines):
        name, score = min((cosine_by_hand(x, licenses.HEADER) for x in ("first line", line, "last", rows[i][1])), key=lambda x: -(x[1] or 0))
        if "SPDX" in line:
            name, score = "GPL-2.0", 1.0
        if name:
            assert (by[i]["license"], by[i]["found"]) == (name, "own") and by[i]["similarity"] == pytest.approx(score, abs=1e-5)
        else:
            assert (by[i]["license"], by[i]["found"]) == ("MIT", "inherited")
    assert [by[i]["found"] for i in range(len(lines))] == ["own", "own", "inherited", "own", "inherited", "inherited", "own", "inherited"]
    assert [(by[i]["license"], by[i]["found"]) for i in (10, 11, 12, 13, 14, None, 20, 21)] == [("GPL-3.0", "inherited"), ("GPL-3.0", "inherited"), (None, None), (None, None), (None, None), ("MIT", "inherited"), ("GPL-3.0", "own"), ("MIT", "own")]
    assert licenses.scan_licenses(docs.limit(0), F.col("path")).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "path")
    assert {r["license"] for r in licenses.scan_licenses(named, F.col("path")).where("doc_id = 'd0'").collect()} == {"MIT"}


WRAPPED = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS."""
REAL = [
    ("MIT", "x/LICENSE", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n"),
    ("BSD-3-Clause", "x/COPYING", ""),
    ("Apache-2.0", "x/LICENSE.txt", ""),
    ("GPL-2.0", "x/LICENSE", ""),
    ("LGPL-3.0", "x/LICENSE", ""),
    ("MPL-2.0", "x/LICENSE", ""),
    ("CC-BY-SA-4.0", "x/LICENSE", ""),
]


def test_real_texts(spark):
    """Whole licence files with their own names and years, cut or edited, and wrapped headers of source files."""
    full = {name: text for kind, name, text in licenses.templates() if kind == licenses.FILE}
    rows = [(i, start + full[name].replace("Regents of the University of California", "Example Authors")[: max(900, len(full[name]) * 4 // 5)], path) for i, (name, path, start) in enumerate(REAL)]
    rows += [(20, WRAPPED + "\n\nimport os\n", "y/a.py"), (21, "/* SPDX-License-Identifier: MIT */\nint main;", "y/a.c"), (22, "Copyright (c) 2020 Jane Doe. All rights reserved.", "y/b.c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs, F.col("path")).collect()}
    assert [got[i] for i in range(len(REAL))] == [name for name, _, _ in REAL]
    assert (got[20], got[21], got[22]) == ("Apache-2.0", "MIT", "Proprietary")


def test_filter_loses_nothing():
    """Wordings of any terms of the templates: one that is like enough always has a telling term."""
    rng = random.Random(2)
    telling = re.compile(licenses._any_of(licenses.telling_terms(licenses.templates(), 0.7)))
    headers = [t for kind, _, t in licenses.templates() if kind == licenses.HEADER]
    for _ in range(400):
        words = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", rng.choice(headers).lower())
        text = " ".join(rng.sample(words, rng.randint(1, len(words))) + [rng.choice(words)] * rng.choice([0, 3]))
        assert cosine_by_hand(text, licenses.HEADER)[0] is None or telling.search(text)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = texts(300, 4)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    docs = [(r[0], r[1], r[2], r[3], len(r[1])) for r in rows]
    docs += [(1000 + i, docs[i][1], "en", "copy", docs[i][4]) for i in range(20)]
    docs += [(2000 + i, f"{docs[i][1]} {passage} {WORDS[i]}", "en", "shared", 0) for i in range(100, 110)]
    docs += [(3000, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[5], r[4]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    step, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, step, str(tmp_path))
        if k < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        step = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = step.collect()
    good = {r[0] for r in rows if r[5]}
    kept = {r["doc_id"] for r in seen["quality_classifier"]}
    assert len(good - kept) <= 3 and len({r[0] for r in rows if not r[5]} & kept) <= 3
    assert not {i for i in range(1000, 1020) if i - 1000 in kept} & {r["doc_id"] for r in seen["minhash_near_dedup"]}
    after = {r["doc_id"]: r["text"] for r in seen["suffix_array_dedup"]}
    assert set(after) == {r["doc_id"] for r in seen["minhash_near_dedup"]}
    assert not any(passage[20:-20] in (t or "") for t in after.values())
    assert sum(len(r["text"].split()) for r in seen["source_mixing"]) == pytest.approx(1.5 * sum(len((t or "").split()) for t in after.values()), abs=10)
    assert len(seen["bpe_tokens"]) == len(seen["source_mixing"])


BSD_HEADER = """/*
 * Copyright (c) 2019, Jane Doe
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *   * Redistributions of source code must retain the above copyright
 *     notice, this list of conditions and the following disclaimer.{more}
 */
int main() { return 0; }"""
NEITHER = """
 *
 * Neither the name of the copyright holder nor the names of its contributors may be used to
 * endorse or promote products derived from this software without specific prior written permission."""


def test_licences_that_are_alike(spark):
    """Headers and files of licences that share most of their words, and SPDX expressions."""
    full = {name: text for kind, name, text in licenses.templates() if kind == licenses.FILE}
    bsd3 = full["BSD-3-Clause"]
    bsd2 = bsd3[: bsd3.index("3. Neither")] + bsd3[bsd3.index("THIS SOFTWARE") :]
    cases = [
        (BSD_HEADER.replace("{more}", ""), "f1", "BSD-2-Clause", "BSD-2-Clause"),
        (BSD_HEADER.replace("{more}", NEITHER), "f2", "BSD-3-Clause", "BSD-3-Clause"),
        ("Copyright 2020 A. All rights reserved.", "f3", "Proprietary", "Proprietary"),
        ("Copyright (c) 2021 X\n" + bsd2, "a/LICENSE", "BSD-2-Clause", "BSD-2-Clause"),
        (bsd3, "b/LICENSE", "BSD-3-Clause", "BSD-3-Clause"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0", "f6", "Apache-2.0", "Apache-2.0,MIT"),
        ("/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 AND (MIT OR ISC)) */\nMIT License", "f7", "MIT", "GPL-2.0,ISC,MIT"),
        ("<!-- SPDX-License-Identifier: LGPL-2.1+ -->\nand OR more", "f8", "LGPL-2.1", "LGPL-2.1"),
        ("SPDX-License-Identifier: NOASSERTION\nSPDX-License-Identifier:\n", "f9", None, ""),
        ("SPDX-License-Identifier: Zlib and words after it", "f10", "Zlib", "Zlib"),
    ]
    cases += [(full[n], f"{n}/LICENSE", n, None) for n in full] + [("Copyright (c) 2020 Somebody Else\n\n" + full[n], f"x{n}/COPYING", n, None) for n in full]
    docs = spark.createDataFrame([(i, t, p) for i, (t, p, *_) in enumerate(cases)], "doc_id long, text string, path string")
    got = {r["doc_id"]: (r["license"], ",".join(r["licenses"])) for r in licenses.scan_licenses(docs, F.col("path")).collect()}
    for i, (_, path, name, every) in enumerate(cases):
        assert got[i][0] == name and (every is None or got[i][1] == every), (path, got[i])
