"""Samples of capped size decide as the whole does."""

import random

import numpy as np

from lodestone.llm import quality, toxicity
from lodestone.llm.linear import logistic, sigmoid


def test_weights_of_labels():
    rng = np.random.default_rng(1)
    y = (rng.random(20_000) < 0.86).astype(float)
    z = rng.normal(2 * y - 1, 1.5)
    whole = logistic(z[:, None], y, np.ones(len(y)))
    part = np.concatenate([np.flatnonzero(y == 0)[:1500], np.flatnonzero(y == 1)[:1500]])
    weight = np.where(y[part] == 1, y.sum() / 1500, (1 - y).sum() / 1500)
    capped = logistic(z[part][:, None], y[part], weight)
    at = np.linspace(-4, 4, 50)
    assert np.abs(sigmoid(capped[0] + capped[1] * at) - sigmoid(whole[0] + whole[1] * at)).max() < 0.03


def test_quality_caps_decide_alike(spark):
    """Plain texts are good in 9 of 10, texts with some marks in 7 of 10, marked ones in 1 of 10."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        kind = rng.choices((0, 1, 2), (5, 4, 1))[0]
        words = [rng.choice(("bade", "cola", "dune", "fira", "gomu")) for _ in range(60)]
        rows.append((i, " ".join(w + ("***" if k < 20 * kind else "") for k, w in enumerate(words)), "en", "s"))
        labels.append((i, int(rng.random() < (0.9, 0.7, 0.1)[kind])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
    own = spark.createDataFrame(labels, "doc_id long, quality int")

    def kept(most):
        model = quality.train_quality(docs, own, most_labelled=most)
        return {r["doc_id"]: r["quality_score"] >= 0.5 for r in quality.score_quality(docs, model).collect()}

    whole, capped = kept(2000), kept(250)
    assert np.mean([whole[i] == capped[i] for i in whole]) > 0.95


def test_toxicity_caps_decide_alike(spark):
    """Texts with the marker are toxic in 9 of 10, others in 3 of 10; few clean ones calibrate."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        marked = rng.random() < 0.1
        words = [rng.choice(("bade", "cola", "dune", "fira", "gomu")) + str(rng.randrange(50)) for _ in range(20)] + ["zorkface"] * marked
        rows.append((i, " ".join(words)))
        labels.append((i, int(rng.random() < (0.9 if marked else 0.3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    own = spark.createDataFrame(labels, "doc_id long, toxic int")

    def found(most):
        model = toxicity.train_toxicity(docs, own, most_labelled=most)
        return {r["doc_id"]: r["toxicity"] >= 0.5 for r in toxicity.score_toxicity(docs, model).collect()}

    whole, capped = found(3000), found(250)
    assert np.mean([whole[i] == capped[i] for i in whole]) > 0.98
