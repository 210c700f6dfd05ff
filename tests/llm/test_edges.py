"""Every corpus operator and stage on nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, chat, licenses, media, mixing, quality, toxicity
from lodestone.llm.near_dedup import near_duplicates, one_per_group
from lodestone.llm.queries import tokenised, tokenizer_path
from lodestone.llm.suffix_dedup import repeated_strings
from lodestone.llm.topk import top_k_products

#: Names that operators use inside or in results.
CLASHES = "_text text_mark row key doc twin size range draw digest kept label mark id c0 wid wording media_ n samples_ _kept part".split()
LONG = "word of a very long text " * 8000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, None, None), (None, "", "en", "a"), (3, " \n\t", "", ""), (4, LONG, "en", "b"), (5, LONG + "end", "en", "b"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def path():
    return F.concat_ws("/", "source", F.col("doc_id").cast("string"))


OPERATORS = {
    "bpe": lambda d, l: bpe.decode(bpe.encode(d, tokenizer_path()), tokenizer_path()),
    "digests": lambda d, l: tokenised(d, tokenizer_path()),
    "media": lambda d, l: media.read_samples(media.store_texts(d)),
    "near": lambda d, l: near_duplicates(d),
    "mix": lambda d, l: mixing.mix_sources(d),
    "suffix": lambda d, l: repeated_strings(d, length=100),
    "toxicity": lambda d, l: toxicity.score_toxicity(d, toxicity.train_toxicity(d, l)),
    "quality": lambda d, l: quality.score_quality(d, quality.train_quality(d, l)),
    "licences": lambda d, l: licenses.scan_licenses(d, path()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_names(spark, docs, labels, name):
    run = OPERATORS[name]
    got = run(docs, labels)
    assert got.count() == docs.count()
    if name not in ("near", "digests", "licences"):
        assert set(CLASHES) <= set(got.columns)
        row = got.where("doc_id = 4").first()
        assert [row[c] for c in CLASHES if c not in ("size",)] == [i for i, c in enumerate(CLASHES) if c not in ("size",)]
    assert run(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_equal_texts_score_alike(docs, labels, name):
    column = {"toxicity": "toxicity", "quality": "quality_score"}[name]
    rows = OPERATORS[name](docs, labels).select("doc_id", column).collect()
    assert len({r[1] for r in rows if r[0] == 1}) == 1 and all(0 <= r[1] <= 1 for r in rows)


def test_kept_documents(docs):
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, None, None]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("trim(coalesce(text, '')) = ''").count() == 0


def test_stages(spark, docs, labels, tmp_path):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for folder, frame, known in ((tmp_path / "some", own, labels), (tmp_path / "none", own.limit(0), labels.limit(0)), (tmp_path / "unlabelled", own, labels.limit(0))):
        frame.write.parquet(f"{folder}/documents.parquet")
        known.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (out.count() > 0) == (folder.name != "none")


def test_conversations_and_vectors(spark):
    talk = spark.createDataFrame([(1, None, None, None), (1, 0, "user", "x"), (None, 0, "user", "y"), (1, 0, "user", "x")], "conv_id long, turn int, role string, text string").withColumn("segment", F.lit("z"))
    assert chat.read_segments(chat.chat_segments(talk)).count() == 2 and chat.chat_segments(talk.limit(0)).count() == 0
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, []), (20, []), (4, [2.0, 1.0]), (5, [2.0, 1.0])], "vec_id long, embedding array<double>").withColumn("dim", F.lit("z"))
    got = [tuple(r) for r in top_k_products(vectors, F.col("vec_id") % 20 == 0, k=2).collect()]
    assert sorted(set(got)) == [(0, 1, 4, 16384), (0, 2, 5, 16384), (20, 1, 3, 0)]
