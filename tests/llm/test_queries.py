"""The contract queries on the smallest tables: against SQL, or against the plain definition."""

import hashlib
import zlib

import duckdb
import pandas as pd
import pytest
from tokenizers import Tokenizer

from lodestone.llm import oracles, queries
from tests.test_registry import FOLDER, TABLES, same


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{FOLDER}/documents.parquet").set_index("doc_id")["text"].fillna("").to_dict()


def result(spark, name):
    return queries.queries()[name](spark, FOLDER).toPandas()


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_sql(spark, duck, name):
    same(result(spark, name), duck.execute(oracles.SQL[name]).df())


def test_op1(spark, texts):
    t = Tokenizer.from_file(queries.tokenizer_path())
    got = result(spark, "op1_bpe").set_index("doc_id")
    assert set(got.index) == set(texts)
    for i, x in texts.items():
        ids = t.encode(x, add_special_tokens=False).ids
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2(spark, texts):
    got = result(spark, "op2_gif_media").set_index("doc_id")
    assert set(got.index) == set(texts)
    for i, x in texts.items():
        raw = x.encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        assert tuple(got.loc[i, ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_op4_and_op9(spark, texts):
    toxic = result(spark, "op4_toxicity").set_index("doc_id")
    assert set(toxic.index) == set(texts)
    assert all(toxic.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in texts)
    assert toxic.score.between(0, 1).all() and ((toxic.score >= 0.5) == toxic.predicted).all()
    good = result(spark, "op9_quality").set_index("doc_id")
    assert set(good.index) == set(texts) and good.score.between(0, 1).all()
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet").set_index("doc_id").quality
    assert (good.predicted.reindex(labels.index) == labels).mean() > 0.9


def test_op8(spark, texts):
    from tests.llm.test_pairs import removed_by_hand

    got = result(spark, "op8_suffix_dedup").set_index("doc_id")
    want = dict(zip(texts, removed_by_hand(list(texts.values()), 400), strict=True))
    assert {i: tuple(got.loc[i, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) for i in got.index} == want
