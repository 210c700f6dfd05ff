"""The queries of this subpackage for the driver's contract: thin digests of the operators' own outputs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import bpe, chat, licenses, media, mixing, oracles, quality, textkit as tk, toxicity
from lodestone.llm.divergence import source_divergence
from lodestone.llm.lexical import rank_documents
from lodestone.llm.near_dedup import near_duplicates
from lodestone.llm.simhash import simhash_components
from lodestone.llm.suffix_dedup import repeated_strings
from lodestone.llm.topk import top_k_products


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, and decoded_sha256 of the text that the codec decodes from the ids.

    Null and empty texts have no tokens; rows with null or repeated ids are each given. Encoding and digests share a worker.
    """
    encoded = bpe.encoded_batches(path, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.codec(path)
        for batch in encoded(batches):
            out = []
            for ids in bpe.id_rows(batch.column(2)):
                text = own.decode(ids).decode(errors="replace")
                out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tk.mapped(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, files, n, samples, frames, time, bins = batch.columns
            out = []
            for f, s, k, t, b in zip(files, samples, frames, time, bins, strict=True):
                f, s = f.as_buffer(), s.as_buffer()
                feature = f"frames={k};cs={t};rgb=" + ",".join(map(str, b.as_py()))
                out.append((s.size, hashlib.sha256(s).hexdigest(), zlib.crc32(s[-64:]), f.size, hashlib.sha256(f).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 6
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([doc, n, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    read = media.read_samples(stored).select("doc_id", "media", "n_bytes", "samples", "n_frames", "duration_cs", "histogram")
    return tk.mapped(read, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held_out())
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels), score_col="score")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False).select("doc_id", "source", "size", "source_size", "target", "taken")


#: A conversation whose texts hold control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], own.schema)
    return chat.read_segments(chat.chat_segments(own.unionByName(more)))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_strings(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", F.col("kept_text").alias("text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", "text_score", "meta_score", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of packages of a hundred ids in folders source/lang; one in ten is its package's licence file, one in a hundred its folder's."""
    docs = _table(spark, sf_dir, "documents")
    number = F.col("doc_id")
    package = F.concat(F.lit("p"), F.floor(number / 100).cast("string"))
    name = F.when(number % 10 == 5, F.concat_ws("/", package, F.lit("LICENSE"))).when(number % 100 == 0, F.lit("LICENSE")).otherwise(F.concat_ws("/", package, number.cast("string")))
    found = licenses.scan_licenses(docs, F.concat_ws("/", "source", "lang", name))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe, op2_gif_media, op3_exact_topk, op4_toxicity, op5_near_dedup, op6_mixing, op7_chat_format, op8_suffix_dedup, op9_quality, op10_licenses, op11_source_divergence, op12_simhash, op13_lexical_search)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
