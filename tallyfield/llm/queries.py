"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, langid, mix, neardup, packing, phrases, quality, secrets, tokenfiles, topk, toxicity, urlfilter
from .common import id_crc, table
from .oracle import ORACLE as ORACLE

QUALITY_TRAIN_ROWS = 4_000  # labelled rows that the quality model is fitted on, at most
TOXIC_TRAIN_ROWS = 12_000  # labelled rows that the toxicity model is fitted on, at most


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), id_crc() % 4 != 2, TOXIC_TRAIN_ROWS)
    scored = toxicity.score(docs, lexicon, 0.3, ["doc_id"]).select("row.doc_id", "score", "predicted")
    return scored.select("doc_id", F.coalesce(id_crc() % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the package that holds the files is not part of this library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2, 1024, with_ids=False)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)
    return tokenfiles.read(manifest, with_ids=False)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), 2, 80)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), id_crc() % 4 != 2, QUALITY_TRAIN_ROWS)
    return quality.grade(docs, model).withColumn("held_out", F.coalesce(id_crc() % 4 == 2, F.lit(False)))


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).withColumn("purity", F.round("purity", 9))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs, id_crc() % 3 != 1)
    return langid.identify(docs, net).select("doc_id", F.coalesce(id_crc() % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mix.plan(table(spark, sf_dir, "documents"), (5, 2, 1), 3)
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), 30, 4, 80, 2000)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.rearrange(table(spark, sf_dir, "documents"), "1", with_output=False, columns=["doc_id"])
    return done.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_files": op4_token_files,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination,
    "op8_quality": op8_quality,
    "op9_url_templates": op9_url_templates,
    "op2_exact_topk": op2_exact_topk,
    "op10_language_id": op10_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op11_source_mix": op11_source_mix,
    "op12_collocations": op12_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}
