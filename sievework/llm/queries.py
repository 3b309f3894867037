"""The registered corpus queries: thin digests of the operators' own results, over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, bpe, centroids, ctw, langmix, oracles, packing, quality, simhash, spans, trie, warc, webp, wrappers
from .common import crc_mod, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op2_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    out = ctw.score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = langmix.learn(docs.filter(~held_out))
    found = langmix.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")


def op8_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", "text")


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_column(table(spark, sf_dir, "documents")).drop("media", "samples")


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.new_folder(spark)
    captures = warc.write(pages, folder)
    directory = warc.build_index(captures, folder)
    found = warc.look_up(pages.select(warc.url_key(F.col("url")).alias("url_key")), directory, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_patricia_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_partial_distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
