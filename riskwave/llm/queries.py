"""Registered queries of the training-data operators.

Each ``opN_*`` applies its operator with production parameters to the
whole table; the digest columns asked for are derived here from the
operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskwave.llm.bpa_search import ORACLE as BPA_SEARCH
from riskwave.llm.common import prepare, table
from riskwave.llm.kdtree_topk import ORACLE as KDTREE_TOPK
from riskwave.llm.line_templates import ORACLE as LINE_TEMPLATES
from riskwave.llm.merkle_manifest import ORACLE as MERKLE_MANIFEST


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.token_counts import count_tokens
    prepare(spark)
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.quality_rules import judge, train
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs, train(docs, labels), ["doc_id"])


def op6_zstd_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.zstd_classifier import score, train
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.simhash_golay import near_duplicates
    prepare(spark)
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.line_templates import drop_recurring_lines
    out = drop_recurring_lines(table(spark, sf_dir, "documents"), stats=True)
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.pfair_mixing import mix_sources
    out = mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return out.select("row.doc_id", "row.source", "share", "epoch", "block", "release", "deadline", "slot", "place")


def op4_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.pii_semicrf import digest, tag_documents, train
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return digest(tag_documents(docs, train(docs)))


def op7_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.kdtree_topk import top_inner_products
    prepare(spark)
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


#: A conversation whose texts look like the template's own marks.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from riskwave.llm.chat_format import format_conversations, read_back
    prepare(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    bpe = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return read_back(format_conversations(rows.unionByName(marks), *bpe), *bpe)


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.bm25_packing import pack_documents
    prepare(spark)
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op11_bpa_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.bpa_search import search
    prepare(spark)
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.dominance_packing import pack_documents
    prepare(spark)
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id",
                         "offset")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskwave.llm.merkle_manifest import manifest, tampered_fields
    prepare(spark)
    rows = manifest(table(spark, sf_dir, "documents"), claimed=tampered_fields())
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                       F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op11_bpa_search": op11_bpa_search,
    "op12_dominance_packing": op12_dominance_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
    "op7_kdtree_topk": op7_kdtree_topk,
    "op8_chat_format": op8_chat_format,
    "op4_pii_semicrf": op4_pii_semicrf,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op10_line_templates": op10_line_templates,
    "op2_simhash_golay": op2_simhash_golay,
    "op1_quality_rules": op1_quality_rules,
    "op6_zstd_classifier": op6_zstd_classifier,
    "op3_bm25_packing": op3_bm25_packing,
    "op9_token_counts": op9_token_counts,
}

ORACLES: dict[str, str] = {
    "op7_kdtree_topk": KDTREE_TOPK,
    "op10_line_templates": LINE_TEMPLATES,
    "op11_bpa_search": BPA_SEARCH,
    "op13_merkle_manifest": MERKLE_MANIFEST,
}
