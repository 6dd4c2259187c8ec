"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from haulage.llm import (chunk_dedup, compression_bands, conversation_repair, line_dedup, lpf_dedup, ngram_join,
                         pivot_codes, quality_classifier, simhash_bktree, source_mix, suffix_decontamination, token_codes, warc)
from haulage.llm.common import table
from haulage.llm.oracles import ORACLE  # noqa: F401


def op1_compression_bands(spark, sf_dir):
    return compression_bands.compression_bands(table(spark, sf_dir, "documents"))


def op2_suffix_decontamination(spark, sf_dir):
    return suffix_decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark, sf_dir):
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.component_report(table(spark, sf_dir, "documents"))


def op5_source_mix(spark, sf_dir):
    return source_mix.mix_plan(table(spark, sf_dir, "documents")).drop("copies")


def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_lines(docs, line_dedup.LineIndex.build(docs))


def op7_token_ids(spark, sf_dir):
    return token_codes.read_codes(token_codes.write_codes(table(spark, sf_dir, "documents")), with_ids=False).drop("ids")


def op8_chunk_dedup(spark, sf_dir):
    return chunk_dedup.dedup_chunks(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    index = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lpf_dedup(spark, sf_dir):
    return lpf_dedup.remove_copies(table(spark, sf_dir, "documents"))


def op11_simhash_bktree(spark, sf_dir):
    return simhash_bktree.near_duplicates(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_pivot_codes(spark, sf_dir):
    return pivot_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_compression_bands, op2_suffix_decontamination, op3_quality_classifier, op4_ngram_jaccard_join, op5_source_mix,
    op6_line_dedup, op7_token_ids, op8_chunk_dedup, op9_warc, op10_lpf_dedup,
    op11_simhash_bktree, op12_conversation_repair, op13_pivot_codes)}
