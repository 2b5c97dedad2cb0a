"""The thin queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curvelake.llm import chat, common, huffman, language, lines, linkrank, ngram_join, packing, pieces, quality, topk, toxicity, trie, vafile


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.scratch(spark, "token-files")
    huffman.write(common.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 0, out)
    return huffman.read(spark, out)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sentencepiece(common.table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.mixture_pack(common.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(common.table(spark, sf_dir, "documents"))


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op6_url_linkrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkrank.url_verdicts(common.table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(common.table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(common.table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(common.table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(common.table(spark, sf_dir, "embeddings"))


def op11_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.clusters(common.table(spark, sf_dir, "embeddings")).drop("fetched")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(common.table(spark, sf_dir, "conversations")).drop("screened")


def op13_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = [(-1, 0, "user", chat.TRAP), (-1, 1, "assistant", chat.TRAP)]
    out = common.scratch(spark, "chat-files")
    chat.write(rows.union(spark.createDataFrame(trap, rows.schema)), out)
    return chat.report(chat.read(spark, out))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": lines.ORACLE, "op6_url_linkrank": linkrank.oracle(), "op7_ngram_join": ngram_join.oracle(3, 90, 100), "op9_quality_rules": quality.oracle(), "op10_exact_topk": topk.ORACLE, "op11_va_clusters": vafile.oracle(), "op12_prefix_trie": trie.ORACLE, "op13_chat_examples": chat.ORACLE}
