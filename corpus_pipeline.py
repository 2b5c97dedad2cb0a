"""The corpus pipeline: documents to packed training sequences.

Each stage is one of the operators, gets what its predecessor kept, and returns the columns of ``documents`` (the last:
the pieces of the packed sequences), further columns of any name and type included. Empty tables pass through. A null or
empty text has the score of no words and goes with the language stage, as every text without a letter; a null id is an id
like any other, but for learning, where it counts as held in. Rows that repeat an id are judged one by one; of equal ids
and texts one row stays (near copies). Ties are settled by id, then hash, then the row itself. Long texts are
worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.llm import common, language, lines, ngram_join, packing, toxicity
from curvelake.llm.queries import tokenizer

#: A document goes from this score on.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field scores below TOXIC."""
    common.collect_garbage(spark)
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    out = common.fresh(docs, "toxicity")
    return toxicity.tag(docs, model, out).where(F.col(f"{out}.score") < TOXIC).select(*map(common.quoted, docs.columns))


def drop_languageless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: not those without a letter, nor those that fit none of them."""
    out = common.fresh(docs, "language")
    rows = language.identify(docs, language.learn(docs), out)
    return rows.where((F.col(f"{out}.lang_pred") != "und") & (F.col(f"{out}.rate") <= language.MISFIT)).select(*map(common.quoted, docs.columns))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents share; the count of characters follows the text."""
    kept = lines.drop_lines(docs).select(*map(common.quoted, docs.columns))
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8): the smallest id, then the smallest hash of id and text;
    null ids come last. Rows that repeat an id with other texts are documents of their own; the same id and text are one, of
    which the row stays that is first as JSON."""
    key = common.fresh(docs, "near_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.coalesce("text", F.lit("\0"))))
    found = common.materialize(ngram_join.ngram_join(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, num=80, den=100), "near-copies")
    linked = found.where("component_id <> doc_id").select(F.col("doc_id").alias(key), "component_id")
    members = linked.union(linked.select("component_id", "component_id")).distinct()
    named = members.join(keyed.select(key, F.col("doc_id").alias("id_")).distinct(), key)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id_").isNull().alias("none"), "id_", key)).alias("first")).select(F.col(f"first.{key}").alias(key))
    copies = members.select(key).join(first, key, "left_anti")
    kept = keyed.join(copies, key, "left_anti")
    again = common.materialize(found.groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key), "repeated")
    if again.isEmpty():
        return kept.select(*map(common.quoted, docs.columns))
    row = F.struct(*map(common.quoted, docs.columns))
    one = kept.join(again, key, "left_semi").groupBy(key).agg(F.min_by(row, F.to_json(row)).alias(key + "row"))
    alone = kept.join(again, key, "left_anti").select(*map(common.quoted, docs.columns))
    return alone.union(one.select(common.quoted(key + "row") + ".*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, each with the sources' shares of all tokens."""
    return packing.mixture_pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_languageless),
    ("line_dedup", drop_common_lines),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]

#: SQL can't express the random field or the suffix automata.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.passing(spark):  # a stage's own tables go once its documents are written
            docs = common.materialize(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
