"""Line de-duplication, in DataFrame functions alone.

Nulls and empty texts are one empty line. A document is an id: rows that repeat one count once for a line, and rows with
a null id count for none, as in count(DISTINCT doc_id), but lose the common lines like all others. Lines whose key is
shorter than ``least`` code points are never dropped. An empty table gives an empty table. Only ``doc_id`` and ``text``
are read, so extra columns don't matter, whatever their names.

Lines are joined with the common ones by the hashes of their keys. A line so frequent that it has more than one in HOT of
all (document, common line) pairs is salted: HOT such lines can exist at most, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.llm import common

#: Lines that may be hot, at most, and the partitions over which one is spread.
HOT, SALTS = 1000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    lowered = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    return F.btrim(lowered, F.lit(" \t\n\x0b\x0c\r"))


def key_hashes(text: Column, least: int) -> Column:
    """For each line, in order, a struct of two independent 64-bit hashes of its key, or null where the key is short."""

    def one(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= least, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), one)


def drop_lines(docs: DataFrame, min_docs: int = 10, least: int = 1) -> DataFrame:
    """All columns of ``docs``, ``text`` without the lines whose key at least ``min_docs`` documents hold, and a struct
    column ``lines_report`` (n_lines, n_dropped; underscores follow its name if it is taken)."""
    row, report = common.fresh(docs, "row_key"), common.fresh(docs, "lines_report")
    keyed = docs.withColumn(row, F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("d"), F.xxhash64("text").alias("t")))
    each = keyed.select(F.col(row).alias("r"), F.col("doc_id").alias("d"), F.posexplode(key_hashes(F.col("text"), least)).alias("at", "h")).where("h is not null")
    each = each.select("r", "d", "at", "h.a", "h.b")
    counts = each.where("d is not null").select("a", "b", "d").distinct().groupBy("a", "b").count().where(F.col("count") >= min_docs)
    counts = common.materialize(counts, "common-lines")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = F.col("count") * HOT > total
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    common_lines = counts.select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.explode(salts).alias("salt_"))
    spread = F.broadcast(counts.where(hot).select("a", "b", F.lit(True).alias("hot")))  # HOT rows at most
    each = each.join(spread, ["a", "b"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("r", "at"), F.lit(SALTS)).cast("int")).otherwise(0))
    held = each.join(common_lines, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")) & (F.col("salt") == F.col("salt_")))
    held = held.groupBy("r").agg(F.collect_set("at").alias("dropped"))  # the places of one text's common lines
    taken, lines, gone = (common.fresh(docs, x) for x in ("taken_", "lines_", "gone_"))
    held = held.select(F.col("r").alias(taken), F.col("dropped").alias(gone))
    out = keyed.join(held, F.col(row) == F.col(taken), "left").withColumn(lines, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    n, k = F.size(lines).cast("long"), F.coalesce(F.size(gone), F.lit(0)).cast("long")
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get(F.col(lines), i)), "\n"))
    names = [F.col(common.quoted(c)) if c != "text" else text.alias("text") for c in docs.columns]
    return out.select(*names, F.struct(n.alias("n_lines"), k.alias("n_dropped")).alias(report))


def line_dedup(docs: DataFrame, min_docs: int = 10, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    rows = drop_lines(docs.select("doc_id", "text"), min_docs, least)
    return rows.select("doc_id", "lines_report.n_lines", "lines_report.n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
