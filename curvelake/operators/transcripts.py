"""Words with times: repair, sentences and checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Shortest word, and what ends a sentence (fixed values).
LEAST_S, TERMINALS = 0.04, ".!?。！？…"
_ONES = "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN".split()
_TENS = "TWENTY THIRTY FORTY FIFTY SIXTY SEVENTY EIGHTY NINETY".split()


def tokens(text: Column, language: Column) -> Column:
    """Chinese by character without white space, other languages at white space; no empty tokens."""
    parts = F.when(language == "zh", F.split(F.regexp_replace(text, r"\s+", ""), "")).otherwise(F.split(F.trim(text), r"\s+"))
    return F.filter(parts, lambda x: x != "")


def normalise(words: DataFrame, key: str) -> DataFrame:
    """``start``, ``end``: no word starts before the one before it ends, the first not before 0; each lasts LEAST_S at least.

    end_i = max(end_i, start_i + LEAST_S) with start_i = max(s_i, end_(i-1)) is a running maximum of
    max(e_j, s_j + LEAST_S) - LEAST_S * j, and of 0 + LEAST_S * (1 - the first i), so one window does it. ``words``:
    key, i (a rank without gaps), s, e.
    """
    w = Window.partitionBy(key).orderBy("i")
    first = F.lag("i").over(w).isNull()
    own = F.when(first, F.greatest("s", F.lit(0.0))).otherwise(F.col("s"))
    reach = F.greatest("e", own + LEAST_S) - LEAST_S * F.col("i")
    end = LEAST_S * F.col("i") + F.max(reach).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = words.withColumn("end", end)
    return out.withColumn("start", F.greatest("s", F.coalesce(F.lag("end").over(w), F.lit(0.0))))


def compress(words: DataFrame, key: str, limit: Column) -> DataFrame:
    """Times scaled so that the last word ends at ``limit`` where it would end after it."""
    last = F.max("end").over(Window.partitionBy(key))
    scale = F.when(last > limit, limit / last).otherwise(1.0)
    return words.withColumn("k_", scale).withColumns({"start": F.col("start") * F.col("k_"), "end": F.col("end") * F.col("k_")}).drop("k_")


def sentences(words: DataFrame, key: str) -> DataFrame:
    """key, sentence (from 0), start, end (3 digits), text: a sentence ends with a word that ends in a terminal."""
    w = Window.partitionBy(key).orderBy("i")
    ends = F.col("t").rlike(f"[{TERMINALS}]$").cast("int")
    before = F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = words.withColumn("sentence", before)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), " ")
    return rows.groupBy(key, "sentence").agg(F.round(F.min("start"), 3).alias("start"), F.round(F.max("end"), 3).alias("end"), text.alias("text"))


def pull_back(words: DataFrame, key: str, duration: Column) -> DataFrame:
    """``start`` and ``end``: words that run past the duration, or past the start of the word after them, move back and keep their
    widths. From the right, the first word that would begin before 0 begins at 0 and keeps what of its width there is room for; what is left of it has
    no room at all and lies at 0. As nothing moves forth, end_i is the least, over j >= i, of e_j + widths after j (and of the duration), less the widths
    after i, for the words to the right of that one."""
    w = Window.partitionBy(key).orderBy("i")
    width = F.greatest(F.col("e") - F.col("s"), F.lit(0.0))
    after = F.coalesce(F.sum(width).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    least = F.min(F.col("e") + F.col("after_")).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = words.withColumn("after_", after).withColumn("end_", F.least(duration, least) - F.col("after_")).withColumn("start_", F.col("end_") - width)
    rows = rows.withColumns({"room_": F.coalesce(F.lead("start_").over(w), duration), "full_": F.coalesce(F.max((F.col("start_") < 0).cast("int")).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)) == 1})
    squeezed = F.col("full_") | (F.col("start_") < 0)
    end = F.when(F.col("full_"), 0.0).when(F.col("start_") < 0, F.least(width, F.col("room_"))).otherwise(F.col("end_"))
    return rows.withColumns({"start": F.when(squeezed, 0.0).otherwise(F.col("start_")), "end": end}).drop("after_", "end_", "start_", "room_", "full_")


def place_missing(words: DataFrame, key: str) -> DataFrame:
    """Words without times (s null) sit midway between their neighbours, with score -1. No word is dropped."""
    w = Window.partitionBy(key).orderBy("i")
    before = F.last("e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("s", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    mid = (F.coalesce(before, after, F.lit(0.0)) + F.coalesce(after, before, F.lit(0.0))) / 2
    score = F.when(F.col("s").isNull(), -1.0).otherwise(F.col("score"))
    return words.withColumns({"s": F.coalesce("s", mid), "e": F.coalesce("e", mid), "score": score})


def violations(words: DataFrame, key: str, duration: Column, slack: float = 0.0) -> DataFrame:
    """key, i, rule for every word that breaks one: order (starts before the last one ends), width, bounds."""
    w = Window.partitionBy(key).orderBy("i")
    rules = F.array_compact(
        F.array(
            F.when(F.col("s") < F.col("before_") - slack, "order"),
            F.when(F.col("e") <= F.col("s"), "width"),
            F.when((F.col("s") < -slack) | (F.col("e") > duration + slack), "bounds"),
        )
    )
    return words.withColumn("before_", F.lag("e").over(w)).withColumn("rule", F.explode(rules)).select(key, "i", "rule")


def sentence_violations(sentences_: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """key, sentence, i (null for the sentence itself), rule: sentences begin no earlier than the one before ends and have a
    width; their words begin no earlier than the sentence or the word before, have a width, and end within it.
    ``sentences_``: key, sentence, start, end; ``words``: key, sentence, i, s, e."""
    w = Window.partitionBy(key).orderBy("sentence")
    late = F.col("start") < F.coalesce(F.lag("end").over(w), F.lit(0.0))
    whole = sentences_.withColumn("rules_", F.array_compact(F.array(F.when(late, "order"), F.when(F.col("end") <= F.col("start"), "width"))))
    rows = words.join(sentences_.select(key, "sentence", "start", F.col("end").alias("end_")), [key, "sentence"])
    begun = F.coalesce(F.lag("e").over(Window.partitionBy(key, "sentence").orderBy("i")), F.col("start"))
    found = rows.withColumn("rules_", F.array_compact(F.array(F.when(F.col("s") < begun, "word order"), F.when(F.col("e") <= F.col("s"), "word width"), F.when(F.col("e") > F.col("end_"), "word outside"))))
    none = F.lit(None).cast(words.schema["i"].dataType).alias("i")
    return whole.select(key, "sentence", none, F.explode("rules_").alias("rule")).union(found.select(key, "sentence", "i", F.explode("rules_").alias("rule")))


def alignment_quality(words: DataFrame, key: str, duration: Column, speech: Column) -> DataFrame:
    """key, monotonic, in_speech (3 digits: words that start within 0.15 s of speech), span_ratio, mean_score, silent_tail
    (4 digits). ``words``: key, i, s, e, score; ``speech``: array of [from, to]."""
    w = Window.partitionBy(key).orderBy("i")
    rows = words.withColumn("ok_", F.col("s") >= F.coalesce(F.lag("s").over(w), F.col("s"))).withColumn("d_", duration)
    return rows.groupBy(key).agg(
        F.bool_and("ok_").alias("monotonic"),
        F.round(F.avg(F.exists(speech, lambda x: F.col("s").between(x[0] - 0.15, x[1] + 0.15)).cast("int")), 3).alias("in_speech"),
        F.round((F.max("e") - F.min("s")) / F.max("d_"), 4).alias("span_ratio"),
        F.round(F.avg("score"), 4).alias("mean_score"),
        F.round(F.max("d_") - F.max("e"), 4).alias("silent_tail"),
    )


def spell(n: int) -> str:
    """A number below a million in capital words; larger ones digit by digit."""
    if n >= 1_000_000:
        return " ".join(_ONES[int(d)] for d in str(n))
    parts = []
    for unit, name in ((1000, "THOUSAND"), (100, "HUNDRED")):
        if n >= unit:
            parts += [spell(n // unit), name]
            n %= unit
    if n >= 20:
        parts.append(_TENS[n // 10 - 2])
        n %= 10
    if n or not parts:
        parts.append(_ONES[n])
    return " ".join(parts)


@F.pandas_udf(StringType())
def spoken(text: pd.Series) -> pd.Series:
    """Digits as words with blanks around them, then only capitals, apostrophes and blanks; other marks just go."""
    words = text.fillna("").str.replace(r"\d+", lambda m: f" {spell(int(m[0]))} ", regex=True).str.upper()
    return words.str.replace(r"[^A-Z' ]+", "", regex=True).str.strip()


def word_spans(tokens: DataFrame, key: str) -> DataFrame:
    """key, word, s, e, score: a word lasts from its first token's start to its last one's end and has their mean score. ``tokens``: key,
    word (its number), s, e, score."""
    return tokens.groupBy(key, "word").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.avg("score").alias("score"))
