"""Quality rules: how much of a text lies in repeated word n-grams and repeated lines, by rolling hashes in numpy.

Nulls and empty texts have no word: every measure is 0 and the base rule fails. Rows are judged one by one, so repeated
rows and ids don't matter. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.llm import common, textkernel
from curvelake.llm.textkernel import U64, mix

#: Of a text's word characters, the share that may lie in n-grams found twice or more, for each n.
LIMITS = {4: 0.40, 6: 0.30, 10: 0.25}
#: Of a text's characters, the share that may lie in lines equal to an earlier one.
LINE_LIMIT = 0.35
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1


def repeated(h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with a hash in a group (ascending): is it there twice or more; and is it there before."""
    key = mix(h + mix(group.astype(U64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def windows(words: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its text has twice or more."""
    covered = np.zeros(len(words) + 1, np.int64)
    m = len(words) - n + 1
    if m > 0:
        mult = textkernel.powers(0xA24BAED4963EE407, n)
        rolled = np.zeros(m, U64)
        for j in range(n):
            rolled += words[j : j + m] * mult[j]
        inside = np.flatnonzero(group[:m] == group[n - 1 :])
        hit = inside[repeated(rolled[inside], group[inside])[0]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + n, -1)
    return np.cumsum(covered[:-1]) > 0


def measures(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text, as arrays."""
    n_docs = len(at) - 1
    starts, ends, offsets = textkernel.word_spans(data, at)
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    total = lambda v, d: np.bincount(d, weights=v, minlength=n_docs).astype(np.int64)
    words = textkernel.span_hashes(data, starts, ends, False)
    out = {"n_words": np.diff(offsets), "word_chars": total(chars, doc)}
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out["n_symbols"] = symbols[at[1:]] - symbols[at[:-1]]

    feeds = np.flatnonzero(data == 0x0A)
    line_doc = np.concatenate([np.arange(n_docs), np.searchsorted(at, feeds, "right") - 1])
    line_start = np.concatenate([at[:-1], feeds + 1])
    order = np.lexsort((line_start, line_doc))
    line_doc, line_start = line_doc[order], line_start[order]
    line_end = at[1:][line_doc]
    more = np.flatnonzero(line_doc[1:] == line_doc[:-1])
    line_end[more] = line_start[more + 1] - 1
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_doc, line_start, line_end = line_doc[worded], line_start[worded], line_end[worded]
    later = repeated(textkernel.span_hashes(data, line_start, line_end, False), line_doc)[1]
    out["n_dup_lines"] = total(later, line_doc)
    out["line_chars"] = total((points[line_end] - points[line_start]) * later, line_doc)
    out["n_chars"] = points[at[1:]] - points[at[:-1]]
    out["n_repeat_words"] = total(windows(words, doc, 8), doc)
    for n in LIMITS:
        out[f"gram{n}_chars"] = total(chars * windows(words, doc, n), doc)
    return out


def repetition_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures and verdicts, and the share of each text in repeated n-grams and lines."""
    shares = [f"gram{n}_share" for n in LIMITS] + ["line_share"]
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.pieces(whole, "text"):
                m = measures(*common.flat(b.column("text")))
                base_failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                share = {f"gram{n}_share": m[f"gram{n}_chars"] / np.maximum(m["word_chars"], 1) for n in LIMITS}
                share["line_share"] = m["line_chars"] / np.maximum(m["n_chars"], 1)
                fine = share["line_share"] <= LINE_LIMIT
                for n, most in LIMITS.items():
                    fine &= share[f"gram{n}_share"] <= most
                cols = [b.column("doc_id"), *(pa.array(m[c].astype(np.int64)) for c in longs), pa.array(base_failed), pa.array(~base_failed & fine), *(pa.array(share[s]) for s in shares)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *longs, "base_failed", "kept", *shares])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in longs) + ", base_failed boolean, kept boolean, " + ", ".join(f"{s} double" for s in shares)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _sql_grams() -> str:
    """For each n, the words that lie in an n-word window which their text has twice or more."""
    one = """w{n} AS (SELECT doc_id, i, array_to_string(all_[i : i + {m}], ' ') AS g FROM words WHERE i + {m} <= len(all_)),
 c{n} AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(all_[i])) AS BIGINT) AS chars FROM words x WHERE EXISTS (SELECT 1 FROM t{n} t WHERE t.doc_id = x.doc_id AND t.i = x.i) GROUP BY 1)"""
    twice = "t{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM w{n}) WHERE k > 1)"
    out = []
    for n in (*LIMITS, 8):
        first, last = one.format(n=n, m=n - 1).split(",\n ")
        out += [first, twice.format(n=n), last]
    return ",\n ".join(out)


def oracle() -> str:
    """SQL for DuckDB: windows of words as text, lines compared as text."""
    shares = ", ".join(f"coalesce(c{n}.chars, 0) / greatest(d.word_chars, 1) AS gram{n}_share" for n in LIMITS)
    fine = " AND ".join(f"gram{n}_share <= {most}::DOUBLE" for n, most in LIMITS.items())
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 b AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS all_ FROM t),
 words AS (SELECT doc_id, all_, unnest(range(1, len(all_) + 1)) AS i FROM b),
 {_sql_grams()},
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t),
 dup AS (SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) WHERE nth > 1 GROUP BY 1),
 d AS (SELECT doc_id, text, len(all_) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN all_]), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM b),
 m AS (SELECT d.doc_id, n_words, d.word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(c8.n, 0) AS n_repeat_words, {shares}, coalesce(dup.chars, 0) / greatest(length(text), 1) AS line_share
  FROM d LEFT JOIN dup USING (doc_id) {" ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = d.doc_id" for n in (*LIMITS, 8))}),
 v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {fine} AND line_share <= {LINE_LIMIT}::DOUBLE AS kept FROM v"""
