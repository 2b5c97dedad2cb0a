"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text of each language gives the longest matches with which a text is parsed, phrase by
phrase; the language whose text needs the fewest phrases for each byte wins. All blocks of all texts step through the
automata side by side in numpy. A phrase ends where a block of BLOCK bytes ends, alike for every language.

Nulls: a null text, or one without a letter, is ``und`` with score 0, and so is every text where no language could be
learned. Ties go to the smaller name. Rows are judged one by one, so repeats don't matter, and whole, however long. An
empty table gives an empty table. Extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.llm import common
from curvelake.llm.textkernel import LOWER

#: The learning sample: documents of each language, and bytes of all languages together.
SAMPLE_DOCS, SAMPLE_BYTES = 64, 160_000
#: Longest text (characters) that the sample takes.
SAMPLE_TEXT = 16_384
BLOCK = 1024
#: Phrases for each byte, beyond the one that any text needs, above which no learned language fits.
MISFIT = 0.5


def automaton(text: np.ndarray, alphabet: int) -> np.ndarray:
    """The transitions of the suffix automaton of a text of symbols: state 0 is the root, -1 no transition."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur, p = len(nxt), last
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = cur
    table = np.full((len(nxt), alphabet), -1, np.int32)
    for s, row in enumerate(nxt):
        if row:
            table[s, list(row)] = list(row.values())
    return table


def phrases(data: np.ndarray, at: np.ndarray, symbol: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Phrases that each language needs for each text (texts x languages)."""
    size = np.diff(at)
    blocks = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(size)), blocks)
    first = at[:-1][doc] + BLOCK * (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    left = np.minimum(BLOCK, at[1:][doc] - first)
    order = np.argsort(-left, kind="stable")
    first, left, doc = first[order], left[order], doc[order]
    live = np.searchsorted(-left, -np.arange(BLOCK), "left")  # blocks longer than each step
    symbols = symbol[data].astype(np.int32)
    out = np.zeros((len(size), len(tables)))
    for k, table in enumerate(tables):
        width = table.shape[1]
        flat, root = table.ravel(), np.maximum(table[0], 0)
        state, count = np.zeros(len(first), np.int32), np.ones(len(first), np.int32)
        for step in range(int(left[0]) if len(left) else 0):
            n = live[step]
            s = symbols[first[:n] + step]
            to = flat[state[:n] * width + s]
            miss = to < 0
            if step:  # the first phrase is counted already
                count[:n] += miss
            state[:n] = np.where(miss, root[s], to)
        out[:, k] = np.bincount(doc, weights=count, minlength=len(size))
    return out


class Model:
    """Languages, their sample bytes and the symbols of the bytes."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.names = sorted(samples)
        texts = [LOWER[np.frombuffer(samples[n], np.uint8)] for n in self.names]
        seen = np.unique(np.concatenate([*texts, np.empty(0, np.uint8)]))
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.symbol = self.symbol[LOWER]
        self.texts, self.key = texts, hash(tuple(samples.items()))

    def tables(self) -> list[np.ndarray]:
        """Built once in each Python worker."""
        size = int(self.symbol.max(initial=0)) + 1
        return common.held(("automata", self.key), lambda: [automaton(self.symbol[t], size) for t in self.texts])

    def judge(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, score, and phrases beyond the first for each byte, of each text."""
        need = phrases(data, at, self.symbol, self.tables())
        best = need.argmin(axis=1)
        two = np.sort(need, axis=1)
        second = two[:, 1] if need.shape[1] > 1 else 2 * two[:, 0]
        return best, np.nan_to_num(second / (two[:, 0] + second)), (two[:, 0] - 1) / np.maximum(np.diff(at), 1)


def learn(docs: DataFrame) -> Model:
    """From at most SAMPLE_DOCS documents of each language, chosen by the hash of their ids, outside the held-out rows."""
    usable = (common.split_of(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & (F.char_length("text").between(1, SAMPLE_TEXT))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id")
    chosen = docs.where(usable).select("doc_id", "lang", F.row_number().over(order).alias("k")).where(F.col("k") <= SAMPLE_DOCS)
    keys = chosen.select(F.col("doc_id").alias("d_"), F.col("lang").alias("l_"), "k")
    rows = docs.where(usable).select("doc_id", "lang", "text").join(F.broadcast(keys), (F.col("doc_id") == F.col("d_")) & (F.col("lang") == F.col("l_")))
    found = rows.select("lang", "k", "text").dropDuplicates(["lang", "k"]).toPandas().sort_values(["lang", "k"])
    samples: dict[str, bytes] = {}
    most = SAMPLE_BYTES // max(1, found.lang.nunique())
    for name, text in zip(found.lang, found.text, strict=True):
        own, new = samples.get(name, b""), text.encode() + b"\n"
        if not own or len(own) + len(new) <= most:
            samples[name] = own + new
    return Model(samples)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, out: str) -> DataFrame:
    """All columns and a struct ``out`` (lang_pred, score, rate: phrases beyond the first for each byte)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flag = common.fresh(docs, "has_letter")
    text, last = docs.columns.index("text"), len(docs.columns)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rate", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in common.pieces(whole, text):
                lettered = b.column(last).to_numpy(zero_copy_only=False).astype(bool)
                if m.names:
                    best, score, rate = m.judge(*common.flat(b.column(text)))
                    found = [m.names[i] if x else "und" for i, x in zip(best.tolist(), lettered, strict=True)]
                else:
                    score = rate = np.zeros(b.num_rows)
                    found = ["und"] * b.num_rows
                made = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(rate)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*b.columns[:last], made], [*b.schema.names[:last], "made"])

    marked = docs.withColumn(flag, has_letter(F.col("text")))
    return common.with_struct(marked, run, out, "struct<lang_pred:string, score:double, rate:double>", drop=flag)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = learn(docs.select("doc_id", "text", "lang"))
    rows = identify(docs.select("doc_id", "text"), model, "made")
    return rows.select("doc_id", (common.split_of(F.col("doc_id")) == 2).alias("held_out"), "made.lang_pred", "made.score")
