"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Token features are hashes of the word and of its first 4, 5 and 6 bytes. Labels are of whole documents, so token labels
come from them: in a toxic document, tokens with a feature that toxic documents have and clean ones (almost) never have.
The field (two states, feature weights, a transition matrix) is trained by gradient ascent on windows around such
tokens and on windows of clean documents. Forward-backward marginals of every token of every text follow from 2 x 2
matrices, multiplied in blocks side by side; a logistic fit turns a text's marginals into its score.

Nulls and empty texts have no token: score of a text without any sign. Rows are judged one by one, so repeats and ties
don't matter, and whole, however long. Of labelled rows that repeat an id, the text with the smallest hash is learned
from. Where no toxic document can be learned from, every score is 0. An empty table gives an empty table. Extra columns
stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.llm import common, textkernel
from curvelake.llm.textkernel import U64, mix

#: The learning sample: labelled documents of each class, chosen by the hash of their ids, and the longest text taken.
SAMPLE_DOCS, SAMPLE_TEXT = 1000, 20_000
#: Features kept, and the least number of toxic sample documents with one.
FEATURES, LEAST_DOCS = 20_000, 4
PREFIXES = (4, 5, 6)
BLOCK, WINDOW = 64, 8
#: Bytes of text judged at a time: each token takes some hundred bytes of numbers beside it.
PIECE_BYTES = 1 << 20


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word in lower case without .,;:!? at its ends, and of its first bytes (the whole word, if shorter)."""
    edge = np.zeros(256, bool)
    edge[list(b".,;:!?\"'()")] = True
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3):
        starts += (ends - starts > 1) & edge[data[starts]] if len(data) else 0
        ends -= (ends - starts > 1) & edge[data[np.maximum(ends - 1, 0)]] if len(data) else 0
    out = [textkernel.span_hashes(data, starts, ends, True)]
    out += [mix(textkernel.span_hashes(data, starts, np.minimum(ends, starts + k), True) + U64(k)) for k in PREFIXES]
    return out


def forward_backward(e: np.ndarray, at: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(state 1) of each token; ``e``: log-odds from its features; ``at``: where each text's tokens start."""
    n = np.diff(at)
    blocks = -(-n // BLOCK)
    doc = np.repeat(np.arange(len(n)), blocks)
    if not len(doc):
        return np.empty(0)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = at[:-1][doc] + BLOCK * nth
    size = np.minimum(BLOCK, at[1:][doc] - first)
    col = np.arange(BLOCK)
    real = col < size[:, None]
    odds = np.exp(np.clip(e[np.minimum(first[:, None] + col, len(e) - 1)], -30, 30))
    (a, b), (c, d) = trans  # a step multiplies by [[a, b x], [c, d x]], x the odds
    m = np.broadcast_to(np.eye(2), (len(doc), 2, 2)).copy()
    for t in range(BLOCK):
        x, ok = odds[:, t], real[:, t]
        p, q, r, s = m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1]
        new = np.stack([p * a + q * c, (p * b + q * d) * x, r * a + s * c, (r * b + s * d) * x], 1).reshape(-1, 2, 2)
        new /= new.max(axis=(1, 2), keepdims=True)
        m = np.where(ok[:, None, None], new, m)
    enter = np.tile(np.array([1.0, 1e-3]), (len(doc), 1))
    leave = np.ones((len(doc), 2))
    head = np.cumsum(blocks) - blocks
    for k in range(1, int(blocks.max())):  # from block to block, all texts at once
        to = head[blocks > k] + k
        v = np.einsum("ni,nij->nj", enter[to - 1], m[to - 1])
        enter[to] = v / v.max(axis=1, keepdims=True)
        back = head[blocks > k] + blocks[blocks > k] - 1 - k
        v = np.einsum("nij,nj->ni", m[back + 1], leave[back + 1])
        leave[back] = v / v.max(axis=1, keepdims=True)
    forward = np.empty((len(doc), BLOCK, 2))
    u, v = enter[:, 0], enter[:, 1]
    for t in range(BLOCK):
        x, ok = odds[:, t], real[:, t]
        f, g = u * a + v * c, (u * b + v * d) * x
        z = np.maximum(f, g)
        u, v = np.where(ok, f / z, u), np.where(ok, g / z, v)
        forward[:, t, 0], forward[:, t, 1] = u, v
    out = np.empty((len(doc), BLOCK))
    u, v = leave[:, 0], leave[:, 1]
    for t in range(BLOCK - 1, -1, -1):
        x, ok = odds[:, t], real[:, t]
        f, g = forward[:, t, 0] * u, forward[:, t, 1] * v
        out[:, t] = g / (f + g)
        f, g = a * u + b * x * v, c * u + d * x * v
        z = np.maximum(f, g)
        u, v = np.where(ok, f / z, u), np.where(ok, g / z, v)
    return out[real]


@dataclass
class Model:
    """Sorted feature hashes and their weights, bias, transitions, and the logistic fit of the document score."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    fit: np.ndarray

    def log_odds(self, feats: list[np.ndarray]) -> np.ndarray:
        e = np.full(len(feats[0]), self.bias)
        for f in feats:
            at = np.minimum(np.searchsorted(self.keys, f), max(0, len(self.keys) - 1))
            if len(self.keys):
                e += np.where(self.keys[at] == f, self.weights[at], 0.0)
        return e

    def judge(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text; marginal, start and end byte of each token; tokens before each text."""
        starts, ends, offsets = textkernel.word_spans(data, at)
        p = forward_backward(self.log_odds(features(data, starts, ends)), offsets, self.trans)
        x = summary(p, offsets)
        score = 1 / (1 + np.exp(-(x @ self.fit))) if len(self.keys) else np.zeros(len(at) - 1)
        return score, p, starts, ends, offsets


def summary(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1, the three largest marginals, the logarithm of the expected number of toxic tokens, and their density."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((-p, doc))
    ranked = np.concatenate([p[order], [0.0]])
    tops = [np.where(n > k, ranked[np.minimum(offsets[:-1] + k, len(p))], 0.0) for k in range(3)]
    total = np.bincount(doc, weights=p, minlength=len(n))
    return np.stack([np.ones(len(n)), *tops, np.log1p(total), np.log1p(1000 * total / np.maximum(n, 20))], 1)


def train(texts: list[str], toxic: np.ndarray, prior: float) -> Model:
    """From labelled texts; ``prior``: the share of toxic documents among all labelled ones."""
    none = Model(np.empty(0, U64), np.empty(0), 0.0, np.array([[0.5, 0.5], [0.5, 0.5]]), np.zeros(6))
    if not toxic.any() or toxic.all():
        return none
    data, at = common.flat(pa.array(texts, pa.string()))
    starts, ends, offsets = textkernel.word_spans(data, at)
    feats = features(data, starts, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keys, inverse = np.unique(np.concatenate(feats), return_inverse=True)
    inverse = inverse.reshape(len(feats), -1)
    group = families(textkernel.span_hashes(data, starts, ends, True), offsets)[doc]
    pairs = np.unique(np.concatenate([inverse[i] * len(texts) + group for i in range(len(feats))]))  # copies count once for each feature
    toxic_family = np.zeros(len(texts), bool)
    toxic_family[group[toxic[doc]]] = True
    is_toxic = toxic_family[pairs % len(texts)]
    pos = np.bincount((pairs // len(texts))[is_toxic], minlength=len(keys))
    neg = np.bincount((pairs // len(texts))[~is_toxic], minlength=len(keys))
    n_pos, n_neg = toxic_family.sum(), len(np.unique(group)) - toxic_family.sum()
    lift = np.log((pos + 0.1) / (n_pos + 0.2)) - np.log((neg + 0.1) / (n_neg + 0.2))
    n, q = pos + neg, n_pos / (n_pos + n_neg)  # no feature passes by chance, of all that were tried
    share = np.clip(pos / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    evidence = n * (share * np.log(share / q) + (1 - share) * np.log((1 - share) / (1 - q)))
    sign = (pos >= LEAST_DOCS) & (lift > 3.0) & (evidence > np.log(len(keys)) + 3)
    known = np.flatnonzero(sign)[np.argsort(-pos[sign], kind="stable")[:FEATURES]]
    number = np.full(len(keys), -1)
    number[known] = np.arange(len(known))
    own = number[inverse]  # features x tokens, -1: not kept
    labels = toxic[doc] & (own >= 0).any(axis=0)
    if not labels.any():
        return none
    rng = np.random.default_rng(5)
    centres = np.flatnonzero(labels)
    centres = np.concatenate([rng.permutation(centres)[:4000], rng.choice(len(doc), min(4000, len(doc)), replace=False)])
    span = np.clip(centres[:, None] + np.arange(-WINDOW, WINDOW + 1), 0, len(doc) - 1)
    held = doc[span] == doc[centres][:, None]
    f, y = np.where(held[None], own[:, span], -1), labels[span] & held
    weights, bias, logt = np.zeros(len(known) + 1), -2.0, np.zeros((2, 2))
    state = [np.zeros_like(weights), 0.0, np.zeros((2, 2))]
    lanes = np.arange(len(centres))
    for step in range(60):  # gradient of the conditional log-likelihood, with a small penalty
        e = bias + weights[f].sum(axis=0)
        p, pair = window_marginals(e, logt)
        gap = (y - p) * held
        grad = np.bincount(np.where(f < 0, len(known), f).ravel(), weights=np.broadcast_to(gap, f.shape).ravel(), minlength=len(weights))
        grad[-1] = 0
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1].astype(int), y[:, 1:].astype(int)), 1.0)
        rate = 0.5 / (1 + step / 30)
        for i, (g, v) in enumerate(((grad / len(lanes) - 1e-4 * weights, weights), (gap.mean(), bias), ((seen - pair) / y.size, logt))):
            state[i] = 0.9 * state[i] + 0.1 * g * g if step else g * g
            move = rate * g / (np.sqrt(state[i]) + 1e-8)
            if i == 0:
                weights = v + move
            elif i == 1:
                bias = float(v + move)
            else:
                logt = v + move - (v + move)[0, 0]
    order = np.argsort(keys[known])
    model = Model(keys[known][order], weights[:-1][order], bias, np.exp(np.clip(logt, -20, 20)), np.zeros(6))
    x = summary(forward_backward(model.log_odds(feats), offsets, model.trans), offsets)
    odds = np.where(toxic, prior / toxic.sum(), (1 - prior) / (~toxic).sum())
    odds /= odds.mean()
    fit = np.zeros(6)
    for _ in range(30):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-(x @ fit)))
        h = (x * (odds * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.5 * np.eye(6)
        fit += np.linalg.solve(h, x.T @ (odds * (toxic - p)) - 0.5 * fit)
    model.fit = fit
    return model


def families(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each sample text, the same for likely copies: texts that share one of their four least 5-word shingles."""
    h, at = textkernel.shingles(words, offsets, 5)
    own = np.arange(len(at) - 1)
    least = [np.unique(h[a:b])[:4] for a, b in zip(at[:-1], at[1:], strict=True)]
    text = np.repeat(own, [len(x) for x in least])
    _, key = np.unique(np.concatenate([*least, np.empty(0, U64)]), return_inverse=True)
    for _ in range(20):
        low = np.full(key.max(initial=0) + 1, len(own))
        np.minimum.at(low, key, own[text])
        new = own.copy()
        np.minimum.at(new, text, low[key])
        if (new == own).all():
            break
        own = new
    return own


def window_marginals(e: np.ndarray, logt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) in each place of each window, and the expected number of each transition."""
    t, x = np.exp(np.clip(logt, -20, 20)), np.exp(np.clip(e, -30, 30))
    n, width = e.shape
    fw, bw = np.empty((n, width, 2)), np.ones((n, width, 2))
    emit = np.stack([np.ones_like(x), x], 2)
    fw[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, width):
        v = (fw[:, i - 1] @ t) * emit[:, i]
        fw[:, i] = v / v.sum(axis=1, keepdims=True)
    for i in range(width - 2, -1, -1):
        v = (emit[:, i + 1] * bw[:, i + 1]) @ t.T
        bw[:, i] = v / v.sum(axis=1, keepdims=True)
    both = fw * bw
    pair = fw[:, :-1, :, None] * t * (emit * bw)[:, 1:, None, :]
    return both[:, :, 1] / both.sum(axis=2), (pair / pair.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From at most about SAMPLE_DOCS documents of each class, outside the held-out rows."""
    marks = labels.where((common.split_of(F.col("doc_id")) != 2) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows
    if not counts.get(1) or not counts.get(0):
        return train([], np.zeros(0, bool), 0.0)
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30))
    few = {y: int(min(1.0, SAMPLE_DOCS / n) * (1 << 30)) for y, n in counts.items()}
    chosen = marks.where(draw < F.when(F.col("y") == 1, few[1]).otherwise(few[0])).select(F.col("doc_id").alias("d_"), "y")
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_TEXT).join(F.broadcast(chosen), F.col("doc_id") == F.col("d_"))
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y"))
    found = one.toPandas().sort_values("doc_id")
    model = train(found.text.tolist(), found.y.to_numpy() == 1, counts[1] / (counts[0] + counts[1]))
    common.release()
    return model


def tag(docs: DataFrame, model: Model, out: str) -> DataFrame:
    """All columns and a struct ``out``: score, toxic tokens, and spans: where runs of toxic tokens begin and end, in
    characters, with their largest marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for whole in batches:
            for b in common.pieces(whole, text, PIECE_BYTES):
                data, at = common.flat(b.column(text))
                score, p, starts, ends, offsets = shared.value.judge(data, at)
                bad = np.flatnonzero(p >= 0.5)
                doc = np.searchsorted(offsets, bad, "right") - 1
                count = np.bincount(doc, minlength=b.num_rows)
                new = np.ones(len(bad), bool)
                new[1:] = (np.diff(bad) > 1) | (np.diff(doc) > 0)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(bad)) - 1 if len(first) else first
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
                doc, base = doc[first], points[at[doc[first]]]
                most = np.maximum.reduceat(p[bad], first) if len(first) else np.empty(0)
                spans = pa.StructArray.from_arrays([pa.array(points[starts[bad[first]]] - base), pa.array(points[ends[bad[last]]] - base), pa.array(most)], fields=list(span))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(at))).astype(np.int32)), spans)
                made = pa.StructArray.from_arrays([pa.array(score), pa.array(count), lists], names=["score", "tokens", "spans"])
                yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, "made"])

    return common.with_struct(docs, run, out, "struct<score:double, tokens:bigint, spans:array<struct<start:bigint, end:bigint, p:double>>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic_tokens, and spans: the offending offsets in characters."""
    rows = tag(docs.select("doc_id", "text"), learn(docs, labels), "made")
    held = common.split_of(F.col("doc_id")) == 2
    return rows.select("doc_id", held.alias("held_out"), "made.score", (F.col("made.score") >= threshold).cast("int").alias("predicted"), F.col("made.tokens").alias("n_toxic_tokens"), F.col("made.spans").alias("spans"))
