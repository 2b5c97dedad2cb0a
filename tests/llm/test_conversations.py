"""The conversation trie and chat formatting against plain Python, with ties, nulls, long and repeated conversations."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.llm import chat, trie, turns

KIND = "conv_id long, turn long, role string, text string, pos string, digest string, depth string"
ODD = [None, "", " ", "<|im_end|>", "<\\|x|>", "<|<|", "<\\\\|", "a<", "|b", "<|im_start|>user\nhi<|im_end|>\n", "日本語 é \U0001f600", "\\1$1", "x" * 3000]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], KIND).repartition(3)


def in_order(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        out[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [(r, t) for *_, r, t in sorted(own)] for c, own in out.items()}


def some(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-8, 5 * n), n):
        for turn in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", *ODD])))
    return rows + [(None, 0, "user", "nobody's")] * 2 + rows[:3]


def nodes(rows):
    own = in_order([r for r in rows if r[0] is not None])
    built = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + seq[h:]
    members = collections.defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    value = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += value[p]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(built[c]) == len(p)).encode()).hexdigest()
    return collections.Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


@pytest.mark.parametrize("segment", [1024, 3])
def test_nodes_are_those_of_plain_grouping(spark, monkeypatch, segment):
    monkeypatch.setattr(turns, "SEGMENT", segment)
    rows = some(segment)
    out = trie.conversation_trie(table(spark, rows)).collect()
    assert collections.Counter(tuple(r)[:8] for r in out) == nodes(rows)
    assert any(r.screened for r in out) and not all(r.screened for r in out)


def test_a_crowded_sketch_only_sends_more_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(trie, "cells_of", lambda a, b, width: np.stack([(a % 40).astype(np.int64) + r * width for r in range(trie.ROWS)]))
    monkeypatch.setattr(turns, "SEGMENT", 4)
    rows = some(7)
    out = trie.conversation_trie(table(spark, rows)).collect()
    assert collections.Counter(tuple(r)[:8] for r in out) == nodes(rows)
    assert sum(r.screened for r in out) < len(out) / 2


def test_one_long_conversation_and_many_copies(spark):
    long = [(5, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(2500)]
    copies = [(c, t, "user", f"same {t}") for c in range(100, 400) for t in range(12)]
    rows = long + copies
    got = collections.Counter(tuple(r)[:8] for r in trie.conversation_trie(table(spark, rows)).collect())
    small = collections.Counter({k: n for k, n in got.items() if k[1] <= 12 and k[0] != 5})
    assert sum(got.values()) == sum(small.values()) + sum(n for k, n in got.items() if k[0] == 5)
    want = nodes([r for r in rows if r[0] >= 100 or r[1] < 13])
    assert small - want == collections.Counter() or {k[:2] for k in small - want} == {(5, 0)}
    assert {k[1] for k in got if k[0] == 5 and k[3] == 1} >= set(range(1, 2501))


def test_trie_of_one_and_of_none(spark):
    one = [(3, 0, "user", "hi")]
    assert collections.Counter(tuple(r)[:8] for r in trie.conversation_trie(table(spark, one)).collect()) == nodes(one)
    assert trie.conversation_trie(table(spark, one).limit(0)).count() == 0


def wanted(rows):
    out = {}
    for c, seq in in_order(rows).items():
        whole, reply = "".join(f"{r}\n{t}\n" for r, t in seq), "".join(t for r, t in seq if r == "assistant")
        out[c] = (len(seq), hashlib.sha256(whole.encode()).hexdigest(), len(reply), hashlib.sha256(reply.encode()).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1 << 20, 5])
def test_what_is_written_comes_back(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(turns, "PIECE", piece)
    rows = some(11) + [(9, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("a|<%\nb", "assistant") for t in ODD)]
    chat.write(table(spark, rows), f"{tmp_path}/chat")
    read = chat.read(spark, f"{tmp_path}/chat")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.report(read).collect()}
    assert got == wanted(rows)
    segments = [r.segment for r in read.collect()]
    assert all(s.count("<|") == 2 and s.startswith(chat.OPEN) and s.endswith(chat.CLOSE) for s in segments)


def test_examples_hold_all_before_them_and_train_one_reply(spark, tmp_path):
    rows = some(13)
    chat.write(table(spark, rows), f"{tmp_path}/chat")
    read = chat.read(spark, f"{tmp_path}/chat")
    found = chat.expand(read, chat.examples(read)).collect()
    plain = in_order(rows)
    assert len(found) == sum(r == "assistant" for own in plain.values() for r, _ in own)
    for e in found:
        own = plain[e.conv_id]
        assert own[e.target] == ("assistant", e.reply)
        assert e.context_turns == e.target and len(e.text) == e.chars
        assert e.text.count(chat.OPEN) == e.target + 1
        masked = e.text[e.loss_from : e.loss_to]
        assert chat.OPEN not in masked and e.text[e.loss_to :] == chat.CLOSE
        assert e.text[: e.context_chars].endswith(chat.CLOSE) or not e.target
    total = {r.conv_id: r.expanded_chars for r in chat.report(read).collect()}
    for c in plain:
        assert total[c] == sum(len(e.text) for e in found if e.conv_id == c)


def test_long_conversations_run_over_ranges(spark, tmp_path):
    rows = [(1, i, "assistant" if i % 3 else "user", f"turn {i} " * (i % 7)) for i in range(4000)] + [(2, 0, "user", "x" * 5_000_000), (0, 0, "user", "hello")]
    chat.write(table(spark, rows), f"{tmp_path}/chat")
    read = chat.read(spark, f"{tmp_path}/chat")
    assert {r.conv_id: tuple(r)[1:5] for r in chat.report(read).collect()} == wanted(rows)
    starts = read.where("conv_id = 1").orderBy("turn").select("turn", "start", F.char_length("segment").alias("n")).collect()
    assert [r.turn for r in starts] == list(range(4000)) and all(a.start + a.n == b.start for a, b in zip(starts, starts[1:], strict=False))
    chat.write(table(spark, rows).limit(0), f"{tmp_path}/none")
    assert chat.report(chat.read(spark, f"{tmp_path}/none")).count() == 0
