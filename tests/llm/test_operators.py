"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import math
import os
import random
import re
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from curvelake.llm import common, huffman, language, lines, linkrank, ngram_join, packing, pieces, quality, textkernel, tokens, topk, toxicity

BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, row string, made string, hash string"
ODD = [None, "", " ", "a", "a  b", "\n", "x\n\nx", " lead", "trail ", "don't  it's\t x", "é　z \x85 q", "A\x1cB", "\0", "日本語。テスト", "ΑΣ ΣΑΣ", "a ́b", "word " * 3000, "z" * 3000, "\r\n\x0b\x0c", "<|endoftext|> x", "▁under ▁"]


def make(spark, texts, ids=None, lang="en", source=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang, source(k) if source else f"s{k % 3}", 0, "x", "x", "x", "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(seed, n=60, words=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, words))) + "." for _ in range(n)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "joined"), [(BYTE_BPE, True), (WORD_BPE, False)])
def test_spans_encode_as_the_library(path, joined, monkeypatch):
    rng, e = random.Random(1), tokens.Encoder(path, joined)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab .,\n'é1　\t-Zß÷Ж") for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["".join(rng.choice(["Über", "été", "foo", " ", " ", ", ", ".\n", "\n", "!! ", " 12 "]) for _ in range(300)) for _ in range(40)]
    want = [[*x.ids, 7] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for most in (1 << 23, 200, 1000):  # whole, and cut in slices
        monkeypatch.setattr(tokens.slices, "__defaults__", (most,))
        ids, at = e.encode(*common.flat(pa.array(texts)), 7)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_memo_stays_within_its_bytes_and_keeps_what_is_asked_for():
    made = []
    memo = tokens.Memo(lambda k: made.append(k) or k.encode(), 100_000)
    for i in range(20_000):
        assert memo["often"] == b"often"
        assert memo[f"k{i}"] == f"k{i}".encode()
        assert len(memo) + len(memo.old) < 2 * 100_000 // tokens.ENTRY
    assert made.count("often") == 1
    long = "x" * 20_000
    assert memo[long] and long not in memo and long not in memo.old
    many = tokens.Memo(lambda ks: [k * 2 for k in ks], 100_000)
    for _ in range(2):
        assert many.many([b"a", b"b" * 100, b"c"]) == [b"aa", b"b" * 200, b"cc"]
    assert set(many) == {b"a", b"c"}


def test_unbroken_junk_leaves_the_memo_empty():
    rng, e = random.Random(2), tokens.Encoder(BYTE_BPE, True)
    junk = ["".join(rng.choice("abcdefgh") for _ in range(20_000)) for _ in range(40)]
    e.encode(*common.flat(pa.array(junk)), 0)
    assert not e.memo and not e.memo.old


@pytest.mark.parametrize(("path", "joined"), [(BYTE_BPE, True), (WORD_BPE, False)])
def test_words_before_marks_are_spans_of_their_own(path, joined, monkeypatch):
    """The library's search for pieces isn't needed for them, and the word is encoded once whatever follows it."""
    rng, e = random.Random(2), tokens.Encoder(path, joined)
    texts = [f"{w}{m} again {w}{n}" for w in ("Wörter", "some", "élan") for m in ("%%%", "!!", "***", "&&&", "###", "$.,") for n in ("", "!", " $$$")]
    odd = ["".join(rng.choice("ab  .,!#$%&*\n'é1　\tÜ?|<") for _ in range(rng.randrange(30))) for _ in range(1500)]
    for own in (texts, odd):
        raw = [x.encode() for x in own]
        want = [[*x.ids, 7] for x in e.tokenizer.encode_batch(own, add_special_tokens=False)]
        with monkeypatch.context() as m:
            if own is texts:
                m.setattr(e, "whole", None)
            ids, at = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])), 7)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == want
    assert sum(b"some" in k for k in e.memo) <= 2


@pytest.mark.parametrize("n", [1, 2, 3, 17, 300, 5000])
def test_huffman_codes_are_prefix_free_short_and_reversible(n):
    rng = np.random.default_rng(n)
    counts = np.sort(rng.zipf(1.3, n).clip(1, 1 << 40))
    ids = rng.permutation(60_000)[:n]
    bits = huffman.code_lengths(counts)
    assert bits.max() <= 16 and sum(0.5 ** bits.astype(float)) <= 1
    codes, at = huffman.canonical(ids, bits), rng.integers(0, n, 3000)
    data, offsets = huffman.pack(codes[at], bits[at])
    blocks = np.arange(0, 3000, huffman.BLOCK)
    got = huffman.Decoder(ids, bits).decode(data, offsets[blocks], np.minimum(huffman.BLOCK, 3000 - blocks))
    assert (got == ids[at]).all()


def test_huffman_lengths_are_optimal_without_a_limit():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    assert (huffman.code_lengths(counts) * counts).sum() == total


def test_token_files_round_trip(spark):
    texts = ODD + prose(2) + ["same"] * 5
    ids = [None, *range(100, 100 + len(texts) - 6), 7, 7, 7, 7, 8]
    out = common.scratch(spark, "files")
    huffman.write(make(spark, texts, ids), BYTE_BPE, 0, out)
    got = huffman.read(spark, out, keep_ids=True).collect()
    t = Tokenizer.from_file(BYTE_BPE)
    want = collections.Counter((i, crc([*t.encode(x or "", add_special_tokens=False).ids, 0])) for i, x in zip(ids, texts, strict=True))
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and ordered[0].doc_id is None
    empty = common.scratch(spark, "files")
    huffman.write(make(spark, texts, ids).limit(0), BYTE_BPE, 0, empty)
    assert huffman.read(spark, empty).count() == 0


def whole(rows, ids):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    sizes = {k: sum(r.length for r in v) for k, v in by.items()}
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(s == 2048 or (s < 2048 and s & (s - 1) == 0) for s in sizes.values())
    docs = collections.defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
    for d, own in docs.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids[d]) == own[0].doc_tokens
        assert all(crc(ids[d][r.start : r.start + r.length]) == r.ids_crc32 for r in own)
    assert set(docs) == set(ids)
    return by


def test_packing_places_each_id_once_and_keeps_the_mixture(spark):
    texts = ODD + prose(3, 500, 120)
    t = Tokenizer.from_file(WORD_BPE)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    source = lambda k: None if k % 9 == 0 else "hot" if k % 3 else f"s{k % 4}"
    rows = packing.mixture_pack(make(spark, texts, source=source), WORD_BPE).collect()
    by = whole(rows, ids)
    share = collections.Counter()
    for r in rows:
        share[r.source] += r.length
    total = sum(share.values())
    for own in by.values():
        if sum(r.length for r in own) == 2048:
            for s, n in share.items():
                assert abs(sum(r.length for r in own if r.source == s) - 2048 * n / total) <= 4 * 128
    assert packing.mixture_pack(make(spark, texts).limit(0), WORD_BPE).count() == 0


def test_packing_with_targets_and_many_sources(spark, monkeypatch):
    texts = prose(4, 200, 80)
    t = Tokenizer.from_file(WORD_BPE)
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    rows = packing.mixture_pack(make(spark, texts), WORD_BPE, targets={"s1": 0.75, "s2": 0.25}).collect()
    first = whole(rows, ids)[0]
    assert abs(sum(r.length for r in first if r.source == "s1") - 1536) <= 256 and not [r for r in first if r.source == "s0"]
    monkeypatch.setattr(packing, "QUEUES", 2)
    whole(packing.mixture_pack(make(spark, texts), WORD_BPE).collect(), ids)


def strip(x):
    return x.strip("\x20\t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = ["Common line", " common LINE\t", "É line", "é line", "", " ", "rare", "b\r", "b"]
    texts = [*ODD, *["\n".join(rng.choice(pool) for _ in range(rng.randrange(6))) for _ in range(60)]]
    docs = make(spark, texts)
    seen = collections.defaultdict(set)
    for i, x in enumerate(texts):
        for y in (x or "").split("\n"):
            if strip(y):
                seen[strip(y)].add(i)
    gone = {k for k, v in seen.items() if len(v) >= 10}
    assert gone
    import hashlib

    want = {}
    for i, x in enumerate(texts):
        own = (x or "").split("\n")
        kept = [y for y in own if strip(y) not in gone]
        want[i] = (len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_dedup(docs).collect()} == want
    assert lines.line_dedup(docs.limit(0)).count() == 0
    names = ["lines_report", "r", "d", "at", "h", "a", "b", "a_", "b_", "salt", "salt_", "hot", "dropped", "gone_", "lines_", "taken_", "a`b.c"]
    twice = lines.drop_lines(docs.unionByName(docs).withColumns(dict.fromkeys(names, F.lit(1))))
    assert twice.count() == 2 * len(texts) and {"lines_report_", *names} <= set(twice.columns)


def test_a_hot_line_is_salted_and_dropped_everywhere(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 3)
    texts = ["\n".join(["hot"] * (i % 3) + [f"own {i}", "warm" if i % 9 == 0 else f"last {i}", ""]) for i in range(120)]
    got = {r.doc_id: r.text for r in lines.drop_lines(make(spark, texts)).collect()}
    assert got == {i: "\n".join([f"own {i}"] + [f"last {i}"] * (i % 9 != 0) + [""]) for i in range(120)}
    long = ["\n".join(f"line {i}" for i in range(20_000))] * 10 + ["line 7\nline x"]
    assert {r.doc_id: r.text for r in lines.drop_lines(make(spark, long)).collect()} == {**dict.fromkeys(range(10), ""), 10: "line x"}


def brute_join(texts, k, num, den):
    sets = {}
    for i, x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = list(sets)
    for a in range(len(own)):
        for b in range(a + 1, len(own)):
            x, y = sets[own[a]], sets[own[b]]
            if x and y and den * len(x & y) >= num * len(x | y):
                u, v = find(own[a]), find(own[b])
                root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 60)])
def test_ngram_join_equals_brute_force(spark, k, num):
    rng = random.Random(k)
    texts = [*ODD, "A b", "a B", "one two three", "One two  three"]
    for base in prose(6, 8, 90):  # families of copies with more and more edits
        w = base.split()
        for _ in range(14):
            own = list(w)
            for _ in range(rng.randrange(0, max(1, len(w) // 8) + 1)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    got = ngram_join.ngram_join(make(spark, texts), k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(list(enumerate(texts)), k, num, 100)


@pytest.mark.parametrize("num", [60, 66, 80, 90])
def test_sizes_that_may_link_meet_in_a_range_and_file_enough(num):
    rule = ngram_join.Rule(3, num, 100)
    ranges = {n: {c: (v, keep) for c, v, keep in rule.ranges(n)} for n in range(1, 400)}
    for n in range(1, 400):
        for m in range(n, n * 100 // num + 1):
            if m < 400 and 100 * n >= num * m:
                both = ranges[n].keys() & ranges[m].keys()
                assert both, (n, m)
                most = rule.apart(n + m)
                assert any(min(ranges[n][c][1], ranges[m][c][1]) > most and ranges[n][c][0] > most for c in both), (n, m)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_ngram_join_of_all_documents_equals_brute_force(spark, k, num):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    want = brute_join([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], k, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, k, num, 100).collect()} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_ngram_join_null_repeated_ids_and_empty_tables(spark):
    texts = ["a b c d e f", "a b c d e f", "a b c d e f", "q r s t u v", "a b c d e f"]
    got = ngram_join.ngram_join(make(spark, texts, [5, 3, None, 9, 5]), 3, 90, 100).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(5, 3), (3, 3), (None, None), (9, 9), (5, 3)], key=str)
    assert ngram_join.ngram_join(make(spark, texts).limit(0), 3, 90, 100).count() == 0


def test_ngram_join_keeps_little_at_a_time(spark, monkeypatch):
    """Shared fragments are found in bands, none with most of them; differences are held for sets that meet a third one only."""
    alone, trio = prose(81, 30, 90), prose(82, 6, 90)
    texts = [t + x for t in alone for x in ("", " zz")] + [t + x for t in trio for x in ("", " one", " two", " one two")]
    docs = make(spark, texts)
    seen = collections.defaultdict(list)

    def kept(df, name, keep=False, old=common.materialize):
        out = old(df, name, keep)
        seen[name].append(out.collect())
        return out

    monkeypatch.setattr(common, "materialize", kept)
    got = ngram_join.ngram_join(docs, 3, 80, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(list(enumerate(texts)), 3, 80, 100)
    sizes = [len(x) for x in seen["shared"]]
    assert len(sizes) == ngram_join.BANDS and max(sizes) < 0.5 * sum(sizes)
    met = {(r.a, r.b): r.met for r in seen["pairs"][0]}
    assert {r.met for r in seen["pairs"][0]} == {True, False}
    assert all(bool(r.delta) == met[r.a, r.b] for r in seen["judged"][0])


def brute_quality(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    own = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, inside = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            inside.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(inside)


def test_quality_equals_brute_force(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    texts = [*ODD, "a\n a\na\n\n\na", "#*$%&|<> x|\n" * 9, clean, (" ".join(f"w{i}" for i in range(40)) + "\n") * 2, clean + " " + " ".join(f"w{i}" for i in range(100)), *prose(7, 30)]
    rows = {r.doc_id: r for r in quality.repetition_rules(make(spark, texts)).collect()}
    for i, x in enumerate(texts):
        r, want = rows[i], brute_quality(x or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, x
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert rows[texts.index(clean)].kept
    assert quality.repetition_rules(make(spark, texts).limit(0)).count() == 0


def brute_shares(x):
    """Characters of words in repeated n-grams for each n, and in lines equal to an earlier one, as shares."""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    out = {}
    for n in quality.LIMITS:
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        count = collections.Counter(grams)
        inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)}
        out[n] = sum(len(w[j]) for j in inside) / max(1, sum(map(len, w)))
    return out


def test_quality_shares_and_verdict_equal_brute_force(spark):
    rng = random.Random(3)
    texts = prose(8, 40) + [" ".join(rng.choice(["a b c d e f g h", "some other words", f"w{i} x{i}"]) for i in range(60)) for _ in range(30)]
    for r in quality.repetition_rules(make(spark, texts)).collect():
        want = brute_shares(texts[r.doc_id])
        got = {n: r[f"gram{n}_share"] for n in quality.LIMITS}
        assert got == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and all(got[n] <= quality.LIMITS[n] for n in got) and r.line_share <= quality.LINE_LIMIT)


def naive_phrases(sample, text):
    """Phrases of the greedy parse of a text into substrings of the sample, by blocks."""
    n = 0
    for b in range(0, len(text), language.BLOCK):
        block, i, held = text[b : b + language.BLOCK], 0, b""
        n += 1
        while i < len(block):
            c = block[i : i + 1]
            if held + c in sample:
                held += c
            else:
                n += i > 0
                held = c if c in sample else b""
            i += 1
    return n


def test_automaton_parses_as_a_substring_search():
    rng = random.Random(8)
    samples = {"x": "".join(rng.choice("abc ") for _ in range(300)).encode(), "y": "".join(rng.choice("abd ") for _ in range(300)).encode()}
    model = language.Model(samples)
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 1500))) for _ in range(40)]
    got = language.phrases(*common.flat(pa.array(texts)), model.symbol, model.tables())
    for t, row in zip(texts, got, strict=True):
        assert [naive_phrases(samples[n], t.encode()) for n in model.names] == row.tolist()


def tongues(seed, n, odd=()):
    rng, rows = random.Random(seed), []
    parts = {"aa": "ka lo mi ne su ta".split(), "bb": "qur xes zol vim wep".split()}
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang))
    return rows + [(n + k, t, "aa") for k, t in enumerate(odd)]


def test_language_of_held_out_texts(spark):
    rows = tongues(9, 80, [None, "", "123 456", "...", "KALO MINE suta"])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("made", F.lit(1))
    got = {r.doc_id: r for r in language.language_id(docs).collect()}
    for i, text, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        assert got[i].lang_pred == ("und" if not text or not any(map(str.isalpha, text)) else lang)
    assert {r.lang_pred for r in language.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.language_id(docs.limit(0)).count() == 0


def test_language_ties_repeats_short_and_long_texts(spark):
    rows = tongues(12, 80)
    rows += [(500, "kalomi qurxes", "aa"), (500, "kalomi qurxes", "aa"), (501, "ka", None), (502, "A.", None), (503, "ka lo mi " * 700_000, None), (504, "日本語" * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.identify(docs, language.learn(docs), "x").select("doc_id", "x.*").collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and len({(r.lang_pred, r.score) for r in out if r.doc_id == 500}) == 1
    assert by[503].lang_pred == "aa" and by[501].rate < language.MISFIT and by[502].rate <= language.MISFIT < by[504].rate
    tie = language.Model({"b": b"xyzw", "a": b"xyzw"})
    best, score, _ = tie.judge(*common.flat(pa.array(["xyzw", "q"])))
    assert best.tolist() == [0, 0] and score.tolist() == [0.5, 0.5]  # the smaller name


def test_language_score_equals_its_definition():
    rng = random.Random(8)
    samples = {n: "".join(rng.choice(c) for _ in range(300)).encode() for n, c in (("x", "abc "), ("y", "abd "), ("z", "bcd "))}
    model = language.Model(samples)
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 1500))) for _ in range(40)]
    best, score, rate = model.judge(*common.flat(pa.array(texts)))
    for i, t in enumerate(texts):
        need = [naive_phrases(samples[n], t.encode()) for n in model.names]
        one, two = sorted(need)[:2]
        assert (best[i], score[i], rate[i]) == (need.index(one), two / (one + two), (one - 1) / len(t))


def toxic_rows(seed, n):
    rng = random.Random(seed)
    clean, rows, marks = prose(seed, n, 60), [], []
    for i, t in enumerate(clean):
        bad = i % 4 == 0
        words = t.split()
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "zzurk" + rng.choice("abcdefgh") + "x"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad), 1))
    return rows, marks


def test_toxicity_of_held_out_texts(spark):
    rows, marks = toxic_rows(10, 1200)
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9003, "VILE!! zzurkqx, (vile) ...")], "doc_id long, text string").withColumn("y", F.lit(0))
    labels = spark.createDataFrame([*marks, (77777, 1, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == bad for i, bad, _ in held]) > 0.97
    assert all(got[i].held_out for i, _, _ in held) and all(0 <= r.score <= 1 for r in got.values())
    assert got[9001].predicted == got[9002].predicted == 0 and got[9003].predicted == 1 and got[9003].n_toxic_tokens == 3
    none = toxicity.toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_spans_are_the_planted_words_in_characters(spark):
    rows, marks = toxic_rows(10, 1200)
    rows = [(i, "é日 " * (i % 5) + t.replace(" vile ", " vile, VILE ")) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a`b c", F.lit(1))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    hit = planted = found = 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            continue
        want = {k for m in re.finditer(r"vile|zzurk\wx", t, re.I) for k in range(*m.span())}
        mine = {k for s in got[i].spans for k in range(s.start, s.end)}
        assert all(0 <= s.start < s.end <= len(t) and not t[s.start].isspace() and not t[s.end - 1].isspace() for s in got[i].spans)
        assert [s.start for s in got[i].spans] == sorted(s.start for s in got[i].spans)
        hit, planted, found = hit + len(want & mine), planted + len(want), found + len({k for k in mine if t[k].isalpha()})
    assert hit / planted > 0.95 and hit / found > 0.95
    tagged = toxicity.tag(docs, toxicity.learn(docs, labels), "o`ut")
    assert tagged.columns == ["doc_id", "text", "a`b c", "o`ut"] and tagged.count() == len(rows)
    assert language.identify(docs, language.learn(docs.withColumn("lang", F.lit("aa"))), "o`ut").count() == len(rows)


def test_score_equals_its_definition(spark):
    rows, marks = toxic_rows(11, 600)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    model = toxicity.learn(docs, labels)
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    for i, t in rows[:40]:
        data, at = common.flat(pa.array([t]))
        starts, ends, _ = textkernel.word_spans(data, at)
        feats = toxicity.features(data, starts, ends)
        e = [model.bias + sum(weights.get(int(f[k]), 0.0) for f in feats) for k in range(len(starts))]
        f, p = np.array([1.0, 1e-3]), []
        ahead = []
        for x in e:  # one token after the other
            f = f @ model.trans * np.array([1.0, math.exp(x)])
            f /= f.max()
            ahead.append(f)
        b = np.ones(2)
        for x, a in zip(e[::-1], ahead[::-1], strict=True):
            p.append(a[1] * b[1] / (a * b).sum())
            b = model.trans @ (np.array([1.0, math.exp(x)]) * b)
            b /= b.max()
        tops = (sorted(p, reverse=True) + [0.0] * 3)[:3]
        row = [1.0, *tops, math.log1p(sum(p)), math.log1p(1000 * sum(p) / max(len(p), 20))]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-np.dot(row, model.fit))), abs=1e-6)


def test_forward_backward_equals_enumeration():
    rng, trans = np.random.default_rng(1), np.array([[0.9, 0.2], [0.4, 0.7]])
    e, at = rng.normal(size=9), np.array([0, 4, 4, 9])
    got = toxicity.forward_backward(e, at, trans)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a == b:
            continue
        n, p, z = b - a, np.zeros(b - a), 0.0
        for path in np.ndindex(*[2] * n):
            w = trans[0, path[0]] + 1e-3 * trans[1, path[0]]
            for t in range(n):
                w *= np.exp(e[a + t]) if path[t] else 1.0
                w *= trans[path[t], path[t + 1]] if t + 1 < n else 1.0
            z += w
            p += w * np.array(path)
        assert got[a:b] == pytest.approx(p / z)
    long = rng.normal(size=500)
    assert np.isfinite(toxicity.forward_backward(long * 100, np.array([0, 500]), trans)).all()


RULES = [("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/", "allow")]


def test_url_rules_and_propagation(spark):
    link = lambda *to: " ".join(f'<a HREF="{t}">x</a>' for t in to)
    rows = [
        (1, "http://A.Example.ORG/en/12?q=/es/", link("http://good.net/x", "/rel", "http://good.net/y")),
        (2, "https://example.org/es/", ""),
        (3, "http://x.com/de/1#f", link("http://bad-friend.net/")),
        (4, "http://bad-friend.net/p", link("http://x.com/de/1")),
        (5, "http://good.net/", None),
        (6, "no url", link("http://good.net/")),
        (7, None, None),
        (8, "http://notexample.org", None),
        (9, "http://fexample.org/es/1", None),
        (10, "http://even.net/", link("//x.com/de/1")),
        (12, "http://long.net/", "<p>" * 200_000 + link("HTTP://Good.net")),
        (9, "http://fexample.org/es/1", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = linkrank.url_verdicts(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert (by[2].rule, by[2].verdict, by[3].rule, by[3].verdict) == ("example.org/es/", "block", "com/de/", "block")
    assert (by[4].rule, by[4].verdict, by[5].verdict, by[6].verdict, by[7].host, by[7].path) == (None, "block", "allow", "allow", "", "")
    assert by[10].verdict == "block" and by[12].verdict == "allow"  # links without a scheme count
    assert (by[8].path, by[8].rule, by[9].rule, by[9].verdict) == ("", None, "org/", "allow")
    assert linkrank.url_verdicts(pages.limit(0)).count() == 0


def test_propagation_equals_dense_iteration(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2)) if a != b})
    out = linkrank.propagate(spark.createDataFrame([(str(a), str(b)) for a, b in edges], "u string, v string"), spark.createDataFrame([("0", 0.7), ("5", 0.3)], "host string, seed double"))
    m, seed = np.zeros((12, 12)), np.zeros(12)
    seed[0], seed[5] = 0.7, 0.3
    for a, b in edges:
        m[a, b] = 1 / sum(x == a for x, _ in edges)
    r = seed.copy()
    for _ in range(linkrank.ROUNDS):
        r = (1 - linkrank.DAMPING) * seed + linkrank.DAMPING * (r @ m)
    assert {x.host: x.rank for x in out.collect()} == pytest.approx({str(i): v for i, v in enumerate(r) if v}, abs=1e-12)


@pytest.mark.parametrize("block", [4, 1024])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(300, 24)) * rng.exponential(size=(300, 1))).astype(np.float32)
    x[50:60] = x[20]  # ties
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 24), (1060, [math.inf] * 24), (None, [1.0] * 24), (40, rows[40][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit("clash"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(vectors, 20, 20, block).collect())
    n = np.floor(x.astype(float) * 64).astype(np.int64)
    ids, all_rows = np.array([*range(300), 40]), np.concatenate([n, n[40:41]])
    want = []
    for q in range(0, 300, 20):
        found = sorted((-int(s), int(i)) for i, s in zip(ids, all_rows @ n[q], strict=True) if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert got == sorted(want)


def test_top_k_sends_only_blocks_that_can_matter(spark, monkeypatch):
    rng, pairs = np.random.default_rng(4), []
    keep = topk.reaching
    monkeypatch.setattr(topk, "reaching", lambda *a: pairs.append(keep(*a)) or pairs[-1])
    x = rng.normal(size=(2000, 8)) / (1 + np.arange(2000)[:, None] / 50)  # ever shorter
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 20, 32).collect()}
    n = np.floor(x * 64).astype(np.int64)
    for q in range(0, 2000, 20):
        best = sorted((-int(s), i) for i, s in enumerate(n @ n[q]) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert 0 < pairs[0].count() < 4 * 63 / 3  # of 4 query blocks and 63 others


def test_top_k_of_repeated_ids_and_of_scores_beyond_64_bits(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.variant, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 2, 12288), (0, 2, 1, 4096), (1, 1, 1, 8192), (1, 2, 2, 4096)]
    huge = [(20, [1e15, 0.0]), (1, [1e15, 0.0]), (2, [1.1e15, 0.0]), (3, [-1e15, 0.0]), (4, [1e-3, 0.0]), (5, [1e300, 0.0])]
    got = topk.exact_top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [5, 2, 1, 4, 3] and [r.score for r in got][:3] == [2**63 - 1] * 3 and got[-1].score == -(2**63)


def test_top_k_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(20, [1.0, 2.0]), (1, [1.0]), (2, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in topk.exact_top_k(few).orderBy("rank").collect()] == [(1, 1, 4096), (2, 2, -8192)]
    assert topk.exact_top_k(few.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_pass_odd_rows(spark, tmp_path):
    rows, marks = toxic_rows(14, 400)
    texts = [t for _, t in rows] + [None, "", "12 34", "same words here again and again", "same words here again and again"]
    docs = spark.createDataFrame([(i, t, "aa", f"s{i % 3}", 0) for i, t in enumerate(texts)] + [(None, "bad cab fed had egg", "aa", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, kept, str(tmp_path)), name)
        assert out.columns == docs.columns and out.count() <= kept.count()
        kept = out
    left = {r.doc_id for r in kept.collect()}
    bad = {i for i, y, _ in marks if y}
    assert not {400, 401, 402, 404} & left and {403, None} <= left
    assert len(left & bad) <= 2 and len(left - bad) > 280
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0


def library_ids(texts):
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=PIECES)
    return [p.encode(t or "") for t in texts]


def test_pieces_are_the_ids_of_the_library(spark):
    rng, m = random.Random(17), pieces.pieces(PIECES)
    texts = ODD + prose(18, 30) + ["".join(rng.choice("thereisandfor") for _ in range(n)) for n in (5, 31, 32, 400, 3000)]
    texts += ["".join(rng.choice("ab th.,\n'é1　\t-Z▁日") for _ in range(rng.randrange(90))) for _ in range(400)]
    want = library_ids(texts)
    for t, w in zip(texts, want, strict=True):
        prepared = pieces.prepared(t or "")
        assert m.encode(prepared) == m.encode_whole(t or "") == np.array(w, "<u4").tobytes(), t
        assert m.heap_merged(prepared) == m.merged(prepared)
    got = {r.doc_id: r for r in pieces.sentencepiece(make(spark, texts), PIECES).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(want[i]), crc(want[i])), t
        assert got[i].text_crc32 == zlib.crc32((t or "").replace("▁", " ").encode())
    assert pieces.sentencepiece(make(spark, texts).limit(0), PIECES).count() == 0


@pytest.mark.parametrize("part", [1, 3, 16, 50])
def test_matrices_lead_to_the_ids_of_the_library_however_they_are_grouped(part):
    rng, m = random.Random(part), pieces.pieces(PIECES)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 250))) for letters in ("thereisandfor", "ab th.,\n'é1　\t-Z▁日", "the and is", "z", " =") for _ in range(12)]
    for text, want in zip(texts, library_ids(texts), strict=True):
        t = pieces.prepared(text)
        made = [m.chunk(t[f : p + part + m.longest], p - f, min(p + part, len(t)) - f) for p in range(0, len(t), part) for f in [max(0, p - m.longest)]]
        own = pieces.unpacked([x[0] for x in made], [x[1] for x in made])
        grouped = list(own)
        while len(grouped) > 1:
            i = rng.randrange(len(grouped) - 1)
            grouped[i : i + 2] = [pieces.multiply(*grouped[i : i + 2])]
        assert grouped[0].tolist() == [[0.0]]
        path, ids = pieces.doors(own, 0, 0), b""
        for (_, _, enter, leave, head, middle, tail, size), i, j in zip(made, path, path[1:], strict=False):
            before, after = m.traced(head, tail, size, enter[i], leave[j])
            ids += before + middle + after
        assert np.frombuffer(ids, "<u4").tolist() == want, text


def test_the_product_takes_the_best_way():
    a, b = np.array([[0.0, -np.inf], [2.0, 1.0]]), np.array([[-np.inf, 3.0], [5.0, 0.0]])
    assert pieces.multiply(a, b).tolist() == [[-np.inf, 3.0], [6.0, 5.0]]
    assert pieces.doors([a, b], 1, 0) == [1, 1, 0]


def test_long_texts_are_scanned_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(pieces, "FAN", 3)  # several rounds
    rng = random.Random(19)
    texts = [" ".join(prose(20, 40)), "日本語。テスト " * 60, "".join(rng.choice("xq1日　 ") for _ in range(900)), "z" * 900, " " * 700, "short", "".join(rng.choice("thereisandfor") for _ in range(1500)), "z" * 99, "z" * 100]
    texts, ids = texts + texts[:1], [0, 1, 2, 3, 4, None, 5, 6, 7, 0]
    want = collections.Counter((i, len(w), crc(w), -(-(len(t) + 1) // 100)) for i, t, w in zip(ids, texts, library_ids(texts), strict=True))
    rows = pieces.sentencepiece(make(spark, texts, ids), PIECES, part=100).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.n_chunks) for r in rows) == want


def test_texts_of_megabytes_with_and_without_blanks(spark):
    rng = random.Random(23)
    texts = ["".join(rng.choices("thereisandfor", k=600_000)), " ".join("".join(rng.choices("aeinrst", k=rng.randrange(1, 9))) for _ in range(300_000))]
    want = [(len(w), crc(w), -(-(len(t) + 1) // pieces.PART)) for t, w in zip(texts, library_ids(texts), strict=True)]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.n_chunks) for r in pieces.sentencepiece(make(spark, texts), PIECES).collect()}
    assert [got[0], got[1]] == want


def test_shared_queues_keep_each_sources_share(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 2)
    texts = prose(21, 900, 120)
    t = Tokenizer.from_file(WORD_BPE)
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    source = lambda k: None if k % 10 == 0 else "s0" if k % 10 > 6 else f"s{k % 10}"
    docs = make(spark, texts, source=source)
    targets = {"s0": 0.4, "s1": 0.1, "s2": 0.2, "s3": 0.3}
    rows = packing.mixture_pack(docs, WORD_BPE, targets=targets).collect()
    by = whole(rows, ids)
    n = collections.Counter(source(i) for i in ids for _ in ids[i])
    until = int(min(n[s] / share for s, share in targets.items())) // 2048 - 1  # windows before a source runs dry
    assert until >= 3
    for s, share in targets.items():
        served = np.cumsum([sum(r.length for r in by[w] if r.source == s) for w in range(until)])
        assert (abs(served - share * 2048 * np.arange(1, until + 1)) <= 4 * 128).all(), (s, served)
    of_named = max(r.sequence_id for r in rows if r.source in targets)
    assert of_named <= min(r.sequence_id for r in rows if r.source not in targets)
    by = whole(packing.mixture_pack(docs, WORD_BPE).collect(), ids)
    for own in by.values():
        if sum(r.length for r in own) == 2048:
            for s in n:
                assert abs(sum(r.length for r in own if r.source == s) - 2048 * n[s] / sum(n.values())) <= 4 * 128


def test_repeated_rows_are_one_document_of_a_line(spark):
    texts = ["repeated\nshared"] * 10 + ["nobody's"] * 10 + [f"shared\nown {i}" for i in range(9)]
    ids = [0] * 10 + [None] * 10 + list(range(1, 10))
    out = lines.drop_lines(make(spark, texts, ids)).collect()
    assert sorted(r.text for r in out) == sorted(["repeated"] * 10 + ["nobody's"] * 10 + [f"own {i}" for i in range(9)])


def test_near_copies_are_dropped_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(5, a), (2, a + " more"), (5, b), (5, c), (5, c), (None, d), (None, d), (None, a), (7, None)]
    docs = make(spark, [t for _, t in rows], [i for i, _ in rows])
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter([(2, a + " more"), (5, b), (5, c), (None, d), (7, None)])


def test_pipeline_stages_take_columns_of_any_name(spark, tmp_path):
    rows, marks = toxic_rows(15, 200)
    names = ["a.b", "c`d e", "r", "dropped", "toxicity", "language", "near_key", "lines_report", "row_key", "made", "c0", "has_letter", "a", "h"]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 100
        assert [tuple(r)[5:] for r in out.limit(1).collect()] == [tuple(range(len(names)))]
    assert corpus_pipeline.pack(spark, docs, "").count() >= 200


def test_pipeline_stages_take_nested_columns_and_choose_among_equal_rows(spark, tmp_path):
    rows, marks = toxic_rows(16, 150)
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = F.struct(F.lit(1).alias("my-key"), F.array(F.struct(F.lit("x").alias("b c"), F.lit(None).cast("double").alias("a.b`"))).alias("in <here>"))
    docs = docs.select("*", odd.alias("nested"), F.create_map(F.lit("k"), F.struct(F.lit(2).alias("v w"))).alias("mapped"), F.lit(None).cast("array<struct<`x-y`:int>>").alias("none"))
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() > 80
        first = out.first()
        assert first.nested["my-key"] == 1 and first.nested["in <here>"][0]["b c"] == "x" and first.mapped["k"]["v w"] == 2
    assert corpus_pipeline.pack(spark, docs, "").count() >= 150
    text = " ".join(f"w{i}" for i in range(50))
    twice = spark.createDataFrame([(1, text, lang, "s", 0, {"k": lang}) for lang in ("fr", "de", "en")] + [(2, text + " x", "aa", "s", 0, None), (3, "other words", "b", "s", 0, None)], "doc_id long, text string, lang string, source string, n_chars long, m map<string,string>")
    for parts in (1, 4):
        got = corpus_pipeline.drop_near_copies(spark, twice.repartition(parts), "").collect()
        assert sorted((r.doc_id, r.lang, str(r.m)) for r in got) == [(1, "de", "{'k': 'de'}"), (3, "b", "None")]


def test_texts_beyond_a_batch_piece(spark):
    """Texts of more than BATCH_BYTES beside short ones: op1, op3, op4, op5, op7 and op9."""
    rng = random.Random(29)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(3000)]
    long = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(90_000))
    assert len(long) > common.BATCH_BYTES
    texts = [long, "short one", long + " more", None, "a b c d e f"]
    docs = make(spark, texts).repartition(1)
    t = Tokenizer.from_file(BYTE_BPE)
    out = common.scratch(spark, "long-texts")
    huffman.write(docs, BYTE_BPE, 0, out)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in huffman.read(spark, out).collect()}
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), crc(ids))
    w = Tokenizer.from_file(WORD_BPE)
    whole(packing.mixture_pack(docs, WORD_BPE).collect(), {i: [*w.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)})
    kept = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.line_dedup(docs).collect()}
    assert kept[0] == (90_000, 0) and kept[3] == (1, 0)
    joined = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, k=3, num=90, den=100).collect()}
    own = long.split()
    assert joined[0] == (len({tuple(own[i : i + 3]) for i in range(len(own) - 2)}), 0) and joined[2][1] == 0 and joined[4] == (4, 4)
    rules = {r.doc_id: r for r in quality.repetition_rules(docs).collect()}
    assert rules[0].n_words == len(own) and rules[0].word_chars == sum(map(len, own))
    rows, marks = toxic_rows(17, 120)
    learned = make(spark, [x for _, x in rows], [i for i, _ in rows])
    model = toxicity.learn(learned, spark.createDataFrame(marks, "doc_id long, toxic int, quality int"))
    scored = {r.doc_id: r.made2.score for r in toxicity.tag(docs, model, "made2").collect()}
    assert len(scored) == 5 and all(0 <= s <= 1 for s in scored.values())


def test_a_process_holds_one_operators_tables():
    """A Python worker is handed from operator to operator: a tokenizer with its memo goes when another one's tables come."""
    first = weakref.ref(tokens.encoder(WORD_BPE, False))
    assert tokens.encoder(WORD_BPE, False) is first()
    model = language.Model({"en": b"some words\n", "de": b"ein paar worte\n"})
    assert len(model.tables()) == 2 and model.tables() is model.tables()
    assert first() is None
    packing_size = tokens.id_bytes(WORD_BPE, False)  # as the driver asks for it
    assert packing_size == 2 and not common._held


def test_scores_do_not_depend_on_the_piece():
    rows, labels = toxic_rows(77, 240)
    of = {r[0]: r[1] == 1 for r in labels}
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], ["text"])
    marks = np.array([of.get(i, False) for i, _ in rows])
    model = toxicity.train([t for _, t in rows], marks, 0.2)
    whole = model.judge(*common.flat(batch.column(0)))[0]
    cut = [model.judge(*common.flat(b.column(0)))[0] for b in common.pieces(batch, 0, 3000)]
    assert len(cut) > 5 and whole.max() > 0.3 and np.allclose(np.concatenate(cut), whole, rtol=0, atol=1e-12)
