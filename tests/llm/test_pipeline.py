"""The whole pipeline over a small table against a plain composition of its stages' rules."""

import collections
import random

import corpus_pipeline
from test_operators import WORD_BPE, brute_join, strip, tongues, toxic_rows, whole
from tokenizers import Tokenizer

from curvelake.llm import common, language, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_equals_a_plain_composition(spark, tmp_path):
    rng = random.Random(51)
    toxic, marks = toxic_rows(52, 240)
    rows = [(i, t, "en", f"s{i % 4}") for i, t in toxic]
    rows += [(1000 + i, t, lang, "t") for i, t, lang in tongues(53, 60)]
    shared = [f"everyone has line {k} of these" for k in range(3)]
    rows = [(i, "\n".join([t, rng.choice(shared), shared[0].upper() + " "]) if i % 3 == 0 else t, lang, s) for i, t, lang, s in rows]
    base = [r for r in rows if len(r[1].split()) > 25][:12]
    rows += [(2000 + k, t + " one word more", lang, s) for k, (_, t, lang, s) in enumerate(base)]
    rows += [(3000 + k, f"{base[1][1]} copy{k}", "en", "hot") for k in range(20)]
    rows += [(4000, None, None, None), (4001, "", "en", "s1"), (4002, "12 - 34", "en", "s1"), (4003, "日本語 " * 40, None, "s2"), (4004, "\n\n", "en", None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], KIND)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    # the models are the stages' own, fitted on what each stage sees; their scores are tested against their definitions elsewhere
    model = toxicity.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = {r.doc_id: r.x.score for r in toxicity.tag(docs, model, "x").collect()}
    left = [r for r in rows if score[r[0]] < 0.3]
    kept = common.materialize(spark.createDataFrame([(*r, 0) for r in left], KIND), "left")
    samples = language.learn(kept)
    known = {r.doc_id: r.x for r in language.identify(kept, samples, "x").collect()}
    left = [r for r in left if known[r[0]].lang_pred != "und" and known[r[0]].rate <= language.MISFIT]
    gone_toxic = {r[0] for r in rows} - set(score) | {i for i, s in score.items() if s >= 0.3}
    assert gone_toxic and {4000, 4001, 4002, 4003, 4004}.isdisjoint(r[0] for r in left)

    seen = collections.defaultdict(set)
    for i, t, *_ in left:
        for y in t.split("\n"):
            if strip(y):
                seen[strip(y)].add(i)
    common_lines = {k for k, v in seen.items() if len(v) >= 10}
    assert common_lines
    left = [(i, "\n".join(y for y in t.split("\n") if strip(y) not in common_lines), lang, s) for i, t, lang, s in left]
    root = {i: c for i, (_, c) in brute_join([(i, t) for i, t, *_ in left], 5, 80, 100).items()}
    dropped = [r for r in left if root[r[0]] != r[0]]
    assert len(dropped) >= 20
    left = [r for r in left if root[r[0]] == r[0]]

    tokens = Tokenizer.from_file(WORD_BPE)
    ids = {i: [*tokens.encode(t, add_special_tokens=False).ids, 1] for i, t, *_ in left}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole(packed, ids)
    assert {r.doc_id: r.source for r in packed} == {i: s for i, _, _, s in left}
