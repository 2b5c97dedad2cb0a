"""One handle drops all that queries have written."""

import os

import pytest

from curvelake import catalog, scratch
from curvelake.llm import common, ngram_join

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["J16_release_chain", "G3_largest_component", "S12_document_attempts", "X9_transfer", "S4_append_once", "C8_issue_numbers", "D5_build"])
def test_nothing_stays_of_a_query(spark, name):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(scratch.names(spark, base))
    with scratch.passing(spark):
        n = catalog.queries()[name](spark, SF).count()
        assert set(scratch.names(spark, base)) > before
    assert n and set(scratch.names(spark, base)) == before


def test_what_is_kept_belongs_to_the_block_around(spark):
    with scratch.passing(spark):
        with scratch.passing(spark):
            inner = scratch.folder(spark, "inner")
            kept = scratch.materialize(spark.range(3), "kept", keep=True)
            scratch.write(spark.range(2), inner)
        assert kept.count() == 3 and not scratch.names(spark, inner)
        path = os.path.dirname(kept.inputFiles()[0])
        assert scratch.names(spark, path)
    assert not scratch.names(spark, path)


def test_tables_of_the_ngram_join_go_when_nothing_reads_them(spark, monkeypatch):
    base, write, stood = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"), scratch.write, {}

    def told(df, path):
        stood.setdefault(os.path.basename(path).split("-")[0], {n.split("-")[0] for n in scratch.names(spark, base)})
        return write(df, path)

    monkeypatch.setattr(scratch, "write", told)
    words = [f"word{i}" for i in range(60)]
    rows = [(k, " ".join([*words[: 10 * (k % 3)], f"other{k}", *words[10 * (k % 3) + 1 :]])) for k in range(12)]
    with common.passing(spark):
        out = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80, 100).collect()}
    assert set(out.values()) == {0}
    assert "shared" in stood["buckets"] and "filed" in stood["buckets"]  # which are shared is known, and its shuffle gone, before the join
    assert not {"filed", "shared"} & stood["judged"]  # what the sets file is larger than all that follows
    assert "sets" in stood["judged"] and "sets" not in stood["prefixes"]
