"""Every operator over the table of edge cases and over an empty one."""

from collections import Counter

import pytest

import corpus_pipeline
from veilframe.llm import decontaminate, licenses, mixing, neardup, packing, passages, quality, suffixes, tokens, urls

PER_ROW = {
    "mix": (lambda d: mixing.mix_sources(d)),
    "quality": (lambda d: quality.judge_quality(d)),
    "neardup": (lambda d: neardup.find_near_duplicates(d)),
    "suffixes": (lambda d: suffixes.find_repeats(d)),
    "licenses": (lambda d: licenses.scan_licenses(d)),
    "decontaminate": (lambda d: decontaminate.find_contamination(d, d.sparkSession.createDataFrame([(1, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11"), (2, None), (None, "one")], "item_id long, text string"))),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_per_document(edge, nothing, name):
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(PER_ROW[name](edge)) == ids(edge)
    assert PER_ROW[name](nothing).count() == 0


def test_mix(edge):
    rows = mixing.mix_sources(edge).collect()
    assert all(r["copies"] == 0 for r in rows if r["size"] == 0) and all(0 <= r["copies"] <= 3 for r in rows)
    taken = mixing.take_mix(edge)
    assert taken.columns == edge.columns and taken.count() == sum(r["copies"] for r in rows)


def test_quality(edge):
    rows = {r["doc_id"]: r for r in quality.judge_quality(edge).collect()}
    assert all(rows[k]["base_failed"] and not rows[k]["kept"] for k in (1, 2, 3, 4)) and rows[1]["n_words"] == 0
    assert rows[9]["n_dup_lines"] == 2 and rows[8]["n_repeat_words"] == 80
    assert quality.keep_quality(edge).columns == edge.columns and quality.keep_quality(edge.filter("false")).count() == 0


def test_near_duplicates(edge):
    rows = neardup.find_near_duplicates(edge).collect()
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6} and next(r for r in rows if r["doc_id"] == 1)["n_shingles"] == 0
    assert next(r for r in rows if r["doc_id"] == 4)["n_shingles"] == 1
    kept = neardup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 8, 9, 10, None])


def test_suffixes(edge):
    rows = {r["doc_id"]: r for r in suffixes.find_repeats(edge).collect()}
    assert rows[1]["n_bytes"] == 0 and rows[7]["n_removed"] == rows[7]["n_bytes"] >= 400 and rows[10]["n_removed"] == 5000 and rows[5]["n_removed"] == 0


def test_decontaminate(edge, nothing):
    benchmark = edge.sparkSession.createDataFrame([(1, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11"), (2, None), (None, "one")], "item_id long, text string")
    clean = decontaminate.decontaminate(edge, benchmark)
    assert clean.columns == edge.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter([1, 2, 3, 5, 8, 9, 10])
    assert decontaminate.decontaminate(edge, benchmark.filter("false")).count() == edge.count()


def test_packing_and_tokens(edge, nothing):
    assert packing.pack_documents(nothing).count() == 0 and tokens.count_tokens(nothing).count() == 0
    counts = tokens.count_tokens(edge).collect()
    assert [(r["section"], r["n_tokens"]) for r in counts if r["doc_id"] == 2] == [(0, 0)] and len([r for r in counts if r["doc_id"] == 9]) == 4
    placed = Counter(d for r in packing.pack_documents(edge).collect() for d, p in zip(r["doc_ids"], r["pieces"]) if p == 0)
    assert placed == Counter([3, 4, 5, 6, 6, 7, 8, 9, 10, None])


def test_passages(edge, nothing):
    found = {(r["doc_id"], r["source_doc_id"]) for r in passages.find_passages(edge).collect()}
    assert (7, 6) in found and not any(None in p for p in found)
    assert passages.find_passages(nothing).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (4, "http://A.net", "x"), (4, "http://A.net", "x"), (5, "ftp://x.EXAMPLE.net/en/a?b#c", None), (6, "a://b://c/d", "x"), (7, "http://net/\n", "x")], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert len(rows) == 7 and (rows[1]["host"], rows[1]["path"], rows[1]["verdict"]) == ("", "", "allow") and rows[3]["host"] == ""
    assert rows[4]["rule"] is None and rows[4]["path"] == "" and rows[5]["rule"] == "example.net/en/" and rows[5]["verdict"] == "allow"
    assert rows[6]["host"] == "b:" and rows[7]["rule"] == "net/"
    assert urls.filter_urls(pages.filter("false")).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, edge, nothing, k):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, edge, "/root/testdata/sf0.001")
    kept = quality.judge_quality(edge).filter("kept").count()
    assert out.count() == kept if k == 0 else out.count() > 0
    assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == edge.columns
    assert stage(spark, nothing, "/root/testdata/sf0.001").count() == 0
