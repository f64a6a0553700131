"""The corpus pipeline: each stage judged on what its predecessor kept."""

import hashlib

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import mixing, near_dup, quality
from lorekeep.llm.common import table
from lorekeep.llm.queries import bpe_vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows of documents and of each stage's result."""
    top, docs = tmp_path_factory.mktemp("steps"), table(spark, SF, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        found.append(docs)
    return found


def test_columns(steps):
    assert [sorted(x.columns) for x in steps[:-1]] == [sorted(COLUMNS)] * 5


def test_quality_drops_what_it_rejects(spark, steps):
    judged = quality.judged(steps[0], table(spark, SF, "labels"))
    assert sorted(r.doc_id for r in judged.where("kept").collect()) == sorted(r.doc_id for r in steps[1].collect())


def test_lines_go_and_documents_stay(steps):
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in steps[1:3])
    assert before.keys() == after.keys()
    lines = [line for t in after.values() for line in t.split("\n") if line.strip()]
    assert len(lines) == len(set(lines))
    for i, text in after.items():
        assert [x for x in before[i].split("\n") if x in set(text.split("\n"))] or not text


def test_one_document_of_each_class_stays(steps):
    texts = {r.doc_id: r.text for r in steps[2].collect()}
    kept = {r.doc_id for r in steps[3].collect()}
    ids = sorted(kept)
    assert kept <= texts.keys()
    # every document that went is like one before it, which itself may have gone for another
    for gone in texts.keys() - kept:
        assert any(near_dup.linked(*(near_dup.Words(near_dup.word_hashes(t.split())) for t in (texts[gone], texts[i]))) for i in texts if i != gone)
    assert not [(a, b) for a in ids for b in ids if a < b and texts[a] == texts[b]]


def test_mix_meets_its_targets(steps):
    """The stage tells rows apart by their text too, so it need not take the same words as mix() of each document, but as many of each source."""
    plan = steps[3].transform(mixing.mix)
    target = {r.source: r.target for r in plan.select("source", "target").distinct().collect()}
    size = {r.doc_id: r.size for r in plan.collect()}
    words = steps[4].select("doc_id", "source", mixing.size_of(F.col("text")).alias("n")).collect()
    assert all(0 < r.n <= 3 * size[r.doc_id] for r in words)
    for source, wanted in target.items():
        assert abs(sum(r.n for r in words if r.source == source) - wanted) <= 0.01 * wanted + 1


def test_tokens_as_the_library_gives_them(steps):
    import base64

    ranks, pattern = bpe_vocabulary()
    known = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=known, special_tokens={})
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    for r in steps[5].collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
