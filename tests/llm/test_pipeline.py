import numpy as np
import pytest

import corpus_pipeline
from hazeloom.llm import mixing, quality_lines, segmentation
from hazeloom.llm.common import stored
from hazeloom.llm.queries import PIECES

from .test_duplicates import brute_force, prints


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mix", "segment"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == stages["documents"].columns
        assert stages[name].where("n_chars <> length(text)").count() == 0 or name == "documents"


def test_quality_keeps_what_the_rules_keep(stages):
    judged = {r.doc_id: r.quality for r in quality_lines.judge_lines(stages["documents"]).collect()}
    kept = {r.doc_id: r.text for r in stages["quality"].collect()}
    assert kept == {i: q.clean_text for i, q in judged.items() if q.kept} and 0 < len(kept) < len(judged)


def test_no_two_near_copies_stay(stages):
    before = {r.doc_id: r.text for r in stages["quality"].collect()}
    after = {r.doc_id for r in stages["near_dedup"].collect()}
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in before.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert not [(a, b) for a in after for b in after if a < b and like(a, b) >= 0.8]
    assert all(max(like(i, b) for b in before if b < i) >= 0.3 for i in set(before) - after)
    assert len({prints(before[i], 5) for i in after}) == len(after)


def test_substrings_against_brute_force(stages):
    before = {r.doc_id: r.text for r in stages["near_dedup"].collect()}
    after = {r.doc_id: r.text for r in stages["substring_dedup"].collect()}
    assert after == {i: t for i, t in brute_force(before, 20).items() if t.strip()}


def test_mix_takes_copies(stages):
    want = {r.row.doc_id: r.copies for r in mixing.mixed(stages["substring_dedup"], "doc_id", "text", "source").collect()}
    got = {r.doc_id: r["count"] for r in stages["mix"].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_segments_decode_to_the_mix(stages):
    pieces = segmentation.lattices(PIECES).pieces
    texts = {r.doc_id: r.text for r in stages["mix"].collect()}
    rows = stages["segment"].collect()
    assert len(rows) == stages["mix"].count()
    assert all(pieces.decode(np.array(r.ids).tolist()) == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def test_stages_on_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs.withColumnRenamed("key", "lang"), no_docs.withColumnRenamed("key", "lang")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, "").count() <= 3 * odd_docs.count()
