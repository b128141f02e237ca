import random
from collections import defaultdict

import pytest

from hazeloom.llm import mixing


def water_level(sizes):
    """Targets by repeated resharing: sources at three times their size drop out until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def make(spark, counts, seed=1):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 3, 10, 40, 200]), s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize("bucket_rows", [1024, 5])
def test_taken_words_meet_the_targets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)  # five: a tree of several levels
    df = make(spark, {"a": 300, "b": 60, "c": 7, None: 90, "Z": 400, "é": 2})
    rows = mixing.mixed(df, "doc_id", "text", "source").collect()
    assert sorted(r.row.doc_id for r in rows) == list(range(859))
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len((r.row.text or "").split()) and 0 <= r.copies <= 3
        sizes[r.row.source] += r.size
        taken[r.row.source] += r.copies * r.size
        most[r.row.source] = max(most[r.row.source], r.size)
    targets = water_level(sizes)
    for r in rows:
        assert r.source_size == sizes[r.row.source] and r.target == pytest.approx(targets[r.row.source])
        if r.size:
            assert r.copies - 1 <= r.target / r.source_size <= r.copies + 1
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= most[s] / 2 + 1e-6
    again = mixing.mixed(df.repartition(7), "doc_id", "text", "source").collect()
    assert {(r.row.doc_id, r.copies) for r in again} == {(r.row.doc_id, r.copies) for r in rows}


def test_probabilities_are_kept():
    sizes, shares = [50, 40, 30, 20, 10, 5], [0.3, 0.6, 0.25, 0.5, 0.9, 0.1]
    sums = [0.0] * 6
    for i in range(4000):
        x = list(shares)
        done, at = mixing.pivotal(sizes, x, str(i))
        values = [x[at] if j == at else d for j, d in enumerate(done)]
        assert sum(s * v for s, v in zip(sizes, values)) == pytest.approx(sum(s * v for s, v in zip(sizes, shares)))
        sums = [a + b for a, b in zip(sums, values)]
    assert all(abs(s / 4000 - p) < 0.04 for s, p in zip(sums, shares))
    assert mixing.pivotal([], [], "x") == ([], -1) and mixing.pivotal([3, 0], [1.0, 0.5], "x") == ([1, 0], -1)


def test_mix_repeats_rows(spark, odd_docs, no_docs):
    out = mixing.mix(odd_docs, "doc_id", "text", "source")
    assert out.columns == odd_docs.columns and out.count() > 0
    assert len(mixing.mixed(odd_docs, "doc_id", "text", "source").collect()) == odd_docs.count()
    assert mixing.mix(no_docs, "doc_id", "text", "source").count() == 0
    wordless = odd_docs.where("text = ''")
    assert [r.copies for r in mixing.mixed(wordless, "doc_id", "text", "source").collect()] == [0]
