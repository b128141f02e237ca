import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazeloom.llm import segmentation
from hazeloom.llm.queries import PIECES

TABLE = segmentation.lattices(PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from(" \n▁the ing")), min_size=1, max_size=60))
def test_round_trip(text):
    (ids,) = TABLE.sample([text], np.array([7], np.uint64))
    assert TABLE.pieces.decode(ids.tolist()) == text


def segmentations(text, pieces):
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            for rest in segmentations(text[n:], pieces):
                yield (pieces[text[:n]], *rest)


def test_samples_follow_the_lattice():
    pieces = {t.decode(): i for i, t in enumerate(TABLE.pieces.bytes) if i > 258}  # the first are bytes and controls
    theta = 2e-5
    table = segmentation.Lattices(TABLE.pieces, theta)
    ways = list(segmentations(" these", pieces))
    weight = [math.exp(theta * sum(TABLE.pieces.score[i] for i in w)) for w in ways]
    expected = {w: x / sum(weight) for w, x in zip(ways, weight)}
    n = 20_000
    seen = Counter(tuple(x.tolist()) for x in table.sample(["these"] * n, np.arange(n, dtype=np.uint64)))
    assert set(seen) <= set(expected) and len(ways) > 10
    assert all(abs(seen[w] / n - p) < 0.02 for w, p in expected.items())


def test_rows_are_reproducible_in_any_batch(spark):
    rows = [(i % 50, f"these things {i % 50} are said again and again\n▁ ü 日 ") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = segmentation.segmented(df.repartition(5), "doc_id", "text", PIECES).collect()
    assert all(r.restored for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r.doc_id, r.ids) == r.ids
    assert len({len(x) for x in by.values()}) > 1
    other = segmentation.segmented(df, "doc_id", "text", PIECES, seed=1).collect()
    assert any(by[r.doc_id] != r.ids for r in other)
    back = segmentation.segmented(df, "doc_id", "text", PIECES).select("text", segmentation.decode(F.col("ids"), PIECES).alias("t"))
    assert all(r.text == r.t for r in back.collect())


def test_draws_next_to_one_stay_in_their_state(monkeypatch):
    table = segmentation.Lattices(TABLE.pieces, 5e-4)
    table.sample([f"word{i} other thing" for i in range(200)], np.arange(200, dtype=np.uint64))
    monkeypatch.setattr(segmentation, "_mix", lambda x: np.full(len(x), 2**64 - 1, np.uint64))
    for text in ("word7 other", "thing word150 other", "these new things"):
        (ids,) = table.sample([text], np.array([7], np.uint64))
        assert table.pieces.decode(ids.tolist()) == text


def test_forgetting_changes_nothing(monkeypatch):
    texts, seeds = [f"word{i} other{i % 7} thing" for i in range(60)], np.arange(60, dtype=np.uint64)
    whole = segmentation.Lattices(TABLE.pieces, 5e-4).sample(texts, seeds)
    monkeypatch.setattr(segmentation, "MOST_EDGES", 50)
    table = segmentation.Lattices(TABLE.pieces, 5e-4)
    parts = [table.sample([t], seeds[i : i + 1])[0] for i, t in enumerate(texts)]
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_odd_rows(spark, odd_docs, no_docs):
    got = segmentation.segmented(odd_docs, "doc_id", "text", PIECES)
    assert got.columns == [*odd_docs.columns, "ids", "restored"]
    rows = got.collect()
    assert all(r.restored for r in rows) and len(rows) == odd_docs.count()
    assert all((r.ids is None) == (r.text is None) for r in rows)
    assert segmentation.segmented(no_docs, "doc_id", "text", PIECES).count() == 0
    with pytest.raises(ValueError):
        segmentation.segmented(odd_docs.withColumn("IDS", F.lit(1)), "doc_id", "text", PIECES)
