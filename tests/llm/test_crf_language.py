import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeloom.llm import crf_language as crf

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")


@pytest.fixture(scope="module")
def field(docs):
    return crf.fit(docs, "doc_id", "text", "lang")


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(3)
    lengths, labels = np.array([5, 3, 3, 1]), 3
    potentials, moves = rng.random((lengths.sum(), labels)) + 0.05, rng.random((labels, labels)) + 0.05
    got, moved, logs = crf.forward_backward(potentials, lengths, moves, pairs=True)
    want, want_moved = np.zeros_like(got), np.zeros((labels, labels))
    for start, n in zip(np.cumsum(lengths) - lengths, lengths):
        total = 0.0
        for path in itertools.product(range(labels), repeat=n):
            w = math.prod(potentials[start + t, k] for t, k in enumerate(path)) * math.prod(moves[a, b] for a, b in zip(path, path[1:]))
            total += w
        for path in itertools.product(range(labels), repeat=n):
            w = math.prod(potentials[start + t, k] for t, k in enumerate(path)) * math.prod(moves[a, b] for a, b in zip(path, path[1:]))
            for t, k in enumerate(path):
                want[start + t, k] += w / total
            for a, b in zip(path, path[1:]):
                want_moved[a, b] += w / total
        assert logs[start : start + n].sum() == pytest.approx(math.log(total))
    assert np.allclose(got, want) and np.allclose(moved, want_moved)


def test_labelling_equals_all_paths_over_own_features(field):
    words = ["the", "und", "que", "thing"]
    names, scores = field.languages, np.zeros((len(words), len(field.languages)))
    for i, w in enumerate(words):
        for f in crf.spellings([w])[0]:
            scores[i] += field.weights[f]
        scores[i] += field.listed[field.lexicon.get(w, 0)]
    weight = {}
    for path in itertools.product(range(len(names)), repeat=len(words)):
        weight[path] = math.exp(sum(scores[t, k] for t, k in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:])))
    total = sum(weight.values())
    want = np.array([[sum(w for p, w in weight.items() if p[t] == k) / total for k in range(len(names))] for t in range(len(words))])
    ((_, got),) = crf.Labeller(field).batches([" ".join(words)])
    assert np.allclose(got, want)


def test_features_of_a_word_do_not_depend_on_its_company():
    alone, among = crf.spellings(["ab"])[0], crf.spellings(["ab", "abcdefghij"])[0]
    real = lambda row: sorted(f for f in row.tolist() if f != crf.BUCKETS)
    assert real(alone) == real(among)
    # three affix pairs would need three letters, here two; two letters with two ends: 4 single, 3 pairs, 2 triples
    assert len(real(alone)) == 2 * 2 + 4 + 3 + 2


def test_held_out_accuracy(docs, field):
    held = docs.where((crf.fold(F.col("doc_id")) == 2) & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = held.select("lang", crf.language(F.col("text"), field).alias("x")).collect()
    assert len(rows) > 150 and sum(r.lang == r.x.lang for r in rows) >= 0.97 * len(rows)
    for r in rows:
        assert sum(s.words for s in r.x.spans) == r.x.n_words and 0 < r.x.score <= 1


def test_words_of_switched_text(spark, docs, field):
    held = docs.where((crf.fold(F.col("doc_id")) == 2) & (F.length("text") > 1500)).orderBy("doc_id").limit(120).collect()
    by = {}
    for r in held:
        by.setdefault(r.lang, []).append(crf.split_words(r.text)[10:40])
    mixed, truth = [], []
    for a, b in itertools.permutations(sorted(by), 2):
        for left, right in zip(by[a][:6], reversed(by[b][:6])):
            mixed.append((len(mixed), " ".join(left + right), "x"))
            truth.append([a] * len(left) + [b] * len(right))
    got = spark.createDataFrame(mixed, "i int, text string, lang string").select("i", crf.language(F.col("text"), field).alias("x")).collect()
    right = total = 0
    for r in got:
        own = [s.lang for s in r.x.spans for _ in range(s.words)]
        total += len(own)
        right += sum(x == y for x, y in zip(own, truth[r.i]))
    assert right >= 0.97 * total


def test_nothing_is_learned_from_held_out_rows(docs, field):
    odd = docs.withColumn("lang", F.when(crf.fold(F.col("doc_id")) == 2, F.lit("xx")).otherwise(F.col("lang")))
    extra = docs.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit("yy").alias("lang"), "source")
    again = crf.fit(odd.union(extra).repartition(5), "doc_id", "text", "lang")
    assert again.languages == field.languages and again.lexicon == field.lexicon
    assert (again.weights == field.weights).all() and (again.moves == field.moves).all()


def test_odd_rows(spark, odd_docs, no_docs, field):
    rows = [(1, None), (2, ""), (3, "12 ½ ² !!"), (4, "x" * 30000), (5, "the " * 40000), (6, "THE, the"), (6, "THE, the"), (None, "ÀÉ 日本語")]
    df = spark.createDataFrame([(*r, "score") for r in rows], "doc_id bigint, text string, lang string").withColumn("spans", F.lit(1))
    got = df.select("doc_id", "text", "spans", crf.language(F.col("text"), field).alias("x")).collect()
    for r in got:
        none = r.doc_id in (1, 2, 3)
        assert (r.x.lang == crf.UNKNOWN) == none and (r.x.score == 0) == none and (r.x.n_words == 0) == none
        assert none or r.x.lang in field.languages
    sizes = {r.doc_id: r.x.n_words for r in got}
    assert sizes[4] == 1250 and sizes[5] == 40000 and sizes[6] == 2
    for docs in (no_docs, odd_docs.where("false")):
        assert crf.fit(docs.withColumn("lang", F.lit("a")), "doc_id", "text", "lang") is None
    assert crf.fit(odd_docs.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang") is None
    (r,) = df.where("doc_id = 5").select(crf.language(F.col("text"), None).alias("x")).collect()
    assert (r.x.lang, r.x.score, r.x.spans) == (crf.UNKNOWN, 0.0, [])
    one = crf.fit(odd_docs.withColumn("lang", F.lit("a")), "doc_id", "text", "lang")
    assert one.languages == ["a"]


def test_query(spark):
    from hazeloom.llm.queries import op13_crf_language

    got = op13_crf_language(spark, "/root/testdata/sf0.001")
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert {r.held_out for r in rows} == {True, False}
