import random

import pytest
from pyspark.sql import functions as F

from hazeloom.llm import quality_lines, token_counts
from hazeloom.llm.queries import PIECES


def counts(text, limit=50):
    words = [w for w in text.translate({c: " " for c in [9, 10, 11, 12, 13]}).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.translate({c: " " for c in [9, 10, 11, 12, 13]}).strip(" ")]
    failed = len(words) < limit or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_counts_against_brute_force(spark):
    rng = random.Random(4)
    words = ["a", "b", "c.", "dé", "#x", " ", "end."]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    got = quality_lines.judge_lines(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in got:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == counts(r.text)


@pytest.mark.parametrize(
    "line,passes",
    [
        ("A plain sentence.", True),
        ('She said "no."', True),
        ("Ein Satz mit ß und «Wort».", True),
        ("No end", False),
        ("Home | About | Contact.", False),
        ("SALE!! NOW!! HERE!!", False),
        ("the$$$ of%%% and***.", False),
        ("Please accept cookies to go on.", False),
        ("We read moreover.", True),
        ("Wait!!", True),
    ],
)
def test_line_rules(spark, line, passes):
    df = spark.createDataFrame([(line,)], "x string")
    assert df.select(quality_lines.line_passes(F.col("x"))).first()[0] is passes


def test_lines_go_first_then_documents(spark):
    good = " ".join(f"word{i} other{i}." for i in range(40))
    rows = [(1, good), (2, good + "\nHome | About | Us"), (3, good[:40] + ".\n" + "bad line without end " * 30), (4, good + "\n\n" + good)]
    got = {r.doc_id: r for r in quality_lines.keep_clean(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert set(got) == {1, 2}  # 4 repeats itself
    assert got[2].text == good


def test_odd_rows(spark, odd_docs, no_docs):
    got = quality_lines.judge_lines(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.quality.base_failed for r in got)
    assert quality_lines.keep_clean(odd_docs).columns == odd_docs.columns
    assert quality_lines.judge_lines(no_docs).count() == 0
    with pytest.raises(ValueError):
        quality_lines.judge_lines(odd_docs.withColumn("Quality", F.lit(1)))
    clash = odd_docs.withColumns({"_words": F.lit(1), "_T": F.lit(2), "_found": F.lit(3)})
    assert quality_lines.judge_lines(clash).columns == [*clash.columns, "quality"]


def test_whole_token_shortcut_is_exact(spark):
    library = token_counts.load(PIECES)
    counter = token_counts.Counter(PIECES)
    assert all(len(library.encode(w)) == 1 for w in counter.whole)
    rng = random.Random(7)
    bits = ["a", "b", " ", " ", "the", "\n", "▁", "é", "日", "in", "er", "\x00", "<s>", "</s>", "<0x0A>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert [counter.of_text(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_token_counts_of_odd_rows(spark, odd_docs, no_docs):
    library = token_counts.load(PIECES)
    rows = odd_docs.select("text", token_counts.token_count(F.col("text"), PIECES).alias("n")).collect()
    assert [r.n for r in rows] == [len(library.encode(r.text or "")) for r in rows]
    assert no_docs.select(token_counts.token_count(F.col("text"), PIECES)).count() == 0


def test_cache_is_emptied_without_loss(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 10)
    counter = token_counts.Counter(PIECES)
    texts = [f"zqx{i} qzx{i}y" for i in range(40)]
    assert [counter.of_text(t) for t in texts] == [len(counter.model.encode(t)) for t in texts]
