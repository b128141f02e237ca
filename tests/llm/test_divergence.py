import random
import re
from collections import Counter, defaultdict

import numpy as np

from hazeloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "lang string, source string, text string, rank int, term string, n bigint"


def brute_force(rows):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs = [(lang or "", source or "", [t.translate(lower) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted(t for t, n in seen.items() if n >= 3)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if seen[t] >= 3)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            over = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:200]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(over, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    found = divergence.audit(df, "lang", "source", "text")
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


def made(n, sources, seed, words=120):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["ab", "Éa", "zß", "日本", "Qx"]) + "".join(rng.choice("abcdeé") for _ in range(rng.randint(0, 3))) for _ in range(words)]
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        text = " ".join(rng.choice(vocabulary[: 10 if hot else words]) + rng.choice(["", ",", "7", "_"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["aa", "bb", None]), "s0" if hot else f"s{rng.randrange(sources)}", text))
    return rows


def test_equals_brute_force(spark):
    rows = made(150, 4, 1)
    assert run(spark, rows) == brute_force(rows)


def test_many_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "RANGE_TERMS", 9)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    rows = made(200, 7, 2)
    assert run(spark, rows) == brute_force(rows)


def test_more_terms_than_ranks(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(700)]
    rows = [("l", s, " ".join(rng.choice(words[a:b]) for _ in range(2000))) for s, a, b in (("x", 0, 500), ("y", 300, 700)) for _ in range(4)]
    got = run(spark, rows)
    assert got == brute_force(rows) and sum(r[1:3] == ("x", "term") for r in got) == 200


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "", ""), ("a", None, "x y x"), ("a", "s", "X y"), ("a", "s", "x Y"), ("a", "t", None), ("a", "", "\n  9")]
    rows += [("b", "s", "only twice"), ("b", "t", "only twice"), ("b", "empty", ""), ("c", "lone", "q q q"), ("c", "lone", "w " * 5000 + "x" * 30000)]
    rows += rows[2:5]
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, []) == []


def test_equal_subtrees_are_one_node_and_are_priced_once():
    groups, terms = 6, 1024
    rng = np.random.default_rng(1)
    half = [(t, int(rng.zipf(1.5)) % 7 + 1) for t in range(512) if rng.random() < 0.3]
    cells = [(g, t, c) for g in range(groups) for t, c in half] + [(g, 512 + 64 * g, 5) for g in range(groups)]
    forest = divergence.Forest(*map(np.array, zip(*cells)), groups, terms)
    apart = sum(map(len, forest.levels))
    alone = [divergence.Forest(*map(np.array, zip(*[(0, t, c) for g, t, c in cells if g == own])), 1, terms) for own in range(groups)]
    assert apart < sum(map(len, alone[0].levels)) + 3 * forest.height * groups < sum(sum(map(len, f.levels)) for f in alone)
    others = np.arange(1, groups)
    pair, left, right, times = forest.walk(others, np.full(len(others), forest.roots[0]), forest.roots[others])
    assert times.sum() == terms * len(others) and forest.priced < terms * len(others) / 2
    dense = np.zeros((groups, terms), np.int64)
    for g, t, c in cells:
        dense[g, t] = c
    for b in others:
        want = Counter(zip(dense[0].tolist(), dense[b].tolist()))
        got = {(forest.leaves[x], forest.leaves[y]): n for p, x, y, n in zip(pair, left, right, times) if p == b}
        assert got == want


def test_great_counts_stay_exact():
    leaves = np.array([0, 3, 10**12])
    assert divergence.shares(leaves, 10**12 + 3, 5).tolist() == [1 + 10**9 * (c + 1) // (10**12 + 8) for c in (0, 3, 10**12)]
