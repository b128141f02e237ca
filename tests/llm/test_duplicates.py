import inspect
import random

import numpy as np
import xxhash

from hazeloom.llm import chunk_dedup, components, simhash


def prints(text, words, bits=64):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Smallest node that is reachable, by search over all pairs."""
    name = {}
    for start in sorted(nodes):
        if start in name:
            continue
        todo = [start]
        name[start] = start
        while todo:
            a = todo.pop()
            for b in nodes:
                if b not in name and linked(a, b):
                    name[b] = start
                    todo.append(b)
    return name


def sample_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = []
    for i in range(n):
        if i % 3 and texts:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(words))
    return texts


def test_fingerprints_and_components_against_all_pairs(spark):
    texts = sample_texts(1, 160)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    own = {i: prints(t, 3) for i, t in enumerate(texts)}
    expected = groups(own, lambda a, b: bin(own[a] ^ own[b]).count("1") <= 3)
    for block_rows in (20_000, 1):  # one: every shard is dealt into blocks
        got = {r["key"]: r for r in simhash.classes(df, "doc_id", "text", block_rows=block_rows).collect()}
        assert {k: r.prints[0] % 2**64 for k, r in got.items()} == own
        assert {k: r.component for k, r in got.items()} == expected
    assert len(set(expected.values())) < len(texts) - 20


def test_one_of_each_group_of_near_copies(spark):
    texts = sample_texts(2, 120)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    expected = groups(range(len(texts)), alike)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.one_of_each(df, "doc_id", "text").collect()}
    assert kept <= set(expected.values())  # every near copy is caught
    pairs = [(a, b) for a in kept for b in expected if a != b]
    overlap = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    lone = {a for a in expected.values() if all(overlap(a, b) < 0.3 for b in range(len(texts)) if a != b)}
    assert lone <= kept and pairs


def shared_passage_texts():
    """Texts of their own words around one passage (similarity 0.6 to 0.7), and a chain whose neighbours alone have 0.8."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    passage = [word() for _ in range(160)]
    texts = [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]) for _ in range(30)]
    chain = [word() for _ in range(500)]
    return texts + [" ".join(chain[i * 20 : i * 20 + 300]) for i in range(8)]


def test_links_are_checked_by_similarity(spark):
    texts = shared_passage_texts()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    expected = groups(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sorted(set(expected.values())) == list(range(31))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.one_of_each(df, "doc_id", "text").collect()} == set(range(31))
    for block_sets in (2_000, 3):  # three: every component is dealt into blocks
        found = simhash.classes(df, "doc_id", "text", 5, 192, 45, 0.99, similarity=0.8, block_sets=block_sets)
        assert {r.key: r.component for r in found.collect()} == expected


def test_tree_search_is_complete():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (40, 1), dtype=np.int64)
    near = np.concatenate([base ^ (np.int64(1) << rng.integers(0, 62, (40, 1))) for _ in range(12)])
    x = np.unique(np.concatenate([base, near]), axis=0)
    for radius in (1, 2, 3, 12):
        got = set()
        for query, row in simhash.BKTree(x).within(x, radius):
            got |= set(zip(query.tolist(), row.tolist()))
        want = {(i, j) for i in range(len(x)) for j in np.flatnonzero(simhash.distances(x, x[i]) <= radius)}
        assert got == want
        left, right = simhash.shard_links(x, radius)
        linked = {(int(a), int(b)) for a, b in zip(left, right)}
        near_pairs = lambda a, b: simhash.distances(x[a], x[b]) <= radius
        assert groups(range(len(x)), near_pairs) == groups(range(len(x)), lambda a, b: (a, b) in linked or (b, a) in linked)
        assert len(left) == len(set(left.tolist())) < len(x)


def test_the_tree_does_the_pruning():
    """A shard of twenty thousand without any band: few distances are computed, and no link is lost."""
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**63), 2**63 - 1, (20_000, 1), dtype=np.int64)
    for i in range(0, 3000, 3):  # chains of near fingerprints
        x[i + 1] = x[i] ^ np.int64(0b101 << (i % 60))
        x[i + 2] = x[i + 1] ^ np.int64(0b111 << (i % 50))
    tree = simhash.BKTree(x)
    left, right = simhash.shard_links(x, 3, tree)
    assert tree.compared < 0.12 * len(x) ** 2
    wide = simhash.BKTree(x[:4000])
    list(wide.within(x[:4000], 40))
    assert wide.compared > 0.9 * 4000**2  # where the radius is wide, no edge is skipped
    assert {(int(a), int(b)) for a, b in zip(left, right)} == {(i + j, i) for i in range(0, 3000, 3) for j in (1, 2)}


def test_a_dense_group_is_hardly_compared_with_itself():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.integers(-(2**63), 2**63 - 1, (1, 3), dtype=np.int64), 6000, axis=0)
    x[np.arange(6000), rng.integers(0, 3, 6000)] ^= rng.integers(0, 2**16, 6000)  # all within 32 bits of each other
    tree = simhash.BKTree(np.unique(x, axis=0))
    left, right = simhash.shard_links(tree.prints, 45, tree)
    assert len(left) == len(tree.prints) - 1 and (right == 0).all()
    assert tree.compared < 0.25 * len(tree.prints) ** 2


def test_tables_of_bits():
    assert [len(t) for t in simhash.bit_tables(1000, 64, 3, 0.9)] == [1, 1, 1, 1]  # as at any size: halves of each piece
    some = simhash.bit_tables(10**6, 64, 3, 0.9)
    assert len(some) == 4 and all(len(t) == 4 for t in some)
    rng = random.Random(5)
    for n in (10**6, 10**9, 10**14):
        tables = simhash.bit_tables(n, 64, 3, 0.9)
        assert all(n / 2 ** len(t) <= simhash.SHARD_ROWS for t in tables)
        for _ in range(200):  # no choice of three bits touches every table
            flipped = set(rng.sample(range(64), 3))
            assert any(not flipped & set(t.tolist()) for t in tables)


def test_shards_of_leading_bits_lose_no_link(spark, monkeypatch):
    texts = sample_texts(2, 300)
    own = {i: prints(t, 3) for i, t in enumerate(texts)}
    expected = groups(own, lambda a, b: bin(own[a] ^ own[b]).count("1") <= 3)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 30)
    assert [len(t) for t in simhash.bit_tables(len(set(own.values())), 64, 3, 0.9)][0] >= 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["key"]: r.component for r in simhash.classes(df, "doc_id", "text").collect()} == expected


def test_sampled_tables_miss_few_pairs_of_the_similarity():
    rng = np.random.default_rng(6)
    on = lambda x: np.unpackbits(np.array([simhash._majority(simhash._remix(x, i)) for i in (1, 2, 3)]).view(np.uint8), bitorder="little")
    pairs = []
    for _ in range(400):  # 160 of 200 shingles are shared
        h = rng.integers(0, 2**63, 200).astype(np.uint64)
        pairs.append(on(h[:180]) == on(h[20:]))
    defaults = dict(zip(list(inspect.signature(simhash.one_of_each).parameters)[5:], simhash.one_of_each.__defaults__[2:]))
    for n in (7_631, 10**7):
        tables = simhash.bit_tables(n, 192, **defaults)
        assert sum(not any(same[t].all() for t in tables) for same in pairs) <= 2


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.u: r.v for r in components.connected(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)}
    assert components.connected(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.classes(odd_docs, "doc_id", "text").collect()
    assert len(got) == odd_docs.count()
    by = {r["key"]: r.component for r in got}
    assert by[0] == by[1] == by[2] == by[None] == 0 and by[9] == by[10] == 9
    kept = simhash.one_of_each(odd_docs, "doc_id", "text")
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 4, 5, 6, 7, 8, 9]
    assert simhash.classes(no_docs, "doc_id", "text").count() == 0
    assert simhash.one_of_each(no_docs, "doc_id", "text").count() == 0


PASSAGE = " ".join(f"passage{i} of{i * 7 % 13} words{i * 3 % 11}" for i in range(25))


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_passages_stay_once_and_clean_texts_stay(spark):
    rows = [(i, f"{prose(i)} {PASSAGE} {prose(1000 + i)}") for i in range(6)] + [(i, prose(i * 31)) for i in range(6, 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.dedup for r in chunk_dedup.without_repeats(df, "doc_id", "text").collect()}
    whole = dict(rows)
    assert got[0].text == whole[0]
    for i in range(1, 6):
        left = got[i].text
        assert got[i].n_runs == 1 and got[i].n_words >= 25
        assert prose(i)[:500] in left and prose(1000 + i)[-500:] in left
        assert got[i].n_words == len(whole[i].split()) - len(left.split())
    assert all(got[i].text == whole[i] and got[i].n_bytes == 0 for i in range(6, 12))


def brute_force(texts, min_words):
    """First occurrences of chunk pairs by key and place; runs of pairs whose first occurrences follow each other."""
    seen, out = {}, {}
    for key in sorted(texts):
        raw = texts[key].encode()
        cuts = [0, *chunk_dedup.cut_points(np.frombuffer(raw, np.uint8)).tolist()]
        chunks = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        gone, runs = [False] * len(chunks), []
        for i, chunk in enumerate(chunks):
            if len(chunk.split()) >= min_words and seen.setdefault((chunk,), (key, i)) != (key, i):
                gone[i] = True
        for i, pair in enumerate(zip(chunks, chunks[1:])):
            there = seen.setdefault(pair, (key, i))
            if there == (key, i):
                continue
            if runs and runs[-1][-1][0] == i - 1 and runs[-1][-1][1] == (there[0], there[1] - 1):
                runs[-1].append((i, there))
            else:
                runs.append([(i, there)])
        for run in runs:
            places = range(run[0][0], run[-1][0] + 2)
            if sum(len(chunks[j].split()) for j in places) >= min_words:
                for j in places:
                    gone[j] = True
        out[key] = b"".join(c for c, g in zip(chunks, gone) if not g).decode()
    return out


def test_chunks_against_brute_force(spark):
    rng = random.Random(9)
    parts = [prose(i, 60) for i in range(8)]
    texts = {i: " ".join(rng.choice(parts) if rng.random() < 0.5 else prose(100 + 10 * i + j, 40) for j in range(4)) for i in range(25)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.dedup.text for r in chunk_dedup.without_repeats(df, "doc_id", "text", min_words=15).collect()}
    assert got == brute_force(texts, 15) and sum(got[i] != texts[i] for i in texts) > 10


def test_what_goes_stands_in_an_earlier_place_in_one_piece(spark):
    rng = random.Random(12)
    phrases = [prose(i, 6) for i in range(60)]  # every phrase is seen everywhere, in ever other orders
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(30))) for i in range(60)]
    rows += [(100 + i, f"{prose(500 + i)} {PASSAGE} {prose(700 + i)}") for i in range(3)]
    got = {r.doc_id: r.dedup.text for r in chunk_dedup.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert all(got[i] == text for i, text in rows[:61])
    assert all(len(got[100 + i].split()) < 250 for i in (1, 2))


def test_texts_without_a_key_or_with_the_same_key_do_not_mix(spark):
    long = prose(1, 120)
    for key in (None, 7):
        rows = [(1, long), (key, f"{prose(2, 40)} {long}"), (key, f"{prose(3, 90)} {long} {prose(4, 30)}")]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        out = [r.dedup for r in chunk_dedup.without_repeats(df, "doc_id", "text").collect() if r.doc_id == key]
        assert all(d.n_words >= 100 for d in out)
        left = sorted(d.text for d in out)
        assert any(t.startswith(prose(2, 40)[:200]) for t in left) and any(t.startswith(prose(3, 90)[:400]) and t.endswith(prose(4, 30)[-150:]) for t in left)


def test_periodic_and_unspaced_passages(spark):
    rng, periodic = random.Random(3), "and the " * 60
    rows = [(i, f"{prose(i)} {periodic} {prose(50 + i)}") for i in range(3)]
    unspaced = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(3000))
    rows += [(10 + i, f"{prose(90 + i)} {unspaced}") for i in range(2)]
    got = {r.doc_id: r.dedup.text for r in chunk_dedup.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    for i in range(3):
        assert got[i].count("and the") < (30 if i == 0 else 12)
    assert len(got[10]) == len(rows[3][1]) and len(got[11]) < len(rows[4][1]) - 1000


def test_boundaries_follow_the_content():
    raw = prose(5, 400).encode()
    cuts = chunk_dedup.cut_points(np.frombuffer(raw, np.uint8))
    moved = chunk_dedup.cut_points(np.frombuffer(b"inserted words " + raw, np.uint8)) - 15
    assert len(set(cuts) - set(moved)) <= 2
    for text in ("日本語" * 9000, "x" * 30000, "é" * 20001):
        raw = text.encode()
        cuts = chunk_dedup.cut_points(np.frombuffer(raw, np.uint8))
        assert cuts[-1] == len(raw) and np.diff(cuts, prepend=0).max() <= chunk_dedup.LONGEST + 3
        assert "".join(raw[a:b].decode() for a, b in zip([0, *cuts[:-1]], cuts)) == text


def test_chunk_dedup_of_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.union(spark.createDataFrame([(20, "word " * 4000, None, 1, "k")], odd_docs.schema))
    got = chunk_dedup.without_repeats(df, "doc_id", "text")
    assert got.columns == [*df.columns, "dedup"]
    rows = {r.doc_id: r.dedup.text for r in got.collect()}
    assert rows[0] is None and rows[1] == "" and rows[9] == "tie tie tie"
    assert len(rows[20]) < 100
    assert chunk_dedup.without_repeats(no_docs, "doc_id", "text").count() == 0
