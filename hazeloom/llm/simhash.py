"""SimHash near-duplicates with BK-trees.

1. A fingerprint per document: the majority bits of the hashes of its word shingles. Equal fingerprints become one
   node, so copies cost nothing further.
2. Shards of some hundred thousand fingerprints, 8 bytes each. With a small radius two fingerprints within it agree on
   one of radius + 1 pieces, so a shard of equal leading bits of a piece loses no link. With a wide radius a shard is a
   set of equal sampled bits, and the number of samples follows from the wanted chance that a pair at the very radius,
   or a pair of the wanted similarity, shares a shard.
3. In each shard a BK-tree (children keyed by their distance to the parent, leaves of a few fingerprints) answers
   which fingerprints lie within the radius, following only edges within it. All queries go down the tree together, so
   each node is compared with all that reach it at once. Pairs are united as they are found, and a task emits one link
   per fingerprint to the first of its set, never all pairs.
4. Connected components of these links.
5. Where a similarity is asked for, fingerprints only propose: the distinct shingle sets of each component are
   compared themselves, and components are formed again from the pairs that are similar enough.

The trees are shuffled to the tasks that search them, shard by shard, not broadcast: fingerprints grow with the
data and have no size bound. A shard of more than ``block_rows`` fingerprints is dealt into blocks, and each pair of
blocks is searched by a task of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored
from .components import connected

#: Rows of a leaf, and queries that are compared with a leaf at a time.
LEAF, QUERIES = 24, 8192
#: Fingerprints of a shard where bands are exact: large enough that the tree, and not the band, does the pruning.
SHARD_ROWS = 100_000
SEED = 42


def _shingle_hashes(text: str, words: int) -> np.ndarray:
    import xxhash

    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.array([digest(line[a:b], SEED) for a, b in pairs], np.uint64)


def _remix(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits from a hash (the finalizer of splitmix64)."""
    z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 32768):
        bits = np.unpackbits(h[at : at + 32768].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _set_name(shingles: np.ndarray) -> int:
    """64 bits that name a set of distinct sorted shingle hashes; the empty set is zero."""
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(shingles.tobytes(), SEED), np.uint64).view(np.int64)) if len(shingles) else 0


def fingerprint(text: Column, words: int = 3, bits: int = 64, sets: bool = False) -> Column:
    """array<bigint> of bits / 64 words; a text that is null or has no word gives zero.

    With ``sets`` each distinct shingle counts once, and a last word names the set of shingles.
    """

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                h = _shingle_hashes(t, words)
                h = np.unique(h) if sets else h
                found = [_majority(h if i == 0 else _remix(h, i)) for i in range(bits // 64)] if len(h) else [0] * (bits // 64)
                out.append(found + [_set_name(h)] if sets else found)
            yield pd.Series(out)

    return run(F.coalesce(text, F.lit("")))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, both as (rows, words)."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int32)  # signed, it would count |x|


class BKTree:
    """Children keyed by integer distance to their parent's fingerprint; sets of up to LEAF rows stay together.

    ``prints`` are distinct fingerprints as (rows, words). ``compared`` counts the distances that searches computed.
    """

    def __init__(self, prints: np.ndarray):
        self.prints, self.compared = prints, 0
        self.root = self._node(np.arange(len(prints)))

    def _node(self, rows: np.ndarray):
        """A leaf's rows, or (row of the parent, its children by distance)."""
        if len(rows) <= LEAF:
            return rows
        d = distances(self.prints[rows[1:]], self.prints[rows[0]])
        order = np.argsort(d, kind="stable")
        edges, at = np.unique(d[order], return_index=True)
        parts = np.split(rows[1:][order], at[1:])
        return rows[0], {int(e): self._node(part) for e, part in zip(edges, parts)}

    def within(self, queries: np.ndarray, radius: int, sets: Sets | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) pairs within the radius, node by node: all queries that reach a node are compared with it at
        once, and each goes on along the edges within the radius of its own distance.

        With ``sets`` of the rows, which are the queries then, a leaf that is all of one set is not compared with that
        set's own rows; so a dense group is compared with its first leaf and hardly with itself."""
        waiting = [(self.root, np.arange(len(queries)))]
        while waiting:
            node, q = waiting.pop()
            if isinstance(node, tuple):
                parent, children = node
                d = distances(queries[q], self.prints[parent])
                self.compared += len(q)
                near = q[d <= radius]
                if len(near):
                    yield near, np.full(len(near), parent)
                for edge, child in children.items():
                    part = q[np.abs(d - edge) <= radius]
                    if len(part):
                        waiting.append((child, part))
                continue
            for first in range(0, len(q), QUERIES):
                part = q[first : first + QUERIES]
                if sets is not None:
                    names = sets.names(node)
                    if (names == names[0]).all():
                        part = part[sets.names(part) != names[0]]
                found, row = np.nonzero(distances(queries[part][:, None], self.prints[node][None]) <= radius)
                self.compared += len(part) * len(node)
                if len(found):
                    yield part[found], node[row]


class Sets:
    """Disjoint sets of rows, united many pairs at a time; a set is named by its smallest row."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def names(self, rows: np.ndarray) -> np.ndarray:
        out = self.parent[rows]
        while True:
            up = self.parent[out]
            if (up == out).all():
                self.parent[rows] = out
                return out
            out = up

    def unite(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.names(left), self.names(right)
            differ = a != b
            left, right, a, b = left[differ], right[differ], a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(prints: np.ndarray, radius: int, tree: BKTree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, smallest row of its set) that join the same fingerprints as all pairs within the radius would."""
    tree, sets = tree or BKTree(prints), Sets(len(prints))
    for query, row in tree.within(prints, radius, sets):
        sets.unite(query, row)
    names = sets.names(np.arange(len(prints)))
    linked = np.flatnonzero(names != np.arange(len(prints)))
    return linked, names[linked]


def bit_tables(n: int, bits: int, radius: int, recall: float, similarity: float | None = None) -> list[np.ndarray]:
    """Bit positions per table; fingerprints that agree on all positions of a table share a shard.

    Exact for a radius that is small against the bits: of radius + 1 equal pieces a pair within the radius agrees on
    one at least. A table takes as many bits of its piece as leave shards of some SHARD_ROWS, one in any case, so that
    every size works alike. Past what a piece can tell apart the pieces are more and a table is every
    choice of m - radius of m.

    A wide radius leaves neither such pieces nor edges to skip. There tables are seeded samples for shards of some 256,
    as many as the recall asks for: of pairs at the very radius, or with ``similarity`` of pairs with that Jaccard
    similarity, whose distances are spread as the sum of independent bits.
    """
    if 8 * radius <= bits:
        wanted = max(1, math.ceil(math.log2(max(n, 1) / SHARD_ROWS)))
        for m in range(radius + 1, bits + 1):
            pieces = np.array_split(np.arange(bits), m)
            if (m - radius) * (bits // m) >= wanted:
                return [np.concatenate([pieces[i] for i in c])[:wanted] for c in itertools.combinations(range(m), m - radius)]
    wanted = max(8, math.ceil(math.log2(max(n, 2) / 256)))
    share = lambda d: math.prod((bits - d - i) / (bits - i) for i in range(wanted))
    if similarity is None:
        spread = {radius: 1.0}
    else:
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi  # that a bit differs, for sets of one size
        spread = {d: math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(radius + 1)}
    count = 1
    while sum(w * (1 - share(d)) ** count for d, w in spread.items()) > 1 - recall:
        count += 1
    rng = np.random.default_rng(SEED)
    return [rng.permutation(bits)[:wanted] for _ in range(count)]


def _keyed(nodes: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """Rows (key, node, prints) for every table of bit positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            flat = batch.column("prints").flatten().to_numpy(zero_copy_only=False).astype("<i8")
            on = np.unpackbits(flat.view(np.uint8).reshape(len(batch), -1), axis=1, bitorder="little")
            for t, at in enumerate(tables):
                key = on[:, at].astype(np.int64) @ np.left_shift(np.int64(1), np.arange(len(at), dtype=np.int64))
                key += np.int64(t) << np.int64(48)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), batch.column("node"), batch.column("prints")], ["key", "node", "prints"]
                )

    return nodes.mapInArrow(run, "key bigint, node bigint, prints array<bigint>")


def _search(keyed: DataFrame, radius: int, words: int) -> DataFrame:
    """Links (u, v) found in runs of equal (key, pair); the input is clustered and sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(keys, node, prints):
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate([[0], cuts, [len(keys)]])
            us, vs = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a > 1:
                    left, right = shard_links(prints[a:b], radius)
                    if len(left):
                        us.append(node[a:b][left])
                        vs.append(node[a:b][right])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "pair")], axis=1)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            prints = batch.column("prints").flatten().to_numpy(zero_copy_only=False).reshape(-1, words).astype(np.int64)
            held.append((keys, node, prints))
            if (keys[-1] == held[0][0][0]).all():
                continue  # still the first shard
            keys, node, prints = (np.concatenate(x) for x in zip(*held))
            at = len(keys) - int(np.argmax((keys[::-1] != keys[-1]).any(axis=1)))
            yield from links(keys[:at], node[:at], prints[:at])
            held = [(keys[at:], node[at:], prints[at:])]
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held)))

    return keyed.mapInArrow(run, "u bigint, v bigint")


def similar_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) of pairs whose Jaccard similarity is reached; they join the same rows as all such pairs would."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    waiting, marked, left, right = np.arange(len(sets)), np.zeros(len(values), bool), [], []
    at = np.concatenate([[0], np.cumsum(sizes)])
    own = [codes[a:b] for a, b in zip(at[:-1], at[1:])]
    while len(waiting) > 1:
        todo, waiting = [int(waiting[0])], waiting[1:]
        rest, n = np.concatenate([own[i] for i in waiting]), sizes[waiting]
        while todo and len(waiting):
            row = todo.pop()
            marked[own[row]] = True
            shared = np.add.reduceat(marked[rest], np.cumsum(n) - n, dtype=np.int64)
            marked[own[row]] = False
            near = shared >= similarity * (n + sizes[row] - shared)
            if near.any():
                left.append(np.full(near.sum(), row))
                right.append(waiting[near])
                todo.extend(waiting[near].tolist())
                rest, waiting, n = rest[np.repeat(~near, n)], waiting[~near], n[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _compare(dealt: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) of similar texts in runs of equal (head, pair); the input is clustered and sorted by them."""

    def links(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            node = np.array(list(held), np.int64)
            left, right = similar_links(list(held.values()), similarity)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(node[left]), pa.array(node[right])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            for head, pair, node, text in zip(*(batch.column(c).to_pylist() for c in ("head", "pair", "node", "text"))):
                if (head, pair) != last:
                    yield from links(held)
                    last, held = (head, pair), {}
                shingles = np.unique(_shingle_hashes(text or "", words))
                if len(shingles) and _set_name(shingles) == node:  # else another text of a repeated key
                    held[node] = shingles
        yield from links(held)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def _verified(links: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float, block_sets: int) -> DataFrame:
    """Components (u, v) by similarity of shingle sets, inside the components ``links``; ``texts`` has key and text.

    A component of more than ``block_sets`` sets is dealt into blocks, and each pair of blocks is compared by a task
    of its own.
    """
    members = links.select(F.col("u").alias("node"), F.col("v").alias("head"))
    members = members.union(links.select("v", "v").distinct())
    blocks = members.groupBy("head").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("blocks"))
    members = members.join(blocks, "head").join(nodes.select("node", F.col("low").alias("key")), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.least(i.cast("long"), block) * F.col("blocks") + F.greatest(i.cast("long"), block),
    )
    dealt = members.join(texts, "key").select("head", "node", "text", F.explode(pairs).alias("pair"))
    dealt = dealt.repartition("head", "pair").sortWithinPartitions("head", "pair")
    return connected(_compare(dealt, words, similarity))


def classes(
    df: DataFrame,
    key: str,
    text: str,
    words: int = 3,
    bits: int = 64,
    radius: int = 3,
    recall: float = 0.9,
    block_rows: int = 2 * SHARD_ROWS,
    similarity: float | None = None,
    block_sets: int = 2_000,
) -> DataFrame:
    """Rows (key, prints, component) for every row of ``df``: the smallest key that is reachable over links.

    Fingerprints link at ``radius`` or fewer differing bits. ``recall`` matters only where bands would be too short
    for the radius: it is the chance that a pair at the very radius meets in a shard; closer pairs meet more surely.
    With ``similarity`` it is the chance for a pair of that similarity, and fingerprints only propose: pairs link whose sets of distinct shingles have that Jaccard similarity
    or more, and ``prints`` gets a last word that names the set.
    ``key`` is an integer column. A null key takes part and gets its component, but is never the name of one unless
    all its class has no key: then the component is null. Repeated rows and keys get a row each.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), fingerprint(F.col(text), words, bits, similarity is not None).alias("prints"))
    rows = stored(rows, "prints")
    if similarity is not None:
        name = F.col("prints")[bits // 64]
    else:
        name = F.col("prints")[0] if bits == 64 else F.xxhash64("prints")
    nodes = stored(rows.groupBy("prints").agg(F.min("key").alias("low")).withColumn("node", name), "nodes")
    n = nodes.count()
    keyed = _keyed(nodes.select("node", F.slice("prints", 1, bits // 64).alias("prints")), bit_tables(n, bits, radius, recall, similarity))

    # shards beyond the bound are dealt into blocks, each pair of blocks to a task of its own
    crowded = stored(
        keyed.groupBy("key").count().where(F.col("count") > block_rows)
        .select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")),
        "crowded",
    )
    if crowded.isEmpty():
        keyed = keyed.withColumn("pair", F.lit(0).cast("long"))
    else:
        block = F.pmod(F.xxhash64("node"), F.col("blocks"))
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda i: F.least(i.cast("long"), block) * F.col("blocks") + F.greatest(i.cast("long"), block),
        )
        keyed = keyed.join(crowded, "key", "left").select(
            "key", "node", "prints", F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(F.array(F.lit(0).cast("long")))).alias("pair")
        )
    keyed = keyed.repartition("key", "pair").sortWithinPartitions("key", "pair")
    links = connected(_search(keyed, radius, bits // 64))
    if similarity is not None:
        texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        links = _verified(links, nodes, texts, words, similarity, block_sets)

    # names of components: the smallest key among their fingerprints
    member = nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("head")), "node", "left")
    member = member.withColumn("head", F.coalesce("head", "node"))
    names = member.groupBy("head").agg(F.min("low").alias("component"))
    named = member.join(names, "head").select("prints", "component")
    return rows.join(named, "prints", "left").select("key", "prints", "component")


def one_of_each(
    df: DataFrame,
    key: str,
    text: str,
    words: int = 5,
    bits: int = 192,
    radius: int = 45,
    recall: float = 0.999,
    similarity: float = 0.8,
) -> DataFrame:
    """The row with the smallest key of each class; other rows go. Columns and their order stay.

    A class is a chain of texts, each with a Jaccard similarity of ``similarity`` or more to the next between their sets
    of distinct shingles. The default radius is a cosine of 0.74 between the sets; texts that share four fifths of their
    shingles have 0.89, so they are well within it, and what else is within it is compared and stays. Rows without a
    key stay, as nothing says which of them to keep. Of several rows with the kept key and the same text one stays.
    """
    (k,) = fresh(df, "_key")
    keyed = df.where(F.col(key).isNotNull())
    found = classes(keyed, key, text, words, bits, radius, recall, similarity=similarity)
    kept = found.where("key = component").select(F.col("key").alias(k)).distinct()
    first = keyed.withColumn(k, F.col(key).cast("long")).join(kept, k, "left_semi").dropDuplicates([k, text])
    return first.select(*df.columns).unionByName(df.where(F.col(key).isNull()).select(*df.columns))
