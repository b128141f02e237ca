"""Source divergence audit with hash-consed segment trees.

How far do the term frequencies of two sources of one language lie apart? Terms of a language are dealt to ranges of
bounded size; in a range every (language, source) group, and the language as a whole, has a segment tree of counts over
the range's terms. Trees are hash-consed level by level: a node is the pair of its children, equal pairs are one node,
so equal subtrees of any two groups are the same number, and the empty subtree is number zero.

Two trees are walked together from their roots. What waits at a level are distinct pairs of nodes with the number of
times they occur, so that equal node pairs are priced once; a pair of empty subtrees is priced where it is met. At the
leaves a pair of counts is priced in both directions. Terms that stand out in a group are found by the same walk with
the tree of its language, which enters no subtree that is empty in the group.

Documents are counted in each task before the shuffle, so a source with a third of all documents sends no more than
its distinct terms per task. A walk holds one range and two blocks of sources, whatever the number of either.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

UNIT = 1_000_000_000
LEAST_DOCS = 3
RANGE_TERMS = 8192
SOURCE_BLOCK = 32
TOP = 200
#: Distinct (group, term) entries that a task holds before it sends them on.
HELD_TERMS = 300_000

#: Bytes of a term: A-Z are lowered, other ASCII but a-z ends a term, bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs) from (lang, source, text); the empty term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, found, size = defaultdict(Counter), defaultdict(Counter), 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in found.items():
                terms = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()),
                        pa.array([source] * len(terms), pa.string()),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array(counts.values(), pa.int64(), size=len(terms)),
                        pa.array([seen[lang, source][t] for t in terms], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                group = lang.as_py(), source.as_py()
                counts = Counter(split_terms(text.as_py()))
                counts[b""] = 0
                before = len(found[group])
                found[group].update(counts)
                seen[group].update(counts.keys())
                size += len(found[group]) - before
                if size > HELD_TERMS:
                    yield from rows()
                    seen.clear(), found.clear()
                    size = 0
        yield from rows()

    counted = docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    whole = F.sum(F.col("n").cast("decimal(38,0)")).cast("bigint")
    return counted.groupBy("lang", "source", "term").agg(whole.alias("n"), F.sum("docs").alias("docs"))


class Forest:
    """Hash-consed segment trees of several groups over the same 2^height terms.

    ``leaves`` are the distinct counts (zero first), a node above them is (left, right), the numbers of its children;
    ``levels[h]`` lists the nodes of height h + 1, and number zero is the empty subtree at every height.
    """

    def __init__(self, group: np.ndarray, term: np.ndarray, count: np.ndarray, groups: int, terms: int):
        self.height = int(max(terms - 1, 0)).bit_length()
        self.leaves, node = np.unique(np.append(count, 0), return_inverse=True)
        node, order = node[:-1], np.lexsort((term, group))
        group, at, node = group[order], term[order], node[order]
        self.levels: list[np.ndarray] = []
        for _ in range(self.height):
            new = np.ones(len(at), bool)
            new[1:] = (group[1:] != group[:-1]) | (at[1:] >> 1 != at[:-1] >> 1)
            slot = np.cumsum(new) - 1
            children = np.zeros((int(new.sum()), 2), np.int64)
            children[slot, at & 1] = node
            width = int(children.max(initial=0)) + 1
            pairs, node = np.unique(np.append(children[:, 0] * width + children[:, 1], 0), return_inverse=True)
            node, group, at = node[:-1], group[new], at[new] >> 1
            self.levels.append(np.stack([pairs // width, pairs % width], axis=1))
        self.roots = np.zeros(groups, np.int64)
        self.roots[group] = node

    def walk(self, pair: np.ndarray, left: np.ndarray, right: np.ndarray, skip_empty: bool = False):
        """Walks trees together; yields (pair, left leaf, right leaf, times) of the leaves met, distinct in the first
        three, and sets ``priced`` to the node pairs looked at. With ``skip_empty`` nothing is met below empty left
        subtrees; otherwise the leaf pair (0, 0) counts the terms below pairs of empty subtrees."""
        times, empty, self.priced = np.ones(len(pair), np.int64), np.zeros(len(self.roots), np.int64), 0
        for height in range(self.height, 0, -1):
            live = left != 0 if skip_empty else (left != 0) | (right != 0)
            if not skip_empty:
                np.add.at(empty, pair[~live], times[~live] << height)
            self.priced += len(live)
            pair, times, children = np.tile(pair[live], 2), np.tile(times[live], 2), self.levels[height - 1]
            left, right = (children[side[live]].T.ravel() for side in (left, right))
            pair, left, right, times = _distinct(pair, left, right, times)
        self.priced += len(pair)
        if skip_empty:
            live = left != 0
            return pair[live], left[live], right[live], times[live]
        extra = np.flatnonzero(empty)
        none = np.zeros(len(extra), np.int64)
        return _distinct(np.append(pair, extra), np.append(left, none), np.append(right, none), np.append(times, empty[extra]))

    def counts(self, root: int) -> Iterator[tuple[int, int]]:
        """(term, leaf) of every leaf of a tree that is not zero."""
        at, node = np.zeros(1, np.int64), np.array([root])
        for height in range(self.height, -1, -1):
            at, node = at[node != 0], node[node != 0]
            if height:
                at, node = np.concatenate([2 * at, 2 * at + 1]), self.levels[height - 1][node].T.ravel()
        return zip(at.tolist(), node.tolist())


def _distinct(pair, left, right, times):
    """Distinct (pair, left, right) with the sum of their times."""
    order = np.lexsort((right, left, pair))
    pair, left, right, times = pair[order], left[order], right[order], times[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    return pair[at], left[at], right[at], np.add.reduceat(times, at) if len(at) else times


def shares(leaves: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + terms)) for each count."""
    if int(leaves[-1]) < 9 * 10**9:
        return 1 + UNIT * (leaves + 1) // (total + terms)
    return np.array([1 + UNIT * (c + 1) // (total + terms) for c in leaves.tolist()], np.int64)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _priced(key: tuple, group: pa.Table) -> pa.Table:
    """Walks the trees of one range for the sources of two blocks: rows of part pair and part term.

    Rows with an empty term are groups (source null: the language) with n, their total, and V, the language's terms.
    """
    lang, _, low_block, high_block = (k.as_py() for k in key)
    source, term, n, block = (group.column(c).to_numpy(zero_copy_only=False) for c in ("source", "term", "n", "block"))
    head = term == ""
    names = source[head].tolist()
    number = {s: i for i, s in enumerate(names)}
    total, blocks, kept = n[head].tolist(), block[head], int(group.column("v")[0].as_py())
    owner = np.fromiter((number[s] for s in source[~head]), np.int64, (~head).sum())
    whole = number[None]
    # terms by falling count, so that rare ones, whose counts are alike, are neighbours
    own = owner == whole
    words = term[~head][own][np.lexsort((term[~head][own], -n[~head][own]))]
    place = {w: i for i, w in enumerate(words.tolist())}
    at = np.fromiter((place[w] for w in term[~head]), np.int64, len(owner))
    forest = Forest(owner, at, n[~head], len(names), len(words))
    p = np.stack([shares(forest.leaves, t, kept) for t in total])
    surplus = (1 << forest.height) - len(words)

    found: list[tuple] = []
    sources = [i for i in range(len(names)) if i != whole]
    low = [i for i in sources if blocks[i] == low_block]
    for a in low:
        others = np.array([b for b in sources if blocks[b] == high_block and (low_block != high_block or b > a)], np.int64)
        if len(others):
            pair, left, right, times = forest.walk(others, np.full(len(others), forest.roots[a]), forest.roots[others])
            times = times - surplus * ((left == 0) & (right == 0))
            pa_, pb = p[a][left], p[pair, right]
            for own_is_p in (True, False):
                value = gap(pa_, pb) if own_is_p else gap(pb, pa_)
                # products in floating point tell whether 64 bits are enough
                exact = value * times if float(np.dot(value.astype(float), times)) < 2**62 else value.astype(object) * times
                cuts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                for b, v in zip(pair[cuts].tolist(), np.add.reduceat(exact, cuts).tolist()):
                    ends = (names[a], names[b]) if own_is_p else (names[b], names[a])
                    found.append((lang, ends[0], "pair", ends[1], v))
    if low_block == high_block and low:
        rows = np.array(low, np.int64)
        pair, left, right, _ = forest.walk(rows, forest.roots[rows], np.full(len(rows), forest.roots[whole]), skip_empty=True)
        above = p[pair, left] > p[whole][right]
        value = gap(p[pair, left], p[whole][right])
        price = dict(zip(zip(*(x[above].tolist() for x in (pair, left, right))), value[above].tolist()))
        leaf_of = dict(forest.counts(forest.roots[whole]))
        for a in low:
            hits = []
            for t, leaf in forest.counts(forest.roots[a]):
                if (a, leaf, leaf_of[t]) in price:
                    hits.append((-price[a, leaf, leaf_of[t]], words[t].encode()))
            found += [(lang, names[a], "term", w.decode(), -v) for v, w in sorted(hits)[:TOP]]
    columns = list(zip(*found)) or [[]] * 5
    types = [pa.string()] * 4 + [pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "source", "part", "item", "value"])


def audit(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every (lang, source) group of ``df``.

    A language keeps the V terms found in at least 3 of its rows. With p = 1 + floor(10^9 (count + 1) / (N + V)) in the
    group, N the group's count over all kept terms, and q the same elsewhere, f = floor((p - q)^2 / q). Part ``pair``:
    each other source of the language, q its own, f summed over all kept terms. Part ``term``: the kept terms that occur
    in the group with p > q, q of the whole language, the 200 of greatest f. Rank 1 has the greatest value, equal ones
    are ordered by the UTF-8 bytes of the item.

    Null texts, languages and sources are empty ones; groups without terms take part; a language without kept terms
    has pairs of value 0. Repeated rows are documents of their own; an empty table gives no rows. Other columns of
    ``df`` do not matter. A pair's value beyond 64 bits (more than 10^9 kept terms) raises.
    """
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    everywhere = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns(
        {
            "whole": F.sum(F.col("n").cast("decimal(38,0)")).over(everywhere).cast("bigint"),
            "docs": F.sum("docs").over(everywhere),
            "once": F.col("source") == F.min("source").over(everywhere),
        }
    )
    counts = stored(counts.where((F.col("term") == "") | (F.col("docs") >= LEAST_DOCS)).drop("docs"), "counts")
    real = F.col("term") != ""
    groups = counts.groupBy("lang", "source").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("bigint").alias("total"))
    languages = counts.groupBy("lang").agg(
        F.count_if(real & F.col("once")).alias("v"),
        F.sum(F.when(real, F.col("n")).cast("decimal(38,0)")).cast("bigint").alias("total"),
        F.ceil(F.count_if(~real) / SOURCE_BLOCK).cast("int").alias("blocks"),
    )
    languages = stored(languages.withColumn("ranges", F.ceil(F.col("v") / RANGE_TERMS).cast("int")), "languages")
    groups = stored(groups.join(languages.select("lang", "v", "blocks", "ranges"), "lang"), "groups")

    # what each walk needs: counts of the two blocks' sources and of the language, and one head row for each of them
    nobody, lit = F.lit(None).cast("string"), F.lit("")
    at_range, in_block = F.pmod(F.xxhash64("term"), F.col("ranges")).cast("int"), F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    ranges = F.explode(F.sequence(F.lit(0), F.col("ranges") - 1))
    some = counts.where(real).join(languages.select("lang", "v", "blocks", "ranges"), "lang")
    shape = ["lang", "source", "term", "n", "range", "v", "blocks"]
    rows = (
        some.withColumn("range", at_range).select(*shape)
        .union(some.where("once").select("lang", nobody.alias("source"), "term", F.col("whole").alias("n"), at_range.alias("range"), "v", "blocks"))
        .union(groups.where("v > 0").select("lang", "source", lit.alias("term"), F.col("total").alias("n"), ranges.alias("range"), "v", "blocks"))
        .union(languages.where("v > 0").select("lang", nobody.alias("source"), lit.alias("term"), F.col("total").alias("n"), ranges.alias("range"), "v", "blocks"))
    )
    own = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.struct(F.least(i, F.col("block")).alias("low"), F.greatest(i, F.col("block")).alias("high")),
    )
    every = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct(i.alias("low"), j.alias("high"))),
        )
    )
    rows = rows.withColumn("block", in_block).withColumn("walk", F.explode(F.when(F.col("source").isNull(), every).otherwise(own)))
    rows = rows.select("lang", "range", "walk.*", "source", "term", "n", "block", "v")
    found = rows.groupBy("lang", "range", "low", "high").applyInArrow(
        _priced, "lang string, source string, part string, item string, value bigint"
    )
    found = stored(found, "found")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item")
    pairs = pairs.agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("bigint").alias("value"))
    bare = groups.where("v = 0").select("lang", "source")
    others = bare.select("lang", F.col("source").alias("item"))
    none = bare.join(others, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    pairs = pairs.union(none).withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.union(terms)
