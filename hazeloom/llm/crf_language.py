"""Language of words and documents with a linear-chain conditional random field.

A text is a chain of words (letter runs, lower-cased; a run of more than ``PIECE`` letters is several words). A word's
potentials add up the weights of its features: prefixes and suffixes, letters and letter pairs and triples with word
ends, and which languages' lexicons list it. Transitions between languages are learned with them, from chains that are
spliced from texts of several languages, so that the field knows how code-switched text runs on. Forward-backward gives
each word's chance of every language; a document's language is the one with most of its words.

The field is fitted on a bounded sample of labelled texts: ``per_language`` texts of each language, chosen by a hash
of the id, count the lexicons, and a few windows of each make the chains. Scoring reads every whole text once, in Arrow
batches and without a shuffle: potentials are computed once per distinct word and worker, and the chains of many
texts, sorted by length, take their steps together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

PIECE = 24
BUCKETS = 1 << 16
AFFIXES, GRAMS = (1, 2, 3), (1, 2, 3)
LEXICON = 2000
PER_LANGUAGE, WINDOWS, WINDOW_WORDS = 1000, 4, 24
#: Windows that follow each other in one chain; a chain of one language alone is as likely as one that switches.
SPLICED = 3
EPOCHS, CHAINS, RATE, DECAY = 4, 128, 0.1, 1e-6
#: Words whose chains are walked together, and distinct words that a worker keeps.
WALK_WORDS, KEPT_WORDS = 1_000_000, 400_000
SEED = 11
UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]{1,%d}" % PIECE)


def split_words(text: str) -> list[str]:
    """Lower-cased pieces of letter runs; runs of number signs alone are none."""
    found = WORDS.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def spellings(words: list[str]) -> np.ndarray:
    """(words, features) feature numbers below BUCKETS, or BUCKETS where a word is too short to have one."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    width = int(n.max(initial=1)) + 2
    padded = np.array([f"\x02{w}\x03" for w in words], f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
    rows, columns = np.arange(len(words))[:, None], []

    def add(kind: int, chars: np.ndarray, known: np.ndarray) -> None:
        h = np.full(known.shape, kind, np.uint64)
        for j in range(chars.shape[-1]):
            h = _mix(h, chars[..., j])
        columns.append(np.where(known, (h % np.uint64(BUCKETS)).astype(np.int64), BUCKETS).reshape(len(words), -1))

    for size in AFFIXES:
        there = (n >= size)[:, None]
        from_start, from_end = np.arange(1, size + 1)[None], np.maximum(n[:, None] - size + 1, 0) + np.arange(size)[None]
        add(10 + size, padded[rows, np.minimum(from_start, width - 1)][:, None], there)
        add(20 + size, padded[rows, np.minimum(from_end, width - 1)][:, None], there)
    for size in GRAMS:
        if width >= size:
            at = np.lib.stride_tricks.sliding_window_view(padded, size, axis=1)
            add(30 + size, at, np.arange(at.shape[1])[None] + size <= n[:, None] + 2)
    return np.concatenate(columns, axis=1)


def forward_backward(potentials: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Marginals (words, labels) of chains that lie one after the other, longest first; with ``pairs`` also the summed
    chances of each move between neighbours and the logarithm of each chain's normalizer.

    ``potentials`` are positive and have their rows scaled to a greatest value of one; so are ``moves``.
    """
    labels, starts = potentials.shape[1], np.cumsum(lengths) - lengths
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left") if steps else []
    alpha, scale = np.empty_like(potentials), np.empty(len(potentials))
    for t in range(steps):
        at = starts[: alive[t]] + t
        a = potentials[at] if t == 0 else (alpha[at - 1] @ moves) * potentials[at]
        s = a.sum(axis=1)
        scale[at] = s
        alpha[at] = a / s[:, None]
    beta, expected = np.ones((len(lengths), labels)), np.zeros((labels, labels))
    out = alpha
    for t in range(steps - 1, 0, -1):
        at = starts[: alive[t]] + t
        ahead = potentials[at] * beta[: alive[t]] / scale[at][:, None]
        if pairs:
            expected += moves * (alpha[at - 1].T @ ahead)
        out[at] *= beta[: alive[t]]  # not read as alpha any more
        beta[: alive[t]] = ahead @ moves.T
    if steps:
        out[starts[: alive[0]]] *= beta[: alive[0]]
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1e-300)
    return (out, expected, np.log(scale)) if pairs else out


@dataclass
class Field:
    """Languages in order, weights (BUCKETS + 1, languages) with a last row of zeros, lexicons, transition weights."""

    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    listed: np.ndarray
    moves: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Summed feature weights (words, languages)."""
        out = np.zeros((len(words), len(self.languages)))
        for first in range(0, len(words), 8192):
            part = words[first : first + 8192]
            here = out[first : first + len(part)]
            for column in spellings(part).T:
                here += self.weights[column]
            masks = np.fromiter((self.lexicon.get(w, 0) for w in part), np.int64, len(part))
            here += self.listed[masks]
        return out

    def potentials(self, words: list[str]) -> np.ndarray:
        s = self.scores(words)
        return np.exp(s - s.max(axis=1, keepdims=True))

    def transitions(self) -> np.ndarray:
        return np.exp(self.moves - self.moves.max())


class Labeller:
    """Marginals of words, with the potentials of words seen before."""

    def __init__(self, field: Field):
        self.field, self.moves = field, field.transitions()
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.empty((0, len(self.field.languages)))

    def chances(self, chains: list[list[str]]) -> list[np.ndarray]:
        """(words, languages) for each chain; together they should hold some WALK_WORDS words."""
        if len(self.row) > KEPT_WORDS:
            self.forget()
        new = list(set().union(*chains) - self.row.keys())
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            self.table = np.concatenate([self.table, self.field.potentials(new)])
        lengths = np.fromiter(map(len, chains), np.int64, len(chains))
        order = np.argsort(-lengths, kind="stable")
        look = self.row.__getitem__
        codes = np.fromiter((c for i in order.tolist() for c in map(look, chains[i])), np.int64, int(lengths.sum()))
        found = forward_backward(self.table[codes], lengths[order], self.moves)
        out: list[np.ndarray] = [np.empty(0)] * len(chains)
        for i, part in zip(order.tolist(), np.split(found, np.cumsum(lengths[order])[:-1])):
            out[i] = part
        return out

    def batches(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(position, marginals) of the texts with words, in groups of similar length."""
        chains = [split_words(t) if t else [] for t in texts]
        held, size = [], 0
        for i in sorted((i for i, c in enumerate(chains) if c), key=lambda i: -len(chains[i])):
            held.append(i)
            size += len(chains[i])
            if size >= WALK_WORDS:
                yield from zip(held, self.chances([chains[i] for i in held]))
                held, size = [], 0
        if held:
            yield from zip(held, self.chances([chains[i] for i in held]))


def _learn(chains: list[list[int]], labels: list[list[int]], words: list[str], field: Field) -> None:
    """Maximum likelihood by AdaGrad on blocks of chains; seeded, so the same chains give the same field."""
    rng, n = np.random.default_rng(SEED), len(field.languages)
    codes = spellings(words)
    masks = np.fromiter((field.lexicon.get(w, 0) for w in words), np.int64, len(words))
    kinds = (field.weights, field.listed, field.moves)
    seen = [np.full(w.shape, 1e-8) for w in kinds]
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), CHAINS):
            part = sorted(order[at : at + CHAINS].tolist(), key=lambda i: -len(chains[i]))
            lengths = np.array([len(chains[i]) for i in part])
            flat, truth = (np.concatenate([x[i] for i in part]).astype(np.int64) for x in (chains, labels))
            used, inverse = np.unique(flat, return_inverse=True)
            score = field.listed[masks[used]].copy()
            for column in codes[used].T:
                score += field.weights[column]
            score = np.exp(score - score.max(axis=1, keepdims=True))
            error, moved, _ = forward_backward(score[inverse], lengths, field.transitions(), pairs=True)
            error[np.arange(len(flat)), truth] -= 1
            follows = np.ones(len(flat), bool)
            follows[np.cumsum(lengths) - lengths] = False
            to = np.flatnonzero(follows)
            np.add.at(moved, (truth[to - 1], truth[to]), -1)
            own = np.stack([np.bincount(inverse, e, len(used)) for e in error.T])
            features = codes[used]
            spelled = np.stack([np.bincount(features.ravel(), np.repeat(o, features.shape[1]), BUCKETS + 1) for o in own], axis=1)
            listed = np.stack([np.bincount(masks[used], o, len(field.listed)) for o in own], axis=1)
            spelled[BUCKETS], listed[0] = 0, 0  # no feature, no lexicon
            for weights, slope, total in zip(kinds, (spelled, listed, moved), seen):
                slope = slope / len(flat) + DECAY * weights
                total += slope**2
                weights -= RATE * slope / np.sqrt(total)


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. A null id has none."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))


def _sample(docs: DataFrame, key: str, text: str, lang: str, per_language: int) -> DataFrame:
    """Distinct (id, lang, h, text) of at most ``per_language`` texts a language that may be learned from."""
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (fold(F.col("id")) != 2)).withColumn("h", F.xxhash64("text"))
    each = stored(rows.select("id", "lang", "h").distinct(), "ids")
    # a hash thins every language to little more than is wanted, so that no window holds a whole language
    counts = each.groupBy("lang").agg(F.count("*").alias("of"))
    thinned = F.pmod(F.xxhash64("id", "h"), F.lit(1_000_000)) * F.col("of") <= 1_000_000 * (1.1 * per_language + 50)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id", "h"), "id", "h")
    few = each.join(counts, "lang").where(thinned).withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= per_language)
    # per_language rows of three short values for each language
    sample = rows.join(F.broadcast(few.select("id", "lang", "h")), ["id", "lang", "h"])
    return stored(sample.dropDuplicates(["id", "lang", "h"]), "sample")


def fit(docs: DataFrame, key: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> Field | None:
    """Field learned from texts with a language whose fold is not 2; None if there are none with a letter.

    Nothing else is read: rows of fold 2, without a key or without a language are never learned from. At most
    ``per_language`` texts of each language go into the sample, whole; WINDOWS windows of WINDOW_WORDS words of each
    make the chains. Repeated rows count once. Driver memory grows with the number of languages only.
    """
    sample = _sample(docs, key, text, lang, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for language, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen.update((language, w) for w in set(split_words(t)))
        keys = list(seen)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([seen[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    entries = counted.withColumn("r", F.row_number().over(common)).where(F.col("r") <= LEXICON).select("lang", "word").collect()
    if not entries:
        return None
    languages = sorted({r.lang for r in entries})
    number = {name: i for i, name in enumerate(languages)}
    lists: dict[str, set[int]] = {}
    for r in entries:
        lists.setdefault(r.word, set()).add(number[r.lang])
    kinds = {kind: i for i, kind in enumerate(sorted({tuple(sorted(s)) for s in lists.values()}), 1)}
    n = len(languages)
    field = Field(
        languages,
        {w: kinds[tuple(sorted(s))] for w, s in lists.items()},
        np.zeros((BUCKETS + 1, n)),
        np.zeros((len(kinds) + 1, n)),
        np.zeros((n, n)),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, windows = [], []
            for i, language, h, t in zip(*(batch.column(c).to_pylist() for c in ("id", "lang", "h", "text"))):
                found = split_words(t)
                places = max(1, len(found) - WINDOW_WORDS + 1)
                starts = np.random.default_rng([SEED, h & (2**63 - 1)]).integers(places, size=WINDOWS if places > 1 else 1)
                for j, at in enumerate(starts.tolist()):
                    if found:
                        keys.append((number.get(language), i, h, j))
                        windows.append(found[at : at + WINDOW_WORDS])
            columns = list(zip(*keys)) or [[]] * 4
            types = [pa.int32(), pa.string(), pa.int64(), pa.int32()]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, types)] + [pa.array(windows, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "id", "h", "j", "words"])

    made = sample.select("id", "lang", "h", "text").mapInArrow(cut, "label int, id string, h bigint, j int, words array<string>")
    windows = [(r.label, r.words) for r in sorted(made.collect(), key=lambda r: (r.label, r.id, r.h, r.j))]
    order = np.random.default_rng(SEED).permutation(len(windows)).tolist()
    half = len(order) // 2  # of these each follows any other; the rest follow their own language
    order = order[:half] + sorted(order[half:], key=lambda i: windows[i][0])
    spliced = [[windows[i] for i in order[at : at + SPLICED]] for at in range(0, len(order), SPLICED)]
    words = sorted({w for _, found in windows for w in found})
    at = {w: i for i, w in enumerate(words)}
    chains = [[at[w] for _, found in parts for w in found] for parts in spliced]
    _learn(chains, [[label for label, found in parts for _ in found] for parts in spliced], words, field)
    return field


RESULT = "struct<lang:string,score:double,n_words:bigint,spans:array<struct<lang:string,first:bigint,words:bigint,score:double>>>"


def _described(field: Field | None, texts: list[str | None]) -> pa.StructArray:
    n = len(texts)
    names, scores, sizes, spans = [UNKNOWN] * n, [0.0] * n, [0] * n, [[] for _ in range(n)]
    if field is not None:
        languages = field.languages
        for i, chance in _labeller(field).batches(texts):
            share, best = chance.mean(axis=0), chance.argmax(axis=1)
            top = int(share.argmax())
            names[i], scores[i], sizes[i] = languages[top], min(float(share[top]), 1.0), len(chance)
            cuts = np.flatnonzero(np.diff(best, prepend=-1))
            sure = np.add.reduceat(chance[np.arange(len(best)), best], cuts)
            runs = np.diff(np.append(cuts, len(best)))
            spans[i] = [
                {"lang": languages[k], "first": a, "words": r, "score": s / r}
                for k, a, r, s in zip(best[cuts].tolist(), cuts.tolist(), runs.tolist(), sure.tolist())
            ]
    span = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("score", pa.float64())])
    arrays = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span))]
    return pa.StructArray.from_arrays(arrays, ["lang", "score", "n_words", "spans"])


_LABELLERS: dict[int, Labeller] = {}


def _labeller(field: Field) -> Labeller:
    """The worker's labeller of a field, with what it has seen."""
    if id(field) not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[id(field)] = Labeller(field)
    return _LABELLERS[id(field)]


def language(text: Column, field: Field | None) -> Column:
    """Struct (lang, score, n_words, spans) of each text.

    ``lang`` is the language with the greatest mean chance over the text's words (the first by code point of equals),
    ``score`` that mean. ``spans`` are runs of words with the same likeliest language, with the number of the first
    word, the words and their mean chance, so they cover the text. A text that is null or has no letter is ``und`` with
    score 0 and no spans, and so is every text where nothing could be learned. Texts are read whole, whatever their
    length, and do not influence each other.
    """

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _described(field, texts.to_pylist())

    return run(text)
