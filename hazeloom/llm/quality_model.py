"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Every token has a sparse random index vector, made from a hash of the token; its word vector is the sum of the index
vectors of its neighbours in the training texts. Words outside the vocabulary stand as their shape (letters, capitals
and digits shortened to one mark each), so every word of any text has a token. A document is the mean and the spread
of its tokens' vectors and three numbers on length and repetition, which a two-layer network turns into a probability; a temperature fitted on texts the network
has not seen makes it an honest one.

Only the model is fitted on a bounded sample of labelled texts (``sample_rows``); vocabulary, vectors and network are
bounded by their parameters and go to the tasks with the scoring function. Scoring reads each text once, in Arrow
batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

VOCABULARY, DIMENSION, NONZERO, NEIGHBOURS = 8192, 64, 6, 2
#: Mean and spread of the vectors; the length, and the shares of words said twice in a row and of distinct words.
WIDTH = 2 * DIMENSION + 3
HIDDEN, EPOCHS, RATE, BATCH = 32, 40, 0.003, 128
SAMPLE_ROWS = 20_000
TASKS = 8
SEED = 5
DIGIT = re.compile(r"\d+")


def shape(word: str) -> str:
    """The word with runs of lower-case letters as a, capitals as A, digits as 9; runs of one mark as the mark."""
    if word.isupper():
        word = re.sub(r"[^\W\d_]+", "A", word)
    else:
        word = re.sub(r"[^\W\d_]+", lambda m: "Aa" if m.group()[:1].isupper() and len(m.group()) > 1 else "a", word)
    return "\x01" + re.sub(r"([^\w\s])\1+", r"\1\1", DIGIT.sub("9", word))[:16]


def index_vectors(tokens: list[str]) -> np.ndarray:
    """Sparse ternary vectors: NONZERO places of +1 or -1, drawn from the token's hash."""
    import xxhash

    out = np.zeros((len(tokens), DIMENSION), np.int64)
    for i, token in enumerate(tokens):
        h = xxhash.xxh3_128_intdigest(token.encode("utf-8", "replace"), SEED)
        for _ in range(NONZERO):
            h, place = divmod(h, DIMENSION)
            h, sign = divmod(h, 2)
            out[i, place] += 2 * sign - 1
    return out


class Tokens(dict):
    """Row of each word: its own if it is in the vocabulary, else its shape's, else that of any other word."""

    def __init__(self, vocabulary: list[str]):
        super().__init__(zip(vocabulary, range(len(vocabulary))))
        self.fixed = len(vocabulary)
        self.shapes = dict(self)

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
            self.update(self.shapes)
        at = self[word] = self.shapes.get(shape(word), self.fixed)
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class Model:
    """What scoring needs: the vocabulary, its vectors (a row more for other words), and the network."""

    vocabulary: list[str]
    vectors: np.ndarray
    layers: list[np.ndarray]
    center: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0

    def features(self, texts, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(texts), WIDTH))
        for i, t in enumerate(texts):
            words = t.split() if t else []
            if words:
                rows = tokens.rows(words)
                counts = np.bincount(rows, minlength=1)
                used = np.flatnonzero(counts)
                share, vectors = counts[used] / len(rows), self.vectors[used]
                mean = share @ vectors
                out[i, :DIMENSION] = mean
                out[i, DIMENSION : 2 * DIMENSION] = np.sqrt(np.maximum(share @ vectors**2 - mean**2, 0))
                again = sum(map(eq, words[1:], words))
                out[i, -3:] = np.log1p(len(words)), again / len(words), len(set(words)) / len(words)
        return out

    def logits(self, features: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((features - self.center) / self.scale @ a + b) @ c + d[0]

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def _network(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Logistic loss by Adam on shuffled batches; seeded, so the same data give the same network."""
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            part = order[at : at + BATCH]
            hidden = np.tanh(x[part] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            slopes = [x[part].T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            step += 1
            for q, g, a, b in zip(p, slopes, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return p


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least logistic loss, on a grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id has no fold."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Model from labelled texts of the folds 1 to 4, at most ``sample_rows`` of them, chosen by a hash of the id.

    Fold 1 fits the temperature, the others fit vocabulary, vectors and network. None if no label can be used.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold(F.col(key)) != 0)).groupBy(F.col(key).cast("long").alias("id"))
    known = known.agg(F.min(label).alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most sample_rows pairs of numbers are broadcast
    sample = texts.join(F.broadcast(known), "id").withColumn("train", fold(F.col("id")) != 1)
    sample = stored(sample, "sample")
    train = sample.where("train").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                words = set(t.split())
                seen.update(words)
                seen.update({shape(w) for w in words})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    tokens = train.mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    vocabulary = [r.token for r in tokens.orderBy(F.desc("n"), "token").limit(VOCABULARY).collect()]
    if not vocabulary:
        return None

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, index = Tokens(vocabulary), index_vectors([*vocabulary, "\x02"])
        total = np.zeros((len(vocabulary) + 1, DIMENSION), np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                rows = lookup.rows(t.split())
                for gap in range(1, NEIGHBOURS + 1):
                    np.add.at(total, rows[:-gap], index[rows[gap:]])
                    np.add.at(total, rows[gap:], index[rows[:-gap]])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int32).tobytes()], pa.binary())], ["total"])

    # one matrix of fixed size for each of at most TASKS tasks, whatever the number of partitions
    parts = train.coalesce(TASKS).mapInArrow(context, "total binary").collect()
    total = sum(np.frombuffer(r.total, np.int32).astype(np.int64).reshape(-1, DIMENSION) for r in parts).astype(float)
    total += index_vectors([*vocabulary, "\x02"])  # a token without neighbours is still itself
    vectors = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    model = Model(vocabulary, vectors, [], np.zeros(1), np.ones(1))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Tokens(vocabulary)
        for batch in batches:
            found = model.features(batch.column("text").to_pylist(), lookup)
            ids, y, use = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("id", "y", "train"))
            yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([ids, y, use, found]).tobytes()], pa.binary())], ["rows"])

    # sample_rows rows of numbers, as they are in memory
    blocks = [np.frombuffer(r.rows).reshape(-1, WIDTH + 3) for r in sample.mapInArrow(features, "rows binary").collect()]
    rows = np.concatenate(blocks) if blocks else np.empty((0, WIDTH + 3))
    rows = rows[np.lexsort(rows.T[::-1])]  # by id, then by all numbers
    y, use, x = rows[:, 1], rows[:, 2] > 0, rows[:, 3:]
    model.center, model.scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-6
    model.layers = _network((x[use] - model.center) / model.scale, y[use])
    if (~use).any():
        model.temperature = _temperature(model.logits(x[~use]), y[~use])
    return model


def score(text: Column, model: Model | None) -> Column:
    """Probability of label 1; an empty or null text is scored as one without words, 0.5 if there is no model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = Tokens(model.vocabulary)
        for texts in batches:
            yield pd.Series(model.probabilities(model.features(texts.tolist(), lookup)))

    return run(F.coalesce(text, F.lit("")))
