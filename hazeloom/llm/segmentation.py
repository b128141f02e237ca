"""Sampled segmentations into pieces: forward filtering and backward sampling over the piece lattice.

A text is cut into units that no piece crosses: wherever two characters stand side by side in no piece. The
lattices of the distinct units are filtered forward once per worker, all new units of a block at once: for every
position the probabilities of the pieces that may end there, given all segmentations before. Sampling then walks all units of a block of texts
backward at once, one table lookup per piece. The draw for the n-th step in the m-th unit of a row is a hash of the
row's key, m and n, so the same row gives the same pieces in any batch, partition or rerun.

Characters without a piece, and the space mark itself where it stands in a text, become their UTF-8 bytes, and
blanks stand in the pieces as the mark, so decoding gives the text back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .common import fresh

SPACE_MARK = "▁"
#: Weight of a piece is exp(THETA * its score); scores of the model are merge ranks.
THETA = 5e-4
#: Pieces without a score of their own (runs of blanks) have one below this; they weigh as the rarest piece.
UNSCORED = -1e8
MOST_EDGES = 1_000_000
BLOCK_CHARS = 250_000


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _found(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value, -1 if it is not there."""
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


class Pieces:
    """The vocabulary of a model: ordinary pieces by length, byte pieces, and the bytes of every id."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = model.vocab_size()
        self.bytes, self.byte_ids, self.score = [], [0] * 256, np.zeros(self.size)
        texts: dict[int, str] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(SPACE_MARK, " ").encode())
                self.score[i], texts[i] = model.get_score(i), piece.replace(SPACE_MARK, " ")
        self.lowest = float(self.score[self.score > UNSCORED].min())
        self.score = np.maximum(self.score, self.lowest)
        self.of_length = []
        pairs = set()
        for n in range(1, max(map(len, texts.values())) + 1):
            ids = np.array([i for i, t in texts.items() if len(t) == n], np.int64)
            codes = np.array([_codes(texts[i]) for i in ids.tolist()], np.int64).reshape(len(ids), n)
            for k in range(n - 1):
                pairs.update(((codes[:, k] << 21) | codes[:, k + 1]).tolist())
            powers = self.powers(n)[0]
            keys = (codes.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
            order = np.argsort(keys)
            self.of_length.append((keys[order], ids[order], codes[order]))
        self.pairs = np.array(sorted(pairs))

    def powers(self, n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
        """base ** i and its inverse modulo 2 ** 64, for i below n."""
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
        up[:1] = down[:1] = 1
        return np.cumprod(up), np.cumprod(down)

    def units(self, text: str) -> list[str]:
        codes = _codes(text)
        inner = _found(self.pairs, (codes[:-1] << 21) | codes[1:]) >= 0
        cuts = np.flatnonzero(~inner) + 1
        return [text[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)])]

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, symbol, score) of all pieces in the text; ``left``: characters of the unit from there on."""
        up, down = self.powers(len(codes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * up)])
        out, plain = [], np.zeros(len(codes), bool)
        for n, (keys, ids, texts) in enumerate(self.of_length, 1):
            starts = np.flatnonzero(left >= n)
            if not len(keys) or not len(starts):
                continue
            at = _found(keys, (sums[starts + n] - sums[starts]) * down[starts])
            starts, at = starts[at >= 0], at[at >= 0]
            same = (codes[starts[:, None] + np.arange(n)] == texts[at]).all(axis=1)
            starts, found = starts[same], ids[at[same]]
            if n == 1:
                plain[starts] = True
            out.append((starts, np.full(len(starts), n), found, self.score[found]))
        bare = np.flatnonzero(~plain)
        size = 1 + (codes[bare] > 0x7F) + (codes[bare] > 0x7FF) + (codes[bare] > 0xFFFF)
        out.append((bare, np.ones(len(bare), np.int64), self.size + codes[bare], self.lowest * size))
        return tuple(np.concatenate(x) for x in zip(*out))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class Lattices:
    """Filtered lattices of the units met so far, in flat arrays.

    States are numbered through all units. ``reach`` holds, for each edge into state s, s plus the cumulated
    probability of the edges into s; so one binary search for s + draw finds the sampled edge.
    """

    def __init__(self, pieces: Pieces, theta: float):
        self.pieces, self.theta = pieces, theta
        self.short = np.concatenate([np.arange(pieces.size), pieces.byte_ids[:128]]).astype(np.int32)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first = self.last = np.empty(0, np.int64)
        self.origin = self.symbol = np.empty(0, np.int32)
        self.reach, self.states = np.empty(0), 0

    def add(self, units: list[str]) -> None:
        """Filters the lattices of new units and appends them."""
        sizes = np.array([len(u) for u in units])
        ends = np.cumsum(sizes)
        unit = np.repeat(np.arange(len(units)), sizes)
        left = ends[unit] - np.arange(ends[-1])
        start, length, symbol, score = self.pieces.edges(_codes("".join(units)), left)
        origin = start + unit[start]  # each unit has a state more than characters
        state = origin + length
        depth = sizes[unit[start]] - left[start] + length
        order = np.lexsort((state, depth))
        origin, state, symbol, depth, weight = origin[order], state[order], symbol[order], depth[order], self.theta * score[order]
        alpha, share = np.zeros(ends[-1] + len(units)), np.empty(len(order))
        steps = np.searchsorted(depth, np.arange(1, depth[-1] + 2))
        for a, b in zip(steps[:-1], steps[1:]):
            into = state[a:b]
            at = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
            per = np.diff(np.append(at, b - a))
            value = alpha[origin[a:b]] + weight[a:b]
            top = np.maximum.reduceat(value, at)
            value = np.exp(value - np.repeat(top, per))
            total = np.add.reduceat(value, at)
            alpha[into[at]] = top + np.log(total)
            upto = np.cumsum(value / np.repeat(total, per))
            upto -= np.repeat(np.concatenate([[0.0], upto[at[1:] - 1]]), per)
            upto[np.append(at[1:], b - a) - 1] = 1.0
            share[a:b] = upto
        order = np.argsort(state, kind="stable")
        self.reach = np.concatenate([self.reach, (state + share + self.states)[order]])
        self.origin = np.concatenate([self.origin, (origin[order] + self.states).astype(np.int32)])
        self.symbol = np.concatenate([self.symbol, symbol[order].astype(np.int32)])
        self.known.update(zip(units, range(len(self.first), len(self.first) + len(units))))
        self.first = np.concatenate([self.first, self.states + ends - sizes + np.arange(len(units))])
        self.last = np.concatenate([self.last, self.states + ends + np.arange(len(units))])
        self.states += int(ends[-1]) + len(units)

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text; every text is not empty."""
        if len(self.symbol) > MOST_EDGES:
            self.clear()
        found = [self.pieces.units(" " + t) for t in texts]
        sizes = np.array([len(x) for x in found])
        found = [u for x in found for u in x]
        new = [u for u in dict.fromkeys(found) if u not in self.known]
        if new:
            self.add(new)
        unit = np.array(list(map(self.known.__getitem__, found)))
        first, state = self.first[unit], self.last[unit]
        starts = np.cumsum(sizes) - sizes
        ordinal = np.arange(len(unit)) - np.repeat(starts, sizes)
        stream = _mix(np.repeat(seeds, sizes) + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        active, steps = np.arange(len(unit)), []
        while len(active):
            draw = _mix(stream[active] + np.uint64((len(steps) + 1) * 0xD1B54A32D192ED03 % 2**64))
            draw = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at = np.minimum(state[active] + draw, np.nextafter(state[active] + 1.0, 0.0))  # rounding stays in the state
            edge = np.searchsorted(self.reach, at, side="right")
            steps.append((active, self.symbol[edge]))
            state[active] = self.origin[edge]
            active = active[state[active] != first[active]]
        counts = np.zeros(len(unit), np.int64)
        for rows, _ in steps:
            counts[rows] += 1
        ends = np.cumsum(counts)
        out = np.empty(ends[-1] if len(ends) else 0, np.int64)
        for step, (rows, symbols) in enumerate(steps):
            out[ends[rows] - 1 - step] = symbols
        cuts = ends[np.cumsum(sizes) - 1]
        return [self._ids(x) for x in np.split(out, cuts[:-1])]

    def _ids(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols above the vocabulary are bare characters: one byte, or spelled out where there are longer ones."""
        if symbols.max() < len(self.short):
            return self.short[symbols]
        ids = []
        for s in symbols.tolist():
            if s < len(self.short):
                ids.append(self.short[s])
            else:
                ids += [self.pieces.byte_ids[b] for b in chr(s - self.pieces.size).encode("utf-8", "surrogatepass")]
        return np.array(ids, np.int32)


_LOADED: dict[tuple, Lattices] = {}


def lattices(model_file: str, theta: float = THETA) -> Lattices:
    """One table per worker process, filled further by each task."""
    if (model_file, theta) not in _LOADED:
        _LOADED[model_file, theta] = Lattices(Pieces(model_file), theta)
    return _LOADED[model_file, theta]


def segmented(
    df: DataFrame, key: str, text: str, model_file: str, ids: str = "ids", restored: str = "restored", theta: float = THETA, seed: int = 0
) -> DataFrame:
    """Adds ``ids`` (array<int>), pieces sampled by the row's key, and ``restored``: whether decoding gives the text.

    A null text has null ids and counts as restored, an empty one has none. Rows with a null key share one stream of
    draws, and rows with equal key and text get equal ids, also repeated ones. A smaller ``theta`` samples more
    freely, a large one takes the best segmentation. Rows are returned in pieces of some BLOCK_CHARS characters, so
    a task's memory does not depend on how many texts an Arrow batch holds. Columns named as the new ones are an error.
    """
    if {ids.lower(), restored.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {ids} or {restored} exist")
    names, (draws,) = df.columns, fresh(df, "_draws")
    schema = StructType([*df.schema.fields, StructField(ids, ArrayType(IntegerType())), StructField(restored, BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lattices(model_file, theta)
        for batch in batches:
            seeds = batch.column(draws).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            block = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)[:-1]]) // BLOCK_CHARS if len(batch) else sizes
            at = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for first, end in zip(at[:-1].tolist(), at[1:].tolist()):
                part = batch.slice(first, end - first)
                texts = part.column(text).to_pylist()
                rows = [i for i, t in enumerate(texts) if t]
                found = [np.empty(0, np.int32)] * len(texts)
                if rows:
                    for i, x in zip(rows, table.sample([texts[i] for i in rows], seeds[first:end][rows])):
                        found[i] = x
                same = [t is None or table.pieces.decode(x.tolist()) == t for t, x in zip(texts, found)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)), mask=part.column(text).is_null())
                kept = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(same)], [*names, ids, restored])

    return df.withColumn(draws, F.xxhash64(F.col(key), F.lit(seed))).mapInArrow(run, schema)


def decode(ids: Column, model_file: str) -> Column:
    """The text of each array of piece ids; null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = lattices(model_file).pieces
        for arrays in batches:
            yield pd.Series([None if a is None else pieces.decode(a.tolist()) for a in arrays], dtype=object)

    return run(ids)
