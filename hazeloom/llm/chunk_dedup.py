"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends at a blank where the hash says so, or where the text
repeats itself within a few words, so boundaries follow the content and an insertion moves only those next to it. Two
chunks in a row are known by the digest of both; all but its first occurrence are repeats. Repeated pairs make a run as
long as their first occurrences follow each other too, so a run as a whole stands in one earlier place; runs of
``min_words`` words or more are taken out of the text. A long chunk is a run by itself.

Only digests and the numbers of chunks are shuffled to find repeats; positions are found again where the text is cut.
Occurrences of a digest are counted before the shuffle, and the join back is a plain equi-join that adaptive execution
splits where a passage is very frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import fresh

WINDOW = 16
#: One in so many blanks ends a chunk, and one in so many other bytes, for texts without blanks.
BLANKS, OTHERS = 6, 2048
LONGEST = 8000
#: A text that repeats itself within so many blanks, with the last WINDOW bytes the same, ends a chunk at each of them.
PERIOD_BLANKS = 4
#: Runs without blanks count by their bytes.
BYTES_PER_WORD = 15
#: Stands for the text itself among the hashes that name the texts of first occurrences.
OWN = -1
#: Rows that a task has in hand at a time.
SLICE_ROWS = 500
RESULT = StructType().add("text", "string").add("n_runs", "integer").add("n_words", "long").add("n_bytes", "long")


def _gear() -> np.ndarray:
    """A pseudo-random 32-bit number per byte value (Weyl sequence, mixed)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j below WINDOW, by doubling the window."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text's bytes, ascending, the last one its length."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    h = rolling(data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    ends = (blank & (h < 2**32 // BLANKS)) | (h < 2**32 // OTHERS)
    places = np.flatnonzero(blank)
    for lag in range(1, PERIOD_BLANKS + 1):
        ends[places[lag:][h[places[lag:]] == h[places[:-lag]]]] = True
    ends[:-1] &= (data[1:] & 0xC0) != 0x80  # never inside a character
    cuts = np.flatnonzero(ends) + 1
    if not len(cuts) or cuts[-1] != n:
        cuts = np.append(cuts, n)
    gaps = np.diff(cuts, prepend=0)
    if gaps.max() > LONGEST:
        extra = [np.arange(c - g + LONGEST, c, LONGEST) for c, g in zip(cuts, gaps) if g > LONGEST]
        extra = np.concatenate(extra)
        for _ in range(3):
            extra -= (data[extra] & 0xC0) == 0x80
        cuts = np.union1d(cuts, extra)
    return cuts


def _long(raw: bytes, min_words: int) -> bool:
    return len(raw.split()) >= min_words or len(raw) >= BYTES_PER_WORD * min_words


def _units(raw: bytes, min_words: int) -> tuple[np.ndarray, list[bytes]]:
    """Numbers and contents of what is looked up: chunk i with the next as 2 i, a long chunk alone as 2 i + 1."""
    cuts = cut_points(np.frombuffer(raw, np.uint8)).tolist()
    starts = [0, *cuts[:-1]]
    alone = [i for i, (a, b) in enumerate(zip(starts, cuts)) if b - a >= min_words and _long(raw[a:b], min_words)]
    # the place of the border is part of a pair
    pairs = [raw[a:c] + (b - a).to_bytes(2, "little") for a, b, c in zip(starts, cuts, cuts[1:])]
    numbers = np.concatenate([2 * np.arange(len(pairs)), 2 * np.array(alone, np.int64) + 1])
    return numbers, pairs + [raw[starts[i] : cuts[i]] for i in alone]


def _chunks(rows: DataFrame, min_words: int) -> DataFrame:
    """(digest, id, hash, at) of every unit of every text, once: its own repeats in a text are known where it is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest_of = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = batch.column("text")
            for first in range(0, len(batch), SLICE_ROWS):
                digests, ats, sizes = [], [], []
                for i in range(first, min(first + SLICE_ROWS, len(batch))):
                    numbers, units = _units(texts[i].as_buffer().to_pybytes(), min_words)
                    once = dict(zip(reversed(units), reversed(numbers.tolist())))
                    digests += map(digest_of, once)
                    ats.append(np.fromiter(once.values(), np.int64, len(once)))
                    sizes.append(len(once))
                if digests:
                    part = pa.array(np.repeat(np.arange(first, first + len(sizes)), sizes))
                    columns = [pa.array(np.array(digests, np.uint64).view(np.int64))]
                    columns += [batch.column(c).take(part) for c in ("id", "hash")] + [pa.array(np.concatenate(ats))]
                    yield pa.RecordBatch.from_arrays(columns, ["digest", "id", "hash", "at"])

    return rows.mapInArrow(run, "digest bigint, id bigint, hash bigint, at bigint")


def _runs(found: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """(first chunk, end chunk) of runs whose first occurrences follow each other, from unit -> (text, unit there).

    Where the text repeats itself, so may the first occurrences.
    """
    runs = [(at // 2, at // 2 + 1) for at in found if at % 2]
    pairs = sorted(at for at in found if not at % 2)
    start, recent = 0, []
    for i, at in enumerate(pairs):
        text, there = found[at]
        goes_on = i and at == pairs[i - 1] + 2 and text == recent[-1][0] and (there == recent[-1][1] + 2 or (text, there) in recent[-8:])
        if i and not goes_on:
            runs.append((pairs[start] // 2, pairs[i - 1] // 2 + 2))
            start, recent = i, []
        recent.append((text, there))
    if pairs:
        runs.append((pairs[start] // 2, pairs[-1] // 2 + 2))
    return runs


def _cut(text: str, found: list[dict] | None, min_words: int) -> tuple[str, int, int, int]:
    """The text without its long runs of repeated chunks; removed runs, words and bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    if not _long(raw, min_words):
        return text, 0, 0, 0
    places = {f["at"]: (f["text"], f["there"]) for f in found or ()}
    numbers, units = _units(raw, min_words)
    if len(set(units)) < len(units):
        first: dict[bytes, int] = {}
        for at, unit in zip(numbers.tolist(), units):
            own = first.setdefault(unit, at)
            if own != at:  # where the first one in this text is from, or that one itself
                places[at] = places.get(own, (OWN, own))
    if not places:
        return text, 0, 0, 0
    cuts = [0, *cut_points(np.frombuffer(raw, np.uint8)).tolist()]
    spans = [(cuts[a], cuts[b]) for a, b in _runs(places)]
    kept, last, runs, words = [], 0, 0, 0
    merged: list[list[int]] = []
    for a, b in sorted(s for s in spans if _long(raw[s[0] : s[1]], min_words)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        kept.append(raw[last:a])
        last, runs, words = b, runs + 1, words + len(raw[a:b].split())
    kept.append(raw[last:])
    left = b"".join(kept)
    return left.decode("utf-8", "surrogatepass"), runs, words, len(raw) - len(left)


def without_repeats(df: DataFrame, key: str, text: str, result: str = "dedup", min_words: int = 20) -> DataFrame:
    """Adds a struct column ``result`` (text, n_runs, n_words, n_bytes: what is left, and what was taken out).

    The first occurrence, by smallest key, then text hash, then position, stays; so every passage is left once. A null
    key comes last. Rows with the same key and text count as one document and get the same result; rows with the same
    key, or none, and different texts are documents of their own. A null text stays null, an empty one empty. Repeats
    inside one text are taken out too. What is taken out stands in one piece in an earlier text, or earlier in this one.
    """
    if result.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {result} exists")
    i, h, ats = fresh(df, "_id", "_hash", "_ats")
    ident, text_hash = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.col(text))
    rows = df.where(F.length(text) > 0).select(ident.alias("id"), text_hash.alias("hash"), F.col(text).alias("text"))
    chunks = _chunks(rows, min_words)
    first = (
        chunks.groupBy("digest")
        .agg(F.min(F.struct("id", "hash", "at")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    repeats = chunks.join(first, "digest").where("struct(id, hash, at) > first").select(
        F.col("id").alias(i), F.col("hash").alias(h), F.struct("at", F.xxhash64("first.id", "first.hash").alias("text"), F.col("first.at").alias("there")).alias("unit")
    )
    repeats = repeats.groupBy(i, h).agg(F.collect_list("unit").alias(ats))

    names = df.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("text", pa.string()), ("n_runs", pa.int32()), ("n_words", pa.int64()), ("n_bytes", pa.int64())]
        for batch in batches:
            for first in range(0, len(batch), SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                texts, places = part.column(text).to_pylist(), part.column(ats).to_pylist()
                done = [(None, 0, 0, 0) if t is None else _cut(t, a, min_words) for t, a in zip(texts, places)]
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*done), fields)]
                taken = pa.StructArray.from_arrays(columns, [f for f, _ in fields])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], taken], [*names, result])

    joined = df.withColumns({i: ident, h: text_hash}).join(repeats, [i, h], "left").select(*names, ats)
    # the struct is made once, whatever is asked of it
    return joined.mapInArrow(cut, StructType([*df.schema.fields, StructField(result, RESULT)]))
