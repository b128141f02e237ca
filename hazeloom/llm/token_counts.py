"""Token counts of a subword model without tokenizing the words that are one token anyway.

The model merges pieces inside a unit only: a unit is a run of the space mark with what follows it, and no
vocabulary string has the space mark after another character (``check_units`` proves it for the model in use).
So the count of a text is the sum over its units. ``whole_tokens`` proves once which vocabulary strings encode
alone as one token; those units count one each, and only the other units are merged, by the library, once per
worker and distinct unit (the table is emptied when it holds ``CACHE`` of them, so memory stays bounded).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_MARK = "▁"
CACHE = 400_000


def load(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def check_units(model) -> None:
    """Raises if a vocabulary string could be merged across the start of a unit, or if the model rewrites texts."""
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
        raise ValueError("a vocabulary string goes on after a space mark inside it")
    probe = "  ﬁ a  b "
    if model.normalize(probe) != SPACE_MARK + probe.replace(" ", SPACE_MARK):
        raise ValueError("the model normalizes texts or drops spaces")


def whole_tokens(model) -> set[str]:
    """Vocabulary strings with one leading space mark that encode alone as one token, without that mark."""
    words = [p[1:] for p in (model.id_to_piece(i) for i in range(model.vocab_size())) if p[:1] == SPACE_MARK]
    words = [w for w in words if w and SPACE_MARK not in w]
    return {w for w, ids in zip(words, model.encode(words, num_threads=1)) if len(ids) == 1}


class Counter(dict):
    """Tokens of the unit made of a space mark and the key; unknown units are merged on first use."""

    def __init__(self, model_file: str):
        self.model = load(model_file)
        check_units(self.model)
        self.whole = whole_tokens(self.model)
        super().__init__(dict.fromkeys(self.whole, 1))

    def __missing__(self, unit: str) -> int:
        n = len(self.model.encode(unit, num_threads=1))
        if len(self) > CACHE:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[unit] = n
        return n

    def of_text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(SPACE_MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        # a run of spaces stays with the word after it: the first space of the run is the unit's own mark
        units, run = [], 0
        for word in text.split(" "):
            if word:
                units.append(" " * run + word)
                run = 0
            else:
                run += 1
        total = sum(map(self.__getitem__, units))
        if run:  # spaces at the end are a unit of space marks alone
            total += len(self.model.encode(" " * (run - 1), num_threads=1)) if run > 1 else 1
        return total


def token_count(text: Column, model_file: str) -> Column:
    """Tokens of each text without begin, end or added special tokens; a null text counts as empty, so 0.

    ``model_file`` must exist on every executor. Texts are taken whole, in Arrow batches; a row never meets another
    one, so copies and hot sources need no shuffle.
    """

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(model_file)
        for texts in batches:
            yield pd.Series([counter.of_text(t) for t in texts.fillna("")], dtype="int64")

    return count(F.coalesce(text, F.lit("")))
