"""Byte-pair encoding of whole texts and its way back.

A text is normalised, cut into words, and each distinct word is merged on its own: its symbols
form a doubly linked list, the ranks of the merges between neighbours wait in a priority queue,
and an entry whose neighbours have changed since is skipped when it comes up. So a word of n bytes
takes O(n log n), however long it is. Decoding looks every id up and joins the vocabulary's strings.

The vocabulary file is of the kind that lower-cases, drops white space and marks word ends.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, blocks, bounded_batches
from .packing import _SIGNS, _packed, tokenizer

#: Control signs that Python's split() takes for white space and the vocabulary's pattern does not.
_NO_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


class Model:
    """Merge ranks, symbols and patterns of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, steps = told["model"], [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        splits = [x["pattern"]["Regex"] for x in told["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        if steps != ["NFC", "Replace", "Lowercase"] or len(splits) != 1 or not model["end_of_word_suffix"] or told["decoder"]:
            raise ValueError(f"{path} is not a vocabulary of lower-case words with marked ends")
        ids = model["vocab"]
        self.pattern, self.tokenizer = regex.compile(splits[0]), tokenizer(path)
        self.added = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.strings = [""] * (max([*ids.values(), *self.added.values()]) + 1)
        for s, i in [*ids.items(), *self.added.items()]:
            self.strings[i] = s
        self.inner = [ids[_SIGNS[b]] for b in range(256)]
        self.final = [ids[_SIGNS[b] + model["end_of_word_suffix"]] for b in range(256)]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.made, self.blank = [ids[a + b] for a, b in pairs], len(self.strings)
        self.follows: list[dict[int, int]] = [{} for _ in range(self.blank + 1)]  # by the left symbol: the right one and their merge's rank
        for rank, (a, b) in enumerate(pairs):
            self.follows[ids[a]][ids[b]] = rank
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def merge(self, word: str) -> list[int]:
        """The ids of one word. The list's ends and symbols that were merged away point to a blank that nothing merges with."""
        data, blank, follows, made = word.encode(), self.blank, self.follows, self.made
        n = len(data)
        ids = [self.inner[b] for b in data] + [blank]
        ids[n - 1] = self.final[data[-1]]
        queue = [r * n + i for i in range(n - 1) if (r := follows[ids[i]].get(ids[i + 1])) is not None]  # a rank, and a place below it
        heapify(queue)
        after, before = list(range(1, n + 1)), [n, *range(n)]
        while queue:
            r, i = divmod(heappop(queue), n)
            j = after[i]
            if follows[ids[i]].get(ids[j]) != r:
                continue  # stale: one of the two was merged since
            ids[i], ids[j] = a, _ = made[r], blank
            after[i] = k = after[j]
            before[k], h = i, before[i]
            if (r := follows[a].get(ids[k])) is not None:
                heappush(queue, r * n + i)
            if (r := follows[ids[h]].get(a)) is not None:
                heappush(queue, r * n + h)
        return [x for x in ids if x != blank]

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary's strings of the ids; they stand apart by a space, as the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


    def words(self, run: str) -> list[str]:
        """The words of a run without white space. Signs that are newer than Python's tables are left to the library's."""
        if not run.isprintable() and any(unicodedata.category(c) == "Cn" for c in run):
            run = self.tokenizer.normalizer.normalize_str(run)
            ends = [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(run)]
            return [run[i:j] for i, j in ends]
        return self.pattern.findall(run)


@cache
def load(path: str) -> Model:
    return Model(path)


def normal(text: str) -> str:
    """Composed and in lower case, sign by sign: a sigma does not heed its place."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Encoder:
    """Encodes for one worker; runs between white space, and their words, are merged once as far as the caches reach."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.runs, self.words = model, Bounded(most), Bounded(most)

    def _merged(self, words: list[str]) -> list[bytes]:
        return [_packed(self.model.merge(w)) for w in words]

    def _joined(self, runs: list[str]) -> list[bytes]:
        parts = [None if x.isalpha() else self.model.words(x) for x in runs]
        self.words.need(set().union((x for x, p in zip(runs, parts, strict=True) if p is None), *filter(None, parts)), self._merged)
        word = self.words.__getitem__
        return [word(x) if p is None else b"".join(map(word, p)) for x, p in zip(runs, parts, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four little-endian bytes an id. An added token's string is its one id, wherever it stands."""
        added, cut = self.model.added, self.model.cut
        split = []
        for x in texts:
            own: list[str] = []
            for part in cut.split(x) if cut and any(a in x for a in added) else (x,):
                if part in added:
                    own.append(" " + part)  # no run begins with a space
                else:
                    part = normal(part)
                    own += filter(None, _SPACE.split(part)) if _NO_SPACE.search(part) else part.split()
            split.append(own)
        need, ids = set().union(*split), {" " + a: _packed([i]) for a, i in added.items()}
        self.runs.need(need.difference(ids), self._joined)
        get = self.runs.__getitem__ if need.isdisjoint(ids) else lambda x: ids.get(x) or self.runs[x]
        return [b"".join(map(get, own)) for own in split]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """``docs`` with the token ids of each whole text in ``out``: an array, or with ``packed`` four little-endian bytes an id.

    A null text has no ids, as an empty one and one of white space alone. Repeated rows are encoded as often as they come, an
    empty table gives an empty one, and ``out`` replaces a column of that name. Texts are encoded some 1.5 million characters at a
    time, a longer one by itself; a worker's caches are bounded. Batches are those of ``bounded_batches``.
    """

    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Encoder(load(model_path))
        for texts in batches:
            texts, found = [x or "" for x in texts.tolist()], []
            for i, j in blocks(texts):
                found += own.encode(texts[i:j])
            yield pd.Series(found if packed else [np.frombuffer(x, "<u4").astype("<i4") for x in found], dtype=object)

    told.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return bounded_batches(docs).withColumn(out, F.pandas_udf(told, "binary" if packed else "array<int>")(F.col(text_col)))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids (an array or packed, as ``encode`` gives them) in ``out``, special tokens too.

    Null ids and none at all give an empty text. An id beyond the vocabulary, which no encoding gives, is an error. ``out``
    replaces a column of that name.
    """
    packed = rows.schema[ids_col].dataType.simpleString() == "binary"

    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load(model_path)
        for ids in batches:
            yield pd.Series([model.decode((np.frombuffer(x, "<u4") if packed else x).tolist()) if x is not None else "" for x in ids], dtype=object)

    told.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return bounded_batches(rows).withColumn(out, F.pandas_udf(told, "string")(F.col(ids_col)))
