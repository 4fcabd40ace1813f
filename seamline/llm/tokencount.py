"""Token counts under a unigram model, by dynamic programming over a trie of the words.

The distinct words of a batch go into one trie. The best score of every prefix is
computed once, from those of shorter prefixes and the pieces that end there, and
shared by all words that begin with it; the end node of a word has its count. The
model is a public vocabulary with Zipf scores by its own order, so nothing is trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, blocks

MARK = "▁"


@cache
def vocabulary(path: str) -> tuple[dict[str, float], int, float]:
    """Log probabilities of the pieces, Zipf by their place; the longest piece; the score of a lone byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(plain))))
    scores = {p: -math.log(r + 2) - total for r, p in enumerate(plain)}
    return scores, max(map(len, plain)), -2 * math.log(len(plain) + 2) - total


class Trie:
    """Nodes share their prefix's best score and its number of tokens."""

    def __init__(self, scores: dict[str, float], longest: int, byte: float):
        self.scores, self.longest, self.byte = scores, longest, byte
        self.next: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        """Insert a word, computing its new prefixes alone; the tokens of the whole."""
        at, path = 0, [0]
        for i, c in enumerate(word):
            to = self.next.get((at, c))
            if to is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                best, tokens = self.best[at] + size * self.byte, self.tokens[at] + size
                for j in range(max(0, i + 1 - self.longest), i + 1):
                    s = self.scores.get(word[j : i + 1])
                    if s is not None and (s := s + self.best[path[j]]) > best:
                        best, tokens = s, self.tokens[path[j]] + 1
                to = self.next[at, c] = len(self.best)
                self.best.append(best)
                self.tokens.append(tokens)
            at = to
            path.append(at)
        return self.tokens[at]


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", words_out: str = "n_words", tokens_out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of words (between white space) and of tokens in each whole text.

    A word is marked at its start and segmented into the pieces of the greatest total score, of
    equal ones that with the longest last piece; a character without a piece costs its UTF-8 bytes.
    A null text counts 0, as an empty one. The two columns replace any of the same name.
    """

    @F.pandas_udf("words long, tokens long")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, cached = vocabulary(model_path), Bounded()

        def fill(new: list[str]) -> Iterator[int]:
            trie = Trie(*model)
            return [trie.count(MARK + w) for w in new]

        for texts in batches:
            texts, words, tokens = texts.tolist(), [], []
            for i, j in blocks(texts):
                split = [x.split() if x else [] for x in texts[i:j]]
                cached.need(sorted(set().union(*split)), fill)
                words += map(len, split)
                tokens += [sum(map(cached.__getitem__, s)) for s in split]
            yield pd.DataFrame({"words": np.array(words, int), "tokens": np.array(tokens, int)})

    got = "_counted"
    while got in docs.columns:
        got = "_" + got
    out = docs.withColumn(got, told(F.col(text_col)))
    return out.withColumns({words_out: F.col(f"{got}.words"), tokens_out: F.col(f"{got}.tokens")}).drop(got)
