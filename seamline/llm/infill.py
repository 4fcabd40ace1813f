"""Fill-in-the-middle: two cuts at unit ends, and the three parts in another order.

The signs of many texts at once become classes by what ends there, kept in a wavelet matrix. Ranks of several classes
add up to the number of unit ends before a place, so a text's units are counted by two queries, and bisection on the
ranks finds where a given number of them ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, free_name

#: Classes of signs: inside a word, last of a word, white space, line break; the last three again where they end the text.
INNER, CLOSE, BLANK, BREAK, END, END_BLANK, END_BREAK = range(7)
#: The classes at which a unit ends.
UNITS = {"word": (CLOSE, END, END_BLANK, END_BREAK), "line": (BREAK, END, END_BLANK, END_BREAK)}


def classes(signs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each code point of texts that lie one after the other; ``ends`` has the place after each."""
    white = (signs == 32) | ((signs >= 9) & (signs <= 13))
    last = np.zeros(len(signs), bool)
    last[ends[ends > np.concatenate([[0], ends[:-1]])] - 1] = True
    closes = ~white & (last | np.append(white[1:], True))
    out = np.where(white, np.where(signs == 10, BREAK, BLANK), np.where(closes, CLOSE, INNER))
    return np.where(last, np.where(white, out + END_BLANK - BLANK, END), out).astype(np.uint8)


class Bits:
    """Bits with their number before any place: words of 64, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class Wavelets:
    """A wavelet matrix: a level for each bit of a class, the high one first, the signs parted by it for the next."""

    def __init__(self, values: np.ndarray, depth: int = 3):
        self.levels = []
        for k in reversed(range(depth)):
            high = (values >> k & 1).astype(bool)
            self.levels.append((Bits(high), len(values) - int(high.sum())))
            values = np.concatenate([values[~high], values[high]])

    def rank(self, value: int, place: np.ndarray) -> np.ndarray:
        """How many of ``value`` stand before each place."""
        low = np.zeros_like(place)
        for k, (bits, zeros) in enumerate(self.levels):
            a, b = bits.ones(low), bits.ones(place)
            if value >> (len(self.levels) - 1 - k) & 1:
                low, place = zeros + a, zeros + b
            else:
                low, place = low - a, place - b
        return place - low

    def ranks(self, values: tuple[int, ...], place: np.ndarray) -> np.ndarray:
        return sum(self.rank(v, place) for v in values)


def cuts(texts: list[str], first: np.ndarray, second: np.ndarray, unit: str = "word") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of units n, and where (in code points) the smaller and the larger of ``first`` and ``second`` mod n + 1 units end."""
    ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    index, kinds = Wavelets(classes(signs, ends)), UNITS[unit]
    before = index.ranks(kinds, starts)
    n = index.ranks(kinds, ends) - before
    a, b = first % (n + 1), second % (n + 1)

    def end_of(k: np.ndarray) -> np.ndarray:
        low, high = starts.copy(), np.where(k > 0, ends, starts)  # the smallest place with k ends before it lies between them
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = index.ranks(kinds, middle) - before >= k
            high, low = np.where(open_ & enough, middle, high), np.where(open_ & ~enough, middle + 1, low)
        return high - starts

    return n, end_of(np.minimum(a, b)), end_of(np.maximum(a, b))


def draws(key: Column, seed: int = 42, many: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers of a key: the first groups of the SHA-256 of seed, colon and key. A null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(many)]


def transform(docs: DataFrame, key: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "word", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), out: str = "output") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and ``out``: the whole text as it is (plain), or as prefix, suffix, middle (psm) or suffix, prefix, middle (spm) behind marks.

    Of each hundred texts about ``rate`` change, and of those ``spm`` become spm. A null or empty text, and one that holds a
    mark, stays plain, with null for the two lengths. ``unit`` is a word with the white space before it (white space that ends a text is one of its own), or a line.
    Rows that repeat give equal results; an empty table gives an empty one; the five columns replace others of their names. Texts are cut some 1.5 million
    characters at a time, a longer one by itself. Batches are those of ``bounded_batches``.
    """

    @F.pandas_udf("n long, low long, high long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, first, second in batches:
            texts, found = texts.tolist(), [np.zeros((3, 0), np.int64)]
            for i, j in blocks(texts):
                found.append(np.stack(cuts(texts[i:j], first.to_numpy()[i:j], second.to_numpy()[i:j], unit)))
            yield pd.DataFrame(np.concatenate(found, axis=1).T, columns=["n", "low", "high"])

    p, s, m = map(F.lit, marks)
    at = free_name(docs, "_cut")
    h1, h2, h3, h4 = draws(F.col(key), seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = bounded_batches(docs).withColumn(at, cut(text, h1, h2))
    marked = F.lit(False)
    for x in marks:
        marked = marked | F.contains(text, F.lit(x))
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    low, high = F.col(f"{at}.low").cast("int"), F.col(f"{at}.high").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low), F.substring(text, high + 1, F.length(text))
    made = F.when(form == "plain", text).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    told = told.withColumns({"n": F.col(f"{at}.n"), "form": form, "prefix_chars": F.when(form != "plain", F.col(f"{at}.low")), "middle_chars": F.when(form != "plain", F.col(f"{at}.high") - F.col(f"{at}.low")), out: made})
    return told.drop(at)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that ``transform`` was given, from its output and form alone: no part holds a mark, so the marks part them."""
    part = F.split(output, "|".join(f"\\Q{x}\\E" for x in marks), -1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.concat(part[1], part[3], part[2]))
