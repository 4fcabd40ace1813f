"""Packing of tokenised documents into sequences by bounded-space online best fit.

Documents are tokenised, closed with an end id and cut into pieces of at most one
sequence. In each partition a fixed number of bins is open, kept by their free
space, with one bit for each free space that occurs. A piece goes to the open
bin with the least space that holds it; if there is none, a new bin opens, and
if too many are open, the fullest closes first.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, bounded_batches, spans

#: White space of more than one byte, as the tokenizer's pattern means it, in Unicode's property White_Space.
WIDE = "\x85\xa0" + "".join(map(chr, (0x1680, 0x2000))) + "-" + "".join(map(chr, (0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = "\t-\r " + WIDE
_ODD = re.compile(rf"[{SPACE}][{WIDE}]|[{WIDE}][{SPACE}]")
_CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_LETTERS = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_units = Bounded()


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def added(path: str) -> list[str]:
    """The tokens that the file adds to the vocabulary and that no merge makes; they are found in any text that holds them."""
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def _ids(path: str, texts: list[str]) -> list[bytes]:
    t = tokenizer(path)
    return [_packed(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def _packed(ids: list[int]) -> bytes:
    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


def _byte_signs() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SIGNS = _byte_signs()


def _unit_ids(path: str, units: list[bytes]) -> list[bytes]:
    """Ids of parts of a text; letters, and a space before them, are one unit of the pattern and go straight to the merges."""
    merge = tokenizer(path).model.tokenize
    whole = pc.match_substring_regex(pa.array(units, pa.string()), _LETTERS).to_pylist()
    signs = [u.decode("latin-1").replace(" ", _SIGNS[32]) if u.isascii() else u.decode("latin-1").translate(_SIGNS) if w else "" for u, w in zip(units, whole, strict=True)]
    other = iter(_ids(path, [u.decode() for u, w in zip(units, whole, strict=True) if not w]))
    return [_packed([x.id for x in merge(s)]) if w else next(other) for s, w in zip(signs, whole, strict=True)]


def _cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the parts of texts start, in UTF-8 with a text between each two ``edges``: the pattern ends a match there, whatever is beside it.

    White space of one byte is cut as the pattern does: a run but for its last sign is a part, and that sign is one, or belongs to
    the word after it if it is a space. Words are cut behind a letter, before a sign of one byte that is none.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    if not len(data):
        return np.flatnonzero(cut[:-1])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    low = data | 32
    letter = (low >= 97) & (low <= 122)
    other = (data < 128) & ~letter
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut[1:-1] |= letter[:-1] & other[1:]
    cut[1:-1] |= space[1:] & ~space[:-1]
    cut[1:-1] |= space[:-1] & ~space[1:] & (data[:-1] != 32)
    last = space.copy()  # the last white space before a word
    last[:-1] &= ~space[1:]
    last[edges[1:][edges[1:] > 0] - 1] = False
    return np.flatnonzero(cut[:-1] | last)


def _encoded(path: str, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, one after the other and each with ``end`` behind it, and the edges of each text's.

    Texts are cut where no token crosses, and each distinct part is tokenised once. A text that holds one of the ``added``
    tokens goes through the tokenizer whole, and one where wide white space meets other is cut by the pattern itself.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    apart: dict[int, list[bytes]] = {}
    whole = np.zeros(len(texts), bool)
    for a in added(path):
        whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(texts, _ODD.pattern).to_numpy(zero_copy_only=False) & ~whole
    at = np.flatnonzero(whole).tolist()
    apart.update(zip(at, ([x] for x in _ids(path, texts.take(pa.array(at, pa.int64())).to_pylist())), strict=True))
    for i in np.flatnonzero(odd).tolist():
        apart[i] = _looked_up(path, [x.encode() for x in _CHUNK.findall(texts[i].as_py())])
    if apart:
        texts = pc.if_else(pa.array(whole | odd), "", texts)

    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    starts = _cuts(data, edges)
    places = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
    parts = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, places, pa.py_buffer(data)]).dictionary_encode()
    values = _looked_up(path, parts.dictionary.to_numpy(zero_copy_only=False).tolist())

    upto = np.searchsorted(starts, edges)  # parts before each edge
    extra = np.full(len(texts), len(values), np.int64)
    values.append(end)
    for i, own in apart.items():
        extra[i] = len(values)
        values.append(b"".join([*own, end]))
    picked = np.insert(parts.indices.to_numpy().astype(np.int64), upto[1:], extra)
    ids = pa.array(values, pa.large_binary()).take(pa.array(picked))
    _, offsets, data = ids.buffers()
    bounds = np.frombuffer(offsets, np.int64)[upto + np.arange(len(upto))]
    return np.frombuffer(data or b"", np.uint8), bounds


def _looked_up(path: str, units: list[bytes]) -> list[bytes]:
    _units.need(dict.fromkeys(units), lambda new: _unit_ids(path, new))
    return list(map(_units.__getitem__, units))


def encode(path: str, texts: list[str]) -> list[bytes]:
    """Token ids of each text, four little-endian bytes an id."""
    data, bounds = _encoded(path, pa.array(texts, pa.string()))
    return [data[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _cut_up(batches: Iterable[pa.RecordBatch], path: str, size: int, end: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in spans(batch.column("text"), 6_000_000):
            data, bounds = _encoded(path, batch.column("text").slice(i, j - i), end)
            n = np.diff(bounds) // 4
            many = (n + size - 1) // size
            owner = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            first = (n - 1) % size + 1
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * size)
            length = np.where(piece == 0, first[owner], size)
            left = bounds[:-1][owner] + 4 * start
            crc = [zlib.crc32(data[a:b]) for a, b in zip(left.tolist(), (left + 4 * length).tolist(), strict=True)]
            ids = batch.column("id").slice(i, j - i).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, words: int = 1_000_000) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's pieces; the first is the shorter one.

    A null text is an empty one: its end id alone. Repeated rows and ids each give their own pieces. A worker
    keeps the ids of up to ``words`` distinct words, some 200 bytes each: fewer take less memory, and more words are tokenised again.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = _packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _units.most = words
        yield from _cut_up(batches, tokenizer_path, size, end)

    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open bins by free space; a bit of ``free`` is set where a bin has just that much."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.free, self.bins, self.open = 0, [[] for _ in range(size + 1)], 0

    def _take(self, space: int) -> int:
        b = self.bins[space].pop()
        self.open -= 1
        if not self.bins[space]:
            self.free &= ~(1 << space)
        return b

    def put(self, length: int) -> tuple[int, int]:
        """The bin for a piece, and its place there."""
        above = self.free >> length
        if above:
            space = length + (above & -above).bit_length() - 1
            b = self._take(space)
        else:
            space, b = self.size, self.next
            self.next += 1
        if left := space - length:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            self.bins[left].append(b)
            self.free |= 1 << left
            self.open += 1
        return b, self.size - space


def pack(cut_up: DataFrame, size: int = 1024, open_bins: int = 1024) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset``. No piece is longer than ``size``.

    The pieces are dealt to partitions by their key, so how the input is split does not
    matter; each partition packs its own sequences, in one pass and constant memory.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_up.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit = BestFit(size, open_bins, TaskContext.get().partitionId() << 40)
        for pdf in batches:
            got = [fit.put(n) for n in pdf["length"].tolist()]
            yield pdf.assign(sequence_id=[x[0] for x in got], offset=[x[1] for x in got])

    return cut_up.repartition(F.col("id"), F.col("piece")).mapInPandas(run, f"{fields}, sequence_id long, offset long")
