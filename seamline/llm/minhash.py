"""Near-duplicate classes by BagMinHash over multisets of word shingles.

A document is the multiset of its five-word shingles (lower case, runs of word
characters; a text of fewer words is one shingle). Each shingle of weight w owns
Poisson processes over the dyadic weight ranges [0,1), [1,2), [2,4), ... below w; a
point has a time, a signature slot and a unit cell within its range, and counts
if the cell lies below w. The earliest point in each slot is the signature, so
two slots agree with the probability of the weighted Jaccard similarity. Times are
sums of whole ticks, which no order of adding changes, and a slot holds its
point's hash, so a text's signature does not depend on the texts beside it.

Bands of slots give candidate buckets. First one pivot a bucket, the member that
shares most buckets, is held against the rest. Members whose class then differs
from that of most of their bucket are held against all of it, block by block, each pair
in the first bucket that it shares; so no link between different texts is lost, and a
bucket of mutual copies costs one check a member. A pair is first held against each
other by a byte of each slot, and the texts move for those pairs alone whose slots agree
about as often as the threshold asks (4.5 standard deviations of leeway); these are told by the
exact multisets. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Bounded, Scratch, blocks, bounded_batches, cut, free_name, mix, perhaps_in, slices, word_hashes

BANDS, ROWS = 26, 5
#: Documents in a block: of texts, of signatures; and the pairs of a pivot that go to one task.
BLOCK, SKETCHES, SPREAD = 256, 2048, 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Parts of a unit of time: sums below 2**17 units are exact in a float.
_TICKS = 2.0**36


@cache
def _word_signs() -> np.ndarray:
    """Of each code point whether it belongs to a word."""
    found = np.zeros(0x110000, bool)
    for m in WORD.finditer(np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        found[m.start() : m.end()] = True
    return found


def _in_words(data: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8 whether its sign belongs to a word."""
    signs = _word_signs()
    found = np.append(signs[:128], np.zeros(128, bool))[data]
    at = np.flatnonzero(data >= 0xC0)
    for n, lead, upto in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        some = at[(data[at] >= lead) & (data[at] < upto)]
        point = data[some].astype(np.int64) & (0x7F >> n)
        for k in range(1, n):
            point = point << 6 | data[some + k] & 0x3F
        for k in range(n):
            found[some + k] = signs[point]
    return found


def _word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin and end; each distinct word is hashed once."""
    _, offsets, data = pa.array([x.lower() if x else "" for x in texts], pa.string()).buffers()
    edges, data = np.frombuffer(offsets, np.int32)[: len(texts) + 1], np.frombuffer(data or b"", np.uint8)
    data = data[: edges[-1]]
    inside = _in_words(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = edges[:-1][edges[:-1] < edges[1:]]
    first[heads] = inside[heads]
    starts, letters = np.flatnonzero(first), data[inside]
    places = np.append(np.flatnonzero(first[inside]), len(letters)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)]).dictionary_encode()
    hashes = np.array(word_hashes(words.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint64)
    return hashes[words.indices.to_numpy()], np.searchsorted(starts, edges)


def shingle_bags(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the distinct shingle hashes, in order, and their counts: (text index, hash, count)."""
    if not any(texts):
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int)
    ids, edges = _word_ids(texts)
    have = np.diff(edges)
    wide = np.minimum(have, width)
    many = np.where(have > 0, have - wide + 1, 0)
    ends = np.cumsum(many)
    owner = np.repeat(np.arange(len(texts)), many)
    starts = np.arange(len(owner)) + (edges[:-1] - ends + many)[owner]
    ids, w = np.append(ids, np.zeros(width, np.uint64)), wide[owner]
    x, least = w.astype(np.uint64), w.min(initial=width)
    for k in range(width):
        more = mix(x * _GOLD + ids[starts + k])
        x = more if k < least else np.where(k < w, more, x)
    for i, j in zip((ends - many).tolist(), ends.tolist(), strict=True):
        x[i:j].sort()
    new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])))[: len(x)]
    return owner[new], x[new], np.diff(np.append(new, len(x)))


def bag_signatures(owner: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """BagMinHash signatures, n x slots, of weighted items: the hash of each slot's earliest point, 0 in a row without items."""
    low, size, keep = [], [], []
    for level in range(max(1, int(weight.max(initial=0)).bit_length() + 1)):
        start = 0 if level == 0 else 1 << (level - 1)
        has = np.flatnonzero(weight > start)
        if not len(has):
            break
        keep.append(has)
        low.append(np.full(len(has), start))
        size.append(np.full(len(has), max(1, start)))
    first, sig = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    if not keep:
        return sig.reshape(n, slots)
    keep, low, size = map(np.concatenate, (keep, low, size))
    own, w = owner[keep], weight[keep]
    seed = mix(item[keep] + low.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    t, k = np.zeros(len(own)), np.zeros(len(own), np.uint64)
    while len(own):
        p = int(np.clip(65_536 // len(own), 1, 64))
        at = k[:, None] + np.arange(p, dtype=np.uint64)
        h = mix(seed[:, None] + at * _GOLD)
        steps = np.rint(-np.log(((h >> np.uint64(11)).astype(float) + 0.5) / 2**53) * _TICKS) / _TICKS
        times = t[:, None] + np.cumsum(steps, axis=1)
        g = mix(h ^ _GOLD)
        slot = (g >> np.uint64(32)) % np.uint64(slots)
        cell = low[:, None] + ((g & np.uint64(0xFFFFFFFF)).astype(float) / 2**32 * size[:, None]).astype(int)
        inside = cell < w[:, None]
        into, when, point = (own[:, None] * slots + slot.astype(int))[inside], (times / size[:, None])[inside], h[inside]
        was = first.copy()
        np.minimum.at(first, into, when)
        sig[first < was] = np.iinfo(np.uint64).max
        won = when == first[into]
        np.minimum.at(sig, into[won], point[won])  # of points at one time the smallest hash
        worst = first.reshape(n, slots).max(axis=1)
        t, k = times[:, -1], k + np.uint64(p)
        on = t / size <= worst[own]
        own, w, low, size, seed, t, k = own[on], w[on], low[on], size[on], seed[on], t[on], k[on]
    return sig.reshape(n, slots)


def signatures(texts: list[str], slots: int, width: int = 5) -> np.ndarray:
    owner, item, count = shingle_bags(texts, width)
    return bag_signatures(owner, item, count, len(texts), slots)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared over joint multiset size of (sorted hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _signed(bands: int, rows: int, width: int):
    """Band hashes of each text and a byte of each of its slots, nulls where it has no word; copies near each other are signed once."""

    def sign(texts: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        for i, j in blocks(texts):
            sig = signatures(texts[i:j], bands * rows, width)
            bits = sig.reshape(-1, bands, rows)
            h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2])
            for r in range(rows):
                h = mix(h * _GOLD + bits[:, :, r])
            for some, own, slots in zip(sig.any(axis=1), h.astype(np.int64), (sig & np.uint64(255)).astype(np.uint8), strict=True):
                yield (own.tobytes(), slots.tobytes()) if some else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bounded(20_000)
        for part in slices(batches, "text"):
            same = part.column("same").to_pylist()
            texts = dict(zip(same, part.column("text").to_pylist(), strict=True))
            texts.pop(None, None)
            known.need(texts, lambda new: sign([texts[x] for x in new]))
            got = [known.get(x) for x in same]
            own = pa.array([x and np.frombuffer(x[0], np.int64) for x in got], pa.list_(pa.int64())), pa.array([x and x[1] for x in got], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("same"), *own], ["id", "same", "bands", "sketch"])

    return run


def least_agreement(threshold: float, slots: int) -> float:
    return threshold - 4.5 * (threshold * (1 - threshold) / slots) ** 0.5


def _alike(least: float):
    """The pairs of (pivot, other) whose sketches agree in a share of ``least``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("x", "y"))
                pdf = pdf[(x == y).mean(axis=1) >= least]
            yield pdf[["pivot", "salt", "other"]]

    return run


def _verified(width: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bag = None, None
        for pdf in batches:
            out = []
            texts = pdf["text_b"].tolist()
            for i, j in blocks(texts):
                owner, item, count = shingle_bags(texts[i:j], width)
                edge = np.searchsorted(owner, np.arange(j - i + 1))
                for r in range(j - i):
                    row = i + r
                    if last != (a := pdf["a"].iat[row]):
                        last, bag = a, shingle_bags([pdf["text_a"].iat[row]], width)[1:]
                    s = slice(edge[r], edge[r + 1])
                    out.append(similarity(bag, (item[s], count[s])))
            yield pdf[["a", "b"]].assign(linked=np.array(out, float) >= threshold - 1e-12)

    return run


def _stacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(rows["bands"]), np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)


def _candidates(odd: pd.DataFrame, every: pd.DataFrame, least: float) -> Iterator[np.ndarray]:
    """For each row of ``odd`` a mask of ``every``: another label, alike sketches, and no earlier bucket in common."""
    (x, u), (y, v) = _stacked(odd), _stacked(every)
    band = int(np.flatnonzero(x[0] == odd["bucket"].iat[0])[0])
    labels = every["label"].to_numpy()
    for r in range(len(odd)):
        want = labels != odd["label"].iat[r]
        if want.any():
            want &= ((v == u[r]).mean(axis=1) >= least) & ~(y[:, :band] == x[r, :band]).any(axis=1)
        yield want


def _suspects(least: float):
    """The rows of two blocks of a bucket that have a candidate in the other one."""

    def run(odd: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        found: set[int] = set()
        if len(odd) and len(every):
            ids, own = every["id"].to_numpy(), odd["id"].to_numpy()
            for r, want in enumerate(_candidates(odd, every, least)):
                if want.any():
                    found.update([int(own[r]), *ids[want].tolist()])
        return pd.DataFrame({"bucket": odd["bucket"].iat[0] if found else 0, "id": sorted(found)}).astype("int64")

    return run


def _compared(width: int, threshold: float, least: float):
    """Links between the documents of two blocks of a bucket, by their texts."""

    def run(odd: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(odd) and len(every):
            owner, item, count = shingle_bags(every["text"].tolist(), width)
            sizes = np.bincount(owner, count, len(every))
            mine, what, many = shingle_bags(odd["text"].tolist(), width)
            edge, ids = np.searchsorted(mine, np.arange(len(odd) + 1)), every["id"].to_numpy()
            for r, want in enumerate(_candidates(odd, every, least)):
                s = slice(edge[r], edge[r + 1])
                total = many[s].sum()
                want &= np.minimum(sizes, total) >= threshold * np.maximum(sizes, total) - 1e-9
                if not want.any():
                    continue
                near = want[owner]
                at = np.searchsorted(what[s], item[near])
                at[at == edge[r + 1] - edge[r]] = 0
                hit = what[s][at] == item[near]
                both = np.bincount(owner[near], np.where(hit, np.minimum(many[s][at], count[near]), 0), len(every))
                linked = want & (both >= (threshold - 1e-12) * (sizes + total - both))
                out += [(int(odd["id"].iat[r]), int(i)) for i in ids[linked]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _by_blocks(rest: DataFrame, size: int, held: list[str], run, schema: str) -> DataFrame:
    """Deal the rows of each bucket to blocks of about ``size``, and give ``run`` each block of odd rows with each block of all."""
    counts = rest.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"), F.ceil(F.count_if(F.col("label") != F.col("most")) / size).alias("odd_blocks"))
    rest = rest.join(counts.where("odd_blocks > 0"), "bucket")
    unit = lambda own, other: [F.pmod(F.xxhash64("id"), F.col(own)).alias(own[:-1]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other[:-1])]
    odd = rest.where("label <> most").select(*(F.col(c).alias(c) for c in held), *unit("odd_blocks", "blocks"))
    every = rest.select(*held, *unit("blocks", "odd_blocks"))
    keys = ["bucket", "block", "odd_block"]
    return odd.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInPandas(run, schema)


def components(links: DataFrame, cut=cut) -> DataFrame:
    """Smallest node of each connected component: (id, label) for every node of ``links(a, b)``.

    Minimum labels pass along the links and jump to their own label's label, so
    the number of rounds grows with the logarithm of the longest path.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = cut(step.join(jump, "label", "left").select("id", "old", F.least("label", "far").alias("label")), "labels")
        done = new.where(F.col("old") != F.col("label")).isEmpty()
        labels = new.select("id", "label")
        if done:
            return labels


def _repeats(rows: DataFrame, id_col: str) -> bool:
    return not rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: (id, class_id), class_id being the smallest id of its class.

    Equal texts, empty ones too, are one class. A null text, and a text without a word
    character, is alone but for its exact copies (a null has none); a null id has a
    null class. Rows that repeat an id are one document with all of their texts, and so of one class. Other columns of
    ``docs`` are not looked at, whatever their names. An empty table gives no row.
    With the default bands a pair at the threshold is missed with probability 3e-5.
    """
    scratch = Scratch(docs.sparkSession)
    keep, least = scratch.cut, least_agreement(threshold, bands * rows)
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.unhex(F.md5(text_col)).alias("same"))
    signed = keep(base.mapInArrow(_signed(bands, rows, width), "id long, same binary, bands array<long>, sketch binary"), "signed")
    repeated = _repeats(signed, "id")
    once = (lambda df: df.dropDuplicates(["id", "same"])) if repeated else (lambda df: df)
    keyed = signed.select("id", "same")
    first = keep(keyed.where("same is not null and id is not null").groupBy("same").agg(F.min("id").alias("id")), "first")
    nodes = keep(once(signed.where("bands is not null").join(first, ["same", "id"])), "nodes")

    slots = nodes.select("id", F.explode("bands").alias("bucket"))
    full = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keep(slots.join(full, "bucket"), "members")
    shares = members.groupBy("id").agg(F.sum("n").alias("shared"))
    pivot = members.join(shares, "id").groupBy("bucket").agg(F.max(F.struct("shared", (-F.col("id")).alias("a"))).alias("top"))
    pairs = members.join(pivot.select("bucket", (-F.col("top.a")).alias("a")), "bucket").where("id <> a")
    pairs = pairs.groupBy(F.least("a", "id").alias("x"), F.greatest("a", "id").alias("y")).agg(F.min("a").alias("pivot"))
    pairs = keep(pairs.select("pivot", F.expr("case when pivot = x then y else x end").alias("other")), "pairs")

    # a pivot with many pairs is copied, so that its pairs can go to many tasks
    loads = keep(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SPREAD).alias("salts")).where("salts > 1"), "loads")
    spread = pairs.join(loads, "pivot", "left").select("pivot", F.pmod(F.xxhash64("other"), F.coalesce("salts", F.lit(1))).alias("salt"), "other")

    def copied(rows: DataFrame, column: str) -> DataFrame:
        """``column`` of the pivots, a row for each of their salts."""
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
        return rows.withColumnRenamed("id", "pivot").join(loads, "pivot", "left").select("pivot", salts, F.col(column).alias("x"))

    other = lambda rows, column: rows.select(F.col("id").alias("other"), F.col(column).alias("y"))
    slim = nodes.select("id", "sketch")
    near = spread.join(other(perhaps_in(slim, pairs.select("other")), "sketch"), "other").join(copied(perhaps_in(slim, pairs.select("pivot")), "sketch"), ["pivot", "salt"])
    near = keep(near.select("pivot", "salt", "other", "x", "y").mapInPandas(_alike(least), "pivot long, salt long, other long").distinct(), "near")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, text, ...) of the documents in ``ids``."""
        wanted = keep(perhaps_in(nodes.select("id", "same"), ids).join(ids, "id"), "wanted")
        return keep(once(perhaps_in(base, wanted.select("id")).join(wanted, ["id", "same"])).select(*ids.columns, "text"), "texts")

    ends = near.select(F.col("pivot").alias("id"), F.lit(True).alias("turned")).union(near.select("other", F.lit(False)))
    texts = texts_of(keep(ends.groupBy("id").agg(F.max("turned").alias("turned")), "ends"))
    told = near.join(other(texts, "text"), "other").join(copied(texts.where("turned"), "text"), ["pivot", "salt"])
    told = told.select(F.col("pivot").alias("a"), F.col("x").alias("text_a"), F.col("other").alias("b"), F.col("y").alias("text_b"))
    links = told.mapInPandas(_verified(width, threshold), "a long, b long, linked boolean").where("linked").select("a", "b")
    if repeated:  # the texts of one document belong together
        own = keyed.join(first.withColumnRenamed("id", "a"), "same").select("id", "a").distinct()
        links = links.union(own.join(own.groupBy("id").agg(F.min("a").alias("b")), "id").where("a <> b").select("a", "b"))
    links = keep(links, "links")
    labels = components(links, keep)

    # what is left: members outside the class of most of their bucket, against all the bucket
    placed = keep(members.where("n > 2").join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("label", "id").alias("label")), "placed")
    most = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    most = most.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("top"), F.max("n").alias("n")).where("top.m < n")
    rest = keep(placed.join(most.select("bucket", F.col("top.label").alias("most")), "bucket").select("bucket", "id", "label", "most"), "rest")
    held = ["bucket", "id", "label", "bands", "sketch"]
    signs = perhaps_in(nodes.select("id", "bands", "sketch"), rest.select("id").distinct())
    suspects = keep(_by_blocks(rest.join(signs, "id"), SKETCHES, held, _suspects(least), "bucket long, id long").distinct(), "suspects")
    if not suspects.isEmpty():
        doubtful = keep(suspects.select("id").distinct(), "doubtful_ids")
        signs = perhaps_in(nodes.select("id", "bands", "sketch"), doubtful)
        rest = rest.join(suspects, ["bucket", "id"], "left_semi").join(signs, "id").join(texts_of(doubtful), "id")
        found = _by_blocks(keep(rest, "doubtful"), BLOCK, [*held, "text"], _compared(width, threshold, least), "a long, b long")
        labels = components(keep(links.union(found), "links"), keep)

    classes = first.join(labels, "id", "left").select("same", F.coalesce("label", "id").alias("class_id"))
    out = keyed.where("same is not null").join(classes, "same", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    lone = keyed.where("same is null").select("id", F.col("id").alias("class_id"))
    if repeated:  # a null text goes with the other texts of its id
        lone = lone.alias("l").join(out.groupBy("id").agg(F.min("class_id").alias("c")), "id", "left").select("id", F.coalesce("c", "class_id").alias("class_id"))
    out = cut(out.union(lone).select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id")), "classes")
    scratch.clear()
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, that of the smallest id.

    Columns are unchanged, whatever their names. Rows with a null id stay; of rows that repeat an id, that with the
    smallest digest of its text stays, and of equal texts one.
    """
    classes = near_duplicates(docs, id_col, text_col, **how)
    rest = cut(classes.where(F.col(id_col) != F.col("class_id")).select(id_col).distinct(), "rest")
    kept = docs.join(rest, id_col, "left_anti").select(*docs.columns)
    if _repeats(docs, id_col):
        nth = free_name(docs, "_nth")
        order = Window.partitionBy(id_col).orderBy(F.md5(text_col).asc_nulls_last(), F.xxhash64(*docs.columns))
        named = kept.where(F.col(id_col).isNotNull()).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
        kept = named.drop(nth).unionByName(kept.where(F.col(id_col).isNull()))
    return kept
