"""A convolutional toxicity classifier, trained in numpy and applied by Spark.

A word is the sum of three hashed embeddings: itself and its first four and five
characters. Filters of widths 1, 2 and 3 slide over the words, the largest
response of each filter anywhere in the text passes a ReLU, and a logistic unit
adds them up. Each language guessed from the text itself has its own threshold,
moved to a score of one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Bounded, blocks, bounded_batches, free_name, sampled, spans

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 20, 8, 8, (1, 2, 3)
PAD = max(WIDTHS) - 1


@dataclass
class Model:
    rows: np.ndarray  # of each bucket: its row of ``embed`` and ``profile``, 0 for the ones never seen
    embed: np.ndarray
    filters: list[np.ndarray]  # width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    constant: float
    profile: np.ndarray  # log frequency of a whole word's bucket in each language
    thresholds: np.ndarray  # of the logit, by language


def word_keys(words: list[str]) -> list[int]:
    """The three buckets of each word in one integer, 20 bits a bucket."""
    h = xxhash.xxh3_64_intdigest
    return [h(w) % BUCKETS | h("4" + w[:4]) % BUCKETS << 20 | h("5" + w[:5]) % BUCKETS << 40 for w in words]


def _unpacked(keys: np.ndarray) -> np.ndarray:
    return np.stack([keys & BUCKETS - 1, keys >> 20 & BUCKETS - 1, keys >> 40], axis=1)


def key_lists(texts: list[str | None], cache: Bounded | None = None) -> list[np.ndarray]:
    """The words of each text as keys; all that the classifier ever sees of it."""
    cache = Bounded() if cache is None else cache
    split = [WORD.findall(x.lower()) if x else [] for x in texts]
    cache.need(set().union(*split), word_keys)
    return [np.fromiter(map(cache.__getitem__, s), np.int64, len(s)) for s in split]


def fit(texts: list[np.ndarray], toxic: list[int], langs: list[str], epochs: int = 6, rate: float = 0.05, seed: int = 7) -> Model:
    """Train on texts given as ``key_lists``; every fifth one is set aside for the thresholds.

    Without any text, or any of one label, the model is still whole: it then scores all texts near that which it saw,
    and low if it saw none.
    """
    rng = np.random.default_rng(seed)
    vocabulary = np.zeros(0, np.int64)
    for i, j in blocks(texts, 250_000):
        vocabulary = np.union1d(vocabulary, np.concatenate(texts[i:j]))
    buckets = _unpacked(vocabulary)
    seen = np.unique(buckets)
    rows = np.zeros(BUCKETS, np.int32)
    rows[seen] = np.arange(1, len(seen) + 1)
    feats = rows[buckets]
    docs = [np.searchsorted(vocabulary, x).astype(np.int32) for x in texts]
    del texts  # the numbers of the words tell them, in half the space
    y = np.array(toxic, float)
    order = rng.permutation(len(docs))
    hold, learn = order[::5], np.array([i for k, i in enumerate(order) if k % 5 or len(order) < 10], int)

    names = sorted({x for x in langs if x is not None}) or [""]
    lang_of = np.array([names.index(x) if x in names else -1 for x in langs], int)
    has, per_lang = np.zeros((2, len(seen) + 1)), np.zeros((len(seen) + 1, len(names)))
    for i in learn:
        has[int(y[i]), np.unique(feats[docs[i]])] += 1
        if lang_of[i] >= 0:
            np.add.at(per_lang[:, lang_of[i]], feats[docs[i], 0], 1)
    profile = np.log((per_lang + 0.1) / (per_lang.sum(axis=0) + 0.1 * len(per_lang)))
    profile[0] = profile.min(axis=0).mean()

    n = np.maximum(1, np.array([(y[learn] == k).sum() for k in (0, 1)]))
    odds = np.log((has[1] + 0.5) / (n[1] + 1)) - np.log((has[0] + 0.5) / (n[0] + 1))
    odds *= (has.sum(axis=0)) / (has.sum(axis=0) + 3)
    embed = rng.normal(0, 0.02, (len(seen) + 1, DIM)).astype(np.float32)
    embed[:, 0] = np.clip(odds, -1, 6) / 6
    embed[0] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, :] = np.abs(f[0, 0, :]) + 0.5
    bias = [np.full(FILTERS, -0.3, np.float32) for _ in WIDTHS]
    out, constant = np.full(len(WIDTHS) * FILTERS, 0.5, np.float32), -3.0
    params = [embed, *filters, *bias, out]
    past = [np.full(p.shape, 1e-2, np.float32) for p in params]

    def step(k: int, grad: np.ndarray, where=slice(None)) -> None:
        past[k][where] += grad**2
        params[k][where] -= rate * grad / np.sqrt(past[k][where])

    past_c = 1e-2
    weight = np.where(y > 0, 0.5 / n[1], 0.5 / n[0]) * n.sum()
    for _ in range(epochs):
        for i in rng.permutation(learn):
            f = np.vstack([feats[docs[i]], np.zeros((PAD + 1, 3), int)])
            x = embed[f].sum(axis=1)
            length = len(docs[i]) + 1
            tops, places = [], []
            for w, fl, b in zip(WIDTHS, filters, bias, strict=True):
                r = sum(x[k : k + length] @ fl[k] for k in range(w))
                places.append(r.argmax(axis=0))
                tops.append(r.max(axis=0) + b)
            h = np.concatenate(tops)
            z = float(np.maximum(h, 0) @ out + constant)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i]
            if abs(d) < 1e-3:
                continue
            dh = (d * out * (h > 0)).astype(np.float32)
            for m, w in enumerate(WIDTHS):
                g = dh[m * FILTERS : (m + 1) * FILTERS]
                if not g.any():
                    continue
                for k in range(w):
                    at_k = places[m] + k
                    dx = (filters[m][k] * g).T
                    step(1 + m, x[at_k].T * g, k)
                    rows_k = f[at_k]
                    for c in range(3):
                        u, back = np.unique(rows_k[:, c], return_inverse=True)
                        acc = np.zeros((len(u), DIM), np.float32)
                        np.add.at(acc, back, dx)
                        acc[u == 0] = 0
                        step(0, acc, u)
                step(1 + len(WIDTHS) + m, g)
            step(len(params) - 1, (d * np.maximum(h, 0)).astype(np.float32))
            past_c += d * d
            constant -= rate * d / np.sqrt(past_c)

    model = Model(rows, embed, filters, bias, out, constant, profile.astype(np.float32), np.zeros(len(names), np.float32))
    z, guess = [np.zeros(0)], [np.zeros(0, int)]
    for i, j in blocks([docs[k] for k in hold], 250_000):
        for own, part in zip((z, guess), logits(model, [vocabulary[docs[k]] for k in hold[i:j]]), strict=True):
            own.append(part)
    z, guess = np.concatenate(z), np.concatenate(guess)
    for k in range(len(names)):
        own = guess == k
        model.thresholds[k] = _threshold(z[own], y[hold][own], weight[hold][own])
    return model


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap with the best balanced accuracy, shrunk to zero where there is little to learn from."""
    if y.sum() < 5 or (1 - y).sum() < 5:
        return 0.0
    order = np.argsort(z)
    z, y, weight = z[order], y[order], weight[order]
    right = np.cumsum(np.where(y == 0, weight, 0))[:-1] + np.cumsum(np.where(y == 1, weight, 0)[::-1])[::-1][1:]
    best = np.flatnonzero(right >= right.max() - 1e-9)
    cuts = (z[best] + z[best + 1]) / 2
    return float(cuts[np.argmin(np.abs(cuts))])


def logits(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Logit and guessed language number of each text, given as ``key_lists``."""
    if not texts:
        return np.zeros(0), np.zeros(0, int)
    vocabulary, at = np.unique(np.concatenate(texts), return_inverse=True)
    feats = np.vstack([np.zeros((1, 3), int), model.rows[_unpacked(vocabulary)]])
    x, profile = model.embed[feats].sum(axis=1), model.profile[feats[:, 0]]
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1 + PAD)[:-1]]).astype(int)
    ids = np.zeros(int((sizes + 1 + PAD).sum()) + PAD, np.int32)
    ids[np.arange(len(at)) + np.repeat(np.arange(len(texts)) * (1 + PAD), sizes)] = at + 1
    total, h = len(ids) - PAD, []
    for w, f, b in zip(WIDTHS, model.filters, model.bias, strict=True):
        r = (x @ f[0])[ids[:total]]
        for k in range(1, w):
            r += (x @ f[k])[ids[k : total + k]]
        h.append(np.maximum.reduceat(r, starts, axis=0) + b)
    profile[0] = 0
    guess = np.add.reduceat(profile[ids[:total]].astype(float), starts, axis=0).argmax(axis=1)
    return np.maximum(np.hstack(h), 0) @ model.out + model.constant, guess


def scores(model: Model, texts: list[str | None], cache: Bounded | None = None) -> np.ndarray:
    """Between 0 and 1, half at the threshold of the language that the words suggest."""
    z, guess = logits(model, key_lists(texts, cache))
    return 1 / (1 + np.exp(-np.clip(z - model.thresholds[guess], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", max_docs: int = 6_000) -> Model:
    """Fit on about ``max_docs`` labelled documents, up to half of them toxic; a hash of the id picks them.

    Ids, labels and texts that are null teach nothing; an id whose labels differ counts as toxic. ``lang_col``
    only groups the rows for the language guess and the thresholds. The executors turn the texts into word keys, eight
    bytes a word, and these are what the driver collects.
    """
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    picked = None
    for k in (1, 0):
        part = sampled(given.where(F.col("y") == k), F.col("id"), max_docs // 2)
        picked = part if picked is None else picked.union(part)
    texts = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(keys=[x.tobytes() for x in key_lists(pdf["text"].tolist())])

    # at most about max_docs ids, whatever the size of the tables
    own = texts.join(F.broadcast(picked), "id").select("id", "y", "lang", "text")
    return fit(*_collected(own.mapInPandas(keyed, f"id {docs.schema[id_col].dataType.simpleString()}, y int, lang string, keys binary")))


def _collected(rows: DataFrame) -> tuple[list[np.ndarray], list[int], list[str]]:
    """Keys, label and language of ``rows(id, y, lang, keys)`` in the order of id and keys, whatever order they come in.

    They come as Arrow batches, whose memory the keys share: as rows, JVM and Python would hold several copies of them.
    """
    got = rows.toArrow()
    order = pc.sort_indices(got, [("id", "ascending"), ("keys", "ascending")])
    keys = [np.frombuffer(x.as_buffer(), np.int64) for chunk in got["keys"].chunks for x in chunk]
    return [keys[i] for i in order.to_pylist()], got["y"].take(order).to_pylist(), got["lang"].take(order).to_pylist()


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text, 0 to 1. Null and empty texts score as no words; ``out`` replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = Bounded(100_000)
        for texts in batches:
            yield pa.array(np.concatenate([scores(shared.value, texts[i:j].to_pylist(), cache) for i, j in spans(texts)] or [np.zeros(0)]), pa.float64())

    return bounded_batches(docs).withColumn(out, told(F.col(text_col)))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Drop the rows that score ``least`` or more; columns stay as they are, whatever their names."""
    own = free_name(docs, "_toxicity")
    return score(docs, model, text_col, own).where(F.col(own) < least).select(*docs.columns)
