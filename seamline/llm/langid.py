"""Language identification: known words first, shorter and shorter character n-grams for the rest.

The model holds, for the words of a bounded sample of documents, their log
frequency in each language, and the same for the character n-grams of those
words. A known word adds its own log frequencies. An unseen word adds the mean
of its known n-grams of the longest order that has any, from five characters down to one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, Scratch, bounded_batches, free_name, sampled, spans

LETTERS = re.compile(r"[^\W\d_]+")
SMOOTH = 0.1


@dataclass
class Model:
    langs: list[str]
    vocabulary: pa.Array
    word_logs: np.ndarray
    parts: pa.Array  # character n-grams
    gram_logs: np.ndarray
    prior: np.ndarray
    longest: int

    @cached_property
    def words(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.vocabulary.to_pylist())}

    @cached_property
    def grams(self) -> dict[str, int]:
        return {g: i for i, g in enumerate(self.parts.to_pylist())}

    def __getstate__(self) -> dict:
        """Without the dictionaries: each worker makes its own, and a driver that only trains makes none."""
        return {f.name: getattr(self, f.name) for f in fields(self)}


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * (len(counts) + 1)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 2_500, longest: int = 5) -> Model:
    """Learn from about ``max_docs`` documents (a hash of the id picks them), all of their words.

    Rows with a null language or text teach nothing; without any row the model knows no language.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    known = sampled(known, F.col("id"), max_docs)
    words = known.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("key")).where("key <> ''")
    scratch = Scratch(docs.sparkSession)
    # as many as the sampled documents have
    words = scratch.cut(words.groupBy("lang", "key").count(), "words")
    within = f"transform(sequence(1, least({longest}, char_length(key))), n -> transform(sequence(1, char_length(key) - n + 1), i -> substring(key, i, n)))"
    grams = words.withColumn("key", F.concat(F.lit("<"), "key", F.lit(">"))).select("lang", F.expr(f"explode(flatten({within}))").alias("key"), "count")
    prior = dict(known.groupBy("lang").count().collect())
    langs = sorted(prior)
    vocabulary, word_counts = _counted(words, langs)
    parts, gram_logs = _counted(grams.groupBy("lang", "key").agg(F.sum("count").alias("count")), langs)
    scratch.clear()
    orders = pc.utf8_length(parts).to_numpy(zero_copy_only=False)
    for n in np.unique(orders):
        gram_logs[orders == n] = _logs(gram_logs[orders == n])
    share = np.array([prior[x] for x in langs], float)
    return Model(langs, vocabulary, _logs(word_counts), parts, gram_logs, np.log(share / max(1.0, share.sum())), longest)


def _counted(rows: DataFrame, langs: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The distinct keys of ``rows(lang, key, count)``, in any order, and their counts by language."""
    got = rows.select("lang", "key", "count").toArrow()
    keys = got["key"].combine_chunks().dictionary_encode()
    counts = np.zeros((len(keys.dictionary), len(langs)))
    counts[keys.indices.to_numpy(), pc.index_in(got["lang"], value_set=pa.array(langs, got["lang"].type)).to_numpy()] = got["count"].to_numpy()
    return keys.dictionary, counts


def _grams(word: str, orders) -> Iterator[str]:
    word = f"<{word}>"
    for n in orders:
        for i in range(len(word) - n + 1):
            yield word[i : i + n]


def word_scores(model: Model, words: list[str]) -> list[np.ndarray]:
    out = []
    for w in words:
        if (i := model.words.get(w)) is not None:
            out.append(model.word_logs[i])
            continue
        for n in range(model.longest, 0, -1):
            if found := [model.grams[g] for g in _grams(w, (n,)) if g in model.grams]:
                out.append(model.gram_logs[found].mean(axis=0))
                break
        else:
            out.append(np.zeros(len(model.langs)))
    return out


def predict(model: Model, texts: list[str | None], cache: Bounded | None = None) -> tuple[list[str], np.ndarray]:
    """Language and its posterior share for each text; ``und`` and 0 where there is no letter or no language is known."""
    cache = Bounded(50_000) if cache is None else cache
    split = [LETTERS.findall(x.lower()) if x else [] for x in texts]
    vocabulary = list(set().union(*split))
    known = np.fromiter((model.words.get(w, -1) for w in vocabulary), np.int64, len(vocabulary))
    fresh = [vocabulary[i] for i in np.flatnonzero(known < 0)]
    cache.need(fresh, lambda new: word_scores(model, new))
    logs = np.zeros((len(vocabulary), len(model.langs)))
    logs[known >= 0] = model.word_logs[known[known >= 0]]
    if fresh:
        logs[known < 0] = [cache[w] for w in fresh]
    at = {w: i for i, w in enumerate(vocabulary)}
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    for i, words in enumerate(split):
        if not model.langs or not any(c.isalpha() for w in words for c in w):
            continue
        total = model.prior + logs[np.fromiter(map(at.__getitem__, words), np.int64, len(words))].sum(axis=0)
        best = int(np.argmax(total))
        langs[i] = model.langs[best]
        scores[i] = 1 / np.exp(total - total[best]).sum()
    return langs, scores


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with a predicted language and its score (0 to 1) from the whole text of each row.

    A null text, or one without a letter, is ``und`` with score 0. Repeated rows get equal
    results. The two columns replace any of the same name; all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = Bounded(50_000)
        for texts in batches:
            parts = [predict(shared.value, texts[i:j].to_pylist(), cache) for i, j in spans(texts)]
            langs, scores = pa.array([x for p in parts for x in p[0]], pa.string()), np.concatenate([p[1] for p in parts] or [np.zeros(0)])
            yield pa.StructArray.from_arrays([langs, pa.array(scores, pa.float64())], ["lang", "score"])

    got = free_name(docs, "_identified")
    out = bounded_batches(docs).withColumn(got, told(F.col(text_col)))
    return out.withColumns({lang_out: F.col(f"{got}.lang"), score_out: F.col(f"{got}.score")}).drop(got)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Drop the rows whose text has no language (``und``) or one below ``least``; columns stay as they are, whatever their names."""
    lang, score = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    told = identify(docs, model, text_col, lang, score)
    return told.where((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)
