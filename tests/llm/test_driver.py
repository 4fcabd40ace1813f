"""What the driver holds while the pipeline's models are fitted."""

import pickle
import tracemalloc

import numpy as np
import pytest

from seamline.llm import langid, mixing, toxicity


def peak_mb(run):
    tracemalloc.start()
    try:
        got = run()
        return got, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(5))


def test_language_training_leaves_words_and_grams_in_arrow(spark):
    """20,000 words and their n-grams, counted by Spark; a worker's copy makes the dictionaries."""
    texts = [" ".join(word(7919 * (i + 100 * k)) for i in range(100)) for k in range(200)]
    df = spark.createDataFrame([(k, x, "ab"[k % 2]) for k, x in enumerate(texts)], "doc_id long, text string, lang string")
    model, mb = peak_mb(lambda: langid.train(df))
    assert mb < 10 and not {"words", "grams"} & set(vars(model))
    own = pickle.loads(pickle.dumps(model))
    assert len(own.words) == len({w for x in texts for w in x.split()}) and "words" not in model.__getstate__()
    want: dict[tuple[str, str], int] = {}
    for k, x in enumerate(texts):
        for w in x.split():
            for g in langid._grams(w, range(1, 6)):
                want[g, "ab"[k % 2]] = want.get((g, "ab"[k % 2]), 0) + 1
    grams = {g for g, _ in want}
    assert set(own.grams) == grams
    for n in range(1, 6):
        some = sorted(g for g in grams if len(g) == n)
        counts = np.array([[want.get((g, c), 0) for c in "ab"] for g in some], float)
        assert own.gram_logs[[own.grams[g] for g in some]] == pytest.approx(langid._logs(counts), abs=1e-12)


def test_toxicity_training_collects_keys_once(spark, monkeypatch):
    """2000 texts of 1000 words are 16 MB of keys, which Python holds once: in the batches that came."""
    df = spark.range(2000).selectExpr("2000 - id as doc_id", "array_join(transform(sequence(1, 1000), k -> concat('w', k * (id + 1) % 977)), ' ') as text", "'en' as lang")
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    monkeypatch.setattr(toxicity, "fit", lambda *got: got)
    (keys, y, langs), mb = peak_mb(lambda: toxicity.train(df, labels))
    assert mb < 18 and len(keys) == 2000 and {len(x) for x in keys} == {1000} and set(langs) == {"en"}
    assert y == [i % 2 for i in range(1, 2001)]  # in the order of ids
    text = df.where("doc_id = 3").first()["text"]
    assert keys[2].tolist() == toxicity.key_lists([text])[0].tolist()


def test_few_cells_are_raked_where_they_lie(spark, monkeypatch):
    cells = spark.createDataFrame([(p, q, (i * 37 + j * 11) % 50 + 1) for i, p in enumerate("abc") for j, q in enumerate("xyz")], "p string, q string, tokens long")
    want = {d: mixing.tempered(cells, d, 0.5) for d in ("p", "q")}
    plans, cut = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, tag))

    def raked(**how):
        plans.clear()
        got = {(r["p"], r["q"]): r["weight"] for r in mixing.rake(cells, want, **how).collect()}
        return got, sum(x.count("Exchange hashpartitioning") for x in plans if "Window" in x)

    (near, none), (dealt, some) = raked(), raked(few=0)
    assert none == 0 and some > 0 and near == pytest.approx(dealt, abs=1e-12)
