"""Each registered query over a small table of awkward rows, and the operators against plain Python."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("seamline.llm")
import xxhash  # noqa: E402

import corpus_pipeline  # noqa: E402
from seamline.llm import ann, common, fingerprints, langid, minhash, mixing, packing, queries, sharding, tokencount, toxicity, warc  # noqa: E402

#: Names that an operator might use for columns of its own.
CLASH = ["_tokens", "_dim_source", "_toxicity", "_lang_pred", "_lang_score", "_identified", "_nth", "id", "score", "same", "place", "bucket"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
WORDS = {"en": ["the", "house", "river", "stone", "walk", "green", "apple", "north"], "de": ["der", "haus", "fluss", "stein", "gehen", "gruen", "apfel", "norden"]}


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), *["x"] * len(CLASH))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        words = rng.choices(WORDS[lang], k=rng.randint(20, 60)) + [f"w{rng.randint(0, 900)}" for _ in range(12)]
        out.append(row(i, " ".join(words + (["nastyword"] if i % 5 == 0 else [])), lang, f"s{i % 3}"))
    out += [row(200, None, None, None), row(201, ""), row(202, "!!! 12"), row(203, out[3][1]), row(204, out[4][1] + " tail"), row(205, " ".join(rng.choices(WORDS["en"], k=20_000)))]
    return [*out, out[7], out[7], row(8, "an id that comes twice with another text here"), row(None, "no id at all but a text"), row(None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(160)] + [(3, 1, 0), (3, 1, 0), (None, 1, 1), (4, None, None), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 8)).astype(np.float32).tolist()
    extra = [(50, v[3]), (120, None), (121, [0.0] * 8), (122, [float("nan")] * 8), (123, [1.0, 2.0]), (100, v[7]), (None, v[1])]
    spark.createDataFrame([*enumerate(v), *extra], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    pages = [(1, "u", "<a>"), (2, "u", "<a>"), (3, None, None), (4, "u", ""), (5, "u", "b" * 700_000), (2, "u", "<a>"), (2, "u", "other"), (None, "u", "<a>"), (6, "u", "x" * 10)]
    spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, sha1 string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def nothing(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("nothing"))
    for name in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at


SHAPES = {
    "op1_minhash": {"doc_id": "bigint", "class_id": "bigint"},
    "op2_mixing": {"doc_id": "bigint", "weight": "double", "probability": "double", "sampled": "boolean"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op5_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_tokencount": {"doc_id": "bigint", "n_words": "bigint", "n_tokens": "bigint"},
    "op7_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op11_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12_filters": {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")},
    "op13_infill": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op10_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
}


@pytest.mark.parametrize("name", list(SHAPES))
def test_queries_have_their_columns_and_take_empty_tables(spark, nothing, name):
    got = queries.QUERIES[name](spark, nothing)
    assert dict(got.dtypes) == SHAPES[name] and got.count() == 0


def fold(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


# --- 1


def test_near_duplicates_of_awkward_rows(spark, folder, docs, rows):
    got = [(r["doc_id"], r["class_id"]) for r in queries.op1_minhash(spark, folder).collect()]
    assert Counter(i for i, _ in got) == Counter(r[0] for r in rows)
    by = {}
    for i, c in got:
        by.setdefault(i, set()).add(c)
    assert all(len(c) == 1 for c in by.values())  # rows of one id share a class
    assert by[203] == by[3] == {3} and by[204] == by[4] == {4} and by[None] == {None} and by[201] == {201} and by[8] == {8}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = Counter(min(c) for i, c in by.items() if i is not None and i in c)
    assert Counter(r["doc_id"] for r in kept.collect()) == want + Counter({None: 2})
    eight = [r["text"] for r in kept.where("doc_id = 8").collect()]
    assert eight == [min((r[1] for r in rows if r[0] == 8), key=lambda x: hashlib.md5(x.encode()).hexdigest())]


def test_texts_of_one_id_link_their_classes(spark):
    one, two = "a b c d e f g h", "q r s t u v w x"
    df = spark.createDataFrame([(1, one), (1, two), (5, two), (6, one), (7, None), (1, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (7, 7)}


def test_bitmap_keeps_every_partner(spark):
    ids = spark.range(0, 4000, 7).select("id")
    kept = {r["id"] for r in common.perhaps_in(spark.range(4000), ids).collect()}
    assert set(range(0, 4000, 7)) <= kept and len(kept) < 1200
    assert common.perhaps_in(spark.range(10), ids, most_bits=64).count() == 10


def test_sketches_leave_out_no_pair_at_the_threshold():
    rng = np.random.default_rng(3)
    agree = rng.binomial(130, 0.8, 200_000) / 130
    assert (agree < minhash.least_agreement(0.8, 130)).mean() < 5e-5


# --- 2


def test_mixing_meets_its_marginals(spark, docs, rows):
    out = queries.mixed(docs)
    assert set(out.columns) == {*docs.columns, "mix_weight", "mix_probability", "mix_keep"}
    got = out.select(*docs.columns, "mix_probability").collect()
    assert all(r["_tokens"] == "x" and r["_dim_source"] == "x" for r in got) and len(got) == len(rows)
    words = lambda x: len((x or "").split())
    total = sum(words(r["text"]) for r in got)
    kept = Counter()
    for r in got:
        kept[r["source"] or "(none)"] += words(r["text"]) * r["mix_probability"]
    assert sum(kept.values()) <= queries.MIX_SHARE * total + 1e-6
    same = [r["mix_probability"] for r in got if r["doc_id"] == 7]
    assert len(set(same)) == 1


def test_raking_stops_at_its_tolerance_and_warns(spark):
    cells = spark.createDataFrame([("a", "x", 60), ("b", "y", 40)], "p string, q string, tokens long")
    want = {"p": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, target double"), "q": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "value string, target double")}
    with pytest.warns(UserWarning, match="marginals off"):
        mixing.rake(cells, want, most=6)
    both = {"p": want["p"], "q": spark.createDataFrame([("x", 3.0), ("y", 3.0)], "value string, target double")}
    assert [round(r["weight"], 9) for r in mixing.rake(cells, both).orderBy("p").collect()] == [0.5, 0.5]


def test_calibration_fills_cells_up_to_one(spark):
    cells = spark.createDataFrame([("a", 10, 0.6), ("b", 100, 0.3), ("c", 100, 0.1), ("d", 5, 0.0)], "p string, tokens long, weight double")
    got = {r["p"]: r["probability"] for r in mixing.calibrate(cells, 0.2).collect()}
    assert got["a"] == 1.0 and got["d"] == 0.0 and got["b"] / got["c"] == pytest.approx(3)
    assert 10 + 100 * got["b"] + 100 * got["c"] == pytest.approx(0.2 * 215)
    assert all(r["probability"] == (1.0 if r["weight"] else 0.0) for r in mixing.calibrate(cells, 1.0).collect())


# --- 3


def plain_score(model, text):
    words = toxicity.WORD.findall((text or "").lower())
    h = xxhash.xxh3_64_intdigest
    buckets = [(h(w) % toxicity.BUCKETS, h("4" + w[:4]) % toxicity.BUCKETS, h("5" + w[:5]) % toxicity.BUCKETS) for w in words]
    x = [sum(model.embed[model.rows[b]].astype(float) for b in own) for own in buckets] + [np.zeros(toxicity.DIM)] * 3
    z = model.constant
    for m, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            top = max(sum(float(x[p + k] @ model.filters[m][k, :, f]) for k in range(w)) for p in range(len(words) + 1))
            z += max(0.0, top + model.bias[m][f]) * model.out[m * toxicity.FILTERS + f]
    langs = np.sum([model.profile[model.rows[b[0]]] for b in buckets], axis=0) if buckets else np.zeros(len(model.thresholds))
    return 1 / (1 + math.exp(-(z - model.thresholds[int(np.argmax(langs))])))


def test_toxicity_is_the_plain_convolution(spark, folder, docs, rows):
    model = queries.toxicity_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = [r[1] for r in rows if r[1] is None or len(r[1]) < 5000]
    assert toxicity.scores(model, texts).tolist() == pytest.approx([plain_score(model, x) for x in texts], abs=1e-5)
    got = queries.op3_toxicity(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert r["held_out"] == (None if r["doc_id"] is None else fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 160]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.9
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r["_toxicity"] for r in kept.collect()} == {"x"}
    assert kept.count() == sum(r["score"] < 0.5 for r in got)


@pytest.mark.parametrize("toxic", [[], [0, 0, 0], [1, 1, 1]])
def test_toxicity_of_no_or_one_label(toxic):
    model = toxicity.fit(toxicity.key_lists(["a b", "c d", ""][: len(toxic)]), toxic, [None] * len(toxic))
    s = toxicity.scores(model, ["a b", None, "", "new words"])
    assert ((0 <= s) & (s <= 1)).all() and (len(toxic) and toxic[0] or (s < 0.5).all())


# --- 4


def spark_hash(*parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<d", p) if isinstance(p, float) else struct.pack("<q", p) if abs(p) > 2**31 else struct.pack("<i", p)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def plain_bids(text):
    for c in fingerprints.BREAKS:
        text = text.replace(c, " ")
    counts, share = Counter(w for w in text.split(" ") if w), lambda x, at: ((x >> at & (1 << 24) - 1) + 0.5) / (1 << 24)
    out = []
    for j in range(fingerprints.SAMPLES):
        best = None
        for word, n in counts.items():
            term = spark_hash(word)
            term = term - (1 << 64) if term >= 1 << 63 else term
            x, y = spark_hash(term, 2 * j), spark_hash(term, 2 * j + 1)
            r, ln_c = -math.log(share(x, 0) * share(x, 24)), math.log(-math.log(share(y, 0) * share(y, 24)))
            b = ((x >> 48) * 65536.0 + (y >> 48) + 0.5) / 2**32
            bid = ln_c - r * (1 - b) - (r * math.floor(math.log(n) / r + b) if n > 1 else 0)
            best = bid if best is None else min(best, bid)
        out.append("00000000" if best is None else f"{spark_hash(best):016x}"[8:])
    return "".join(out), counts


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_are_plain_consistent_sampling(spark, folder, rows):
    got = queries.op4_fingerprints(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] or "" for r in rows if r[0] not in (None, 8)}
    known = [r for r in got if r["doc_id"] in text and len(text[r["doc_id"]]) < 2000][:40]
    parts = lambda f: [f[8 * j : 8 * j + 8] for j in range(fingerprints.SAMPLES)]
    hits = [x == y for r in known for x, y in zip(parts(r["fingerprint"]), parts(plain_bids(text[r["doc_id"]])[0]), strict=True)]
    assert np.mean(hits) > 0.93  # a bid that differs in its last digit, as logarithms of two libraries do, hashes to other digits
    order = sorted({i for i in text if 100 < i < 160}, reverse=True)
    errors = []
    for i, j in zip(order, order[1:]):
        own, nxt = text[i], text[j]
        k = len(own) // 3
        edited, r = own[: len(own) - k] + nxt[:k], next(x for x in got if x["doc_id"] == i)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(own)
        a, b, c = (plain_bids(x)[1] for x in (own, edited, nxt))
        errors += [r["near_edited"] - jaccard(a, b), r["near_next"] - jaccard(a, c)]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12


def test_the_next_document_is_a_row(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "x y z"), (2, "m n")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_chars"]): r["near_next"] for r in fingerprints.edited_fingerprints(df).collect()}
    assert got == {(1, 7): 0.0, (1, 5): 0.0, (2, 3): 0.0}
    nulls = spark.createDataFrame([(None, f"t{k} u{k}") for k in range(40)] + [(5, "p q")], df.schema)
    assert fingerprints.edited_fingerprints(nulls).count() == 41


# --- 5


def test_neighbours_of_awkward_rows(spark, folder):
    got = {}
    for r in queries.op5_neighbours(spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100}
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] and len(r["embedding"]) == 8 and r["vec_id"] is not None]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    q = next(v for i, v in rows if i == 0)
    best = sorted(((-float((v * q).sum() / np.sqrt((v * v).sum()) / np.sqrt((q * q).sum())), i) for i, v in rows if i != 0))[:5]
    assert [i for _, i, _ in sorted(got[0])] == [i for _, i in best]
    assert len(got[50]) == 10 and len(got[100]) == 10  # ids with two vectors ask twice


def test_different_vectors_of_one_id_stay(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 3)) for r in got] == [(1, 0.995), (2, 0.707), (1, 0.0)]


def test_recall_on_clusters_over_many_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    v = centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 24))
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), cell=200, sample=1000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for i in range(0, 3000, 50):
        c = u @ u[i]
        c[i] = -9
        hits += len(set(np.argsort(-c)[:5].tolist()) & got[i])
    assert hits >= 0.95 * 5 * 60


# --- 6


def test_token_counts_take_any_text(spark, folder, rows):
    got = queries.op6_tokencount(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert next(r["n_words"] for r in got if r["doc_id"] == 205) == 20_000
    clash = spark.createDataFrame([("a b", 7)], "text string, n_words long")
    assert tokencount.count_tokens(clash, queries.tokenizer_path("piece_bpe_32k.model")).first()["n_words"] == 2


# --- 7


def plain_language(model, text):
    words = langid.LETTERS.findall((text or "").lower())
    if not any(c.isalpha() for w in words for c in w) or not model.langs:
        return "und", 0.0
    total = model.prior.copy()
    for w in words:
        if w in model.words:
            total += model.word_logs[model.words[w]]
            continue
        for n in range(model.longest, 0, -1):
            marked = f"<{w}>"
            own = [model.grams[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in model.grams]
            if own:
                total += np.mean([model.gram_logs[g] for g in own], axis=0)
                break
    p = np.exp(total - total.max())
    return model.langs[int(total.argmax())], float(p.max() / p.sum())


def test_language_is_the_plain_backoff(spark, folder, docs, rows):
    model = queries.language_model(docs)
    texts = [r[1] for r in rows] + ["gruenes hausboot", "riverstone walking", "ΩΩΩ"]
    langs, s = langid.predict(model, texts)
    want = [plain_language(model, x) for x in texts]
    assert langs == [x for x, _ in want] and s.tolist() == pytest.approx([x for _, x in want])
    learnt = docs.where(queries.fold(4) != 2).where("lang = 'de'")
    count = sum((r["text"] or "").lower().split().count("haus") for r in learnt.collect())
    total = sum(len(langid.LETTERS.findall((r["text"] or "").lower())) for r in learnt.collect())
    assert model.word_logs[model.words["haus"], model.langs.index("de")] == pytest.approx(math.log((count + 0.1) / (total + 0.1 * (len(model.words) + 1))), abs=0.02)
    got = queries.op7_langid(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert r["held_out"] == (None if r["doc_id"] is None else fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und")
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r["_lang_pred"] for r in kept.collect()} == {"x"} and kept.where("text is null").count() == 0


# --- 8


def test_shards_are_the_plain_order(spark, folder, docs, rows):
    bits = 5
    dims = [sharding.by_hash("lang", bits), sharding.by_hash("source", bits), sharding.by_quantile(docs, "n_chars", bits)]
    places = [(r["doc_id"], r["text"] or "", r["p"]) for r in docs.select("doc_id", "text", sharding.hilbert(dims, bits).alias("p")).collect()]
    key = lambda i: (i is not None, i or 0)  # noqa: E731  nulls first
    lead = {}
    for i, text, p in places:
        lead[text] = min(lead.get(text, (1 << 62, (True, 0))), (p, key(i)))
    order = sorted(places, key=lambda x: (*lead[x[1]], hashlib.md5(x[1].encode()).digest(), key(x[0])))
    got = queries.op8_sharding(spark, folder).collect()
    n, want = len(order), Counter()
    for rank, (i, text, _) in enumerate(order):
        shard = rank * 40 // n
        want[i, len(text.encode()) + 16, zlib.crc32(text.encode()), shard, rank - (shard * n + 39) // 40] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_a_filter_on_a_dimension_skips_shards(spark):
    rows = [(i, f"t{i}", f"l{i % 8}", "s", i) for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.shard(df, [sharding.by_hash("lang", 5), sharding.by_quantile(df, "n_chars", 5)], 5, 40).join(df.select("doc_id", "lang"), "doc_id")
    touched = [r["n"] for r in got.groupBy("lang").agg(F.countDistinct("shard").alias("n")).collect()]
    assert max(touched) <= 20


# --- 9 and 10


def test_packing_of_awkward_rows(spark, folder, rows):
    got = queries.op9_packing(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in rows)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 1024 and [o for o, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))])[:-1].tolist() for b in bins.values())
    assert [r["length"] for r in got if r["doc_id"] == 201] == [1]
    assert len(packing.tokenizer(queries.tokenizer_path("byte_bpe_50k.json")).encode("a", add_special_tokens=False).ids) == 1


def test_archives_of_awkward_rows(spark, folder):
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in queries.op10_warc(spark, folder).collect())
    assert got == Counter([(1, 3, "revisit", 2), (2, 3, "response", None), (2, 3, "response", None), (2, 5, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 700_000, "response", None), (None, 3, "response", None), (6, 10, "response", None)])
    digest = {r["page_id"]: r["payload_digest"] for r in queries.op10_warc(spark, folder).where("page_id = 6").collect()}
    assert digest[6] == base64.b32encode(hashlib.sha1(b"x" * 10).digest()).decode()
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    assert warc.archive(pages, least=4).where("record_type = 'revisit'").count() == 0
    planned = warc.plan(pages).where("refers_to is not null").collect()
    assert planned and all(r["html"] is None for r in planned)


# --- the pipeline


def test_pipeline_stages_are_what_plain_python_says(spark, folder, docs, rows):
    language, clean, dedup, mixture, packed = (f for _, f in corpus_pipeline.STAGES)
    first = language(spark, docs, folder)
    model = queries.language_model(docs)
    keep = lambda x: (lambda p: p[0] != "und" and p[1] >= 0.5)(plain_language(model, x))
    assert first.columns == docs.columns and Counter(r["doc_id"] for r in first.collect()) == Counter(r[0] for r in rows if keep(r[1]))
    second, tox = clean(spark, first, folder), queries.toxicity_model(first, spark.read.parquet(f"{folder}/labels.parquet"))
    want = Counter(r["doc_id"] for r in first.collect() if toxicity.scores(tox, [r["text"]])[0] < 0.5)
    assert Counter(r["doc_id"] for r in second.collect()) == want
    third = dedup(spark, second, folder)
    left = {r["doc_id"] for r in third.collect()}
    assert not {203} <= left or 3 not in {r["doc_id"] for r in second.collect()}
    assert len([i for i in left if i is not None]) == third.where("doc_id is not null").count()
    fourth = mixture(spark, third, folder)
    assert fourth.columns == docs.columns and {r["doc_id"] for r in fourth.collect()} <= left
    last = packed(spark, fourth, folder)
    assert Counter(r["doc_id"] for r in last.where("piece = 0").collect()) == Counter(r["doc_id"] for r in fourth.collect())


def test_scratch_folders_go(spark, docs):
    import os

    at = f"{common.shared_dir(spark)}/seamline"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    out = minhash.near_duplicates(docs)
    assert len(set(os.listdir(at)) - before) == 1 and out.count() > 0  # the result alone is left
