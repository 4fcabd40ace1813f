import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("seamline.llm")
from seamline.llm import ann, common, fingerprints, langid, minhash, mixing, packing, queries, sharding, tokencount, toxicity, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, stretch int"


def docs(spark, texts):
    return spark.createDataFrame([(i, x, "en", "s", None if x is None else len(x), "clash", 0) for i, x in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]


@pytest.fixture(scope="module")
def odd(words):
    rng = random.Random(6)
    base = [" ".join(rng.choices(words, k=rng.randint(30, 90))) for _ in range(30)]
    near = [x + " tail" for x in base[:6]]
    return [*base, *near, base[0], base[0], None, None, "", "", "!!!", "one", "one", " ".join(rng.choices(words, k=30_000)), "b\x00a", "  two  spaces\n\n x "]


def test_minhash_matches_brute_force(spark, odd):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, odd)).collect()}
    parent = list(range(len(odd)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = []
    for x in odd:
        w = minhash.WORD.findall(x.lower()) if x else []
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    for a in range(len(odd)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if (odd[a] is not None and odd[a] == odd[b]) or (both and both / sum((bags[a] | bags[b]).values()) >= 0.8):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(odd))}
    assert minhash.keep_one(docs(spark, odd)).count() == len(set(got.values()))
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_shingles_of_many_texts_are_made_together(monkeypatch):
    rng = random.Random(8)
    signs = [*"aB_1²ª.'-\n\x1c\x85\xa0éÉ×ÿĀ中İſΣ", " ", " ", " a", "e\u0301", "\U0001f600", "\U0001d49c", "\U00010400"]
    texts = ["", None, "...", *("".join(rng.choices(signs, k=rng.randint(0, rng.choice([3, 60])))) for _ in range(400)), None, ""]
    want = []
    for i, x in enumerate(texts):
        words = common.WORD.findall(x.lower()) if x else []
        w, own = min(5, len(words)), np.array(common.word_hashes(words), np.uint64)
        bag = Counter()
        for at in range(len(words) - w + 1 if words else 0):
            h = np.array([w], np.uint64)
            for k in range(w):
                h = common.mix(h * minhash._GOLD + own[at + k])
            bag[int(h[0])] += 1
        want += [(i, h, n) for h, n in sorted(bag.items())]
    calls, mix = [], minhash.mix
    monkeypatch.setattr(minhash, "mix", lambda x: calls.append(len(x)) or mix(x))
    assert list(zip(*(x.tolist() for x in minhash.shingle_bags(texts)), strict=True)) == want
    assert len(calls) == 5  # a pass over all texts for each word of a shingle


def test_minhash_keeps_links_beyond_the_pivot(spark, words):
    rng = random.Random(1)
    base = rng.choices(words, k=200)
    texts = []
    for k in range(60):
        x = list(base)
        for i in rng.sample(range(200), k % 12):
            x[i] = rng.choice(words)
        texts.append(" ".join(x))
    owner, item, count = minhash.shingle_bags(texts)
    bag = [(item[owner == i], count[owner == i]) for i in range(60)]
    links = [(a, b) for a in range(60) for b in range(a) if minhash.similarity(bag[a], bag[b]) >= 0.8]
    group = {i: i for i in range(60)}
    for _ in range(60):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == group


def test_bag_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    items = rng.integers(1, 2**62, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    sig = minhash.bag_signatures(np.repeat([0, 1], 300), np.concatenate([items, items]), np.concatenate([a, b]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_bag_signatures_do_not_depend_on_the_batch(words):
    rng = random.Random(3)
    short = [" ".join(rng.choices(words, k=k)) for k in (1, 5, 6, 14, 30, 60)] + ["again " * 40, ""]
    alone = np.concatenate([minhash.signatures([x], 130) for x in short])
    batch = [" ".join(rng.choices(words, k=400)) for _ in range(300)]
    assert (minhash.signatures(short + batch, 130)[: len(short)] == alone).all()
    assert (minhash.signatures(batch[:9] + short, 130)[9:] == alone).all()


def test_mixing_rakes_to_targets(spark):
    rows = [(i, "x" * 10, ["en", "fr", None][i % 3], f"s{i % 4}", 10, "", 0) for i in range(240)]
    df = spark.createDataFrame(rows, DOCS)
    even = {"source": 0.0, "lang": 1.0}
    out = mixing.mix(df, {"source": F.col("source"), "lang": F.col("lang")}, F.col("n_chars"), even, 0.5, F.col("doc_id"))
    got = out.collect()
    assert len(got) == 240 and all(abs(r["mix_probability"] - 0.5) < 1e-6 for r in got)
    assert 70 < sum(r["mix_keep"] for r in got) < 170
    assert mixing.mix(df.limit(0), {"source": F.col("source")}, F.col("n_chars"), {"source": 1.0}, 0.5, F.col("doc_id")).count() == 0
    cells = spark.createDataFrame([("a", "x", 60), ("a", "y", 40), ("b", "x", 20), ("b", "y", 80)], "p string, q string, tokens long")
    want = {"p": spark.createDataFrame([("a", 0.7), ("b", 0.3)], "value string, target double"), "q": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "value string, target double")}
    raked = {(r["p"], r["q"]): r["weight"] for r in mixing.rake(cells, want).collect()}
    assert abs(raked["a", "x"] + raked["a", "y"] - 0.7) < 1e-3 and abs(raked["a", "x"] + raked["b", "x"] - 0.5) < 1e-6


def test_toxicity_learns_and_scores_anything(spark, words):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(words, k=60) + (["nastyword"] if i % 4 == 0 else [])) for i in range(400)]
    model = toxicity.fit(toxicity.key_lists(texts), [int(i % 4 == 0) for i in range(400)], ["en"] * 400)
    fresh = [" ".join(rng.choices(words, k=80)) for _ in range(40)]
    s = toxicity.scores(model, [*fresh, *(x + " nastyword ok" for x in fresh), None, "", "!"])
    assert ((s[:40] < 0.5).mean() > 0.9) and ((s[40:80] >= 0.5).mean() > 0.9) and s[-3] == s[-2] == s[-1]
    got = toxicity.score(docs(spark, [*fresh[:3], None, ""]), model).collect()
    assert [r["score"] for r in got[:3]] == pytest.approx(list(s[:3])) and got[0]["id"] == "clash"
    assert toxicity.keep_clean(docs(spark, [fresh[0], fresh[0] + " nastyword"]), model).count() == 1


def test_fingerprints_match_their_meaning(spark, odd):
    texts = [x for x in odd if x is None or len(x) < 5000]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs(spark, texts)).collect()}
    order = sorted(got, reverse=True)
    assert len(got) == len(texts)
    import hashlib

    for at, i in enumerate(order):
        own, nxt = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        k = len(own) // 3
        edited = own[: len(own) - k] + nxt[:k]
        assert got[i]["n_chars"] == len(own) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for j, x in enumerate(texts):
            if (x or "") == own:
                assert got[j]["fingerprint"] == got[i]["fingerprint"]
            if (x or "") == edited:
                assert got[j]["fingerprint"] == got[i]["edited_fingerprint"]
        f, g = got[i]["fingerprint"], got[order[(at + 1) % len(order)]]["fingerprint"]
        assert got[i]["near_next"] == np.mean([f[8 * s : 8 * s + 8] == g[8 * s : 8 * s + 8] for s in range(fingerprints.SAMPLES)])
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0


def test_neighbours_have_the_recall_and_the_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[100:180] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), cell=100, asked=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    x = v.astype(float)
    hits = 0
    for q, near in got.items():
        s = (x * x[q]).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (x[q] ** 2).sum())
        s[q] = -9
        best = sorted(range(600), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len({i for i, _ in near.values()} & set(best))
        assert all(abs(score - s[i]) < 1e-12 for i, score in near.values())
    assert set(got) == set(range(0, 600, 50)) and hits >= 0.9 * 5 * len(got)
    assert [got[50][k][0] for k in range(1, 6)] == [100, 101, 102, 103, 104]


def test_token_counts_match_plain_programming(spark, odd):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    scores, longest, byte = tokencount.vocabulary(path)

    def plain(w):
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            size = len(w[i - 1].encode())
            top = (best[i - 1][0] + size * byte, best[i - 1][1] + size)
            for j in range(max(0, i - longest), i):
                if (s := scores.get(w[j:i])) is not None and best[j][0] + s > top[0]:
                    top = (best[j][0] + s, best[j][1] + 1)
            best.append(top)
        return best[-1][1]

    texts = [x for x in odd if x is None or len(x) < 5000] + ["漢字 Ω☃"]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokencount.count_tokens(docs(spark, texts), path).collect()}
    assert got == {i: (len((x or "").split()), sum(plain("▁" + w) for w in (x or "").split())) for i, x in enumerate(texts)}


def test_language_backs_off_from_words(spark):
    rng = random.Random(3)
    parts = {"aa": ["ba", "do", "ki"], "bb": ["xu", "zo", "wy"]}
    text = lambda lang: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(20))
    rows = [(i, text(x), x, "s", 0, "", 0) for i, x in enumerate(["aa", "bb"] * 100)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df)
    langs, s = langid.predict(model, [text("aa"), "xuxuxuxuxu", None, "12 34", "", "ΩΩΩ"])
    assert langs[:5] == ["aa", "bb", "und", "und", "und"] and all(0 <= x <= 1 for x in s)
    assert langid.keep_identified(df.limit(3).union(docs(spark, ["12"])), model).count() == 3
    assert langid.predict(langid.train(df.limit(0)), ["abc"])[0] == ["und"]


def test_hilbert_curve_steps_by_one(spark):
    cells = [(a, b, c) for a in range(8) for b in range(8) for c in range(8)]
    df = spark.createDataFrame(cells, "a int, b int, c int").withColumn("h", sharding.hilbert([F.col(x) for x in "abc"], 3))
    path = [(r["a"], r["b"], r["c"]) for r in df.orderBy("h").collect()]
    assert sorted(r["h"] for r in df.collect()) == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_shards_are_even_and_gapless(spark, odd):
    df = docs(spark, odd)
    got = sharding.shard(df, [sharding.by_hash("lang", 3), sharding.by_quantile(df, "n_chars", 3)], 3, 7).collect()
    by = Counter(r["shard"] for r in got)
    assert max(by.values()) - min(by.values()) <= 1 and len(got) == len(odd)
    for k in by:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(by[k]))
    assert all(r["size"] == len((odd[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((odd[r["doc_id"]] or "").encode()) for r in got)


def test_packing_tokens_and_bins(spark, odd):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    t = packing.tokenizer(path)
    rng = random.Random(9)
    noise = ["".join(rng.choices("ab .,'s!\n\t  \xa0éß1", k=rng.randint(0, 60))) for _ in range(300)] + [x or "" for x in odd] + ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n\n<|endoftext|> y", "<|endoftext"]
    for x, ids in zip(noise, packing.encode(path, noise), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    plain = [x for x in odd if x and not packing._ODD.search(x)]
    for x, ids in zip(plain, packing.encode(path, plain), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    got = packing.pack(packing.pieces(docs(spark, odd), path)).collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(odd)}
    bins = {}
    for r in got:
        own = ids[r["id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] <= 1024 and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert Counter({i: len(x) for i, x in ids.items()}) == Counter({i: sum(r["length"] for r in got if r["id"] == i) for i in ids})
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


def test_a_word_is_merged_once_whatever_stands_behind_it(monkeypatch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    t, merged = packing.tokenizer(path), []

    class Counted:
        model = type("Model", (), {"tokenize": staticmethod(lambda w: merged.append(w) or t.model.tokenize(w))})
        encode_batch_fast = staticmethod(t.encode_batch_fast)

    packing.added(path)
    monkeypatch.setattr(packing, "tokenizer", lambda _: Counted)
    for x in ("a zzqword, zzqword. zzqword%%% zzqword\n(zzqword) zzqword's zzqword7", "a élanzzq, élanzzq;\télanzzq  élanzzq"):
        assert np.frombuffer(packing.encode(path, [x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert Counter(w for w in merged if "zzqword" in w) == {"\u0120zzqword": 1} and sum("lanzzq" in w for w in merged) == 2


def test_parts_of_any_signs_are_those_of_the_library():
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rng = random.Random(12)
    signs = [*"ab1.,'%-\n\t\r\x0b\x1c\x85\xa0éÿ×÷ªß²中\u0301\u2003\u3000", " ", "  ", " Th", "'s", "\U0001f600", "<|endoftext|>"]
    texts = ["", *("".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(3000)), "", ""]
    want = packing.tokenizer(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(path, texts)] == [x.ids for x in want]


def test_best_fit_is_close_to_the_bound():
    rng = random.Random(4)
    sizes = [rng.randint(1, 1024) for _ in range(20_000)]
    fit = packing.BestFit(1024, 1024, 0)
    used = {fit.put(n)[0] for n in sizes}
    assert len(used) <= 1.03 * math.ceil(sum(sizes) / 1024)


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(["a" * 9, "b", "a" * 9, None, "", "é" * 400_000, "a" * 9])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive(pages).collect()}
    assert {i: r["record_type"] for i, r in got.items()} == {0: "revisit", 1: "response", 2: "revisit", 3: "revisit", 4: "response", 5: "response", 6: "response"}
    assert got[0]["refers_to"] == got[2]["refers_to"] == 6 and got[3]["refers_to"] == 4
    import base64
    import hashlib

    for i, _, h in rows:
        data = (h or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if got[i]["record_type"] == "response":
            assert bytes(got[i]["payload"]) == data
    assert warc.archive(pages.limit(0)).count() == 0


def test_pipeline_runs_and_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    path = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, path)
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == d.columns and 0 < kept.count() <= d.count()
        d = kept
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.STAGES[-1][1](spark, d, path).columns)


def test_archives_lie_in_the_file_system_of_spark(spark, tmp_path):
    """A folder without a scheme, with a sign that a URI escapes: bundles lie where Spark's tables do, and nothing else stays."""
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, None, None)], "page_id long, url string, html string")
    at = tmp_path / "an archive"
    assert common.qualified(spark, str(at)).startswith("file:/") and "%20" in common.qualified(spark, str(at))
    shared = Path(common.shared_dir(spark).removeprefix("file:")) / "seamline"
    before = set(shared.glob("*/keys-*")) | set(shared.glob("*/revisits-*"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive(pages, str(at)).collect()}
    assert got == {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("response", None, 0)}
    assert list(at.glob("*.warc.zst")) and not list(at.glob("*.part"))
    assert set(shared.glob("*/keys-*")) | set(shared.glob("*/revisits-*")) == before
    assert warc._store(common.qualified(spark, str(at)))[1] == str(at)
