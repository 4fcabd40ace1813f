"""Byte-pair encoding, the filter audit and fill-in-the-middle against a library, plain Python and each other."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("seamline.llm")
from seamline.llm import audit, bpe, infill, queries  # noqa: E402

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
AWKWARD = [
    None, "", " \n\t ", "Hello World's it's we'll I'D don't", "ΣΑΣ ΟΔΟΣ ς", "a\x1cb c\x1f\x85d\xa0e", "x" * 5000, "ab" * 3000 + " " + "é" * 999, "<|endoftext|>a<|startoftext|> <|EndOfText|> b<|endoftext|>",
    "é Å ﬁ İstanbul ǅ", "12 3４ ½ ²", "漢字かな交じり", "😀👍🏽 !!...??", "ࢗ \U00010d50 \U0001e5d0 \U00016d40x", "ab\u0000cd\x7f", "tail \n", "  lead", "<P> holds a mark", "<", "a<S", "same text", "same text",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["the", "River", "STONE", "naïve", "über", "#tag", "x=1;", "l'eau", "<M", ">", "１２", "\n", "\t", "  "]
    return AWKWARD + [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(120)]


@pytest.fixture(scope="module")
def at(spark, texts, tmp_path_factory):
    """A folder of tables: texts with ids, the last of which are null or repeat."""
    folder, rng = str(tmp_path_factory.mktemp("texts")), random.Random(5)
    rows = [(i, x, rng.choice(["en", "de", None, ""]), "s") for i, x in enumerate(texts)]
    rows += [(None, "same text", "en", "s"), (None, None, None, "s"), (3, rows[3][1], "de", "s"), (5, "another text of this id", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, len(texts), 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


# --- 11


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_encoding_is_that_of_the_library(spark, at, library):
    folder, rows, _ = at
    want = Counter()
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, queries.op11_bpe(spark, folder).collect())) == want


def test_ids_as_arrays_decode_too(spark, library):
    path = queries.tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame([("a River", "k"), (None, "k"), ("", "k")], "text string, ids string")
    got = bpe.decode(bpe.encode(df, path), path).collect()
    assert [list(r["ids"]) for r in got] == [library.encode("a River").ids, [], []]
    assert [r["decoded"] for r in got] == [library.decode(library.encode("a River").ids), "", ""]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_merges_as_in_the_library(text):
    path = queries.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    ids = np.frombuffer(bpe.Encoder(bpe.load(path), most=5).encode([text])[0], "<u4").tolist()
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeinthr", min_size=1, max_size=200))
def test_the_queue_merges_what_the_slow_way_merges(word):
    model = bpe.load(queries.tokenizer_path("word_bpe_49k.json"))
    ids = [model.inner[b] for b in word.encode()[:-1]] + [model.final[word.encode()[-1]]]
    while True:
        best = min(((r, i) for i in range(len(ids) - 1) if (r := model.follows[ids[i]].get(ids[i + 1])) is not None), default=None)
        if best is None:
            break
        ids[best[1] : best[1] + 2] = [model.made[best[0]]]
    assert model.merge(word) == ids


# --- 12


def plain_fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    return out | ({"D"} if re.search("[#$%&*|]", text) else set())


def test_the_audit_is_every_order_applied(spark, at):
    folder, rows, labels = at
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, lang, _ in rows:
        fails = plain_fails(text or "")
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, *_ in rows):
            fails.add("E")
        docs.append((lang or "", fails, i in good, i in toxic))
    want, fair = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            everyone = left
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                fair[part, f] += len(gone)
                want[part, "".join(order), step] = (len(left), len(gone), sum(f in d[1] for d in everyone) - len(gone), sum(d[1] == {f} for d in everyone), sum(d[2] for d in gone), sum(d[3] for d in gone))
    got = {tuple(r[:3]): tuple(r[3:]) for r in queries.op12_filters(spark, folder).collect()}
    assert got == {k: (*v, fair[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_shares_are_the_mean_over_all_orders():
    rng = random.Random(2)
    for n in (1, 2, 3, 5):
        counts = {m: rng.randint(0, 50) for m in range(1 << n)}
        gone = audit.coalitions(counts, n)
        orders, total = list(permutations(range(n))), [0] * n
        for order in orders:
            had = 0
            for k in order:
                total[k] += gone[had | 1 << k] - gone[had]
                had |= 1 << k
        assert audit.shares(gone) == [Fraction(x, len(orders)) for x in total]


def test_other_filters_without_copies_or_tallies(spark):
    df = spark.createDataFrame([(1, "a b", "p"), (2, "A", None), (3, None, "p")], "id long, text string, part string")
    counts = audit.counted(df, F.col("id"), F.col("text"), F.col("part"), {"X": F.col("text").contains("A"), "Y": F.col("text").isNull()})
    assert {tuple(r) for r in counts.select("part", "mask", "n").collect()} == {("p", 0, 1), ("", 1, 1), ("p", 2, 1)}
    assert audit.steps(counts, "XY", []).count() == 2 * 2 * 2


# --- 13


def plain_infill(i, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, digest = len(tokens), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = ("".join(p) for p in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return i, n, form, len(x), len(y), sha(f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"), sha(text)


def test_infilling_is_the_plain_one(spark, at):
    folder, rows, _ = at
    got = Counter(map(tuple, queries.op13_infill(spark, folder).collect()))
    assert got == Counter(plain_infill(i, text) for i, text, *_ in rows)
    assert {"plain", "spm", "psm"} == {r[2] for r in got}


def test_infilling_keeps_the_other_columns(spark):
    df = spark.createDataFrame([(1, "one\ntwo\nthree", "k", "c")], "doc_id long, text string, n string, _cut string")
    out = infill.transform(df, unit="line", rate=100)
    assert out.columns == ["doc_id", "text", "n", "_cut", "form", "prefix_chars", "middle_chars", "output"]
    r = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).first()
    assert (r["n"], r["back"], r["_cut"]) == (3, "one\ntwo\nthree", "c") and r["form"] != "plain"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab <\n\t\r.é", max_size=40), min_size=1, max_size=8), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_fall_at_unit_ends(texts, h1, h2):
    for unit, pattern in (("word", r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), ("line", r"[^\n]*\n|[^\n]+")):
        n, low, high = infill.cuts(texts, np.full(len(texts), h1), np.full(len(texts), h2), unit)
        for k, text in enumerate(texts):
            parts = re.findall(pattern, text)
            a, b = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
            assert (n[k], low[k], high[k]) == (len(parts), len("".join(parts[:a])), len("".join(parts[:b])))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=300))
def test_ranks_of_the_wavelet_matrix(values):
    index, places = infill.Wavelets(np.array(values, np.uint8)), np.arange(len(values) + 1)
    for v in range(7):
        assert index.rank(v, places).tolist() == [values[:p].count(v) for p in places]
