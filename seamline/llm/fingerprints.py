"""Consistent weighted sampling of word multisets, in DataFrame operations alone.

For a term of weight w and a sample j, hashes of (term, j) give r and c of a
Gamma(2, 1) law and b uniform in (0, 1); with t = floor(ln w / r + b) the term
bids ln c - r (t - b) - r, and the least bid wins. A winning bid is decided by term, j
and t, so two texts share sample j with the probability of their generalised Jaccard
similarity, and the bid itself, hashed to 32 bits, stands for the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SAMPLES, TURN = 32, 8
#: Characters that end a term, besides the space.
BREAKS = "".join(map(chr, range(32))) + "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_MASK = (1 << 24) - 1


def _share(x: Column, at: int) -> Column:
    """24 of the 64 bits of ``x`` as a number within (0, 1)."""
    return (F.shiftrightunsigned(x, at).bitwiseAND(F.lit(_MASK)).cast("double") + 0.5) / F.lit(float(_MASK + 1))


def draws(term: Column, j: Column) -> tuple[Column, Column, Column]:
    """Of a term and sample j: r, b, and the bid at weight 1, where t is 0."""
    x, y = F.xxhash64(term, j * 2), F.xxhash64(term, j * 2 + 1)
    r = -F.log(_share(x, 0) * _share(x, 24))
    ln_c = F.log(-F.log(_share(y, 0) * _share(y, 24)))
    b = (F.shiftrightunsigned(x, 48).cast("double") * 65536.0 + F.shiftrightunsigned(y, 48).cast("double") + 0.5) / float(1 << 32)
    return r, b, ln_c - r * (1 - b)


def bids(counts: DataFrame, group: str, row: str, weights: list[str], samples: int) -> DataFrame:
    """Least bids of the terms of each ``row`` of a ``group``, a column ``<weight>_<j>`` for each weight and sample.

    A row of ``counts`` is a term (a hash) with a count in each of ``weights``; a count of 0 or null doesn't bid. Samples
    are drawn ``TURN`` at a time, a turn a row, as generated code that handles more of them at once is too long
    to be compiled.
    """
    ln = [F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))).alias(w) for w in weights]
    each = counts.select(group, row, "term", *ln, F.explode(F.lit(list(range(0, samples, TURN)))).alias("turn"))
    drawn = [x.alias(f"{n}_{k}") for k in range(TURN) for n, x in zip("rbs", draws(F.col("term"), F.col("turn") + k), strict=True)]
    each = each.select(group, row, "turn", *weights, *drawn)
    least = []
    for k in range(TURN):
        for w in weights:
            bid = F.expr(f"case when {w} = 0 then s_{k} when {w} > 0 then s_{k} - r_{k} * floor({w} / r_{k} + b_{k}) end")
            least.append(F.min(bid).alias(f"{w}_{k}"))
    turns = each.groupBy(group, row, "turn").agg(*least)
    pick = lambda w, j: F.expr(f"max(case when turn = {j // TURN * TURN} then {w}_{j % TURN} end) as {w}_{j}")
    return turns.groupBy(group, row).agg(*(pick(w, j) for w in weights for j in range(samples)))


def fingerprint(weight: str, samples: int) -> Column:
    """Eight hexadecimal digits for each sample; zeros throughout where there was no term."""
    parts = (f"coalesce(substring(lpad(lower(hex(xxhash64({c}))), 16, '0'), 9, case when {c} is null then null else 8 end), '00000000')" for c in (f"{weight}_{j}" for j in range(samples)))
    return F.expr(f"concat({', '.join(parts)})")


def likeness(a: str, b: str, samples: int) -> Column:
    """Share of equal samples of two fingerprints."""
    same = (f"cast(substring({a}, {8 * j + 1}, 8) = substring({b}, {8 * j + 1}, 8) as int)" for j in range(samples))
    return F.expr(f"({' + '.join(same)}) / {float(samples)}D")


def _stretch(key: Column, text: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at or below the key, by bisection; null keys have 16 stretches below 0, by a hash of the text."""
    bits = max(1, len(bounds).bit_length())
    padded = F.lit([*bounds, *[2**63 - 1] * ((1 << bits) - len(bounds))]) if bounds else F.lit([2**63 - 1] * 2)
    step = lambda at, k: F.when(F.element_at(padded, (at + k).cast("int")) <= key, at + k).otherwise(at)
    found = F.aggregate(F.lit([1 << k for k in reversed(range(bits))]), F.lit(0), step)
    return F.when(key.isNull(), (-9 - F.shiftright(F.xxhash64(text), 60)).cast("int")).otherwise(found)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(stretch, rn, id, text, next_stretch, next_rn, next_text): each text and the next one by descending id.

    (stretch, rn) names a row. After the last comes the first. Null ids come last; rows with equal ids follow by a hash of
    their texts. Ids are cut into stretches at approximate quantiles, four to a shuffle partition,
    so no task sees the whole order; the row after a stretch is looked up among the stretches' first rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = base.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10 * max(1000, n))).first()[0]
    # never null, but said here, so that all readers of the shuffled texts agree and it is made once
    base = base.withColumn("stretch", _stretch(F.col("id"), F.col("text"), sorted(set(cuts or [])))).where("stretch is not null")
    order = Window.partitionBy("stretch").orderBy(F.desc_nulls_last("id"), F.xxhash64("text"), "text")
    rows = base.select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("then"))
    ends = cut(base.groupBy("stretch").agg(F.max("id").alias("id")), "ends")
    round_ = Window.partitionBy(F.lit(1)).orderBy(F.desc("stretch"))  # one row a stretch
    first = F.first(F.struct("stretch", "id")).over(round_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("stretch", F.coalesce(F.lead(F.struct("stretch", "id")).over(round_), first).alias("to"))
    ends = ends.select("stretch", F.col("to.stretch").alias("next_stretch"), F.col("to.id").alias("next_id"))
    heads = F.broadcast(ends).join(base.withColumnRenamed("stretch", "of"), (F.col("next_stretch") == F.col("of")) & F.col("next_id").eqNullSafe(F.col("id")))
    heads = heads.groupBy("stretch", "next_stretch").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("head"))
    out = rows.join(cut(heads, "heads"), "stretch", "left")
    last = F.col("then").isNull()
    return out.select("stretch", "rn", "id", "text", F.when(last, F.col("next_stretch")).otherwise(F.col("stretch")).alias("next_stretch"), F.when(last, 1).otherwise(F.col("rn") + 1).alias("next_rn"), F.coalesce("then", "head").alias("next_text"))


def spaced(text: Column) -> Column:
    return F.translate(text, BREAKS, " " * len(BREAKS))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprint each text and the same text with its last third taken from the next one's start.

    One row for each row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A term is a run of characters between spaces and signs. A null text is an empty one; texts without a term have
    the zero fingerprint and are alike. Repeated rows
    and ids keep a row each, and the next row is one row, also where ids repeat. Other columns are not looked at, whatever
    their names. The standard error of a likeness s is sqrt(s (1 - s) / ``samples``). An empty table gives no row.
    """
    third = "cast(floor(length(text) / 3) as int)"
    rows = with_next(docs, id_col, text_col).withColumn("edited", F.expr(f"concat(left(text, length(text) - {third}), left(next_text, {third}))"))
    keys = ["stretch", "rn"]
    told = rows.select(*keys, "id", "next_stretch", "next_rn", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    # both texts share all words before the one that the cut falls into, so these are split once
    parts = rows.select(*keys, *(spaced(F.expr(x)).alias(n) for n, x in (("head", f"left(text, length(text) - {third})"), ("own", f"right(text, {third})"), ("new", f"left(next_text, {third})"))))
    parts = parts.withColumn("tail", F.substring_index("head", " ", -1))
    shared = F.expr("left(head, length(head) - length(tail))")
    words = parts.select(*keys, F.split(F.concat(shared, F.lit(" \x00 "), "tail", "own", F.lit(" \x01 "), "tail", "new"), " ").alias("words"))
    words = words.select(*keys, "words", F.array_position("words", "\x00").alias("a"), F.array_position("words", "\x01").alias("b"))
    each = words.select(*keys, "a", "b", F.posexplode("words").alias("pos", "word")).where(~F.col("word").isin("", "\x00", "\x01"))
    each = each.select(*keys, F.xxhash64("word").alias("term"), F.expr("cast(pos < b as int)").alias("w"), F.expr("cast(pos < a or pos >= b as int)").alias("e"))
    counts = each.groupBy(*keys, "term").agg(F.sum("w").alias("w"), F.sum("e").alias("e"))
    signed = bids(counts, *keys, ["w", "e"], samples)
    signed = signed.select(*keys, fingerprint("w", samples).alias("fingerprint"), fingerprint("e", samples).alias("edited_fingerprint"))
    none = F.lit("0" * 8 * samples)
    told = told.join(signed, keys, "left").withColumns({c: F.coalesce(c, none) for c in ("fingerprint", "edited_fingerprint")})
    told = cut(told, "fingerprints")
    then = told.select(F.col("stretch").alias("next_stretch"), F.col("rn").alias("next_rn"), F.col("fingerprint").alias("next_fingerprint"))
    out = told.join(then, ["next_stretch", "next_rn"])
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", samples).alias("near_next"),
    )
