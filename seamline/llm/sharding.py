"""Sharding along a Hilbert curve, in DataFrame operations alone.

Several metadata columns are quantised to the same number of bits, the cell's
place on the Hilbert curve orders the rows, and the order is cut into runs of
equal counts. Rows of a shard then lie close together in all the dimensions, so
a filter on any of them skips most shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut


def hilbert(axes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell given by integers of ``bits`` bits (Skilling's transform)."""
    n = len(axes)
    if n * bits > 62:
        raise ValueError("too many bits for a long")
    moves = F.lit([[1 << q, i] for q in range(bits - 1, 0, -1) for i in range(n)] or [[0, 0]])
    put = lambda x, i, v: F.transform(x, lambda y, k: F.when(k == i, v).otherwise(y))

    def turn(x: Column, move: Column) -> Column:
        q, i = move[0], move[1].cast("int")
        p = q - 1
        head, own = F.get(x, F.lit(0)), F.get(x, i)
        swap = head.bitwiseXOR(own).bitwiseAND(p)
        return (
            F.when(q == 0, x)
            .when(own.bitwiseAND(q) != 0, put(x, F.lit(0), head.bitwiseXOR(p)))
            .when(i == 0, x)
            .otherwise(F.transform(x, lambda y, k: F.when((k == 0) | (k == i), y.bitwiseXOR(swap)).otherwise(y)))
        )

    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  x is worked out once
    bit = lambda x: lambda s, m: s * 2 + F.call_function("shiftright", F.get(x, m[1].cast("int")), m[0].cast("int")).bitwiseAND(F.lit(1)).cast("long")
    places = F.lit([[q, i] for q in range(bits - 1, -1, -1) for i in range(n)])
    masks = F.lit([1 << q for q in range(bits - 1, 0, -1)] or [0])

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        flip = F.aggregate(masks, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        flipped = let(flip, lambda t: F.transform(x, lambda y: y.bitwiseXOR(t)))
        return let(flipped, lambda z: F.aggregate(places, F.lit(0).cast("long"), bit(z)))

    turned = F.aggregate(moves, F.array(*(a.cast("int") for a in axes)), turn)
    # Gray code: each axis is xored with all before it
    gray = lambda x: F.transform(x, lambda _, k: F.aggregate(F.slice(x, F.lit(1), k + 1), F.lit(0), lambda s, y: s.bitwiseXOR(y)))
    return let(let(turned, gray), finish)


def by_quantile(df: DataFrame, column: str, bits: int) -> Column:
    """The column's quantile as an integer of ``bits`` bits; nulls are in the first one."""
    n = 1 << bits
    cuts = df.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 10_000)).first()[0] or []
    level = F.lit(0)
    for c in cuts:
        level = level + F.when(F.col(column) > F.lit(c), 1).otherwise(0)
    return F.coalesce(level, F.lit(0))


def by_hash(column: str, bits: int) -> Column:
    """A name as an integer of ``bits`` bits: equal names share a cell; nulls are in the first one."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("int")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank``, the place of a row in the order of all, from 0, and ``total``.

    The rows are dealt to partitions by ranges of the order and written once; a rank is the
    number of rows in earlier partitions plus the place within its own. Rows that tie in the order are equal.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = cut(placed.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "ordered")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))  # one row a partition
    before = sizes.select("part", (F.sum("n").over(every.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(every).alias("total"))
    return placed.join(cut(before, "offsets"), "part").select("*", (F.col("before") + F.col("row")).alias("rank")).drop("part", "row", "before")


def shard(docs: DataFrame, dims: list[Column], bits: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, place, shard, slot) of each row, shards differing by a row at most.

    Equal texts are one group; it stands where its first row on the curve stands (the smallest id of those), so only the
    border of a shard can part it. The order is the group's place on the curve, that row's id, the text's digest, and
    the row's own id. A null text counts as empty; null ids come first; repeated rows each get a slot
    of their own. An empty table gives no row. Columns other than those in ``dims`` are not looked at, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("same"), hilbert(dims, bits).alias("place"))
    rows = cut(rows, "placed")
    groups = rows.groupBy("same").agg(F.min(F.struct("place", "id")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(cut(groups.drop("n"), "groups"), "same", "left")
    rows = rows.select("id", "size", "text_crc32", "same", F.coalesce("lead.place", "place").alias("place"), F.when(F.col("lead").isNotNull(), F.col("lead.id")).otherwise(F.col("id")).alias("first"))
    told = ranked(rows, ["place", "first", "same", "id"])
    told = told.withColumn("shard", F.expr(f"cast((rank * {shards}) div total as int)"))
    told = told.withColumn("slot", F.expr(f"rank - (shard * total + {shards - 1}) div {shards}"))
    return told.select(F.col("id").alias(id_col), "size", "text_crc32", "place", "shard", "slot")
