"""What the corpus operators share: tables, the shared scratch folder, small hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, where all of them are one process, may do without it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="seamline-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host by which Spark reads it; without any, it lies in the cluster's default file system.

    Signs that a URI can't hold are escaped, so the result is for readers of URIs, not for Spark's own paths.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a short lineage that outlives executors."""
    return Scratch(df.sparkSession).cut(df, tag)


class Scratch:
    """A folder of its own within the shared one, for tables that are needed only until a result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/seamline/{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        at = f"{self.at}/{tag}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def clear(self) -> None:
        """Delete the folder; nothing that reads its tables may run any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(rows: DataFrame, most: int = 1_000) -> DataFrame:
    """``rows`` as they are, in a session whose Arrow batches hold at most ``most`` of them: texts are long, and a batch lies in memory on both sides.

    A session that sets another number than Spark's own keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if rows.sparkSession.conf.get(key) == "10000":
        rows.sparkSession.conf.set(key, str(most))
    return rows


def perhaps_in(rows: DataFrame, ids: DataFrame, column: str = "id", most_bits: int = 1 << 27) -> DataFrame:
    """The rows whose ``column`` may be in the first column of ``ids``: all that are, and about one in twenty of the others.

    A bitmap of hashes, of ``most_bits`` (16 MB) at most whatever the tables' size, is broadcast, so rows without a partner
    drop out before a join moves them. Where it would be too full to tell much, all rows pass.
    """
    bits = max(1 << 15, 1 << (16 * ids.count()).bit_length())
    if bits > 8 * most_bits:
        return rows
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(min(bits, most_bits))) + 1
    bucket, bit = free_name(rows, "_bucket"), free_name(rows, "_bits")
    maps = ids.select(place(F.col(ids.columns[0])).alias("at")).groupBy(F.bitmap_bucket_number("at").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(bit))
    at = F.bitmap_bit_position(place(F.col(column)))
    byte = F.conv(F.hex(F.substring(F.col(bit), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn(bucket, F.bitmap_bucket_number(place(F.col(column)))).join(F.broadcast(maps), bucket)
    return told.where(F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` of the rows, picked by a hash of ``key``; all of them if there are fewer."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(most / n * (1 << 30)))


class Bounded(dict):
    """A cache for one worker: ``fill`` computes what is missing. When ``most`` keys or ``chars`` characters of keys are passed, all go but those asked for."""

    def __init__(self, most: int = 400_000, chars: int = 16_000_000):
        super().__init__()
        self.most, self.chars, self.held = most, chars, 0

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def need(self, keys: Iterable, fill: Callable[[list], Iterable]) -> None:
        new = list(filterfalse(self.__contains__, keys))
        more = sum(map(len, new))
        if self and (len(self) + len(new) > self.most or self.held + more > self.chars):
            known = {k: self[k] for k in keys if k in self}
            self.clear()
            self.update(known)
            self.held = sum(map(len, known))
        if new:
            self.update(zip(new, fill(new), strict=True))
            self.held += more


def word_hashes(words: list[str] | list[bytes]) -> list[int]:
    """63-bit hashes, so that they fit a signed column."""
    h = xxhash.xxh3_64_intdigest
    return [h(w) >> 1 for w in words]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list, chars: int = 1_500_000) -> Iterable[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters each, to bound what a step holds at once."""
    start = size = 0
    for i, x in enumerate(texts):
        size += 0 if x is None else len(x)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def spans(texts: pa.Array, chars: int = 1_500_000) -> Iterable[tuple[int, int]]:
    """``blocks`` of an Arrow array, so that few texts at a time become Python strings."""
    sizes, start = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + chars, "right")))
        yield start, stop
        start = stop


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterable[pa.RecordBatch]:
    """Arrow batches in parts of bounded text."""
    for batch in batches:
        for i, j in spans(batch.column(text)):
            yield batch.slice(i, j - i)
