"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that can be read alone; after the frames comes a
seek table in a skippable frame (the public seekable format), so any Zstandard
reader reads a bundle and a seek needs its tail only. An index maps each record to
its bundle, frame and offset within the frame. Of equal payloads one record is a
response and the rest revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, qualified, shared_dir

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME, BUNDLE = 1 << 18, 1 << 26


def _store(uri: str):
    """File system and path of a folder that ``qualified`` has named."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(page_id: int, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit has no payload of its own but tells its size."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest32(sha1)}"),
        ("WARC-Payload-Length", str(size)),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(payload))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record in a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if lines[0] != "WARC/1.1" or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"broken record at {at}")
        yield at, head, data[start:stop]
        at = stop + 4


class BundleWriter:
    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.zip = out, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.total = bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset within the frame."""
        if self.buffer and len(self.buffer) + len(data) > FRAME:
            self.flush()
        place = len(self.frames), len(self.buffer)
        self.buffer += data
        self.total += len(data)
        return place

    def flush(self) -> None:
        if self.buffer:
            packed = self.zip.compress(bytes(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.buffer)))
            self.buffer = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle, ``file`` being seekable."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        self.sizes = np.frombuffer(file.read(8 * n), "<u4").reshape(n, 2)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0].astype(np.int64))])

    def frame(self, k: int) -> bytes:
        import zstandard

        self.file.seek(int(self.starts[k]))
        return zstandard.ZstdDecompressor().decompress(self.file.read(int(self.sizes[k, 0])), max_output_size=int(self.sizes[k, 1]))


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url, html, size, sha1, refers_to) of each page: the largest id of a payload is the one referred to.

    What revisits what is told from ids, digests and sizes alone; pages then meet it by their own id and digest, so
    copies of one payload stay apart. The html of a revisit is null. What lies in ``scratch`` may go when the plan's rows are written.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("sha1"))
    keys = scratch.cut(rows.select("page_id", "sha1", "size").where(F.col("size") >= least), "keys")
    last = keys.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least <> refers_to").drop("least")
    again = scratch.cut(keys.join(last, "sha1").where("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct(), "revisits")
    own = rows.join(again, ["page_id", "sha1"], "left")
    return own.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "sha1", "refers_to")


def write_archive(planned: DataFrame, folder: str) -> DataFrame:
    """Write the records to bundles in ``folder``, one or more a task; the index (page_id, bundle, frame, offset).

    A bundle gets its name when it is complete, and a name of its own each time a task runs, so
    a task that is run again leaves a bundle that the index doesn't name. The index is written
    before it is returned and so fits the bundles. A folder without a scheme lies where Spark's own tables do, in the cluster's default file system.
    """
    folder = qualified(planned.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        writer, name, rows = None, "", []

        def close() -> pd.DataFrame:
            writer.close()
            store.move(f"{base}/{name}.part", f"{base}/{name}.warc.zst")
            return pd.DataFrame(rows, columns=["page_id", "bundle", "frame", "offset"]).astype({"page_id": "Int64"})

        for pdf in batches:
            refers = pdf["refers_to"].astype("Int64").tolist()
            ids = pdf["page_id"].astype("Int64").tolist()
            for page, url, html, size, sha1, to in zip(ids, pdf["url"], pdf["html"], pdf["size"], pdf["sha1"], refers, strict=True):
                if writer is None:
                    name, rows = uuid.uuid4().hex, []
                    writer = BundleWriter(store.open_output_stream(f"{base}/{name}.part", compression=None))
                page, to = (None if x is pd.NA else x for x in (page, to))
                place = writer.add(record(page, url, (html or "").encode(), size, sha1, to))
                rows.append((page, f"{name}.warc.zst", *place))
                if writer.total >= BUNDLE:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return cut(planned.mapInPandas(run, "page_id long, bundle string, frame int, offset long"), "index")


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that ``index`` names, checked against it and against its digest.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, payload); the payload of a revisit is null. Give
    a part of the index to read its records alone: frames without any are passed over.
    """
    folder = qualified(index.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        for pdf in batches:
            for bundle, wanted in zip(pdf["bundle"], pdf["places"], strict=True):
                path = f"{base}/{bundle}"
                with store.open_input_file(path) as file:
                    reader = BundleReader(file, store.get_file_info(path).size)
                    by_frame: dict[int, set[int]] = {}
                    for p in wanted:
                        by_frame.setdefault(p["frame"], set()).add(p["offset"])
                    for k in sorted(by_frame):
                        yield _records(parse(reader.frame(k)), by_frame[k])

    places = index.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset"))).alias("places"))  # as many as one bundle holds
    # dealt in turn to a number of readers, as the few small rows that name the bundles would all go to one task
    places = places.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return places.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _records(found: Iterable, wanted: set[int]) -> pd.DataFrame:
    rows = []
    number = lambda x: None if x == "None" else int(x)
    for at, head, block in found:
        if at not in wanted:
            continue
        wanted.discard(at)
        page, kind, digest = number(head["WARC-Record-ID"][10:-1]), head["WARC-Type"], head["WARC-Payload-Digest"][5:]
        if kind == "response" and digest32(hashlib.sha1(block).hexdigest()) != digest:
            raise ValueError(f"payload of {page} does not have its digest")
        to = number(head["WARC-Refers-To"][10:-1]) if kind == "revisit" else None
        rows.append((page, int(head["WARC-Payload-Length"]), digest, kind, to, block if kind == "response" else None))
    if wanted:
        raise ValueError("the index names places where no record starts")
    return pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, **columns) -> DataFrame:
    """Write ``pages`` as WARC bundles and read all of it back; a row for each page, as ``read_archive`` has them.

    A null html is an empty payload. Of rows that repeat an id and payload, all are responses if the
    id is the largest one of the payload, else all are revisits. A null id is kept, and never referred to unless all
    ids of its payload are null. Payloads shorter than ``least`` bytes are all responses. Ids are integers: text that
    holds none is an error. An empty table gives no row and no bundle. Columns besides id, url and html are not looked at,
    whatever their names. A frame has at least one whole record, and a record less than 4 GB, which is what a seek table can tell.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/seamline/warc-{uuid.uuid4().hex}"
    scratch = Scratch(pages.sparkSession)
    index = write_archive(plan(pages, least=least, scratch=scratch, **columns), folder)
    scratch.clear()
    return read_archive(index, folder)
