"""WARC archives: one gzip member per record, written and read sequentially in tasks.

The reader decompresses each member bit by bit, frames the block by Content-Length, and checks payload and block digests without holding a record.
Archives live in a folder that all executors share, given as a URI that ``pyarrow.fs`` opens (file, s3, gs, hdfs). A task writes under names of its own,
and only names that a finished task returned are part of the archive, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import KeyFilter, batches, fresh_path, lean, partitions, passing, stored

CHUNK = 1 << 18
#: An archive is closed beyond this size.
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str, date: str) -> bytes:
    """A whole record, not compressed. A revisit (refers_to is given) has the HTTP head alone as block."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    name = f"{URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}#{payload_digest}')}"
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    fields: dict[str, str]
    payload_bytes: int
    payload_digest: str
    valid: bool
    payload: bytes | None


class WarcError(ValueError):
    """Not a record, or one that ends too early or goes on too long."""


class _Member:
    """The decompressed bytes of one gzip member, in pieces."""

    def __init__(self, source, rest: bytes):
        self.source, self.rest, self.unpack, self.held = source, rest, zlib.decompressobj(31), b""

    def more(self) -> bytes:
        while not self.unpack.eof:
            raw = self.unpack.unconsumed_tail or self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not raw:
                raise WarcError("the archive ends inside a record")
            if out := self.unpack.decompress(raw, CHUNK):
                return out
        return b""

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > most or not (out := self.more()):
                raise WarcError("no end of the header")
            self.held += out
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            piece = self.held or self.more()
            if not piece:
                raise WarcError("the block is shorter than its Content-Length")
            piece, self.held = piece[:n], piece[n:]
            n -= len(piece)
            yield piece

    def end(self) -> bytes:
        """Checks the two line ends after the block; returns what was read beyond the member."""
        if b"".join(self.pieces(4)) != b"\r\n\r\n" or self.held or self.more():
            raise WarcError("the block is longer than its Content-Length")
        return self.unpack.unused_data


def read_records(source, keep_payload: bool = False) -> Iterator[Record]:
    """Records of an open binary stream, one after another. ``valid``: the block's digest, and for responses the payload's, are as the header says."""
    rest = source.read(CHUNK)
    while rest:
        one = _Member(source, rest)
        version, *lines = one.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError("no WARC version")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block, payload, n, kept, head = hashlib.sha1(), hashlib.sha1(), 0, [], b""
        body = False
        for piece in one.pieces(int(fields["content-length"])):
            block.update(piece)
            if not body:
                head += piece
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                body, piece = True, head[at + 4 :]
            payload.update(piece)
            n += len(piece)
            if keep_payload:
                kept.append(piece)
        rest = one.end() or source.read(CHUNK)
        said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        found = base64.b32encode(payload.digest()).decode()
        valid = fields.get("warc-block-digest", "").removeprefix("sha1:") == base64.b32encode(block.digest()).decode() and (fields.get("warc-type") == "revisit" or said == found)
        yield Record(fields, n, said, valid, b"".join(kept) if keep_payload else None)


def _number(urn: str | None) -> int | None:
    return int(urn[len(URN) + 1 : -1]) if urn and urn.startswith(f"<{URN}") else None


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages: page_id, url, payload (binary), refers_to -> (path) of the archives written to the shared ``folder``."""

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        sink, names, size = None, [], 0
        for batch in batches(rows, 8 << 20):
            for r in batch.to_pylist():
                if sink is None:
                    names.append(f"{base}/{uuid.uuid4().hex}.warc.gz")
                    sink, size = store.open_output_stream(names[-1], compression=None), 0
                data = member(record(r["page_id"], r["url"], r["payload"], r["refers_to"], digest(r["payload"]), date))
                sink.write(data)
                size += len(data)
                if size > most_bytes:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    return stored(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(lean(write), "path string"), "warc-names")


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """(path) -> page_id, record_type, refers_to, payload_bytes, payload_digest, valid; an archive is read by one task."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "valid"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for rows_ in rows:
            for path in rows_.column(0).to_pylist():
                found = []
                with store.open_input_stream(path, compression=None) as source:
                    for r in read_records(source):
                        f = r.fields
                        found.append((_number(f["warc-record-id"]), f["warc-type"], _number(f.get("warc-refers-to")), r.payload_bytes, r.payload_digest, r.valid))
                        if len(found) == 10_000:
                            yield batch(found)
                            found = []
                if found:
                    yield batch(found)

    n = partitions(paths.sparkSession)
    return paths.repartition(n, "path").mapInArrow(lean(read), "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, valid boolean")


def roundtrip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, valid.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of ``min_bytes`` or more that of the largest id is the response and the others
    revisit it; a revisit's payload is not written again, its length comes from the response that was read. Rows that repeat an id and its payload are
    written alike (all responses where the id is the largest). A null id is kept as null and is a response only where all its payload's ids are null
    (then every one is); a null or odd url is left out or percent-encoded. An empty table gives no archives and no rows; other columns are ignored.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("bigint"))
    firsts = base.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")).where("copies > 1 AND first IS NOT NULL")
    firsts = stored(firsts.select("sha", "n", "first", F.xxhash64("sha").alias("key")), "warc-firsts")
    # only payloads that may have copies are shuffled; the join's keys differ from the grouping's, so a payload that very many rows share is split
    known, keyed = pages.sparkSession.sparkContext.broadcast(KeyFilter.of(firsts.select("key"))), base.withColumn("key", F.xxhash64("sha"))
    copied = passing(keyed, "key", known).join(firsts.drop("key"), ["sha", "n"], "left").select("page_id", "url", "payload", "first")
    alone = passing(keyed, "key", known, False).select("page_id", "url", "payload", F.lit(None).cast("bigint").alias("first"))
    paths = write_archives(alone.unionByName(copied).withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))), folder)
    read = stored(read_archives(paths, folder), "warc-read")
    responses = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("to_id"), F.col("payload_digest").alias("to_digest")).agg(F.max("payload_bytes").alias("to_bytes"))
    out = read.join(responses, (F.col("refers_to") == F.col("to_id")) & (F.col("payload_digest") == F.col("to_digest")), "left")
    return out.select(
        F.col("page_id").alias(id_col), F.when(F.col("record_type") == "revisit", F.col("to_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to", (F.col("valid") & (F.col("to_id").isNotNull() | (F.col("record_type") == "response"))).alias("valid"),
    )
