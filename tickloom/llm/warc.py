"""Operator 13: pages as WARC archives, written and read back record by record.

Writing: equal payloads are found by their digest; one page of each group is a ``response`` record, the others are
``revisit`` records that name it. Each record is a gzip member of its own. A task writes archives of about
``archive_bytes`` under names that no other attempt uses, and gives a row for each that is complete, so the
manifest, which is a table, names only what successful tasks have written.

Reading: a task goes through an archive once, from its start to its end: a piece of the file at a time, one incremental
decompressor a member, blocks framed by Content-Length and hashed as they pass. Memory is one piece, whatever the
length of a record, unless payloads are asked for. A damaged member gives a row with ``error``, and
reading goes on at the next member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path

#: Fixed values of the format.
VERSION, CRLF, END = b"WARC/1.1", b"\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
GZIP = 16 + zlib.MAX_WBITS
MAGIC = b"\x1f\x8b\x08"
#: Bytes of a file, and of what is decompressed at once.
PIECE = 1 << 18
#: Bytes within which the head of a record, and that of its HTTP message, must end.
HEAD = 1 << 20

MANIFEST = "path string, records long, bytes long"
RECORDS = "archive string, offset long, record_id string, record_type string, uri string, page_id long, refers_to_id string, payload_bytes long, payload_digest string, block_ok boolean, payload_ok boolean, error string, payload binary"


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """``page_id, url, payload, digest, first``: ``first`` is the page that a revisit refers to, null for responses.

    Of equal payloads of ``least`` bytes or more the smallest page_id is the response; rows that share it are all
    responses, as all are where every id is null. A null id never is the smallest beside others. A null html is an empty payload.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # by another key than the aggregate's, so that both sides are dealt anew and a payload with very many pages can be split
    same = same.select(F.reverse("digest").alias("key"), "first")
    rows = rows.join(same, F.reverse("digest") == F.col("key"), "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest[:32]}>"


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str, level: int = 6) -> bytes:
    """One record as one gzip member. A revisit has the head of its HTTP message, but not its payload."""
    block = HTTP.format(len(payload)).encode()
    if first is None:
        block += payload
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if first is not None:
        head += [("WARC-Refers-To", record_id(first, digest)), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    text = VERSION + CRLF + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + CRLF
    return packer.compress(text) + packer.compress(block) + packer.compress(END) + packer.flush()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = 1 << 26, date: str = "2000-01-01T00:00:00Z", **columns) -> DataFrame:
    """Writes a record per row and returns ``path, records, bytes`` of the archives. ``folder`` must be shared; ``columns`` are for ``with_roles``.

    The frame is lazy: archives are written when it is, so write it once (``stash``) before it is read.
    """
    folder = folder or new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _store(folder)
        store.create_dir(where, recursive=True)
        out, name, done = None, "", [0, 0]

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": done[0], "bytes": done[1]}], manifest)

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, done = f"{uuid.uuid4().hex}.warc.gz", [0, 0]
                    out = store.open_output_stream(f"{where}/{name}", compression=None)
                data = member(page_id, url, payload, digest, first, date)
                out.write(data)
                done[0] += 1
                done[1] += len(data)
                if done[1] >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    manifest = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    return with_roles(pages, **columns).mapInArrow(write, MANIFEST)


class Members:
    """The members of a gzip stream, one after the other, each in pieces."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.at = stream, b"", 0  # at: offset of raw in the file
        self.eof = False

    def _more(self) -> bool:
        if not self.raw and not self.eof:
            self.raw = self.stream.read(PIECE)
            self.eof = not self.raw
        return bool(self.raw)

    def _take(self, n: int) -> None:
        self.raw, self.at = self.raw[n:], self.at + n

    def skip(self) -> None:
        """To the next place that looks like the start of a member with a record."""
        while True:
            at = self.raw.find(MAGIC)
            while at >= 0:
                if len(self.raw) - at < 64 and not self.eof:
                    piece = self.stream.read(PIECE)
                    self.raw += piece
                    self.eof = not piece
                try:
                    if zlib.decompressobj(GZIP).decompress(self.raw[at:], 16).startswith(b"WARC/"):
                        self._take(at)
                        return
                except zlib.error:
                    pass
                at = self.raw.find(MAGIC, at + 1)
            keep = self.raw[-2:]
            self._take(len(self.raw) - len(keep))
            piece = b"" if self.eof else self.stream.read(PIECE)
            if not piece:
                self._take(len(self.raw))
                self.eof = True
                return
            self.raw += piece

    def __iter__(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        """``offset, pieces`` of each member; the pieces must be used up before the next is asked for."""
        while self._more():
            yield self.at, self._pieces()

    def _pieces(self) -> Iterator[bytes]:
        unpack = zlib.decompressobj(GZIP)
        fresh = True  # nothing of this member has been read yet
        while not unpack.eof:
            if not self._more():
                out = unpack.decompress(b"", PIECE)  # what it still holds back
                if not out and not unpack.eof:
                    raise ValueError("the archive ends within a record")
                yield out
                continue
            try:
                out = unpack.decompress(self.raw, PIECE)
            except zlib.error as e:
                if fresh:
                    self._take(1)
                raise ValueError(f"damaged member: {e}") from None
            left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            self._take(len(self.raw) - len(left))
            fresh = False
            if out:
                yield out


class _Feed:
    """Bytes of a member: up to a mark, or so many of them."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""

    def until(self, mark: bytes, most: int = HEAD) -> bytes:
        while (at := self.held.find(mark)) < 0:
            piece = next(self.pieces, None)
            if piece is None or len(self.held) > most:
                raise ValueError("a head without end")
            self.held += piece
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def some(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self.held:
                self.held = next(self.pieces, b"")
                if not self.held:
                    raise ValueError("the record ends before its Content-Length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def rest(self) -> bytes:
        """What is left of the member, which must be short."""
        for piece in self.pieces:
            self.held += piece
            if len(self.held) > len(END):
                break
        return self.held


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        key, colon, value = line.partition(":")
        if colon:
            out.setdefault(key.strip().lower(), value.strip())
    return out


def _agrees(stated: str | None, sha256, sha1) -> bool | None:
    """Whether a stated digest is that of the bytes; None where none is stated or its algorithm is another."""
    name, _, value = (stated or "").partition(":")
    if name.lower() == "sha256":
        return value.lower() == sha256.hexdigest()
    if name.lower() == "sha1":
        return value.upper() == base64.b32encode(sha1.digest()).decode() or value.lower() == sha1.hexdigest()
    return None


def read_record(pieces: Iterator[bytes], payloads: bool = False) -> dict:
    """One record from the pieces of its member. Raises ValueError where framing is wrong."""
    feed = _Feed(pieces)
    first, _, head = feed.until(END).partition(CRLF)
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    field = _fields(head)
    size = field.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", size):
        raise ValueError("a record without Content-Length")
    kind = field.get("warc-type")
    whole, part = (hashlib.sha256(), hashlib.sha1()), (hashlib.sha256(), hashlib.sha1())
    http, message, length, kept = b"", {}, 0, []
    waiting = field.get("content-type", "").lower().startswith("application/http")
    for piece in feed.some(int(size)):
        for h in whole:
            h.update(piece)
        if waiting:  # for the end of the message's head
            http += piece
            at = http.find(END)
            if at < 0:
                if len(http) > HEAD:
                    raise ValueError("an HTTP head without end")
                continue
            message, piece, waiting, http = _fields(http[:at]), http[at + len(END) :], False, b""
        length += len(piece)
        for h in part:
            h.update(piece)
        if payloads:
            kept.append(piece)
    if feed.rest() != END:
        raise ValueError("a record that goes on after its Content-Length")
    stated = field.get("warc-payload-digest")
    out = {"record_id": field.get("warc-record-id"), "record_type": kind, "uri": field.get("warc-target-uri"), "refers_to_id": field.get("warc-refers-to"), "block_ok": _agrees(field.get("warc-block-digest"), *whole)}
    if kind == "revisit":  # the payload is in the record that it refers to
        stated_length = message.get("content-length", "")
        return out | {"payload_bytes": int(stated_length) if stated_length.isdigit() else None, "payload_digest": (stated or "").partition(":")[2] or None}
    return out | {"payload_bytes": length, "payload_digest": part[0].hexdigest(), "payload_ok": _agrees(stated, *part), "payload": b"".join(kept) if payloads else None}


def read_stream(stream, archive: str, payloads: bool = False) -> Iterator[dict]:
    """The records of one open archive."""
    members = Members(stream)
    for offset, pieces in members:
        row = {"archive": archive, "offset": offset}
        try:
            row |= read_record(pieces, payloads)
            found = re.fullmatch(r"<urn:page:(-?\d+):.*>", row["record_id"] or "")
            row["page_id"] = int(found[1]) if found else None
        except ValueError as e:
            row["error"] = str(e)
            for _ in _quiet(pieces):
                pass
            members.skip()
        yield row


def _quiet(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The rest of a member, to its end or to where it is damaged."""
    try:
        yield from pieces
    except ValueError:
        return


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives that ``path`` names, in the columns of ``RECORDS``. An archive is one task's at a time; ``payload`` is null unless asked for."""
    fields = ("archive", "offset", "record_id", "record_type", "uri", "page_id", "refers_to_id", "payload_bytes", "payload_digest", "block_ok", "payload_ok", "error", "payload")
    kinds = (pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.binary())
    schema = pa.schema(list(zip(fields, kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, where = _store(path)
                rows, held = [], 0
                with store.open_input_stream(where, compression=None) as stream:
                    for row in read_stream(stream, path, payloads):
                        rows.append(row)
                        held += len(row.get("payload") or b"")
                        if len(rows) >= 2000 or held > 1 << 25:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    spark = archives.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(tasks, "path").mapInArrow(read, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Adds ``refers_to``, the page of the response that a revisit names, and ``verified``.

    A response is verified if both its digests are those of its bytes, a revisit if its block's is and the response that it names is there
    with the same payload digest. A damaged record is not.
    """
    target = records.where("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("payload_digest").alias("target_digest"))
    target = target.select(F.reverse("record_id").alias("key"), "refers_to", "target_digest")  # another key than the aggregate's: a hot one can be split
    # never a broadcast: what the planner knows of the size of these records is that of the manifest
    out = records.join(target.hint("merge"), F.reverse("refers_to_id") == F.col("key"), "left").drop("key")
    fine = F.col("block_ok") & F.when(F.col("record_type") == "revisit", F.col("target_digest") == F.col("payload_digest")).otherwise(F.col("payload_ok"))
    return out.withColumn("verified", F.coalesce(fine, F.lit(False))).drop("target_digest")
