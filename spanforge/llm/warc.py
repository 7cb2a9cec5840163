"""WARC archives: one gzip member per record, written and read in a stream.

The writer puts records into archives below a shared folder, each task into files of its own; only
files that a task lists in its committed result count, so a lost or repeated task leaves no trace in
the archive. The reader inflates members one after another in bounded pieces, frames each record by
its Content-Length and checks block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _scratch

ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """An archive that doesn't follow the format, or whose digests don't fit."""


def _one_line(x: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in x)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the response's headers, not its payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [
        f"WARC-Block-Digest: sha256:{base64.b32encode(hashlib.sha256(block).digest()).decode()}",
        f"WARC-Payload-Digest: sha256:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


class _Inflated:
    """Bytes of gzip members, inflated as they are asked for."""

    def __init__(self, stream):
        self.stream, self.raw, self.ready, self.member = stream, b"", bytearray(), None

    def next_member(self) -> bool:
        if self.member is not None and not self.member.eof:
            raise WarcError("a record ends before its gzip member")
        if not self.raw:
            self.raw = self.stream.read(PIECE)
        self.member = zlib.decompressobj(31) if self.raw else None
        return self.member is not None

    def _more(self) -> bool:
        if self.member.eof:
            return False
        if not self.raw and not self.member.unconsumed_tail:
            self.raw = self.stream.read(PIECE)
            if not self.raw:
                raise WarcError("the archive ends inside a gzip member")
        feed = self.member.unconsumed_tail + self.raw
        self.raw = b""
        self.ready += self.member.decompress(feed, PIECE)
        if self.member.eof:
            self.raw = self.member.unused_data
        return True

    def line(self) -> bytes:
        while (at := self.ready.find(b"\r\n")) < 0:
            if not self._more():
                raise WarcError("a header line doesn't end")
        out = bytes(self.ready[:at])
        del self.ready[: at + 2]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self._more():
                raise WarcError("a record is shorter than its Content-Length")
            piece = bytes(self.ready[:n])
            del self.ready[: len(piece)]
            n -= len(piece)
            if piece:
                yield piece

    def end(self) -> None:
        while self._more():
            pass
        if self.ready != b"\r\n\r\n":
            raise WarcError("a record is longer than its Content-Length")
        self.ready.clear()


VERSIONS = (b"WARC/1.0", b"WARC/1.1")
#: Bytes of an HTTP head; a longer block without its end in them is payload, a shorter one is all head.
MOST_HEAD = 1 << 20


def _headers(source: _Inflated) -> dict[str, str]:
    out, last = {}, None
    while line := source.line():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and last:  # a folded line goes on with the one before
            out[last] += f" {text.strip()}"
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _page(urn: str | None) -> int | None:
    """The page's number, where this module's writer has named the record."""
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _address(text: str | None) -> str | None:
    """A target as it is, or without the angle brackets of version 1.0."""
    text = text and text.strip()
    return text[1:-1] if text and text[0] == "<" and text[-1] == ">" else text


def _told(head: dict[str, str], name: str) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a digest in base 32 or hexadecimal; None for one that isn't there or of an unknown kind."""
    kind, _, text = head.get(name, "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "sha512", "md5"):
        return None
    size, text = hashlib.new(kind).digest_size, text.strip()
    try:
        return kind, bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError as e:
        raise WarcError(f"{name} can't be read: {text}") from e


def read_stream(stream, keep: bool = True) -> Iterator[dict]:
    """Records of one archive of gzip members, of versions 1.0 and 1.1 and any type.

    ``payload`` is what follows the HTTP head, or the whole block of other content types; None for revisits, and
    without ``keep``, where no record is held in memory. ``payload_bytes`` and ``payload_digest`` (hexadecimal SHA-256)
    are of the full payload; of a revisit they are what it tells, its digest of whatever kind, or None. ``page_id`` and ``refers_to``
    are None for records of other writers. Digests that a record has are checked; one that doesn't fit, and any break of the format, is a WarcError.
    """
    source = _Inflated(stream)
    while source.next_member():
        if source.line() not in VERSIONS:
            raise WarcError("not a WARC record of version 1.0 or 1.1")
        head = _headers(source)
        name, length = head.get("warc-record-id", "a record without id"), head.get("content-length", "")
        if not length.isdigit():
            raise WarcError(f"{name} has no Content-Length")
        told_block, told = _told(head, "warc-block-digest"), _told(head, "warc-payload-digest")
        block = hashlib.new(told_block[0]) if told_block else None
        sha, other = hashlib.sha256(), hashlib.new(told[0]) if told and told[0] != "sha256" else None
        front = bytearray() if head.get("content-type", "").lower().startswith("application/http") else None
        http, payload, size = b"", bytearray(), 0
        for piece in source.exactly(int(length)):
            if block:
                block.update(piece)
            if front is not None:
                front += piece
                at = front.find(b"\r\n\r\n")
                if at < 0 and len(front) < MOST_HEAD:
                    continue
                http, piece, front = (bytes(front[:at]), bytes(front[at + 4 :]), None) if at >= 0 else (b"", bytes(front), None)
            sha.update(piece)
            if other:
                other.update(piece)
            size += len(piece)
            if keep:
                payload += piece
        source.end()
        if front:
            http = bytes(front)
        if block and block.digest() != told_block[1]:
            raise WarcError(f"block digest of {name} doesn't fit")
        kind = head.get("warc-type", "").lower()
        revisit = kind == "revisit"
        if told and not revisit and (other or sha).digest() != told[1]:
            raise WarcError(f"payload digest of {name} doesn't fit")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        full = fields.get(b"content-length", b"")
        yield {
            "page_id": _page(head.get("warc-record-id")), "url": _address(head.get("warc-target-uri")), "record_type": kind,
            "refers_to": _page(head.get("warc-refers-to")) if revisit else None, "payload_bytes": (int(full) if full.isdigit() else None) if revisit else size,
            "payload_digest": (told[1].hex() if told else None) if revisit else sha.hexdigest(), "payload": bytes(payload) if keep and not revisit else None,
        }


def _writer(folder: str, archive_bytes: int, revisits: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _scratch.filesystem(folder)
        out, name, size, count = None, "", 0, 0
        done, known = [], (None, {})
        for batch in batches:
            for i, (row, page_id, url, digest) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True)):
                if known[0] != row >> 33:  # the revisits among the rows of one task of the first pass
                    side = _scratch.read_side_table(f"{revisits}/grp={row >> 33}", ["row", "refers_to"])
                    known = row >> 33, {} if side is None else dict(zip(side.column("row").to_pylist(), side.column("refers_to").to_pylist(), strict=True))
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url, batch.column(3)[i].as_py(), digest, known[1].get(row), row in known[1])
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    out.close()
                    out = done.append((name, count, size))
        if out is not None:
            out.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], names=["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row below ``folder``; returns the list of archives (archive, records, bytes).

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest id is the response and the others revisit it;
    of repeated rows with that id one is. A null payload is empty, a null id is never referred to and
    always a response, a null url has no header, control characters in a url are percent-encoded.

    Rows are numbered and written once to the shared folder; only their numbers, ids and digests are
    shuffled, never payloads.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"),
    )
    rows = _scratch.stored(rows, "pages")
    light = rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).select("row", "page_id", "digest")
    first = light.groupBy("digest").agg(F.min(F.struct("page_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = light.join(first, "digest").where(F.col("row") != F.col("first.row")).select("row", F.col("first.page_id").alias("refers_to"), F.shiftright("row", 33).alias("grp"))
    revisits = _scratch.materialize(again.repartition("grp"), "revisits", partition_by="grp")
    sent = rows.select("row", "page_id", "url", "payload", "digest")
    return _scratch.stored(sent.mapInArrow(_writer(folder, archive_bytes, revisits), "archive string, records long, bytes long"), "archives")


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _scratch.filesystem(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{path}/{archive}", compression=None) as stream:
                    for x in read_stream(stream, with_payload):
                        held.append(x)
                        size += len(x["payload"] or b"") if with_payload else 0
                        if len(held) == 4096 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], t) for c, t in zip(names, kinds, strict=True)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], t) for c, t in zip(names, kinds, strict=True)], names=names)

    return run


def archive_list(spark: SparkSession, folder: str) -> DataFrame:
    """All archives of a folder, for archives that came from elsewhere; their records may be of any type."""
    fs, path = _scratch.filesystem(folder)
    found = [(x.base_name,) for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".warc.gz")]
    return spark.createDataFrame(found, "archive string")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the listed archives, an archive to a task at a time. A damaged archive or a
    digest that doesn't fit fails the read."""
    spark = archives.sparkSession
    names = archives.select("archive")
    dealt = names.repartition(max(2 * spark.sparkContext.defaultParallelism, names.count()), "archive")
    schema = RECORD_SCHEMA if with_payload else RECORD_SCHEMA.removesuffix(", payload binary")
    return dealt.mapInArrow(_reader(folder, with_payload), schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    folder = _scratch.scratch_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **options), folder, with_payload=False)
