"""WARC archives: writing, the normaliser of monolithic gzip files, and reading by offset.

``write_archives`` lets every task write its rows as records into files that are one gzip stream each.
``normalise`` inflates such a stream once, from front to end in pieces, rewrites every record as a gzip member
of its own, and writes a sidecar index with each member's offset and length. ``read_archives`` reads the
members back through the sidecars. No file passes through the driver or whole through memory.

Files go to a folder that driver and executors share; the paths are opened through ``pyarrow.fs``, so any
scheme it knows will do. Every attempt of a task writes files of its own name and returns their paths; the
paths that count are those in the committed table of results, so a lost or repeated attempt leaves at most
files that no table names.

Defined results: a null payload is empty; records of equal payload of at least ``least_bytes`` bytes have one
response, the one with the largest page id (of equal rows one is the response), the others are revisits
without payload that name it; smaller ones are all responses; an empty table gives no archives. Ids are 64-bit
integers throughout, and a null id is written and read back as null. A task holds one payload while writing, pieces
of one while normalising, and one record while reading. Columns other than ``page_id, url, html`` are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import partitions
from ebbtide.session import ensure_checkpoint_dir, materialize

GZIP = 31
CHUNK = 1 << 18
ARCHIVE_BYTES = 64 << 20
WRITTEN = "path string, records long, bytes long"
NORMALISED = "path string, sidecar string, records long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, path string, offset long"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
RECORD_FIELDS = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in RECORD.split(", ")])
STAMP = datetime(2020, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def open_path(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _pair() -> list:
    """Page id and payload digest as one key; a null id is a value of its own."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    return [F.coalesce(F.col("page_id").cast("string"), F.lit("?")), F.sha1(payload)]


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, digest, winner, copies``: hex SHA-1, page id of the response, rows of this id and payload.

    Payloads never meet: only (digest, page id) pairs are grouped, combined on the map side. They are joined
    back on both together, so copies of one payload spread over all tasks and the html is shuffled once, by a
    merge join at every size. ``winner`` is null for payloads that occur once or are too short.
    """
    narrow = pages.select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("size"), _pair()[1].alias("digest"))
    pairs = materialize(narrow.groupBy("page_id", "digest").agg(F.count("*").alias("copies"), F.max("size").alias("size")))
    groups = pairs.groupBy("digest").agg(F.max("page_id").alias("winner"), F.sum("copies").alias("n"))
    shared = groups.where("n > 1").select(F.col("digest").alias("shared"), "winner")
    revisits = pairs.where(F.col("size") >= least_bytes).join(shared, F.col("digest") == F.col("shared"))
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("?")), "digest")
    revisits = revisits.select(key.alias("own_key"), "winner", "copies")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.concat_ws(":", *_pair()).alias("key"))
    joined = rows.join(revisits.hint("merge"), F.col("key") == F.col("own_key"), "left")
    return joined.select("page_id", "url", "html", F.substring_index("key", ":", -1).alias("digest"), "winner", "copies")


def record_bytes(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``refers_to`` set) keeps the HTTP head and no payload."""
    payload = html.encode("utf-8", "replace")
    head = HTTP.format(len(payload)).encode()
    body = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {STAMP}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` as monolithic gzip archives into ``folder``; returns the table of files.

    Rows that repeat both page id and payload are gathered by both and sorted, so exactly one of them is the
    response; all others stay where the decision left them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_path(folder)
        sink = packer = path = None
        records = size = 0
        before = None
        for batch in batches:
            for page_id, url, html, digest, winner in zip(*batch.columns, strict=True):  # ids stay integers, one html is held
                page_id, digest, winner = page_id.as_py(), digest.as_py(), winner.as_py()
                first, before = (page_id, digest) != before, (page_id, digest)
                revisit = winner is not None and not (winner == page_id and first)
                if sink is None:
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink, packer = system.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP)
                record = record_bytes(page_id, url.as_py(), html.as_py(), digest, winner if revisit else None)
                sink.write(packer.compress(record))
                records, size = records + 1, size + len(record)
                if size >= archive_bytes:
                    sink.write(packer.flush())
                    sink.close()
                    sink = None
                    yield _row(path=path, records=records, bytes=size)
        if sink is not None:
            sink.write(packer.flush())
            sink.close()
            yield _row(path=path, records=records, bytes=size)

    decided = decide(pages, least_bytes)
    once = decided.where(F.coalesce("copies", F.lit(1)) == 1)
    repeated = decided.where("copies > 1").repartition(partitions(pages.sparkSession), "page_id", "digest")
    dealt = once.unionByName(repeated.sortWithinPartitions("page_id", "digest", "url"))
    return materialize(dealt.select("page_id", "url", "html", "digest", "winner").mapInArrow(write, WRITTEN))


class Inflater:
    """Reads a gzip file of one or many members as one stream, piece by piece."""

    def __init__(self, source):
        self.source, self.engine, self.pending, self.buffer = source, None, b"", bytearray()

    def more(self) -> bool:
        """Add the next piece to the buffer; False at the end of the file. Zero bytes after a member are padding."""
        while True:
            data, self.pending = self.pending or self.source.read(CHUNK), b""
            if self.engine is None:
                if not data:
                    return False
                if not (data := data.lstrip(b"\0")):
                    continue
                self.engine = zlib.decompressobj(GZIP)
            piece = self.engine.decompress(data, CHUNK)
            if not data and not piece and not self.engine.eof:
                raise ValueError("the gzip stream ends inside a member")
            self.pending = self.engine.unconsumed_tail or self.engine.unused_data
            if self.engine.eof:
                self.engine = None
            if piece:
                self.buffer += piece
                return True

    def line_block(self) -> bytes | None:
        """The header of the next record with its blank line; None at the end."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        block = bytes(self.buffer[: end + 4])
        del self.buffer[: end + 4]
        return block

    def body(self, size: int) -> Iterator[bytes]:
        """Exactly ``size`` bytes in pieces."""
        while size:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends inside a record")
            piece = bytes(self.buffer[:size])
            del self.buffer[:size]
            size -= len(piece)
            yield piece


def fields_of(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines if line)}


def normalise_file(source, sink) -> Iterator[dict]:
    """Rewrite a whole-file gzip stream as one member per record; yields offset, length and main fields of each."""
    stream, offset = Inflater(source), 0
    while (block := stream.line_block()) is not None:
        fields = fields_of(block)
        packer, length = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0

        def put(data: bytes) -> int:
            sink.write(data)
            return len(data)

        length += put(packer.compress(block))
        for piece in stream.body(int(fields["content-length"]) + 4):
            length += put(packer.compress(piece))
        length += put(packer.flush())
        yield {"offset": offset, "length": length, "type": fields["warc-type"], "url": fields.get("warc-target-uri", ""), "digest": fields.get("warc-payload-digest", "")}
        offset += length


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive of ``path`` record by record into ``folder``; returns new paths and sidecars."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_path(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                with (
                    system.open_input_stream(path, compression=None) as source,
                    system.open_output_stream(target, compression=None) as sink,
                    system.open_output_stream(target + ".cdxj", compression=None) as sidecar,
                ):
                    for entry in normalise_file(source, sink):
                        sidecar.write(json.dumps(entry).encode() + b"\n")
                        n += 1
                yield _row(path=target, sidecar=target + ".cdxj", records=n)

    dealt = archives.select("path").repartition(partitions(archives.sparkSession), "path")
    return materialize(dealt.mapInArrow(rewrite, NORMALISED))


def parse_record(data: bytes) -> dict:
    """A member's record as a dictionary; the payload's digest is computed anew where there is a payload."""
    block, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(block + b"\r\n\r\n")
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    page = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    refers = fields.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(fields_of(http + b"\r\n")["content-length"])
    revisit = fields["warc-type"] == "revisit"
    if not revisit:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != stated or size != len(payload):
            raise ValueError(f"the payload of page {page} differs from its digest")
    return {
        "page_id": int(page) if page else None,
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": fields["warc-type"],
        "refers_to": int(refers) if refers else None,
        "url": fields.get("warc-target-uri", ""),
        "payload": None if revisit else payload,
    }


def read_archives(normalised: DataFrame, payloads: bool = True) -> DataFrame:
    """Read all records through the sidecars, each member inflated on its own and checked against its digest."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, _ = fs.FileSystem.from_uri(path) if "://" in path else (open_path(root)[0], path)
                held, size = [], 0
                with system.open_input_stream(sidecar, compression=None) as lines, system.open_input_file(path) as archive:
                    for line in _lines(lines):
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        record = parse_record(zlib.decompress(archive.read(entry["length"]), GZIP))
                        size += record["payload_bytes"] + 256
                        held.append(record | {"path": path, "offset": entry["offset"]} | ({} if payloads else {"payload": None}))
                        if size >= CHUNK * 16:
                            yield pa.RecordBatch.from_pylist(held, RECORD_FIELDS)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, RECORD_FIELDS)

    root = archive_root(normalised.sparkSession)
    return normalised.select("path", "sidecar").repartition(partitions(normalised.sparkSession), "path").mapInArrow(read, RECORD)


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values])


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(CHUNK):
        *lines, rest = (rest + data).split(b"\n")
        yield from lines
    if rest:
        yield rest


def archive_root(spark) -> str:
    """A URI of the shared folder; a bare path is a local one."""
    folder = ensure_checkpoint_dir(spark)
    return folder if "://" in folder else f"file://{folder.removeprefix('file:')}"


def new_folder(spark, name: str) -> str:
    """A new folder for archives below the shared folder of the session."""
    folder = f"{archive_root(spark)}/{name}-{uuid.uuid4().hex}"
    system, path = open_path(folder)
    system.create_dir(path, recursive=True)
    return folder
