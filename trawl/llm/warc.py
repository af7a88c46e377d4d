"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writer: equal payloads are found by their SHA-256 in one aggregation; the join
back carries a row for repeated payloads only. Each task writes files of its own
in the shared folder, a gzip member for each record, and returns a manifest row
for each file it closed. The manifest is written as a table, so a file that a
lost or repeated attempt left behind is never read.

Reader: each record has to pass its checks (version line, header lines, length,
end of record, block digest). After a failure the reader looks for the next
place where a member with a version line (compressed) or a version line
(plain) begins, goes on from there, and logs the bytes between as a gap with its
reason. Records are taken one at a time and handed on as they come, also from a
member that holds many; no header, record, member or file is too long. What
waits in memory is one record as its header states it (never more than is left of
the file), a chunk of it decompressed at a time. A record of a damaged member is
kept if its own digest holds.

Nulls, empty and odd input: a null payload is written empty; a null address is
left out; a null page id is written as such and read back as null, and refers to
the smallest id of its payload, if there is one; rows that repeat the smallest id
of a payload are all responses; an empty table gives no archive and no record;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import fresh_path, written

#: Bytes from which on an equal payload is written as a revisit.
REVISIT_FROM = 100
#: Bytes after which a task begins a new archive.
ROLL = 64_000_000
CHUNK, FLUSH = 1 << 20, 4_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"(?:(?<=\n)|\A)WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
CONTROL = re.compile(rb"[\x00-\x08\x0a-\x1f]")
RECORD = "file string, at long, type string, record_id string, refers_to_id string, uri string, payload_bytes long, payload_digest string, payload binary, gap_to long, reason string"


def open_folder(path: str):
    """The file system of a path or address, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def planned(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, uri, payload, digest, refers_to`` of every row; refers_to is null for a response."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(uri_col).alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = rows.where(F.octet_length("payload") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    # A table of its own: its size is then known, and the payloads are shuffled only if it is too large to broadcast.
    both = rows.join(written(repeated, "warc-repeated"), F.col("digest") == F.col("d"), "left")
    return both.select("page_id", "uri", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(kind: str, page_id, uri: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, not yet compressed."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {re.sub('[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', uri)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str | None = None, compress: bool = True, date: str = "2000-01-01T00:00:00Z", **columns: str) -> DataFrame:
    """Writes ``pages``; returns the manifest: ``file, records, bytes``."""
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = open_folder(folder)
        files.create_dir(inner, recursive=True)
        out, name, count, size = None, "", 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, uri, payload, digest, refers_to = (batch.column(c)[k].as_py() for c in range(5))
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out, count, size = files.open_output_stream(f"{inner}/{name}", compression=None), 0, 0
                data = record("response" if refers_to is None else "revisit", page_id, uri, payload, digest, refers_to, date)
                data = zlib.compress(data, 5, 31) if compress else data
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ROLL:
                    out.close()
                    yield _manifest(folder, name, count, size)
                    out = None
        if out is not None:
            out.close()
            yield _manifest(folder, name, count, size)

    return written(planned(pages, **columns).mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


def _manifest(folder: str, name: str, count: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "records": count, "bytes": size}])


class Plain:
    """Records of an uncompressed stream that arrives in parts. Yields (position, header lines, block) and gaps (from, to, reason).

    ``size``: where the stream ends, if that is known; a record that would end later fails at once.
    """

    def __init__(self, size: int | None = None) -> None:
        self.held, self.at, self.gap, self.reason, self.size = bytearray(), 0, None, "", size
        self.need = self.line = self.looked = 0

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple]:
        self.held += data
        while self.held and (len(self.held) >= self.need or last):
            got = self.take(last)
            if got == "more":
                return
            if got[0] == "bad":
                if self.gap is None:
                    self.gap, self.reason = self.at, got[1]
                found = VERSION.search(self.held, 1)
                drop = found.start() if found else len(self.held) - (0 if last else min(len(self.held) - 1, 16))
                self.skip(max(1, drop))
                if not found and not last:
                    return
            else:
                if self.gap is not None:
                    yield "gap", self.gap, self.at, self.reason
                    self.gap = None
                yield "record", self.at, got[1], got[2]
                self.skip(got[3])
        if last and self.gap is not None:
            yield "gap", self.gap, self.at, self.reason
            self.gap = None

    def skip(self, n: int) -> None:
        del self.held[:n]
        self.at, self.need, self.line, self.looked = self.at + n, 0, 0, 0

    def header(self, last: bool) -> tuple | str:
        """Where the header ends, or what is wrong with it. Lines are looked at once each, as they come; ``line`` is where the next begins."""
        while True:
            end = self.held.find(b"\r\n", max(self.line, self.looked - 1))
            if end == self.line:
                return "ok", end + 2
            if end < 0 and CONTROL.search(self.held, self.line, len(self.held) - self.held.endswith(b"\r")) or end > 0 and (CONTROL.search(self.held, self.line, end) or self.held.find(b":", self.line, end) < 0):
                return "bad", "header line without a colon, or with control characters"
            if end < 0:
                self.looked, self.need = len(self.held), len(self.held) + 1
                return ("bad", "header does not end") if last else "more"
            self.line = self.looked = end + 2

    def take(self, last: bool) -> tuple | str:
        if not self.line:
            start = VERSION.match(self.held)
            if not start:
                return ("bad", "no version line") if last or len(self.held) >= 10 else "more"
            self.start = self.line = start.end()
        got = self.header(last)
        if got[0] != "ok":
            return got
        body, lines = got[1], {}
        for line in bytes(self.held[self.start : body - 4]).split(b"\r\n"):
            name, _, value = line.partition(b":")
            lines[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        length = lines.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            return "bad", "no valid length"
        stop = body + int(length)
        if self.size is not None and self.at + stop + 4 > self.size:
            return "bad", "the record is cut off"
        if len(self.held) < stop + 4:
            self.need = stop + 4
            return ("bad", "the record is cut off") if last else "more"
        if self.held[stop : stop + 4] != b"\r\n\r\n":
            return "bad", "no end of record after its length"
        block = bytes(self.held[body:stop])
        kind, _, digest = lines.get("warc-block-digest", "").partition(":")
        if kind.lower() == "sha256" and digest.lower() != hashlib.sha256(block).hexdigest():
            return "bad", "block digest differs"
        return "ok", lines, block, stop + 4


def salvage(source, compressed: bool) -> Iterator[tuple]:
    """Records and gaps of one open file that can be sought in."""
    size = source.size()
    if not compressed:
        plain, at = Plain(size), 0
        while at < size:
            data = source.read_at(min(CHUNK, size - at), at)
            at += len(data)
            yield from plain.feed(data, at >= size)
        return
    at, gap, why = 0, None, ""
    while at < size:
        for x in (found := Member(source, at, size)):
            if gap is not None:
                yield "gap", gap, at, why
                gap = None
            yield x
        if not found.reason:
            at = found.end
            continue
        # Damaged: what lies between here and the next member that begins as a record is set aside.
        gap, why = (at, found.reason) if gap is None else (gap, why)
        at = next_member(source, found.end or at + 1, size)
    if gap is not None:
        yield "gap", gap, size, why


class Member:
    """The records of the gzip member at ``at``. After them: where it ends (``end``; None: it doesn't), and what is wrong with it (``reason``)."""

    def __init__(self, source, at: int, size: int):
        self.source, self.at, self.size, self.end, self.reason = source, at, size, None, ""

    def __iter__(self) -> Iterator[tuple]:
        plain, waiting = Plain(), None
        try:
            for out, last in self.text():
                for x in plain.feed(out, last):
                    if x[0] == "gap":
                        self.reason = self.reason or x[3]
                        continue
                    if waiting:
                        yield waiting
                    waiting = "record", self.at, *x[2:]
        except zlib.error as e:
            self.end, self.reason = None, f"member: {e}"
        if not waiting and not self.reason:
            self.reason = "no record in the member"
        # The last record has only its own digest to vouch for it if the member's check fails.
        if waiting and (not self.reason or waiting[2].get("warc-block-digest", "").lower().startswith("sha256:")):
            yield waiting

    def text(self) -> Iterator[tuple[bytes, bool]]:
        """The member's text in chunks, and whether they are the last; sets ``end``."""
        unzip, pos = zlib.decompressobj(31), self.at
        while not unzip.eof and pos < self.size:
            data = self.source.read_at(min(CHUNK if pos > self.at else 1 << 16, self.size - pos), pos)
            pos += len(data)
            while True:
                out = unzip.decompress(data, CHUNK)
                data = unzip.unconsumed_tail
                yield out, False
                if unzip.eof or not data and len(out) < CHUNK:
                    break
        if not unzip.eof:
            raise zlib.error("cut off")
        self.end = pos - len(unzip.unused_data)
        yield b"", True


def next_member(source, at: int, size: int) -> int:
    """The first place from ``at`` on where a member begins whose text begins with a version line, else the end."""
    while at < size:
        data = source.read_at(min(CHUNK, size - at), at)
        k = data.find(MAGIC)
        while k >= 0:
            try:
                head = data[k : k + 4096]
                head += source.read_at(min(4096 - len(head), size - at - k - len(head)), at + k + len(head)) if len(head) < 4096 and at + k + len(head) < size else b""
                if VERSION.match(zlib.decompressobj(31).decompress(head, 16)):
                    return at + k
            except zlib.error:
                pass
            k = data.find(MAGIC, k + 1)
        if at + len(data) >= size:
            break
        at += max(1, len(data) - 2)
    return size


def read_archives(manifest: DataFrame, payloads: bool = True, file_col: str = "file") -> DataFrame:
    """Every record and every gap of the files that ``manifest`` names.

    Columns: see ``RECORD``. For a gap, ``type`` is ``gap``, ``at`` and ``gap_to``
    its bytes, ``reason`` the failed check. A response's digest and length are
    those of the payload as read; a revisit's are the ones that it states.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, held = _arrow_schema(), [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, inner = open_folder(name)
                with files.open_input_file(inner) as source:
                    zipped = name.endswith(".gz") or source.read_at(min(3, source.size()), 0) == MAGIC
                    for x in salvage(source, zipped):
                        rows.append(_row(name, x, payloads))
                        held += 200 + len(rows[-1]["payload"] or b"")
                        if held >= FLUSH:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.select(F.col(file_col).alias("file"))
    # A task for each file: by number, since these rows are too small for Spark to keep them apart.
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORD)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORD.split(", "))])


def _row(name: str, x: tuple, payloads: bool) -> dict:
    blank = dict.fromkeys(_arrow_schema().names)
    if x[0] == "gap":
        return blank | {"file": name, "type": "gap", "at": x[1], "gap_to": x[2], "reason": x[3]}
    _, at, lines, block = x
    row = blank | {"file": name, "at": at, "type": lines.get("warc-type"), "record_id": lines.get("warc-record-id"), "refers_to_id": lines.get("warc-refers-to"), "uri": lines.get("warc-target-uri")}
    stated = lines.get("warc-payload-digest", "").partition(":")[2] or None
    if row["type"] == "revisit":
        length = lines.get("x-payload-length")
        return row | {"payload_digest": stated, "payload_bytes": int(length) if length and length.isdigit() else None}
    payload = block
    if "application/http" in lines.get("content-type", ""):
        payload = block.partition(b"\r\n\r\n")[2]
    return row | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload if payloads else None}


def page_of(name: str) -> Column:
    """The page id in a record id of the writer, as a long."""
    return F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")


def pages_read(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, uri`` of the records that ``read_archives`` found."""
    return records.where(F.col("type").isin("response", "revisit")).select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to_id").alias("refers_to"), "uri"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    return pages_read(read_archives(write_archives(pages), payloads=False))
