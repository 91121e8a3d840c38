"""WARC archives with revisit records, and a reader that salvages damaged ones.

Writing: pages with equal payloads of a least size are told by digest; the page with the
largest id is a response record, the others revisit it. Every task writes one archive of
gzip members, one member per record, under a passing name that is then changed.

Reading: a task walks through an archive member by member (or record by record where it
is not compressed) and checks each: gzip checksum, version line, header, content length,
closing lines, payload digest. Where a check fails, it looks for the next gzip member or
version line that begins a valid record and goes on there; the bytes between are logged
as a gap with the reason. Records after a gap come out whole. An archive is read through a
window, so its size does not matter, only that of one record does.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import folder, staged

#: Payloads below this size are always stored.
LEAST_REVISITED = 1000
VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
WINDOW_BYTES = 1 << 20
STEP_BYTES = 1 << 14
#: Payload bytes after which a batch of records is given out.
BATCH_BYTES = 8 << 20
ENTRIES = "path string, start long, stop long, kind string, reason string, record_type string, record_id string, target string, refers_to string, digest string, payload_length long, payload binary"
DATE = "1970-01-01T00:00:00Z"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. Line breaks in the address are percent-encoded."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload if refers_to is None else b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def revisits(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """Pages (page_id, url, html) with ``digest`` and ``refers_to`` (NULL: stored).

    A NULL html is an empty payload, a NULL page_id is always stored. A page_id may come more than once:
    each of its payloads is judged by itself, and rows of the largest page_id are all stored. Groups are
    counted by partial aggregates and joined back as (page_id, digest, size) rows only; a hot digest is
    split by the adaptive skew join.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    large = rows.where(F.col("size") >= least).select("page_id", "digest", "size")
    groups = large.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = large.join(groups, ["digest", "size"]).where("page_id <> keeper")
    later = later.groupBy("page_id", "digest", "size").agg(F.max("keeper").alias("refers_to"))
    return rows.join(later.hint("shuffle_hash"), ["page_id", "digest", "size"], "left").drop("size")


def write(pages: DataFrame, where: str, least: int = LEAST_REVISITED, level: int = 6) -> DataFrame:
    """Write all pages as archives below ``where``: rows (path, n_records, n_bytes), one per archive, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(f"{where}/part-{TaskContext.get().partitionId():06d}.warc.gz")
        passing, out, records, size = f"{path}.{uuid.uuid4().hex}", None, 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(passing)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page_id, url, html.encode(), digest, refers_to)) + packer.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            out.close()
            store.move(passing, path)
            yield pa.RecordBatch.from_pydict({"path": [f"{where}/{path.rsplit('/', 1)[1]}"], "n_records": [records], "n_bytes": [size]})

    rows = revisits(pages, least).select("page_id", "url", "html", "digest", "refers_to")
    return staged(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


@dataclass
class Entry:
    """A record, or a gap with the reason."""

    start: int
    stop: int
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


class Damaged(Exception):
    """A record or member fails a check."""


class Salvager:
    """Walks through one archive; ``file`` has ``read_at(n, offset)`` and ``size()``."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.base, self.window = 0, b""
        #: From here on no header ends; and the last end found, with the place it was looked for from.
        self.endless, self.ending = self.size, (0, 0)

    def peek(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``."""
        if not (self.base <= at and at + n <= self.base + len(self.window)):
            if n > WINDOW_BYTES:
                return self.file.read_at(n, at)
            self.base, self.window = at, self.file.read_at(WINDOW_BYTES, at)
        return self.window[at - self.base : at - self.base + n]

    def entries(self) -> Iterator[Entry]:
        at = 0
        while at < self.size:
            try:
                entry = self.record(at)
            except Damaged as why:
                entry = self.next_valid(at + 1)
                start = self.size if entry is None else entry.start
                yield Entry(at, start, str(why))
                if entry is None:
                    return
            yield entry
            at = entry.stop

    def record(self, at: int) -> Entry:
        """The valid record that starts at ``at``."""
        head = self.peek(at, 7)
        if head.startswith(MAGIC):
            return self.member(at)
        if head.startswith(VERSION):
            return self.uncompressed(at)
        raise Damaged("no member or version line")

    def member(self, at: int) -> Entry:
        unpack, parts, place = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                step = self.peek(place, STEP_BYTES)
                if not step:
                    raise Damaged("member is cut off")
                first = not parts
                parts.append(unpack.decompress(step))
                place += len(step)
                if first and parts[0] and not parts[0].startswith(VERSION[: len(parts[0])]):
                    raise Damaged("member without a version line")
        except zlib.error as e:
            raise Damaged("member fails its checksum or is malformed") from e
        raw = b"".join(parts)
        stop = place - len(unpack.unused_data)
        headers, begin = self.header(raw)
        length = self.length(headers)
        if raw[begin + length :] != b"\r\n\r\n":
            raise Damaged("content length does not fit")
        return self.checked(Entry(at, stop, None, headers, raw[begin : begin + length]))

    def uncompressed(self, at: int) -> Entry:
        headers, begin = self.header(self.peek(at, self.header_end(at) - at))
        length = self.length(headers)
        block = self.peek(at + begin, length + 4) if at + begin + length + 4 <= self.size else b""
        if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
            raise Damaged("content length does not fit")
        return self.checked(Entry(at, at + begin + length + 4, None, headers, block[:length]))

    def header_end(self, at: int) -> int:
        """The place behind the first empty line from ``at`` on; the archive's size is the only bound."""
        since, end = self.ending
        if since <= at <= end - 4:
            return end
        place = at
        while place < self.endless:
            part = self.peek(place, min(STEP_BYTES, self.size - place))
            found = part.find(b"\r\n\r\n")
            if found >= 0:
                self.ending = (at, place + found + 4)
                return place + found + 4
            if place + len(part) >= self.size:
                break
            place += len(part) - 3
        self.endless = min(self.endless, at)
        raise Damaged("header without an end")

    @staticmethod
    def header(raw: bytes) -> tuple[dict[str, str], int]:
        """Fields (names in lower case) and the place behind the empty line."""
        end = raw.find(b"\r\n\r\n")
        if not raw.startswith(VERSION) or end < 0:
            raise Damaged("header without an end")
        fields = {}
        for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise Damaged("header line without a colon")
            fields[name.strip().lower()] = value.strip()
        return fields, end + 4

    @staticmethod
    def length(headers: dict[str, str]) -> int:
        value = headers.get("content-length", "")
        if not (value.isascii() and value.isdigit()):
            raise Damaged("no content length")
        return int(value)

    @staticmethod
    def checked(entry: Entry) -> Entry:
        """The entry, if its payload has the digest that its header names."""
        kind, _, digest = entry.headers.get("warc-payload-digest", "").partition(":")
        if entry.headers.get("warc-type") != "revisit" and kind == "sha1" and len(digest) == 40 and hashlib.sha1(entry.payload).hexdigest() != digest.lower():
            raise Damaged("payload digest does not fit")
        return entry

    def next_valid(self, at: int) -> Entry | None:
        """The first valid record that starts at ``at`` or later."""
        while at < self.size:
            part = self.peek(at, min(WINDOW_BYTES, self.size - at))
            places = sorted({p for mark in (MAGIC, VERSION) for p in self.marks(part, mark)})
            for p in places:
                try:
                    return self.record(at + p)
                except Damaged:
                    continue
            if at + len(part) >= self.size:
                return None
            at += len(part) - len(VERSION) + 1
        return None

    @staticmethod
    def marks(part: bytes, mark: bytes) -> Iterator[int]:
        p = part.find(mark)
        while p >= 0:
            yield p
            p = part.find(mark, p + 1)


def read(archives: DataFrame) -> DataFrame:
    """Records and gaps of all archives (path): see ``ENTRIES``; ``kind`` is record or gap.

    An empty archive gives nothing, one without a valid record a single gap.
    """
    schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in ENTRIES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(where)
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for e in Salvager(file).entries():
                        h = e.headers.get
                        size = h("warc-payload-length", "")
                        rows.append(
                            {
                                "path": where, "start": e.start, "stop": e.stop, "kind": "record" if e.reason is None else "gap", "reason": e.reason,
                                "record_type": h("warc-type"), "record_id": h("warc-record-id"), "target": h("warc-target-uri"), "refers_to": h("warc-refers-to"),
                                "digest": h("warc-payload-digest"), "payload_length": int(size) if size.isdigit() else len(e.payload), "payload": e.payload,
                            }
                        )
                        held += len(e.payload) + 500
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spread = max(1, archives.count())
    return archives.select("path").repartition(spread, "path").mapInArrow(run, ENTRIES)


def contract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    where = folder(spark, "warc")
    entries = read(write(pages, where if "://" in where else f"file://{where}")).where("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    stored = F.col("record_type") == "response"
    return entries.select(
        number("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
