"""Web archives: ARC files of versions 1 and 2 in, equivalent WARC files out, and back as rows.

An ARC file begins with a version block that names the fields of its header lines; a record is a
header line with the number of bytes that follow.  ``read_arc`` takes records apart by these
declared lengths, ``to_warc`` gives each the identifier, time, type and digests that a WARC
record has, and ``write_warc`` and ``read_warc`` store and restore them.

Files are written by Spark's own writer, a row of the table per file, so a lost task leaves
nothing behind.  A file holds about ``ArchiveRules.volume_bytes`` of records, or a single larger
one, and is read as a whole, unpacked piece by piece.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autoprofile.llm.common import column, settle, shared_folder

#: rows of payload that go to or come from Python together
BATCH_BYTES = 8 << 20
#: bytes that are unpacked at a time
PIECE_BYTES = 1 << 20
#: repeated payloads up to this number are sent to every task, more are joined by a shuffle
BROADCAST_DIGESTS = 100_000

# fixed values of the formats
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset"
    " Filename Archive-length",
}
WARC_VERSION = b"WARC/1.1"
END_OF_RECORD = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_VALUE = "-"
NO_ADDRESS = "0.0.0.0"
#: HTTP header that carries the key of a page through an archive
KEY_HEADER = "X-Page-Id"


@dataclass(frozen=True)
class ArchiveRules:
    #: a payload of fewer bytes is always stored, also where it repeats
    least_shared_bytes: int = 100
    #: when the pages were captured, as ARC files write it
    captured: str = "20000101000000"
    origin: str = "autoprofile"
    #: records of a file, before compression; a task holds one such file
    volume_bytes: int = 16 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh: Callable) -> Iterator:
    """Rows as record batches of about ``BATCH_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _weight(row: tuple) -> int:
    """Bytes of the block, the last of a record's fields."""
    return len(row[-1] or b"")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema
    )


def _volumes(
    records: Iterator[bytes], begin: Callable, between: bytes, most: int
) -> Iterator[bytes]:
    """Records joined into the contents of files.  ``begin``: what the n-th file begins with."""
    number, held, size = 0, [], 0
    for record in records:
        held.append(record)
        size += len(record) + len(between)
        if size >= most:
            yield begin(number) + between.join(held)
            number, held, size = number + 1, [], 0
    if held:
        yield begin(number) + between.join(held)


VOLUME = pa.schema([("value", pa.binary())])


def _write(volumes: DataFrame, folder: str, end: str) -> None:
    """A gzip file per row; ``end`` is what the last record of a file ends with."""
    volumes.select(F.col("value").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).option("lineSep", end).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED"
    ).text(folder)


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of a file, a piece at a time: as they are, or of all gzip members in turn."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + PIECE_BYTES] for i in range(0, len(content), PIECE_BYTES))
        return
    rest = content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            piece = member.decompress(rest, PIECE_BYTES)
            rest = member.unconsumed_tail
            if piece:
                yield piece
            elif not rest and not member.eof:
                raise ValueError("the archive ends inside a gzip member")
        rest = member.unused_data


class Stream:
    """Bytes that arrive in pieces, read by lines and by lengths."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.before = pieces, b"", 0, 0

    @property
    def place(self) -> int:
        """How many bytes were read."""
        return self.before + self.at

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.before += self.at
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None where nothing is left."""
        looked = self.at
        while (end := self.held.find(b"\n", looked)) < 0:
            left = len(self.held) - self.at
            if not self._more():
                rest, self.at = self.held[self.at :], len(self.held)
                return rest or None
            looked = self.at + left
        text, self.at = self.held[self.at : end], end + 1
        return text.removesuffix(b"\r")

    def take(self, size: int) -> bytes:
        parts = []
        while size > 0:
            part = self.held[self.at : self.at + size]
            if part:
                parts.append(part)
                self.at += len(part)
                size -= len(part)
            elif not self._more():
                raise ValueError("the archive ends inside a record")
        return b"".join(parts)

    def until_blank(self) -> list[bytes]:
        lines = []
        while line := self.line():
            lines.append(line)
        return lines


# ------------------------------------------------------------------------------------- ARC


def _http(key: int | None, payload: bytes) -> bytes:
    """The response of a server that gives a page."""
    own = "" if key is None else f"{KEY_HEADER}: {key}\r\n"
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n{own}\r\n"
    )
    return head.encode() + payload


def _pages_as_arc(rules: ArchiveRules) -> Callable:
    """The pages of a task as ARC files, of version 1 and 2 by turns."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = 0

        def name(n: int) -> str:
            return f"pages-{task:06d}-{n:06d}.arc"

        def begin(n: int) -> bytes:
            nonlocal number
            number = n + 1
            version = 1 + (task + n) % 2
            body = f"{version} 0 {rules.origin}\n{ARC_FIELDS[version]}\n"
            head = f"filedesc://{name(n)} {NO_ADDRESS} {rules.captured} text/plain {len(body)}\n"
            return (head + body + "\n").encode()

        def records() -> Iterator[bytes]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    part = batch.slice(start, 64)
                    payloads = part.column("html").cast(pa.binary()).to_pylist()
                    keys, urls = (part.column(x).to_pylist() for x in ("id", "url"))
                    for key, url, payload in zip(keys, urls, payloads):
                        payload = payload or b""
                        body = _http(key, payload)
                        line = {
                            "URL": quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else NO_VALUE,
                            "IP-address": NO_ADDRESS,
                            "Archive-date": rules.captured,
                            "Content-type": "text/html",
                            "Result-code": "200",
                            "Checksum": hashlib.md5(payload).hexdigest(),
                            "Location": NO_VALUE,
                            "Offset": "0",
                            "Filename": name(number),
                            "Archive-length": str(len(body)),
                        }
                        fields = ARC_FIELDS[1 + (task + number) % 2].split()
                        yield " ".join(line[f] for f in fields).encode() + b"\n" + body

        for volume in _volumes(records(), begin, b"\n", rules.volume_bytes):
            yield _batch([(volume,)], VOLUME)

    return write


def write_arc(
    pages: DataFrame, folder: str, rules: ArchiveRules = ArchiveRules(),
    key: str = "page_id", url: str = "url", html: str = "html",
) -> None:
    """Pages as a folder of ARC files, each page the response of a server to its URL.

    A null key is left out of the record, a null or empty URL is written as ``-``, a null page
    is empty.  Characters that a header line cannot hold are percent-encoded.
    """
    source = pages.select(
        column(pages, key).cast("long").alias("id"),
        column(pages, url).cast("string").alias("url"),
        column(pages, html).cast("string").alias("html"),
    )
    _write(source.mapInArrow(_pages_as_arc(rules), "value binary"), folder, "\n")


ARC_RECORD = pa.schema([
    ("path", pa.string()), ("place", pa.int64()), ("version", pa.int32()), ("url", pa.string()),
    ("address", pa.string()), ("date", pa.string()), ("mime", pa.string()),
    ("block", pa.binary()),
])
ARC_COLUMNS = (
    "path string, place long, version int, url string, address string, date string,"
    " mime string, block binary"
)


def arc_records(path: str, pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The records of a file, by the fields that its version block names."""
    stream = Stream(pieces)
    fields, version = ARC_FIELDS[1].split(), 1
    while True:
        place = stream.place
        line = stream.line()
        if line is None:
            return
        if not line.strip():
            continue  # records are set off by line ends
        text = line.decode("utf-8", "replace")
        if text.startswith("filedesc:"):
            own, _, names = stream.take(int(text.split()[-1])).decode().partition("\n")
            version = int(own.split()[0])
            fields = names.split("\n")[0].split() or ARC_FIELDS[version].split()
            continue
        # a URL of old crawlers may hold spaces: all other fields are counted from the end
        values = text.rsplit(" ", len(fields) - 1)
        if len(values) < len(fields) or not values[-1].isdigit():
            raise ValueError(f"{path} has no record at byte {place}: {text[:80]!r}")
        named = dict(zip(fields, values))
        yield (
            path, place, version, named["URL"], named["IP-address"], named["Archive-date"],
            named["Content-type"], stream.take(int(values[-1])),
        )


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("path")[i].as_py(), batch.column("content")[i].as_py()


def _read_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (
        record for path, content in _files(batches)
        for record in arc_records(path, _unpacked(content))
    )
    yield from _batches(rows, ARC_RECORD, _weight)


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the ARC files in a folder, plain or gzip, in one or many members.

    Columns: path and place tell where the record lies, then the version of the file, the header
    fields as they are written, and the block.  A record that ends early or has no length is an
    error that names the file.
    """
    return _contents(spark, folder).mapInArrow(_read_arc, ARC_COLUMNS)


# ------------------------------------------------------------------------------------ WARC

WARC_RECORD = pa.schema([
    ("record_id", pa.string()), ("key", pa.int64()), ("type", pa.string()), ("url", pa.string()),
    ("address", pa.string()), ("date", pa.string()), ("mime", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("block_digest", pa.string()), ("refers_to", pa.string()), ("refers_to_url", pa.string()),
    ("refers_to_date", pa.string()), ("block", pa.binary()),
])
WARC_COLUMNS = (
    "record_id string, key long, type string, url string, address string, date string,"
    " mime string, payload_bytes long, payload_digest string, block_digest string,"
    " refers_to string, refers_to_url string, refers_to_date string, block binary"
)
TIME = re.compile(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head, with the blank line, and payload of a response; a block that is none has no head."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank:
        head, blank, payload = block.partition(b"\n\n")
    return head + blank, payload


def http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("latin-1").splitlines()[1:]
    pairs = (line.partition(":") for line in lines if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _whole_number(text: str | None) -> int | None:
    """A 64-bit number, or None where the text is none."""
    number = int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def record_id(path: str, place: int) -> str:
    """The same identifier whenever the same record of the same file is converted."""
    name = hashlib.sha256(f"{path} {place}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>"


def warc_time(date: str) -> str:
    """ARC dates have 14 digits, in old files 12; what is missing is zero."""
    found = TIME.match(date.ljust(14, "0"))
    if not found:
        return "1970-01-01T00:00:00Z"
    year, month, day, *clock = found.groups()
    return f"{year}-{month}-{day}T{':'.join(clock)}Z"


def _converted(arc: tuple, with_blocks: bool) -> tuple:
    path, place, _, url, address, date, mime, block = arc
    head, payload = split_http(block)
    return (
        record_id(path, place),
        _whole_number(http_fields(head).get(KEY_HEADER.lower())),
        "response" if head else "resource",
        None if url == NO_VALUE else url,
        None if address in (NO_VALUE, NO_ADDRESS) else address,
        warc_time(date),
        "application/http;msgtype=response" if head else mime,
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        hashlib.sha256(block).hexdigest() if with_blocks else None,
        None, None, None,
        block if with_blocks else None,
    )


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (
        _converted(tuple(batch.column(n)[i].as_py() for n in ARC_RECORD.names), True)
        for batch in batches for i in range(batch.num_rows)
    )
    yield from _batches(rows, WARC_RECORD, _weight)


def _convert_files(with_blocks: bool) -> Callable:
    """Files of ARC records straight to WARC records, so that blocks pass through Python once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            _converted(record, with_blocks)
            for path, content in _files(batches)
            for record in arc_records(path, _unpacked(content))
        )
        yield from _batches(rows, WARC_RECORD, _weight)

    return run


def arc_as_warc(spark: SparkSession, folder: str, with_blocks: bool = True) -> DataFrame:
    """``to_warc(read_arc(spark, folder))`` in one step, on request without the blocks."""
    return _contents(spark, folder).mapInArrow(_convert_files(with_blocks), WARC_COLUMNS)


def to_warc(arc: DataFrame) -> DataFrame:
    """ARC records as equivalent WARC records, all of them whole.

    The identifier is a name for file and place, the time the archive date, the type response
    for what a server sent and resource for anything else, the digests SHA-256 of payload and
    block.  ``key`` is what the page header of the response says, null where it says nothing.
    """
    return arc.mapInArrow(_convert, WARC_COLUMNS)


def _heads_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Revisits keep the head of the response, not its payload."""
    for batch in batches:
        later = [i for i, kind in enumerate(batch.column("type").to_pylist()) if kind == "revisit"]
        if later:
            blocks, digests = (batch.column(x).to_pylist() for x in ("block", "block_digest"))
            for i in later:
                blocks[i] = split_http(blocks[i])[0]
                digests[i] = hashlib.sha256(blocks[i]).hexdigest()
            batch = batch.set_column(
                batch.schema.get_field_index("block"), "block", pa.array(blocks, pa.binary())
            ).set_column(
                batch.schema.get_field_index("block_digest"), "block_digest", pa.array(digests)
            )
        yield batch


def share_payloads(
    records: DataFrame, rules: ArchiveRules = ArchiveRules(), slim: DataFrame | None = None
) -> DataFrame:
    """Responses whose payload an earlier one has become revisits that refer to it.

    ``slim``: the same records without their blocks, where these need not be made to count.

    Earlier is the smaller key, a null key last, then the smaller identifier.  Digests are counted
    without the payloads; only payloads that repeat are looked up again, from a list in every
    task while that is short, else by a shuffle.
    """
    place = F.struct(F.col("key").isNull(), "key", "record_id", "url", "date")
    repeated = settle(
        (records if slim is None else slim)
        .filter((F.col("type") == "response")
                & (F.col("payload_bytes") >= rules.least_shared_bytes))
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(place).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("payload_digest", "payload_bytes", "first")
    )
    few = repeated.count() <= BROADCAST_DIGESTS
    joined = records.join(
        F.broadcast(repeated) if few else repeated.hint("shuffle_merge"),
        ["payload_digest", "payload_bytes"], "left",
    )
    later = (
        (F.col("type") == "response")
        & F.col("first").isNotNull()
        & (F.col("record_id") != F.col("first.record_id"))
    )
    marked = joined.withColumns({
        "type": F.when(later, F.lit("revisit")).otherwise(F.col("type")),
        "refers_to": F.when(later, F.col("first.record_id")),
        "refers_to_url": F.when(later, F.col("first.url")),
        "refers_to_date": F.when(later, F.col("first.date")),
    })
    return marked.select(*WARC_RECORD.names).mapInArrow(_heads_only, WARC_COLUMNS)


HEADERS = {
    # fixed names of the format, and the column that each has
    "WARC-Type": "type", "WARC-Record-ID": "record_id", "WARC-Date": "date",
    "WARC-Target-URI": "url", "WARC-IP-Address": "address",
    "WARC-Payload-Digest": "payload_digest", "WARC-Block-Digest": "block_digest",
    "WARC-Refers-To": "refers_to", "WARC-Refers-To-Target-URI": "refers_to_url",
    "WARC-Refers-To-Date": "refers_to_date", "Content-Type": "mime",
}


def warc_record(row: dict) -> bytes:
    lines = [WARC_VERSION.decode()]
    for header, name in HEADERS.items():
        value = row[name]
        if value is not None:
            lines.append(f"{header}: {'sha256:' if header.endswith('Digest') else ''}{value}")
    if row["type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines.append(f"Content-Length: {len(row['block'])}")
    return "\r\n".join(lines).encode() + END_OF_RECORD + row["block"]


def _warc_volumes(rules: ArchiveRules) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (
            warc_record({n: batch.column(n)[i].as_py() for n in batch.schema.names})
            for batch in batches for i in range(batch.num_rows)
        )
        task = TaskContext.get().partitionId()
        volumes = _volumes(records, _warc_begin(task), END_OF_RECORD, rules.volume_bytes)
        for volume in volumes:
            yield _batch([(volume,)], VOLUME)

    return write


def _warc_begin(task: int) -> Callable:
    """What the n-th file of a task begins with."""

    def begin(number: int) -> bytes:
        body = b"software: autoprofile\r\nformat: WARC File Format 1.1\r\n"
        name = f"pages-{task:06d}-{number:06d}.warc"
        info = {
            **dict.fromkeys(HEADERS.values()), "type": "warcinfo", "block": body,
            "record_id": record_id(name, -1), "date": "1970-01-01T00:00:00Z",
            "mime": "application/warc-fields",
            "block_digest": hashlib.sha256(body).hexdigest(),
        }
        return warc_record(info) + END_OF_RECORD

    return begin


def write_warc(
    records: DataFrame, folder: str, rules: ArchiveRules = ArchiveRules()
) -> None:
    """Records as a folder of gzip WARC files, each beginning with a warcinfo record."""
    volumes = records.mapInArrow(_warc_volumes(rules), "value binary")
    _write(volumes, folder, END_OF_RECORD.decode())


def warc_records(path: str, pieces: Iterator[bytes]) -> Iterator[dict]:
    """The records of a file; blocks whose digest differs from the declared one are an error."""
    stream = Stream(pieces)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path} has no record before byte {stream.place}: {line[:80]!r}")
        fields: dict[str, str] = {}
        for text in stream.until_blank():
            name, _, value = text.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.take(int(fields["content-length"]))
        row = {name: fields.get(header.lower()) for header, name in HEADERS.items()}
        for name in ("payload_digest", "block_digest"):
            row[name] = row[name].partition(":")[2] if row[name] else None
        if row["block_digest"] not in (None, hashlib.sha256(block).hexdigest()):
            raise ValueError(f"{path}: the block of {row['record_id']} was changed")
        yield row | {"block": block}


def _read_warc(
    batches: Iterator[pa.RecordBatch], with_blocks: bool = True
) -> Iterator[pa.RecordBatch]:
    def checked(path: str, row: dict) -> tuple:
        head, payload = split_http(row["block"])
        named = http_fields(head)
        row["key"] = _whole_number(named.get(KEY_HEADER.lower()))
        if row["type"] == "revisit":
            row["payload_bytes"] = _whole_number(named.get("content-length"))
        else:
            row["payload_bytes"] = len(payload)
            whole = hashlib.sha256(payload).hexdigest()
            if row["payload_digest"] not in (None, whole):
                raise ValueError(f"{path}: the payload of {row['record_id']} was changed")
            row["payload_digest"] = whole
        if not with_blocks:
            row["block"] = None
        return tuple(row[n] for n in WARC_RECORD.names)

    rows = (
        checked(path, row) for path, content in _files(batches)
        for row in warc_records(path, _unpacked(content))
    )
    yield from _batches(rows, WARC_RECORD, _weight)


def read_warc(spark: SparkSession, folder: str, with_blocks: bool = True) -> DataFrame:
    """Every record of the WARC files in a folder but for the warcinfo ones.

    Blocks are checked, and left out of the result if not wanted.  Digests are held against blocks and payloads; a revisit has the payload's digest and length
    as the record it refers to had them.
    """
    read = partial(_read_warc, with_blocks=with_blocks)
    records = _contents(spark, folder).mapInArrow(read, WARC_COLUMNS)
    return records.filter("type <> 'warcinfo'")


def convert(spark: SparkSession, arc_folder: str, rules: ArchiveRules = ArchiveRules()) -> str:
    """The ARC files of a folder as WARC files in a new shared folder, whose name is returned."""
    folder = shared_folder(spark)
    slim = arc_as_warc(spark, arc_folder, with_blocks=False)
    write_warc(share_payloads(arc_as_warc(spark, arc_folder), rules, slim), folder, rules)
    return folder


def archive_pages(
    pages: DataFrame, rules: ArchiveRules = ArchiveRules(),
    key: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """One row per page, from the WARC files it was written to by way of ARC files.

    Columns: the key, payload_bytes, payload_digest, record_type, refers_to (the key of the
    response that a revisit refers to), and more of the record.  Of equal payloads of at least
    ``rules.least_shared_bytes`` the one with the smallest key is the response, a null key last; of
    rows that repeat key and payload exactly one is.  A null page is empty; a null key stays
    null.  Other columns are not read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc = shared_folder(spark)
    write_arc(pages, arc, rules, key, url, html)
    warc = convert(spark, arc, rules)
    records = settle(read_warc(spark, warc, with_blocks=False).drop("block"))
    wanted = records.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("own"))
    responses = records.select(F.col("record_id").alias("own"), F.col("key").alias("response"))
    referred = responses.join(wanted.distinct(), "own")
    # records that refer to nothing are joined by their own identifier, which spreads them
    own = F.coalesce("refers_to", "record_id")
    return records.withColumn("own", own).join(referred, "own", "left").select(
        F.col("key").alias(key),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), F.col("response")).alias("refers_to"),
        "record_id",
        "date",
    )
