"""Web archives in ZIP packages: WARC records written, found again by index, and read by range.

A package is a ZIP file with two stored members: `archive/data.warc`, the records one after the
other, and `indexes/index.tsv`, one line per record with its id, offset and length within the
archive member. The reader parses the end record, the ZIP64 records where a field overflows, and the
central directory; the local header of a stored member then gives where its bytes begin. Index and records are
read by byte range; no member is ever extracted.

Packages are cut at `PACKAGE_BYTES` and lie in a shared folder. Writer tasks name them by their
input partition, so a repeated task replaces its own files.

Defined results: a null html is the empty payload; rows with the same id and payload are both kept; payloads
of at least `LEAST` bytes that occur with a null id only are all responses; an empty table gives no packages.
Only the id, URL and payload columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from struct import calcsize

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.sizing import MAX_BROADCAST_ROWS, settle

PACKAGE_BYTES = 64 << 20
LEAST = 100
GAP = 64 << 10  # records closer than this are fetched in one range
# Layouts of the ZIP format.
END = "<4s4H2IH"
END64 = "<4sQ2H2I4Q"
LOCATOR64 = "<4sIQI"
ENTRY = "<4s6H3I5H2I"
LOCAL = "<4s5H3I2H"
ARCHIVE, INDEX = "archive/data.warc", "indexes/index.tsv"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


# ---- ZIP ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ZipReader:
    """Members of a ZIP file by range reads; `reads` counts the bytes fetched."""

    def __init__(self, path: str):
        system, name = open_path(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()
        self.reads = 0

    def __enter__(self) -> ZipReader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def fetch(self, start: int, length: int) -> bytes:
        if start < 0 or start + length > self.size:
            raise ValueError(f"range {start}+{length} lies outside a file of {self.size} bytes")
        self.reads += length
        return self.file.read_at(length, start)

    def directory(self) -> tuple[int, int, int]:
        """Where the central directory begins, its bytes and its entries."""
        tail_size = min(self.size, calcsize(END) + FULL16)
        tail = self.fetch(self.size - tail_size, tail_size)
        mark = b"PK\x05\x06"
        at = tail.rfind(mark, 0, max(0, len(tail) - calcsize(END) + len(mark)))
        while at >= 0 and at + calcsize(END) + struct.unpack_from(END, tail, at)[7] != len(tail):
            at = tail.rfind(mark, 0, at + len(mark) - 1)
        if at < 0:
            raise ValueError("no end record: not a ZIP file, or a cut one")
        _, _, _, _, entries, size, start, _ = struct.unpack_from(END, tail, at)
        if entries == FULL16 or FULL32 in (size, start):
            where = self.size - tail_size + at - calcsize(LOCATOR64)
            found, _, end64, _ = struct.unpack(LOCATOR64, self.fetch(where, calcsize(LOCATOR64)))
            if found != b"PK\x06\x07":
                raise ValueError("a field overflows, but there is no ZIP64 locator")
            fields = struct.unpack(END64, self.fetch(end64, calcsize(END64)))
            if fields[0] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where the locator points")
            entries, size, start = fields[7], fields[8], fields[9]
        return start, size, entries

    def members(self) -> dict[str, Member]:
        start, size, entries = self.directory()
        raw, at, found = self.fetch(start, size), 0, {}
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            head = struct.unpack_from(ENTRY, raw, at)
            method, stored, plain = head[4], head[8], head[9]
            name_size, extra_size, note_size, header = head[10], head[11], head[12], head[16]
            at += calcsize(ENTRY)
            name = raw[at : at + name_size].decode("utf-8", "replace")
            wide = wide_fields(raw[at + name_size : at + name_size + extra_size], [plain, stored, header])
            found[name] = Member(name, method, wide[0], wide[1], wide[2])
            at += name_size + extra_size + note_size
        return found

    def data_start(self, member: Member) -> int:
        """First byte of a stored member; its local header may differ in length from the directory's."""
        if member.method != 0:
            raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
        head = struct.unpack(LOCAL, self.fetch(member.header, calcsize(LOCAL)))
        if head[0] != b"PK\x03\x04":
            raise ValueError(f"no local header for {member.name}")
        return member.header + calcsize(LOCAL) + head[9] + head[10]


def wide_fields(extra: bytes, values: list[int]) -> list[int]:
    """`values` with those that overflow 32 bits taken from the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<2H", extra, at)
        if tag == 1:
            place, out = at + 4, []
            for value in values:
                if value == FULL32:
                    value = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
                out.append(value)
            return out
        at += 4 + size
    return values


def write_zip(sink, members: list[tuple[str, bytes]], zip64: bool = False) -> None:
    """Stored members one after the other; ZIP64 records where needed or asked for."""
    at, entries = 0, []
    for name, data in members:
        raw, crc, wide = name.encode(), zlib.crc32(data), zip64 or len(data) >= FULL32
        size = FULL32 if wide else len(data)
        extra = struct.pack("<2H2Q", 1, 16, len(data), len(data)) if wide else b""
        sink.write(struct.pack(LOCAL, b"PK\x03\x04", 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)))
        sink.write(raw + extra)
        sink.write(data)
        far = wide or at >= FULL32
        more = struct.pack("<2H3Q", 1, 24, len(data), len(data), at) if far else b""
        sizes = (FULL32, FULL32) if far else (len(data), len(data))
        version = 45 if far else 20
        place = FULL32 if far else at
        entries.append(
            struct.pack(ENTRY, b"PK\x01\x02", version, version, 0x800, 0, 0, 33, crc, *sizes, len(raw), len(more), 0, 0, 0, 0, place)
            + raw
            + more
        )
        at += calcsize(LOCAL) + len(raw) + len(extra) + len(data)
    directory = b"".join(entries)
    sink.write(directory)
    count, size, start = len(entries), len(directory), at
    if zip64 or count >= FULL16 or max(size, start) >= FULL32:
        sink.write(struct.pack(END64, b"PK\x06\x06", calcsize(END64) - 12, 45, 45, 0, 0, count, count, size, start))
        sink.write(struct.pack(LOCATOR64, b"PK\x06\x07", 0, start + size, 1))
        count, size, start = FULL16, FULL32, FULL32
    sink.write(struct.pack(END, b"PK\x05\x06", 0, 0, count, count, size, start, 0))


# ---- WARC -----------------------------------------------------------------------------------------


def record_id(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def key_of(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def warc_record(key, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with its payload, or a revisit that has only the HTTP header of what it met."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [
            f"WARC-Refers-To: {record_id(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def parse_record(raw: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes]:
    """(id, URL, payload bytes, digest, type, id referred to, payload) of one record.

    A response's payload is checked against its digest; a revisit tells the size in its HTTP header.
    """
    if not raw.startswith(b"WARC/1."):
        raise ValueError("no WARC record where the index points")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = headers_of(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    size = int(headers_of(http)["content-length"])
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    key, other = key_of(fields["warc-record-id"]), key_of(fields.get("warc-refers-to"))
    return key, fields["warc-target-uri"], size, digest, fields["warc-type"], other, payload


# ---- Spark ----------------------------------------------------------------------------------------


def plan_records(
    pages: DataFrame, key: str, payload: str, url: str | None, least: int = LEAST, max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """(key, url, payload, digest, refers_to): who holds each payload and who revisits it.

    Only digests and keys are shuffled to find payloads that repeat. The most frequent of these, `max_rows` at
    most, are broadcast; a payload moves only if its digest may be one of the others.
    """
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    link = F.col(url).cast("string") if url else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("key"), link.alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= least
    firsts = rows.where(long_enough).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = settle(firsts.where((F.col("n") > 1) & F.col("first").isNotNull()))
    few = firsts.count() <= max_rows
    frequent = firsts if few else settle(firsts.orderBy(F.desc("n"), "digest").limit(max_rows))
    rows = rows.join(F.broadcast(frequent.select("digest", "first")), "digest", "left")
    if not few:
        rows = with_rare(rows, firsts.join(F.broadcast(frequent.select("digest")), "digest", "left_anti"))
    met = F.col("key").isNull() | (F.col("key") > F.col("first"))
    return rows.select("key", "url", "payload", "digest", F.when(met, F.col("first")).alias("refers_to"))


def with_rare(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """`rows` (…, digest, first) with `first` of the digests in `rare`, too many to broadcast.

    A bit map of at most 2^20 words of 64 bits, addressed by the first 26 bits of a digest, tells which rows
    may have one; the others stay where they are. No digest in `rare` is frequent, so none makes a hot task.
    """
    number = F.conv(F.substring("digest", 1, 7), 16, 10).cast("long")
    word, bit = F.shiftright(number, 8), F.shiftright(number, 2).bitwiseAND(F.lit(63)).cast("int")
    marks = rare.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    marked = rows.withColumn("word", word).join(F.broadcast(settle(marks)), "word", "left")
    maybe = F.col("first").isNull() & F.coalesce(F.call_function("getbit", "bits", bit) == 1, F.lit(False))
    columns = ["key", "url", "payload", "digest", "first"]
    stay = marked.where(~maybe).select(*columns)
    move = marked.where(maybe).drop("first").join(rare.select("digest", "first"), "digest", "left")
    return stay.unionByName(move.select(*columns))


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write `records` as packages below `folder`; one row (package, records) per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        system, root = open_path(folder)
        system.create_dir(root, recursive=True)
        data, lines = [], []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal data, lines, size, count
            name = f"part-{part:05d}-{count:05d}.wacz"
            members = [(ARCHIVE, b"".join(data)), (INDEX, "".join(lines).encode())]
            with system.open_output_stream(f"{root}/{name}") as sink:
                write_zip(sink, members)
            out = pa.RecordBatch.from_pydict({"package": [f"{folder}/{name}"], "records": [len(lines)]})
            data, lines, size, count = [], [], 0, count + 1
            return out

        for batch in batches:
            for row in batch.to_pylist():
                raw = warc_record(row["key"], row["url"], row["payload"], row["digest"], row["refers_to"])
                lines.append(f"{record_id(row['key'])}\t{size}\t{len(raw)}\n")
                data.append(raw)
                size += len(raw)
                if size >= package_bytes:
                    yield flush()
        if lines:
            yield flush()

    return records.mapInArrow(run, "package string, records long")


def locate(packages: DataFrame, records_per_row: int = 256) -> DataFrame:
    """(package, offsets, lengths): where the records lie in the file, a bounded run of them per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with ZipReader(path) as package:
                    members = package.members()
                    base = package.data_start(members[ARCHIVE])
                    index = members[INDEX]
                    raw = package.fetch(package.data_start(index), index.size)
                spots = [line.split("\t")[1:] for line in raw.decode().splitlines()]
                for k in range(0, len(spots), records_per_row):
                    run_of = spots[k : k + records_per_row]
                    offsets, lengths = [base + int(a) for a, _ in run_of], [int(b) for _, b in run_of]
                    yield pa.RecordBatch.from_pydict({"package": [path], "offsets": [offsets], "lengths": [lengths]})

    return packages.select("package").mapInArrow(run, "package string, offsets array<long>, lengths array<long>")


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = 8 << 20) -> Iterator[tuple[int, int, list[int]]]:
    """(start, bytes, records) of the fetches that cover the records, in file order."""
    order = sorted(range(len(offsets)), key=lambda k: offsets[k])
    start, end, held = 0, 0, []
    for k in order:
        far = offsets[k] > end + gap or offsets[k] + lengths[k] - start > most
        if held and far:
            yield start, end - start, held
            held = []
        if not held:
            start, end = offsets[k], offsets[k]
        held.append(k)
        end = max(end, offsets[k] + lengths[k])
    if held:
        yield start, end - start, held


READ = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(spots: DataFrame) -> DataFrame:
    """The records at `spots`, read by range."""
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with ZipReader(row["package"]) as package:
                    for start, size, held in ranges(row["offsets"], row["lengths"]):
                        raw, columns = package.fetch(start, size), [[] for _ in names]
                        for k in held:
                            at = row["offsets"][k] - start
                            for column, value in zip(columns, parse_record(raw[at : at + row["lengths"][k]])):
                                column.append(value)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return spots.mapInArrow(run, READ)
