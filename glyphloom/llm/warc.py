"""WARC archives in ZIP packages: written per partition, read by ranges without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import arrow_rows
from glyphloom.session import cut_lineage, scratch_path

DATA_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
RANGE_BYTES = 8 << 20
"""Bytes of consecutive records that one read fetches, about."""
DATE = "2024-01-01T00:00:00Z"

# Signatures and sizes of ZIP directory structures.
END, END_SIZE = b"PK\x05\x06", 22
END64, LOCATOR64, LOCATOR64_SIZE = b"PK\x06\x06", b"PK\x06\x07", 20
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
LARGE16, LARGE32 = 0xFFFF, 0xFFFFFFFF

ReadAt = Callable[[int, int], bytes]


def payload_digest(payload: bytes) -> str:
    """Bare base32 SHA-1, as WARC headers carry it after their prefix."""

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, ident: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers, whose Content-Length is the payload's, without the payload."""

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""

    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"{headers.get('WARC-Record-ID')}: its length is wrong")
    return headers, block


def zip_members(read_at: ReadAt, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, first byte, bytes) of an archive, from its directories alone.

    The end record is found from the file's end. Where one of its fields is saturated, the
    ZIP64 locator before it leads to the ZIP64 end record, and the entries' ZIP64 fields hold
    sizes and offsets. A member's first byte follows from its local header.
    """

    tail_size = min(size, END_SIZE + LARGE16 + LOCATOR64_SIZE)
    tail = read_at(size - tail_size, tail_size)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if LARGE16 == count or LARGE32 in (length, start):
        locator = tail[end - LOCATOR64_SIZE : end]
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        (place,) = struct.unpack("<Q", locator[8:16])
        end64 = read_at(place, 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", end64[32:56])
    directory = read_at(start, length)
    members, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        (method,) = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, plain, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        (local,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + ENTRY_SIZE : at + ENTRY_SIZE + n_name].decode()
        extra = directory[at + ENTRY_SIZE + n_name : at + ENTRY_SIZE + n_name + n_extra]
        wide = _wide_fields(extra, [v == LARGE32 for v in (plain, packed, local)])
        plain, packed, local = (w if w is not None else v for w, v in zip(wide, (plain, packed, local)))
        head = read_at(local, LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        members[name] = (method, local + LOCAL_SIZE + sum(struct.unpack("<HH", head[26:30])), packed)
        at += ENTRY_SIZE + n_name + n_extra + n_note
    return members


def _wide_fields(extra: bytes, wanted: list[bool]) -> list[int | None]:
    """Values of the ZIP64 extra field (number 1), which holds only the saturated ones, in order."""

    at = 0
    while at + 4 <= len(extra):
        number, length = struct.unpack("<HH", extra[at : at + 4])
        if number == 1:
            values = iter(struct.unpack(f"<{length // 8}Q", extra[at + 4 : at + 4 + length // 8 * 8]))
            return [next(values) if w else None for w in wanted]
        at += 4 + length
    return [None] * len(wanted)


SALTS = 16
"""Parts into which the rows of one payload are dealt where they meet the row that stands for them."""


def with_revisits(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", payload: str = "html") -> DataFrame:
    """(key, url, payload, refers_to): the page whose record holds this row's payload, if another's does.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the largest key
    is kept; the others name it. Digests are grouped with partial sums; what is joined
    back are digests that occur twice or more, once for each of ``SALTS`` parts, so a payload
    that a third of all rows share is not one task's. Null keys come before all others; rows
    that repeat the kept row's key and payload are kept like it.
    """

    payloads = pages.select(key, "url", F.coalesce(F.col(payload), F.lit("")).alias("payload")).withColumns(
        {"sha": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload"), "salt": F.pmod(F.xxhash64(key, "url"), F.lit(SALTS)).cast("int")}
    )
    shared = (
        payloads.filter(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max(key).alias("kept"), F.count("*").alias("n"))
        .filter("n > 1").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    other = F.when(~F.col("kept").eqNullSafe(F.col(key)), F.col("kept"))
    return payloads.join(shared, ["sha", "size", "salt"], "left").select(key, "url", "payload", other.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, key: str = "page_id") -> DataFrame:
    """Write one ZIP package per partition into the shared ``folder``; returns the written (path, records, bytes).

    The package holds the WARC file as a stored member, each record a gzip member of its own,
    and an index of its records. A retried
    task writes under another name, and only names that reached the returned table are read.
    """

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        from pyarrow import fs

        first = next(slices, None)
        if first is None:
            return
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}.wacz"
        lines, at = [], 0
        with store.open_output_stream(path) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
            with package.open(DATA_MEMBER, "w", force_zip64=True) as member:
                part: list[tuple] | None = first
                while part is not None:
                    for page, url, text, refers_to in part:
                        kind = "response" if refers_to is None else "revisit"
                        plain = record(kind, _ident(page), url, (text or "").encode("utf-8", "surrogatepass"), _ident(refers_to))
                        data = gzip.compress(plain, 1, mtime=0)
                        member.write(data)
                        lines.append(json.dumps({"id": _ident(page), "offset": at, "length": len(data)}))
                        at += len(data)
                    part = next(slices, None)
            package.writestr(INDEX_MEMBER, "\n".join(lines))
        yield [(path, len(lines), store.get_file_info(path).size)]

    return cut_lineage(arrow_rows(records, [key, "url", "payload", "refers_to"], "path string, records bigint, bytes bigint", rows))


def _ident(page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def _page(ident: str | None) -> int | None:
    page = ident.strip("<>").split(":")[2] if ident else ""
    return int(page) if page else None


def record_ranges(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, lengths): runs of whole records of every package's WARC member, from directory and index."""

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for part in slices:
            for path, size in part:
                with store.open_input_file(path) as file:
                    members = zip_members(lambda at, n: file.read_at(n, at), size)  # noqa: B023
                    (method, first, _), (index_method, index_at, index_bytes) = members[DATA_MEMBER], members[INDEX_MEMBER]
                    if method or index_method:
                        raise ValueError(f"{path}: members are compressed")
                    start, size_of, lengths, out = first, 0, [], []
                    for line in file.read_at(index_bytes, index_at).decode().split("\n"):
                        entry = json.loads(line)
                        if lengths and size_of + entry["length"] > range_bytes:
                            out.append((path, start, lengths))
                            start, size_of, lengths = first + entry["offset"], 0, []
                        lengths.append(entry["length"])
                        size_of += entry["length"]
                    yield [*out, (path, start, lengths)]

    return arrow_rows(archives, ["path", "bytes"], "path string, start bigint, lengths array<bigint>", rows)


def read_records(ranges: DataFrame, folder: str) -> DataFrame:
    """One row per record of the ranges; a payload that doesn't match its digest is an error."""

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for part in slices:
            for path, start, lengths in part:
                with store.open_input_file(path) as file:
                    data = memoryview(file.read_at(sum(lengths), start))
                out, stops = [], list(accumulate(lengths))
                for a, b in zip([0, *stops], stops):
                    headers, block = parsed(gzip.decompress(data[a:b]))
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    size_of = int(head.decode().rpartition("Content-Length: ")[2])
                    if kind == "response" and (len(payload) != size_of or payload_digest(payload) != digest):
                        raise ValueError(f"{path}: payload of {headers['WARC-Record-ID']} doesn't match its digest")
                    out.append((
                        _page(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size_of, digest, kind,
                        _page(headers.get("WARC-Refers-To")), payload if kind == "response" else None,
                    ))
                yield out

    fields = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return arrow_rows(ranges, ["path", "start", "lengths"], fields, rows)


def archive_round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into packages in the shared folder and read all records back.

    Null html is the empty payload. Rows with a null page_id get records too; an empty table
    gives no package and no row. Columns beyond page_id, url and html are ignored.
    """

    folder = scratch_path(spark)
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)
    archives = write_archives(with_revisits(pages, least_bytes), folder)
    ranges = cut_lineage(record_ranges(archives, folder))
    return read_records(ranges.repartition(max(1, ranges.count()), "path", "start"), folder).drop("payload", "url")
