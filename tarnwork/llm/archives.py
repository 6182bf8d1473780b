"""Web archives packed in ZIP files: written, indexed, and read back by byte range without extraction.

A ZIP holds two stored (uncompressed) members: ``archive/data.warc.gz``, each record a gzip member of its own, and
``indexes/index.cdxj``, a line a record with its offset and length in the former. The reader takes the tail of the file,
finds the end record (and the ZIP64 one through its locator), walks the central directory, and then fetches the index
and the records by range; neighbouring records share a fetch of up to FETCH bytes.

Payloads that come again are revisits: the smallest id of a payload's pages is its response, and the others refer to it.

Rows: null HTML is an empty payload, and equal empty payloads revisit too. Rows with the smallest id of their payload
are all responses. A null id is larger than any other; such a row refers to the response, and is one itself where all
ids of its payload are null. Repeated rows are records each. A very long payload is one record, fetched alone. An empty
table gives no archives and no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import adopt, partitions, shared_dir, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records in one ZIP, about; bytes fetched at once, at most (or one record).
ARCHIVE, FETCH = 16 << 20, 4 << 20
#: Tasks that read archives, at most so many for each shuffle partition.
READERS = 4
RECORD = "page_id bigint, record_type string, target_uri string, payload_digest string, refers_to bigint, payload_bytes bigint, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record, gzipped. A revisit has the response's HTTP header and no body."""
    name = lambda x: f"<urn:x-page:{x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def read_record(raw: bytes) -> dict:
    """Fields of RECORD from a gzip member; raises if lengths or the payload's digest don't hold."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = field["WARC-Type"] == "revisit"
    if len(rest) != len(block) + 4 or not revisit and (len(payload) != length or digest32(payload) != digest):
        raise ValueError(f"record {field['WARC-Record-ID']} is damaged")
    number = lambda x: None if x is None or x[12:-1] == "None" else int(x[12:-1])
    return {"page_id": number(field["WARC-Record-ID"]), "record_type": field["WARC-Type"], "target_uri": field["WARC-Target-URI"], "payload_digest": digest, "refers_to": number(field.get("WARC-Refers-To")), "payload_bytes": length, "payload": None if revisit else payload}


def write_zip(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP of stored members; with zip64, sizes and offsets stand in the 64-bit fields."""
    out, central = [], []
    at = 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        big = zip64 or n >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        small = 0xFFFFFFFF if big else n
        version = 45 if big else 20
        out += [struct.pack("<IHHHHHIIIHH", 0x04034B50, version, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra)), raw, extra, data]
        extra_c = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, version, version, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra_c), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + raw + extra_c)
        at += 30 + len(raw) + len(extra) + n
    directory = b"".join(central)
    tail = b""
    if zip64:
        tail = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(central), len(central), len(directory), at) + struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    few = (0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) if zip64 else (len(central), len(central), len(directory), at)
    return b"".join(out) + directory + tail + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, *few, 0)


class Package:
    """Stored members of a ZIP, by range reads of an open file that can seek."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = self._directory()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ValueError("range outside the file")
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("file ends early")
        return data

    def _directory(self) -> dict[str, tuple[int, int, int, int]]:
        """method, stored size, size, place of the local header of each member."""
        n = min(self.size, 22 + 0xFFFF)
        tail = self.read(self.size - n, n)
        end = len(tail) - 22
        while end >= 0 and not (tail[end : end + 4] == b"PK\5\6" and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail)):
            end -= 1
        if end < 0:
            raise ValueError("no end of a ZIP's directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        here = self.size - n + end
        if 0xFFFF == count or 0xFFFFFFFF in (length, at):
            sign, _, place, _ = struct.unpack("<IIQI", self.read(here - 20, 20))
            if sign != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            sign, _, _, _, _, _, _, count, length, at = struct.unpack("<IQHHIIQQQQ", self.read(place, 56))
            if sign != 0x06064B50:
                raise ValueError("no ZIP64 end record")
        raw, i, found = self.read(at, length), 0, {}
        for _ in range(count):
            sign, _, _, flags, method, _, _, _, stored, size, n_name, n_extra, n_note, _, _, _, place = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, i)
            if sign != 0x02014B50:
                raise ValueError("no directory entry")
            name = raw[i + 46 : i + 46 + n_name].decode()
            extra, j = raw[i + 46 + n_name : i + 46 + n_name + n_extra], 0
            while j + 4 <= len(extra):
                tag, m = struct.unpack_from("<HH", extra, j)
                if tag == 1:  # holds, in this order, only what doesn't fit above
                    k = j + 4
                    if size == 0xFFFFFFFF:
                        size, k = struct.unpack_from("<Q", extra, k)[0], k + 8
                    if stored == 0xFFFFFFFF:
                        stored, k = struct.unpack_from("<Q", extra, k)[0], k + 8
                    if place == 0xFFFFFFFF:
                        place = struct.unpack_from("<Q", extra, k)[0]
                j += 4 + m
            found[name] = (method, stored, size, place)
            i += 46 + n_name + n_extra + n_note
        return found

    def locate(self, name: str) -> tuple[int, int]:
        """Place and length of a stored member's bytes in the file."""
        method, stored, size, place = self.members[name]
        if method or stored != size:
            raise ValueError(f"{name} isn't stored as it is")
        head = self.read(place, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        return place + 30 + sum(struct.unpack_from("<HH", head, 26)), size

    def records(self, fetch: int = FETCH):
        """(offset, raw record) of every line of the index."""
        at, n = self.locate(INDEX)
        base, size = self.locate(DATA)
        spots = []
        for line in self.read(at, n).decode().splitlines():
            facts = json.loads(line.split(" ", 2)[2])
            spots.append((int(facts["offset"]), int(facts["length"])))
        spots.sort()
        i = 0
        while i < len(spots):
            j = i + 1
            while j < len(spots) and spots[j][0] + spots[j][1] - spots[i][0] <= fetch:
                j += 1
            first, to = spots[i][0], spots[j - 1][0] + spots[j - 1][1]
            if to > size:
                raise ValueError("index points outside its archive")
            raw = self.read(base + first, to - first)
            for at, n in spots[i:j]:
                yield at, raw[at - first : at - first + n]
            i = j


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """path, n_records of each archive written. pages: page_id, url, html, refers_to (null: a response).

    A file's name is new for each try of a task; the rows returned name the files of the tries that count.
    """

    def run(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)

        def close(records, lines):
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(path) as f:
                f.write(write_zip([(DATA, b"".join(records)), (INDEX, "".join(lines).encode())]))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(lines)], pa.int64())], ["path", "n_records"])

        records, lines, at = [], [], 0
        for b in batches:
            for page, url, html, first in zip(b["page_id"], b["url"], b["html"].cast(pa.binary()), b["refers_to"]):
                page, url, html, first = page.as_py(), url.as_py() or "about:blank", html.as_py() or b"", first.as_py()
                url = url.replace("\r", "%0D").replace("\n", "%0A")
                revisit = first is not None
                raw = record(page, url, html, first, revisit)
                lines.append(f"{url.replace(' ', '%20')} 20200101000000 " + json.dumps({"offset": str(at), "length": str(len(raw)), "filename": "data.warc.gz", "mime": "warc/revisit" if revisit else "text/html"}) + "\n")
                records.append(raw)
                at += len(raw)
                if at >= archive_bytes:
                    yield close(records, lines)
                    records, lines, at = [], [], 0
        if lines:
            yield close(records, lines)

    return staged(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, n_records bigint"), "archives")


def read(written: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """RECORD of every record of the archives listed; payload stays null for revisits, or where not asked for."""
    names = [x.split() for x in RECORD.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        files, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b["path"].to_pylist():
                with files.open_input_file(path) as f:
                    held, size = [], 0
                    for _, raw in Package(f, f.size()).records():
                        r = read_record(raw)
                        size += r["payload_bytes"]
                        held.append(r if with_payload else r | {"payload": None})
                        if size >= FETCH:
                            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], kinds[t]) for n, t in names], [n for n, _ in names])
                            held, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], kinds[t]) for n, t in names], [n for n, _ in names])

    # A few archives a task, dealt round; the list is a written table, so it is dealt the same way again.
    return written.repartition(max(1, min(written.count(), READERS * partitions(written.sparkSession)))).mapInArrow(run, RECORD)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: what each page revisits, if its payload has at least so many bytes.

    Digests that come again, and what refers to them, are tables of narrow rows: either join then has an exchange of its
    own on both sides, of which Spark splits a digest's that very many pages have. Texts move once, by page and digest.
    """
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    keys = pages.filter(F.coalesce(F.octet_length("html"), F.lit(0)) >= least).select("page_id", sha.alias("_sha"))
    first = keys.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 and _first is not null").drop("_n")
    first = staged(first, "archive-digests")
    again = keys.join(first, "_sha").filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("_first"))).select(F.col("page_id").alias("_page"), "_sha", "_first").distinct()
    again = staged(again, "archive-revisits")
    mine = pages.select("page_id", "url", "html", sha.alias("_mine"))
    return mine.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_mine") == F.col("_sha")), "left").select("page_id", "url", "html", F.col("_first").alias("refers_to"))


def archive_folder(spark: SparkSession) -> str:
    return adopt(f"{shared_dir(spark)}/wacz-{uuid.uuid4().hex}", spark)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """RECORD without payloads of every page, written to archives in the shared folder and read back."""
    folder = archive_folder(pages.sparkSession)
    return read(write(with_revisits(pages, least), folder), folder, with_payload=False)
