"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package is a ZIP file whose members are stored, not deflated: ``archive/*.warc.gz`` (one
gzip member a record) and ``indexes/index.cdxj`` (offset and length of each record). The
reader finds the central directory from the file's end (with ZIP64's locator and records),
locates the stored archive members and the index, and reads each record by its byte range.

Distribution: payload digests (narrow rows) are aggregated to one leader a digest, so a
payload that a third of all pages share is summed up before the shuffle; narrow rows then meet
their leader by digest, a join that Spark splits where one digest is very frequent, and whole pages
by (page_id, digest). Each task writes packages of bounded size to the shared folder under names
that depend only on its partition, first under a temporary name: a task that runs again replaces
its files by ones of the same records (their order may differ; readers go by each file's own
directory and index). Reading deals byte ranges, not
files, to tasks.

Edge cases: null html is empty. A null url is left out of the record, control characters in
one are percent-encoded. Rows with equal page_id and payload are equal records (both response
if that id is the largest); a null page_id never leads while another id has the payload. An
empty table gives no package and an empty result. Other columns are not archived.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import Scratch, fresh_path, small_batches

LEAST_REVISIT = 1000
PACKAGE_BYTES = 64 << 20  # a package is closed beyond this
MEMBER_BYTES = 16 << 20  # and an archive member beyond this
RANGE_BYTES = 4 << 20  # adjacent records read at once

# Fixed values of the formats (ZIP application note, WARC 1.1)
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-dayloom:page:{}>"
DATE = "1970-01-01T00:00:00Z"


def file_system(uri: str):
    """The file system of a URI and the path in it (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + re.sub("^file:", "", uri))


# ---------------------------------------------------------------- ZIP


@dataclass
class Member:
    name: str
    method: int
    offset: int  # of its data
    size: int  # as stored


def read_directory(source) -> list[Member]:
    """Members of a ZIP file open for random access (size, read_at); reads its end, its
    directory and each member's local header only."""
    total = source.size()
    tail_at = max(0, total - 65557 - 20)
    tail = source.read_at(total - tail_at, tail_at)
    at = len(tail)
    while (at := tail.rfind(END, 0, at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        record = source.read_at(56, where)
        if record[:4] != END64:
            raise ValueError("ZIP64 locator points at no ZIP64 record")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    directory, pos, members = source.read_at(size, start), 0, []
    for _ in range(count):
        if directory[pos : pos + 4] != ENTRY:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, pos + 10)[0]
        stored, plain, n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, pos + 20)
        local = struct.unpack_from("<I", directory, pos + 42)[0]
        name = directory[pos + 46 : pos + 46 + n].decode("utf-8", "replace")
        extra = directory[pos + 46 + n : pos + 46 + n + extra_n]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF and wide else plain
                stored = wide.pop(0) if stored == 0xFFFFFFFF and wide else stored
                local = wide.pop(0) if local == 0xFFFFFFFF and wide else local
            extra = extra[4 + length :]
        head = source.read_at(30, local)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        name_n, local_extra = struct.unpack_from("<HH", head, 26)
        members.append(Member(name, method, local + 30 + name_n + local_extra, stored))
        pos += 46 + n + extra_n + comment_n
    return members


# ---------------------------------------------------------------- records


def header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. digest: hex SHA-1 of the payload; a revisit has no payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: {RECORD_ID.format(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers.get("content-length", 0))]
    return headers, block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def page_of(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-dayloom:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def walk_member(source, m: Member) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of a stored member that no index describes; one block
    is held at a time."""
    at, end = m.offset, m.offset + m.size
    start, unpack = at, zlib.decompressobj(31)
    while at < end:
        data = source.read_at(min(1 << 20, end - at), at)
        at += len(data)
        while data:
            unpack.decompress(data)
            if not unpack.eof:
                break
            data = unpack.unused_data
            yield start, at - len(data) - start
            start, unpack = at - len(data), zlib.decompressobj(31)


# ---------------------------------------------------------------- writer


class Package:
    """One ZIP file in the making; stored members, closed at a bounded size."""

    def __init__(self, system, path: str):
        self.system, self.path, self.temporary = system, path, f"{path}.{uuid.uuid4().hex}.part"
        self.stream = system.open_output_stream(self.temporary)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member, self.index, self.members, self.bytes, self.records = None, [], 0, 0, 0

    def add(self, record: bytes, entry: dict) -> None:
        if self.member is None:
            self.name, self.at = f"archive/data-{self.members:04d}.warc.gz", 0
            info = zipfile.ZipInfo(self.name, (1980, 1, 1, 0, 0, 0))
            self.member = self.zip.open(info, "w", force_zip64=True)
            self.members += 1
        self.member.write(record)
        url = header_value(entry.pop("url") or "-")
        self.index.append(f"{url} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry | {'filename': self.name, 'offset': self.at, 'length': len(record)})}\n")
        self.at, self.bytes, self.records = self.at + len(record), self.bytes + len(record), self.records + 1
        if self.at >= MEMBER_BYTES:
            self.member.close()
            self.member = None

    def close(self) -> tuple[str, int, int]:
        if self.member is not None:
            self.member.close()
        self.zip.writestr(zipfile.ZipInfo("indexes/index.cdxj", (1980, 1, 1, 0, 0, 0)), "".join(self.index))
        self.zip.close()
        self.stream.close()
        from pyarrow import fs

        if self.system.get_file_info(self.path).type != fs.FileType.NotFound and not isinstance(self.system, fs.LocalFileSystem):
            self.system.delete_file(self.path)  # some stores do not rename onto a file
        self.system.move(self.temporary, self.path)
        return self.path, self.bytes, self.records


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another one's payload. The leaders are a
    written table, so that both sides of the join come from a shuffle and Spark's adaptive skew join
    splits a payload that very many pages have."""
    long_ones = pages.where(F.col("payload_bytes") >= least).select("page_id", "digest")
    leaders = long_ones.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    leaders = Scratch(pages.sparkSession).put(leaders, "leaders")
    return long_ones.join(leaders, "digest").where("page_id is null or page_id <> refers_to").dropDuplicates(["page_id", "digest"])


def write_packages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the packages and returns the manifest (path, bytes, records), itself a written table."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("payload_bytes"))
    who = revisits(rows.drop("payload", "url")).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    joined = rows.join(who, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        part, done, package = TaskContext.get().partitionId(), [], None
        for b in small_batches(batches):
            for page, u, data, digest, refers in zip(*[c.to_pylist() for c in b.columns], strict=True):
                package = package or Package(system, f"{base}/part-{part:06d}-{len(done):04d}.wacz")
                kind = "response" if refers is None else "revisit"
                package.add(make_record(page, u, data, digest, refers), {"url": u, "type": kind, "digest": f"sha1:{digest}"})
                if package.bytes >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    manifest = joined.mapInArrow(run, "path string, bytes long, records long")
    at = folder + "-manifest"
    manifest.write.parquet(at)
    return spark.read.schema("path string, bytes long, records long").parquet(at)


# ---------------------------------------------------------------- reader


def record_ranges(manifest: DataFrame, folder: str) -> DataFrame:
    """(path, offset, lengths): byte ranges of adjacent records, up to RANGE_BYTES each, from
    each package's directory and index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with system.open_input_file(path) as source:
                    members = read_directory(source)
                    archives = {m.name: m for m in members if m.method == 0 and re.search(r"\.warc(\.gz)?$", m.name)}
                    places: list[tuple[int, int]] = []
                    indexed = set()
                    for m in members:
                        if m.name.endswith(".cdxj") and m.method in (0, 8):
                            raw = source.read_at(m.size, m.offset)
                            for line in (raw if m.method == 0 else zlib.decompress(raw, -15)).decode().splitlines():
                                x = json.loads(line.split(" ", 2)[2])
                                indexed.add(x["filename"])
                                places.append((archives[x["filename"]].offset + int(x["offset"]), int(x["length"])))
                    for m in archives.values():
                        if m.name not in indexed:
                            places += walk_member(source, m)
                starts, lengths = [], []
                for at, n in sorted(places):
                    if starts and at == starts[-1] + sum(lengths[-1]) and sum(lengths[-1]) + n <= RANGE_BYTES:
                        lengths[-1].append(n)
                    else:
                        starts.append(at)
                        lengths.append([n])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["path", "offset", "lengths"])

    return manifest.select("path").mapInArrow(run, "path string, offset long, lengths array<long>")


def read_records(ranges: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to, url
    (and the payload). The digest of a response is computed from the payload read back; a
    payload that differs from its header's digest is an error."""
    import hashlib

    kinds = [("page_id", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long"), ("url", pa.string(), "string")]
    kinds += [("payload", pa.binary(), "binary")] if with_payload else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for b in batches:
            for path, offset, lengths in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with system.open_input_file(path) as source:
                    data = source.read_at(sum(lengths), offset)
                rows, at = [], 0
                for n in lengths:
                    headers, payload = parse_record(zlib.decompress(data[at : at + n], 31))
                    at += n
                    said = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                    kind = headers["warc-type"]
                    size = len(payload) if kind == "response" else int(headers["x-payload-length"])
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != said:
                        raise ValueError(f"{path}: record at {offset + at - n} does not match its digest")
                    rows.append((page_of(headers["warc-record-id"]), size, said, kind, page_of(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k[1]) for i, k in enumerate(kinds)], names=[k[0] for k in kinds])

    return ranges.mapInArrow(run, ", ".join(f"{k[0]} {k[2]}" for k in kinds))


def read_packages(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Ranges are dealt over tasks by their place, so that a large package is read by many."""
    ranges = record_ranges(manifest, folder)
    return read_records(ranges.repartition("path", "offset"), folder, with_payload)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = fresh_path(spark, "packages")
    import atexit

    from dayloom.llm.common import remove_dir

    atexit.register(remove_dir, spark, folder)
    atexit.register(remove_dir, spark, folder + "-manifest")
    return read_packages(write_packages(pages, folder), folder).drop("url")
