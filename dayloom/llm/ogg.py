"""Media columns: Ogg. Writes and reads Ogg streams held in a binary column.

The reader verifies page checksums, reassembles packets from lacing values across pages,
demultiplexes logical streams and derives times from granule positions. The writer stores
bytes losslessly as 8-bit PCM samples (the OggPCM draft's header, format U8) in one logical
stream, and beside it a second logical stream of marks: the CRC-32 of each second block of
samples, so that a reader must demultiplex and can check the first stream by the second.

Row-wise, no shuffle; each task holds one small batch of media.

Edge cases: null text is empty text (64 zero bytes of payload). Empty or null media has no
streams. A damaged page is skipped to the next capture pattern and counted; packets it cut
are dropped and counted. Equal texts give equal media, as serial numbers are fixed. Extra
columns pass through unless their names clash with the result's; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dayloom.llm.common import small_batches

# Fixed values of the formats (RFC 3533, OggPCM draft)
CAPTURE = b"OggS"
PAGE_HEADER, PAGE_HEADER_SIZE = "<4sBBqIIIB", 27
CONTINUED, FIRST, LAST = 1, 2, 4
PCM_HEADER = ">8sHHIIBBHI"
PCM_MAGIC, PCM_U8 = b"PCM     ", 1
MARKS_HEADER = "<8sI"
MARK = "<qI"
MARKS_MAGIC = b"dlmarks\0"

RATE = 8000
PACKET_SAMPLES = 4096
MARK_SAMPLES = 16384
AUDIO_SERIAL, MARKS_SERIAL = 1, 2
BLOCK = 64

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, most significant bit first, from 0: zlib's CRC of the
    mirrored bytes, started at 0 and without its final inversion, mirrored again."""
    value = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(value.to_bytes(4, "little").translate(_MIRROR), "big")


def write_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one logical stream as (granule for interleaving, bytes). Each packet comes with
    the granule position at its end. The first packet has a page of its own."""
    pages: list[tuple[int, bytes]] = []
    lacing, body, granule, continued, at = bytearray(), [], -1, False, 0

    def flush(last: bool, next_continued: bool) -> None:
        nonlocal lacing, body, granule, continued, at
        flags = CONTINUED * continued | FIRST * (not pages) | LAST * last
        head = struct.pack(PAGE_HEADER, CAPTURE, 0, flags, granule, serial, len(pages), 0, len(lacing)) + bytes(lacing)
        raw = head + b"".join(body)
        raw = raw[:22] + struct.pack("<I", page_checksum(raw)) + raw[26:]
        at = max(at, granule)
        pages.append((at, raw))
        lacing, body, granule, continued = bytearray(), [], -1, next_continued

    for k, (data, end) in enumerate(packets):
        full, rest = divmod(len(data), 255)
        offset = 0
        for value in [255] * full + [rest]:
            if len(lacing) == 255:
                flush(False, offset > 0)
            lacing.append(value)
            body.append(data[offset : offset + value])
            offset += value
        granule = end
        if k == 0 and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return pages


def write_ogg(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as samples of one stream, with the stream of marks, interleaved by granule."""
    audio = [(struct.pack(PCM_HEADER, PCM_MAGIC, 0, 0, PCM_U8, rate, 8, 1, PACKET_SAMPLES, 0), 0)]
    audio += [(payload[i : i + PACKET_SAMPLES], min(i + PACKET_SAMPLES, len(payload))) for i in range(0, len(payload), PACKET_SAMPLES)]
    marks = [(struct.pack(MARKS_HEADER, MARKS_MAGIC, rate), 0)]
    marks += [(struct.pack(MARK, i, zlib.crc32(payload[i : i + MARK_SAMPLES])), min(i + MARK_SAMPLES, len(payload))) for i in range(0, len(payload), MARK_SAMPLES)]
    first, second = write_pages(AUDIO_SERIAL, audio), write_pages(MARKS_SERIAL, marks)
    rest = sorted([(g, 0, k, p) for k, (g, p) in enumerate(first[1:])] + [(g, 1, k, p) for k, (g, p) in enumerate(second[1:])])
    return first[0][1] + second[0][1] + b"".join([p[3] for p in rest])


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page on which each packet ends
    complete: bool = False  # its last page was seen
    lost: int = 0  # packets cut by missing or damaged pages
    _open: list[bytes] | None = None
    _next: int = 0


def read_ogg(media: bytes | None) -> tuple[dict[int, LogicalStream], int]:
    """Logical streams by serial number, and the number of damaged pages."""
    streams: dict[int, LogicalStream] = {}
    damaged, at, data = 0, 0, media or b""
    while (at := data.find(CAPTURE, at)) >= 0 and at + PAGE_HEADER_SIZE <= len(data):
        _, version, flags, granule, serial, number, checksum, n = struct.unpack_from(PAGE_HEADER, data, at)
        start = at + PAGE_HEADER_SIZE + n
        lacing = data[at + PAGE_HEADER_SIZE : start]
        end = start + sum(lacing)
        if version or len(lacing) < n or end > len(data) or page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != checksum:
            damaged += 1
            at += 4
            continue
        s = streams.setdefault(serial, LogicalStream(serial))
        if number != s._next and s._open is not None:
            s.lost, s._open = s.lost + 1, None
        s._next = number + 1
        skip = bool(flags & CONTINUED) and s._open is None  # the start of this packet is lost
        if not flags & CONTINUED and s._open is not None:
            s.lost, s._open = s.lost + 1, None
        pos = run = start
        for value in lacing:
            pos += value
            if value < 255:
                if skip:
                    skip, s.lost = False, s.lost + 1
                else:
                    s.packets.append(b"".join([*(s._open or ()), data[run:pos]]))
                    s.granules.append(granule)
                s._open, run = None, pos
        if lacing and lacing[-1] == 255 and not skip:
            s._open = [*(s._open or ()), data[run:pos]]
        s.complete |= bool(flags & LAST)
        at = end
    for s in streams.values():
        if s._open is not None:
            s.lost, s._open = s.lost + 1, None
    return streams, damaged


def packet_ends(stream: LogicalStream) -> list[int]:
    """The sample at which each data packet ends. Only the last packet of a page has the page's
    granule position; those before it are found by counting back, one sample a byte."""
    ends = list(stream.granules)
    for k in range(len(ends) - 2, 0, -1):
        if stream.granules[k] == stream.granules[k + 1]:
            ends[k] = ends[k + 1] - len(stream.packets[k + 1])
    return ends


def read_samples(media: bytes | None) -> tuple[bytes, int, list[float], bool]:
    """Samples, rate, the end time of each packet, and whether the marks agree with the samples."""
    streams, damaged = read_ogg(media)
    audio = next((s for s in streams.values() if s.packets and s.packets[0].startswith(PCM_MAGIC)), None)
    marks = next((s for s in streams.values() if s.packets and s.packets[0].startswith(MARKS_MAGIC)), None)
    if audio is None:
        return b"", 0, [], False
    rate = struct.unpack(PCM_HEADER, audio.packets[0])[4]
    samples = b"".join(audio.packets[1:])
    sound = not damaged and not audio.lost and audio.complete and marks is not None and audio.granules[-1] == len(samples)
    for p in marks.packets[1:] if marks else ():
        i, crc = struct.unpack(MARK, p)
        sound = sound and zlib.crc32(samples[i : i + MARK_SAMPLES]) == crc
    return samples, rate, [e / rate for e in packet_ends(audio)[1:]], sound


def padded(raw: bytes) -> bytes:
    return raw + bytes((-len(raw)) % BLOCK if raw else BLOCK)


def features(samples: bytes, rate: int, times: list[float]) -> str:
    """Duration, packets, mean, root of the mean square, and changes of sign around the middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128.0
    n = max(len(x), 1)
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"seconds={times[-1] if times else 0.0:.6f};packets={len(times)};mean={x.sum() / n:.6f};rms={np.sqrt((x * x).sum() / n):.6f};crossings={crossings}"


def encode_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Replaces the text column by ``media`` (Ogg) and ``n_bytes`` (of the text in UTF-8)."""
    names = (media, "n_bytes", text)
    keep = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*keep, T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            raw = [(t or "").encode("utf-8") for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([len(r) for r in raw], pa.int64()), pa.array([write_ogg(padded(r)) for r in raw], pa.binary())], names=schema.names)

    return df.select(*[f.name for f in keep], text).mapInArrow(run, schema)


def describe_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Replaces the media column by what is read from it: payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature and sound (all checks passed)."""
    made = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("sound", T.BooleanType())]
    keep = [f for f in df.schema.fields if f.name not in {media, *dict(made)}]
    schema = T.StructType([*keep, *[T.StructField(n, t) for n, t in made]])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = []
            for m in b.column(len(keep)).to_pylist():
                samples, rate, times, sound = read_samples(m)
                m = m or b""
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), features(samples, rate, times), sound))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *columns], names=schema.names)

    return df.select(*[f.name for f in keep], media).mapInArrow(run, schema)


def demultiplex(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each packet: the other columns, serial, packet, granule, data."""
    made = [("serial", T.LongType()), ("packet", T.LongType()), ("granule", T.LongType()), ("data", T.BinaryType())]
    keep = [f for f in df.schema.fields if f.name not in {media, *dict(made)}]
    schema = T.StructType([*keep, *[T.StructField(n, t) for n, t in made]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = [(i, s.serial, k, g, p) for i, m in enumerate(b.column(len(keep)).to_pylist()) for s in read_ogg(m)[0].values() for k, (p, g) in enumerate(zip(s.packets, s.granules, strict=True))]
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[: len(keep)]], *columns], names=schema.names)

    return df.select(*[f.name for f in keep], media).mapInArrow(run, schema)


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return describe_media(encode_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "sound")
