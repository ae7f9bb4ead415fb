import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from dayloom.llm import ogg


def slow_crc(data):
    reg = 0
    for b in data:
        reg ^= b << 24
        for _ in range(8):
            reg = ((reg << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if reg & 0x80000000 else reg << 1
    return reg


def test_checksum():
    for d in (b"", b"\0", b"OggS123", bytes(range(256)) * 3):
        assert ogg.page_checksum(d) == slow_crc(d)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), min_size=1, max_size=6))
def test_lacing_round_trip(sizes):
    total, packets = 0, []
    for n in sizes:
        total += n
        packets.append((bytes([n % 251]) * n, total))
    streams, damaged = ogg.read_ogg(b"".join(p for _, p in ogg.write_pages(7, packets)))
    assert damaged == 0 and streams[7].packets == [p for p, _ in packets] and streams[7].complete and not streams[7].lost


def test_samples_times_and_damage():
    for n in (64, 4096, 4160, 16384, 130048, 1_000_000):
        payload = bytes((i * 37 + i // 255) % 256 for i in range(n // 64 * 64))
        media = ogg.write_ogg(payload)
        samples, rate, times, sound = ogg.read_samples(media)
        assert samples == payload and sound and rate == 8000
        assert times == [min(i + 4096, len(payload)) / 8000 for i in range(0, len(payload), 4096)]
        broken = bytearray(media)
        broken[-10] ^= 1
        assert not ogg.read_samples(bytes(broken))[3]
        assert ogg.read_samples(b"junk" + media)[0] == payload
    assert ogg.read_samples(None) == (b"", 0, [], False)


def test_table(spark):
    rows = [(1, "abc", "k"), (2, None, "k"), (3, "", "k"), (4, "é" * 32, None), (5, "abc", "z"), (6, "x" * 200_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    out = {r.doc_id: r for r in ogg.describe_media(ogg.encode_media(df)).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        pay = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.sound) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), True)
    assert out[1].media_sha256 == out[5].media_sha256 and out[1].feature == out[5].feature
    assert ogg.describe_media(ogg.encode_media(df.limit(0))).collect() == []
    packets = ogg.demultiplex(ogg.encode_media(df.where("doc_id = 6"))).collect()
    assert b"".join(p.data for p in packets if p.serial == 1 and p.packet > 0).rstrip(b"\0") == b"x" * 200_000
