import hashlib
import random
import zlib

from trialloom.llm import ogg


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(2)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


def test_round_trip_and_packets_over_pages():
    rng = random.Random(3)
    for n, packet in ((64, 4096), (255 * 64, 255), (64 * 5000, 200_000), (64 * 1000, 510), (64 * 3, 64)):
        payload = rng.randbytes(n)
        media = ogg.encode(payload, b"12345678", packet=packet)
        streams, errors = ogg.read(media)
        assert errors == [] and b"".join(streams[ogg.SAMPLES].packets[1:]) == payload
        assert streams[ogg.NOTES].packets == [b"NOTE", b"12345678"]
        for k, granule in streams[ogg.SAMPLES].ends[1:]:
            assert granule == min((k - 1) * packet, n)


def test_damage_is_seen():
    media = bytearray(ogg.encode(bytes(range(256)) * 1000, b"12345678"))
    media[len(media) // 2] ^= 1
    streams, errors = ogg.read(bytes(media))
    assert errors and streams[ogg.NOTES].packets[0] == b"NOTE"
    for cut in (1, 26, 100, len(media) - 5):
        assert ogg.read(bytes(media[:cut]))[1]


def test_documents(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "x" * 64, 0), (4, "é" * 33, 0), (None, "n", 0), (5, "long " * 60_000, 0), (3, "x" * 64, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = ogg.from_media(ogg.to_media(df)).collect()
    assert len(got) == len(rows)
    assert all(r.errors == "" for r in got)
    by = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        r = by[doc_id]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert by[1].media_sha256 == by[2].media_sha256 and by[1].feature == by[2].feature
    assert ogg.from_media(ogg.to_media(df.limit(0))).collect() == []
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert all(r.errors for r in ogg.from_media(bad).collect())
