import random
import struct

from flowkit.llm import media


def test_round_trip_and_facts():
    r = random.Random(5)
    for n in (0, 1, 64, 73, 936, 937, 938, 5000, 20_000):
        data = bytes(r.randrange(256) for _ in range(n))
        stream = media.to_stream(data)
        x = media.from_stream(stream)
        assert x["payload"] == data and x["payload_ok"] and x["skipped"] == 0
        assert x["vbr_frames"] == len(x["offsets"]) == x["crc_checked"] and x["crc_failed"] == 0
        assert x["samples"] == 1152 * len(x["offsets"]) and x["sample_rate"] == 48000 and x["layer"] == 3
        assert all(media.header(int.from_bytes(stream[o : o + 4], "big")) for o in x["offsets"])
        assert len(x["toc"]) == 100


def test_crc_is_the_standard_one():
    assert media.crc16(int.from_bytes(b"123456789", "big"), 72) == 0xAEE7  # CRC-16/CMS


def test_damage_is_found():
    data = bytes(range(256)) * 20
    stream = media.to_stream(data)
    x = media.from_stream(stream)
    hit = bytearray(stream)
    hit[x["offsets"][2] + 10] ^= 1  # side information of a frame
    y = media.from_stream(bytes(hit))
    assert y["crc_failed"] == 1 and len(y["offsets"]) == len(x["offsets"])
    hit = bytearray(stream)
    hit[x["offsets"][2]] = 0  # a lost header
    y = media.from_stream(bytes(hit))
    assert len(y["offsets"]) == len(x["offsets"]) - 1 and y["skipped"] == 960 and y["payload_ok"] is False
    cut = media.from_stream(stream[: x["offsets"][-1] + 10])
    assert len(cut["offsets"]) == len(x["offsets"]) - 1 and cut["skipped"] == 10


def frames(head, count, fill=0):
    h = media.header(int.from_bytes(head, "big"))
    return (head + bytes([fill]) * (h.length - 4)) * count


def test_other_streams():
    # layer II, 44.1 kHz, 128 kbit/s, with padding in one frame; junk before, ID3v1 behind
    plain, padded = bytes([0xFF, 0xFD, 0x80, 0x00]), bytes([0xFF, 0xFD, 0x82, 0x00])
    tail = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(65)
    x = media.from_stream(b"junk\xff\xfb" + frames(plain, 3) + frames(padded, 1) + frames(plain, 1) + tail)
    assert (x["layer"], len(x["offsets"]), x["samples"], x["skipped"], x["tags"]) == (2, 5, 5 * 1152, 6, {"TIT2": "Title", "TPE1": "Artist"})
    assert x["offsets"][0] == 6 and x["offsets"][1] - x["offsets"][0] == 417 and x["offsets"][4] - x["offsets"][3] == 418
    # MPEG-2 layer III and MPEG-1 layer I
    assert media.from_stream(frames(bytes([0xFF, 0xF3, 0x80, 0xC0]), 4))["samples"] == 4 * 576
    assert media.from_stream(frames(bytes([0xFF, 0xFF, 0x80, 0xC0]), 4))["samples"] == 4 * 384
    vbri = bytearray(frames(bytes([0xFF, 0xFB, 0x90, 0x00]), 2))
    vbri[36:54] = b"VBRI" + struct.pack(">HHHII", 1, 0, 75, 12345, 77)
    x = media.from_stream(bytes(vbri))
    assert (x["vbr_frames"], x["vbr_bytes"], len(x["offsets"])) == (77, 12345, 1)


def test_no_audio_at_all():
    for data in (b"", b"\xff", b"no sync here", b"\xff" * 500, b"ID3\3\0\0\0\0\0\x05abcde", b"TAG" * 50):
        x = media.from_stream(data)
        assert x["layer"] is None and x["samples"] == 0 and x["offsets"] == []


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, b"abc"), (2, None), (3, b"")], "id long, media binary")
    out = df.withColumn("stream", media.store()("media")).withColumn("m", media.read()("stream")).select("id", "m.payload", F.size("m.offsets").alias("n"), "m.tags").orderBy("id").collect()
    assert [bytes(r.payload) for r in out] == [b"abc", b"", b""] and [r.n for r in out] == [1, 1, 1]
    assert out[0].tags["payload_bytes"] == "3"
    assert df.select(media.read()("media").alias("m")).select("m.layer").distinct().collect()[0][0] is None


def bits_crc(bits):
    """CRC-16 of a string of 0 and 1, by polynomial division."""
    work = [int(b) ^ (i < 16) for i, b in enumerate(bits + "0" * 16)]
    for i in range(len(bits)):
        if work[i]:
            for j, p in enumerate("11000000000000101"):
                work[i + j] ^= int(p)
    return int("".join(map(str, work[-16:])), 2)


def test_crc_of_layers_one_and_two():
    """Frames whose allocations are made by hand: each covered bit counts, and no other."""
    r = random.Random(8)
    cases = [
        # header; bits of a subband's allocation; subbands with an allocation for each channel; channels; scale factor choices?
        (bytes([0xFF, 0xFE, 0x84, 0x00]), [4] * 32, 32, 2, False),  # layer I, stereo
        (bytes([0xFF, 0xFE, 0x84, 0xC0]), [4] * 32, 0, 1, False),  # layer I, mono
        (bytes([0xFF, 0xFE, 0x84, 0x50]), [4] * 32, 8, 2, False),  # layer I, joint stereo from subband 8
        (bytes([0xFF, 0xFC, 0xA4, 0x00]), [4] * 11 + [3] * 12 + [2] * 4, 27, 2, True),  # layer II, 48 kHz, 192 kbit/s, stereo
        (bytes([0xFF, 0xFC, 0x20, 0xC0]), [4] * 2 + [3] * 6, 0, 1, True),  # layer II, 44.1 kHz, 48 kbit/s, mono
        (bytes([0xFF, 0xFC, 0xA0, 0x40]), [4] * 11 + [3] * 12 + [2] * 7, 4, 2, True),  # layer II, 44.1 kHz, 192 kbit/s, joint stereo from subband 4
        (bytes([0xFF, 0xF4, 0x84, 0x00]), [4] * 4 + [3] * 7 + [2] * 19, 30, 2, True),  # MPEG-2 layer II
    ]
    for head, widths, bound, channels, choices in cases:
        h = media.header(int.from_bytes(head, "big"))
        body, used = "", 0
        for sub, n in enumerate(widths):
            for _ in range(channels if sub < bound else 1):
                value = r.choice([0, r.randrange(1 << n)])
                body += f"{value:0{n}b}"
                used += bool(value) * (1 if sub < bound else channels)
        if choices:
            body += "".join(r.choice("01") for _ in range(2 * used))
        crc = bits_crc("".join(f"{b:08b}" for b in head[2:4]) + body)
        covered = len(body)
        body += "".join(r.choice("01") for _ in range(8 * (h.length - 6) - covered))
        frame = head + crc.to_bytes(2, "big") + int(body, 2).to_bytes(h.length - 6, "big")
        x = media.from_stream(frame * 3)
        assert (x["layer"], x["crc_checked"], x["crc_failed"]) == (h.layer, 3, 0)
        behind = bytearray(frame)
        behind[-1] ^= 1
        assert media.from_stream(bytes(behind) * 2)["crc_failed"] == 0
        if covered > 8:
            hit = bytearray(frame)
            hit[6] ^= 0x10
            assert media.from_stream(bytes(hit) * 2)["crc_failed"] == 2


def test_query_columns_in_plain_python(spark):
    """Every column of the query from the texts alone; features and offsets from the bytes stored."""
    import hashlib
    import zlib

    from flowkit.llm.queries import op4_media

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(64 if not data else -len(data) % 64)
        stream = media.to_stream(payload)
        expected = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == expected
        assert r.duration_s == len(r.frame_offsets) * 1152 / 48000
        assert all(stream[a : a + 2] == b"\xff\xfa" for a in r.frame_offsets) and f"frames={len(r.frame_offsets)};last={r.frame_offsets[-1]}" in r.feature
