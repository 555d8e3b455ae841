import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from oddities import BASE, empty, odd

from loomlog.llm import media


@pytest.mark.parametrize("payload", [bytes(64), b"\xff" * 640, bytes(range(256)) * 5, os.urandom(64 * 333), b"text " * 64])
def test_round_trip(payload):
    (stored,) = media.encode_payloads([payload])
    images = media.parse_images(stored)
    assert b"".join(t.tobytes() for t in media.thumbnails(images)) == payload
    assert [(i.width, i.height) for i in images] == [(512, len(payload) // 8)]


def test_long_payloads_become_several_images():
    payload = os.urandom(64 * (media.MOST_ROWS + 3))
    one, two = media.encode_payloads([payload, bytes(64)])
    images = media.parse_images(one)
    assert [i.height for i in images] == [8 * media.MOST_ROWS, 24]
    assert b"".join(t.tobytes() for t in media.thumbnails(images)) == payload
    assert media.thumbnails(media.parse_images(two))[0].tobytes() == bytes(64)


# A general baseline writer with full AC codes, as a counterpart: one bit string after another.
DC = {s: (s, 4) for s in range(12)}
AC = {(r << 4) | s: (k, 8) for k, (r, s) in enumerate([(0, 0), (15, 0)] + [(r, s) for r in range(16) for s in range(1, 11)])}


def coded(value):
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def write_jpeg(rng, width, height, sampling, restart):
    """A JPEG of random coefficients; returns it with the luminance DC terms of each block."""
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    single = len(sampling) == 1
    across, down = -(-width // (8 * (1 if single else wide))), -(-height // (8 * (1 if single else high)))
    h0, v0 = (1, 1) if single else sampling[0]
    luma = np.zeros((down * v0, across * h0), dtype=int)
    parts, bits, last = [], "", [0] * len(sampling)

    def close():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
        bits = ""
        return data.replace(b"\xff", b"\xff\x00")

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            parts.append(close() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]))
            last = [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for k in range(1 if single else h * v):
                dc = rng.randint(-100, 100)
                size, own = coded(dc - last[c])
                last[c] = dc
                code, n = DC[size]
                bits += format(code, f"0{n}b") + own
                if c == 0:
                    luma[unit // across * v0 + k // h0, unit % across * h0 + k % h0] = dc
                place = 1
                while place < 64:
                    run = rng.choice([0, 1, 3, 17, 63])
                    if place + run >= 64:
                        code, n = AC[0]
                        bits += format(code, f"0{n}b")
                        break
                    while run > 15:
                        code, n = AC[0xF0]
                        bits += format(code, f"0{n}b")
                        run, place = run - 16, place + 16
                    size, own = coded(rng.choice([-1, 1]) * rng.randint(1, 1023))
                    code, n = AC[run << 4 | size]
                    bits += format(code, f"0{n}b") + own
                    place += run + 1
    parts.append(close())
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    table = lambda kind, codes, bits: bytes([kind]) + bytes(len(codes) if k == bits else 0 for k in range(1, 17)) + bytes(codes)
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0]) + bytes([3]) * 64)
    out += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)))
    out += seg(0xC4, table(0, DC, 4) + table(0x10, AC, 8))
    if restart:
        out += seg(0xDD, struct.pack(">H", restart))
    out += seg(0xDA, bytes([len(sampling)]) + b"".join(bytes([c + 1, 0]) for c in range(len(sampling))) + b"\0\x3f\0")
    return out + b"".join(parts) + b"\xff\xd9", luma


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_general_baseline_images(sampling, restart):
    rng = random.Random(restart)
    made = [write_jpeg(rng, w, h, sampling, restart) for w, h in ((8, 8), (33, 17), (64, 40))]
    images = [i for data, _ in made for i in media.parse_images(data)]
    for image, (_, luma), thumb in zip(images, made, media.thumbnails(images), strict=True):
        want = np.clip(luma * 3 // 8 + 128, 0, 255)[: -(-image.height // 8), : -(-image.width // 8)]
        assert (thumb == want).all()


@pytest.mark.parametrize("cut", [0, 1, 5, 30, 90, -3, -1])
def test_damaged_values_are_told(cut):
    data = media.encode_payloads([os.urandom(640)])[0]
    with pytest.raises((media.MediaError, struct.error, IndexError, KeyError)):
        media.thumbnails(media.parse_images(data[:cut] or b"x"))
    with pytest.raises(media.MediaError):
        media.parse_images(data.replace(b"\xff\xc0", b"\xff\xc2"))


def test_tables(spark):
    rows = media.text_media(odd(spark)).collect()
    texts = {i: (t or "").encode() for i, t, *_ in BASE}
    assert len(rows) == len(BASE)
    for r in rows:
        if r["doc_id"] == 10:
            continue
        text = texts[r["doc_id"]]
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None)
    same = [r for r in rows if r["doc_id"] in (1, 2)]
    assert same[0]["feature"] == same[1]["feature"] and same[0]["media_sha256"] == same[1]["media_sha256"]
    assert media.text_media(empty(spark)).collect() == []
    bad = spark.createDataFrame([(1, 3, bytearray(b"GIF")), (2, 0, None), (3, 64, bytearray(media.encode_payloads([bytes(64)])[0]))], "doc_id bigint, n_bytes bigint, media binary")
    got = {r["doc_id"]: r for r in media.jpeg_features(bad).collect()}
    assert got[1]["error"] and got[2]["error"] and got[1]["payload_sha256"] is None and got[3]["error"] is None and got[3]["payload_bytes"] == 64
