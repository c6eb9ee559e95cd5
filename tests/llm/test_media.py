import hashlib
import struct
import zlib

import numpy as np
import pytest

from duovox.llm import media


@pytest.mark.parametrize("kind", range(5))
def test_reader_undoes_every_filter(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (7, 5)).astype(int)
    rows = b""
    for y in range(7):
        coded = []
        for x in range(5):
            a = image[y, x - 1] if x else 0
            b = image[y - 1, x] if y else 0
            c = image[y - 1, x - 1] if x and y else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: (abs(p - v), (a, b, c).index(v)))
            coded.append((image[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows += bytes([kind, *coded])
    data = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 0, 0, 0, 0))
    half = zlib.compress(rows)
    data += media._chunk(b"tEXt", b"a\0b") + media._chunk(b"IDAT", half[:9]) + media._chunk(b"IDAT", half[9:]) + media._chunk(b"IEND", b"")
    assert (media.read_png(data) == image).all()


def test_round_trip_uses_several_filters():
    ramp = np.add.outer(np.arange(40) * 3, np.arange(64) * 5).astype(np.uint8)
    noise = np.random.default_rng(1).integers(0, 256, (40, 64)).astype(np.uint8)
    image = np.concatenate([ramp, noise, np.zeros((3, 64), np.uint8)])
    data = media.write_png(image)
    raw = zlib.decompress(data[41 : 41 + struct.unpack(">I", data[33:37])[0]])
    assert len(set(raw[:: 65])) > 1
    assert (media.read_png(data) == image).all()


def test_damage_is_found():
    data = bytearray(media.write_png(np.zeros((2, 64), np.uint8)))
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(data))
    with pytest.raises(ValueError):
        media.read_png(b"GIF89a")
    with pytest.raises(ValueError):
        media.read_png(media.write_png(np.zeros((2, 64), np.uint8))[:-12])


def test_cosine_hash_matches_plain_float_transform():
    thumbs = np.random.default_rng(2).integers(0, 4000, (5, 32, 32))
    n = np.arange(32)
    basis = np.array([[np.cos(np.pi * (2 * x + 1) * k / 64) for x in n] for k in range(8)])
    for h, t in zip(media.cosine_hashes(thumbs), thumbs):
        low = (basis @ t @ basis.T).ravel()
        bits = low > np.median(low[1:])
        assert bin(int(h, 16) ^ int(np.packbits(bits).tobytes().hex(), 16)).count("1") <= 1


def test_table(spark):
    texts = ["", None, "a", "a", "é" * 32, "x" * 64, "y" * 65, "z" * 200_000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, b"s") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = media.media_digest(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[3 if r.doc_id is None else r.doc_id] or ""
        want = media.payload(text)
        assert (r.n_bytes, r.payload_bytes) == (len(text.encode()), len(want)) and len(want) % 64 == 0 and want
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
    by = {r.doc_id: r for r in got}
    assert by[2].feature == by[None].feature and by[2].media_sha256 == by[None].media_sha256 and by[0].feature == by[1].feature
    assert media.media_digest(docs.limit(0)).collect() == []
    full = media.with_media(docs.drop("media")).collect()
    assert (media.read_png(full[2].media).tobytes()) == media.payload("a")
