import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from tesserae.llm import media as M

from .helpers import corpus, frame


def bmp(rows, bits=24, palette=None, top_down=False):
    h, w = len(rows), len(rows[0])
    lines = []
    for r in rows if top_down else rows[::-1]:
        raw = b"".join(bytes(p[::-1]) for p in r) if bits == 24 else bytes(r)
        lines.append(raw + b"\0" * (-len(raw) % 4))
    pal = b"".join(bytes(c[::-1]) + b"\0" for c in palette or [])
    data = b"".join(lines)
    head = struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, bits, 0, len(data), 0, 0, len(palette or []), 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(pal) + len(data), 0, 0, 54 + len(pal)) + head + pal + data


def test_netpbm_kinds():
    assert M.decode_netpbm(b"P1\n# c\n3 2\n101\n0 1 0").tolist() == [[True, False, True], [False, True, False]]
    assert M.decode_netpbm(b"P2 2 2 9\n1 2\n3 9").tolist() == [[1, 2], [3, 9]]
    assert M.decode_netpbm(b"P3 1 1 255 7 8 9").tolist() == [[[7, 8, 9]]]
    assert M.decode_netpbm(b"P4 10 1\n\xaa\x80").astype(int).tolist() == [[1, 0, 1, 0, 1, 0, 1, 0, 1, 0]]
    assert M.decode_netpbm(b"P5 2 1 65535\n\x01\x02\xff\xff").tolist() == [[258, 65535]]
    assert M.decode_netpbm(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    for broken in (b"", b"P7 1 1 1\n", b"P5 2 2 255\nab", b"P5 0 1 255\n"):
        with pytest.raises(ValueError):
            M.decode_netpbm(broken)


def test_bmp_kinds():
    image = [[(1, 2, 3), (4, 5, 6), (7, 8, 9)], [(10, 11, 12), (13, 14, 15), (16, 17, 18)]]
    for top_down in (False, True):
        assert M.decode(bmp(image, top_down=top_down)).tolist() == [[list(p) for p in r] for r in image]
    grey = [(i, i, i) for i in range(4)]
    assert M.decode(bmp([[0, 3], [2, 1]], 8, grey)).tolist() == [[0, 3], [2, 1]]
    with pytest.raises(ValueError):
        M.decode(b"BM" + b"\0" * 60)


def test_area_resize_is_the_exact_mean_of_areas():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (12, 18)).astype("u1")
    assert np.allclose(M.area_resize(a, 4, 6), a.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    for h, w, r, c in ((5, 7, 3, 4), (1, 64, 8, 9), (3, 2, 8, 8)):
        a = rng.random((h, w))
        fine = np.kron(a, np.ones((r, c)))  # each pixel as r x c parts, of which each target cell gets h x w whole ones
        assert np.allclose(M.area_resize(a, r, c), fine.reshape(r, h, c, w).mean(axis=(1, 3)))


def test_hash_and_tiles():
    ramp = np.tile(np.arange(64), (64, 1))
    assert int(M.difference_hash(ramp)) == 2**64 - 1 and int(M.difference_hash(ramp[:, ::-1])) == 0
    cut, hashes = M.tiles(ramp)
    assert cut.shape == (4, 16, 16) and hashes.shape == (4,)
    assert np.array_equal(np.load(io.BytesIO(M.npy(cut[0]))), cut[0])


def test_media_features(spark):
    data = [(1, b"P5 2 2 255\nabcd"), (None, bmp([[(1, 2, 3)]])), (2, None), (3, b"junk"), (3, b"junk")]
    out = M.media_features(spark.createDataFrame(data, "k long, m binary"), "k", "m").collect()
    assert sorted((r["k"] or 0, r["error"] is None) for r in out) == [(0, True), (1, True), (2, False), (3, False), (3, False)]
    good = next(r for r in out if r["k"] == 1)
    assert (good["height"], good["width"], good["channels"], len(good["tiles"])) == (2, 2, 1, 4)


def test_texts_round_trip(spark):
    rows = corpus()
    out = {r["doc_id"]: r for r in M.text_media(frame(spark, rows), with_media=True).collect()}
    assert len(out) == len(rows)
    for i, text, *_ in rows:
        raw, r = (text or "").encode(), out[i]
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and M.decode(bytes(r["media"])).tobytes() == payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
    assert out[21]["feature"] == out[24]["feature"]  # null and empty
    assert M.text_media(frame(spark, [])).count() == 0


def test_broken_headers_and_samples_are_errors(spark):
    files = [b"P5 99999999999999 99999999999999 255", b"P2 2 1 255 1 " + b"9" * 26, b"P2 2 1 44 300 1", b"P5 2 1 10 \x0b\x01", b"P4 99999999999 9999999999 ", b"BM" + b"\x7f" * 60, b"P3 1 1 255 -1 2 3"]
    df = spark.createDataFrame(list(enumerate(files)), "id int, media binary")
    out = M.media_features(df, "id", "media").collect()
    assert len(out) == len(files) and all(r["error"] and r["hash"] is None and r["tiles"] is None for r in out)


def test_features_like_a_plain_computation(spark):
    def mean(image, top, bottom, left, right):  # over an exact area, pixel by pixel
        total = 0.0
        for y in range(int(top), min(image.shape[0], int(np.ceil(bottom)))):
            for x in range(int(left), min(image.shape[1], int(np.ceil(right)))):
                total += float(image[y, x]) * (min(bottom, y + 1) - max(top, y)) * (min(right, x + 1) - max(left, x))
        return total / ((bottom - top) * (right - left))

    def resized(image, rows, columns):
        h, w = image.shape
        return np.array([[mean(image, h * i / rows, h * (i + 1) / rows, w * j / columns, w * (j + 1) / columns) for j in range(columns)] for i in range(rows)])

    def bits(image):
        small = np.round(resized(image, 8, 9), 6)
        return f"{int(''.join(str(int(a < b)) for r in small for a, b in zip(r, r[1:])), 2):016x}"

    rows = [(1, "a few words " * 30), (None, None), (2, ""), (2, "é" * 100), (3, "a few words " * 30)]
    out = M.text_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and sum(r["doc_id"] is None for r in out) == 1 and sum(r["doc_id"] == 2 for r in out) == 2
    for r in out:
        text = next(t for i, t in rows if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"])
        raw = (text or "").encode().ljust(r["payload_bytes"], b"\0")
        image = np.frombuffer(raw, "u1").reshape(-1, 64)
        small = np.rint(np.round(resized(image, 32, 32), 9))
        cut = [small[y : y + 16, x : x + 16] for y in (0, 16) for x in (0, 16)]
        assert r["feature"] == bits(image) + ":" + "".join(bits(c) for c in cut)
        assert all(np.array_equal(M.read_npy(bytes(t)), c) for t, c in zip(r["tiles"], cut, strict=True))
