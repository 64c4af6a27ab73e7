"""Encoders against independent decoders, and image statistics against direct formulas."""

import random
import zlib

import numpy as np
import pytest

from foliospark.functions import deflate, images, jpeg, jpeg_decode, predictor

RNG = random.Random(1)
INPUTS = [b"", b"a", b"ab" * 3, b"\xab" * 4096, b"The quick brown fox jumps over the lazy dog. " * 200, bytes(RNG.randrange(256) for _ in range(10_000)), bytes(range(256)), bytes(k * 7 % 251 for k in range(512)), bytes(RNG.choice(b"abc ") for _ in range(40_000))]


@pytest.mark.parametrize("data", INPUTS, ids=len)
def test_deflate_is_read_by_zlib(data):
    out = deflate.compress_zlib(data)
    assert zlib.decompress(out) == data == zlib.decompress(deflate.compress(data))
    assert out[:2] == b"\x78\xda" and deflate.restore(deflate.parse(data)) == data


def test_deflate_shrinks_prose():
    assert len(deflate.deflate(INPUTS[4])) < len(INPUTS[4]) / 2


@pytest.mark.parametrize("limit", [7, 15])
def test_code_lengths_are_complete_and_limited(limit):
    for seed in range(40):
        rng = random.Random(seed)
        freq = [int(1.7**k) if seed == 0 else rng.choice([0, 1, 1, 5, 10**rng.randrange(6)]) for k in range(30)]
        lengths = deflate.code_lengths(freq, limit)
        used = [n for n in lengths if n]
        assert max(used) <= limit and [n > 0 for n in lengths] == [f > 0 for f in freq]
        assert len(used) < 2 or sum(2.0**-n for n in used) == 1


def test_adler_of_a_known_word():
    assert int.from_bytes(deflate.compress_zlib(b"Wikipedia")[-4:]) == 0x11E60398


def test_png_rows():
    rng = np.random.default_rng(0)
    for stride, bpp in ((24, 3), (7, 1), (4, 4), (2, 3)):
        data = rng.integers(0, 256, stride * 9, dtype=np.uint8).tobytes()
        out = predictor.encode_png_best(data, stride, bpp)
        assert predictor.decode_png(out, stride, bpp) == data
        for kind in range(5):
            rows = bytearray(out)
            rows[0] = kind
            assert predictor.decode_png(bytes(rows), stride, bpp) is not None
    assert predictor.decode_png(b"\x05aa", 2, 1) is None and predictor.decode_png(b"\x00a", 2, 1) is None
    assert predictor.encode_png_best(bytes(24), 12, 3)[0] == 0
    assert predictor.decode_tiff(predictor.encode_tiff(b"abcdefgh!", 4, 2), 4, 2) == b"abcdefgh!"


def test_jpeg_is_read_by_an_independent_decoder(spark, tmp_path):
    w, h = 24, 17
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    smooth = np.stack([x * 10, y * 12, (x + y) * 5], 2).astype(np.uint8)
    solid = np.full((16, 16, 3), (200, 40, 80), np.uint8)
    for name, p in (("smooth", smooth), ("solid", solid), ("dot", solid[:1, :1]), ("odd", smooth[:5, :7])):
        for sub in (False, True):
            (tmp_path / f"{name}_{sub}.jpg").write_bytes(jpeg.encode_rgb(p.shape[1], p.shape[0], p.tobytes(), 95, sub))
    got = {r["image"]["origin"].rsplit("/", 1)[1]: r["image"] for r in spark.read.format("image").load(str(tmp_path)).collect()}
    for name, p in (("smooth", smooth), ("solid", solid), ("dot", solid[:1, :1]), ("odd", smooth[:5, :7])):
        i = got[f"{name}_False.jpg"]
        back = np.frombuffer(bytes(i["data"]), np.uint8).reshape(i["height"], i["width"], 3)[..., ::-1]
        assert back.shape == p.shape and np.abs(back.astype(int) - p).mean() < 8
        assert got[f"{name}_True.jpg"]["width"] == p.shape[1]
    i = got["smooth_False.jpg"]
    back = np.frombuffer(bytes(i["data"]), np.uint8).reshape(h, w, 3)[..., ::-1].tobytes()
    assert images.ssim(w, h, smooth.tobytes(), back) >= 0.98
    assert len(jpeg.encode_rgb(w, h, smooth.tobytes(), 15)) < len(jpeg.encode_rgb(w, h, smooth.tobytes(), 90))
    with pytest.raises(ValueError):
        jpeg.encode_rgb(70_000, 1, bytes(210_000), 50)


def test_jpeg_decoder_reads_what_the_jvm_writes(spark, tmp_path):
    """Pictures by the JVM's own writer, read by it and by the decoder here."""
    jvm = spark.sparkContext._jvm
    for kind, channels in ((5, 3), (10, 1)):
        image = jvm.java.awt.image.BufferedImage(37, 21, kind)
        for x in range(37):
            for y in range(21):
                image.setRGB(x, y, (x * 6) << 16 | (y * 11) << 8 | (x + y) * 3)
        path = str(tmp_path / f"{channels}.jpg")
        jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(path))
        w, h, c, data = jpeg_decode.decode(open(path, "rb").read())
        assert (w, h, c) == (37, 21, channels)
        i = spark.read.format("image").load(path).first()["image"]
        want = np.frombuffer(bytes(i["data"]), np.uint8).reshape(21, 37, channels)[..., ::-1].astype(int)
        assert np.abs(np.frombuffer(data, np.uint8).reshape(21, 37, channels) - want).mean() < 4
    for bad in (b"", b"\xff\xd8\xff\xd9", b"\xff\xd8" + bytes(40)):
        with pytest.raises(ValueError):
            jpeg_decode.decode(bad)


def test_quant_scaling():
    base = np.full(64, 16)
    assert set(jpeg.scaled_quant(base, 100)) == {1} and set(jpeg.scaled_quant(base, 1)) == {255}


def test_image_kinds_and_gate():
    bw = np.indices((32, 32)).sum(0) % 2 * 255
    assert images.classify(32, 32, np.repeat(bw.astype(np.uint8)[..., None], 3, 2).tobytes()) == "Bitonal"
    assert images.classify(0, 0, b"") == "Photo" and images.passes_gate((0, 0, b""), (0, 0, b""))
    x, y = np.meshgrid(np.arange(64), np.arange(64))
    photo = np.stack([127 + 100 * np.sin(x / 9), 127 + 100 * np.cos(y / 7), (x * 3 + y) % 256], 2).astype(np.uint8).tobytes()
    assert images.classify(64, 64, photo) == "Photo"
    assert images.passes_gate((64, 64, photo), (64, 64, photo)) and not images.passes_gate((64, 64, photo), (64, 64, photo[::-1]))
    assert not images.passes_gate((64, 64, photo), (32, 128, photo))


def test_resampling():
    assert images.fit(3840, 2160, 1920) == (1920, 1080) and images.fit(10, 5, 1920) == (10, 5) and images.fit(5000, 1, 1920) == (1920, 1)
    assert images.resize(np.array([[[0], [10]], [[30], [60]]], np.uint8), 1, 1).item() == 25
    data = np.random.default_rng(3).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (images.resize(data, 5, 7) == data).all()
    want = [[data[a * 7 // 3 : (a + 1) * 7 // 3, b * 5 // 2 : (b + 1) * 5 // 2, 0].astype(int).sum() // data[a * 7 // 3 : (a + 1) * 7 // 3, b * 5 // 2 : (b + 1) * 5 // 2, 0].size for b in range(2)] for a in range(3)]
    assert images.resize(data, 2, 3)[..., 0].tolist() == want
