"""The source of labelled images: formats byte by byte, reasons of rejects, pushed filters, partitions."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from samplekit.sources import imagefiles as files
from samplekit.sources import scan


def noise(seed, h, w, c=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(np.uint8)


def png(image, kinds, colour):
    """All five filters, as kinds asks for line by line; by the definition of the format."""
    h, w, c = image.shape
    raw, zero = b"", np.zeros((w, c), int)
    for y in range(h):
        up = image[y - 1].astype(int) if y else zero
        left = np.vstack((np.zeros((1, c), int), image[y, :-1].astype(int)))
        corner = np.vstack((np.zeros((1, c), int), up[:-1]))
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = (zero, left, up, (left + up) // 2, paeth)[kinds[y % len(kinds)]]
        raw += bytes([kinds[y % len(kinds)]]) + ((image[y].astype(int) - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour, channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png(colour, channels):
    image = noise(colour, 9, 7, channels)
    want = np.repeat(image[..., :1], 3, 2) if channels < 3 else image[..., 2::-1]
    for kinds in ([0], [1], [2], [3], [4], [0, 4, 3, 2, 1]):
        assert (files.decoded(png(image, kinds, colour)) == want).all()


def test_portable_maps_and_bitmaps():
    gray, colour = noise(1, 5, 7, 1), noise(2, 5, 7)
    text = b"P2 # made by hand\n7 5\n# most\n255\n" + b" ".join(b"%d" % v for v in gray.ravel())
    assert (files.decoded(text) == gray).all() and files.decoded(text).shape == (5, 7, 3)
    assert (files.decoded(files.encoded(5, 7, 1, gray.tobytes())[1]) == gray).all()
    assert (files.decoded(b"P6 7 5 255\n" + colour.tobytes()) == colour[..., ::-1]).all()
    assert (files.decoded(b"P5 2 1 15\n\0\x0f") == [[[0] * 3, [255] * 3]]).all()
    assert (files.decoded(b"P5 2 1 65535\n\0\0\xff\xff") == [[[0] * 3, [255] * 3]]).all()
    kind, body = files.encoded(5, 7, 3, colour.tobytes())
    assert kind == "bmp" and (files.decoded(body) == colour).all()


@pytest.mark.parametrize(
    "body, reason",
    [(b"", "empty file"), (b"no image", "no known format"), (b"P5\n0 4\n255\n", "zero size"), (b"P5\n9 9\n255\nabc", "cut off"), (b"P2 x", "broken header"), (b"BM", "cut off"), (b"\xff\xd8\xff\xe0", "jpeg under another format's extension"), (png(noise(1, 4, 4), [0], 2)[:60], "cut off"), (b"P5\n4 4\n99999\n" + b"a" * 16, "broken header")],
)
def test_reasons(body, reason):
    with pytest.raises(files.Undecodable, match=reason):
        files.decoded(body)


def test_scan(spark, tmp_path):
    for kind in files.CLASSES:
        for split in files.SPLITS:
            (tmp_path / f"{kind}_{split}").mkdir()
            for k in range(6):
                (tmp_path / f"{kind}_{split}" / f"{k}.pgm").write_bytes(files.encoded(4, 5, 1, noise(k, 4, 5, 1).tobytes())[1])
            (tmp_path / f"{kind}_{split}" / "W.PNG").write_bytes(png(noise(3, 4, 5), [4], 2))
            (tmp_path / f"{kind}_{split}" / "note.txt").write_text("x")
    broken = {"attack_training/a.bmp": b"", "attack_validation/b.png": b"\xff\xd8\xff\xe0", "bonafide_training/c.pgm": b"P5\n0 0\n255\n", "bonafide_validation/d.jpg": b"no image"}
    for name, body in broken.items():
        (tmp_path / name).write_bytes(body)
    df = scan.scan_images(spark, str(tmp_path), "mine", part_bytes=3 * files.FILE_BYTES // 16)
    assert scan.readable_images(df).count() == 28
    rejects = {r.path.split(str(tmp_path) + "/")[1]: r.reason for r in scan.rejected_images(df).collect()}
    assert rejects == {"attack_training/a.bmp": "empty file", "attack_validation/b.png": "jpeg under another format's extension", "bonafide_training/c.pgm": "zero size", "bonafide_validation/d.jpg": "no codec decodes it"}
    one = df.where("label = 1 and split = 'training' and pixels is not null")
    assert one.count() == 7 and {r.channels for r in one.collect()} == {3}
    reader = files.ImageReader(str(tmp_path), 1 << 40)
    left = list(reader.pushFilters([files.EqualTo(("label",), 1), files.In(("split",), ("training", "other")), files.EqualTo(("path",), "x")]))
    assert [f.attribute for f in left] == [("path",)]
    assert {(label, split) for p in reader.partitions() for _, label, split in p.files} == {(1, "training")}
    assert len(files.ImageReader(str(tmp_path), 3 * files.FILE_BYTES // 16).partitions()) == 11
    assert scan.scan_images(spark, str(tmp_path / "absent"), "mine").count() == 0


def test_written_images_come_back(spark, tmp_path):
    rows = [(f"n{k}", k % 2, files.SPLITS[k % 3 > 0], 3, 5, 1 + 2 * (k % 2), noise(k, 3, 5, 1 + 2 * (k % 2)).tobytes()) for k in range(20)]
    files.register(spark)
    spark.createDataFrame(rows, "name string, label int, split string, height int, width int, channels int, pixels binary").repartition(3).write.format("labelled_images").mode("append").save(str(tmp_path / "out"))
    got = {r.path.rsplit("/", 1)[1].split(".")[0]: (r.label, r.split, bytes(r.pixels)) for r in scan.scan_images(spark, f"file://{tmp_path}/out", "d").collect()}
    want = {n: (y, s, (np.repeat(np.frombuffer(p, np.uint8), 3) if c == 1 else np.frombuffer(p, np.uint8)).tobytes()) for n, y, s, _, _, c, p in rows}
    assert got == want
