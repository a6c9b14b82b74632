"""Pixel kernels against hand-worked values; scans of small files; streaming."""

from __future__ import annotations

import colorsys
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplekit.functions import pixels as px
from samplekit.operators import features, images
from samplekit.sources import scan, sinks
from samplekit.streaming.running import running_error_rates

I, J = np.mgrid[0:8, 0:8]
CASES = {
    "flat": (np.full((8, 8), 128.0), (0, 0, 128, 1, 0, 0.2, False)),
    "ramp": (32.0 * J, (774.4, 73.321211, 112, 0.875, 322123.1616, 0.975, True)),
    "checker": ((I + J) % 2 * 255.0, (728280, 127.5, 127.5, 0.996094, 624.24, 0.999219, True)),
    "step": ((J >= 4) * 200.0, (7060, 100, 100, 0.78125, 30720006, 0.95625, True)),
}


@pytest.mark.parametrize("name", CASES)
def test_quality(spark, name):
    image, expected = CASES[name]
    df = spark.createDataFrame([(1, 8, 8, image.ravel().tolist())], "sample_id long, height int, width int, pixels array<double>")
    r = features.with_composite(images.with_quality(df)).withColumn("accepted", features.quality_gate(0.65)).first()
    assert (r.sharpness, r.contrast, r.mean_brightness, r.brightness_score, r.blur_score, r.composite_score) == pytest.approx(expected[:6], rel=1e-5, abs=1e-6)
    assert r.accepted == expected[6]


def test_gate_limits(spark):
    df = spark.createDataFrame([(40.0, 20.0, 81.0), (220.0, 20.0, 81.0), (39.9, 20.0, 81.0), (128.0, 15.0, 81.0), (128.0, 20.0, 80.0)], "mean_brightness double, contrast double, blur_score double").withColumn("sharpness", F.lit(100.0))
    got = [r.a for r in features.with_composite(df).select(features.quality_gate(0.4).alias("a")).collect()]
    assert got == [True, True, False, False, False]
    assert features.gate_threshold(0.85, "premium") == 0.9 and features.gate_threshold(0.45, "basic") == 0.4
    with pytest.raises(ValueError):
        features.quality_gate(2)


def test_what_is_no_image_is_kept_without_values(spark):
    df = spark.createDataFrame([(1, 8, 8, [1.0]), (2, None, 2, [1.0]), (3, 1, 1, None)], "sample_id long, height int, width int, pixels array<double>")
    assert images.with_quality(df).where("sharpness is null").count() == 3
    assert images.enhance_images(df).count() == 3


def test_enhancement_saturates():
    image = np.array([[0.0, 255.0], [128.0, 64.0]])
    out = px.gamma_scaled(image)
    assert out.min() >= 0 and out.max() == 255 and out[0, 0] == 5
    assert px.unsharp(np.full((1, 9, 9), 77.0)).tolist() == np.full((1, 9, 9), 77.0).tolist()
    assert px.resized(np.arange(16.0).reshape(1, 4, 4), 2, 2, "bilinear").tolist() == [[[2.5, 4.5], [10.5, 12.5]]]


def _at(image, y, x):
    """The pixel with mirrored borders, one at a time."""
    def inside(k, n):
        k = abs(k)
        return 2 * (n - 1) - k if k >= n else k

    return image[inside(y, image.shape[0])][inside(x, image.shape[1])]


def _plain_filter(image, kernel):
    r = len(kernel) // 2
    return np.array([[sum(kernel[i + r][j + r] * _at(image, y + i, x + j) for i in range(-r, r + 1) for j in range(-r, r + 1)) for x in range(image.shape[1])] for y in range(image.shape[0])])


def test_kernels_against_loops_over_pixels():
    rng = np.random.default_rng(0)
    stack = rng.integers(0, 256, (3, 9, 11)).astype(float)
    whole = lambda a: np.clip(np.rint(a), 0, 255)
    gauss = [[np.exp(-(i * i + j * j) / 8) for j in range(-6, 7)] for i in range(-6, 7)]
    gauss = np.array(gauss) / np.sum(gauss)
    for k, image in enumerate(stack):
        assert px.unsharp(stack)[k] == pytest.approx(whole(1.5 * image - 0.5 * _plain_filter(image, gauss)))
        sharp = whole(_plain_filter(image, [[0, -0.6, 0], [-0.6, 3.0, -0.6], [0, -0.6, 0]]))
        assert px.frame_sharpen(stack)[k] == pytest.approx(whole(0.7 * image + 0.3 * sharp))
        middle = [[np.median([_at(image, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]) for x in range(11)] for y in range(9)]
        assert px.median_filtered(stack, 3)[k].tolist() == np.array(middle).tolist()
        y, x = 1.5 * 9 / 5 - 0.5, 2.5 * 11 / 7 - 0.5
        a, b = int(y), int(x)
        expected = sum(image[a + i][b + j] * (1 - abs(y - a - i)) * (1 - abs(x - b - j)) for i in (0, 1) for j in (0, 1))
        assert px.resized(stack, 5, 7, "bilinear")[k][1][2] == pytest.approx(expected)


def test_two_stage_gate(spark):
    rows = [(k, 8, 8, CASES[n][0].ravel().tolist()) for k, n in enumerate(("flat", "ramp", "checker", "step"))]
    raw = spark.createDataFrame(rows, "sample_id long, height int, width int, pixels array<double>")
    before, after = (features.with_composite(images.with_quality(x)) for x in (raw, images.enhance_images(raw)))
    scores = {r.sample_id: (r.a, r.b) for r in before.select("sample_id", F.col("composite_score").alias("a")).join(after.select("sample_id", F.col("composite_score").alias("b")), "sample_id").collect()}
    got = {r.sample_id: (r.composite_score, r.final.composite_score) for r in features.two_stage_gate(before, after, 0.6).collect()}
    assert got and set(got) <= {1, 2, 3} and all(got[i] == pytest.approx(scores[i]) for i in got)


def test_transforms_against_single_images():
    rng = np.random.default_rng(1)
    gray, colour = rng.integers(0, 256, (4, 5, 7)).astype(float), rng.integers(0, 256, (4, 5, 7, 3)).astype(float)
    whole = lambda a: np.clip(np.rint(a), 0, 255)
    values = np.array([[0.1, -0.2, np.nan], [-0.1, 0.2, np.nan], [0.0, 0.3, np.nan], [0.2, 0.0, np.nan]])
    same = lambda x: np.tile([x, np.nan, np.nan], (4, 1))
    for stack in (gray, colour):
        for k, image in enumerate(stack):
            assert images.transformed(stack, "rotate90", same(1.7), [])[k].tolist() == np.rot90(image).tolist()
            assert images.transformed(stack, "flip", same(0.2), [])[k].tolist() == image[::-1].tolist()
            assert images.transformed(stack, "flip", same(1.2), [])[k].tolist() == image[:, ::-1].tolist()
            assert images.transformed(stack, "flip", same(2.9), [])[k].tolist() == image[::-1, ::-1].tolist()
            assert images.transformed(stack, "transpose", same(np.nan), [])[k].tolist() == np.swapaxes(image, 0, 1).tolist()
            assert images.transformed(stack, "brightness_contrast", values, [])[k] == pytest.approx(whole((1 + values[k, 1]) * image + 255 * values[k, 0]))
            assert images.transformed(stack, "gamma", 100 + 100 * values, [])[k] == pytest.approx(whole((image / 255) ** (1 + values[k, 0]) * 255))
            assert images.transformed(stack, "multiplicative_noise", 1 + values, [])[k] == pytest.approx(whole(image * (1 + values[k, 0])))
    assert images.transformed(gray, "blur", same(3), [])[2] == pytest.approx(whole(_plain_filter(gray[2], np.full((3, 3), 1 / 9))))
    two = np.tile([0.3, 0.6, np.nan], (4, 1))
    for name, kernel in (("emboss", [[-1.6, -0.6, 0], [-0.6, 1, 0.6], [0, 0.6, 1.6]]), ("sharpen", [[-1, -1, -1], [-1, 8.6, -1], [-1, -1, -1]])):
        assert images.transformed(gray, name, two, [])[1] == pytest.approx(whole(0.7 * gray[1] + 0.3 * _plain_filter(gray[1], kernel)))
    shift = np.tile([5.0, -7.0, 20.0], (4, 1))
    assert images.transformed(colour, "rgb_shift", shift, [])[3] == pytest.approx(whole(colour[3] + shift[3]))
    assert (images.transformed(colour, "channel_dropout", same(1.5), [])[..., 1] == 128).all()
    rngs = [np.random.default_rng(k) for k in range(4)]
    assert sorted(images.transformed(colour, "channel_shuffle", same(np.nan), rngs)[0].ravel()) == sorted(colour[0].ravel())
    for name in ("image_compression", "hue_saturation_value", "iso_noise", "rgb_shift", "channel_shuffle"):
        assert images.transformed(gray, name, same(2), rngs) is gray


def test_augmentation(spark):
    df = spark.createDataFrame([(i, 8, 8, np.arange(192.0).tolist()) for i in range(40)], "sample_id long, height int, width int, pixels array<double>")
    plan = images.augmentation_plan(df, "heavy", 3)
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, images.augmentation_plan(df.repartition(5), "heavy", 3).collect()))
    once, again = (sorted((r.sample_id, r.epoch, tuple(r.pixels)) for r in images.apply_augmentation(df.repartition(n), plan, 3).collect()) for n in (1, 6))
    assert once == again and len(once) == 120
    assert all(0 <= min(p) and max(p) <= 255 for _, _, p in once)


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scans(spark, tmp_path):
    for half in ("attack_training", "bonafide_validation"):
        (tmp_path / half).mkdir()
        png(tmp_path / half / "a.png", np.full((4, 5, 3), 90))
        png(tmp_path / half / "B.PNG", np.full((4, 5, 3), 90))
        (tmp_path / half / "broken.jpg").write_bytes(b"no image")
        (tmp_path / half / "note.txt").write_text("x")
        (tmp_path / half / "clip.mp4").write_bytes(b"video")
    df = scan.scan_images(spark, str(tmp_path), "mine")
    assert {(r.label, r.split, r["count"]) for r in df.groupBy("label", "split").count().collect()} == {(1, "training", 3), (0, "validation", 3)}
    assert scan.readable_images(df).count() == 4 and scan.rejected_images(df).count() == 2
    assert scan.scan_videos(spark, str(tmp_path)).count() == 2
    assert scan.scan_images(spark, str(tmp_path / "absent"), "mine").count() == 0


def test_datasets_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "sample_id long, dataset string, split string")
    sinks.write_dataset(df, str(tmp_path / "d"))
    assert [r.sample_id for r in scan.read_dataset(spark, str(tmp_path / "d"), "a").collect()] == [1]
    assert scan.read_dataset(spark, str(tmp_path / "d"), "c", "skip").count() == 0
    with pytest.raises(FileNotFoundError):
        scan.read_dataset(spark, str(tmp_path / "d"), "c")
    (tmp_path / "r1.csv").write_text("epoch,loss\n0,0.5\n1,0.25\n")
    assert [(r.run_id, r.epoch, r.loss) for r in scan.read_epoch_logs(spark, str(tmp_path / "r1.csv"), ["loss"]).orderBy("epoch").collect()] == [("r1", 0, 0.5), ("r1", 1, 0.25)]
    (tmp_path / "h.json").write_text('{"loss": [0.5, 0.25], "accuracy": [0.1, 0.2]}')
    assert scan.read_history(spark, str(tmp_path / "h.json"), ["loss", "accuracy"]).count() == 2
    assert scan.read_stats(spark, str(tmp_path / "none")).count() == 0


def test_results_have_no_nan(spark, tmp_path):
    df = spark.createDataFrame([("m", float("nan"), {"0.1": 0.5})], "model string, eer double, bpcer map<string, double>")
    sinks.write_results(df, str(tmp_path / "r"))
    assert "NaN" not in "".join(p.read_text() for p in (tmp_path / "r").rglob("part-*"))


def test_running_rates_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02d}:00", h % 2, 0.1 * h) for h in range(8) for m in (5, 35)], "t string, label int, score double").select(F.to_timestamp("t").alias("ts"), "label", "score")
    rows.write.parquet(str(tmp_path / "in"))
    stream = running_error_rates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("rates").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("rates").count() == 8
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, running_error_rates(rows).collect()))


def _places(y, x, steps, image, whole):
    """A value between pixels from its eight by eight places, by the definition of the kernel."""
    out, total = 0.0, 0.0
    for i in range(int(np.floor(y)) - 3, int(np.floor(y)) + 5):
        for j in range(int(np.floor(x)) - 3, int(np.floor(x)) + 5):
            w = math.prod(1.0 if t == 0 else 4 * math.sin(math.pi * t) * math.sin(math.pi * t / 4) / (math.pi * t) ** 2 for t in (y - i, x - j))
            out += w * image[min(max(i, 0), image.shape[0] - 1)][min(max(j, 0), image.shape[1] - 1)]
            total += w
    return out / total


def test_lanczos():
    stack = np.random.default_rng(5).integers(0, 256, (2, 11, 9)).astype(float)
    for h, w in ((5, 4), (11, 9), (17, 20), (1, 1)):
        got = px.resized(stack, h, w)
        for y in range(h):
            for x in range(w):
                assert got[1, y, x] == pytest.approx(_places((y + 0.5) * 11 / h - 0.5, (x + 0.5) * 9 / w - 0.5, 8, stack[1], None))
    colour = np.stack([stack, stack + 1, stack * 0], -1)
    assert px.resized(colour, 6, 7)[..., 1] == pytest.approx(px.resized(stack, 6, 7) + 1)


def test_colours():
    stack = np.random.default_rng(6).integers(0, 256, (3, 4, 5, 3)).astype(float)
    stack[0, 0, 0], stack[0, 0, 1] = 7, 0
    hsv = px.to_hsv(stack)
    for pixel, own in zip(stack.reshape(-1, 3), hsv.reshape(-1, 3), strict=True):
        h, s, v = colorsys.rgb_to_hsv(*(pixel / 255))
        assert (own[0] / 6, own[1], own[2] / 255) == pytest.approx((h, s, v))
    assert px.from_hsv(hsv) == pytest.approx(stack)
    moved = px.shifted_hsv(stack, np.array([30.0, -30.0, 0.0]), np.array([0.0, 0.0, -51.0]), np.array([0.0, 10.0, 0.0]))
    h, s, v = hsv[2, 1, 1]
    assert moved[2, 1, 1] == pytest.approx(np.rint(np.array(colorsys.hsv_to_rgb(h / 6, max(0, s - 0.2), v / 255)) * 255))
    h, s, v = hsv[0, 1, 1]
    assert moved[0, 1, 1] == pytest.approx(np.rint(np.array(colorsys.hsv_to_rgb((h + 1) % 6 / 6, s, v / 255)) * 255))


def test_motion_and_displacement():
    assert px.line_kernel(5, 0).tolist() == [[0] * 5, [0] * 5, [0.2] * 5, [0] * 5, [0] * 5]
    assert (px.line_kernel(5, np.pi / 2) == px.line_kernel(5, 0).T).all() and px.line_kernel(7, 1.1).sum() == pytest.approx(1)
    stack = np.random.default_rng(7).integers(0, 256, (2, 6, 8)).astype(float)
    y, x = (np.repeat(a[None].astype(float), 2, 0) for a in np.mgrid[:6, :8])
    assert px.remapped(stack, y, x) == pytest.approx(stack)
    assert px.remapped(stack, y + 1, x)[:, :-1] == pytest.approx(stack[:, 1:]) and px.remapped(stack, y + 1, x)[:, -1] == pytest.approx(stack[:, -2])
    assert px.remapped(stack, y, x + 0.25)[1, 2, 3] == pytest.approx(0.75 * stack[1, 2, 3] + 0.25 * stack[1, 2, 4])
    still = np.tile([0.0, 0.0, np.nan], (2, 1))
    rngs = [np.random.default_rng(k) for k in range(2)]
    for name in ("grid_distortion", "optical_distortion"):
        assert images.transformed(stack, name, still, rngs) == pytest.approx(stack)
        assert (images.transformed(stack, name, still + 0.3, rngs) != stack).any()
    assert (images.transformed(stack, "elastic", np.tile([20.0, 6.0, 3.6], (2, 1)), rngs) != stack).any()


def test_equalisation_by_tiles():
    """Against loops over tiles, places and grey values."""
    image = np.random.default_rng(8).integers(0, 256, (32, 48))
    clip, th, tw = 2.0, 4, 6
    maps = {}
    for ty in range(8):
        for tx in range(8):
            counts = np.bincount(image[ty * th : ty * th + th, tx * tw : tx * tw + tw].ravel(), minlength=256).astype(float)
            most = max(1, int(clip * th * tw / 256))
            over = sum(max(c - most, 0) for c in counts)
            maps[ty, tx] = np.cumsum([min(c, most) + over / 256 for c in counts]) * 255 / (th * tw)
    got = px.equalised(image[None].astype(float), clip)[0]
    for y in range(32):
        for x in range(48):
            v, u = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5
            expected = 0.0
            for dy in (0, 1):
                for dx in (0, 1):
                    ty, tx = int(np.floor(v)) + dy, int(np.floor(u)) + dx
                    weight = (1 - abs(v - ty)) * (1 - abs(u - tx))
                    expected += weight * maps[min(max(ty, 0), 7), min(max(tx, 0), 7)][image[y, x]]
            assert abs(got[y, x] - expected) <= 0.500001
    assert px.equalised(np.full((1, 5, 5), 9.0), 4.0).shape == (1, 5, 5)


def test_what_was_not_applied_is_marked(spark):
    df = spark.createDataFrame([(i, 8, 8, np.arange(64.0).tolist()) for i in range(6)] + [(9, 8, 8, None)], "sample_id long, height int, width int, pixels array<double>")
    plan = spark.createDataFrame([(i, 0, 0, n, 80.0, 0.5, 0.0) for i, n in enumerate(("image_compression", "clahe", "hue_saturation_value", "motion_blur"))] + [(9, 0, 0, "clahe", 2.0, None, None)], "sample_id long, epoch int, step int, transform string, value double, second double, third double").replace(80.0, 5.0)
    got = {r.sample_id: {s.transform: s.applied for s in r.steps or ()} for r in images.apply_augmentation(df, plan).collect()}
    assert got == {0: {"image_compression": False}, 1: {"clahe": True}, 2: {"hue_saturation_value": False}, 3: {"motion_blur": True}, 4: {}, 5: {}, 9: {"clahe": False}}
