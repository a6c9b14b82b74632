"""Jobs over image pixels: quality, enhancement, resizing, and augmentation by plan. Images of one size in an Arrow batch are worked on as one stack."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from samplekit.functions import pixels as px
from samplekit.functions.hashing import hash_uniform

MEASURES = ("sharpness", "contrast", "mean_brightness", "blur_score")
STACK_VALUES = 4 << 20  # of one stack
Stack = tuple[np.ndarray, np.ndarray]


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of a list column, where each row's begin, and how many it has (null: none)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths, lengths


def stacks(batch: pa.RecordBatch) -> Iterator[Stack]:
    """Rows and their images as a stack, for each size; rows whose pixels don't make an image (height, width, pixels) are in none."""
    values, starts, lengths = _flat(batch.column("pixels"))
    height, width = _numbers(batch.column("height")), _numbers(batch.column("width"))
    area = height * width
    good = np.flatnonzero((height > 0) & (width > 0) & (lengths > 0) & (lengths % np.maximum(area, 1) == 0))
    sizes, group = np.unique(np.column_stack([height, width, lengths])[good], axis=0, return_inverse=True)
    for k, (h, w, n) in enumerate(sizes.tolist()):
        rows = good[group.ravel() == k]
        for low in range(0, len(rows), max(1, STACK_VALUES // n)):
            own = rows[low : low + max(1, STACK_VALUES // n)]
            stack = values[starts[own][:, None] + np.arange(n)].astype(np.float64).reshape(len(own), h, w, -1)
            yield own, stack[..., 0] if stack.shape[3] == 1 else stack


def with_quality(df: DataFrame) -> DataFrame:
    """df (height, width, pixels) with sharpness, contrast, mean_brightness and blur_score; null for what is no image."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: np.full(batch.num_rows, np.nan) for name in MEASURES}
            for rows, stack in stacks(batch):
                for name, values in px.quality_of(stack).items():
                    found[name][rows] = values
            columns = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in found.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *MEASURES])

    return df.mapInArrow(measure, StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in MEASURES)]))


def _with_images(batch: pa.RecordBatch, changed: list[Stack]) -> pa.RecordBatch:
    """The batch with other images in some of its rows."""
    column = batch.column("pixels")
    values, starts, lengths = _flat(column)
    height, width, sizes = _numbers(batch.column("height")).copy(), _numbers(batch.column("width")).copy(), lengths.copy()
    for rows, stack in changed:
        height[rows], width[rows] = stack.shape[1:3]
        sizes[rows] = stack[0].size
    begins = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()))
    same = np.ones(len(sizes), bool)
    for rows, stack in changed:
        out[begins[rows][:, None] + np.arange(stack[0].size)] = stack.reshape(len(rows), -1)
        same[rows] = False
    for row in np.flatnonzero(same & (lengths > 0)).tolist():
        out[begins[row] : begins[row] + lengths[row]] = values[starts[row] : starts[row] + lengths[row]]
    offsets = pa.array(np.append(begins, sizes.sum()), pa.int32(), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
    replaced = {"pixels": pa.ListArray.from_arrays(offsets, pa.array(out)), "height": pa.array(height, mask=height < 0), "width": pa.array(width, mask=width < 0)}
    arrays = [replaced[f.name].cast(f.type) if f.name in replaced else batch.column(f.name) for f in batch.schema]
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)


def map_images(df: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with each stack of images changed; rows that are no image keep what they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with_images(batch, [(rows, change(stack)) for rows, stack in stacks(batch)])

    return df.mapInArrow(run, df.schema)


ENHANCEMENTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"gamma_scale": px.gamma_scaled, "unsharp": px.unsharp, "frame_sharpen": px.frame_sharpen}


def enhance_images(df: DataFrame, steps: tuple[str, ...] = ("gamma_scale", "unsharp")) -> DataFrame:
    def change(stack: np.ndarray) -> np.ndarray:
        for step in steps:
            stack = ENHANCEMENTS[step](stack)
        return stack

    return map_images(df, change)


def resize_images(df: DataFrame, height: int, width: int, method: str = "lanczos") -> DataFrame:
    """Images of another size, whole numbers of 0 to 255. method: lanczos or bilinear."""
    return map_images(df, lambda stack: px.saturated(px.resized(stack, height, width, method)))


Range = tuple[float, float]
Member = tuple[str, tuple[Range, ...]]
#: By level, entries in order as (probability, members); a member is a name with the least and largest of each of its
#: parameters. An entry of several members takes one of them, each as likely.
PLANS: dict[str, tuple[tuple[float, tuple[Member, ...]], ...]] = {
    "light": (
        (0.5, (("rotate90", ((0, 4),)),)),
        (0.5, (("flip", ((0, 3),)),)),
        (0.5, (("brightness_contrast", ((-0.1, 0.1), (-0.1, 0.1))),)),
        (0.3, (("gauss_noise", ((5, 20),)),)),
    ),
    "medium": (
        (0.5, (("rotate90", ((0, 4),)),)),
        (0.5, (("flip", ((0, 3),)),)),
        (0.3, (("transpose", ()),)),
        (0.3, (("grid_distortion", ((-0.3, 0.3),)), ("optical_distortion", ((-0.3, 0.3), (-0.3, 0.3))))),
        (0.5, (("hue_saturation_value", ((-10, 10), (-20, 20), (-10, 10))), ("brightness_contrast", ((-0.2, 0.2), (-0.2, 0.2))), ("gamma", ((80, 120),)))),
        (0.4, (("gauss_noise", ((10, 30),)), ("iso_noise", ((0.01, 0.05), (0.1, 0.5))))),
        (0.3, (("motion_blur", ((5, 5),)), ("median_blur", ((5, 5),)), ("blur", ((5, 5),)))),
        (0.3, (("clahe", ((2, 2),)),)),
        (0.3, (("sharpen", ((0.2, 0.5), (0.5, 1.0))),)),
        (0.3, (("image_compression", ((70, 90),)),)),
    ),
    "heavy": (
        (0.7, (("rotate90", ((0, 4),)),)),
        (0.7, (("flip", ((0, 3),)),)),
        (0.5, (("transpose", ()),)),
        (0.5, (("grid_distortion", ((-0.5, 0.5),)), ("optical_distortion", ((-0.5, 0.5), (-0.5, 0.5))), ("elastic", ((120, 120), (6, 6), (3.6, 3.6))))),
        (0.7, (("hue_saturation_value", ((-20, 20), (-30, 30), (-20, 20))), ("brightness_contrast", ((-0.3, 0.3), (-0.3, 0.3))), ("gamma", ((50, 150),)))),
        (0.6, (("gauss_noise", ((20, 50),)), ("iso_noise", ((0.01, 0.1), (0.2, 0.7))), ("multiplicative_noise", ((0.8, 1.2),)))),
        (0.5, (("motion_blur", ((7, 7),)), ("median_blur", ((7, 7),)), ("blur", ((7, 7),)), ("gaussian_blur", ((3, 7),)))),
        (0.5, (("clahe", ((4, 4),)), ("sharpen", ((0.3, 0.7), (0.5, 1.0))), ("emboss", ((0.2, 0.5), (0.2, 0.7))))),
        (0.4, (("coarse_dropout", ((8, 8),)), ("cutout", ((8, 8),)))),
        (0.3, (("channel_shuffle", ()), ("rgb_shift", ((-20, 20), (-20, 20), (-20, 20))), ("channel_dropout", ((0, 3),)))),
        (0.4, (("downscale", ((0.5, 0.9),)), ("image_compression", ((50, 80),)))),
    ),
}
VALUES = ("value", "second", "third")


def _member(name: str, ranges: tuple[Range, ...]) -> Column:
    ends = [(F.lit(float(ranges[i][0])), F.lit(float(ranges[i][1]))) if i < len(ranges) else (F.lit(None).cast("double"),) * 2 for i in range(len(VALUES))]
    return F.struct(F.lit(name).alias("name"), *(x.alias(f"{end}_{v}") for v, pair in zip(VALUES, ends, strict=True) for end, x in zip(("low", "high"), pair, strict=True)))


def augmentation_plan(df: DataFrame, level: str = "medium", epochs: int = 1, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """key, epoch, step, transform, value, second, third: what each sample gets in each epoch, by hash; the same whatever else is planned.

    A transform has up to three parameters, drawn apart; one that it lacks is null. Unknown levels are heavy.
    """
    entries = PLANS.get(level, PLANS["heavy"])
    steps = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(p).alias("p"), F.array(*(_member(*m) for m in members)).alias("members")) for i, (p, members) in enumerate(entries)))
    rows = df.select(key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("s", F.explode(steps)).select(key, "epoch", "s.*")
    taken = rows.where(hash_uniform(seed, key, "epoch", "step") < F.col("p"))
    pick = F.floor(hash_uniform(seed + 1, key, "epoch", "step") * F.size("members")).cast("int")
    member = F.get("members", pick)
    drawn = [(member[f"low_{v}"] + hash_uniform(seed + 2 + i, key, "epoch", "step") * (member[f"high_{v}"] - member[f"low_{v}"])).alias(v) for i, v in enumerate(VALUES)]
    return taken.select(key, "epoch", "step", member["name"].alias("transform"), *drawn)


def _over(values: np.ndarray, stack: np.ndarray) -> np.ndarray:
    return values.reshape(-1, *(1,) * (stack.ndim - 1))


def _noise(stack: np.ndarray, rngs: list[np.random.Generator]) -> np.ndarray:
    return np.stack([rng.normal(0, 1, stack.shape[1:]) for rng in rngs])


def _dropout(stack: np.ndarray, rngs: list[np.random.Generator], holes: int) -> np.ndarray:
    out = stack.copy()
    h, w = stack.shape[1:3]
    for image, rng in zip(out, rngs, strict=True):
        for y, x in zip(rng.integers(0, h, holes), rng.integers(0, w, holes), strict=True):
            image[y : y + max(1, h // 8), x : x + max(1, w // 8)] = 0
    return out


#: Transforms whose first parameter decides on the shape or the kernel: images go together only where it is the same.
ALIKE = ("rotate90", "flip", "blur", "gaussian_blur", "median_blur", "motion_blur", "downscale", "coarse_dropout", "cutout", "channel_dropout", "clahe")
WHOLE = ("rotate90", "flip", "channel_dropout")


def _filtered_each(stack: np.ndarray, kernels: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([px.filtered(stack[k : k + 1], kernel) for k, kernel in enumerate(kernels)])


def _sensor_noise(stack: np.ndarray, colour: np.ndarray, strength: np.ndarray, rngs: list[np.random.Generator]) -> np.ndarray:
    """Noise of a sensor: hues vary by a share of the circle, values grow by counts whose mean follows the image's spread."""
    hsv = px.to_hsv(stack)
    for image, rng, c, s in zip(hsv, rngs, colour, strength, strict=True):
        spread = image[..., 2].std()
        image[..., 0] = (image[..., 0] + rng.normal(0, 6 * c * s, image.shape[:2])) % 6
        image[..., 2] += rng.poisson(spread * s, image.shape[:2]) * (1 - image[..., 2] / 255)
    return px.saturated(px.from_hsv(np.stack([hsv[..., 0], hsv[..., 1], np.clip(hsv[..., 2], 0, 255)], -1)))


def _distorted(stack: np.ndarray, name: str, values: np.ndarray, rngs: list[np.random.Generator], steps: int = 5) -> np.ndarray:
    """Grid: each of so many stripes is stretched by its own share; optical: places move along the radius; elastic: places move at random, smoothed."""
    n, h, w = stack.shape[:3]
    y, x = (np.repeat(a[None].astype(float), n, 0) for a in np.mgrid[:h, :w])
    for k, (rng, (first, second, _)) in enumerate(zip(rngs, values, strict=True)):
        if name == "grid_distortion":
            for at, size, axis in ((y, h, 0), (x, w, 1)):
                share = 1 + first * rng.uniform(-1, 1, steps)
                knots = np.concatenate(([0], np.cumsum(share / share.sum()))) * (size - 1)
                line = np.interp(np.arange(size), np.linspace(0, size - 1, steps + 1), knots)
                at[k] = line[:, None] if axis == 0 else line[None, :]
        elif name == "optical_distortion":
            v, u = (y[k] - (h - 1) / 2) / max(h, w), (x[k] - (w - 1) / 2) / max(h, w)
            stretch = 1 + first * (u * u + v * v)
            y[k], x[k] = v * stretch * max(h, w) + (h - 1) / 2 * (1 + second), u * stretch * max(h, w) + (w - 1) / 2 * (1 + second)
        else:
            sigma = min(second, min(h, w) / 8)
            y[k], x[k] = (at[k] + first * px.blurred(rng.uniform(-1, 1, (1, h, w)), sigma)[0] for at in (y, x))
    return px.saturated(px.remapped(stack, y, x))


def transformed(stack: np.ndarray, name: str, values: np.ndarray, rngs: list[np.random.Generator]) -> np.ndarray:
    """The images after one step of a plan; values: parameters of each image. What can't be done, as it needs a codec or colours that an image hasn't, gives the very stack back."""
    channels = stack.ndim == 4
    first = values[:, 0]
    kind = first[0]
    if name == "rotate90":
        return np.rot90(stack, int(kind), axes=(1, 2))
    if name == "flip":
        return stack[:, ::-1] if int(kind) == 0 else stack[:, :, ::-1] if int(kind) == 1 else stack[:, ::-1, ::-1]
    if name == "transpose":
        return stack.swapaxes(1, 2)
    if name == "brightness_contrast":
        return px.saturated((1 + _over(values[:, 1], stack)) * stack + _over(first, stack) * 255)
    if name == "gamma":
        return px.saturated((stack / 255) ** (_over(first, stack) / 100) * 255)
    if name == "gauss_noise":
        return px.saturated(stack + _noise(stack, rngs) * np.sqrt(_over(first, stack)))
    if name == "multiplicative_noise":
        return px.saturated(stack * _over(first, stack))
    if name == "blur":
        return px.saturated(px.filtered(stack, np.full((int(kind),) * 2, 1 / int(kind) ** 2)))
    if name == "gaussian_blur":
        return px.saturated(px.blurred(stack, kind / 6))
    if name == "median_blur":
        return px.median_filtered(stack, int(kind))
    if name == "motion_blur":
        return px.saturated(_filtered_each(stack, [px.line_kernel(int(kind), rng.uniform(0, np.pi)) for rng in rngs]))
    if name in ("sharpen", "emboss"):
        alpha, kernel = _over(first, stack), px.sharpening if name == "sharpen" else px.embossing
        return px.saturated((1 - alpha) * stack + alpha * _filtered_each(stack, [kernel(v) for v in values[:, 1]]))
    if name in ("grid_distortion", "optical_distortion", "elastic"):
        return _distorted(stack, name, values, rngs)
    if name == "clahe" and channels and stack.shape[3] == 3:
        hsv = px.to_hsv(stack)
        return px.saturated(px.from_hsv(np.concatenate([hsv[..., :2], px.equalised(px.saturated(hsv[..., 2]), kind)[..., None]], -1)))
    if name == "clahe" and not channels:
        return px.equalised(px.saturated(stack), kind)
    if name == "hue_saturation_value" and channels and stack.shape[3] == 3:
        return px.shifted_hsv(stack, *values.T)
    if name == "iso_noise" and channels and stack.shape[3] == 3:
        return _sensor_noise(stack, first, values[:, 1], rngs)
    if name in ("coarse_dropout", "cutout"):
        return _dropout(stack, rngs, int(kind))
    if name == "downscale":
        h, w = stack.shape[1:3]
        return px.saturated(px.resized(px.resized(stack, max(1, int(h * kind)), max(1, int(w * kind)), "bilinear"), h, w, "bilinear"))
    if name == "channel_shuffle" and channels:
        return np.stack([image[..., rng.permutation(stack.shape[3])] for image, rng in zip(stack, rngs, strict=True)])
    if name == "rgb_shift" and channels and stack.shape[3] == 3:
        return px.saturated(stack + values[:, None, None, :3])
    if name == "channel_dropout" and channels:
        out = stack.copy()
        out[..., int(kind) % stack.shape[3]] = 128
        return out
    return stack


def _augmented(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch (__key, epoch, __steps) with the steps of each row applied in order, those of equal kind and size together; applied says which were."""
    images = {int(row): image for rows, stack in stacks(batch) for row, image in zip(rows, stack, strict=True)}
    keys, epochs, steps = (batch.column(c).to_pylist() for c in ("__key", "epoch", "__steps"))
    rngs = {row: np.random.default_rng(zlib.crc32(f"{keys[row]}|{epochs[row]}".encode())) for row in images}
    applied: list[list[bool]] = [[] for _ in keys]
    for turn in range(max((len(s or ()) for s in steps), default=0)):
        together: defaultdict[tuple, list[int]] = defaultdict(list)
        for row, image in images.items():
            if steps[row] and turn < len(steps[row]):
                step = steps[row][turn]
                value = step["value"] if step["transform"] in ALIKE else None
                together[step["transform"], image.shape, int(value) if step["transform"] in WHOLE else value].append(row)
        for (name, _, _), rows in together.items():
            values = np.array([[steps[row][turn][v] for v in VALUES] for row in rows], np.float64)
            own = np.stack([images[row] for row in rows])
            changed = transformed(own, name, values, [rngs[row] for row in rows])
            images.update(zip(rows, changed, strict=True))
            for row in rows:
                applied[row].append(changed is not own)
    by_shape: defaultdict[tuple, list[int]] = defaultdict(list)
    for row, image in images.items():
        by_shape[image.shape].append(row)
    shown = [[{"transform": x["transform"], "applied": done} for x, done in zip(own or (), applied[row] or [False] * len(own or ()), strict=True)] for row, own in enumerate(steps)]
    at = batch.schema.get_field_index("steps")
    marked = batch.set_column(at, batch.schema.field(at), pa.array(shown, batch.schema.field(at).type))
    return _with_images(marked, [(np.array(rows), np.stack([images[row] for row in rows])) for rows in by_shape.values()])


def apply_augmentation(df: DataFrame, plan: DataFrame, epochs: int = 1, key: str = "sample_id") -> DataFrame:
    """df for each epoch, the steps of the plan applied in order, and steps: each transform with whether it was applied. A sample without a step in an epoch is unchanged there, as is one that is no image.

    Not applied are image_compression, which needs a codec, and what changes colours on a gray image. Value and brightness of colours stand for those of other colour spaces; directions,
    noise and displacements are drawn for each sample and epoch.
    """
    steps = plan.groupBy(F.col(key).alias("__of"), F.col("epoch").alias("__epoch")).agg(F.sort_array(F.collect_list(F.struct("step", "transform", *VALUES))).alias("__steps"))
    spread = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = spread.join(steps, (F.col(key) == F.col("__of")) & (F.col("epoch") == F.col("__epoch")), "left").drop("__of", "__epoch").withColumns({"__key": F.col(key).cast("string"), "steps": F.lit(None).cast("array<struct<transform: string, applied: boolean>>")})
    return rows.mapInArrow(lambda batches: map(_augmented, batches), rows.schema).drop("__key", "__steps")
