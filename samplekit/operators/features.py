"""Features of samples: quality scores and the gate, scalar and array expressions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brightness_score(mean: str = "mean_brightness") -> Column:
    return 1 - F.abs(F.col(mean) - 128) / 128


def brightness_ok(mean: str = "mean_brightness") -> Column:
    return F.col(mean).between(40, 220)


def is_sharp(blur: str = "blur_score", limit: float = 80) -> Column:
    return F.col(blur) > limit


def composite_score(sharpness: str = "sharpness", contrast: str = "contrast", brightness: str = "brightness_score", blur: str = "blur_score") -> Column:
    """Weighted mean of four qualities, each at most 1."""
    def upto(column: str, full: float) -> Column:
        return F.least(F.col(column) / full, F.lit(1.0))

    return 0.35 * upto(sharpness, 100) + 0.25 * upto(contrast, 50) + 0.20 * F.col(brightness) + 0.20 * upto(blur, 100)


def with_composite(df: DataFrame) -> DataFrame:
    """df (sharpness, contrast, mean_brightness, blur_score) with brightness_score, brightness_ok, is_sharp and composite_score."""
    return df.withColumns({"brightness_score": brightness_score(), "brightness_ok": brightness_ok(), "is_sharp": is_sharp()}).withColumn("composite_score", composite_score())


def quality_gate(threshold: float = 0.6, contrast: float = 15) -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold must lie in [0, 1]: {threshold}")
    return (F.col("composite_score") >= threshold) & F.col("brightness_ok") & F.col("is_sharp") & (F.col("contrast") > contrast)


def gate_threshold(threshold: float, mode: str = "standard") -> float:
    """The threshold of a processing mode: premium is stricter, basic laxer."""
    return {"premium": min(threshold + 0.1, 0.9), "basic": max(threshold - 0.1, 0.4)}.get(mode, threshold)


def two_stage_gate(df: DataFrame, enhanced: DataFrame, threshold: float = 0.6, key: str = "sample_id") -> DataFrame:
    """Rows whose quality passes before and after enhancement, with the struct `final` of the second. Both have the columns of with_composite."""
    gate = quality_gate(threshold)
    kept = [c for c in ("sharpness", "contrast", "brightness_score", "blur_score", "composite_score")]
    after = enhanced.where(gate).select(key, F.struct(*kept).alias("final"))
    return df.where(gate).join(after, key)


def gray(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Luma as a whole number of 0 to 255."""
    return F.floor(F.col(r) * 0.299 + F.col(g) * 0.587 + F.col(b) * 0.114 + 0.5)


def mean_of(pixels: Column | str) -> Column:
    p = F.col(pixels) if isinstance(pixels, str) else pixels
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)


def contrast_of(pixels: str) -> Column:
    """Population standard deviation."""
    once = F.array(mean_of(pixels))
    return F.get(F.transform(once, lambda mean: F.sqrt(F.aggregate(F.col(pixels), F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(pixels))), F.lit(0))


def unit_range(pixels: str) -> Column:
    return F.transform(pixels, lambda x: x / 255)


def signed_range(pixels: str) -> Column:
    """[0, 1] to [-1, 1]."""
    return F.transform(pixels, lambda x: (x - 0.5) * 2)


def byte_range(pixels: str) -> Column:
    """Pixels of at most 1 are taken as [0, 1] and brought to [0, 255]."""
    return F.when(F.array_max(pixels) <= 1.0, F.transform(pixels, lambda x: x * 255)).otherwise(F.col(pixels))


def one_hot(label: str, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == F.col(label), 1.0).otherwise(0.0))


def argmax(values: Column | str) -> Column:
    """Place of the largest value, from 0; the first of several."""
    v = F.col(values) if isinstance(values, str) else values
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def gamma_corrected(pixels: str, gamma: float = 1.2) -> Column:
    """255 (x / 255)^(1 / gamma), cut to whole numbers."""
    return F.transform(pixels, lambda x: F.floor(F.pow(x / 255, F.lit(1 / gamma)) * 255).cast("double"))


def scaled(pixels: str, factor: float = 1.1, shift: float = 5) -> Column:
    """|factor x + shift| rounded half to even and cut to [0, 255]."""
    return F.transform(pixels, lambda x: F.least(F.lit(255.0), F.bround(F.abs(x * factor + shift), 0)))


def standardised(pixels: str) -> Column:
    """Per image: mean 0, deviation 1; a flat image is 0."""
    once = F.array(F.struct(mean_of(pixels).alias("mean"), contrast_of(pixels).alias("deviation")))
    return F.get(F.transform(once, lambda s: F.transform(pixels, lambda x: F.coalesce(F.try_divide(x - s["mean"], s["deviation"]), F.lit(0.0)))), F.lit(0))


def normalised(df: DataFrame, method: str = "per_image", pixels: str = "pixels") -> DataFrame:
    """df with its pixels normalised: per_image (mean 0, deviation 1 of each image), global (the same of all pixels of all images), standardize (of each place over all images), min_max (each place over all images to [0, 1]).

    Figures of places come from one vector aggregate and are joined back as one row. A place or an image that never varies is 0. Images whose size differs from that of most
    places stay out of the figures: all must have one size.
    """
    if method == "per_image":
        return df.withColumn(pixels, standardised(pixels))
    if method == "global":
        values = df.agg(F.sum(F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x)).alias("s"), F.sum(F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x * x)).alias("q"), F.sum(F.size(pixels)).alias("n"))
        mean = F.col("s") / F.col("n")
        figures = values.select(mean.alias("__mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("__dev"))
        each = lambda x: F.coalesce(F.try_divide(x - F.col("__mean"), F.col("__dev")), F.lit(0.0))
        return df.join(F.broadcast(figures)).withColumn(pixels, F.transform(pixels, each)).select(*df.columns)
    if method not in ("standardize", "min_max"):
        raise ValueError(f"method must be per_image, global, standardize or min_max: {method}")
    vector = array_to_vector(F.col(pixels).cast("array<double>"))
    of = lambda name: vector_to_array(F.col(f"m.{name}")).alias(name)
    summary = df.where(F.col(pixels).isNotNull()).select(Summarizer.metrics("mean", "std", "min", "max", "count").summary(vector).alias("m"))
    figures = F.broadcast(summary.select(of("mean"), of("std"), of("min"), of("max"), F.col("m.count").alias("count")).select(F.struct("*").alias("__f")))  # one row, as wide as an image
    joined = df.join(figures)
    at = lambda name, i: F.get(F.col(f"__f.{name}"), i)
    if method == "min_max":
        scaled_ = lambda x, i: F.try_divide(x - at("min", i), at("max", i) - at("min", i))
    else:
        whole = F.sqrt((F.col("__f.count") - 1) / F.col("__f.count"))
        scaled_ = lambda x, i: F.try_divide(x - at("mean", i), at("std", i) * whole)
    return joined.withColumn(pixels, F.transform(pixels, lambda x, i: F.coalesce(scaled_(x, i), F.lit(0.0)))).select(*df.columns)


def json_rows(df: DataFrame) -> DataFrame:
    """value: each row as JSON; NaN is null and left out, so that the JSON is standard."""
    clean = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*clean)).alias("value"))
