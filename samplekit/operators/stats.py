"""Statistics of labelled samples, their splits and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_weights(df: DataFrame, by: list[str] | None = None, label: str = "label") -> DataFrame:
    """by, label, n, raw_weight (rows over classes times class rows), weight (the largest is 1)."""
    every = Window.partitionBy(*(by or []))
    counts = df.groupBy(*(by or []), label).agg(F.count("*").alias("n"))
    raw = counts.withColumn("raw_weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))
    return raw.withColumn("weight", F.col("raw_weight") / F.max("raw_weight").over(every))


def class_distribution(df: DataFrame, by: list[str] | None = None, label: str = "label") -> DataFrame:
    return df.groupBy(*(by or []), label).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or []))))


def with_class_weight(df: DataFrame, by: list[str] | None = None, label: str = "label", *, small: bool = False) -> DataFrame:
    """df with its class's weight; the weights are a row per class and group. small: whether those may be broadcast, so that df stays where it is."""
    on = [*(by or []), label]
    weights = class_weights(df, by, label).select(*on, F.col("weight").alias("class_weight"))
    return df.join(F.broadcast(weights) if small else weights, on)


def _of(split: str, *more: Column) -> Column:
    condition = F.col("split") == split
    for c in more:
        condition = condition & c
    return condition


def dataset_stats(df: DataFrame, *, source: str = "dataset", quality: str = "quality", label: str = "label") -> DataFrame:
    """A row per source: sizes by split and class, attack shares, means of quality by split, its population deviation, least and largest. df has a split: train or test."""
    train, test, attack = _of("train"), _of("test"), F.col(label) == 1
    counts = {"total_samples": F.count("*"), "train_samples": F.count_if(train), "test_samples": F.count_if(test), "train_bonafide": F.count_if(train & ~attack), "train_attack": F.count_if(train & attack), "test_bonafide": F.count_if(test & ~attack), "test_attack": F.count_if(test & attack)}
    rest = {"train_balance_ratio": F.avg(F.when(train, attack.cast("int"))), "test_balance_ratio": F.avg(F.when(test, attack.cast("int"))), "avg_train_quality": F.avg(F.when(train, F.col(quality))), "avg_test_quality": F.avg(F.when(test, F.col(quality))), "quality_std": F.stddev_pop(quality), "min_quality": F.min(quality), "max_quality": F.max(quality)}
    return df.groupBy(F.col(source).alias("dataset_name")).agg(*(c.alias(k) for k, c in (counts | rest).items()))


def with_settings(
    stats: DataFrame, *, video_like: tuple[str, ...] = (), target_size: tuple[int, int] = (256, 256), train_ratio: float = 0.8, quality_threshold: float = 0.65,
    balanced: bool = True, quality_enhanced: bool = True, synthetic_data: bool = False, created: Column | None = None,
) -> DataFrame:
    """dataset_stats with how the sets were made: creation_time (now, if not given), target_size, train_ratio, quality_threshold, data_type and flags."""
    return stats.withColumns({
        "creation_time": F.current_timestamp() if created is None else created,
        "target_size": F.array(*map(F.lit, target_size)),
        "train_ratio": F.lit(float(train_ratio)),
        "quality_threshold": F.lit(float(quality_threshold)),
        "data_type": F.when(F.col("dataset_name").isin(*video_like), "video").otherwise("image"),
        "balanced": F.lit(balanced),
        "quality_enhanced": F.lit(quality_enhanced),
        "synthetic_data": F.lit(synthetic_data),
    })


def combined_stats(df: DataFrame, *, source: str = "dataset") -> DataFrame:
    """One row: totals, included_datasets and samples_per_dataset (a map of train and test sizes)."""
    per = df.groupBy(source).agg(F.count_if(_of("train")).alias("train"), F.count_if(_of("test")).alias("test"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(source), F.struct("train", "test"))))
    return per.agg(F.sum(F.col("train") + F.col("test")).alias("total_samples"), F.sum("train").alias("train_samples"), F.sum("test").alias("test_samples"), F.sort_array(F.collect_list(source)).alias("included_datasets"), F.map_from_entries(entries).alias("samples_per_dataset"))


def overall_stats(stats: DataFrame) -> DataFrame:
    """One row over dataset_stats: sums, the mean of the sources' own means, the least and the largest quality."""
    sums = ["total_samples", "train_samples", "test_samples", "train_bonafide", "train_attack", "test_bonafide", "test_attack"]
    means = F.flatten(F.collect_list(F.array_compact(F.array("avg_train_quality", "avg_test_quality"))))
    mean = F.try_divide(F.aggregate(means, F.lit(0.0), lambda a, b: a + b), F.size(means))
    return stats.agg(F.count("*").alias("datasets"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums), F.coalesce(mean, F.lit(0.0)).alias("average_quality"), F.coalesce(F.min("min_quality"), F.lit(0.0)).alias("min_quality"), F.coalesce(F.max("max_quality"), F.lit(1.0)).alias("max_quality"))


def loader_info(df: DataFrame, *, label: str = "label") -> DataFrame:
    """split, size, classes, class_0 and class_1 (rows of each class), share_0 and share_1; of images (height, width, pixels) input_shape too."""
    counts = {"size": F.count("*"), "classes": F.count_distinct(label), "class_0": F.count_if(F.col(label) == 0), "class_1": F.count_if(F.col(label) == 1)}
    if {"height", "width", "pixels"} <= set(df.columns):
        channels = F.max(F.try_divide(F.size("pixels"), F.col("height") * F.col("width"))).cast("int")
        counts["input_shape"] = F.array(F.max("height"), F.max("width"), channels)
    out = df.groupBy("split").agg(*(c.alias(k) for k, c in counts.items()))
    return out.withColumns({f"share_{k}": F.col(f"class_{k}") / F.col("size") for k in (0, 1)})


def rollup_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by all columns, by the first ones, and over all; a column that is summed over is null."""
    return df.rollup(*columns).agg(F.count("*").alias("n"))


def expected_check(stats: DataFrame, expected: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """key, expected, actual, difference, ok. A source without statistics has null and is not ok."""
    joined = expected.select(key, F.col(value).alias("expected")).join(stats.select(key, F.col(value).alias("actual")), key, "left")
    off = F.abs(F.col("actual") - F.col("expected"))
    return joined.withColumns({"difference": F.col("actual") - F.col("expected"), "ok": F.coalesce(off <= F.col("expected") * tolerance, F.lit(False))})


def rejection_report(df: DataFrame, by: list[str], *, accepted: str = "accepted", quality: str = "composite_score") -> DataFrame:
    """by, seen, kept, success_rate, mean_quality of what was kept."""
    return df.groupBy(*by).agg(F.count("*").alias("seen"), F.count_if(accepted).alias("kept"), F.avg(F.col(accepted).cast("int")).alias("success_rate"), F.avg(F.when(F.col(accepted), F.col(quality))).alias("mean_quality"))


def _shown(column: str | Column, digits: int = 3) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.round(column, digits).cast(f"decimal(12,{digits})").cast("string"), F.lit("-"))


def _counted(column: str) -> Column:
    return F.format_number(column, 0)


def markdown_report(stats: DataFrame, *, quality_threshold: float = 0.65) -> DataFrame:
    """part, dataset_name, value: Markdown of a summary table (part 0), a section for each row of dataset_stats with data_type (1), and the range of quality (2)."""
    whole = overall_stats(stats)
    rows = [("Datasets", _counted("datasets")), ("Samples", _counted("total_samples")), ("Training samples", _counted("train_samples")), ("Test samples", _counted("test_samples"))]
    rows += [("Mean quality", _shown("average_quality")), ("Quality threshold", F.lit(f"{quality_threshold:g}"))]
    table = [F.concat(F.lit(f"| {name} | "), value, F.lit(" |")) for name, value in rows]
    summary = [F.lit("## Summary"), F.lit(""), F.lit("| What | Value |"), F.lit("| --- | --- |"), *table]
    reach = F.concat(F.lit("- Range of quality: "), _shown("min_quality"), F.lit(" to "), _shown("max_quality"))
    analysis = [F.lit("## Quality"), F.lit(""), F.lit(f"- Threshold: {quality_threshold:g}"), F.concat(F.lit("- Mean quality: "), _shown("average_quality")), reach]

    def split_line(name: str, split: str) -> Column:
        return F.concat(F.lit(f"- {name}: "), _counted(f"{split}_samples"), F.lit(" (bonafide "), _counted(f"{split}_bonafide"), F.lit(", attack "), _counted(f"{split}_attack"), F.lit(")"))

    section = [
        F.concat(F.lit("### "), "dataset_name"),
        F.lit(""),
        F.concat(F.lit("- Type: "), "data_type"),
        F.concat(F.lit("- Samples: "), _counted("total_samples")),
        split_line("Train", "train"),
        split_line("Test", "test"),
        F.concat(F.lit("- Attack share: train "), _shown("train_balance_ratio"), F.lit(", test "), _shown("test_balance_ratio")),
        F.concat(F.lit("- Quality: train "), _shown("avg_train_quality"), F.lit(", test "), _shown("avg_test_quality")),
    ]
    none = F.lit(None).cast("string").alias("dataset_name")
    parts = [whole.select(F.lit(k).alias("part"), none, F.concat_ws("\n", *lines).alias("value")) for k, lines in ((0, summary), (2, analysis))]
    return parts[0].unionByName(stats.select(F.lit(1).alias("part"), "dataset_name", F.concat_ws("\n", *section).alias("value"))).unionByName(parts[1])
