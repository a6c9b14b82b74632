"""Sinks: datasets, statistics, predictions, evaluations and reports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that a task has open at once, so that it needn't sort its rows by folder first; rows of further folders are sorted.
OPEN_FILES = 64


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by dataset and split; rows of one partition come together first, in tasks of an even size, so that each has few files and a large one has several writers."""
    df.hint("rebalance", F.col("dataset"), F.col("split")).write.mode(mode).partitionBy("dataset", "split").parquet(path)


@contextmanager
def _unsorted(spark: SparkSession) -> Iterator[None]:
    """Within it, writes by folder keep OPEN_FILES files open instead of sorting rows, unless the session says how many."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    if int(spark.conf.get(name, "0")) > 0:
        yield
        return
    spark.conf.set(name, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.unset(name)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null, at the top level: JSON has no NaN."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def write_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    without_nan(stats).write.mode(mode).json(path)


def write_quality_report(rows: DataFrame, stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON under path: the quality of every sample (dataset, split, more) by dataset and split as metrics, and the statistics of the datasets as stats."""
    without_nan(rows).hint("rebalance", F.col("dataset"), F.col("split")).write.mode(mode).partitionBy("dataset", "split").json(f"{path}/metrics")
    write_stats(stats, f"{path}/stats", mode)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, by model and tested_on, of scores with the decision, its confidence and whether it is right. A task writes its rows as they come: it holds files, not rows."""
    predicted = F.when(F.col("score") > 1 - F.col("score"), 1).otherwise(0)
    rows = df.select("model", "tested_on", F.col("label").alias("true_label"), predicted.alias("predicted_label"), (1 - F.col("score")).alias("bonafide_prob"), F.col("score").alias("attack_prob"), F.greatest("score", 1 - F.col("score")).alias("confidence"), (predicted == F.col("label")).alias("correct"))
    with _unsorted(df.sparkSession):
        rows.write.mode(mode).option("header", True).partitionBy("model", "tested_on").csv(path)


def write_epoch_logs(df: DataFrame, path: str, metrics: list[str], mode: str = "overwrite") -> None:
    """CSV with a header, of run_id, epoch and metrics. The run is a column, not a folder: there are as many files as tasks, however many runs there are."""
    df.select(F.col("run_id").cast("string").alias("run_id"), "epoch", *metrics).write.mode(mode).option("header", True).csv(path)


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The same rows as JSON and CSV under path; maps and structs, which CSV can't hold, are JSON text there."""
    clean = without_nan(results)
    clean.write.mode(mode).json(f"{path}/json")
    flat = clean.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name) for f in clean.schema))
    flat.write.mode(mode).option("header", True).csv(f"{path}/csv")


def write_report(sections: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text files of a report's sections, in the order of their names."""
    sections.orderBy("part", "dataset_name").select("value").write.mode(mode).text(path)
