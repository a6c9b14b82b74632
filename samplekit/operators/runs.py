"""Analysis of training runs from their epoch logs and results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_summary(logs: DataFrame, *, run: str = "run_id", monitor: str = "val_loss", best_of: str = "val_accuracy") -> DataFrame:
    """run, epochs, best_epoch (from 1, the first least monitor), best values, and the last value of every other metric."""
    others = [c for c in logs.columns if c not in (run, "epoch")]
    return logs.groupBy(run).agg(F.count("*").alias("epochs"), (F.min(F.when(F.col(monitor).isNotNull(), F.struct(monitor, "epoch")))["epoch"] + 1).alias("best_epoch"), F.min(monitor).alias(f"best_{monitor}"), F.max(best_of).alias(f"best_{best_of}"), *(F.max_by(c, "epoch").alias(f"final_{c}") for c in others))


def early_stop(logs: DataFrame, patience: int = 10, *, run: str = "run_id", monitor: str = "val_loss") -> DataFrame:
    """run, stopped_epoch (null: never), best_epoch, best value, as an early stop with this patience would have left the run."""
    before = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = logs.withColumn("__better", F.col(monitor) < F.coalesce(F.min(monitor).over(before), F.lit(float("inf"))))
    marked = marked.withColumn("__last", F.max(F.when(F.col("__better"), F.col("epoch"))).over(upto))
    stale = F.col("epoch") - F.coalesce("__last", F.lit(-1)) >= patience
    marked = marked.withColumn("__stop", F.min(F.when(stale, F.col("epoch"))).over(Window.partitionBy(run)))
    seen = marked.where(F.col("__stop").isNull() | (F.col("epoch") <= F.col("__stop")))
    return seen.groupBy(run).agg(F.max("__stop").alias("stopped_epoch"), F.min(F.struct(monitor, "epoch"))["epoch"].alias("best_epoch"), F.min(monitor).alias("best_value"))


def plateau_replay(logs: DataFrame, *, initial: float = 1e-3, factor: float = 0.5, patience: int = 5, least: float = 1e-6, run: str = "run_id", monitor: str = "val_loss") -> DataFrame:
    """run, epoch, lr: the rate after each epoch, cut by factor after `patience` epochs without a new best, never below least. The count begins anew after a cut, which is state that a window can't carry."""
    def replay(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("epoch")
        lr, best, stale, rates = initial, float("inf"), 0, []
        for value in one[monitor]:
            if value < best:
                best, stale = value, 0
            else:
                stale += 1
                if stale >= patience:
                    lr, stale = max(lr * factor, least), 0
            rates.append(lr)
        return pd.DataFrame({run: one[run], "epoch": one["epoch"], "lr": rates})

    kind = logs.schema[run].dataType.simpleString()
    return logs.select(run, F.col("epoch").cast("long"), monitor).groupBy(run).applyInPandas(replay, f"`{run}` {kind}, epoch long, lr double")


def warmup_rates(logs: DataFrame, *, initial: float = 1e-3, epochs: int = 5) -> DataFrame:
    """logs with warmup_lr: initial, approached in equal steps over the first epochs."""
    return logs.withColumn("warmup_lr", F.when(F.col("epoch") < epochs, F.lit(initial) * (F.col("epoch") + 1) / epochs).otherwise(F.lit(initial)))


def generalisation_gap(logs: DataFrame, metrics: list[str], *, run: str = "run_id") -> DataFrame:
    """run, epoch, metric, train, val, gap, best (whether val is the run's best at this epoch, the first one)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("train"), F.col(f"val_{m}").alias("val")) for m in metrics)))
    rows = logs.select(run, "epoch", pairs.alias("p")).select(run, "epoch", "p.*").withColumn("gap", F.col("val") - F.col("train"))
    sign = F.when(F.col("metric").contains("loss"), F.col("val")).otherwise(-F.col("val"))
    best = rows.groupBy(run, "metric").agg(F.min(F.struct(sign.isNull().alias("none"), sign.alias("sign"), "epoch"))["epoch"].alias("__best")).select(F.col(run).alias("__run"), F.col("metric").alias("__metric"), "__best")
    return rows.join(best, F.col(run).eqNullSafe(F.col("__run")) & (F.col("metric") == F.col("__metric"))).select(*rows.columns, (F.col("epoch") == F.col("__best")).alias("best"))


def time_stats(logs: DataFrame, *, run: str = "run_id", seconds: str = "seconds", memory: tuple[str, ...] = ("cpu_memory", "gpu_memory")) -> DataFrame:
    """run, total, mean and longest seconds of its epochs; mean_ and peak_ of each of the memory columns that the logs have."""
    of_memory = [f(c).alias(f"{name}_{c}") for c in memory if c in logs.columns for name, f in (("mean", F.avg), ("peak", F.max))]
    return logs.groupBy(run).agg(F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.max(seconds).alias("longest"), *of_memory)


def job_summary(runs: DataFrame) -> DataFrame:
    """One row over runs (job_key, success): total, successful, failed, failed_jobs (sorted), success_rate (0 when empty)."""
    failed = F.sort_array(F.collect_list(F.when(~F.col("success"), F.col("job_key"))))
    return runs.agg(F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), failed.alias("failed_jobs"), F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)).alias("success_rate"))


def best_runs(runs: DataFrame, by: list[str], *, value: str = "accuracy", key: str = "job_key") -> DataFrame:
    """by, key, value of the best successful run, a missing value as 0, ties to the first key."""
    rows = runs.where("success").withColumn(value, F.coalesce(value, F.lit(0.0)))
    best = rows.groupBy(*by).agg(F.min(F.struct((-F.col(value)).alias("v"), key)).alias("b"))
    return best.where("b is not null").select(*by, F.col("b")[key].alias(key), (-F.col("b.v")).alias(value))


def training_time(runs: DataFrame, seconds: str = "training_time") -> DataFrame:
    return runs.where("success").agg(*(F.coalesce(f(seconds), F.lit(0.0)).alias(n) for f, n in ((F.sum, "total"), (F.avg, "mean"), (F.min, "shortest"), (F.max, "longest"))))


def best_trial(trials: DataFrame) -> DataFrame:
    """number, value, params of the trial with the least value; a failed or missing one counts as infinite."""
    value = F.when((F.col("state") == "COMPLETE") & F.col("value").isNotNull() & ~F.isnan("value"), F.col("value")).otherwise(float("inf"))
    best = trials.withColumn("value", value).agg(F.min_by(F.struct("number", "value", "params"), F.struct("value", "number")).alias("b"))
    return best.where("b is not null").select("b.*")


def run_catalog(paths: DataFrame, models: list[str]) -> DataFrame:
    """run, model, dataset, path of each run's checkpoint. paths: path, files under <run>/checkpoints/.

    Taken is best_model.h5; else, if there is a directory checkpoints/<run>, a .h5, .keras or saved model in it, or none at all;
    else any .h5, else any .keras. model: one of `models`, else what stands before the first underscore of the run.
    """
    parts = paths.select("path", F.regexp_extract("path", "([^/]+)/checkpoints/(.+)$", 1).alias("run"), F.regexp_extract("path", "([^/]+)/checkpoints/(.+)$", 2).alias("file")).where("run <> ''")
    inside = F.startswith(F.col("file"), F.concat("run", F.lit("/")))
    parts = parts.withColumn("own_dir", F.max(inside.cast("int")).over(Window.partitionBy("run")) == 1)
    h5, keras, saved = F.endswith("file", F.lit(".h5")), F.endswith("file", F.lit(".keras")), F.endswith("file", F.lit("saved_model.pb"))
    deep = F.contains(F.col("file"), F.lit("/"))
    rank = F.when(F.col("file") == "best_model.h5", 0).when(F.col("own_dir") & inside & h5, 1).when(F.col("own_dir") & inside & keras, 2).when(F.col("own_dir") & inside & saved, 3).when(~F.col("own_dir") & ~deep & h5, 4).when(~F.col("own_dir") & ~deep & keras, 5)
    best = parts.withColumn("rank", rank).where("rank is not null").groupBy("run").agg(F.min_by("path", F.struct("rank", "file")).alias("path"))
    pattern = "^(" + "|".join(sorted(models, key=len, reverse=True)) + ")_(.+)$"
    named = F.regexp_extract("run", pattern, 1)
    model = F.when(named != "", named).otherwise(F.regexp_extract("run", "^([^_]*)_(.*)$", 1))
    dataset = F.when(named != "", F.regexp_extract("run", pattern, 2)).otherwise(F.regexp_extract("run", "^([^_]*)_(.*)$", 2))
    return best.select("run", model.alias("model"), dataset.alias("dataset"), "path")


def select_runs(catalog: DataFrame, model: str, dataset: str | None = None) -> DataFrame:
    own = catalog.where(F.col("model") == model)
    return own if dataset is None else own.where(F.col("dataset") == dataset)
