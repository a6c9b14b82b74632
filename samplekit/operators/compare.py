"""Comparison of evaluated detectors: best rows, means, rankings, pivots and significance tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplekit.functions.normal import f_tail

#: Weights of the ranking; error rates count as one minus them.
RANKING = (("accuracy", 0.25, False), ("f1_score", 0.20, False), ("roc_auc", 0.20, False), ("acer", 0.20, True), ("eer", 0.15, True))


def clean(column: str) -> Column:
    """NaN as null, which aggregates pass over."""
    return F.when(~F.isnan(column), F.col(column))


def flatten_results(df: DataFrame, structs: list[str]) -> DataFrame:
    """df with the fields of its struct columns as columns."""
    kept = [c for c in df.columns if c not in structs]
    return df.select(*kept, *(f"{s}.*" for s in structs))


def best_by(df: DataFrame, metrics: dict[str, str], keys: list[str]) -> DataFrame:
    """metric, keys, value of the best row by each metric ("max" or "min"), ties to the first by keys; a metric without values has nulls."""
    picks = []
    for name, mode in metrics.items():
        value = clean(name)
        order = F.struct((-value if mode == "max" else value).alias("v"), *keys)
        picks.append(F.min(F.when(value.isNotNull(), order)).alias(name))
    one = df.agg(*picks)
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(m)[k].alias(k) for k in keys), ((-F.col(m)["v"]) if mode == "max" else F.col(m)["v"]).alias("value")) for m, mode in metrics.items()))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def cross_dataset_summary(df: DataFrame, metrics: tuple[str, ...] = ("accuracy", "acer", "eer"), digits: int = 4) -> DataFrame:
    """model, trained_on, tests and the means of metrics over other sources than the one trained on, rounded half to even; best marks the highest accuracy."""
    means = df.where("trained_on <> tested_on").groupBy("model", "trained_on").agg(F.count("*").alias("tests"), *(F.bround(F.avg(clean(m)), digits).alias(m) for m in metrics))
    top = means.agg(F.min(F.struct((-F.col("accuracy")).alias("v"), "model", "trained_on")).alias("top")).select(F.col("top.model").alias("model"), F.col("top.trained_on").alias("trained_on"), F.lit(True).alias("best"))
    return means.join(top, ["model", "trained_on"], "left").withColumn("best", F.coalesce("best", F.lit(False)))


def rank_models(df: DataFrame, weights: tuple[tuple[str, float, bool], ...] = RANKING) -> DataFrame:
    """model, means, score, rank (from 1; ties by name). A row per model."""
    means = df.groupBy("model").agg(*(F.avg(clean(m)).alias(m) for m, _, _ in weights))
    score = reduce(lambda a, b: a + b, (F.coalesce(1 - F.col(m) if flip else F.col(m), F.lit(0.0)) * w for m, w, flip in weights))
    return means.withColumn("score", score).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "model")))


def metric_pivot(df: DataFrame, metric: str, columns: list[str], *, row: str = "model", column: str = "tested_on", strict: bool = False) -> DataFrame:
    """A row per model, a column per source in `columns`, the mean metric in the cells. strict: two rows for one cell are an error."""
    cells = df.groupBy(row, column).agg(F.avg(clean(metric)).alias("v"), F.count("*").alias("n"))
    if strict:
        cells = cells.withColumn("v", F.when(F.col("n") > 1, F.raise_error(F.lit("more than one row for a cell"))).otherwise(F.col("v")))
    return cells.groupBy(row).pivot(column, columns).agg(F.first("v", ignorenulls=True))


def mean_by_model(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.groupBy("model").agg(*(F.avg(clean(m)).alias(m) for m in metrics))


def cross_mean(df: DataFrame, metric: str = "accuracy") -> DataFrame:
    """model, mean over other sources, place from the best."""
    means = df.where("trained_on <> tested_on").groupBy("model").agg(F.avg(clean(metric)).alias("mean"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "model")))


def box_stats(df: DataFrame, metric: str = "accuracy") -> DataFrame:
    """model, q1, median, q3, low and high whisker (within 1.5 interquartile ranges), outliers."""
    quartiles = df.groupBy("model").agg(F.percentile(metric, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    joined = df.select("model", F.col(metric).alias("x")).join(quartiles, "model")
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.col("x").between(F.col("q")[0] - reach, F.col("q")[2] + reach)
    return joined.groupBy("model").agg(F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"), F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.count_if(~inside).alias("outliers"))


def radar(df: DataFrame, metrics: list[str]) -> DataFrame:
    """model, metric, mean."""
    return mean_by_model(df, metrics).unpivot("model", metrics, "metric", "mean")


def _moments(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def anova(df: DataFrame, value: str = "accuracy", group: str = "model") -> DataFrame:
    """One row: groups, f, df1, df2, p, significant (p < 0.05); only for more than two groups, else no row."""
    m = _moments(df, value, group)
    total = m.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("var")).alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"))
    between = F.col("squares") - F.col("rows") * F.col("grand") * F.col("grand")
    df1, df2 = F.col("groups") - 1, F.col("rows") - F.col("groups")
    out = total.where("groups > 2").select("groups", F.try_divide(between / df1, F.try_divide(F.col("within"), df2)).alias("f"), df1.alias("df1"), df2.alias("df2"))
    return out.withColumn("p", f_tail(F.col("f"), F.col("df1"), F.col("df2"))).withColumn("significant", F.col("p") < 0.05)


def pairwise_ttest(df: DataFrame, value: str = "accuracy", group: str = "model") -> DataFrame:
    """a, b (a before b), t with pooled variance, df, p, mean_diff, significant."""
    m = _moments(df, value, group)
    left = m.select(F.col(group).alias("a"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    right = m.select(F.col(group).alias("b"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    pairs = left.join(right, F.col("a") < F.col("b"))
    free = F.col("n1") + F.col("n2") - 2
    pooled = F.try_divide(F.col("n1") * F.col("v1") + F.col("n2") * F.col("v2"), free)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    out = pairs.select("a", "b", t.alias("t"), free.alias("df"), (F.col("m1") - F.col("m2")).alias("mean_diff"))
    return out.withColumn("p", f_tail(F.col("t") * F.col("t"), F.lit(1), F.col("df"))).withColumn("significant", F.col("p") < 0.05)


def cohens_d(df: DataFrame, value: str = "accuracy", group: str = "model") -> DataFrame:
    """a, b, d, size (small, medium, large); only where there are exactly two groups."""
    m = _moments(df, value, group)
    two = m.agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), "mean", "var"))).alias("m")).where(F.size("m") == 2)
    a, b = F.col("m")[0], F.col("m")[1]
    out = two.select(a["g"].alias("a"), b["g"].alias("b"), F.try_divide(a["mean"] - b["mean"], F.sqrt((a["var"] + b["var"]) / 2)).alias("d"))
    return out.withColumn("size", F.when(F.abs("d") < 0.5, "small").when(F.abs("d") < 0.8, "medium").otherwise("large"))


def summary_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("evaluations"), F.count_distinct("model").alias("models"), F.count_distinct("tested_on").alias("datasets"), F.coalesce(F.bool_or("cross_dataset"), F.lit(False)).alias("any_cross"))


def confidence_interval(df: DataFrame, by: list[str], value: str, z: float = 1.959964) -> DataFrame:
    """by, n, mean, low, high: the mean and its normal interval."""
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))
