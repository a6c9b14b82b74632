"""Threshold metrics of binary detectors, one grouped aggregation each. Label 1 is an attack, the positive class; a score is its probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def confusion(df: DataFrame, by: list[str], *, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """by, tp, fn, tn, fp. A score at the threshold is no attack; null scores and labels count nowhere."""
    attack = F.col(score) > threshold
    return df.groupBy(*by).agg(
        _n((F.col(label) == 1) & attack).alias("tp"), _n((F.col(label) == 1) & ~attack).alias("fn"),
        _n((F.col(label) == 0) & ~attack).alias("tn"), _n((F.col(label) == 0) & attack).alias("fp"),
    )


def over(part: Column, whole: Column) -> Column:
    """part / whole, with a whole of at least 1."""
    return part / F.greatest(whole, F.lit(1))


def with_standard_metrics(counts: DataFrame) -> DataFrame:
    """Confusion counts with accuracy, precision, recall, specificity, f1_score, mcc, cohen_kappa and balanced_accuracy."""
    tp, fn, tn, fp = (F.col(c).cast("double") for c in ("tp", "fn", "tn", "fp"))
    n = tp + fn + tn + fp
    one_prediction = (tp + fp == 0) | (tn + fn == 0)
    root = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / F.nullif(n * n, F.lit(0.0))
    recalls = F.array_compact(F.array(F.when(tp + fn > 0, over(tp, tp + fn)), F.when(tn + fp > 0, over(tn, tn + fp))))
    return counts.withColumns({
        "accuracy": over(tp + tn, n), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "specificity": over(tn, tn + fp),
        "f1_score": F.when(2 * tp + fp + fn > 0, F.try_divide(2 * tp, 2 * tp + fp + fn)).otherwise(0.0),
        "mcc": F.when(one_prediction | (root == 0), 0.0).otherwise(F.try_divide(tp * tn - fp * fn, F.sqrt(root))),
        "cohen_kappa": F.when(one_prediction | (chance == 1), 0.0).otherwise(F.try_divide((tp + tn) / F.nullif(n, F.lit(0.0)) - chance, 1 - chance)),
        "balanced_accuracy": F.try_divide(F.aggregate(recalls, F.lit(0.0), lambda a, b: a + b), F.size(recalls)),
    })


def standard_metrics(df: DataFrame, by: list[str], *, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    return with_standard_metrics(confusion(df, by, threshold=threshold, score=score, label=label))


def with_error_rates(counts: DataFrame) -> DataFrame:
    """Confusion counts with apcer, bpcer, acer, far, frr and hter; a rate over an absent class is 0."""
    apcer, bpcer = over(F.col("fn"), F.col("tp") + F.col("fn")), over(F.col("fp"), F.col("tn") + F.col("fp"))
    return counts.withColumns({"apcer": apcer, "bpcer": bpcer}).withColumns({"acer": (F.col("apcer") + F.col("bpcer")) / 2, "far": F.col("bpcer"), "frr": F.col("apcer")}).withColumn("hter", (F.col("far") + F.col("frr")) / 2)


def biometric_metrics(df: DataFrame, by: list[str], targets: tuple[float, ...] = (0.1, 0.05, 0.01), *, iso: bool = False, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """by, the error rates, eer, eer_threshold and bpcer_at_apcer. by must not be empty."""
    from samplekit.operators import curves

    rates = with_error_rates(confusion(df, by, threshold=threshold, score=score, label=label))
    return rates.join(curves.biometric_points(df, by, targets, iso=iso, score=score, label=label), by, "left")


def classification_report(df: DataFrame, by: list[str], *, threshold: float = 0.5, score: str = "score", label: str = "label", names: tuple[str, str] = ("Bonafide", "Attack")) -> DataFrame:
    """by, class, precision, recall, f1_score, support: both classes, accuracy, and the plain and support-weighted means. What is undefined is 0; an absent class has a row."""
    c = confusion(df, by, threshold=threshold, score=score, label=label)
    tp, fn, tn, fp = (F.col(x).cast("double") for x in ("tp", "fn", "tn", "fp"))

    def row(name: str, hit: Column, missed: Column, wrong: Column) -> Column:
        f1 = F.when(2 * hit + missed + wrong > 0, F.try_divide(2 * hit, 2 * hit + missed + wrong)).otherwise(0.0)
        return F.struct(F.lit(name).alias("class"), over(hit, hit + wrong).alias("precision"), over(hit, hit + missed).alias("recall"), f1.alias("f1_score"), (hit + missed).cast("long").alias("support"))

    two = c.select(*by, row(names[0], tn, fp, fn).alias("a"), row(names[1], tp, fn, fp).alias("b"), over(tp + tn, tp + fn + tn + fp).alias("acc"))
    n = F.col("a.support") + F.col("b.support")

    def mean(name: str, weigh: bool) -> Column:
        parts = [(F.col(f"a.{k}") * F.col("a.support") + F.col(f"b.{k}") * F.col("b.support")) / F.greatest(n, F.lit(1)) if weigh else (F.col(f"a.{k}") + F.col(f"b.{k}")) / 2 for k in ("precision", "recall", "f1_score")]
        return F.struct(F.lit(name).alias("class"), *(p.alias(k) for p, k in zip(parts, ("precision", "recall", "f1_score"), strict=True)), n.alias("support"))

    accuracy = F.struct(F.lit("accuracy").alias("class"), *(F.col("acc").alias(k) for k in ("precision", "recall", "f1_score")), n.alias("support"))
    return two.select(*by, F.explode(F.array("a", "b", accuracy, mean("macro avg", False), mean("weighted avg", True))).alias("r")).select(*by, "r.*")


def confusion_normalized(df: DataFrame, by: list[str], *, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """by, true_label, predicted_label, n, share of the true label's rows."""
    c = confusion(df, by, threshold=threshold, score=score, label=label)
    cells = F.array(*(F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"), F.col(x).alias("n"), over(F.col(x), F.col(x) + F.col(y)).alias("share")) for t, p, x, y in ((0, 0, "tn", "fp"), (0, 1, "fp", "tn"), (1, 0, "fn", "tp"), (1, 1, "tp", "fn"))))
    return c.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def score_histogram(df: DataFrame, by: list[str], *, bins: int = 49, score: str = "score", label: str = "label") -> DataFrame:
    """by, label, bin (from 0), n, density over equal bins of [0, 1]; the last bin is closed. Only bins with rows."""
    binned = df.where(F.col(score).between(0, 1)).groupBy(*by, label, F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return binned.withColumn("density", F.col("n") * bins / F.sum("n").over(Window.partitionBy(*by, label)))


def error_by_confidence(df: DataFrame, by: list[str], *, bins: int = 10, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """by, bin, n, error_rate in equal bins [low, high) of [0, 1]; a score of 1 is in none, an empty bin has rate 0."""
    rows = df.where((F.col(score) >= 0) & (F.col(score) < 1)).select(*by, F.floor(F.col(score) * bins).alias("bin"), ((F.col(score) > threshold).cast("int") != F.col(label)).alias("wrong"))
    found = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), _n(F.col("wrong")).alias("errors"))
    spine = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return spine.join(found, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("errors") / F.col("n"), F.lit(0.0)).alias("error_rate"))


def confidence_histograms(df: DataFrame, by: list[str], *, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """by, kind, bin, n, mean: confidence of correct and wrong rows in 30 bins, scores of false positives and negatives in 20, over each kind's own range."""
    counts = df.groupBy(*by, F.col(score).alias("__score"), F.col(label).alias("__label")).agg(F.count("*").alias("__n"))  # rows of one score and label are placed at once
    attack = F.col("__score") > threshold
    right = attack.cast("int") == F.col("__label")
    sure = F.greatest(F.col("__score"), 1 - F.col("__score"))
    kinds = F.array(
        F.struct(F.when(right, "correct").otherwise("error").alias("kind"), sure.alias("x"), F.lit(30).alias("bins")),
        F.struct(F.when(~right & attack, "false_positive").when(~right, "false_negative").alias("kind"), F.col("__score").alias("x"), F.lit(20).alias("bins")),
    )
    rows = counts.select(*by, "__n", F.explode(kinds).alias("k")).select(*by, "__n", "k.*").where("kind is not null")
    mean = F.try_divide(F.sum(F.col("x") * F.col("__n")), F.sum(F.when(F.col("x").isNotNull(), F.col("__n"))))
    reach = rows.groupBy(*by, "kind").agg(F.min("x").alias("low"), F.max("x").alias("high"), mean.alias("mean"))
    share = F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low"))
    placed = rows.join(reach, [*by, "kind"]).withColumn("bin", F.coalesce(F.least(F.floor(share * F.col("bins")), F.col("bins") - 1), F.lit(0)).cast("long"))
    return placed.groupBy(*by, "kind", "bin").agg(F.sum("__n").alias("n"), F.first("mean").alias("mean"))


def near_constant(df: DataFrame, by: list[str], *, score: str = "score", key: str = "sample_id") -> DataFrame:
    """by, constant: whether all scores are close to the first by key."""
    first = df.groupBy(*by).agg(F.min_by(score, key).alias("__first"), F.min(score).alias("__low"), F.max(score).alias("__high"))
    slack = F.abs("__first") * 1e-5 + 1e-8
    return first.select(*by, ((F.col("__high") - F.col("__first") <= slack) & (F.col("__first") - F.col("__low") <= slack)).alias("constant"))


def flattened_cell_metrics(df: DataFrame, by: list[str], *, thresholds: int = 200, score: str = "score", label: str = "label") -> DataFrame:
    """by, tp, fp, fn, tn, precision, recall, auc over both one-hot cells of every row; the area uses evenly spaced thresholds."""
    steps = thresholds - 1
    cells = df.select(*by, F.explode(F.array(F.struct((F.col(label) == 1).alias("y"), F.col(score).alias("p")), F.struct((F.col(label) == 0).alias("y"), (1 - F.col(score)).alias("p")))).alias("c")).select(*by, "c.*")
    passed = F.when(F.col("p") > 0, 1 + F.least(F.ceil(F.col("p") * steps) - 1, F.lit(steps - 1))).otherwise(1)
    counts = cells.groupBy(*by, passed.cast("int").alias("passed")).agg(_n(F.col("y")).alias("yes"), _n(~F.col("y")).alias("no"), _n(F.col("y") & (F.col("p") > 0.5)).alias("tp"), _n(~F.col("y") & (F.col("p") > 0.5)).alias("fp"))
    down = Window.partitionBy(*by).orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    curve = counts.withColumns({"y1": F.sum("yes").over(down), "p_all": F.sum("yes").over(whole), "n_all": F.sum("no").over(whole)})
    area = F.sum(F.col("no") * (2 * F.col("y1") - F.col("yes")) / 2.0)
    out = curve.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.max("p_all").alias("p"), F.max("n_all").alias("n"), area.alias("area"))
    tp, fp = F.col("tp"), F.col("fp")
    return out.select(*by, "tp", "fp", (F.col("p") - tp).alias("fn"), (F.col("n") - fp).alias("tn"), over(tp, tp + fp).alias("precision"), over(tp, F.col("p")).alias("recall"), F.try_divide("area", F.col("p").cast("double") * F.col("n")).alias("auc"))


def cross_entropy(df: DataFrame, by: list[str], *, smoothing: float = 0.0, weight: str | None = None, score: str = "score", label: str = "label", clip: float = 1e-7) -> DataFrame:
    """by, loss: mean categorical cross-entropy of the two probabilities; weight: a column that rows count by."""
    y = F.col(label) * (1 - smoothing) + smoothing / 2
    attack, bonafide = (F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip)) for p in (F.col(score), 1 - F.col(score)))
    loss = -(y * F.ln(attack) + (1 - y) * F.ln(bonafide))
    if weight is None:
        return df.groupBy(*by).agg(F.avg(loss).alias("loss"))
    return df.groupBy(*by).agg(F.try_divide(F.sum(loss * F.col(weight)), F.count("*")).alias("loss"))


def score_profile(df: DataFrame, by: list[str], *, score: str = "score") -> DataFrame:
    """by, low, high, distinct (at 6 decimals), near_constant, counts (a map of the values where there are 3 or fewer)."""
    values = df.groupBy(*by, F.round(score, 6).alias("__v")).agg(F.count("*").alias("__n"), F.min(score).alias("__low"), F.max(score).alias("__high"))
    top = values.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("__v")))
    few = F.sort_array(F.collect_list(F.when(F.col("__k") <= 3, F.struct("__v", "__n"))))
    out = top.groupBy(*by).agg(F.min("__low").alias("low"), F.max("__high").alias("high"), F.count("*").alias("distinct"), few.alias("__few"))
    return out.select(*by, "low", "high", "distinct", (F.col("distinct") <= 3).alias("near_constant"), F.when(F.col("distinct") <= 3, F.map_from_entries("__few")).alias("counts"))


def evaluation(df: DataFrame, by: list[str], *, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """by and every metric of a result matrix, from one pass of counts and one of curves. by must not be empty."""
    from samplekit.operators import curves

    counts = with_error_rates(standard_metrics(df, by, threshold=threshold, score=score, label=label))
    return counts.join(curves.curve_metrics(df, by, score=score, label=label), by, "left")
