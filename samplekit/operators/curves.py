"""Exact threshold curves of binary detectors, for any number of groups and groups of any size.

Scores are first counted by group and distinct value. Counts are then summed in two levels: within parts between
quantiles of a group's distinct scores, and over the part totals, so that no task has to sort a whole group, whatever the scores are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplekit.functions.parts import part_count, part_of, quantile_bounds


def _same(by: list[str], other: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in by]


def counted_scores(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """by, score, pos, neg: rows of either class at each distinct score. Null and NaN scores and null labels are left out."""
    own = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    return own.groupBy(*by, F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))


def _constant() -> Column:
    """Whether the largest score is within a slack of the least: no curve is drawn of such scores."""
    low, high = F.col("__low"), F.col("__high")
    return (high == low) | (F.abs(low) < float("inf")) & (high - low <= 1e-8 + 1e-5 * F.abs(low))


def placed_counts(df: DataFrame, by: list[str], score: str = "score", label: str = "label", parts: int | None = None) -> DataFrame:
    """counted_scores with __part, the number of its group's quantiles below a score, and the group's totals."""
    parts = parts or part_count(df.sparkSession)
    counts = counted_scores(df, by, score, label)
    bounds = quantile_bounds(F.col("score"), parts)
    reach = counts.groupBy(*by).agg(F.min("score").alias("__low"), F.max("score").alias("__high"), F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.count("*").alias("points"), bounds.alias("__bounds"))
    reach = reach.select(*[F.col(c).alias(f"__r_{c}") for c in by], "__low", "__high", "all_pos", "all_neg", "points", "__bounds")
    return counts.join(reach, _same(by, "__r_") or F.lit(True)).withColumn("__part", part_of(F.col("__bounds"), F.col("score"), parts)).drop("__bounds")


def cumulative_counts(df: DataFrame, by: list[str], score: str = "score", label: str = "label", parts: int | None = None) -> DataFrame:
    """by, score, pos, neg, tps, fps (counts at this score or above), next_pos, next_neg (of the next lower score), all_pos, all_neg, rank (from 1), points, constant (all scores within 1e-8 + 1e-5 of the least)."""
    rows = placed_counts(df, by, score, label, parts)
    sums = rows.groupBy(*by, "__part").agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"), F.count("*").alias("__n"), F.max_by(F.struct("pos", "neg"), "score").alias("__head"))
    above = Window.partitionBy(*by).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.desc("__part"))
    offsets = sums.select(*[F.col(c).alias(f"__o_{c}") for c in by], F.col("__part").alias("__of"), *(F.coalesce(F.sum(f"__{x}").over(above), F.lit(0)).alias(f"__{x}0") for x in ("pos", "neg", "n")), F.lead("__head").over(after).alias("__next"))
    inside = Window.partitionBy(*by, "__part").orderBy(F.desc("score"))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__p": F.sum("pos").over(running), "__q": F.sum("neg").over(running), "__k": F.row_number().over(inside), "__lead": F.lead(F.struct("pos", "neg")).over(inside)})
    joined = rows.join(offsets, [F.col("__part") == F.col("__of"), *_same(by, "__o_")])
    follower = F.coalesce("__lead", "__next")
    return joined.select(
        *by, "score", "pos", "neg", (F.col("__pos0") + F.col("__p")).alias("tps"), (F.col("__neg0") + F.col("__q")).alias("fps"),
        follower["pos"].alias("next_pos"), follower["neg"].alias("next_neg"), "all_pos", "all_neg", (F.col("__n0") + F.col("__k")).alias("rank"), "points", _constant().alias("constant"),
    )


def _corner() -> Column:
    return (F.col("rank") == 1) | (F.col("rank") == F.col("points")) | (F.col("next_neg") != F.col("neg")) | (F.col("next_pos") != F.col("pos"))


def _rate(count: str | Column, total: str) -> Column:
    return F.when(F.col(total) > 0, (F.col(count) if isinstance(count, str) else count) / F.col(total))


def roc_curve(df: DataFrame, by: list[str], *, drop_intermediate: bool = True, score: str = "score", label: str = "label") -> DataFrame:
    """by, threshold, fpr, tpr; the first point (0, 0) has no threshold (null). Points that lie on a line between neighbours go, if so asked. A rate of an absent class is null."""
    points = cumulative_counts(df, by, score, label)
    if drop_intermediate:
        points = points.where(_corner())
    curve = points.select(*by, F.col("score").alias("threshold"), _rate("fps", "all_neg").alias("fpr"), _rate("tps", "all_pos").alias("tpr"), "rank")
    first = points.where("rank = 1").select(*by, F.lit(None).cast("double").alias("threshold"), _rate(F.lit(0), "all_neg").alias("fpr"), _rate(F.lit(0), "all_pos").alias("tpr"), F.lit(0).cast("long").alias("rank"))
    return curve.unionByName(first).withColumnRenamed("rank", "point")


def _auc() -> Column:
    area = F.sum(F.col("neg") * (2 * F.col("tps") - F.col("pos")) / 2.0)
    both = F.max("all_pos").cast("double") * F.max("all_neg")
    return F.when((both > 0) & ~F.max("constant"), area / both)


def roc_auc(df: DataFrame, by: list[str], *, score: str = "score", label: str = "label") -> DataFrame:
    """by, roc_auc: area by trapezoids, null where a class is absent or scores are constant."""
    return cumulative_counts(df, by, score, label).groupBy(*by).agg(_auc().alias("roc_auc"))


def pr_curve(df: DataFrame, by: list[str], *, score: str = "score", label: str = "label") -> DataFrame:
    """by, threshold, precision, recall, and the end point (1, 0) without a threshold."""
    points = cumulative_counts(df, by, score, label)
    curve = points.select(*by, F.col("score").alias("threshold"), (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"), _rate("tps", "all_pos").alias("recall"))
    end = points.where("rank = 1").select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


def _average_precision() -> Column:
    total = F.sum(F.col("pos") * F.col("tps") / (F.col("tps") + F.col("fps")))
    return F.when((F.max("all_pos") > 0) & (F.max("all_neg") > 0) & ~F.max("constant"), total / F.max("all_pos"))


def average_precision(df: DataFrame, by: list[str], *, score: str = "score", label: str = "label") -> DataFrame:
    """by, average_precision: precision weighted by the step in recall; null where a class is absent or scores are constant."""
    return cumulative_counts(df, by, score, label).groupBy(*by).agg(_average_precision().alias("average_precision"))


def _least_gap(drop_intermediate: bool = True) -> Column:
    """Struct of eer and threshold at the point where the rates differ least; null where a class is absent or scores are constant."""
    usable = (F.col("all_pos") > 0) & (F.col("all_neg") > 0) & ~F.col("constant")
    if drop_intermediate:
        usable = usable & _corner()
    fpr, fnr = F.when(usable, F.col("fps") / F.col("all_neg")), F.when(usable, 1 - F.col("tps") / F.col("all_pos"))
    point = F.struct(F.round(F.abs(fpr - fnr), 12).alias("gap"), F.col("rank").alias("rank"), ((fpr + fnr) / 2).alias("eer"), F.col("score").alias("threshold"))
    return F.min(F.when(usable, point))  # the start (0, 0) has a gap of 1, which no later point exceeds


def equal_error(df: DataFrame, by: list[str], *, drop_intermediate: bool = True, score: str = "score", label: str = "label") -> DataFrame:
    """by, eer, eer_threshold: where false positive and false negative rates differ least (to 12 decimals), at the highest such threshold; null where a class is absent or scores are constant."""
    best = cumulative_counts(df, by, score, label).groupBy(*by).agg(_least_gap(drop_intermediate).alias("best"))
    return best.select(*by, F.col("best.eer").alias("eer"), F.col("best.threshold").alias("eer_threshold"))


def curve_metrics(df: DataFrame, by: list[str], *, score: str = "score", label: str = "label") -> DataFrame:
    """by, roc_auc, average_precision, eer, eer_threshold: one build of the curves and one aggregation over them."""
    out = cumulative_counts(df, by, score, label).groupBy(*by).agg(_auc().alias("roc_auc"), _average_precision().alias("average_precision"), _least_gap().alias("best"))
    return out.select(*by, "roc_auc", "average_precision", F.col("best.eer").alias("eer"), F.col("best.threshold").alias("eer_threshold"))


def det_curve(df: DataFrame, by: list[str], *, score: str = "score", label: str = "label") -> DataFrame:
    """by, threshold, fpr, fnr of the reduced curve, and both as normal deviates (null at 0 and 1)."""
    from samplekit.functions.normal import normal_deviate

    curve = roc_curve(df, by, score=score, label=label).select(*by, "point", "threshold", "fpr", (1 - F.col("tpr")).alias("fnr"))
    return curve.withColumns({"fpr_deviate": normal_deviate("fpr"), "fnr_deviate": normal_deviate("fnr")})


def bpcer_at_apcer(df: DataFrame, by: list[str], targets: tuple[float, ...] = (0.1, 0.05, 0.01), *, iso: bool = False, score: str = "score", label: str = "label") -> DataFrame:
    """by, bpcer_at_apcer: for each target (as text) the share of bonafide scores up to the attack score that this share of attacks lies below; above it, if iso. 0 where a class is absent or scores are constant."""
    points = cumulative_counts(df, by, score, label)
    return points.groupBy(*by).agg(_bpcer_at(targets, iso).alias("bpcer_at_apcer"))


def _bpcer_at(targets: tuple[float, ...], iso: bool) -> Column:
    """Map from targets, as text, to rates."""
    rate = F.col("fps") - F.col("neg") if iso else F.col("all_neg") - F.col("fps") + F.col("neg")
    below = F.col("all_pos") - F.col("tps") + F.col("pos")

    def at(target: float) -> Column:
        place = F.floor(F.greatest(F.lit(0.0), F.least(F.col("all_pos") * F.lit(target), (F.col("all_pos") - 1).cast("double"))))
        found = F.min(F.when((below > place) & (F.col("all_neg") > 0) & ~F.col("constant"), F.struct("score", F.try_divide(rate, F.col("all_neg")).alias("value"))))
        return F.coalesce(found["value"], F.lit(0.0))

    return F.create_map(*(x for t in targets for x in (F.lit(f"{t:g}"), at(t))))


def biometric_points(df: DataFrame, by: list[str], targets: tuple[float, ...], *, iso: bool = False, score: str = "score", label: str = "label") -> DataFrame:
    """by, eer, eer_threshold, bpcer_at_apcer, of one build of the curves."""
    out = cumulative_counts(df, by, score, label).groupBy(*by).agg(_least_gap().alias("best"), _bpcer_at(targets, iso).alias("bpcer_at_apcer"))
    return out.select(*by, F.col("best.eer").alias("eer"), F.col("best.threshold").alias("eer_threshold"), "bpcer_at_apcer")
