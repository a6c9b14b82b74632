"""Queries of the evaluation operators over the predictions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplekit.functions import normal
from samplekit.operators import curves, metrics
from samplekit.plans import bindings as b

BY = ["model", "trained_on", "tested_on"]
KEYS = ", ".join(BY)


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


COUNTS = b.PREDICTIONS + f""", c as (select {KEYS}, count(*) filter (where label = 1 and score > 0.5) as tp, count(*) filter (where label = 1 and score <= 0.5) as fn,
  count(*) filter (where label = 0 and score <= 0.5) as tn, count(*) filter (where label = 0 and score > 0.5) as fp from predictions group by {KEYS})"""
CURVE = b.PREDICTIONS + f""", g as (select {KEYS}, score, sum(label) as pos, sum(1 - label) as neg from predictions group by {KEYS}, score)
, w as (select *, sum(pos) over (partition by {KEYS} order by score desc) as tps, sum(neg) over (partition by {KEYS} order by score desc) as fps,
  lead(pos) over (partition by {KEYS} order by score desc) as npos, lead(neg) over (partition by {KEYS} order by score desc) as nneg,
  sum(pos) over (partition by {KEYS}) as p, sum(neg) over (partition by {KEYS}) as n, row_number() over (partition by {KEYS} order by score desc) as k,
  count(*) over (partition by {KEYS}) as points from g)
, corners as (select * from w where k = 1 or k = points or npos <> pos or nneg <> neg)"""
STANDARD = COUNTS + f""", s as (select *, (tp + tn)::double / greatest(tp + tn + fp + fn, 1) as accuracy, tp::double / greatest(tp + fp, 1) as precision,
  tp::double / greatest(tp + fn, 1) as recall, tn::double / greatest(tn + fp, 1) as specificity,
  case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end as f1_score,
  fn::double / greatest(tp + fn, 1) as apcer, fp::double / greatest(tn + fp, 1) as bpcer from c)"""
RESULTS = STANDARD + ", " + CURVE[len(b.PREDICTIONS) + 2 :] + f""", auc as (select {KEYS}, sum(neg * (2 * tps - pos) / 2.0::double) / (max(p)::double * max(n)) as roc_auc from w group by {KEYS})
, e as (select {KEYS}, eer, threshold as eer_threshold from (select {KEYS}, (fps::double / n + 1 - tps::double / p) / 2 as eer, score as threshold,
  row_number() over (partition by {KEYS} order by round(abs(fps::double / n - (1 - tps::double / p)), 12), score desc) as j from corners) where j = 1)
, results as (select s.*, (apcer + bpcer) / 2 as acer, roc_auc, eer, eer_threshold, trained_on <> tested_on as cross_dataset from s join auc using ({KEYS}) join e using ({KEYS}))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return b.predictions(spark, d)


def results(spark: SparkSession, d: str) -> DataFrame:
    """The result matrix."""
    return metrics.evaluation(predictions(spark, d), BY).withColumn("cross_dataset", F.col("trained_on") != F.col("tested_on"))


def _half_labels(column: str = "score") -> Column:
    return F.when(F.col(column) > 1 - F.col(column), 1).otherwise(0)


def confusion_slice(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.with_error_rates(metrics.with_standard_metrics(metrics.confusion(predictions(spark, d), BY))).select(*BY, "tp", "fn", "tn", "fp", "accuracy", "precision", "recall", "specificity", "apcer", "bpcer", "acer"), "accuracy", "precision", "recall", "specificity", "apcer", "bpcer", "acer")


def standard(spark: SparkSession, d: str) -> DataFrame:
    names = ["accuracy", "precision", "recall", "specificity", "f1_score", "mcc", "cohen_kappa", "balanced_accuracy"]
    return r6(metrics.standard_metrics(predictions(spark, d), BY).select(*BY, *names), *names)


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    attack = F.col("score")
    rows = predictions(spark, d).select(
        "model", "trained_on", "sample_id", F.round(1 - attack, 6).alias("bonafide_prob"), F.round(attack, 6).alias("attack_prob"),
        _half_labels().alias("predicted_label"), F.round(F.greatest(attack, 1 - attack), 6).alias("confidence"), (_half_labels() == F.col("label")).alias("correct"),
    )
    return rows


DECISIONS = b.PREDICTIONS + """
select model, trained_on, sample_id, round(1 - score, 6) as bonafide_prob, round(score, 6) as attack_prob, case when score > 1 - score then 1 else 0 end as predicted_label,
  round(greatest(score, 1 - score), 6) as confidence, case when score > 1 - score then 1 else 0 end = label as correct
from predictions"""


def _weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    weighted = predictions(spark, d).withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(0.25))
    return r6(metrics.cross_entropy(weighted, BY, weight="weight"), "loss")


WEIGHTED_LOSS = b.PREDICTIONS + f"""
, p as (select *, greatest(least(score, 1 - 1e-7), 1e-7) as attack, greatest(least(1 - score, 1 - 1e-7), 1e-7) as bonafide, case when label = 1 then 1.0::double else 0.25::double end as weight from predictions)
select {KEYS}, round(sum(-(label * ln(attack) + (1 - label) * ln(bonafide)) * weight) / count(*), 6) as loss from p group by {KEYS}"""


def _polynomial(values: tuple[float, ...], x: str) -> str:
    out = f"{values[-1]!r}::double"
    for value in values[-2::-1]:
        out = f"({out} * {x} + {value!r}::double)"
    return out


def _deviate(p: str) -> str:
    """The rational approximations of the normal quantile, as SQL."""
    q, r = f"({p} - 0.5::double)", f"sqrt(-ln(least({p}, 1 - {p})))"
    parts = [(normal.MIDDLE, f"(0.180625::double - {q} * {q})"), (normal.AWAY, f"({r} - 1.6::double)"), (normal.TAIL, f"({r} - 5)")]
    middle, away, tail = (f"{_polynomial(own[0], x)} / {_polynomial(own[1], x)}" for own, x in parts)
    return f"case when {p} > 0 and {p} < 1 then case when abs{q} <= 0.425::double then {q} * {middle} when {r} <= 5 then sign{q} * {away} else sign{q} * {tail} end end"


def _det(spark: SparkSession, d: str) -> DataFrame:
    curve = curves.det_curve(predictions(spark, d), BY)
    return r6(curve.select(*BY, "point", "fpr", "fnr", "fpr_deviate", "fnr_deviate"), "fpr", "fnr", "fpr_deviate", "fnr_deviate")


DET = CURVE + f"""
, points as (
  select {KEYS}, k as point, fps::double / n as fpr, 1 - tps::double / p as fnr from corners
  union all select distinct {KEYS}, 0, 0.0::double, 1.0::double from w)
select {KEYS}, point, round(fpr, 6) as fpr, round(fnr, 6) as fnr, round({_deviate("fpr")}, 6) as fpr_deviate, round({_deviate("fnr")}, 6) as fnr_deviate from points"""


def _odd_scores(spark: SparkSession, d: str) -> DataFrame:
    odd = b.odd_scores(spark, d)
    rates = curves.bpcer_at_apcer(odd, ["model"]).select("model", *(F.col("bpcer_at_apcer")[t].alias(f"at_{n}") for t, n in (("0.1", "10"), ("0.01", "1"))))
    return r6(curves.curve_metrics(odd, ["model"]).join(rates, "model"), "roc_auc", "average_precision", "eer", "eer_threshold", "at_10", "at_1")


ODD_SCORES = b.ODD_SCORES + """
, g as (select model, score, sum(label) as pos, sum(1 - label) as neg from odd group by model, score)
, w as (select *, sum(pos) over (partition by model order by score desc) as tps, sum(neg) over (partition by model order by score desc) as fps,
  lead(pos) over (partition by model order by score desc) as npos, lead(neg) over (partition by model order by score desc) as nneg, sum(pos) over (partition by model) as p, sum(neg) over (partition by model) as n,
  row_number() over (partition by model order by score desc) as k, count(*) over (partition by model) as points,
  max(score) over (partition by model) - min(score) over (partition by model) <= 1e-8 + 1e-5 * abs(min(score) over (partition by model)) as constant from g)
, areas as (select model, sum(neg * (2 * tps - pos) / 2.0::double) / (max(p)::double * max(n)) as roc_auc, sum(pos * tps::double / (tps + fps)) / max(p) as average_precision from w where not constant group by model)
, e as (select model, eer, eer_threshold from (select model, (fps::double / n + 1 - tps::double / p) / 2 as eer, score as eer_threshold, row_number() over (partition by model order by round(abs(fps::double / n - (1 - tps::double / p)), 12), score desc) as j
  from w where not constant and (k = 1 or k = points or npos <> pos or nneg <> neg)) where j = 1)
, a as (select model, score, row_number() over (partition by model order by score) - 1 as i, count(*) over (partition by model) as c from odd where label = 1)
, t as (select model, max(score) filter (where i = floor(least(c * 0.1::double, c - 1))) as t10, max(score) filter (where i = floor(least(c * 0.01::double, c - 1))) as t1 from a group by model)
, b as (select model, avg((score <= t10)::int) as at_10, avg((score <= t1)::int) as at_1 from odd join t using (model) where label = 0 group by model)
select m.model, round(roc_auc, 6) as roc_auc, round(average_precision, 6) as average_precision, round(eer, 6) as eer, round(eer_threshold, 6) as eer_threshold,
  case when constant then 0 else round(at_10, 6) end as at_10, case when constant then 0 else round(at_1, 6) end as at_1
from (select distinct model, constant from w) m left join areas using (model) left join e using (model) left join b using (model)"""


QUERIES = {
    "f09_f11_f12_f18_odd_scores": (_odd_scores, ODD_SCORES),
    "f01_f02_f13_f15_confusion_rates": (
        confusion_slice,
        STANDARD + f" select {KEYS}, tp, fn, tn, fp, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(specificity, 6) as specificity, round(apcer, 6) as apcer, round(bpcer, 6) as bpcer, round((apcer + bpcer) / 2, 6) as acer from s",
    ),
    "f02_f06_standard_metrics": (
        standard,
        STANDARD + f""" select {KEYS}, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(specificity, 6) as specificity, round(f1_score, 6) as f1_score,
      round(case when tp + fp = 0 or tn + fn = 0 or (tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn) = 0 then 0 else (tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) end, 6) as mcc,
      round(case when tp + fp = 0 or tn + fn = 0 then 0 else ((tp + tn)::double / (tp + tn + fp + fn) - ch) / (1 - ch) end, 6) as cohen_kappa,
      round(case when tp + fn = 0 then specificity when tn + fp = 0 then recall else (recall + specificity) / 2 end, 6) as balanced_accuracy
      from (select *, ((tp + fp)::double * (tp + fn) + (tn + fn)::double * (tn + fp)) / ((tp + tn + fp + fn)::double * (tp + tn + fp + fn)) as ch from s)""",
    ),
    "f07_classification_report": (
        lambda spark, d: r6(metrics.classification_report(predictions(spark, d), ["model", "tested_on"]), "precision", "recall", "f1_score"),
        b.PREDICTIONS + """, c as (select model, tested_on, count(*) filter (where label = 1 and score > 0.5)::double as tp, count(*) filter (where label = 1 and score <= 0.5)::double as fn,
          count(*) filter (where label = 0 and score <= 0.5)::double as tn, count(*) filter (where label = 0 and score > 0.5)::double as fp from predictions group by model, tested_on)
        , k as (select model, tested_on, 'Bonafide' as class, tn / greatest(tn + fn, 1) as precision, tn / greatest(tn + fp, 1) as recall, case when 2 * tn + fp + fn > 0 then 2 * tn / (2 * tn + fp + fn) else 0 end as f1_score, (tn + fp)::bigint as support, (tp + tn) / (tp + tn + fp + fn) as acc from c
          union all select model, tested_on, 'Attack', tp / greatest(tp + fp, 1), tp / greatest(tp + fn, 1), case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, (tp + fn)::bigint, (tp + tn) / (tp + tn + fp + fn) from c)
        select model, tested_on, class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score, support::bigint as support from (
          select model, tested_on, class, precision, recall, f1_score, support from k
          union all select model, tested_on, 'accuracy', max(acc), max(acc), max(acc), sum(support)::bigint from k group by model, tested_on
          union all select model, tested_on, 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)::bigint from k group by model, tested_on
          union all select model, tested_on, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), sum(support)::bigint from k group by model, tested_on)""",
    ),
    "f08_roc_curve": (
        lambda spark, d: r6(curves.roc_curve(predictions(spark, d), BY), "threshold", "fpr", "tpr"),
        CURVE + f" select {KEYS}, round(score, 6) as threshold, round(fps::double / n, 6) as fpr, round(tps::double / p, 6) as tpr, k as point from corners union all select distinct {KEYS}, null, 0.0::double, 0.0::double, 0 from w",
    ),
    "f09_roc_auc": (
        lambda spark, d: r6(curves.roc_auc(predictions(spark, d), BY), "roc_auc"),
        RESULTS + f" select {KEYS}, round(roc_auc, 6) as roc_auc from auc",
    ),
    "f10_pr_curve": (
        lambda spark, d: r6(curves.pr_curve(predictions(spark, d), BY), "threshold", "precision", "recall"),
        CURVE + f" select {KEYS}, round(score, 6) as threshold, round(tps::double / (tps + fps), 6) as precision, round(tps::double / p, 6) as recall from w union all select distinct {KEYS}, null, 1.0::double, 0.0::double from w",
    ),
    "f11_average_precision": (
        lambda spark, d: r6(curves.average_precision(predictions(spark, d), BY), "average_precision"),
        CURVE + f" select {KEYS}, round(sum(pos * tps::double / (tps + fps)) / max(p), 6) as average_precision from w group by {KEYS}",
    ),
    "f12_equal_error": (
        lambda spark, d: r6(curves.equal_error(predictions(spark, d), BY), "eer", "eer_threshold"),
        RESULTS + f" select {KEYS}, round(eer, 6) as eer, round(eer_threshold, 6) as eer_threshold from e",
    ),
    "f16_f17_far_frr_hter": (
        lambda spark, d: r6(metrics.with_error_rates(metrics.confusion(predictions(spark, d), BY)).select(*BY, "far", "frr", "hter"), "far", "frr", "hter"),
        STANDARD + f" select {KEYS}, round(bpcer, 6) as far, round(apcer, 6) as frr, round((apcer + bpcer) / 2, 6) as hter from s",
    ),
    "f18_bpcer_at_apcer": (
        lambda spark, d: r6(curves.bpcer_at_apcer(predictions(spark, d), BY).select(*BY, *(F.col("bpcer_at_apcer")[t].alias(f"at_{n}") for t, n in (("0.1", "10"), ("0.05", "5"), ("0.01", "1")))), "at_10", "at_5", "at_1"),
        b.PREDICTIONS + f""", a as (select {KEYS}, score, row_number() over (partition by {KEYS} order by score) - 1 as i, count(*) over (partition by {KEYS}) as n from predictions where label = 1)
        , t as (select {KEYS}, max(score) filter (where i = floor(greatest(0.0::double, least(n * 0.1::double, n - 1)))) as t10, max(score) filter (where i = floor(greatest(0.0::double, least(n * 0.05::double, n - 1)))) as t5, max(score) filter (where i = floor(greatest(0.0::double, least(n * 0.01::double, n - 1)))) as t1 from a group by {KEYS})
        select {KEYS}, round(avg((score <= t10)::int), 6) as at_10, round(avg((score <= t5)::int), 6) as at_5, round(avg((score <= t1)::int), 6) as at_1 from predictions join t using ({KEYS}) where label = 0 group by {KEYS}""",
    ),
    "f19_near_constant": (
        lambda spark, d: metrics.near_constant(predictions(spark, d), BY),
        b.PREDICTIONS + f", f as (select {KEYS}, arg_min(score, sample_id) as s0, min(score) as lo, max(score) as hi from predictions group by {KEYS}) select {KEYS}, greatest(hi - s0, s0 - lo) <= 1e-8 + 1e-5 * abs(s0) as constant from f",
    ),
    "f20_det_rates": (
        lambda spark, d: r6(curves.roc_curve(predictions(spark, d), BY).select(*BY, "point", "fpr", (1 - F.col("tpr")).alias("fnr")), "fpr", "fnr"),
        CURVE + f" select {KEYS}, k as point, round(fps::double / n, 6) as fpr, round(1 - tps::double / p, 6) as fnr from corners union all select distinct {KEYS}, 0, 0.0::double, 1.0::double from w",
    ),
    "f20_det_curve": (_det, DET),
    "f21_score_histogram": (
        lambda spark, d: r6(metrics.score_histogram(predictions(spark, d), ["model"]), "density"),
        b.PREDICTIONS + " select model, label, least(floor(score * 49), 48)::bigint as bin, count(*) as n, round(count(*) * 49.0::double / sum(count(*)) over (partition by model, label), 6) as density from predictions where score between 0 and 1 group by model, label, least(floor(score * 49), 48)",
    ),
    "f22_error_by_confidence": (
        lambda spark, d: r6(metrics.error_by_confidence(predictions(spark, d), ["model"]), "error_rate"),
        b.PREDICTIONS + """, f as (select model, floor(score * 10)::bigint as bin, count(*) as n, avg((case when score > 0.5 then 1 else 0 end <> label)::int) as e from predictions where score >= 0 and score < 1 group by 1, 2)
        select m.model, k.bin, coalesce(n, 0) as n, round(coalesce(e, 0), 6) as error_rate from (select distinct model from predictions) m cross join (select unnest(range(10))::bigint as bin) k left join f on f.model = m.model and f.bin = k.bin""",
    ),
    "f23_confidence_histograms": (
        lambda spark, d: r6(metrics.confidence_histograms(predictions(spark, d), ["model"]), "mean"),
        b.PREDICTIONS + """, q as (select model, case when (score > 0.5)::int = label then 'correct' else 'error' end as kind, greatest(score, 1 - score) as x, 30 as bins from predictions
          union all select model, case when score > 0.5 then 'false_positive' else 'false_negative' end, score, 20 from predictions where (score > 0.5)::int <> label)
        , r as (select model, kind, min(x) as low, max(x) as high, avg(x) as mean from q group by model, kind)
        select model, kind, coalesce(least(floor((x - low) / nullif(high - low, 0) * bins), bins - 1), 0)::bigint as bin, count(*) as n, round(max(mean), 6) as mean from q join r using (model, kind) group by 1, 2, 3""",
    ),
    "f24_confusion_normalized": (
        lambda spark, d: r6(metrics.confusion_normalized(predictions(spark, d), ["model", "tested_on"]), "share"),
        b.PREDICTIONS + """, t as (select model, tested_on, label as true_label, (score > 0.5)::int as predicted_label, count(*) as n from predictions group by all)
        select m.model, m.tested_on, a.l as true_label, p.l as predicted_label, coalesce(n, 0) as n, round(coalesce(n, 0)::double / greatest(sum(coalesce(n, 0)) over (partition by m.model, m.tested_on, a.l), 1), 6) as share
        from (select distinct model, tested_on from predictions) m cross join (select unnest([0, 1]) as l) a cross join (select unnest([0, 1]) as l) p left join t on t.model = m.model and t.tested_on = m.tested_on and t.true_label = a.l and t.predicted_label = p.l""",
    ),
    "f25_f26_prevalence_distribution": (
        lambda spark, d: r6(predictions(spark, d).groupBy("tested_on").agg(F.avg("label").alias("prevalence"), F.count_if(F.col("label") == 0).alias("bonafide"), F.count_if(F.col("label") == 1).alias("attack")), "prevalence"),
        b.PREDICTIONS + " select tested_on, round(avg(label), 6) as prevalence, count(*) filter (where label = 0) as bonafide, count(*) filter (where label = 1) as attack from predictions group by tested_on",
    ),
    "f27_flattened_cell_metrics": (
        lambda spark, d: r6(metrics.flattened_cell_metrics(predictions(spark, d), ["model"]), "precision", "recall", "auc"),
        b.PREDICTIONS + """, q as (select model, label = 1 as y, score as p from predictions union all select model, label = 0, 1 - score from predictions)
        , k as (select model, case when p > 0 then 1 + least(ceil(p * 199) - 1, 198) else 1 end as b, count(*) filter (where y) as yes, count(*) filter (where not y) as no, count(*) filter (where y and p > 0.5) as tp, count(*) filter (where not y and p > 0.5) as fp from q group by 1, 2)
        , c as (select *, sum(yes) over (partition by model order by b desc) as cy from k)
        select model, sum(tp)::bigint as tp, sum(fp)::bigint as fp, (sum(yes) - sum(tp))::bigint as fn, (sum(no) - sum(fp))::bigint as tn, round(sum(tp)::double / greatest(sum(tp) + sum(fp), 1), 6) as precision, round(sum(tp)::double / greatest(sum(yes), 1), 6) as recall,
          round(sum(no * (2 * cy - yes) / 2.0::double) / (sum(yes)::double * sum(no)), 6) as auc from c group by model""",
    ),
    "f28_weighted_cross_entropy": (_weighted_loss, WEIGHTED_LOSS),
    "f28_cross_entropy": (
        lambda spark, d: r6(metrics.cross_entropy(predictions(spark, d), BY, smoothing=0.1), "loss"),
        b.PREDICTIONS + f" select {KEYS}, round(avg(-((label * 0.9::double + 0.05::double) * ln(greatest(least(score, 1 - 1e-7), 1e-7)) + (1 - (label * 0.9::double + 0.05::double)) * ln(greatest(least(1 - score, 1 - 1e-7), 1e-7)))), 6) as loss from predictions group by {KEYS}",
    ),
    "e09_score_profile": (
        lambda spark, d: r6(metrics.score_profile(predictions(spark, d), ["model"]).drop("counts"), "low", "high"),
        b.PREDICTIONS + " select model, round(min(score), 6) as low, round(max(score), 6) as high, count(distinct round(score, 6)) as distinct, count(distinct round(score, 6)) <= 3 as near_constant from predictions group by model",
    ),
    "b16_b17_decisions": (_decisions, DECISIONS),
}
