"""Hand-worked values of the evaluation operators, and what must hold for any scores."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samplekit.functions import normal
from samplekit.operators import compare, curves, metrics


def scored(spark, rows):
    return spark.createDataFrame([("g", i, y, s) for i, (y, s) in enumerate(rows)], "g string, sample_id long, label int, score double")


FOUR = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]
TIED = [(y, s) for s in (0.9, 0.7, 0.4, 0.2) for y in (0, 1)]


def test_four_scores(spark):
    df = scored(spark, FOUR)
    roc = sorted((r.point, r.fpr, r.tpr, r.threshold) for r in curves.roc_curve(df, ["g"]).collect())
    assert [r[1:3] for r in roc] == [(0, 0), (0, 0.5), (0.5, 0.5), (0.5, 1), (1, 1)]
    assert [r[3] for r in roc] == [None, 0.8, 0.4, 0.35, 0.1]
    assert curves.roc_auc(df, ["g"]).first().roc_auc == 0.75
    assert curves.average_precision(df, ["g"]).first().average_precision == pytest.approx(0.833333, abs=1e-6)
    eer = curves.equal_error(df, ["g"]).first()
    assert (eer.eer, eer.eer_threshold) == (0.5, 0.4)
    assert set(curves.bpcer_at_apcer(df, ["g"]).first().bpcer_at_apcer.values()) == {0.5}
    assert set(curves.bpcer_at_apcer(df, ["g"], iso=True).first().bpcer_at_apcer.values()) == {0.5}
    m = metrics.with_error_rates(metrics.standard_metrics(df, ["g"])).first()
    assert (m.tp, m.fn, m.tn, m.fp) == (1, 1, 2, 0)
    for name, value in {"accuracy": 0.75, "precision": 1, "recall": 0.5, "specificity": 1, "f1_score": 0.666667, "mcc": 0.57735, "cohen_kappa": 0.5, "balanced_accuracy": 0.75, "apcer": 0.5, "bpcer": 0, "acer": 0.25, "far": 0, "frr": 0.5, "hter": 0.25}.items():
        assert m[name] == pytest.approx(value, abs=1e-5), name


def test_equal_error_is_chosen_among_corners(spark):
    df = scored(spark, TIED)
    roc = sorted((r.point, r.threshold) for r in curves.roc_curve(df, ["g"]).collect())
    assert [t for _, t in roc] == [None, 0.9, 0.2]
    assert tuple(curves.equal_error(df, ["g"]).first()[1:]) == (0.5, 0.9)
    assert tuple(curves.equal_error(df, ["g"], drop_intermediate=False).first()[1:]) == (0.5, 0.7)
    assert curves.roc_auc(df, ["g"]).first().roc_auc == 0.5


def test_separable(spark):
    df = scored(spark, [(0, 0.2), (1, 0.9), (1, 0.9)])
    assert curves.roc_auc(df, ["g"]).first().roc_auc == 1
    assert curves.average_precision(df, ["g"]).first().average_precision == 1
    assert tuple(curves.equal_error(df, ["g"]).first()[1:]) == (0, 0.9)


@pytest.mark.parametrize("rows", [[(1, 0.3), (1, 0.6)], [(0, 0.3), (0, 0.6)], [(0, 0.5), (1, 0.5)]])
def test_degenerate_groups_have_no_area(spark, rows):
    df = scored(spark, rows)
    assert curves.roc_auc(df, ["g"]).first().roc_auc is None
    assert curves.equal_error(df, ["g"]).first().eer is None
    out = metrics.biometric_metrics(df, ["g"]).first()
    assert not math.isnan(out.acer)
    if len({y for y, _ in rows}) == 1:
        assert set(out.bpcer_at_apcer.values()) == {0.0}


def test_empty_and_null_scores(spark):
    empty = spark.createDataFrame([], "g string, sample_id long, label int, score double")
    for f in (curves.roc_curve, curves.roc_auc, curves.pr_curve, curves.average_precision, curves.equal_error, metrics.standard_metrics, metrics.classification_report):
        assert f(empty, ["g"]).count() == 0
    df = spark.createDataFrame([("g", 0, 1, None), ("g", 1, None, 0.5), ("g", 2, 1, float("nan")), *(("g", 3 + i, y, s) for i, (y, s) in enumerate(FOUR))], "g string, sample_id long, label int, score double")
    assert curves.roc_auc(df, ["g"]).first().roc_auc == 0.75


def test_edges_of_bins(spark):
    df = scored(spark, [(0, 0.5), (1, 1.0), (0, 0.0)])
    assert metrics.confusion(df, ["g"]).first().fp == 0
    assert metrics.error_by_confidence(df, ["g"]).agg(F.sum("n")).first()[0] == 2
    assert {r.bin for r in metrics.score_histogram(df, ["g"]).where("label = 1").collect()} == {48}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=4, max_size=60))
def test_area_is_the_rank_statistic(spark, rows):
    df = scored(spark, [(y, s / 20) for y, s in rows])
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    got = curves.roc_auc(df.repartition(3), ["g"]).first().roc_auc
    if pos and neg and len({s for _, s in rows}) > 1:
        assert got == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
        assert curves.roc_auc(df.withColumn("score", F.exp("score")), ["g"]).first().roc_auc == pytest.approx(got)
        m = metrics.with_error_rates(metrics.confusion(df, ["g"])).first()
        assert m.hter == pytest.approx(m.acer)
    else:
        assert got is None


def test_significance(spark):
    values = {"a": (0.9, 0.8, 0.85), "b": (0.7, 0.75, 0.6), "c": (0.5, 0.55, 0.6)}
    df = spark.createDataFrame([(m, x) for m, xs in values.items() for x in xs], "model string, accuracy double")
    f = compare.anova(df).first()
    assert (f.f, f.df1, f.df2) == (pytest.approx(18.769231, abs=1e-6), 2, 6)
    assert f.p == pytest.approx(0.002617, abs=1e-5)
    t = compare.pairwise_ttest(df).where("a = 'a' and b = 'b'").first()
    assert (t.t, t.df) == (pytest.approx(3.162278, abs=1e-6), 4)
    two = df.where("model <> 'c'")
    d = compare.cohens_d(two).first()
    assert (d.d, d.size) == (pytest.approx(3.162278, abs=1e-6), "large")
    assert compare.anova(two).count() == 0 and compare.cohens_d(df).count() == 0


def test_tail_probabilities(spark):
    """Closed forms: two degrees above, two below, one and one; and the symmetry of the beta function."""
    rows = [(f, d) for f in (0.01, 0.5, 1.0, 3.7, 40.0, 1e4) for d in (1, 2, 5, 30, 1000, 200000)]
    df = spark.createDataFrame(rows, "f double, d int")
    tail = normal.f_tail
    for r in df.select("f", "d", tail(F.col("f"), F.lit(2), F.col("d")).alias("two"), tail(F.col("f"), F.col("d"), F.lit(2)).alias("below"), tail(F.col("f"), F.lit(1), F.lit(1)).alias("one"), tail(F.col("f"), F.col("d"), F.lit(7)).alias("a"), tail(1 / F.col("f"), F.lit(7), F.col("d")).alias("z")).collect():
        assert r.two == pytest.approx((1 + 2 * r.f / r.d) ** (-r.d / 2), rel=1e-8, abs=1e-300)
        assert r.below == pytest.approx(1 - (r.d * r.f / (2 + r.d * r.f)) ** (r.d / 2), rel=1e-7)
        assert r.one == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(r.f)), rel=1e-8)
        assert r.a + r.z == pytest.approx(1, abs=1e-9)
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (1.0, 0.0), (0.0, 3.0)], "f double, d double").select(tail(F.col("f"), F.lit(2), F.col("d")).alias("p"))
    assert [r.p for r in odd.collect()] == [None, None, None, 1.0]
    gammas = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 7.5, 1e3, 1e6)], "x double").select("x", normal.log_gamma(F.col("x")).alias("y"))
    assert all(r.y == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in gammas.collect())


def test_ranking_skips_nan(spark):
    df = spark.createDataFrame([("a", "x", "x", float("nan"), 0.5), ("b", "x", "y", 0.2, 0.6)], "model string, trained_on string, tested_on string, eer double, accuracy double")
    best = {r.metric: (r.model, r.value) for r in compare.best_by(df, {"eer": "min", "accuracy": "max"}, ["model", "tested_on"]).collect()}
    assert best == {"eer": ("b", 0.2), "accuracy": ("b", 0.6)}


def test_confidence_histograms_count_scores_before_they_meet_their_ranges(spark):
    rows = [("a", s, y) for s, y, n in ((0.9, 1, 300), (0.7, 1, 100), (0.8, 0, 2), (0.2, 1, 1), (None, 1, 5)) for _ in range(n)]
    found = metrics.confidence_histograms(spark.createDataFrame(rows, "model string, score double, label int"), ["model"])
    got = {(r.kind, r.bin): (r.n, round(r["mean"], 9)) for r in found.collect()}
    assert got == {("correct", 0): (100, 0.85), ("correct", 29): (300, 0.85), ("error", 29): (8, 0.8), ("false_positive", 19): (2, 0.8), ("false_negative", 19): (1, 0.2)}
    plan = [line.strip(" :+-") for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    below = [next(x for x in plan[i + 1 :] if not x.startswith(("Project", "Filter"))) for i, x in enumerate(plan) if x.startswith("Generate")]
    assert below and all(x.startswith("Aggregate") for x in below)  # a join of the rows themselves may broadcast them all
