"""Exact ranks and running sums by parts: even parts on skewed values, and the same rows as one window over a group."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from samplekit.functions.hashing import hash_key, with_hash_rank
from samplekit.operators import curves, sampling


def scored(spark, rows):
    return spark.createDataFrame([(g, i, y, s) for i, (g, y, s) in enumerate(rows)], "g string, sample_id long, label int, score double").repartition(4)


def area(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def odd_values(r, n):
    """Log odds with outliers and infinities on both ends."""
    return [r.choice([0, 1]) for _ in range(n)], [r.gauss(0, 1) for _ in range(n - 4)] + [1e300, -1e12, math.inf, -math.inf]


def test_an_outlier_leaves_parts_even(spark):
    labels, scores = odd_values(random.Random(1), 6000)
    df = scored(spark, [("a", y, s) for y, s in zip(labels, scores, strict=True)] + [("b", y, s * 1e-9) for y, s in zip(labels, scores, strict=True)])
    sizes = [r["count"] for r in curves.placed_counts(df, ["g"], parts=64).groupBy("g", "__part").count().collect()]
    assert sum(sizes) == 12_000 and max(sizes) < 4 * 6000 / 64


@pytest.mark.parametrize("parts", [64, 256])
def test_curves_of_odd_scores(spark, parts):
    labels, scores = odd_values(random.Random(2), 300)
    rows = list(zip(labels, scores, strict=True))
    df = scored(spark, [("a", y, s) for y, s in rows] + [(None, y, round(s, 1)) for y, s in rows])
    got = {r.g: r.roc_auc for r in curves.roc_auc(df, ["g"]).collect()}
    assert got["a"] == pytest.approx(area(rows)) and got[None] == pytest.approx(area([(y, round(s, 1)) for y, s in rows]))
    points = curves.cumulative_counts(df.where("g is null"), ["g"], parts=parts).orderBy("rank").collect()
    assert [p["rank"] for p in points] == list(range(1, len(points) + 1))
    for p in points:
        above = [y for y, s in rows if round(s, 1) >= p.score]
        assert (p.tps, p.fps) == (sum(above), len(above) - sum(above))


@pytest.mark.parametrize("scores", [[0.5] * 4, [0.5, 0.5 + 1e-9, 0.5 + 2e-9, 0.5], [1e6, 1e6 + 9, 1e6, 1e6 + 3], [math.inf] * 4])
def test_nearly_constant_scores_have_no_curve(spark, scores):
    df = scored(spark, [("g", y, s) for y, s in zip((0, 1, 1, 0), scores, strict=True)])
    out = curves.curve_metrics(df, ["g"]).first()
    assert (out.roc_auc, out.average_precision, out.eer, out.eer_threshold) == (None, None, None, None)
    assert curves.roc_auc(df, ["g"]).first().roc_auc is None and curves.average_precision(df, ["g"]).first().average_precision is None
    assert set(curves.bpcer_at_apcer(df, ["g"]).first().bpcer_at_apcer.values()) == {0.0}
    assert set(curves.biometric_points(df, ["g"], (0.1,)).first().bpcer_at_apcer.values()) == {0.0}


def test_scores_just_apart_have_one(spark):
    df = scored(spark, [("g", y, 0.5 + k * 1e-5) for k, y in enumerate((0, 1, 0, 1))])
    assert curves.roc_auc(df, ["g"]).first().roc_auc == 0.75
    assert curves.average_precision(df, ["g"]).first().average_precision is not None


@pytest.mark.parametrize("rows", [10, 1 << 17])
def test_hash_order(spark, rows):
    df = spark.createDataFrame([(i, ("a", None)[i % 7 == 0]) for i in range(500)], "sample_id long, g string")
    ranked = with_hash_rank(df, 7, "sample_id", ["g"], rows=rows)
    plain = df.withColumn("plain", F.row_number().over(Window.partitionBy("g").orderBy(hash_key(7, "sample_id"), "sample_id")))
    assert ranked.join(plain, "sample_id").where("hash_rank <> plain").isEmpty() and ranked.count() == 500
    assert sorted(r.hash_rank for r in with_hash_rank(df, 7, "sample_id", rows=rows).collect()) == list(range(1, 501))


def test_ranks_of_ties_by_text_keys(spark):
    """Most rows have one value: they are cut by the bytes behind what their keys have in common."""
    r = random.Random(4)
    rows = [(f"s3://bucket/é/img_{k:05d}.png", g, 0.5 if r.random() < 0.8 else r.random()) for k in range(1500) for g in ("a",)] + [(None, "a", 0.5), ("x", "b", None), ("", "b", 1.0)]
    df = spark.createDataFrame(rows, "name string, g string, quality double").repartition(4)
    plain = df.withColumn("plain", F.row_number().over(Window.partitionBy("g").orderBy(F.desc_nulls_last("quality"), "name")))
    ranked = sampling.with_exact_rank(df, ["g"], "quality", "name")
    assert ranked.join(plain.select("name", "g", "plain"), [ranked.name.eqNullSafe(plain.name), ranked.g == plain.g]).where("rank <> plain").isEmpty()
    assert ranked.count() == len(rows)
    long = spark.createDataFrame([(k, (1 << 60) + k // 2) for k in range(400)], "key long, value long")
    assert sampling.with_exact_rank(long, [], "value", "key").where("rank <> 400 - key + if(key % 2 = 0, -1, 1)").isEmpty()
