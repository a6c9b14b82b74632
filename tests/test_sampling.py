"""Exact sizes, disjoint and complete splits, and independence of the partitioning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from samplekit.operators import combine, sampling, stats


def rows(spark, sizes, groups=7):
    data, k = [], 0
    for name, n in sizes.items():
        for i in range(n):
            data.append((k, name, int(i % 5 < 2), i % groups, (k * 37 % 101) / 101))
            k += 1
    return spark.createDataFrame(data, "sample_id long, dataset string, label int, group_id long, quality double")


def test_frames_of_videos(spark):
    sizes = [9, 10, 30, 40, 67, 100, 1000]
    found = sampling.sample_frames(spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "video_id long, total_frames long")).groupBy("total_frames").agg(F.sort_array(F.collect_list("frame")).alias("f"))
    got = {r.total_frames: r.f for r in found.collect()}
    assert got == {10: [5], 30: [15], 40: list(range(15, 25)), 67: list(range(15, 35)), 100: list(range(15, 75, 3)), 1000: list(range(150, 850, 35))}


def test_published_sizes_combine_to_their_total(spark):
    sizes = {"a": 2620, "b": 3440, "c": 1568, "d": 5000, "e": 2040}
    df = sampling.stratified_split(rows(spark, sizes), 0.8, by=["dataset"])
    counts = {(r.dataset, r.split): r["count"] for r in df.groupBy("dataset", "split").count().collect()}
    assert [counts[s, "train"] for s in sizes] == [2096, 2752, 1254, 4000, 1632]
    both = sampling.balance_sources(df, by=["split"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in both} == {"train": 10480, "test": 2620}


@pytest.mark.parametrize("target", [1, 7, 20, 53])
def test_resampling_hits_its_target(spark, target):
    df = rows(spark, {"a": 20, "b": 3})
    targets = spark.createDataFrame([("a", target), ("b", target)], "dataset string, target long")
    out = sampling.resample_to(df, targets, by=["dataset"])
    assert {r.dataset: r["count"] for r in out.groupBy("dataset").count().collect()} == {"a": target, "b": target}
    assert out.groupBy("sample_id", "replica_no").count().where("count > 1").count() == 0


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = rows(spark, {"a": 90, "b": 41})
    for f in (lambda d: sampling.shuffle(d), lambda d: sampling.stratified_split(d, 0.8, by=["dataset"]), lambda d: sampling.group_split(d, by=["dataset"]), lambda d: sampling.random_split(d), lambda d: sampling.balance_sources(d)):
        assert sorted(map(tuple, f(df.repartition(parts)).collect())) == sorted(map(tuple, f(df).collect()))


def test_splits_are_complete_and_groups_stay_whole(spark):
    df = rows(spark, {"a": 100, "b": 60})
    out = sampling.group_split(df, by=["dataset"], share=0.3)
    assert out.count() == 160 and sampling.leak_report(out, by=["dataset"]).count() == 0
    val = out.where("split = 'val'").select("dataset", "group_id").distinct().groupBy("dataset").count().collect()
    assert {r.dataset: r["count"] for r in val} == {"a": 2, "b": 2}
    assert sampling.random_split(df, 0.15).where("split = 'val'").count() == 24
    with pytest.raises(ValueError):
        sampling.random_split(df, 1.5)


def test_balancing_takes_the_best_of_the_larger_class(spark):
    df = rows(spark, {"a": 50})
    out = sampling.balance_by_quality(df)
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0: 20, 1: 20}
    best = sorted((r.quality for r in df.where("label = 0").collect()), reverse=True)[:20]
    assert sorted((r.quality for r in out.where("label = 0").collect()), reverse=True) == best
    assert sampling.balance_by_quality(df.where("label = 0")).count() == 30
    assert sampling.balance_by_quality(df, enabled=False).count() == 50


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "label int")
    got = {r.label: (r.raw_weight, r.weight) for r in stats.class_weights(df).collect()}
    assert got == {0: (0.625, 0.25), 1: (2.5, 1.0)}
    assert {r.label: r.share for r in stats.class_distribution(df).collect()} == {0: 0.8, 1: 0.2}


def test_empty_table(spark):
    df = rows(spark, {"a": 3}).where("sample_id < 0")
    for f in (sampling.shuffle, sampling.balance_by_quality, sampling.balance_sources, sampling.stratified_split, sampling.group_split, sampling.random_split, lambda d: sampling.with_batches(d, 4)):
        assert f(df).count() == 0


def test_combinations(spark):
    df = rows(spark, {"a": 10, "b": 20, "c": 30})
    out = combine.combine(df, combine.leave_one_out(df)).groupBy("combo", "dataset").count().collect()
    assert {(r.combo, r.dataset): r["count"] for r in out} == {("combined_without_a", "b"): 25, ("combined_without_a", "c"): 25, ("combined_without_b", "a"): 20, ("combined_without_b", "c"): 20, ("combined_without_c", "a"): 15, ("combined_without_c", "b"): 15}
