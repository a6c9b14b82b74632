"""Frames by quality, mixtures by weight, balance over time, sessions and normalisation, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from samplekit.operators import features, runs, sampling


def test_best_frames(spark):
    r = random.Random(1)
    rows = [(v, f, round(r.random(), 1)) for v, n in (("a", 400), ("b", 30), ("c", 1)) for f in r.sample(range(600), n)] + [("d", 5, None), (None, 3, 0.5)]
    got = sampling.best_frames(spark.createDataFrame(rows, "video_id string, frame long, quality double").repartition(3), 8, 25).collect()
    for video in {v for v, *_ in rows}:
        taken: list[int] = []
        for _, f, _ in sorted((x for x in rows if x[0] == video and x[2] is not None), key=lambda x: (-x[2], x[1])):
            if len(taken) < 8 and all(abs(f - t) >= 25 for t in taken):
                taken.append(f)
        assert [x.frame for x in sorted((x for x in got if x.video_id == video), key=lambda x: x.place)] == taken


def _level(rows, total):
    """Shares by halving the level."""
    low, high = 0.0, max(h / w for _, w, _, h in rows)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(h, max(a, w * mid)) for _, w, a, h in rows) < total else (low, mid)
    return {s: min(h, max(a, w * high)) for s, w, a, h in rows}


@pytest.mark.parametrize("seed", range(3))
def test_apportionment(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(r.randint(1, 9)):
        low = r.randint(0, 40)
        rows.append((f"s{k}", r.choice([0.5, 1.0, 1.0, 2.0, 7.3]), low, low + r.randint(0, 200)))
    least, most = sum(x[2] for x in rows), sum(x[3] for x in rows)
    df = spark.createDataFrame(rows, "dataset string, weight double, least long, most long")
    for total in {least, most, (least + most) // 2, least + 1, max(0, least - 9), most + 50, (2 * least + most) // 3}:
        got = {x.dataset: x.target for x in sampling.apportion(df, total).collect()}
        goal = min(most, max(least, total))
        assert sum(got.values()) == goal
        exact = _level(rows, goal)
        for s, _, a, h in rows:
            assert a <= got[s] <= h and abs(got[s] - exact[s]) < 1 + 1e-4


def test_mixtures(spark):
    df = spark.createDataFrame([(i, "abc"[min(i // 100, 2)], i % 2, 0.3 + 0.3 * (i < 100)) for i in range(600)], "sample_id long, dataset string, label int, quality double")
    of = lambda **how: {r.dataset: r.target for r in sampling.weighted_targets(df, 240, **how).collect()}
    assert of() == {"a": 80, "b": 80, "c": 80}
    assert of(weights="quality_based") == {"a": 100, "b": 70, "c": 70}
    assert of(weights={"c": 2.0}) == {"a": 60, "b": 60, "c": 120}
    assert of(weights={"a": 4.0}, upsample=2.0) == {"a": 160, "b": 40, "c": 40}
    rows = sampling.resample_to(df, sampling.weighted_targets(df, 240), by=["dataset"])
    assert rows.count() == 240
    with pytest.raises(ValueError, match="weights"):
        sampling.weighted_targets(df, 1, "odd")


def test_balance_over_time(spark):
    df = spark.createDataFrame([(i, int(i >= 90), 1_700_000_000 + 7 * (i % 90)) for i in range(100)], "sample_id long, label int, s long").selectExpr("*", "timestamp_seconds(s) as ts")
    got = sampling.balance_by_time(df)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 10, 1: 10}
    places = sorted(r.sample_id for r in got.where("label = 0").collect())
    assert all(7 <= b - a <= 11 for a, b in zip(places, places[1:]))


def test_sessions(spark):
    r = random.Random(4)
    times = {g: sorted(r.randrange(0, 60_000) for _ in range(n)) for g, n in ((1, 200), (2, 7), (3, 1))}
    rows = [(g, t) for g, own in times.items() for t in own] + [(4, None)]
    df = spark.createDataFrame(rows, "group_id int, s long").selectExpr("*", "timestamp_seconds(1700000000 + s) as ts").repartition(3)
    got = sampling.session_split(df, "10 minutes", 1)
    assert got.count() == len(rows) and sampling.leak_report(got.where("session is not null"), "session", by=["group_id"]).count() == 0
    found = {(x.group_id, x.s): (x.session, x.split) for x in got.collect()}
    for g, own in times.items():
        session, last, number = 0, None, {}
        for t in own:
            session += last is None or t - last > 600
            number[t] = session
            last = t
        for t in own:
            assert found[g, t] == (number[t], "test" if number[t] == session > 1 else "train")
    assert found[4, None] == (None, "train")


def test_normalisation(spark):
    images = np.random.default_rng(2).integers(0, 256, (30, 12)).astype(float)
    images[:, 5] = 9
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(images)] + [(99, None)], "sample_id long, pixels array<double>").repartition(4)
    with np.errstate(invalid="ignore", divide="ignore"):
        wanted = {
            "per_image": (images - images.mean(1, keepdims=True)) / images.std(1, keepdims=True), "global": (images - images.mean()) / images.std(),
            "standardize": np.nan_to_num((images - images.mean(0)) / images.std(0)), "min_max": np.nan_to_num((images - images.min(0)) / (images.max(0) - images.min(0))),
        }
    for method, want in wanted.items():
        got = {r.sample_id: r.pixels for r in features.normalised(df, method).collect()}
        assert got.pop(99) is None and np.array([got[i] for i in range(30)]) == pytest.approx(want)


def test_a_run_of_a_third_of_all_epochs(spark):
    """The best epoch of a long run comes from an aggregate; ties go to the first, and a run without values has its first epoch."""
    df = spark.range(3000).selectExpr("if(id < 1000, 0, id) as run_id", "if(id < 1000, id, 0) as epoch", "cast(1 as double) as loss", "if(id % 7 = 3, 0.5D, 1.0D) as val_loss").unionByName(spark.createDataFrame([(-1, 0, 1.0, None), (-1, 1, 1.0, None)], "run_id long, epoch long, loss double, val_loss double"))
    gap = runs.generalisation_gap(df, ["loss"])
    assert gap.count() == 3002
    assert {(r.run_id, r.epoch) for r in gap.where("best and run_id <= 0").collect()} == {(0, 3), (-1, 0)}
    assert "Window" not in gap._jdf.queryExecution().executedPlan().toString()
