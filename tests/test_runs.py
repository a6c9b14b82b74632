"""Replays of training runs and model grids."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.ml.classification import LogisticRegression

from samplekit.operators import mlgrid, runs, sampling
from samplekit.plans import files
from samplekit.sources import scan, sinks
from samplekit.sources.shared import shared_folder

DATA = "/root/testdata/sf0.001"


def logs(spark, losses):
    return spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(losses)], "run_id string, epoch long, val_loss double")


def test_early_stop_and_plateau(spark):
    df = logs(spark, [5, 4, 4, 4, 3, 3, 3, 3])
    r = runs.early_stop(df, 3).first()
    assert (r.stopped_epoch, r.best_epoch, r.best_value) == (7, 4, 3)
    assert runs.early_stop(df, 9).first().stopped_epoch is None
    rates = [x.lr for x in runs.plateau_replay(df, initial=1.0, factor=0.5, patience=2, least=0.3).orderBy("epoch").collect()]
    assert rates == [1, 1, 1, 0.5, 0.5, 0.5, 0.3, 0.3]


def test_best_trial_counts_failures_as_infinite(spark):
    df = spark.createDataFrame([(0, None, {}, "FAIL"), (1, 0.5, {"lr": "1"}, "COMPLETE"), (2, float("nan"), {}, "COMPLETE"), (3, 0.1, {}, "FAIL")], "number int, value double, params map<string, string>, state string")
    assert runs.best_trial(df).first().number == 1
    assert runs.best_trial(df.where("number > 9")).count() == 0


def test_catalog_of_runs(spark):
    paths = ["r/beta_1_own_set/checkpoints/best_model.h5", "r/x_y/checkpoints/x_y/note.txt", "r/x_y/checkpoints/a.h5", "r/p_q/checkpoints/a.keras", "r/p_q/checkpoints/b.h5"]
    got = {(r.model, r.dataset, r.path) for r in runs.run_catalog(spark.createDataFrame([(p,) for p in paths], "path string"), ["beta_1"]).collect()}
    assert got == {("beta_1", "own_set", paths[0]), ("p", "q", paths[4])}


def test_empty_runs(spark):
    df = spark.createDataFrame([], "job_key string, success boolean, training_time double, accuracy double, dataset string")
    assert runs.job_summary(df).first().success_rate == 0 and runs.training_time(df).first().total == 0
    assert runs.best_runs(df, ["dataset"]).count() == 0


def test_grid_of_models(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 3 == 0, float(i % 3 == 0) * 50 + i % 7, float(i % 11), 100.0, 90.0) for i in range(200)], "sample_id long, dataset string, y boolean, sharpness double, contrast double, mean_brightness double, blur_score double").selectExpr("*", "cast(y as int) as label").drop("y")
    rows = sampling.stratified_split(df, 0.8, by=["dataset"])
    fitted = mlgrid.train_grid(rows, {"logistic": mlgrid.estimators()["logistic"]}, ["a", "b"])
    scores = mlgrid.score_matrix(fitted, rows)
    assert scores.count() == 2 * rows.where("split = 'test'").count()
    assert scores.where("(score > 0.5) <> (label = 1)").count() == 0
    assert shared_folder(spark) != shared_folder(spark)


def planted(spark, n=240):
    """Labels that a product of two values tells, which a line can't follow and a tree of two levels can."""
    rows = [(i, float(i % 7 - 3 or 1) * 10, float(i % 11 - 5 or 1) * 10, float(i % 5), float(i % 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id long, sharpness double, contrast double, mean_brightness double, blur_score double")
    return df.selectExpr("*", "cast(sharpness * contrast > 0 as int) as label").repartition(3)


def test_search_by_successive_halving(spark):
    df = planted(spark)
    space = {"logistic": {"regParam": ("log", 0.01, 1.0)}, "forest": {"numTrees": ("int", 3, 8), "maxDepth": ("choice", 4, 6)}, "broken": {"maxIter": ("int", -9, -5)}}
    models = {**mlgrid.estimators(), "broken": mlgrid.estimators()["logistic"]}
    found = mlgrid.search(df, space, trials=6, rungs=2, k=2, models=models)
    rows = found.orderBy("number").collect()
    assert [r.number for r in rows] == list(range(6))
    assert {r.state for r in rows if r.estimator == "broken"} == {"FAIL"} and all(r.value == math.inf for r in rows if r.estimator == "broken")
    last = [r for r in rows if r.state == "COMPLETE"]
    assert len(last) == 2 and {r.rung for r in last} == {1} and {r.rows for r in last} == {240}
    assert all(100 < r.rows < 140 for r in rows if r.rung == 0)
    best = runs.best_trial(found).first()
    assert rows[best.number].estimator == "forest" and best.value == min(r.value for r in last) < 0.6
    assert set(rows[best.number].params) == {"numTrees", "maxDepth"}


def test_trials_are_drawn_within_bounds():
    trials = mlgrid.draw_trials(mlgrid.SPACE, 40, 7)
    assert trials == mlgrid.draw_trials(mlgrid.SPACE, 40, 7) != mlgrid.draw_trials(mlgrid.SPACE, 40, 8)
    for t in trials:
        for name, (kind, *values) in mlgrid.SPACE[t.estimator].items():
            x = t.params[name]
            assert x in values if kind == "choice" else values[0] <= x <= values[1]
    small = sum(t.params["regParam"] < 1e-3 for t in trials if t.estimator == "logistic")
    assert 3 < small < 17


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_grid_reads_the_split_that_was_written(spark, monkeypatch):
    monkeypatch.setattr(mlgrid, "estimators", lambda: {"logistic": LogisticRegression(weightCol="class_weight", maxIter=2)})
    scores = files.grid_scores(spark, DATA)
    assert {r.trained_on for r in scores.select("trained_on").distinct().collect()} == {f"ds{k}" for k in range(5)}
    assert scores.inputFiles() and not [f for f in scores.inputFiles() if "events.parquet" in f]  # each fit and score would rank all events again


def test_logs_of_many_runs_are_few_files(spark):
    path = shared_folder(spark)
    logs = spark.range(0, 2000, 1, 4).selectExpr("format_string('%03d', id div 4) as run_id", "id % 4 as epoch", "id / 8 as loss")
    sinks.write_epoch_logs(logs, path, ["loss"])
    found = scan.read_epoch_logs(spark, path, ["loss"], run_column=True)
    assert len(found.inputFiles()) <= 4  # not one for each of the 500 runs
    assert {tuple(r) for r in found.collect()} == {(f"{i // 4:03d}", i % 4, i / 8) for i in range(2000)}


def test_predictions_are_written_as_they_come(spark):
    path = shared_folder(spark)
    df = spark.range(0, 400, 1, 2).selectExpr("concat('m', id % 4) as model", "concat('ds', id % 5) as tested_on", "cast(id % 2 as int) as label", "id / 400 as score")
    sinks.write_predictions(df, path)
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = done.apply(done.size() - 1).physicalPlanDescription()
    assert "InsertIntoHadoopFsRelationCommand" in plan and "Sort" not in plan  # a task would hold all of its rows
    assert spark.read.option("header", True).csv(path).groupBy("model", "tested_on").count().where("count = 20").count() == 20
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"


def test_fits_leave_rows_where_they_are(spark, monkeypatch):
    small = []
    weigh = mlgrid.stats.with_class_weight
    monkeypatch.setattr(mlgrid.stats, "with_class_weight", lambda *a, **k: small.append(weigh(*a, **k)) or small[-1])
    mlgrid.search(planted(spark, 60), {"logistic": {"maxIter": ("int", 2, 3)}}, trials=1, rungs=1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [df._jdf.queryExecution().sparkPlan().toString() for df in small]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)  # only a row for each class moves
