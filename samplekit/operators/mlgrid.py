"""Grids of models over sources, with Spark ML: fitting with class weights, scoring everywhere, and search for settings by successive halving."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Model
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplekit.functions.hashing import hash_uniform
from samplekit.operators import metrics, stats

FEATURES = ("sharpness", "contrast", "mean_brightness", "blur_score")


def estimators(seed: int = 42) -> dict[str, Estimator]:
    """Named estimators of a grid; those that can take class weights do."""
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "logistic": LogisticRegression(weightCol="class_weight", maxIter=30, **common),
        "forest": RandomForestClassifier(weightCol="class_weight", numTrees=20, maxDepth=5, seed=seed, **common),
        "perceptron": MultilayerPerceptronClassifier(layers=[len(FEATURES), 8, 2], maxIter=40, seed=seed, **common),
    }


def with_features(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


def train_grid(df: DataFrame, models: dict[str, Estimator], sources: list[str], *, source: str = "dataset", jobs: int = 4) -> dict[tuple[str, str], Model]:
    """A fitted model for each estimator and source. df has split: rows of "train" are fitted on. Each fit is a distributed job that reads df several times, so df should be a
    written table; `jobs` of them are under way at once."""
    weighted = with_features(stats.with_class_weight(df.where("split = 'train'"), [source], small=True))

    def fit(cell: tuple[str, str]) -> Model:
        name, s = cell
        return models[name].fit(weighted.where(F.col(source) == s))

    cells = [(name, s) for s in sources for name in models]
    with ThreadPoolExecutor(jobs) as pool:
        return dict(zip(cells, pool.map(inheritable_thread_target(df.sparkSession)(fit), cells), strict=True))


def score_matrix(fitted: dict[tuple[str, str], Model], df: DataFrame, *, source: str = "dataset") -> DataFrame:
    """model, trained_on, tested_on, sample_id, label, score of every model on the test rows of every source."""
    rows = with_features(df.where("split = 'test'"))
    parts = [m.transform(rows).select(F.lit(name).alias("model"), F.lit(s).alias("trained_on"), F.col(source).alias("tested_on"), "sample_id", "label", vector_to_array("probability")[1].alias("score")) for (name, s), m in fitted.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: What a search draws from, by estimator: bounds of a number ("log": evenly in its logarithm; "int": whole), or a list to choose from.
SPACE: dict[str, dict[str, tuple]] = {
    "logistic": {"regParam": ("log", 1e-5, 1.0), "elasticNetParam": ("float", 0.0, 1.0), "maxIter": ("int", 5, 40), "standardization": ("choice", True, False)},
    "forest": {"numTrees": ("int", 5, 30), "maxDepth": ("int", 2, 8), "featureSubsetStrategy": ("choice", "sqrt", "all", "onethird")},
}


@dataclass(frozen=True)
class Trial:
    number: int
    estimator: str
    params: dict[str, object]


def _drawn(r: random.Random, kind: str, *values: object) -> object:
    if kind == "choice":
        return r.choice(values)
    low, high = values
    if kind == "int":
        return r.randint(low, high)  # type: ignore[arg-type]
    return math.exp(r.uniform(math.log(low), math.log(high))) if kind == "log" else r.uniform(low, high)  # type: ignore[arg-type]


def draw_trials(space: dict[str, dict[str, tuple]], count: int, seed: int = 42) -> list[Trial]:
    """count settings from the space, estimators in turn; the same for the same seed."""
    names = sorted(space)
    out = []
    for number in range(count):
        r, name = random.Random(f"{seed}:{number}"), names[number % len(names)]
        out.append(Trial(number, name, {p: _drawn(r, *space[name][p]) for p in sorted(space[name])}))
    return out


def _fold_losses(rows: DataFrame, trial: Trial, models: dict[str, Estimator], k: int) -> float:
    """Mean cross-entropy over folds, each held out once."""
    losses = []
    for fold in range(k):
        train = with_features(stats.with_class_weight(rows.where(F.col("fold") != fold), small=True))
        model = models[trial.estimator].copy({models[trial.estimator].getParam(p): v for p, v in trial.params.items()}).fit(train)
        scored = model.transform(with_features(rows.where(F.col("fold") == fold))).select("label", vector_to_array("probability")[1].alias("score"))
        losses.append(metrics.cross_entropy(scored, []).first()["loss"])
    return sum(losses) / k


def search(df: DataFrame, space: dict[str, dict[str, tuple]] | None = None, *, trials: int = 8, keep: int = 2, rungs: int = 3, k: int = 2, seed: int = 42, jobs: int = 4, models: dict[str, Estimator] | None = None, key: str = "sample_id") -> DataFrame:
    """number, estimator, params (map of text), rung, rows, value (mean cross-entropy over k folds), state of every trial, by successive halving.

    All trials are fitted on a share of the rows, in hash order; of those that end, one in `keep` goes on to the next rung with `keep` times the rows,
    until the last rung takes all. state: COMPLETE at the last rung, PRUNED for one that stops before, FAIL with an infinite value for one that can't be fitted. A trial has one row, of
    the last rung that it reached; ties go to the lower number. Each fit is a distributed job; `jobs` of them are under way at once.
    """
    own, models = folds_by_hash(df, k, seed, key), models or estimators(seed)
    running, done = draw_trials(space or SPACE, trials, seed), {}
    for rung in range(rungs):
        share = float(keep) ** (rung - rungs + 1)
        rows = own.where(F.col("place") < share).persist()
        count = rows.count()

        def value(trial: Trial, rows: DataFrame = rows) -> float:
            try:
                found = _fold_losses(rows, trial, models, k)
            except (IllegalArgumentException, Py4JJavaError, ValueError, TypeError, AttributeError, StopIteration):
                return math.inf
            return found if found is not None and not math.isnan(found) else math.inf

        with ThreadPoolExecutor(jobs) as pool:
            values = list(pool.map(inheritable_thread_target(df.sparkSession)(value), running))
        rows.unpersist()
        good = sorted((v, t.number, t) for v, t in zip(values, running, strict=True) if v < math.inf)
        last = rung == rungs - 1
        ahead = [t for _, _, t in good[: max(1, len(good) // keep)]] if not last else []
        for v, t in zip(values, running, strict=True):
            state = "FAIL" if v == math.inf else "COMPLETE" if last else "PRUNED"
            done[t.number] = (t.number, t.estimator, {p: str(x) for p, x in t.params.items()}, rung, count, v, state)
        running = sorted(ahead, key=lambda t: t.number)
    schema = "number int, estimator string, params map<string, string>, rung int, rows long, value double, state string"
    return df.sparkSession.createDataFrame([done[n] for n in sorted(done)], schema)  # one row a trial


def folds_by_hash(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """df with place, a number in [0, 1), and fold, from 0, both by hash of the key and independent of each other."""
    return df.withColumns({"place": hash_uniform(seed, F.col(key)), "fold": F.floor(hash_uniform(seed + 1, F.col(key)) * k).cast("int")})
