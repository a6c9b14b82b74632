"""Union, membership and combination of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplekit.operators import sampling


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column that a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def combine(df: DataFrame, membership: DataFrame, *, source: str = "dataset", balance: bool = True, by: list[str] | None = None, cap: int | None = None, label: str = "label", key: str = "sample_id", seed: int = 42) -> DataFrame:
    """df with combo: each combination's rows, its sources brought to one size. membership: combo, source.

    A source that df lacks is left out; where nothing is left of any combination, that is an error. Ranks within a source are the same in all
    combinations and are worked out once.
    """
    by = by or []
    wanted = membership.distinct()
    if wanted.join(df.select(source).distinct(), source, "left_semi").isEmpty():
        raise ValueError("none of the sources to combine has rows")
    if not balance:
        return df.join(wanted, source).withColumn("replica_no", F.lit(1).cast("long"))
    rows = sampling.with_quota_ranks(df, [source, *by], label, key, seed).join(wanted, source)
    targets = sampling.balance_targets(rows, source=source, by=["combo", *by], cap=cap)
    return sampling.resample_ranked(rows, targets, by=[source, "combo", *by], label=label, key=key, seed=seed)


def leave_one_out(df: DataFrame, *, source: str = "dataset", prefix: str = "combined_without_") -> DataFrame:
    """combo, source: for each source the others. The sources of df are its distinct values, few; they are paired by an unequal join."""
    names = df.select(source).distinct()
    left = names.select(F.concat(F.lit(prefix), source).alias("combo"), F.col(source).alias("__out"))
    return left.join(names, F.col("__out") != F.col(source)).select("combo", source)


def named_subsets(subsets: dict[str, list[str] | None], df: DataFrame, *, source: str = "dataset") -> DataFrame:
    """combo, source of named lists; None stands for all sources of df."""
    listed = [(k, s) for k, v in subsets.items() if v is not None for s in v]
    out = df.sparkSession.createDataFrame(listed, f"combo string, {source} string")
    for name in (k for k, v in subsets.items() if v is None):
        out = out.union(df.select(F.lit(name).alias("combo"), source).distinct())
    return out


def combine_splits(frames: list[DataFrame], *, key: str = "sample_id", seed: int = 42) -> DataFrame:
    """Union of frames that have a split, with shuffle_rank within each split."""
    return sampling.shuffle(union_all(frames), key=key, seed=seed, by=["split"])


def members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def zip_by_key(samples: DataFrame, metrics: DataFrame, key: str = "sample_id") -> DataFrame:
    return samples.join(metrics, key)


def jobs(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every model with every dataset: both are lists of names that a user gives."""
    return models.crossJoin(datasets)


def transfer_pairs(df: DataFrame, *, source: str = "dataset") -> DataFrame:
    """trained_on, tested_on: each source with each other one."""
    names = df.select(source).distinct()
    return names.select(F.col(source).alias("trained_on")).join(names.select(F.col(source).alias("tested_on")), F.col("trained_on") != F.col("tested_on"))


def with_prefixed(df: DataFrame, struct: str, prefix: str = "final_") -> DataFrame:
    """df with the fields of a struct column as columns of their own, prefixed."""
    return df.select("*", *(F.col(f"{struct}.{f.name}").alias(f"{prefix}{f.name}") for f in df.schema[struct].dataType.fields)).drop(struct)
