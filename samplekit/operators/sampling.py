"""Balancing, resampling and splitting by hash order: sizes are exact and don't depend on the partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplekit.functions.hashing import with_hash_rank
from samplekit.functions.parts import is_bound, part_count, part_of, quantile_bounds, shared_prefix, text_code


def check_share(share: float, name: str = "share") -> None:
    if not 0 <= share <= 1:
        raise ValueError(f"{name} must lie in [0, 1]: {share}")


def with_exact_rank(df: DataFrame, by: list[str], value: str, key: str, rank: str = "rank", parts: int | None = None) -> DataFrame:
    """df with its rank, from 1, by value (largest first) and key within `by`. Null values come last.

    Rows are counted by parts of each group first, between approximate quantiles of the value. A value that makes up several quantiles is a part
    of its own, cut further by quantiles of the key, of a text those of the bytes behind what all keys of the group begin with: neither an outlier nor many ties make one task sort a whole group.
    """
    parts = parts or part_count(df.sparkSession)
    same = lambda other: [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in by] or F.lit(True)
    renamed = lambda grouped, other, *columns: grouped.select(*[F.col(c).alias(f"{other}{c}") for c in by], *columns)
    coded = df.withColumn("__code", F.col(key))
    if df.schema[key].dataType.typeName() == "string":
        ends = renamed(df.groupBy(*by).agg(shared_prefix(F.min(key), F.max(key)).alias("__shared")), "__s_", "__shared")
        coded = df.join(ends, same("__s_")).select(*df.columns, text_code(F.col(key), F.col("__shared")).alias("__code"))
    reach = coded.groupBy(*by).agg(quantile_bounds(F.col(value), parts).alias("__values"), quantile_bounds(F.col("__code"), parts).alias("__keys"))
    own = coded.join(renamed(reach, "__r_", "__values", "__keys"), same("__r_")).withColumn("__below", part_of(F.col("__values"), F.col(value), parts))
    tied = F.coalesce(is_bound(F.col("__values"), F.col(value), F.col("__below")), F.lit(False))
    own = own.withColumn("__part", F.when(F.col(value).isNull(), -1).otherwise(2 * F.col("__below") + tied.cast("int")))
    own = own.withColumn("__sub", F.when(F.col(value).isNull() | tied, part_of(F.col("__keys"), F.col("__code"), parts)).otherwise(0))
    sizes = own.groupBy(*by, "__part", "__sub").agg(F.count("*").alias("__rows"))
    above = Window.partitionBy(*by).orderBy(F.desc("__part"), "__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"__o_{c}") for c in by], F.col("__part").alias("__of"), F.col("__sub").alias("__of_sub"), F.coalesce(F.sum("__rows").over(above), F.lit(0)).alias("__before"))
    ranked = own.withColumn("__within", F.row_number().over(Window.partitionBy(*by, "__part", "__sub").orderBy(F.desc_nulls_last(value), key)))
    match = [F.col("__part") == F.col("__of"), F.col("__sub") == F.col("__of_sub"), *(F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in by)]
    return ranked.join(offsets, match).withColumn(rank, (F.col("__before") + F.col("__within")).cast("long")).select(*df.columns, rank)


def _totals(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """by, label, n, total, classes, least."""
    every = Window.partitionBy(*by)
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumns({"total": F.sum("n").over(every), "classes": F.count("*").over(every), "least": F.min("n").over(every)})


def balance_by_quality(df: DataFrame, label: str = "label", quality: str = "quality", key: str = "sample_id", by: list[str] | None = None, enabled: bool = True) -> DataFrame:
    """The best rows of the larger class, as many as the smaller one has; all rows where a class is absent, both are equal, or it isn't enabled."""
    if not enabled:
        return df
    by = by or []
    limits = _totals(df, by, label).select(*by, label, F.when(F.col("classes") > 1, F.col("least")).otherwise(F.col("n")).alias("__limit"))
    ranked = with_exact_rank(df, [*by, label], quality, key, "__rank")
    return ranked.join(limits, [*by, label]).where("__rank <= __limit").select(*df.columns)


def sample_frames(manifest: DataFrame, most: int = 20) -> DataFrame:
    """manifest with frame: the frames to take from each video, evenly from its middle. Fewer than 10 frames: none."""
    n = F.col("total_frames")
    start, end = F.greatest(F.lit(15), F.floor(n * 0.15)).cast("long"), F.least(n - 15, F.floor(n * 0.85)).cast("long")
    step = F.greatest(F.lit(1), F.floor((end - start) / 20)).cast("long")
    frames = F.when(n < 10, F.array().cast("array<bigint>")).when(end <= start, F.array(F.floor(n / 2).cast("long"))).otherwise(F.slice(F.sequence(start, F.greatest(end - 1, start), step), 1, most))
    return manifest.withColumn("frame", F.explode(frames))


def best_frames(frames: DataFrame, most: int = 20, apart: int = 10, *, by: str = "video_id", frame: str = "frame", quality: str = "quality") -> DataFrame:
    """frames, with place from 1, of the best quality in each video, `most` at most, any two of them `apart` or more: the best one first, then always the best of those that are far enough from all taken; ties to the earlier frame.

    What is taken rules out 2 apart - 1 frames at most, so the best most (2 apart - 1) frames of a video decide; only these come together in one row. Frames without a quality are never taken.
    """
    span = 2 * apart - 1
    ranked = with_exact_rank(frames.where(F.col(quality).isNotNull() & F.col(frame).isNotNull()), [by], quality, frame, "__rank").where(F.col("__rank") <= most * span)
    lists = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__rank", F.col(frame).cast("long").alias("frame")))).alias("__list"))
    none = F.array().cast("array<bigint>")
    taken = F.aggregate("__list", none, lambda own, x: F.when((F.size(own) < most) & ~F.exists(own, lambda y: F.abs(y - x["frame"]) < apart), F.concat(own, F.array(x["frame"]))).otherwise(own))
    rows = lists.select(F.col(by).alias("__by"), F.posexplode(taken).alias("__place", "__frame"))
    match = [F.col(by).eqNullSafe(F.col("__by")), F.col(frame) == F.col("__frame")]
    return frames.join(rows, match).select(*frames.columns, (F.col("__place") + 1).alias("place"))


def with_quota_ranks(df: DataFrame, by: list[str], label: str, key: str, seed: int) -> DataFrame:
    """df with its hash ranks within a class of a group and within the group."""
    return with_hash_rank(with_hash_rank(df, seed, key, [*by, label], "__in_class"), seed, key, by, "__in_all")


def resample_to(df: DataFrame, targets: DataFrame, *, by: list[str], label: str = "label", key: str = "sample_id", seed: int = 42) -> DataFrame:
    """df with exactly `target` rows in each group, and replica_no. targets: by, target.

    Down: each class gets its share, rounded down, in hash order; what is missing is taken from the rest in hash order. Up: the whole
    group is repeated, and the remainder is its first rows in hash order. Groups without a target go.
    """
    return resample_ranked(with_quota_ranks(df, by, label, key, seed), targets, by=by, label=label, key=key, seed=seed)


def resample_ranked(ranked: DataFrame, targets: DataFrame, *, by: list[str], label: str, key: str, seed: int) -> DataFrame:
    """resample_to of rows that have their ranks of with_quota_ranks already; whole groups may stand in several groups of by."""
    columns = [c for c in ranked.columns if c not in ("__in_class", "__in_all")]
    counts = _totals(ranked, by, label).select(*by, label, "n", "total").join(targets.select(*by, F.col("target").cast("long").alias("__target")), by)
    quota = F.floor(F.col("__target") * (F.col("n") / F.col("total"))).cast("long")
    counts = counts.withColumn("__quota", F.least("n", quota))
    counts = counts.withColumn("__missing", F.col("__target") - F.sum("__quota").over(Window.partitionBy(*by)))
    rows = ranked.join(counts.select(*by, label, "total", "__target", "__quota", "__missing"), [*by, label])
    up = rows.where(F.col("total") < F.col("__target"))
    times = F.floor(F.col("__target") / F.col("total")) + F.when(F.col("__in_all") <= F.col("__target") % F.col("total"), 1).otherwise(0)
    up = up.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))).alias("replica_no"))
    down = rows.where(F.col("total") >= F.col("__target"))
    first = down.where("__in_class <= __quota")
    few = down.where("__in_class > __quota and __in_class <= __quota + __missing")  # no class gives more than all that is missing, fewer than classes
    rest = few.withColumn("__spare", F.row_number().over(Window.partitionBy(*by).orderBy("__in_all"))).where("__spare <= __missing")
    one = F.lit(1).cast("long").alias("replica_no")
    return up.unionByName(first.select(*columns, one)).unionByName(rest.select(*columns, one))


def balance_targets(df: DataFrame, *, source: str = "dataset", by: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """source, by, target: the median source size, or with a cap the least of it and the smallest size; separately within `by` (such as the split)."""
    by = by or []
    sizes = df.groupBy(source, *by).agg(F.count("*").alias("n"))
    own = F.min("n") if cap is not None else F.floor(F.percentile("n", 0.5))
    goal = sizes.groupBy(*by).agg((F.least(own, F.lit(cap)) if cap is not None else own).cast("long").alias("target"))
    return sizes.select(source, *by).join(goal, by) if by else sizes.select(source).withColumn("__one", F.lit(1)).join(goal.withColumn("__one", F.lit(1)), "__one").drop("__one")


def balance_sources(df: DataFrame, *, source: str = "dataset", by: list[str] | None = None, cap: int | None = None, label: str = "label", key: str = "sample_id", seed: int = 42) -> DataFrame:
    by = by or []
    return resample_to(df, balance_targets(df, source=source, by=by, cap=cap), by=[source, *by], label=label, key=key, seed=seed)


def apportion(sizes: DataFrame, total: int, *, source: str = "dataset", weight: str = "weight", least: str = "least", most: str = "most") -> DataFrame:
    """source, target: whole shares of the total by weight, none below `least` or above `most`, that sum to the total exactly; where the bounds don't let them, to the nearest sum that they allow.

    A share is weight times a level, cut to its bounds, and the level is the one at which all sum to the total: the sum grows in pieces between the levels at which a source leaves its
    least or meets its most, so one ordered pass over these finds it. Fractions go to the largest remainders, ties to the smaller source. One row a source; weights are above 0.
    """
    own = sizes.select(F.col(source).alias("__s"), F.col(weight).cast("double").alias("w"), F.col(least).cast("double").alias("low"), F.greatest(least, most).cast("double").alias("high"))
    levels = own.select(F.explode(F.array(F.struct((F.col("low") / F.col("w")).alias("level"), F.col("w").alias("slope"), (-F.col("low")).alias("fixed")), F.struct((F.col("high") / F.col("w")).alias("level"), (-F.col("w")).alias("slope"), F.col("high").alias("fixed")))).alias("e")).select("e.*")
    steps = levels.groupBy("level").agg(F.sum("slope").alias("slope"), F.sum("fixed").alias("fixed"))
    upto = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # two rows a source
    bounds = own.agg(F.sum("low").alias("__low"), F.sum("high").alias("__high"))
    pieces = steps.withColumns({"slope": F.round(F.sum("slope").over(upto), 9), "fixed": F.sum("fixed").over(upto), "next": F.lead("level").over(Window.orderBy("level"))}).join(bounds)
    goal = F.least(F.col("__high"), F.greatest(F.col("__low"), F.lit(float(total))))
    inside = (F.col("__low") + F.col("fixed") + F.col("level") * F.col("slope") <= goal + 1e-6) & (F.col("slope") > 0)
    level = F.coalesce(F.max_by(F.least(F.col("next"), (goal - F.col("__low") - F.col("fixed")) / F.nullif(F.col("slope"), F.lit(0.0))), F.when(inside, F.col("level"))), F.max("level"))
    exact = F.least(F.col("high"), F.greatest(F.col("low"), F.round(F.col("w") * F.col("__level"), 6)))
    shares = own.join(pieces.agg(level.alias("__level"), F.max(goal).alias("__goal"))).select("__s", F.floor(exact).alias("whole"), (exact - F.floor(exact)).alias("rest"), (F.floor(exact) + 1 <= F.col("high")).alias("room"), "__goal")
    turn = F.row_number().over(Window.orderBy(F.desc("room"), F.desc("rest"), "__s"))
    missing = F.round(F.col("__goal") - F.sum("whole").over(Window.partitionBy()))
    return shares.withColumns({"turn": turn, "missing": missing}).select(F.col("__s").alias(source), (F.col("whole") + F.when(F.col("turn") <= F.col("missing"), 1).otherwise(0)).cast("long").alias("target"))


def weighted_targets(df: DataFrame, total: int, weights: str | dict[str, float] = "balanced", *, source: str = "dataset", quality: str = "quality", least: int = 0, upsample: float = 1.0) -> DataFrame:
    """source, target of a mixture of `total` rows, for resample_to. weights: "balanced" (all alike), "quality_based" (by a source's mean quality), or numbers by source (others: 1).

    No source gives more than upsample times its rows, nor fewer than `least` of them, if it has so many.
    """
    known = {"balanced", "quality_based"}
    if isinstance(weights, str) and weights not in known:
        raise ValueError(f"weights must be numbers or one of {sorted(known)}: {weights}")
    mean = F.avg(quality) if weights == "quality_based" else F.lit(1.0)
    sizes = df.where(F.col(source).isNotNull()).groupBy(source).agg(F.count("*").alias("n"), mean.alias("weight"))
    if isinstance(weights, dict):
        of = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else None
        sizes = sizes.withColumn("weight", F.coalesce(F.try_element_at(of, F.col(source)), F.lit(1.0)) if of is not None else F.lit(1.0))
    most = F.floor(F.col("n") * F.lit(upsample))
    return apportion(sizes.where("weight > 0").withColumns({"most": most, "least": F.least(F.lit(least), most)}), total, source=source)


def balance_by_time(df: DataFrame, label: str = "label", ts: str = "ts", key: str = "sample_id", by: list[str] | None = None) -> DataFrame:
    """As many rows of each class as the smallest has, evenly spread over the class in the order of time, ties by key; all rows where a class is absent."""
    by = by or []
    limits = _totals(df, by, label).select(*by, label, F.col("n").alias("__n"), F.when(F.col("classes") > 1, F.col("least")).otherwise(F.col("n")).alias("__limit"))
    ranked = with_exact_rank(df.withColumn("__early", -F.unix_micros(F.col(ts).cast("timestamp"))), [*by, label], "__early", key, "__rank").join(limits, [*by, label])
    step = lambda rank: F.floor(rank * F.col("__limit") / F.col("__n"))
    return ranked.where(step(F.col("__rank")) > step(F.col("__rank") - 1)).select(*df.columns)


def with_sessions(df: DataFrame, gap: str = "30 minutes", *, by: str = "group_id", ts: str = "ts") -> DataFrame:
    """df with session, from 1 within `by`, and sessions, how many there are: a session ends where nothing follows for longer than the gap. Rows without a time have no session (null).

    Rows of one stretch of time as long as the gap are always of one session, so stretches are summed up first; only they, and not rows, are put in order.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    length = F.lit(int(pd.Timedelta(gap).total_seconds() * 1e6))
    own = df.withColumn("__at", micros).withColumn("__stretch", F.floor(F.col("__at") / length))
    stretches = own.where("__at is not null").groupBy(by, "__stretch").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    order = Window.partitionBy(by).orderBy("__stretch")
    begins = F.col("__first") - F.lag("__last").over(order) > length
    numbered = stretches.withColumn("__begins", F.coalesce(begins, F.lit(True)).cast("long")).withColumn("session", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    numbered = numbered.withColumn("sessions", F.max("session").over(Window.partitionBy(by))).select(F.col(by).alias("__by"), F.col("__stretch").alias("__of"), "session", "sessions")
    return own.join(numbered, [F.col(by).eqNullSafe(F.col("__by")), F.col("__stretch") == F.col("__of")], "left").select(*df.columns, "session", "sessions")


def session_split(df: DataFrame, gap: str = "30 minutes", test_sessions: int = 1, *, by: str = "group_id", ts: str = "ts", names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """df with session and split: the last sessions of each of `by` are names[1], as far as one is left to train on. Rows without a time are names[0]."""
    own = with_sessions(df, gap, by=by, ts=ts)
    late = (F.col("session") > F.col("sessions") - test_sessions) & (F.col("session") > 1)
    return own.select(*df.columns, "session", F.when(late, names[1]).otherwise(names[0]).alias("split"))


def shuffle(df: DataFrame, *, key: str = "sample_id", seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """df with shuffle_rank, a permutation from 1."""
    return with_hash_rank(df, seed, key, by, "shuffle_rank")


def stratified_split(df: DataFrame, share: float = 0.8, *, label: str = "label", by: list[str] | None = None, key: str = "sample_id", seed: int = 42, rounding: str = "floor", names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """df with split: a share of each group, rounded, is names[0]; classes get their part of it by largest remainder, ties to the smaller label."""
    check_share(share)
    by = by or []
    every = Window.partitionBy(*by)
    counts = _totals(df, by, label)
    goal = F.floor(F.col("total") * F.lit(share)) if rounding == "floor" else F.ceil(F.col("total") * F.lit(share))
    exact = goal * F.col("n") / F.col("total")
    counts = counts.withColumns({"__goal": goal, "__floor": F.floor(exact), "__left": F.round(exact - F.floor(exact), 9)})
    counts = counts.withColumn("__spare", F.col("__goal") - F.sum("__floor").over(every)).withColumn("__turn", F.row_number().over(every.orderBy(F.desc("__left"), label)))
    counts = counts.select(*by, label, (F.col("__floor") + F.when(F.col("__turn") <= F.col("__spare"), 1).otherwise(0)).alias("__quota"))
    ranked = with_hash_rank(df, seed, key, [*by, label], "__rank").join(counts, [*by, label])
    return ranked.select(*df.columns, F.when(F.col("__rank") <= F.col("__quota"), names[0]).otherwise(names[1]).alias("split"))


def pseudo_groups(df: DataFrame, order_key: str, size: int = 20, by: list[str] | None = None) -> DataFrame:
    """df with group_id: its position by order_key, divided by size; what is left over joins the last group."""
    by = by or []
    ranked = with_exact_rank(df.withColumn("__neg", -F.col(order_key)), by, "__neg", order_key, "__rank")
    n = F.count("*").over(Window.partitionBy(*by)) if by else None
    ranked = ranked.withColumn("__n", n) if n is not None else ranked.withColumn("__one", F.lit(1)).join(df.agg(F.count("*").alias("__n")).withColumn("__one", F.lit(1)), "__one").drop("__one")
    last = F.greatest(F.floor(F.col("__n") / size) - 1, F.lit(0))
    return ranked.select(*df.columns, F.least(F.floor((F.col("__rank") - 1) / size), last).alias("group_id"))


def group_split(df: DataFrame, group: str = "group_id", share: float = 0.15, *, by: list[str] | None = None, seed: int = 42, names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """df with split: whole groups, the first share of them (rounded down) in hash order is names[1]. Rows without a group are names[0]."""
    check_share(share)
    by = by or []
    groups = df.where(F.col(group).isNotNull()).select(*by, group).distinct()
    ranked = with_hash_rank(groups, seed, group, by, "__rank")
    sizes = groups.groupBy(*by).agg(F.count("*").alias("__groups"))
    ranked = ranked.join(sizes, by) if by else ranked.withColumn("__one", F.lit(1)).join(sizes.withColumn("__one", F.lit(1)), "__one")
    held = ranked.where(F.col("__rank") <= F.floor(F.col("__groups") * F.lit(share))).select(*by, group, F.lit(names[1]).alias("__held"))
    return df.join(held, [*by, group], "left").select(*df.columns, F.coalesce("__held", F.lit(names[0])).alias("split"))


def random_split(df: DataFrame, share: float = 0.15, *, by: list[str] | None = None, key: str = "sample_id", seed: int = 42, names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """df with split: exactly a share of the rows, rounded down, is names[1]."""
    check_share(share)
    by = by or []
    ranked = with_hash_rank(df, seed, key, by, "__rank")
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    ranked = ranked.join(sizes, by) if by else ranked.withColumn("__one", F.lit(1)).join(sizes.withColumn("__one", F.lit(1)), "__one")
    return ranked.select(*df.columns, F.when(F.col("__rank") <= F.floor(F.col("__n") * F.lit(share)), names[1]).otherwise(names[0]).alias("split"))


def routed_split(df: DataFrame, video_like: list[str], share: float = 0.15, *, source: str = "dataset", group: str = "group_id", label: str = "label", key: str = "sample_id", seed: int = 42) -> DataFrame:
    """df with split: by group in the sources named, stratified in the others."""
    grouped = group_split(df.where(F.col(source).isin(video_like)), group, share, by=[source], seed=seed)
    others = stratified_split(df.where(~F.col(source).isin(video_like)), share, label=label, by=[source], key=key, seed=seed, rounding="ceil", names=("val", "train"))
    return grouped.unionByName(others)


def leak_report(df: DataFrame, group: str = "group_id", split: str = "split", by: list[str] | None = None) -> DataFrame:
    """by, group, splits: groups that stand in more than one split."""
    return df.groupBy(*(by or []), group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def with_batches(df: DataFrame, size: int, *, key: str = "sample_id", seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """df with batch_id, from 0, in hash order; the last batch may be smaller."""
    return with_hash_rank(df, seed, key, by, "__rank").select(*df.columns, F.floor((F.col("__rank") - 1) / size).alias("batch_id"))


def folds(df: DataFrame, k: int = 5, *, label: str = "label", by: list[str] | None = None, key: str = "sample_id", seed: int = 42) -> DataFrame:
    """df with fold, from 0: stratified, in hash order."""
    return with_hash_rank(df, seed, key, [*(by or []), label], "__rank").select(*df.columns, ((F.col("__rank") - 1) % k).alias("fold"))


def preview(df: DataFrame, n: int, key: str = "sample_id") -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(n)
