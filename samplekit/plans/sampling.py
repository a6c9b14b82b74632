"""Queries of the sampling and combining operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplekit.operators import combine, sampling
from samplekit.plans import bindings as b

HASH = "md5(concat('42|', cast(sample_id as varchar)))"
#: Down to a target: class quotas first, then what is missing from the rest, both in hash order; up: repeats and a remainder.
RESAMPLE = """, sized as (select *, count(*) over (partition by {g}) as total, count(*) over (partition by {g}, label) as n, row_number() over (partition by {g}, label order by h, sample_id) as rc,
  row_number() over (partition by {g} order by h, sample_id) as ra from tagged)
, q as (select *, least(n, floor(target * (n::double / total)))::bigint as quota from sized)
, m as (select {g}, max(target) - sum(quota) as missing from (select distinct {g}, label, target, quota from q) group by {g})
, rest as (select *, row_number() over (partition by {g} order by h, sample_id) as spare from q where total >= target and rc > quota)
, resampled as (
  select {c}, 1::bigint as replica_no from q where total >= target and rc <= quota
  union all select {c}, 1::bigint from rest join m using ({g}) where spare <= missing
  union all select {c}, unnest(range(1, (floor(target / total) + case when ra <= target % total then 1 else 0 end)::bigint + 1)) from q where total < target)"""
BALANCED = b.SAMPLES + f""", sizes as (select dataset, count(*) as k from samples group by dataset), goal as (select floor(quantile_cont(k, 0.5))::bigint as target from sizes)
, tagged as (select sample_id, dataset, label, {HASH} as h, target from samples cross join goal)""" + RESAMPLE.format(g="dataset", c="sample_id, dataset, label")
MEMBERS = "(select distinct 'combined_without_' || x.dataset as combo, y.dataset from samples x join (select distinct dataset from samples) y on x.dataset <> y.dataset)"
LOO = b.SAMPLES + f""", mem as (select * from {MEMBERS}), joined as (select m.combo, s.* from samples s join mem m using (dataset)), sizes as (select combo, dataset, count(*) as k from joined group by 1, 2)
, goal as (select combo, floor(quantile_cont(k, 0.5))::bigint as target from sizes group by combo), tagged as (select combo, sample_id, dataset, label, {HASH} as h, target from joined join goal using (combo))""" + RESAMPLE.format(g="combo, dataset", c="combo, sample_id, dataset, label")


def _split(share: str, rounding: str, first: str, second: str, by: str = "dataset", table: str = "samples") -> str:
    return f""", cnt as (select {by}, label, count(*) as n from {table} group by {by}, label), tot as (select *, sum(n) over (partition by {by}) as total from cnt)
, ex as (select *, {rounding}(total::double * {share}::double) as goal, {rounding}(total::double * {share}::double) * n / total::double as exact from tot)
, qu as (select *, floor(exact) as fl, row_number() over (partition by {by} order by round(exact - floor(exact), 9) desc, label) as turn, goal - sum(floor(exact)) over (partition by {by}) as spare from ex)
, strat as (select s.sample_id, s.{by}, s.label, s.group_id, case when row_number() over (partition by s.{by}, s.label order by {HASH}, s.sample_id) <= fl + case when turn <= spare then 1 else 0 end then '{first}' else '{second}' end as split
  from {table} s join qu on qu.{by} = s.{by} and qu.label = s.label)"""


GROUPED = ", gr as (select dataset, group_id, row_number() over (partition by dataset order by md5(concat('42|', cast(group_id as varchar))), group_id) as k, count(*) over (partition by dataset) as g from (select distinct dataset, group_id from {t})), grouped as (select s.sample_id, s.dataset, s.label, s.group_id, case when k <= floor(g * 0.15::double) then 'val' else 'train' end as split from {t} s join gr on gr.dataset = s.dataset and gr.group_id = s.group_id)"
SUBSETS = {"all": None, "high_quality": ["ds0", "ds1"], "video": ["ds3", "ds4", "absent"]}


def _frames(spark, d):  # noqa: ANN001, ANN202
    return b.samples(spark, d).select(F.col("group_id").alias("video_id"), F.col("sample_id").alias("frame"), F.round("sharpness", 1).alias("quality"))


BEST_FRAMES = "recursive " + b.SAMPLES + """, r as (select group_id as video_id, sample_id as frame, round(sharpness, 1) as quality, row_number() over (partition by group_id order by round(sharpness, 1) desc, sample_id) as k from samples)
, g as (select distinct video_id, 0::bigint as k, []::bigint[] as taken from r
  union all select g.video_id, g.k + 1, case when len(taken) < 5 and len(list_filter(taken, lambda x: abs(x - r.frame) < 200)) = 0 then list_append(taken, r.frame) else taken end from g join r on r.video_id = g.video_id and r.k = g.k + 1)
, t as (select video_id, arg_max(taken, k) as taken from g group by video_id)
select video_id, frame, quality, place::int as place from (select video_id, unnest(taken) as frame, generate_subscripts(taken, 1) as place from t) join r using (video_id, frame)"""
WEIGHTS = {"ds0": 2.0, "ds3": 0.5}
TOTAL = 1200
TARGETS = b.SAMPLES + f""", s as (select dataset, count(*)::double as high, least(50, count(*))::double as low, case dataset when 'ds0' then 2.0::double when 'ds3' then 0.5::double else 1.0::double end as w from samples group by dataset)
, p as (select distinct low / w as level from s union select distinct high / w from s), f as (select level, sum(least(high, greatest(low, w * level))) as total from p cross join s group by level)
, goal as (select least(sum(high), greatest(sum(low), {TOTAL})) as goal from s), a as (select max(level) as l0, max(total) as t0 from f, goal where total <= goal + 1e-6)
, z as (select min(level) as l1, min(total) as t1 from f, goal where total > goal + 1e-6)
, level as (select case when t1 is null then l0 else l0 + (goal - t0) / (t1 - t0) * (l1 - l0) end as level, goal from a, z, goal)
, x as (select dataset, round(least(high, greatest(low, w * level)), 6) as x, goal, high from s cross join level), y as (select *, row_number() over (order by floor(x) + 1 <= high desc, x - floor(x) desc, dataset) as turn, goal - sum(floor(x)) over () as missing from x)
, targets as (select dataset, (floor(x) + case when turn <= round(missing) then 1 else 0 end)::bigint as target from y)"""
BY_TIME = b.SAMPLES + """, c as (select dataset, label, count(*) as n from samples group by dataset, label), l as (select *, min(n) over (partition by dataset) as k from c)
, r as (select s.sample_id, s.dataset, s.label, n, k, row_number() over (partition by s.dataset, s.label order by ts, sample_id) as j from samples s join l using (dataset, label))
select sample_id, dataset, label from r where floor(j * k / n::double) > floor((j - 1) * k / n::double)"""
SESSIONS = b.SAMPLES + """, o as (select *, case when coalesce(ts - lag(ts) over (partition by group_id order by ts, sample_id) > interval 3 day, true) then 1 else 0 end as begins from samples)
, n as (select *, sum(begins) over (partition by group_id order by ts, sample_id) as session from o), m as (select *, max(session) over (partition by group_id) as sessions from n)"""


def _session_leaks(spark, d):  # noqa: ANN001, ANN202
    """Sessions that stand in more than one split: none; and the rows of each split."""
    own = sampling.session_split(b.samples(spark, d), "3 days")
    leaks = sampling.leak_report(own, "session", by=["group_id"]).agg(F.count("*").alias("leaks"))
    return own.groupBy("split").agg(F.count("*").alias("n")).crossJoin(leaks)


def _weighted_rows(spark, d):  # noqa: ANN001, ANN202
    """Sizes of the sources after they were brought to their targets."""
    rows = b.samples(spark, d)
    targets = sampling.weighted_targets(rows, TOTAL, WEIGHTS, least=50)
    return sampling.resample_to(rows, targets, by=["dataset"]).groupBy("dataset").agg(F.count("*").alias("n"))


def _samples(spark, d):  # noqa: ANN001, ANN202
    return b.samples(spark, d)


def _quality(spark, d):  # noqa: ANN001, ANN202
    return b.labelled_documents(spark, d)


QUERIES = {
    "c02_best_frames": (lambda spark, d: sampling.best_frames(_frames(spark, d), 5, 200), BEST_FRAMES),
    "c05_weighted_targets": (lambda spark, d: sampling.weighted_targets(b.samples(spark, d), TOTAL, WEIGHTS, least=50), TARGETS + " select * from targets"),
    "c05_weighted_sources": (_weighted_rows, TARGETS + " select dataset, target as n from targets where target > 0"),
    "c01_temporal_balance": (lambda spark, d: sampling.balance_by_time(b.samples(spark, d), by=["dataset"]).select("sample_id", "dataset", "label"), BY_TIME),
    "c09_session_split": (
        lambda spark, d: sampling.session_split(b.samples(spark, d), "3 days").select("sample_id", "session", "split"),
        SESSIONS + " select sample_id, session::bigint as session, case when session = sessions and session > 1 then 'test' else 'train' end as split from m",
    ),
    "c12_session_leaks": (_session_leaks, SESSIONS + " select case when session = sessions and session > 1 then 'test' else 'train' end as split, count(*) as n, 0::bigint as leaks from m group by 1"),
    "c01_balance_by_quality": (
        lambda spark, d: sampling.balance_by_quality(_quality(spark, d)).select("sample_id", "label", F.round("quality", 6).alias("quality")),
        b.DOCS + ", r as (select *, row_number() over (partition by label order by quality desc, sample_id) as k from docs), l as (select min(n) as least from (select label, count(*) as n from docs group by label)) select sample_id, label, round(quality, 6) as quality from r cross join l where k <= least",
    ),
    "c02_sample_frames": (
        lambda spark, d: sampling.sample_frames(b.manifest(spark, d)),
        b.MANIFEST + """, f as (select *, greatest(15, floor(total_frames * 0.15::double))::bigint as a, least(total_frames - 15, floor(total_frames * 0.85::double))::bigint as z from manifest)
      select video_id, total_frames, unnest(case when total_frames < 10 then []::bigint[] when z <= a then [(total_frames // 2)::bigint] else list_slice(range(a, z, greatest(1, (z - a) // 20)), 1, 20) end) as frame from f""",
    ),
    "c03_c05_balance_sources": (
        lambda spark, d: sampling.balance_sources(_samples(spark, d)).select("sample_id", "dataset", "label", "replica_no"),
        BALANCED + " select * from resampled",
    ),
    "c05_balance_targets_capped": (
        lambda spark, d: sampling.balance_targets(_samples(spark, d), cap=1000),
        b.SAMPLES + ", s as (select dataset, count(*) as k from samples group by dataset) select dataset, (select least(min(k), 1000) from s)::bigint as target from s",
    ),
    "c06_shuffle": (
        lambda spark, d: sampling.shuffle(_samples(spark, d).select("sample_id")),
        b.SAMPLES + f" select sample_id, row_number() over (order by {HASH}, sample_id) as shuffle_rank from samples",
    ),
    "c07_stratified_split": (
        lambda spark, d: sampling.stratified_split(_samples(spark, d).select("sample_id", "dataset", "label"), 0.8, by=["dataset"]),
        b.SAMPLES + _split("0.8", "floor", "train", "test") + " select sample_id, dataset, label, split from strat",
    ),
    "c08_stratified_validation": (
        lambda spark, d: sampling.stratified_split(_samples(spark, d).select("sample_id", "dataset", "label"), 0.15, by=["dataset"], rounding="ceil", names=("val", "train")),
        b.SAMPLES + _split("0.15", "ceil", "val", "train") + " select sample_id, dataset, label, split from strat",
    ),
    "c09_group_split": (
        lambda spark, d: sampling.group_split(_samples(spark, d).select("sample_id", "dataset", "label", "group_id"), by=["dataset"]),
        b.SAMPLES + GROUPED.format(t="samples") + " select * from grouped",
    ),
    "c09_pseudo_groups": (
        lambda spark, d: sampling.pseudo_groups(_samples(spark, d).select("sample_id", "dataset"), "sample_id", 20, ["dataset"]),
        b.SAMPLES + ", r as (select sample_id, dataset, row_number() over (partition by dataset order by sample_id) - 1 as k, count(*) over (partition by dataset) as n from samples) select sample_id, dataset, least(k // 20, greatest(n // 20 - 1, 0))::bigint as group_id from r",
    ),
    "c10_random_split": (
        lambda spark, d: sampling.random_split(_samples(spark, d).select("sample_id")),
        b.SAMPLES + f" select sample_id, case when row_number() over (order by {HASH}, sample_id) <= floor(count(*) over () * 0.15::double) then 'val' else 'train' end as split from samples",
    ),
    "c11_routed_split": (
        lambda spark, d: sampling.routed_split(_samples(spark, d).select("sample_id", "dataset", "label", "group_id"), ["ds3", "ds4"]),
        b.SAMPLES + ", vid as (select * from samples where dataset in ('ds3', 'ds4')), img as (select * from samples where dataset not in ('ds3', 'ds4'))" + GROUPED.format(t="vid") + _split("0.15", "ceil", "val", "train", table="img") + " select sample_id, dataset, label, group_id, split from grouped union all select sample_id, dataset, label, group_id, split from strat",
    ),
    "c12_leak_report": (
        lambda spark, d: sampling.leak_report(sampling.stratified_split(_samples(spark, d), 0.8, by=["dataset"]), by=["dataset"]),
        b.SAMPLES + _split("0.8", "floor", "train", "test") + " select dataset, group_id, count(distinct split) as splits from strat group by dataset, group_id having count(distinct split) > 1",
    ),
    "c13_batches": (
        lambda spark, d: sampling.with_batches(_samples(spark, d).select("sample_id"), 32),
        b.SAMPLES + f" select sample_id, ((row_number() over (order by {HASH}, sample_id) - 1) // 32)::bigint as batch_id from samples",
    ),
    "c14_preview": (
        lambda spark, d: sampling.preview(_samples(spark, d).select("sample_id", "dataset", "label"), 5),
        b.SAMPLES + " select sample_id, dataset, label from samples order by sample_id limit 5",
    ),
    "x_stratified_folds": (
        lambda spark, d: sampling.folds(_samples(spark, d).select("sample_id", "label"), 5),
        b.SAMPLES + f" select sample_id, label, ((row_number() over (partition by label order by {HASH}, sample_id) - 1) % 5)::bigint as fold from samples",
    ),
    "d01_union_halves": (
        lambda spark, d: combine.union_all([_samples(spark, d).where("label = 0"), _samples(spark, d).where("label = 1")]).groupBy("dataset", "label").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids")),
        b.SAMPLES + " select dataset, label, count(*) as n, sum(sample_id)::bigint as ids from samples group by dataset, label",
    ),
    "d02_combine_all": (
        lambda spark, d: combine.combine(_samples(spark, d), combine.named_subsets({"all": None}, _samples(spark, d))).groupBy("combo", "dataset", "label").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids")),
        BALANCED + " select 'all' as combo, dataset, label, count(*) as n, sum(sample_id)::bigint as ids from resampled group by dataset, label",
    ),
    "d03_leave_one_out": (
        lambda spark, d: combine.combine(_samples(spark, d), combine.leave_one_out(_samples(spark, d))).groupBy("combo", "dataset", "label").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids"), F.max("replica_no").alias("most")),
        LOO + " select combo, dataset, label, count(*) as n, sum(sample_id)::bigint as ids, max(replica_no) as most from resampled group by combo, dataset, label",
    ),
    "d04_named_subsets": (
        lambda spark, d: combine.combine(_samples(spark, d), combine.named_subsets(SUBSETS, _samples(spark, d)), balance=False).groupBy("combo", "dataset").agg(F.count("*").alias("n")),
        b.SAMPLES + " select combo, dataset, count(*) as n from samples join (select 'high_quality' as combo, unnest(['ds0', 'ds1']) as dataset union all select 'video', unnest(['ds3', 'ds4', 'absent']) union all select distinct 'all', dataset from samples) m using (dataset) group by combo, dataset",
    ),
    "d05_combine_splits": (
        lambda spark, d: combine.combine_splits([sampling.stratified_split(_samples(spark, d).where(F.col("dataset") == x), 0.8, by=["dataset"]) for x in ("ds0", "ds1", "ds2", "ds3", "ds4")]).select("sample_id", "dataset", "split", "shuffle_rank"),
        b.SAMPLES + _split("0.8", "floor", "train", "test") + f" select sample_id, dataset, split, row_number() over (partition by split order by {HASH}, sample_id) as shuffle_rank from strat",
    ),
    "d06_membership": (
        lambda spark, d: combine.members(_samples(spark, d), b.labelled_documents(spark, d).select("sample_id"), ["sample_id"]).select("sample_id", "dataset"),
        b.SAMPLES + " select sample_id, dataset from samples where sample_id in (select doc_id from labels join documents using (doc_id))",
    ),
    "d07_difference": (
        lambda spark, d: combine.without(_samples(spark, d), b.labelled_documents(spark, d).select("sample_id"), ["sample_id"]).groupBy("dataset").agg(F.count("*").alias("n")),
        b.SAMPLES + " select dataset, count(*) as n from samples where sample_id not in (select doc_id from labels join documents using (doc_id)) group by dataset",
    ),
    "d08_distinct_counts": (
        lambda spark, d: combine.distinct_counts(_samples(spark, d), ["dataset", "label"]),
        b.SAMPLES + " select dataset, label, count(*) as n from samples group by dataset, label",
    ),
    "d09_zip_by_key": (
        lambda spark, d: combine.zip_by_key(_samples(spark, d).select("sample_id", "label"), _quality(spark, d).select("sample_id", F.round("quality", 6).alias("quality"))),
        b.SAMPLES + ", " + b.DOCS + " select s.sample_id, s.label, round(quality, 6) as quality from samples s join docs using (sample_id)",
    ),
    "d10_jobs": (
        lambda spark, d: combine.jobs(b.predictions(spark, d).select("model").distinct(), _samples(spark, d).select("dataset").distinct()),
        b.SAMPLES + " select model, dataset from (select unnest(['m0', 'm1', 'm2', 'm3']) as model) cross join (select distinct dataset from samples)",
    ),
    "d11_transfer_pairs": (
        lambda spark, d: combine.transfer_pairs(_samples(spark, d)),
        b.SAMPLES + ", n as (select distinct dataset from samples) select x.dataset as trained_on, y.dataset as tested_on from n x join n y on x.dataset <> y.dataset",
    ),
    "d12_prefixed_merge": (
        lambda spark, d: combine.with_prefixed(_samples(spark, d).select("sample_id", "sharpness", F.struct((F.col("sharpness") * 2).alias("sharpness"), "contrast").alias("final")), "final"),
        b.SAMPLES + " select sample_id, sharpness, sharpness * 2 as final_sharpness, contrast as final_contrast from samples",
    ),
}
