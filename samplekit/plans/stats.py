"""Queries of dataset statistics and the quality gate, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplekit.operators import features, sampling, stats
from samplekit.plans import bindings as b
from samplekit.plans.evaluation import r6
from samplekit.plans.sampling import _split

ACCEPT = "composite_score >= 0.65 and brightness_ok and is_sharp and contrast > 15"
SPLIT = b.QUALITY + _split("0.8", "floor", "train", "test") + ", split_rows as (select q.*, strat.split from quality q join strat using (sample_id))"
STATS = SPLIT + """, st as (select dataset as dataset_name, count(*) as total_samples, count(*) filter (where split = 'train') as train_samples, count(*) filter (where split = 'test') as test_samples,
  count(*) filter (where split = 'train' and label = 0) as train_bonafide, count(*) filter (where split = 'train' and label = 1) as train_attack, count(*) filter (where split = 'test' and label = 0) as test_bonafide, count(*) filter (where split = 'test' and label = 1) as test_attack,
  avg(label) filter (where split = 'train') as train_balance_ratio, avg(label) filter (where split = 'test') as test_balance_ratio, avg(composite_score) filter (where split = 'train') as avg_train_quality, avg(composite_score) filter (where split = 'test') as avg_test_quality,
  stddev_pop(composite_score) as quality_std, min(composite_score) as min_quality, max(composite_score) as max_quality from split_rows group by dataset)"""
RATIOS = ["train_balance_ratio", "test_balance_ratio", "avg_train_quality", "avg_test_quality", "quality_std", "min_quality", "max_quality"]
SIZES = "total_samples, train_samples, test_samples, train_bonafide, train_attack, test_bonafide, test_attack"


def _quality(spark, d):  # noqa: ANN001, ANN202
    return features.with_composite(b.samples(spark, d))


def split_quality(spark, d):  # noqa: ANN001, ANN201
    return sampling.stratified_split(_quality(spark, d), 0.8, by=["dataset"])


def dataset_stats(spark, d):  # noqa: ANN001, ANN201
    return stats.with_settings(stats.dataset_stats(split_quality(spark, d), quality="composite_score"), video_like=("ds3", "ds4"))


REPORT = STATS + """
, o as (
  select count(*) as datasets, sum(total_samples)::bigint as total, sum(train_samples)::bigint as train, sum(test_samples)::bigint as test,
    (sum(avg_train_quality) + sum(avg_test_quality)) / (count(avg_train_quality) + count(avg_test_quality)) as quality,
    min(min_quality) as least, max(max_quality) as most
  from st)
, shown as (select *, round(quality, 3)::decimal(12, 3) as q, round(least, 3)::decimal(12, 3) as lo, round(most, 3)::decimal(12, 3) as hi from o)
select 0 as part, null as dataset_name, '## Summary' || chr(10) || chr(10) || '| What | Value |' || chr(10) || '| --- | --- |' || chr(10)
  || '| Datasets | ' || format('{:,}', datasets) || ' |' || chr(10) || '| Samples | ' || format('{:,}', total) || ' |' || chr(10)
  || '| Training samples | ' || format('{:,}', train) || ' |' || chr(10) || '| Test samples | ' || format('{:,}', test) || ' |' || chr(10)
  || '| Mean quality | ' || q || ' |' || chr(10) || '| Quality threshold | 0.65 |' as value from shown
union all
select 1, dataset_name, '### ' || dataset_name || chr(10) || chr(10) || '- Type: ' || case when dataset_name in ('ds3', 'ds4') then 'video' else 'image' end || chr(10)
  || '- Samples: ' || format('{:,}', total_samples) || chr(10)
  || '- Train: ' || format('{:,}', train_samples) || ' (bonafide ' || format('{:,}', train_bonafide) || ', attack ' || format('{:,}', train_attack) || ')' || chr(10)
  || '- Test: ' || format('{:,}', test_samples) || ' (bonafide ' || format('{:,}', test_bonafide) || ', attack ' || format('{:,}', test_attack) || ')' || chr(10)
  || '- Attack share: train ' || round(train_balance_ratio, 3)::decimal(12, 3) || ', test ' || round(test_balance_ratio, 3)::decimal(12, 3) || chr(10)
  || '- Quality: train ' || round(avg_train_quality, 3)::decimal(12, 3) || ', test ' || round(avg_test_quality, 3)::decimal(12, 3) from st
union all
select 2, null, '## Quality' || chr(10) || chr(10) || '- Threshold: 0.65' || chr(10) || '- Mean quality: ' || q || chr(10) || '- Range of quality: ' || lo || ' to ' || hi from shown"""


QUERIES = {
    "b04_b06_b07_quality_gate": (
        lambda spark, d: _quality(spark, d).withColumn("accepted", features.quality_gate(0.65)).select("sample_id", "brightness_score", "brightness_ok", "is_sharp", F.round("composite_score", 9).alias("composite_score"), "accepted"),
        b.QUALITY + f" select sample_id, brightness_score, brightness_ok, is_sharp, round(composite_score, 9) as composite_score, {ACCEPT} as accepted from quality",
    ),
    "b09_rejection_report": (
        lambda spark, d: r6(stats.rejection_report(_quality(spark, d).withColumn("accepted", features.quality_gate(0.65)), ["dataset", "label"]), "success_rate", "mean_quality"),
        b.QUALITY + f" select dataset, label, count(*) as seen, count(*) filter (where {ACCEPT}) as kept, round(avg(({ACCEPT})::int), 6) as success_rate, round(avg(composite_score) filter (where {ACCEPT}), 6) as mean_quality from quality group by dataset, label",
    ),
    "e01_class_weights": (
        lambda spark, d: r6(stats.class_weights(b.samples(spark, d), ["dataset"]), "raw_weight", "weight"),
        b.SAMPLES + ", c as (select dataset, label, count(*) as n from samples group by 1, 2), w as (select *, sum(n) over (partition by dataset)::double / (count(*) over (partition by dataset) * n) as raw_weight from c) select dataset, label, n, round(raw_weight, 6) as raw_weight, round(raw_weight / max(raw_weight) over (partition by dataset), 6) as weight from w",
    ),
    "e02_class_distribution": (
        lambda spark, d: r6(stats.class_distribution(b.labelled_documents(spark, d)), "share"),
        b.DOCS + " select label, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from docs group by label",
    ),
    "e03_dataset_stats": (
        lambda spark, d: r6(dataset_stats(spark, d), *RATIOS).drop("creation_time").withColumn("target_size", F.array_join("target_size", "x")),
        STATS + f" select dataset_name, {SIZES}, '256x256' as target_size, 0.8::double as train_ratio, 0.65::double as quality_threshold, case when dataset_name in ('ds3', 'ds4') then 'video' else 'image' end as data_type, true as balanced, true as quality_enhanced, false as synthetic_data, "
        + ", ".join(f"round({c}, 6) as {c}" for c in RATIOS) + " from st",
    ),
    "e04_combined_stats": (
        lambda spark, d: stats.combined_stats(split_quality(spark, d)).select("total_samples", "train_samples", "test_samples", F.array_join("included_datasets", ",").alias("included"), F.col("samples_per_dataset")["ds1"]["train"].alias("ds1_train"), F.col("samples_per_dataset")["ds1"]["test"].alias("ds1_test")),
        STATS + " select sum(total_samples)::bigint as total_samples, sum(train_samples)::bigint as train_samples, sum(test_samples)::bigint as test_samples, string_agg(dataset_name, ',' order by dataset_name) as included, max(train_samples) filter (where dataset_name = 'ds1') as ds1_train, max(test_samples) filter (where dataset_name = 'ds1') as ds1_test from st",
    ),
    "e05_overall_stats": (
        lambda spark, d: r6(stats.overall_stats(dataset_stats(spark, d)), "average_quality", "min_quality", "max_quality"),
        STATS + " select count(*) as datasets, " + ", ".join(f"sum({c})::bigint as {c}" for c in SIZES.split(", ")) + ", round((sum(avg_train_quality) + sum(avg_test_quality)) / (count(avg_train_quality) + count(avg_test_quality)), 6) as average_quality, round(min(min_quality), 6) as min_quality, round(max(max_quality), 6) as max_quality from st",
    ),
    "e06_loader_info": (
        lambda spark, d: r6(stats.loader_info(split_quality(spark, d)), "share_0", "share_1"),
        SPLIT + " select split, count(*) as size, count(distinct label) as classes, count(*) filter (where label = 0) as class_0, count(*) filter (where label = 1) as class_1, round(avg(1 - label), 6) as share_0, round(avg(label), 6) as share_1 from split_rows group by split",
    ),
    "e07_rollup_counts": (
        lambda spark, d: stats.rollup_counts(split_quality(spark, d), ["dataset", "split", "label"]),
        SPLIT + " select dataset, split, label, count(*) as n from split_rows group by rollup (dataset, split, label)",
    ),
    "e08_expected_check": (
        lambda spark, d: stats.expected_check(dataset_stats(spark, d), spark.createDataFrame([("ds0", 700), ("ds1", 1000), ("other", 5)], "dataset_name string, total_samples long"), "dataset_name", "total_samples", 0.1),
        STATS + " select e.dataset_name, expected, total_samples as actual, total_samples - expected as difference, coalesce(abs(total_samples - expected) <= expected * 0.1::double, false) as ok from (select unnest(['ds0', 'ds1', 'other']) as dataset_name, unnest([700, 1000, 5])::bigint as expected) e left join st using (dataset_name)",
    ),
    "e10_attach_class_weight": (
        lambda spark, d: r6(stats.with_class_weight(b.samples(spark, d).select("sample_id", "dataset", "label"), ["dataset"]), "class_weight"),
        b.SAMPLES + ", c as (select dataset, label, count(*) as n from samples group by 1, 2), w as (select dataset, label, (1.0::double / n) / max(1.0::double / n) over (partition by dataset) as class_weight from c) select sample_id, dataset, label, round(class_weight, 6) as class_weight from samples join w using (dataset, label)",
    ),
    "j06_markdown_report": (lambda spark, d: stats.markdown_report(dataset_stats(spark, d)), REPORT),
    "j07_json_safe": (
        lambda spark, d: features.json_rows(b.samples(spark, d).select("sample_id", F.when(F.col("sample_id") % 3 == 0, float("nan")).otherwise(F.col("contrast")).alias("contrast"), "label")),
        b.SAMPLES + " select '{\"sample_id\":' || sample_id || case when sample_id % 3 = 0 then '' else ',\"contrast\":' || contrast end || ',\"label\":' || label || '}' as value from samples",
    ),
}
