"""Queries of comparisons and run analytics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplekit.operators import compare, metrics, runs
from samplekit.plans import bindings as b
from samplekit.plans.evaluation import BY, KEYS, RESULTS, r6, results

METRICS = ["accuracy", "f1_score", "roc_auc", "acer", "eer"]
MODELS = ["alpha", "beta_1", "beta_2", "gamma"]
DATASETS = [f"ds{k}" for k in range(5)]
RUNS = b.EPOCHS + """, runs as (select 'run' || run_id as job_key, 'm' || (run_id % 4) as model, 'ds' || (run_id % 5) as dataset, run_id % 7 <> 0 as success, sum(seconds) as training_time, case when run_id % 11 <> 0 then max(val_accuracy) end as accuracy from epochs group by run_id)"""
CATALOG = """paths as (select 'results/training/' || run || '/checkpoints/' || file as path, run, file from (
  select (['alpha', 'beta_1', 'beta_2', 'gamma', 'other'])[1 + (user_id % 5)::int] || '_set' || user_id as run,
    unnest(case (user_id % 4)::int when 0 then ['best_model.h5', 'a.h5'] when 1 then ['b.keras', 'a.h5'] when 2 then [(['alpha', 'beta_1', 'beta_2', 'gamma', 'other'])[1 + (user_id % 5)::int] || '_set' || user_id || '/x.keras', 'z.h5'] else ['b.keras'] end) as file from (select distinct user_id from events)))"""
CHOSEN = CATALOG + """, own as (select *, max(starts_with(file, run || '/')::int) over (partition by run) = 1 as own_dir from paths)
, ranked as (select *, case when file = 'best_model.h5' then 0 when own_dir and starts_with(file, run || '/') and file like '%.h5' then 1 when own_dir and starts_with(file, run || '/') and file like '%.keras' then 2 when not own_dir and file like '%.h5' then 4 when not own_dir and file like '%.keras' then 5 end as k from own)
, catalog as (select run, case when regexp_extract(run, '^(beta_1|beta_2|alpha|gamma)_(.+)$', 1) <> '' then regexp_extract(run, '^(beta_1|beta_2|alpha|gamma)_(.+)$', 1) else split_part(run, '_', 1) end as model,
  case when regexp_extract(run, '^(beta_1|beta_2|alpha|gamma)_(.+)$', 1) <> '' then regexp_extract(run, '^(beta_1|beta_2|alpha|gamma)_(.+)$', 2) else split_part(run, '_', 2) end as dataset, path from (select run, path, row_number() over (partition by run order by k, file) as j from ranked where k is not null) where j = 1)"""


def _runs(spark, d):  # noqa: ANN001, ANN202
    keys = [F.concat(F.lit("run"), "run_id").alias("job_key"), F.concat(F.lit("m"), F.col("run_id") % 4).alias("model"), F.concat(F.lit("ds"), F.col("run_id") % 5).alias("dataset"), (F.col("run_id") % 7 != 0).alias("success")]
    return b.epochs(spark, d).groupBy("run_id").agg(F.sum("seconds").alias("training_time"), F.max("val_accuracy").alias("best")).select(*keys, "training_time", F.when(F.col("run_id") % 11 != 0, F.col("best")).alias("accuracy"))


def _paths(spark, d):  # noqa: ANN001, ANN202
    users = b.events(spark, d).select("user_id").distinct()
    names = F.array(*map(F.lit, [*MODELS, "other"]))
    run = F.concat(names[(F.col("user_id") % 5).cast("int")], F.lit("_set"), "user_id")
    kind = F.col("user_id") % 4
    files = F.when(kind == 0, F.array(F.lit("best_model.h5"), F.lit("a.h5"))).when(kind == 1, F.array(F.lit("b.keras"), F.lit("a.h5"))).when(kind == 2, F.array(F.concat("run", F.lit("/x.keras")), F.lit("z.h5"))).otherwise(F.array(F.lit("b.keras")))
    return users.withColumn("run", run).select("run", F.explode(files).alias("file")).select(F.concat(F.lit("results/training/"), "run", F.lit("/checkpoints/"), "file").alias("path"))


def _trials(spark, d):  # noqa: ANN001, ANN202
    return b.events(spark, d).select(F.col("event_id").alias("number"), "value", F.create_map(F.lit("lr"), F.col("props")).alias("params"), F.when(F.col("event_type") == "error", "FAIL").otherwise("COMPLETE").alias("state"))


MEANS = ", ".join(f"avg({m}) as {m}" for m in METRICS)
RANKED = RESULTS + f", means as (select model, {MEANS} from results group by model), ranked as (select *, 0.25::double * accuracy + 0.2::double * f1_score + 0.2::double * roc_auc + 0.2::double * (1 - acer) + 0.15::double * (1 - eer) as score from means)"
MOMENTS = RESULTS + ", mo as (select model, count(*) as n, avg(accuracy) as mean, var_pop(accuracy) as var from results group by model)"
TEST_SUM = "select sum(n * mean) / sum(n) as grand, sum(n) as k, count(*) as g, sum(n * var) as w, sum(n * mean * mean) as sq from mo"


def tail_sql(tests: str) -> str:
    """Common table expressions that end in tails (id, p): P(F > f) of tests (id, f, df1, df2), by the continued fraction as a recursive query."""
    return f""", tests as ({tests})
, beta as (select id, df2::double / 2 as a, df1::double / 2 as b, df2::double / (df2 + df1 * f) as x from tests)
, sides as (select *, x < (a + 1) / (a + b + 2) as near, case when x < (a + 1) / (a + b + 2) then a else b end as p, case when x < (a + 1) / (a + b + 2) then b else a end as q,
  case when x < (a + 1) / (a + b + 2) then x else 1 - x end as z from beta)
, lentz as (select id, 1::bigint as j, 1.0::double as c, 1 / (1 - (p + q) * z / (p + 1)) as d, 1 / (1 - (p + q) * z / (p + 1)) as v, p, q, z from sides
  union all select id, j + 1, 1 + top / c, 1 / (1 + top * d), v * (1 + top / c) / (1 + top * d), p, q, z from (
    select *, case when (j + 1) % 2 = 0 then m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)) else -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)) end as top
    from (select *, (j + 1) // 2 as m from lentz where j < 400)))
, tails as (select s.id, case when near then part else 1 - part end as p from (
  select s.*, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * l.v / s.p as part from sides s join lentz l on l.id = s.id and l.j = 400) s)"""


def _time_stats(spark, d):  # noqa: ANN001, ANN202
    """Shares of two columns stand for the use of memory."""
    logs = b.epochs(spark, d).withColumns({"cpu_memory": F.col("val_accuracy") * 100, "gpu_memory": F.col("accuracy") * 100})
    columns = ("total", "mean", "longest", "mean_cpu_memory", "peak_cpu_memory", "mean_gpu_memory", "peak_gpu_memory")
    return r6(runs.time_stats(logs), *columns)


TIME_STATS = b.EPOCHS + """
select run_id, round(sum(seconds), 6) as total, round(avg(seconds), 6) as mean, round(max(seconds), 6) as longest,
  round(avg(val_accuracy * 100), 6) as mean_cpu_memory, round(max(val_accuracy * 100), 6) as peak_cpu_memory,
  round(avg(accuracy * 100), 6) as mean_gpu_memory, round(max(accuracy * 100), 6) as peak_gpu_memory
from epochs group by run_id"""


QUERIES = {
    "g01_flatten_results": (
        lambda spark, d: r6(compare.flatten_results(results(spark, d).select(*BY, F.struct("accuracy", "f1_score").alias("standard"), F.struct("acer", "eer").alias("biometric")), ["standard", "biometric"]), "accuracy", "f1_score", "acer", "eer"),
        RESULTS + f" select {KEYS}, round(accuracy, 6) as accuracy, round(f1_score, 6) as f1_score, round(acer, 6) as acer, round(eer, 6) as eer from results",
    ),
    "g02_best_by_metric": (
        lambda spark, d: r6(compare.best_by(results(spark, d).withColumns({m: F.round(m, 6) for m in METRICS}), {"accuracy": "max", "f1_score": "max", "acer": "min", "eer": "min"}, BY), "value"),
        RESULTS + ", v as (" + " union all ".join(f"select '{m}' as metric, {KEYS}, round({m}, 6) as value, {s}round({m}, 6) as o from results" for m, s in (("accuracy", "-"), ("f1_score", "-"), ("acer", ""), ("eer", ""))) + f") select metric, {KEYS}, value from (select *, row_number() over (partition by metric order by o, {KEYS}) as j from v) where j = 1",
    ),
    "g03_cross_dataset_rows": (
        lambda spark, d: results(spark, d).where("cross_dataset").select(*BY, F.round("accuracy", 6).alias("accuracy")),
        RESULTS + f" select {KEYS}, round(accuracy, 6) as accuracy from results where trained_on <> tested_on",
    ),
    "g04_cross_dataset_summary": (
        lambda spark, d: compare.cross_dataset_summary(results(spark, d)),
        RESULTS + ", x as (select model, trained_on, count(*) as tests, round_even(avg(accuracy), 4) as accuracy, round_even(avg(acer), 4) as acer, round_even(avg(eer), 4) as eer from results where cross_dataset group by model, trained_on) select *, row_number() over (order by accuracy desc, model, trained_on) = 1 as best from x",
    ),
    "g05_rank_models": (
        lambda spark, d: r6(compare.rank_models(results(spark, d)), *METRICS, "score"),
        RANKED + " select model, " + ", ".join(f"round({m}, 6) as {m}" for m in [*METRICS, "score"]) + ", (row_number() over (order by score desc, model))::int as rank from ranked",
    ),
    "g06_metric_pivot": (
        lambda spark, d: r6(compare.metric_pivot(results(spark, d), "accuracy", DATASETS), *DATASETS),
        RESULTS + " select model, " + ", ".join(f"round(avg(accuracy) filter (where tested_on = '{x}'), 6) as {x}" for x in DATASETS) + " from results group by model",
    ),
    "g07_strict_pivot": (
        lambda spark, d: r6(compare.metric_pivot(results(spark, d).where("trained_on = 'ds0'"), "eer", DATASETS, strict=True), *DATASETS),
        RESULTS + " select model, " + ", ".join(f"round(max(eer) filter (where tested_on = '{x}'), 6) as {x}" for x in DATASETS) + " from results where trained_on = 'ds0' group by model",
    ),
    "g08_cross_mean": (
        lambda spark, d: r6(compare.cross_mean(results(spark, d)), "mean"),
        RESULTS + " select model, round(avg(accuracy), 6) as mean, (row_number() over (order by avg(accuracy) desc, model))::int as place from results where cross_dataset group by model",
    ),
    "g09_box_stats": (
        lambda spark, d: r6(compare.box_stats(results(spark, d)), "q1", "median", "q3", "low", "high"),
        RESULTS + ", q as (select model, quantile_cont(accuracy, 0.25) as q1, quantile_cont(accuracy, 0.5) as median, quantile_cont(accuracy, 0.75) as q3 from results group by model), z as (select r.model, r.accuracy, q.q1, q.median, q.q3, r.accuracy between q1 - 1.5::double * (q3 - q1) and q3 + 1.5::double * (q3 - q1) as i from results r join q using (model)) select model, round(max(q1), 6) as q1, round(max(median), 6) as median, round(max(q3), 6) as q3, round(min(accuracy) filter (where i), 6) as low, round(max(accuracy) filter (where i), 6) as high, count(*) filter (where not i) as outliers from z group by model",
    ),
    "g10_radar": (
        lambda spark, d: r6(compare.radar(results(spark, d), METRICS), "mean"),
        RESULTS + " " + " union all ".join(f"select model, '{m}' as metric, round(avg({m}), 6) as mean from results group by model" for m in METRICS),
    ),
    "g11_anova_f": (
        lambda spark, d: r6(compare.anova(results(spark, d)).select("groups", "f", "df1", "df2"), "f"),
        MOMENTS + f" select g as groups, round(((sq - k * grand * grand) / (g - 1)) / (w / (k - g)), 6) as f, g - 1 as df1, (k - g)::bigint as df2 from ({TEST_SUM})",
    ),
    "g11_anova": (
        lambda spark, d: r6(compare.anova(results(spark, d)), "f").withColumn("p", F.round("p", 9)),
        "recursive " + MOMENTS + tail_sql(f"select 1 as id, ((sq - k * grand * grand) / (g - 1)) / (w / (k - g)) as f, g - 1 as df1, (k - g)::bigint as df2 from ({TEST_SUM})")
        + f" select g as groups, round(f, 6) as f, df1, df2, round(p, 9) as p, p < 0.05 as significant from tests join tails using (id) cross join ({TEST_SUM})",
    ),
    "g12_pairwise_t": (
        lambda spark, d: r6(compare.pairwise_ttest(results(spark, d)).select("a", "b", "t", "df", "mean_diff"), "t", "mean_diff"),
        MOMENTS + " select x.model as a, y.model as b, round((x.mean - y.mean) / sqrt((x.n * x.var + y.n * y.var) / (x.n + y.n - 2) * (1.0::double / x.n + 1.0::double / y.n)), 6) as t, x.n + y.n - 2 as df, round(x.mean - y.mean, 6) as mean_diff from mo x join mo y on x.model < y.model",
    ),
    "g12_pairwise_ttest": (
        lambda spark, d: r6(compare.pairwise_ttest(results(spark, d)), "t", "mean_diff").withColumn("p", F.round("p", 9)),
        "recursive " + MOMENTS + """, pairs as (select x.model || ' ' || y.model as id, x.model as a, y.model as b, x.n + y.n - 2 as df, x.mean - y.mean as mean_diff,
      (x.mean - y.mean) / sqrt((x.n * x.var + y.n * y.var) / (x.n + y.n - 2) * (1.0::double / x.n + 1.0::double / y.n)) as t from mo x join mo y on x.model < y.model)"""
        + tail_sql("select id, t * t as f, 1 as df1, df as df2 from pairs") + " select a, b, round(t, 6) as t, df, round(mean_diff, 6) as mean_diff, round(p, 9) as p, p < 0.05 as significant from pairs join tails using (id)",
    ),
    "g13_cohens_d": (
        lambda spark, d: r6(compare.cohens_d(results(spark, d).where("model in ('m0', 'm3')")), "d"),
        MOMENTS + ", z as (select (x.mean - y.mean) / sqrt((x.var + y.var) / 2) as d from mo x, mo y where x.model = 'm0' and y.model = 'm3') select 'm0' as a, 'm3' as b, round(d, 6) as d, case when abs(d) < 0.5 then 'small' when abs(d) < 0.8 then 'medium' else 'large' end as size from z",
    ),
    "g14_summary_counts": (
        lambda spark, d: compare.summary_counts(results(spark, d)),
        RESULTS + " select count(*) as evaluations, count(distinct model) as models, count(distinct tested_on) as datasets, bool_or(cross_dataset) as any_cross from results",
    ),
    "g15_mean_over_sources": (
        lambda spark, d: r6(compare.mean_by_model(results(spark, d), METRICS), *METRICS),
        RESULTS + " select model, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in METRICS) + " from results group by model",
    ),
    "x_confidence_interval": (
        lambda spark, d: r6(compare.confidence_interval(results(spark, d), ["model"], "accuracy"), "mean", "low", "high"),
        RESULTS + " select model, count(accuracy) as n, round(avg(accuracy), 6) as mean, round(avg(accuracy) - 1.959964::double * stddev_samp(accuracy) / sqrt(count(accuracy)), 6) as low, round(avg(accuracy) + 1.959964::double * stddev_samp(accuracy) / sqrt(count(accuracy)), 6) as high from results group by model",
    ),
    "h01_run_summary": (
        lambda spark, d: r6(runs.run_summary(b.epochs(spark, d).select("run_id", "epoch", "loss", "val_loss", "val_accuracy")), "best_val_loss", "best_val_accuracy", "final_loss", "final_val_loss", "final_val_accuracy"),
        b.EPOCHS + " select run_id, count(*) as epochs, arg_min(epoch, (val_loss, epoch)) + 1 as best_epoch, round(min(val_loss), 6) as best_val_loss, round(max(val_accuracy), 6) as best_val_accuracy, round(arg_max(loss, epoch), 6) as final_loss, round(arg_max(val_loss, epoch), 6) as final_val_loss, round(arg_max(val_accuracy, epoch), 6) as final_val_accuracy from epochs group by run_id",
    ),
    "h02_early_stop": (
        lambda spark, d: r6(runs.early_stop(b.epochs(spark, d), 10), "best_value"),
        b.EPOCHS + """, a as (select *, val_loss < coalesce(min(val_loss) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding), 'infinity'::double) as better from epochs)
      , l as (select *, max(case when better then epoch end) over (partition by run_id order by epoch) as last from a), s as (select *, min(case when epoch - coalesce(last, -1) >= 10 then epoch end) over (partition by run_id) as stop from l)
      select run_id, max(stop) as stopped_epoch, arg_min(epoch, (val_loss, epoch)) as best_epoch, round(min(val_loss), 6) as best_value from s where stop is null or epoch <= stop group by run_id""",
    ),
    "h03_plateau_replay": (lambda spark, d: runs.plateau_replay(b.epochs(spark, d)), None),
    "h04_warmup_rates": (
        lambda spark, d: r6(runs.warmup_rates(b.epochs(spark, d).select("run_id", "epoch")), "warmup_lr"),
        b.EPOCHS + " select run_id, epoch, round(case when epoch < 5 then 1e-3 * (epoch + 1) / 5 else 1e-3 end, 6) as warmup_lr from epochs",
    ),
    "h05_generalisation_gap": (
        lambda spark, d: r6(runs.generalisation_gap(b.epochs(spark, d), ["loss", "accuracy"]), "train", "val", "gap"),
        b.EPOCHS + ", p as (select run_id, epoch, 'loss' as metric, loss as train, val_loss as val, val_loss as o from epochs union all select run_id, epoch, 'accuracy', accuracy, val_accuracy, -val_accuracy from epochs) select run_id, epoch, metric, round(train, 6) as train, round(val, 6) as val, round(val - train, 6) as gap, row_number() over (partition by run_id, metric order by o, epoch) = 1 as best from p",
    ),
    "h06_time_stats": (_time_stats, TIME_STATS),
    "h07_job_summary": (
        lambda spark, d: runs.job_summary(_runs(spark, d)).select("total", "successful", "failed", F.array_join("failed_jobs", ",").alias("failed_jobs"), F.round("success_rate", 6).alias("success_rate")),
        RUNS + " select count(*) as total, count(*) filter (where success) as successful, count(*) filter (where not success) as failed, string_agg(job_key, ',' order by job_key) filter (where not success) as failed_jobs, round(avg(success::int), 6) as success_rate from runs",
    ),
    "h08_best_runs": (
        lambda spark, d: r6(runs.best_runs(_runs(spark, d), ["dataset"]), "accuracy"),
        RUNS + " select dataset, job_key, round(a, 6) as accuracy from (select *, coalesce(accuracy, 0) as a, row_number() over (partition by dataset order by coalesce(accuracy, 0) desc, job_key) as j from runs where success) where j = 1",
    ),
    "h09_training_time": (
        lambda spark, d: r6(runs.training_time(_runs(spark, d)), "total", "mean", "shortest", "longest"),
        RUNS + " select round(sum(training_time), 6) as total, round(avg(training_time), 6) as mean, min(training_time) as shortest, max(training_time) as longest from runs where success",
    ),
    "h10_metrics_comparison": (
        lambda spark, d: r6(compare.best_by(results(spark, d).where("not cross_dataset").withColumns({m: F.round(m, 6) for m in METRICS}), {"accuracy": "max", "acer": "min", "eer": "min"}, ["model", "tested_on"]), "value"),
        RESULTS + ", v as (" + " union all ".join(f"select '{m}' as metric, model, tested_on, round({m}, 6) as value, {s}round({m}, 6) as o from results where not cross_dataset" for m, s in (("accuracy", "-"), ("acer", ""), ("eer", ""))) + ") select metric, model, tested_on, value from (select *, row_number() over (partition by metric order by o, model, tested_on) as j from v) where j = 1",
    ),
    "h11_best_trial": (
        lambda spark, d: runs.best_trial(_trials(spark, d)).select("number", F.round("value", 6).alias("value"), F.col("params")["lr"].alias("lr")),
        "select event_id as number, round(value, 6) as value, props as lr from (select *, row_number() over (order by value, event_id) as j from events where event_type <> 'error') where j = 1",
    ),
    "a07_run_catalog": (lambda spark, d: runs.run_catalog(_paths(spark, d), MODELS), CHOSEN + " select * from catalog"),
    "a08_select_runs": (
        lambda spark, d: runs.select_runs(runs.run_catalog(_paths(spark, d), MODELS), "beta_1"),
        CHOSEN + " select * from catalog where model = 'beta_1'",
    ),
    "b19_name_split": (
        lambda spark, d: results(spark, d).select(F.concat("model", F.lit("_trained_on_"), "trained_on").alias("name")).distinct().select("name", F.split("name", "_trained_on_")[0].alias("model"), F.split("name", "_trained_on_")[1].alias("dataset")),
        RESULTS + " select distinct model || '_trained_on_' || trained_on as name, model, trained_on as dataset from results",
    ),
}
