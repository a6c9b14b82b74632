"""The fixtures as views of the test tables, as DataFrames and as SQL with the same rows.

The SQL texts run in Spark and in DuckDB; each is a list of common table expressions that an oracle puts before its query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplekit.operators.sampling import with_exact_rank

SAMPLES = """samples as (
  select event_id as sample_id, user_id as group_id,
    case when user_id % 15 < 1 then 'ds0' when user_id % 15 < 3 then 'ds1' when user_id % 15 < 6 then 'ds2'
      when user_id % 15 < 10 then 'ds3' else 'ds4' end as dataset,
    case when event_type in ('error', 'purchase') then 1 else 0 end as label, ts,
    value as sharpness, cast(regexp_extract(props, '([0-9]+)', 1) as double) as contrast,
    cast((event_id * 37) % 256 as double) as mean_brightness, value * 2 as blur_score
  from events)"""
PREDICTIONS = SAMPLES + """, predictions as (
  select s.sample_id, m.model, t.trained_on, s.dataset as tested_on, s.label,
    cast((s.sample_id * 7919 + s.group_id * 104729 + m.i * 15485863) % 600
      + s.label * (100 * m.i + case when t.trained_on = s.dataset then 99 else 0 end) as double) / 999 as score
  from samples s
  cross join (select 0 as i, 'm0' as model union all select 1, 'm1' union all select 2, 'm2' union all select 3, 'm3') m
  cross join (select 'ds0' as trained_on union all select 'ds1' union all select 'ds2' union all select 'ds3' union all select 'ds4') t)"""
ODD_SCORES = SAMPLES + """, odd as (
  select sample_id, m.model, label, case m.model when 'flat' then 0.5e0 when 'near' then 0.5e0 + (sample_id % 7) * 1e-9
    when 'odds' then cast((sample_id * 7919) % 600 - 300 as double) / 50 + label * 0.7e0 else case when sample_id % 1009 = 0 then 1e12 else cast((sample_id * 7919) % 601 as double) / 601 end end as score
  from samples cross join (select 'flat' as model union all select 'near' union all select 'odds' union all select 'outlier') m)"""
QUALITY = SAMPLES + """, quality as (
  select *, 1 - abs(mean_brightness - 128) / 128 as brightness_score,
    0.35e0 * least(sharpness / 100, 1e0) + 0.25e0 * least(contrast / 50, 1e0) + 0.20e0 * (1 - abs(mean_brightness - 128) / 128)
      + 0.20e0 * least(blur_score / 100, 1e0) as composite_score,
    mean_brightness between 40 and 220 as brightness_ok, blur_score > 80 as is_sharp
  from samples)"""
MANIFEST = "manifest as (select user_id as video_id, count(*) as total_frames from events group by user_id)"
EPOCHS = """epochs as (
  select * from (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) - 1 as epoch,
    value as val_loss, cast((event_id * 37) % 256 as double) / 256 as val_accuracy, cast((event_id * 91) % 256 as double) / 256 as accuracy, value * 0.9e0 as loss,
    cast(event_id % 13 as double) as seconds from events) e)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("user_id") % 15
    source = F.when(part < 1, "ds0").when(part < 3, "ds1").when(part < 6, "ds2").when(part < 10, "ds3").otherwise("ds4")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("sample_id"), F.col("user_id").alias("group_id"), source.alias("dataset"),
        F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("label"), "ts",
        F.col("value").alias("sharpness"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("contrast"),
        (F.col("event_id") * 37 % 256).cast("double").alias("mean_brightness"), (F.col("value") * 2).alias("blur_score"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of four models, each trained on each of five sources, on all samples. Both literal lists are exploded in place."""
    own = samples(spark, sf_dir).withColumn("i", F.explode(F.array(*map(F.lit, range(4))))).withColumn("trained_on", F.explode(F.array(*(F.lit(f"ds{k}") for k in range(5)))))
    raw = (F.col("sample_id") * 7919 + F.col("group_id") * 104729 + F.col("i").cast("long") * 15485863) % 600
    bonus = F.col("label") * (100 * F.col("i") + F.when(F.col("trained_on") == F.col("dataset"), 99).otherwise(0))
    return own.select("sample_id", F.concat(F.lit("m"), "i").alias("model"), "trained_on", F.col("dataset").alias("tested_on"), "label", ((raw + bonus).cast("double") / 999).alias("score"))


def odd_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of models that are constant, nearly so, log odds, or have outliers: sample_id, model, label, score."""
    own = samples(spark, sf_dir).withColumn("model", F.explode(F.array(*map(F.lit, ("flat", "near", "odds", "outlier")))))
    i = F.col("sample_id")
    odds = ((i * 7919) % 600 - 300).cast("double") / 50 + F.col("label") * 0.7
    outlier = F.when(i % 1009 == 0, 1e12).otherwise(((i * 7919) % 601).cast("double") / 601)
    score = F.when(F.col("model") == "flat", 0.5).when(F.col("model") == "near", 0.5 + (i % 7) * 1e-9).when(F.col("model") == "odds", odds).otherwise(outlier)
    return own.select("sample_id", "model", "label", score.alias("score"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 gray images: sample_id, label, height, width, pixels."""
    pixel = F.transform("embedding", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((e.cast("double") + 1) * 127.5).cast("double"))))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), (F.col("label") % 2).alias("label"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixel.alias("pixels"))


IMAGES = """images as (select vec_id as sample_id, label % 2 as label,
  list_transform(embedding, lambda e: greatest(0.0::double, least(255.0::double, floor((e::double + 1) * 127.5::double)))) as pixels from embeddings)"""
DOCS = """docs as (select d.doc_id as sample_id, d.source as dataset, l.toxic as label, least(cast(d.n_chars as double) / 5000, cast(1 as double)) as quality
  from documents d join labels l on d.doc_id = l.doc_id)"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("dataset"), F.col("toxic").alias("label"), F.least(F.col("n_chars").cast("double") / 5000, F.lit(1.0)).alias("quality"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("video_id")).agg(F.count("*").alias("total_frames"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the epochs of a run, in the order of time; a run of any length is ranked in parts."""
    ranked = with_exact_rank(events(spark, sf_dir).withColumn("early", -F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id"], "early", "event_id")
    return ranked.selectExpr(
        "user_id as run_id", "rank - 1 as epoch", "value as val_loss",
        "cast((event_id * 37) % 256 as double) / 256 as val_accuracy", "cast((event_id * 91) % 256 as double) / 256 as accuracy", "value * 0.9D as loss", "cast(event_id % 13 as double) as seconds",
    )


def full(sql: str) -> str:
    """A whole statement of a text that begins with common table expressions, or is a query already."""
    return sql if sql.lstrip().lower().startswith(("select", "with")) else f"with {sql}"
