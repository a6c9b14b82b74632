"""Scans of image, video, dataset, statistics and log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from samplekit.sources import imagefiles

#: What is taken as an image or a video, in lower or in UPPER case.
IMAGES = ("png", "jpg", "jpeg", "bmp", "pgm", "ppm", "tiff", "tif")
VIDEOS = ("mp4", "avi", "mov", "mkv", "wmv", "flv", "webm")
HALVES = r"/(attack|bonafide)_(training|validation)/"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)  # type: ignore[union-attr]


def _glob(extensions: tuple[str, ...]) -> str:
    return "*.{" + ",".join([*extensions, *(e.upper() for e in extensions)]) + "}"


FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _files(spark: SparkSession, base: str, extensions: tuple[str, ...]) -> DataFrame:
    """Files of the four half directories under base, not of directories below them; none if base is missing."""
    halves = [h for h in (f"{base}/{c}_{s}" for c in ("attack", "bonafide") for s in ("training", "validation")) if _exists(spark, h)]
    if not halves:
        return spark.createDataFrame([], FILES)
    return spark.read.format("binaryFile").option("pathGlobFilter", _glob(extensions)).option("recursiveFileLookup", "false").load(halves)


def with_path_labels(df: DataFrame, path: str = "path") -> DataFrame:
    """df with label (attack 1, bonafide 0, else null) and split (training, validation) from its path."""
    kind = F.regexp_extract(path, HALVES, 1)
    split = F.regexp_extract(path, HALVES, 2)
    return df.withColumns({"label": F.when(kind == "attack", 1).when(kind == "bonafide", 0), "split": F.when(split != "", split)})


def scan_images(spark: SparkSession, base: str, dataset: str, part_bytes: int | None = None) -> DataFrame:
    """path, label, split, dataset, height, width, channels, pixels, reason of the images under base; pixels are blue, green, red, of gray images three equal ones.

    PNG, BMP and portable maps come from the "labelled_images" format, which lists only the directories that filters on label and split leave, in partitions of part_bytes; JPEG and TIFF
    files are decoded by Spark's image source. A file that can't be decoded has null pixels and a reason: see rejected_images.
    """
    imagefiles.register(spark)
    reader = spark.read.format("labelled_images").option("path", base)
    own = (reader.option("partBytes", part_bytes) if part_bytes else reader).load().withColumn("dataset", F.lit(dataset))
    columns = ["path", "label", "split", "dataset", "height", "width", "channels", "pixels", "reason"]
    halves = [h for h in (f"{base}/{c}_{s}" for c in ("attack", "bonafide") for s in ("training", "validation")) if _exists(spark, h)]
    if not halves:
        return own.select(*columns)
    raw = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", _glob(tuple(e for e in IMAGES if e not in imagefiles.EXTENSIONS))).load(halves)
    read = F.col("image.height") > 0
    of = lambda name: F.when(read, F.col(f"image.{name}"))
    rows = raw.select(F.col("image.origin").alias("path"), F.lit(dataset).alias("dataset"), of("height").alias("height"), of("width").alias("width"), of("nChannels").alias("channels"), of("data").alias("pixels"), F.when(~F.coalesce(read, F.lit(False)), "no codec decodes it").alias("reason"))
    return own.select(*columns).unionByName(with_path_labels(rows).select(*columns))


def readable_images(df: DataFrame) -> DataFrame:
    return df.where("pixels is not null")


def rejected_images(df: DataFrame) -> DataFrame:
    """path, reason."""
    return df.where("pixels is null").select("path", "reason")


def scan_videos(spark: SparkSession, base: str) -> DataFrame:
    """path, length, modificationTime, label, split of video files; their content isn't read."""
    return with_path_labels(_files(spark, base, VIDEOS).select("path", "length", "modificationTime"))


def read_dataset(spark: SparkSession, base: str, name: str, missing: str = "error", schema: StructType | str | None = None) -> DataFrame:
    """The rows of one dataset of a folder partitioned by dataset and split. missing: "error", or "skip" for an empty frame."""
    if missing not in ("error", "skip"):
        raise ValueError(f"missing must be error or skip: {missing}")
    found = _exists(spark, f"{base}/dataset={name}")
    if not found and missing == "error":
        raise FileNotFoundError(f"{base}/dataset={name}")
    if not _exists(spark, base):
        return spark.createDataFrame([], schema or "sample_id bigint, dataset string, split string")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(base).where(F.col("dataset") == name)


STATS = (
    "dataset_name string, creation_time timestamp, target_size array<int>, train_ratio double, quality_threshold double, total_samples bigint,"
    " train_samples bigint, test_samples bigint, train_bonafide bigint, train_attack bigint, test_bonafide bigint, test_attack bigint,"
    " train_balance_ratio double, test_balance_ratio double, data_type string, balanced boolean, quality_enhanced boolean, synthetic_data boolean,"
    " avg_train_quality double, avg_test_quality double, quality_std double, min_quality double, max_quality double"
)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics written by write_stats; no rows where there are none."""
    return spark.read.schema(STATS).json(path) if _exists(spark, path) else spark.createDataFrame([], STATS)


def read_epoch_logs(spark: SparkSession, path: str, metrics: list[str], run_column: bool = False) -> DataFrame:
    """run_id, epoch, metrics of CSV logs with a header. The run is a partition run_id of the folder, or else the file's name; run_column: a column run_id of files that hold many runs each."""
    schema = "run_id string, " * run_column + "epoch int, " + ", ".join(f"`{m}` double" for m in metrics)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    run = F.col("run_id").cast("string") if "run_id" in rows.columns else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return rows.select(run.alias("run_id"), "epoch", *metrics)


def read_history(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """run_id, epoch, metrics of JSON files that hold a list of values for each metric."""
    schema = ", ".join(f"`{m}` array<double>" for m in metrics)
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("run_id"), F.posexplode(F.arrays_zip(*metrics)).alias("epoch", "m"))
    return rows.select("run_id", "epoch", "m.*")
