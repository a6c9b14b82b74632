"""Hash order: the source of all randomness here, the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplekit.functions.parts import ROWS


def hash_key(seed: int, *keys: str | Column) -> Column:
    """md5 of the seed and the keys, as text; sorting by it is a shuffle that depends on the seed alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def hash_uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of the hash."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("double") / float(1 << 32)


def with_hash_rank(df: DataFrame, seed: int, key: str, by: list[str] | None = None, rank: str = "hash_rank", rows: int = ROWS) -> DataFrame:
    """df with its rank, from 1, in hash order within `by`, for groups of any size.

    A group is cut into ranges of the hash, one for `rows` of its rows, so that parts grow in number and not in size. Rows are counted by part, the counts are summed over
    the parts, and rows are ranked inside their part: no task sorts a whole group.
    """
    by = by or []
    parts = df.groupBy(*by).agg(F.ceil(F.count("*") / rows).alias("__parts")).select(*[F.col(c).alias(f"__n_{c}") for c in by], "__parts")
    own = df.join(parts, [F.col(c).eqNullSafe(F.col(f"__n_{c}")) for c in by] or F.lit(True)).withColumn("__hash", hash_key(seed, key))
    share = F.conv(F.substring("__hash", 1, 13), 16, 10).cast("double") / float(1 << 52)
    own = own.withColumn("__part", F.floor(share * F.col("__parts"))).select(*df.columns, "__hash", "__part")
    sizes = own.groupBy(*by, "__part").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__of"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__part").orderBy("__hash", key)
    ranked = own.withColumn("__within", F.row_number().over(inside))
    match = [F.col("__part") == F.col("__of"), *(F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by)]
    return ranked.join(offsets, match).withColumn(rank, (F.col("__before") + F.col("__within")).cast("long")).select(*df.columns, rank)
