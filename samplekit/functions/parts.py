"""Ranges of a value that hold about equally many rows, as columns: what exact ranks and running sums of groups of any size are built on.

Bounds are approximate quantiles of each group, so that outliers, infinities and any scale of the value leave the parts even. Their number is a power of two, at least
the session's shuffle partitions: it is that setting which grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ROWS = 1 << 17  # of a part in hash order
LEAST = 64


def part_count(spark: SparkSession) -> int:
    """A power of two, LEAST or more and no less than the shuffle partitions."""
    asked = int(spark.conf.get("spark.sql.shuffle.partitions", str(LEAST)))
    return 1 << (max(LEAST, asked) - 1).bit_length()


def quantile_bounds(value: Column, parts: int) -> Column:
    """Aggregate: the parts - 1 bounds between parts of a numeric value, ascending; errors of ranks are far below a part."""
    return F.percentile_approx(value, [k / parts for k in range(1, parts)], 32 * parts)


def part_of(bounds: Column, value: Column, parts: int) -> Column:
    """The number of bounds below the value, from 0, found by halving. A power of two, parts."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(parts.bit_length() - 1))))
    return F.aggregate(steps, F.lit(0), lambda low, step: low + F.when(F.get(bounds, low + step - 1) < value, step).otherwise(0))


def is_bound(bounds: Column, value: Column, part: Column) -> Column:
    """Whether the value makes up two bounds or more: more than a whole part of rows has it."""
    return (F.get(bounds, part) == value) & (F.get(bounds, part + 1) == value)


def text_code(key: Column, shared: Column) -> Column:
    """A number that grows with a text in the order of its bytes, of the six bytes behind the first `shared` characters."""
    own = F.rpad(F.hex(F.substring(F.encode(F.substr(key, shared + 1), "UTF-8"), 1, 6)), 12, "0")
    return F.conv(own, 16, 10).cast("double")


def shared_prefix(least: Column, largest: Column) -> Column:
    """Characters that the least and the largest of texts, and so all between them, begin with."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(least), F.length(largest))))
    same = F.filter(places, lambda p: (F.length(least) > 0) & (F.substr(least, F.lit(1), p) == F.substr(largest, F.lit(1), p)))
    return F.coalesce(F.array_max(same), F.lit(0))
