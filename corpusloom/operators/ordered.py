"""Row numbers and running sums over a whole table, without a window that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1000


def by_value(key: str, df: DataFrame, buckets: int = BUCKETS) -> Column:
    """An order-keeping bucket of a numeric or string key, between approximate quantiles of its values in ``df``, so
    that buckets hold about as many rows wherever the keys lie: ``buckets`` values reach the driver. Nulls come first."""
    if dict(df.dtypes)[key] == "string":
        # Strings have no quantiles; those of a hash sample stand in, and every bucket still keeps the order.
        size = df.count()
        part = df.select(key).where(F.pmod(F.xxhash64(key), F.lit(max(1, size // (20 * buckets)))) == 0) if size else df.select(key)
        found = sorted({r[0] for r in part.where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key)).limit(20 * buckets).collect()})
        edges = found[:: max(1, len(found) // buckets)]
    else:
        edges = sorted(set(df.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] or []))
    if not edges:
        return F.lit(0).cast("long")
    table = F.array(*(F.lit(x) for x in edges))
    # How many edges are at or below the key, by halving.
    steps = max(1, len(edges).bit_length())
    halve = lambda s, _: F.when(s["lo"] < s["hi"], F.when(F.get(table, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= F.col(key), F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))).otherwise(s)
    found_at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi")), halve, lambda s: s["lo"].cast("long"))
    return F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(found_at)


def running_sum(df: DataFrame, bucket: Column, order: list[str], value: Column, name: str, through: bool = True) -> DataFrame:
    """Add the sum of ``value`` over the rows up to each one (or before it, unless ``through``) in the order of
    ``bucket`` and then ``order``, which must be total.

    Sums of buckets are combined map-side, running sums over them are a window over at most as many rows as
    there are buckets, and inside a bucket a window does the rest. ``bucket`` must take few values: BUCKETS and
    two by ``by_value``, whose sums are then small enough to broadcast.
    """
    df = df.withColumns({"_bucket": bucket, "_value": value.cast("long")})
    sums = df.groupBy("_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if through else -1)
    own = F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return df.join(F.broadcast(offsets), F.col("_bucket").eqNullSafe(F.col("_b"))).withColumn(name, F.col("_offset") + own).drop("_bucket", "_b", "_value", "_offset")


def row_numbers(df: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """Add row numbers from 1 in that order."""
    return running_sum(df, bucket, order, F.lit(1), name)
