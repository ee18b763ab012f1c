"""Exact running totals per key, whatever the size of the largest key.

A plain window puts all rows of a key into one task. Here the sizes of the keys are
counted first (a narrow scan, combined before its shuffle). Keys of ordinary size take the
plain window. A key above `max_rows` is range-partitioned by its own order instead, so that
it spreads over many tasks; each slice is summed on its own and then lifted by the total of
the slices before it.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.plans.durable import written

MAX_ROWS = 5_000_000
MAX_LARGE_KEYS = 100_000


def row_numbers(df: DataFrame, keys: list[str], order: list, name: str,
                max_rows: int = MAX_ROWS) -> DataFrame:
    return running_total(df, keys, order, F.lit(1), name, max_rows)


def running_total(df: DataFrame, keys: list[str], order: list, value: Column, name: str,
                  max_rows: int = MAX_ROWS) -> DataFrame:
    """Add `name`: the sum of a whole-number `value` up to and including each row.

    `order` holds column names or columns; a null key is a key like any other.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    limit, slices = size_limit(sizes, max_rows)
    if limit is None:
        return window_total(df, keys, order, value, name)
    large = written(sizes.filter(F.col("size") > limit).select(*keys), "large-keys")
    usual = _broadcast_join(df, large, keys, "left_anti")
    hot = _broadcast_join(df, large, keys, "left_semi")
    return (window_total(usual, keys, order, value, name)
            .unionByName(sliced_total(hot, keys, order, value, name, slices)))


def size_limit(sizes: DataFrame, max_rows: int) -> tuple[int | None, int]:
    """The size above which a key counts as large (None when none does), and a slice count.

    Keys above the limit number at most total / limit, hence at most MAX_LARGE_KEYS, which
    bounds what is broadcast.
    """
    largest, total = sizes.agg(F.max("size"), F.sum("size")).first()
    limit = max(max_rows, (total or 0) // MAX_LARGE_KEYS)
    if not total or largest <= limit:
        return None, 0
    shuffles = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return limit, max(shuffles, 2 * total // max_rows)


def window_total(df: DataFrame, keys: list[str], order: list, value: Column,
                 name: str) -> DataFrame:
    """The running total by a plain window: for keys of bounded size."""
    upto = (Window.partitionBy(*keys).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.sum(value).over(upto).cast("long"))


def sliced_total(df: DataFrame, keys: list[str], order: list, value: Column, name: str,
                 slices: int) -> DataFrame:
    """The running total by `slices` ranges of the order: for keys of any size."""
    # `_row` parts rows that are equal in every key and order column.
    laid = written(df.withColumn("_value", value)
                   .withColumn("_row", F.monotonically_increasing_id())
                   .repartitionByRange(slices, *keys, *order, "_row")
                   .withColumn("_slice", F.spark_partition_id()), "slices")
    sums = laid.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum"))
    earlier = (Window.partitionBy(*keys).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    # Only a key that crosses a slice border has an earlier slice: fewer rows than slices. They are written, so that
    # Catalyst knows their size and broadcasts them only where they are few.
    before = written(sums.withColumn("_before", F.sum("_sum").over(earlier))
                     .filter("_before IS NOT NULL").drop("_sum"), "slice-offsets")
    return (window_total(laid, [*keys, "_slice"], [*order, "_row"], F.col("_value"), "_local")
            .transform(_null_safe_join, before, [*keys, "_slice"], "left")
            .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
            .select(*df.columns, name))


def _broadcast_join(df: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join a side of bounded size on keys that may be null."""
    return _null_safe_join(df, F.broadcast(small), keys, how)


def _null_safe_join(df: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = small.withColumnsRenamed({key: f"_small_{key}" for key in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_small_{k}")) for k in keys])
    return df.join(renamed, same, how)
