"""Keyed upsert and newest-N-per-key."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.plans.durable import shuffles_removed
from tidewatch.plans.ordered import row_numbers

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each key.

    Spark drops rows past the limit before the shuffle, up to the limit set in
    `windowGroupLimitThreshold`. For a larger limit the rows are numbered without putting a large
    key into one task.
    """
    if limit > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        ranked = row_numbers(df, keys, order, "_rank")
    else:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ranked = df.withColumn("_rank", rank)
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def latest_by_key(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """One row per key, the one that arrived last. Equal arrivals go by the whole row."""
    rest = [F.map_entries(f.name) if f.dataType.typeName() == "map" else F.col(f.name)
            for f in df.schema if f.name not in keys]
    order = [F.col(c).desc() for c in arrival]
    return first_per_key(df, keys, [*order, F.xxhash64(*rest)] if rest else [*order, *keys], 1)


def repeats(df: DataFrame, keys: list[str]) -> bool:
    """Whether some key occurs twice: a pass over the key columns alone."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    with shuffles_removed(df.sparkSession):
        return not counts.filter("n > 1").isEmpty()
