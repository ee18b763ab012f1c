"""Layouts of the event views and the flag table.

Each layout is range-partitioned by its own clustering order, so a busy author, minute or hour
spreads over several files and every file covers a narrow range for min/max skipping.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidewatch import schemas
from tidewatch.functions.times import bucket_hour, bucket_minute


def by_did(events: DataFrame) -> DataFrame:
    return events.select(*schemas.BY_DID)


def by_minute(events: DataFrame) -> DataFrame:
    return (events.withColumn("bucket_minute", bucket_minute(F.col("received_at")))
            .select(*schemas.BY_MINUTE))


def dated(view: DataFrame) -> DataFrame:
    """Rows of the minute view with the day that names their folder."""
    return view.withColumn("bucket_date", F.to_date("bucket_minute"))


def flagged(hits: DataFrame) -> DataFrame:
    """Hits that carry their event's columns, as rows of the flag table."""
    return (hits.withColumn("bucket_hour", bucket_hour(F.col("received_at")))
            .select(*schemas.FLAGGED.fieldNames()))


#: Rows that one task sorts and writes, where there are more than the session's partitions take.
TASK_ROWS = 4_000_000


#: Takes rows in their ranges, in which all rows of a key lie together, and returns those to write.
Choice = Callable[[DataFrame], DataFrame]


def lay_by_did(view: DataFrame, rows: int = 0, choose: Choice | None = None) -> DataFrame:
    return _laid(view, ["did", F.desc("received_at"), "id"], rows, choose)


def lay_by_minute(view: DataFrame, rows: int = 0, choose: Choice | None = None) -> DataFrame:
    return _laid(dated(view), ["kind", "bucket_minute", F.desc("received_at"), "id"], rows, choose)


def lay_flagged(flags: DataFrame, rows: int = 0, choose: Choice | None = None) -> DataFrame:
    # A directory per hour would hold tiny files; within a day the hour is found by min/max.
    dated = flags.withColumn("bucket_date", F.to_date("bucket_hour"))
    return _laid(dated, ["bucket_hour", F.desc("received_at"), "id", "rule_id"], rows, choose)


def _laid(df, order, rows, choose):
    """The number of ranges follows the rows; few rows are left to the session's own number, which
    adaptive execution lessens. A choice by keys is made inside of the ranges, without a shuffle of its own."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-rows // TASK_ROWS)
    ranged = (df.repartitionByRange(needed, *order) if needed > usual
              else df.repartitionByRange(*order))
    return (choose(ranged) if choose else ranged).sortWithinPartitions(*order)
