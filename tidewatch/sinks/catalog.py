"""The same tables in the catalog: managed, with the author view in buckets by author.

A read of one author opens one bucket of each set, whatever the number of authors; joins and groupings by
author need no shuffle within a set. Sets are the first partition column of each table and are named by the same
commit log as those of `TableSink`, so order of arrival, replays, whole batches and compaction work alike.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.plans.durable import CODEC, removed, written
from tidewatch.plans.layout import TASK_ROWS
from tidewatch.sinks.commits import CommitLog, Written
from tidewatch.sinks.tables import (BY_DID_TABLE, BY_MINUTE_TABLE, FLAGGED_TABLE, FULL, SET, TABLES,
                                    TableSink, _last)

BUCKETS = 64


def create_tables(spark: SparkSession, database: str, buckets: int = BUCKETS) -> None:
    """Create the database and its three tables where they do not exist yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    lists = "langs ARRAY<STRING>, links ARRAY<STRING>, created_at TIMESTAMP"
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {database}.{BY_DID_TABLE} (
        did STRING, received_at TIMESTAMP, id STRING, kind STRING, text STRING, {lists}, {SET} STRING)
        USING parquet OPTIONS (compression = '{CODEC}') PARTITIONED BY ({SET})
        CLUSTERED BY (did) SORTED BY (did, received_at, id) INTO {buckets} BUCKETS""")
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {database}.{BY_MINUTE_TABLE} (
        bucket_minute TIMESTAMP, received_at TIMESTAMP, id STRING, did STRING, text STRING,
        {lists}, {SET} STRING, kind STRING, bucket_date DATE)
        USING parquet OPTIONS (compression = '{CODEC}') PARTITIONED BY ({SET}, kind, bucket_date)""")
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {database}.{FLAGGED_TABLE} (
        received_at TIMESTAMP, id STRING, rule_id STRING, did STRING, kind STRING, text STRING,
        severity STRING, reason STRING, evidence MAP<STRING, STRING>, bucket_hour TIMESTAMP,
        {SET} STRING, bucket_date DATE)
        USING parquet OPTIONS (compression = '{CODEC}') PARTITIONED BY ({SET}, bucket_date)""")


class CatalogSink(TableSink):
    """Writes and reads the tables of `database`, which it creates. A table that is there keeps its number of
    buckets."""

    def __init__(self, spark: SparkSession, database: str, mode: str = FULL, unique: bool = False,
                 buckets: int = BUCKETS):
        create_tables(spark, database, buckets)
        about = spark.sql(f"DESCRIBE DATABASE {database}").collect()
        super().__init__({r[0]: r[1] for r in about}["Location"], mode, unique)
        self.database = database
        detail = spark.sql(f"DESCRIBE EXTENDED {self._name(BY_DID_TABLE)}").collect()
        self.buckets = int({r[0]: r[1] for r in detail}["Num Buckets"])

    def _name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def _log(self, spark: SparkSession) -> CommitLog:
        return CommitLog(spark, f"{self.folder}/_commits")

    def _location(self, spark: SparkSession, table: str) -> str:
        detail = spark.sql(f"DESCRIBE EXTENDED {self._name(table)}").collect()
        return {r[0]: r[1] for r in detail}["Location"]

    def _laid(self, df: DataFrame, table: str, rows: int, once: bool = True) -> DataFrame:
        """Rows of one bucket go to one task; those of an author who has more rows than a task sorts go to several, by
        a salt that is the author's alone, and become several files of the bucket."""
        if table != BY_DID_TABLE:
            return super()._laid(df, table, rows, once)
        df = df if once else _last(df, table)
        bucket, salt, parts = F.pmod(F.hash("did"), F.lit(self.buckets)), F.lit(0), self.buckets
        if rows > TASK_ROWS:
            busy = written(df.groupBy("did").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TASK_ROWS),
                           "busy-authors")
            # Each has more than TASK_ROWS rows, which bounds their number and what is broadcast.
            df = df.join(F.broadcast(busy), "did", "left").select(*df.columns, "_n")
            splits = F.ceil(F.coalesce("_n", F.lit(0)) / TASK_ROWS) + 1
            salt = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("id"), splits)).otherwise(0)
            parts = max(parts, 2 * -(-rows // TASK_ROWS))
        laid = df.repartition(parts, bucket, salt).sortWithinPartitions("did", "received_at", "id")
        return laid.select(*TABLES[table][0])

    def _store(self, df: DataFrame, one: Written) -> None:
        table = df.sparkSession.table(self._name(one.table))
        df.withColumn(SET, F.lit(one.name)).select(*table.columns).write.insertInto(self._name(one.table))

    def _remove(self, spark: SparkSession, table: str, name: str) -> None:
        location = self._location(spark, table)
        # A metastore that knows partitions forgets them; the files go in any case.
        spark.sql(f"ALTER TABLE {self._name(table)} DROP IF EXISTS PARTITION ({SET} = '{name}')")
        removed(spark, f"{location}/{SET}={name}")
        spark.catalog.refreshTable(self._name(table))

    def _sets(self, spark: SparkSession, table: str, sets: list[Written]) -> DataFrame:
        rows = spark.table(self._name(table)).filter(F.col(SET).isin([s.name for s in sets]))
        return rows.select(*TABLES[table][0], SET)
