"""Events from files or streams, always with the fixed schema."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.schemas import EVENT

_BAD = "_corrupt_record"


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A batch of events. No schema is inferred; missing text, links and so on read as empty."""
    return filled(spark.read.schema(EVENT).options(**options).format(fmt).load(path))


def read_event_stream(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
                      **options) -> DataFrame:
    """An unbounded stream of events: files under `path`, or Kafka records with JSON values."""
    reader = spark.readStream.options(**options).format(fmt)
    if fmt == "kafka":
        return valid(parsed(reader.load().select(F.col("value").cast("string"))))
    return filled(reader.schema(EVENT).load(path))


def filled(events: DataFrame) -> DataFrame:
    """Null text, author, kind and lists as empty ones."""
    empty = {"did": F.lit(""), "kind": F.lit(""), "text": F.lit(""),
             "langs": F.array().cast("array<string>"), "links": F.array().cast("array<string>")}
    return events.withColumns({c: F.coalesce(c, v) for c, v in empty.items()})


def parsed(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON text as event columns, with the text itself in `_corrupt_record` where it is broken."""
    schema = EVENT.simpleString()[len("struct<"):-1]
    fields = f"{schema},{_BAD}:string"
    event = F.from_json(column, f"struct<{fields}>",
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    return (raw.select(F.coalesce(F.col(column), F.lit("")).alias("_raw"), event.alias("_event"))
            .select("_raw", "_event.*")
            .withColumn(_BAD, F.when(F.trim("_raw") == "", F.col("_raw")).otherwise(F.col(_BAD)))
            .drop("_raw"))


def valid(events: DataFrame) -> DataFrame:
    return filled(events.filter(F.col(_BAD).isNull()).drop(_BAD))


def quarantined(events: DataFrame) -> DataFrame:
    """The JSON texts that do not parse."""
    return events.filter(F.col(_BAD).isNotNull()).select(F.col(_BAD).alias("raw"))
