"""What the operators of this folder share: reading tables, row-wise Arrow maps, small helpers."""

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns alone, `doc_id` and `text`, with null text as empty. Other columns go, so that
    none can clash with what an operator adds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def map_documents(df: DataFrame, schema: StructType | str,
                  function: Callable[[int | None, str], Iterable[tuple]]) -> DataFrame:
    """`function(doc_id, text)` over the columns `doc_id` and `text`; it yields rows of `schema`."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, strings = batch.column("doc_id"), batch.column("text")
            rows = [row for i in range(batch.num_rows)
                    for row in function(ids[i].as_py(), strings[i].as_py())]
            columns = list(zip(*rows)) or [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.select("doc_id", "text").mapInArrow(run, kind)


def smallest_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most `n` rows of `df`, those with the smallest hashes of `key`, whose values all differ. Rows that
    cannot be among them are left out before the sort, so that a task sends few of them."""
    total, place = df.count(), F.xxhash64(key)
    likely = n + 10 * n ** 0.5 + 10  # ten standard deviations above the rows that are wanted
    if total > likely:
        df = df.filter(place <= int(2 ** 64 * (likely / total)) - 2 ** 63)
    return df.orderBy(place, key).limit(n)
