"""Token ids in Parquet files that can be read in part.

A row is a document: its id, where its ids start, how many they are, and the ids as a list column. Rows
are in ascending order of the document id over the files in their order, so that row-group and page
statistics of the id select few pages. Ids are dictionary-encoded where that is smaller and plain or
delta-encoded otherwise (format version 2); the counts are delta-encoded. Row groups and pages are held
to sizes that are parameters. `metadata` reads no ids at all, `tokens` those of a range of documents.

Where a document's ids start in the whole is the sum over all parts before its own, one row per part,
plus its start within its part, which is in the file.

Edge cases: null and empty texts have the end id alone; rows that repeat an id stay, next to each
other; rows with a null id come first; an empty table gives files without rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.frames import texts
from tidewatch.llm.token_ids import crc32, encoder, slices, with_end

SCHEMA = "doc_id long, part int, first long, n_tokens long, tokens array<int>"


def encoded(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """`SCHEMA` for `docs(doc_id, text)`, in the order and partitions that they come in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, first = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch):
                ids, ends = with_end(*tool.encode(rows["text"]), end)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array(np.full(len(rows), part, dtype=np.int32)),
                     pa.array(first + ends[:-1]), pa.array(np.diff(ends)), lists],
                    names=["doc_id", "part", "first", "n_tokens", "tokens"])
                first += int(ends[-1])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(df: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end: int = 0,
                 row_group_bytes: int = 16 << 20, page_rows: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode every text of `df`, append `end`, and write the files under `path`."""
    ordered = (texts(df, id_col, text_col).repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id"))
    (encoded(ordered, vocabulary, end).write
     .option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#first", "false")
     .option("parquet.block.size", row_group_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .option("compression", "zstd").parquet(path))


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, part, first, n_tokens` of every document: the ids are not read."""
    return _read(spark, path).select("doc_id", "part", "first", "n_tokens")


def tokens(spark: SparkSession, path: str, low: int | None = None,
           high: int | None = None) -> DataFrame:
    """`doc_id, start, n_tokens, tokens` of the documents with ids from `low` to `high`. The range is
    pushed down to row groups and pages."""
    found = _read(spark, path)
    if low is not None:
        found = found.filter(F.col("doc_id") >= low)
    if high is not None:
        found = found.filter(F.col("doc_id") <= high)
    return _with_start(found, spark, path).select("doc_id", "start", "n_tokens", "tokens")


def _with_start(found: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """`start` from the sums of the parts before: one row for each part that was written."""
    sums = metadata(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    return (found.join(offsets, "part")
            .withColumn("start", F.col("first") + F.col("offset")).drop("offset"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document, from the files."""
    schema = "doc_id long, part int, first long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["tokens"]
            values = lists.values.to_numpy().astype("<u4", copy=False)
            ends = lists.offsets.to_numpy()
            sums = [crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["part"], batch["first"],
                 pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    found = _read(spark, path).select("doc_id", "part", "first", "tokens").mapInArrow(run, schema)
    return _with_start(found, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
