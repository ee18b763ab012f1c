"""Packing by power-of-two decomposition.

The ids of a document are cut into one piece of the greatest length for each time that fits, and then
one piece for each bit of the rest, from the longest down. Every length is a power of two. A piece is a
sequence of its own: equal lengths form a bucket, batches are drawn from one bucket, nothing is padded,
and no sequence crosses documents. The buckets lie in folders by length.

Sequences are numbered bucket by bucket, from the shortest, and within a bucket by the part and place
where they were written.

Edge cases: null and empty texts have the end id alone, a piece of length 1; rows with null or
repeated ids are packed like any other; an empty table gives no piece.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.frames import texts
from tidewatch.llm.token_ids import crc32, encoder, slices, with_end

SCHEMA = ("doc_id long, start long, ids_crc32 long, doc_tokens long, part int, place long, "
          "tokens array<int>, length int")


def pieces(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of documents of `sizes` ids, in order: of which document each is, and its length.
    `longest` is a power of two."""
    every = np.arange(len(sizes))
    owners, lengths = [np.repeat(every, sizes // longest)], [np.full((sizes // longest).sum(), longest)]
    length = longest >> 1
    while length:
        having = every[(sizes & length) > 0]
        owners.append(having)
        lengths.append(np.full(len(having), length))
        length >>= 1
    owner, length = np.concatenate(owners), np.concatenate(lengths)
    order = np.argsort(owner, kind="stable")  # falling lengths within a document
    return owner[order], length[order]


def write_sequences(df: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end: int = 2,
                    longest: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text of `df`, append `end`, and write its pieces under `path/length=N`."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the greatest length is a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(vocabulary), TaskContext.get().partitionId()
        placed: dict[int, int] = {}
        for batch in batches:
            for rows in slices(batch):
                ids, ends = with_end(*tool.encode(rows["text"]), end)
                sizes = np.diff(ends)
                owner, length = pieces(sizes, longest)
                cuts = np.concatenate([[0], np.cumsum(length)])
                place = np.zeros(len(length), dtype=np.int64)
                for each in np.unique(length).tolist():
                    same = np.flatnonzero(length == each)
                    place[same] = placed.get(each, 0) + np.arange(len(same))
                    placed[each] = placed.get(each, 0) + len(same)
                sums = [crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"].take(pa.array(owner)), pa.array(cuts[:-1] - ends[owner]),
                     pa.array(sums, pa.int64()), pa.array(sizes[owner]),
                     pa.array(np.full(len(length), part, dtype=np.int32)), pa.array(place), lists,
                     pa.array(length.astype(np.int32))],
                    names=["doc_id", "start", "ids_crc32", "doc_tokens", "part", "place", "tokens",
                           "length"])

    (texts(df, id_col, text_col).mapInArrow(run, SCHEMA).write.partitionBy("length")
     .option("compression", "zstd").parquet(path))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """The buckets: the ids of each piece with its `length`, which prunes folders."""
    return spark.read.schema(SCHEMA).parquet(path)


def packed(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset` of every piece. The ids are
    not read. One row for each part and length is summed up to number the sequences."""
    found = sequences(spark, path).drop("tokens")
    counts = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("total"))
    shorter = F.coalesce(F.sum("total").over(Window.orderBy("length").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = (counts.select("length", "part", earlier.alias("earlier"))
               .join(totals.select("length", shorter.alias("shorter")), "length"))
    return found.join(offsets, ["length", "part"]).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("shorter") + F.col("earlier") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
