"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents long, so the sketch is taken of the item: the k smallest hashes of its
word shingles (bottom-k MinHash). Items are partitioned by size, and each partition has its own k: one
more than the shingles that an item of the partition's greatest size may lack at the wanted
containment. A document that contains the item to that degree lacks fewer, so it has at least one
sketch value among its own shingles, however long it is: no match is missed. Candidates are then
verified by exact containment over the shingles themselves.

Words are runs of letters, digits and underscores, in lower case. Items of fewer words than a shingle
have one shingle, the whole item, which is looked for as such. Items without words match nothing.

While the sketches and the shingles of all items stay under `LOCAL_SHINGLES`, tasks hold them and each
document is searched where it is read. Beyond that size, shingle hashes are shuffled and joined; both
ways give the same rows.

Edge cases: null and empty texts match nothing; equal items each match; rows that repeat a document id
count as one document for each text and give one row for each id and item, with the highest
containment; null ids are kept as an id; empty tables give no rows.
"""

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.frames import texts
from tidewatch.plans.durable import written

WORDS = re.compile(r"\w+").findall
#: Shingles of all items together that tasks may hold: about 100 bytes each.
LOCAL_SHINGLES = 1_000_000

HITS = "doc_id long, item_id long, n_shingles int, n_shared int, containment double"


def item_shingles(text: str, width: int) -> set[str]:
    words = WORDS(text.lower())
    width = min(width, len(words))
    return {" ".join(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()


def lacking(n: int, least: float) -> int:
    """How many of `n` shingles a document may lack at a containment of `least`."""
    return n - math.ceil(round(n * least, 9))


def size_class(n: int) -> int:
    """Partitions by powers of two: the greatest size of the one that holds `n`."""
    return (1 << n.bit_length()) - 1


def hashed(shingle: str) -> int:
    """Signed 64 bits."""
    return xxhash.xxh64_intdigest(shingle) - (1 << 63)


def sketched(items: DataFrame, width: int, least: float) -> DataFrame:
    """`item_id, size, shingle, hash, in_sketch` for every shingle of every item."""
    schema = "item_id long, size int, shingle string, hash long, in_sketch boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                found = item_shingles(text, width)
                k = lacking(size_class(len(found)), least) + 1
                for rank, (h, s) in enumerate(sorted((hashed(s), s) for s in found)):
                    rows.append((item, len(found), s, h, rank < k))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["item_id", "size", "shingle", "hash", "in_sketch"])

    return items.mapInArrow(run, schema)


class Index:
    """All items, for one task: sketch values, and the shingles that verify."""

    def __init__(self, rows: list, width: int, least: float):
        self.width, self.least = width, least
        self.size: dict = {}
        self.shingles: dict = defaultdict(set)
        self.by_value: dict = defaultdict(set)
        for item, size, shingle, value, in_sketch in rows:
            self.size[item] = size
            self.shingles[item].add(shingle)
            if in_sketch:
                self.by_value[shingle].add(item)
        self.widths = sorted({s.count(" ") + 1 for s in self.by_value})
        # Documents are looked through word by word; only words that begin a sketch value go on.
        self.first = {s.split(" ", 1)[0] for s in self.by_value}

    def matches(self, text: str) -> Iterator[tuple]:
        words = WORDS(text.lower())
        first, by_value = self.first, self.by_value
        starts = [i for i, w in enumerate(words) if w in first]
        found = set()
        for width in self.widths:
            for i in starts:
                value = by_value.get(" ".join(words[i:i + width]))
                if value and i + width <= len(words):
                    found |= value
        if not found:
            return
        own = {w: {" ".join(words[i:i + w]) for i in range(len(words) - w + 1)}
               for w in self.widths}
        every = set().union(*own.values())
        for item in found:
            shared = len(self.shingles[item] & every)
            if shared >= self.size[item] - lacking(self.size[item], self.least):
                yield item, self.size[item], shared


def contaminated(df: DataFrame, items: DataFrame, width: int = 5, least: float = 0.8,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", local: int = LOCAL_SHINGLES) -> DataFrame:
    """`HITS`: the documents that hold at least `least` of the shingles of an item, and which item."""
    docs = texts(df, id_col, text_col)
    keyed = texts(items, item_col, item_text_col)
    # Items are known by a number of their own, so that null and repeated ids keep apart.
    numbered = written(keyed.withColumn("key", F.monotonically_increasing_id()), "items")
    marked = written(sketched(numbered.select(F.col("key").alias("doc_id"), "text"), width, least),
                     "item-shingles")
    if marked.count() <= local:
        found = _local(docs, marked, width, least)
    else:
        found = _joined(docs, marked, width, least)
    names = numbered.select("key", F.col("doc_id").alias("name"))
    return (found.join(names, found["item_id"] == names["key"])
            .groupBy("doc_id", F.col("name").alias("item_id"))
            .agg(F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"),
                                "n_shingles", "n_shared")).alias("best"))
            .select("doc_id", "item_id", "best.n_shingles", "best.n_shared", "best.containment"))


def _local(docs: DataFrame, marked: DataFrame, width: int, least: float) -> DataFrame:
    # Bounded by `local` rows, counted before.
    rows = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in marked.collect()])
    built: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Index(rows.value, width, least))
        for batch in batches:
            out = [(doc, *hit) for doc, text in zip(batch["doc_id"], batch["text"])
                   for hit in built[0].matches(text.as_py())]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.as_py() for x in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()),
                 *[pa.array(c, pa.int32()) for c in columns[2:]]],
                names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return docs.mapInArrow(run, "doc_id long, item_id long, n_shingles int, n_shared int")


def _joined(docs: DataFrame, marked: DataFrame, width: int, least: float) -> DataFrame:
    """The same over shuffles: shingle hashes of documents meet sketch values, then all shingles."""
    lengths = sorted(r[0] for r in marked.select(
        (F.size(F.split("shingle", " "))).alias("w")).distinct().collect())  # at most `width` rows
    lengths = lengths or [width]
    keyed = written(docs.withColumn("row", F.monotonically_increasing_id()), "documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                words = WORDS(text.as_py().lower())
                found = list({" ".join(words[i:i + w]) for w in lengths
                              for i in range(len(words) - w + 1)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), row.as_py())), pa.array(found, pa.string())],
                    names=["row", "shingle"])

    own = written(keyed.select("row", "text").mapInArrow(run, "row long, shingle string"),
                  "document-shingles")
    sketch = written(marked.filter("in_sketch").select("item_id", "shingle"), "sketches")
    pairs = written(own.join(sketch, "shingle").select("row", "item_id").distinct(), "candidates")
    wanted = written(pairs.join(marked.select("item_id", "size", "shingle"), "item_id"), "wanted")
    counted = (wanted.join(own, ["row", "shingle"]).groupBy("row", "item_id", "size")
               .agg(F.count(F.lit(1)).cast("int").alias("n_shared")))
    enough = counted.filter(F.col("n_shared") >= F.ceil(F.round(F.col("size") * least, 9)))
    return (enough.join(keyed.select("row", "doc_id"), "row")
            .select("doc_id", "item_id", F.col("size").alias("n_shingles"), "n_shared"))


def clean(df: DataFrame, items: DataFrame, width: int = 5, least: float = 0.8,
          id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of `df` that hold no item."""
    found = contaminated(df, items, width, least, id_col, text_col, **names)
    hits = written(found.select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    return df.join(hits, df[id_col].cast("long").eqNullSafe(hits["_hit"]), "left_anti")
