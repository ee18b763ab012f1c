"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits becomes a point of 32 numbers: the bits set in each of its 2-bit segments.
Flipping a bit moves one number by one, so the Manhattan distance of two points never exceeds the
bits in which their fingerprints differ. Points at distance 2 or less have a grid point within 1 of
both. Each point is therefore put on the grid points within 1 of it, and only fingerprints that meet
another one there go on: this is the range join, as a grouping that emits no pairs.

The exact check works the same way on the fingerprints themselves: two of them differ in at most 2
bits if and only if some 64-bit value is within one bit of both. Candidates that meet at such a value
are linked to the smallest one there, which joins the same components as all their pairs would.

Edge cases: null and empty texts have the fingerprint zero and are linked like any other; equal ids
and equal rows each keep their row; an empty table gives an empty result. Rows with a null id are
kept, and never name a component that has an id.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.llm.components import components
from tidewatch.llm.frames import fresh, map_documents, texts
from tidewatch.plans.durable import written

SEED = 42
SEGMENT_BITS = 2


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bit majority over the hashes of all word shingles, as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \t-\r, space only
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    width = min(shingle, len(words))
    starts = [0, *[e + 1 for e in ends[:len(words) - width]]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1:])),
                         dtype="<u8", count=len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """`doc_id, fp` for every row."""
    def one(doc_id, text) -> Iterator[tuple]:
        yield doc_id, fingerprint(text, shingle)

    return map_documents(texts(df, id_col, text_col), "doc_id long, fp long", one)


def segment_counts(fp: Column) -> Column:
    """The bits set in each 2-bit segment, packed in the same 2 bits."""
    def half(bits: Column) -> Column:  # 32 bits at a time, so that no difference leaves its range
        return bits - F.shiftrightunsigned(bits, 1).bitwiseAND(0x55555555)

    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(0xFFFFFFFF)
    return F.shiftleft(half(high), 32).bitwiseOR(half(low))


def _grid_points(point: Column) -> Column:
    """The point itself and those one step away: a count of 0 steps to 1, 1 to 0 and 2, 2 to 1."""
    steps = [point]
    for shift in range(0, 64, SEGMENT_BITS):
        count = F.shiftrightunsigned(point, shift).bitwiseAND(3)
        one, three = (F.shiftleft(F.lit(n).cast("long"), shift) for n in (1, 3))
        steps += [F.when(count < 2, point.bitwiseXOR(one)),
                  F.when(count > 0, point.bitwiseXOR(three))]
    return F.array_compact(F.array(*steps))


def _within_one_bit(fp: Column) -> Column:
    ones = [(1 << b) - (1 << 64) * (b == 63) for b in range(64)]
    return F.concat(F.array(fp), F.transform(F.array(*[F.lit(x).cast("long") for x in ones]),
                                             lambda bit: fp.bitwiseXOR(bit)))


def candidates(distinct: DataFrame) -> DataFrame:
    """The fingerprints of `distinct(fp)` with another one at Manhattan distance 2 or less."""
    placed = distinct.select("fp", F.explode(_grid_points(segment_counts(F.col("fp")))).alias("cell"))
    cell = Window.partitionBy("cell")
    return (placed.select("fp", (F.min("fp").over(cell) < F.max("fp").over(cell)).alias("met"))
            .filter("met").select("fp").distinct())


def links(distinct: DataFrame) -> DataFrame:
    """`a, b` with a < b: fingerprints that differ in 2 bits or fewer, as stars around the smallest
    one of each meeting value."""
    met = candidates(distinct).select("fp", F.explode(_within_one_bit(F.col("fp"))).alias("value"))
    # A value has at most 65 fingerprints within one bit of it, so these groups are small.
    groups = (met.groupBy("value").agg(F.collect_set("fp").alias("fps"))
              .filter(F.size("fps") > 1))
    star = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return star.filter("a < b").distinct()


def rooted_prints(df: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """`doc_id, fp, root, component_id` for every row: `root` is a fingerprint that only its component has."""
    if max_bits not in (0, 2):
        raise ValueError("max_bits is 0 or 2")
    prints = written(fingerprints(df, shingle, id_col, text_col), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    if max_bits == 0:
        heads = distinct.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    else:
        reached = components(links(distinct.select("fp")))
        heads = written(_smallest_ids(distinct, reached), "simhash-heads")
    return prints.join(heads, "fp").select("doc_id", "fp", "root", "component_id")


def simhash_components(df: DataFrame, shingle: int = 3, max_bits: int = 2,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fp, component_id` for every row: the smallest id reachable over links of at most
    `max_bits` bits. The grid and the meeting values are built for 2 bits, for 0 there is no link but
    equality."""
    return rooted_prints(df, shingle, max_bits, id_col, text_col).drop("root")


def _smallest_ids(distinct: DataFrame, reached: DataFrame) -> DataFrame:
    rooted = distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = written(rooted.select("fp", "first", F.coalesce("root", "fp").alias("root")),
                     "simhash-rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")),
                    "simhash-least")
    return rooted.join(least, "root").select("fp", "root", "component_id")


def keep_first(df: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row of `df` for each component: that of the smallest id, null being the greatest; of the smallest
    fingerprint, where rows of one component share the id; and of the smallest hash of the row, where they share
    the fingerprint too. Rows that share an id in different components are documents of their own."""
    prints = written(rooted_prints(df, shingle, max_bits, id_col, text_col), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("first")
    kept = written(prints.groupBy("root").agg(first).select("first.doc_id", "first.fp"), "simhash-kept")
    repeated = written(prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                       .select("doc_id"), "simhash-repeated")

    def with_id(rows, ids, how):
        # Kept ids grow with the documents, so both sides are shuffled at any size.
        ids = ids.select(F.col("doc_id").alias(own)).distinct()
        return rows.join(ids.hint("merge"), rows[id_col].cast("long").eqNullSafe(ids[own]), how)

    own, mark, place = fresh(df, "_own"), fresh(df, "_fp"), fresh(df, "_place")
    if repeated.isEmpty():
        return with_id(df, kept, "left_semi")
    single = with_id(with_id(df, repeated, "left_anti"), kept, "left_semi")
    again = with_fingerprint(with_id(df, repeated, "left_semi"), text_col, mark, shingle)
    wanted = kept.select(F.col("doc_id").alias(own), F.col("fp").alias("_wanted"))
    again = again.join(wanted, again[id_col].cast("long").eqNullSafe(wanted[own])
                       & (again[mark] == wanted["_wanted"]), "left_semi")
    by_row = Window.partitionBy(id_col, mark).orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]))
    one = again.withColumn(place, F.row_number().over(by_row)).filter(F.col(place) == 1)
    return single.unionByName(one.select(*[F.col(f"`{c}`") for c in df.columns]))


def with_fingerprint(df: DataFrame, text_col: str, name: str, shingle: int = 3) -> DataFrame:
    """`df` with the fingerprint of each row in the new column `name`."""
    schema, at = StructType([*df.schema, StructField(name, LongType())]), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(str(t.as_py() if t.is_valid else ""), shingle) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())],
                                             names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
