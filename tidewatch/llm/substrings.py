"""Exact repeats across documents by level-wise doubling, and their removal.

Windows of `start` words are compared first, over all documents. Only where windows of one length are
repeated (in another document) at a position and so far behind it that they reach the next length, is
the window of the next length, at most twice as long, a candidate; the levels go on up to `length` and,
for the longest repeats, until no candidate survives.

Documents are dealt into blocks of consecutive ids, cut at fixed ids so that a lost task is made again
the same. At each level a block sends every distinct candidate hash once, sorted, in one binary per hash
range ("bucket"). A bucket learns which hashes lie in several blocks and tells those blocks whether a
block of smaller ids has them, too. Within a block documents are compared directly. So a passage that
millions of documents share is one entry per block, and no pair is ever written.

Windows are compared by 64-bit hashes that differ from level to level, and a removed window was found
equal at every level.

Edge cases: words lie between ASCII white space; null and empty texts have no words; texts shorter than
a window lose nothing; rows with the same id are one document to each other; null ids sort after all
others; an empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.frames import texts
from tidewatch.plans.durable import written

BLOCK_BYTES = 16 << 20
_LAST = np.iinfo(np.int64).max


def levels(start: int, length: int) -> list[int]:
    """Window lengths from `start` up to `length`, each at most twice the one before."""
    out = [min(start, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _packed(sorted_hashes: np.ndarray) -> bytes:
    """Byte planes: the high bytes of sorted hashes hardly change and compress well."""
    return np.ascontiguousarray(sorted_hashes.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def _window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` word hashes, mixed so that its high bits are even."""
    n = max(0, len(words) - length + 1)
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * length)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(length):
        out = out * factor + words[j:n + j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _members(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of `values` are in the sorted array `among`."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


class Block:
    """The documents of one block in order of their ids, as word hashes."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].to_numpy(zero_copy_only=False)
        if table["doc_id"].null_count:
            ids = np.array([_LAST if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order].astype(np.int64)
        self.texts = table["text"].combine_chunks() if table.num_rows else table["text"]
        digest = xxhash.xxh64_intdigest
        self.words = [np.fromiter(map(digest, self.text(i).split()), dtype=np.uint64)
                      for i in range(len(self.order))]

    def text(self, i: int) -> bytes:
        return self.texts[int(self.order[i])].as_py().encode("utf-8", "surrogatepass")

    def hashes(self, length: int) -> list[np.ndarray]:
        return [_window_hashes(w, length) for w in self.words]

    def seen(self, hashes: list[np.ndarray], later: np.ndarray,
             first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For every window: is it in another document, and is it in one with a smaller id?"""
        sizes = [len(h) for h in hashes]
        every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(self.ids, sizes)
        distinct, at = np.unique(every, return_inverse=True)
        least = np.full(len(distinct), _LAST, dtype=np.int64)
        most = np.full(len(distinct), np.iinfo(np.int64).min, dtype=np.int64)
        np.minimum.at(least, at, owner)
        np.maximum.at(most, at, owner)
        before = _members(distinct, later)
        repeated = before | _members(distinct, first) | (least < most)
        cuts = np.cumsum(sizes)[:-1]
        smaller = before[at] | (least[at] < owner)
        return np.split(repeated[at], cuts), np.split(smaller, cuts)


def _answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All `later` and all `first` hashes that were sent to a block, sorted."""
    out = []
    for name in ("later", "first"):
        parts = [_unpacked(x) for x in table[name].to_pylist()] or [np.zeros(0, dtype=np.uint64)]
        out.append(np.sort(np.concatenate(parts)))
    return out[0], out[1]


_SENT = "bucket int, block int, hashes binary"
_ANSWER = "block int, later binary, first binary"


def _sent(block: int, hashes: np.ndarray, bits: int) -> pa.Table:
    distinct = np.unique(hashes)
    buckets = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(
        len(distinct), dtype=np.int64)
    numbers, starts = np.unique(buckets, return_index=True)
    ends = [*starts[1:], len(distinct)]
    return pa.table({
        "bucket": pa.array(numbers, pa.int32()),
        "block": pa.array(np.full(len(numbers), block), pa.int32()),
        "hashes": pa.array([_packed(distinct[a:b]) for a, b in zip(starts, ends)], pa.binary())})


def _met(table: pa.Table) -> pa.Table:
    """In one bucket: the hashes that several blocks sent, for each of these blocks."""
    table = table.sort_by("block")
    blocks, parts = table["block"].to_pylist(), [_unpacked(x) for x in table["hashes"].to_pylist()]
    every = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(every, kind="stable")  # equal hashes stay in the order of blocks
    every, owner = every[order], owner[order]
    again = np.concatenate([[False], every[1:] == every[:-1]])
    opens = ~again & np.concatenate([again[1:], [False]])
    rows, told = [], np.flatnonzero(again | opens)
    told = told[np.argsort(owner[told], kind="stable")]  # by block; hashes stay in order
    cuts = np.searchsorted(owner[told], np.arange(1, len(parts)))
    for block, mine in zip(blocks, np.split(told, cuts)):
        if len(mine):
            rows.append((block, _packed(every[mine[again[mine]]]), _packed(every[mine[opens[mine]]])))
    columns = list(zip(*rows)) or [[]] * 3
    return pa.table({"block": pa.array(columns[0], pa.int32()),
                     "later": pa.array(columns[1], pa.binary()),
                     "first": pa.array(columns[2], pa.binary())})


class Repeats:
    """Documents in blocks, and the answers of each level."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES):
        docs = texts(df, id_col, text_col)
        spark = df.sparkSession
        total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(parts, -(-total // block_bytes))
        # One number per block, however many documents there are.
        cuts = docs.select(F.percentile_approx(
            "doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 100 * blocks)).first()[0]
        bounds = np.array(sorted(set(cuts or [])), dtype=np.int64)
        self.bits = int(max(parts, total // (BLOCK_BYTES // 2)) - 1).bit_length()

        @F.arrow_udf("int")
        def block_of(ids: pa.Array) -> pa.Array:
            numbers = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
            return pa.array(np.searchsorted(bounds, numbers, side="left"), pa.int32())

        self.docs = docs.withColumn("block", block_of("doc_id"))

    def _answered(self, sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(_met, _ANSWER)

    def first_level(self, length: int) -> DataFrame:
        bits = self.bits

        def send(key: tuple, table: pa.Table) -> pa.Table:
            return _sent(key[0].as_py(), np.concatenate(Block(table).hashes(length)), bits)

        return self._answered(self.docs.groupBy("block").applyInArrow(send, _SENT))

    def next_level(self, answers: DataFrame, length: int, longer: int) -> DataFrame:
        """Answers for windows of `longer` words whose two halves of `length` words are repeated."""
        bits, shift = self.bits, longer - length

        def send(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
            block = Block(table)
            repeated, _ = block.seen(block.hashes(length), *_answers(answer))
            found = [np.zeros(0, dtype=np.uint64)]
            for flags, hashes in zip(repeated, block.hashes(longer)):
                n = len(hashes)
                found.append(hashes[flags[:n] & flags[shift:shift + n]])
            return _sent(key[0].as_py(), np.concatenate(found), bits)

        sent = (self.docs.groupBy("block").cogroup(answers.groupBy("block"))
                .applyInArrow(send, _SENT))
        return self._answered(sent)

    def found(self, length: int, start: int) -> DataFrame:
        steps = levels(start, length)
        answers = self.first_level(steps[0])
        for shorter, longer in zip(steps, steps[1:]):
            answers = self.next_level(answers, shorter, longer)
        return answers


def without_repeats(df: DataFrame, length: int = 13, start: int = 7, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """`doc_id, n_words, n_removed, kept` for every row: `kept` are the words that no window covers
    whose words also start in a document with a smaller id, joined by spaces."""
    return _kept(df, length, start, id_col, text_col, "kept string", lambda kept: kept.decode(
        "utf-8", "surrogatepass"))


def repeat_digests(df: DataFrame, length: int = 13, start: int = 7, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The same with the SHA-256 of the kept words in place of them: texts do not leave their task."""
    return _kept(df, length, start, id_col, text_col, "kept_sha256 string",
                 lambda kept: hashlib.sha256(kept).hexdigest())


def _kept(df, length, start, id_col, text_col, field, result) -> DataFrame:
    repeats = Repeats(df, id_col, text_col)
    schema = f"doc_id long, n_words long, n_removed long, {field}"
    name = field.split()[0]

    def cut(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        block = Block(table)
        _, smaller = block.seen(block.hashes(length), *_answers(answer))
        rows = []
        for i, flags in enumerate(smaller):
            words = block.text(i).split()
            gone = np.zeros(len(words) + 1, dtype=np.int32)
            starts = np.flatnonzero(flags)
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + length, -1)
            keep = np.cumsum(gone[:-1]) == 0
            rows.append((table["doc_id"][int(block.order[i])].as_py(), len(words),
                         int(len(words) - keep.sum()),
                         result(b" ".join(compress(words, keep.tolist())))))
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                        names=["doc_id", "n_words", "n_removed", name])

    answers = repeats.found(length, start)
    return (repeats.docs.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(cut, schema))


def longest_repeats(df: DataFrame, length: int = 13, start: int = 7, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """`doc_id, longest` for every document with a repeat: the greatest of `length`, twice, four times
    and so on at which a window of it is in another document. Doubles until no candidate survives."""
    repeats = Repeats(df, id_col, text_col)
    answers = written(repeats.found(length, start), "repeats")
    result = None
    while True:
        def holders(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
            block = Block(table)
            repeated, _ = block.seen(block.hashes(length), *_answers(answer))
            ids = [table["doc_id"][int(block.order[i])].as_py()
                   for i, flags in enumerate(repeated) if flags.any()]
            return pa.table({"doc_id": pa.array(ids, pa.int64()),
                             "longest": pa.array([length] * len(ids), pa.int64())})

        level = written(repeats.docs.groupBy("block").cogroup(answers.groupBy("block"))
                        .applyInArrow(holders, "doc_id long, longest long"), "repeat-level")
        result = level if result is None else result.unionByName(level)
        if level.isEmpty():
            return result.groupBy("doc_id").agg(F.max("longest").alias("longest"))
        answers = written(repeats.next_level(answers, length, 2 * length), "repeats")
        length *= 2
