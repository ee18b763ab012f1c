"""Ranked lexical search by scanning the texts for the terms of all items at once.

The distinct terms of all items make up one Aho-Corasick automaton. Every term in it has a blank on either
side, and in a text every character that is in no term becomes a blank, so the automaton finds whole terms
only. It runs over each text twice. The first scan counts the documents that hold a term, the documents with
any term, and all terms. The second knows the weights: it counts a term's occurrences in a text, takes what
they add to the items that the term belongs to, and keeps the best documents of each item in its task.
Nothing is kept about a document between the scans, so there is no index of documents.

The automaton is broadcast. Items whose terms exceed `block_bytes` in sum are dealt into blocks by a hash of
their id, and each block has its own automaton and its own two scans.

A term is a longest run of ASCII letters, digits and all characters beyond ASCII; A-Z are lower-cased, other
letters are not. The score is whole-number BM25 (see `scored`); equal scores rank by ascending id.

Edge cases: null and empty texts have no terms and are never found; an item without terms has no rows; rows
with equal item ids (null is an id too) make up one item with the terms of all of them; documents with
equal ids are documents of their own, and a null id ranks after others of the same score; an empty table
gives an empty result.
"""

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.frames import texts
from tidewatch.plans.durable import written

#: Bytes of terms (and 16 for each entry of an item) that are broadcast at a time.
BLOCK_BYTES = 32 << 20
#: Scores, and entries of items that they are made of, that are held at a time.
CELLS = 1 << 20
#: Parts into which the best documents of an item are merged before they meet.
PARTS = 16
_WITH_TERM, _ALL_TERMS = -1, -2


def _table() -> bytes:
    kept = {c: ord(chr(c).lower()) if c < 128 else c for c in range(256)
            if c >= 128 or chr(c).isalnum()}
    return bytes(kept.get(c, 32) for c in range(256))


BLANKED = _table()
_IN_TERM = np.array([c != 32 for c in BLANKED])


def blanked(text: bytes) -> bytes:
    """Terms in lower case with blanks for all that lies between them, and at both ends."""
    return b" " + text.translate(BLANKED) + b" "


def n_terms(line: bytes) -> int:
    inside = _IN_TERM[np.frombuffer(line, dtype=np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


@dataclass(frozen=True, eq=False)
class Block:
    """The items that are searched for together: their ids, the terms, and for each term the items
    that hold it and how often (`items[first[t]:first[t + 1]]`)."""

    key: str
    ids: list[int | None]
    terms: list[bytes]
    first: np.ndarray
    items: np.ndarray
    times: np.ndarray

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


@lru_cache(maxsize=1)
def automaton(block: Block):
    """One per Python worker and block, so that it lasts from task to task."""
    import ahocorasick
    tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, term in enumerate(block.terms):
        tree.add_word(f" {term.decode('latin-1')} ", number)
    tree.make_automaton()
    return tree


def occurrences(tree, line: bytes) -> Counter:
    """How often each of the automaton's terms stands in a blanked text."""
    return Counter(map(itemgetter(1), tree.iter(line.decode("latin-1"))))


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """`item, term, times` of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["doc_id"], batch["text"].cast(pa.binary())):
                found = Counter(blanked(text.as_py()).split())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * len(found), pa.int64()),
                     pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                    names=["item", "term", "times"])

    return (texts(items, item_col, text_col).mapInArrow(run, "item long, term binary, times long")
            .groupBy("item", "term").agg(F.sum("times").alias("times")))


def blocks(terms: DataFrame, block_bytes: int) -> Iterator[Block]:
    """Blocks of about `block_bytes` of `item_terms`, which have been written."""
    total = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    parts = -(-total // block_bytes)
    for part in range(parts):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()
        if not rows:
            continue
        ids = sorted({r["item"] for r in rows}, key=lambda i: (i is None, i))
        words = sorted({bytes(r["term"]) for r in rows})
        place, number = {i: n for n, i in enumerate(ids)}, {w: n for n, w in enumerate(words)}
        entries = sorted((number[bytes(r["term"])], place[r["item"]], r["times"]) for r in rows)
        of, items, times = (np.array(c, dtype=np.int64) for c in zip(*entries))
        yield Block(uuid.uuid4().hex, ids, words, np.searchsorted(of, np.arange(len(words) + 1)),
                    items, times)


def corpus_counts(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """The documents with a term, all terms, and for each of the block's terms the documents that
    hold it: added up in each task, and one row a term then."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, holds, some, total = automaton(sent.value), Counter(), 0, 0
        for batch in batches:
            for text in batch["text"].cast(pa.binary()).to_pylist():
                line = blanked(text)
                n = n_terms(line)
                some, total = some + (n > 0), total + n
                holds.update(occurrences(tree, line).keys())
        holds.update({_WITH_TERM: some, _ALL_TERMS: total})
        yield pa.RecordBatch.from_arrays([pa.array(list(holds), pa.int32()),
                                          pa.array(list(holds.values()), pa.int64())],
                                         names=["term", "n"])

    counts = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(
        F.sum("n").alias("n"))
    found = {row["term"]: row["n"] for row in counts.collect()}  # one for each of the block's terms
    holds = np.array([found.get(t, 0) for t in range(len(block.terms))], dtype=np.int64)
    return found.get(_WITH_TERM, 0), found.get(_ALL_TERMS, 0), holds


def weights(n_docs: int, holds: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1)))
                     for df in holds], dtype=np.int64)


def scored(block: Block, weight: np.ndarray, found: list[Counter], lengths: list[int]) -> np.ndarray:
    """Scores of documents (rows) for the block's items. `lengths` holds what the contract of the score
    calls m: 25 and 75 times a document's length over the mean, in whole numbers."""
    out = np.zeros(len(found) * len(block.ids), dtype=np.int64)
    terms = np.fromiter((t for f in found for t in f), dtype=np.int64)
    if len(terms):
        sizes = np.array([len(f) for f in found])
        often = np.fromiter((n for f in found for n in f.values()), dtype=np.int64)
        m = np.repeat(np.array(lengths, dtype=np.int64), sizes)
        adds = weight[terms] * ((1_000_000_000 * often) // (1000 * often + 8 * m))
        first, n = block.first[terms], block.first[terms + 1] - block.first[terms]
        at = np.arange(n.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        row = np.repeat(np.repeat(np.arange(len(found)), sizes), n)
        np.add.at(out, row * len(block.ids) + block.items[at], np.repeat(adds, n) * block.times[at])
    return out.reshape(len(found), len(block.ids))


class Best:
    """The `top` best documents of each item among those seen."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.least = np.ones(items, dtype=np.int64)
        self.kept = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # item, score, id, id is null
        self.waiting: list[list[np.ndarray]] = []
        self.n_waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        rows, items = np.nonzero(scores >= self.least)
        self.waiting.append([items, scores[rows, items], ids[rows], missing[rows]])
        self.n_waiting += len(rows)
        if self.n_waiting > CELLS:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(self.kept, *self.waiting)]
        item, score, ids, missing = columns
        order = np.lexsort((ids, missing, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        self.kept = [c[order[place < self.top]] for c in columns]
        self.waiting, self.n_waiting = [], 0
        # From now on a document has to reach the last one kept; it may tie and have a smaller id.
        counts = np.bincount(self.kept[0], minlength=self.items)
        full = counts == self.top
        self.least[full] = self.kept[1][np.cumsum(counts)[full] - 1]
        return self.kept


def best_documents(docs: DataFrame, block: Block, top: int) -> DataFrame:
    """`item_id, doc_id, score`: the `top` best documents of each task, at least."""
    n_docs, n_all, holds = corpus_counts(docs, block)
    sent = docs.sparkSession.sparkContext.broadcast((block, weights(n_docs, holds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = sent.value
        tree, best = automaton(block), Best(len(block.ids), top)
        slice_rows = max(1, CELLS // max(len(block.ids), len(block.items)))
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                rows = batch.slice(at, slice_rows)
                found, lengths = [], []
                for text in rows["text"].cast(pa.binary()).to_pylist():
                    line = blanked(text)
                    found.append(occurrences(tree, line))
                    lengths.append(25 + 75 * n_terms(line) * n_docs // max(1, n_all))
                ids = rows["doc_id"]
                best.add(scored(block, weight, found, lengths),
                         ids.fill_null(0).to_numpy(zero_copy_only=False),
                         ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
        item, score, ids, missing = best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array([block.ids[i] for i in item], pa.int64()),
             pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(score, pa.int64())],
            names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(df: DataFrame, items: DataFrame, top: int = 10, block_bytes: int = BLOCK_BYTES,
           id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """`item_id, rank, doc_id, score`: the `top` documents of each item with a score above 0."""
    docs = texts(df, id_col, text_col)
    terms = written(item_terms(items, item_col, item_text_col), "item-terms")
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in blocks(terms, block_bytes):
        found = found.unionByName(best_documents(docs, block, top))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    # Each task sends its best of every item, so the best of an item meet in two steps.
    for keys in (["item_id", "_part"], ["item_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("_part", part).withColumn("rank", rank).filter(F.col("rank") <= top)
        found = found.select("item_id", "rank", "doc_id", "score")
    return found
