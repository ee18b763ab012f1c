"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-case words and their first letters (4, 5 and 6 of them). Of the terms of a bounded
sample of labelled examples, those that go with the label are kept; their document frequencies are
counted over all documents. Each example is a unit vector of TF-IDF weights in an inverted index whose
posting lists are cut into blocks of examples, with the greatest weight of each term in each block. The
products with these bounds order the blocks, and the search stops when no block left can hold an example
nearer than the k nearest found: the result is exact. The k examples vote by their distance, and the
votes are calibrated by isotonic regression on the examples themselves, each left out of its own vote.

The vocabulary is part of the fitted model: at most `TERMS` terms of the sample whose link to the label reaches
`LINK` (a likelihood ratio). The cosine is exact over that vocabulary; terms that do not tell the labels apart
are no features. Nothing else is cut: no document, example, posting list or occurrence of a kept term.

Only the text is scored: the label, language, source and id of a document are never looked at.

Edge cases: a text without any kept term (null and empty ones, too) gets the share of toxic examples
among those without terms; without labels every score is 0; rows with null or repeated ids keep their
rows; labels of missing documents and null labels are not learned from; of several labels of an id the
greatest counts.
"""

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.frames import smallest_hashes, texts
from tidewatch.plans.durable import written

WORDS = re.compile(r"\w+").findall
#: Labelled examples of each label at most: those with the smallest hash of their id.
SAMPLE = 4000
#: Texts whose terms a task counts at a time.
SLICE = 200
#: Terms at most, and the likelihood ratio that a term's link to the label must reach.
TERMS, LINK = 4096, 30.0
NEAREST, BLOCK = 15, 64
PREFIXES = (4, 5, 6)
#: Documents that a task searches for.
SEARCHED = 4000
#: Words whose terms a task remembers at most.
REMEMBERED = 500_000


def terms_of(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


def chosen_terms(sample: DataFrame) -> list[str]:
    """Terms of `sample(text, toxic)` by the likelihood ratio of being in a document and the label. Only
    the terms that are kept reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, found = batch.slice(at, SLICE), (Counter(), Counter())
                for text, label in zip(part["text"].to_pylist(), part["toxic"].to_pylist()):
                    words = set(WORDS(text.lower()))
                    found[label].update({t for word in words for t in terms_of(word)})
                terms = list(found[0].keys() | found[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()),
                     pa.array([found[0][t] for t in terms], pa.int64())], names=["term", "bad", "good"])

    n1, n0 = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    counts = (sample.select("text", "toxic").mapInArrow(run, "term string, bad long, good long")
              .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    total, ratio = float(n1 + n0 or 1), F.lit(0.0)
    for cell, row, column in ((F.col("bad"), n1, F.col("bad") + F.col("good")),
                              (F.col("good"), n0, F.col("bad") + F.col("good")),
                              (n1 - F.col("bad"), n1, total - F.col("bad") - F.col("good")),
                              (n0 - F.col("good"), n0, total - F.col("bad") - F.col("good"))):
        ratio = ratio + F.when(cell > 0, cell * F.log(cell * total / (row * column))).otherwise(0.0)
    rated = counts.filter("bad + good >= 3").select("term", (2 * ratio).alias("ratio"))
    kept = rated.filter(F.col("ratio") >= LINK).orderBy(F.desc("ratio"), "term").limit(TERMS)
    return [row["term"] for row in kept.collect()]


class Index:
    """Unit vectors of examples in posting lists, in blocks with the greatest weights.

    Within a block a posting list is a row of `BLOCK` weights. The rows are laid out where they are first
    used and never sent; they take at most 8 bytes for each term and example."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.vectors, self.n_terms = vectors, n_terms
        blocks = max(1, -(-len(vectors) // BLOCK))
        self.bounds = np.zeros((n_terms, blocks))
        for example, (terms, weights) in enumerate(vectors):
            column = self.bounds[:, example // BLOCK]
            column[terms] = np.maximum(column[terms], weights)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rows": {}}

    def lists(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Which row of the block each term has, and the rows. Row 0 is that of terms not in the block."""
        if block not in self.rows:
            own = np.flatnonzero(self.bounds[:, block])
            place = np.zeros(self.n_terms, dtype=np.int64)
            place[own] = np.arange(1, len(own) + 1)
            rows = np.zeros((len(own) + 1, BLOCK))
            for at, (terms, weights) in enumerate(self.vectors[block * BLOCK:(block + 1) * BLOCK]):
                rows[place[terms], at] = weights
            self.rows[block] = place, rows
        return self.rows[block]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int,
                without: int = -1) -> list[tuple[float, int]]:
        """The `k` examples of the greatest cosine above 0, as `cosine, example`. Cosines are rounded to
        12 places, so that equal examples tie wherever they lie; the smaller example comes first."""
        bounds = weights @ self.bounds[terms]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable").tolist():
            least = -best[-1][0] if len(best) == k else 0.0
            if bounds[block] <= 0 or bounds[block] < least - 1e-11:
                break
            place, rows = self.lists(block)
            scores = np.round(weights @ rows[place[terms]], 12)
            hits = np.flatnonzero((scores > 0) & (scores >= least)).tolist()
            best = sorted(best + [(-float(scores[i]), block * BLOCK + i) for i in hits
                                  if block * BLOCK + i != without])[:k]
        return [(-s, e) for s, e in best]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Steps of a rising function by pooling neighbours: where each begins, and its value. Every step is
    drawn a little to the mean, so that none is exactly 0 or 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([float(x[i]), float(y[i] * w[i]), float(w[i])])
        same = len(pools) > 1 and pools[-2][0] == pools[-1][0]
        while len(pools) > 1 and (same or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
            same = False
    mean = float((y * w).sum() / w.sum())
    return [p[0] for p in pools], [(p[1] + mean) / (p[2] + 1) for p in pools]


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    index: Index | None
    ids: list[int]
    labels: np.ndarray
    votes: np.ndarray
    bare: float
    steps: tuple[list[float], list[float]]

    def vector(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(terms, dtype=np.int64)
        weights = (1 + np.log(np.array(counts, dtype=float))) * self.idf[at]
        return at, weights / np.sqrt((weights ** 2).sum())

    def vote(self, near: list[tuple[float, int]]) -> float:
        pulls = [self.votes[e] / (1.05 - min(s, 1.0)) for s, e in near]
        return sum(p for p, (_, e) in zip(pulls, near) if self.labels[e]) / sum(pulls)

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, str]:
        if not terms or self.index is None:
            return self.bare, ""
        near = self.index.nearest(*self.vector(terms, counts), NEAREST)
        if not near:
            return self.bare, ""
        begins, values = self.steps
        score = values[max(0, bisect_right(begins, self.vote(near)) - 1)]
        return score, ",".join(f"{self.ids[e]}:{s:.4f}" for s, e in near[:5])


def vectors(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """`doc_id, terms, counts`: the kept terms of every document of `docs(doc_id, text)`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for text in batch["text"]:
                found: dict[int, int] = {}
                for word in WORDS(text.as_py().lower()):
                    hit = known.get(word)
                    if hit is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        hit = known[word] = tuple(terms[t] for t in terms_of(word) if t in terms)
                    for term in hit:
                        found[term] = found.get(term, 0) + 1
                out.append(sorted(found.items()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"],
                 pa.array([[t for t, _ in x] for x in out], pa.list_(pa.int32())),
                 pa.array([[n for _, n in x] for x in out], pa.list_(pa.int32()))],
                names=["doc_id", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, terms array<int>, counts array<int>")


def frequencies(found: DataFrame, n_terms: int) -> DataFrame:
    """`term, df`: in how many rows of `found(terms)` each term is, added up in each task before the
    shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            own = batch["terms"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            total += np.bincount(own, minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                                         names=["term", "n"])

    return (found.select("terms").mapInArrow(run, "term int, n long").groupBy("term")
            .agg(F.sum("n").alias("df")))


def sampled(docs: DataFrame, labels: DataFrame, learn_from: Column, sample: int,
            label_col: str = "toxic") -> DataFrame:
    """`doc_id, text, toxic, weight` of at most `sample` documents of each label, as a written table. The
    weight is how many labelled rows each stands for."""
    known = written(labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                                  F.col(label_col).cast("int").alias("toxic"))
                    .dropna().filter(learn_from & F.col("toxic").isin(0, 1))
                    .groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    picked = [smallest_hashes(known.filter(F.col("toxic") == label), "doc_id", sample)
              .withColumn("weight", F.lit(float(max(1.0, sizes.get(label, 0) / sample))))
              for label in (0, 1)]
    # At most 2 * sample rows: the bound of what is broadcast. Of equal ids one text is taken.
    found = docs.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return written(found.groupBy("doc_id", "toxic", "weight").agg(F.min("text").alias("text")),
                   "toxicity-sample")


def fit(sample: DataFrame) -> tuple[dict[str, int], list[tuple]]:
    """The kept terms, and for each example its id, label, weight, terms and counts."""
    terms = {t: i for i, t in enumerate(chosen_terms(sample))}
    known = {r["doc_id"]: (bool(r["toxic"]), r["weight"])
             for r in sample.select("doc_id", "toxic", "weight").collect()}
    found = vectors(sample, terms).collect()
    return terms, sorted((r["doc_id"], *known[r["doc_id"]], r["terms"], r["counts"]) for r in found)


def built(terms: dict[str, int], rows: list[tuple], idf: np.ndarray) -> Model:
    bare = [(label, weight) for _, label, weight, own, _ in rows if not own]
    total = sum(w for _, w in bare)
    rate = (sum(w for label, w in bare if label) + 0.01) / (total + 1) if rows else 0.0
    # Examples of like terms go to like blocks, which makes their bounds tight.
    full = sorted((r for r in rows if r[3]), key=lambda r: (r[3], r[0]))
    model = Model(terms, idf, None, [r[0] for r in full], np.array([r[1] for r in full], dtype=bool),
                  np.array([r[2] for r in full]), float(rate), ([0.0], [float(rate)]))
    if not full:
        return model
    unit = [model.vector(own, counts) for *_, own, counts in full]
    model.index = Index(unit, len(terms))
    votes, seen = [], []
    for i, (at, weights) in enumerate(unit):
        near = model.index.nearest(at, weights, NEAREST, without=i)
        if near:
            votes.append(model.vote(near))
            seen.append(i)
    if seen:
        model.steps = isotonic(np.array(votes), model.labels[seen].astype(float), model.votes[seen])
    return model


def toxicity(df: DataFrame, labels: DataFrame, learn_from: Column, sample: int = SAMPLE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, score, evidence` of every row: a calibrated chance of the label, and the nearest examples
    as `id:cosine`. `learn_from` says which rows of `labels(doc_id, toxic)` may be learned from."""
    docs = texts(df, id_col, text_col)
    spark = df.sparkSession
    terms, rows = fit(sampled(docs, labels, learn_from, sample))
    found = written(vectors(docs, terms), "toxicity-vectors")
    n = found.count()
    idf = np.full(len(terms), math.log(n + 1) + 1)
    counts = frequencies(found, len(terms))  # as many rows as terms are kept, at most
    for row in counts.collect():
        idf[row["term"]] = math.log((n + 1) / (row["df"] + 1)) + 1
    model = spark.sparkContext.broadcast(built(terms, rows, idf))
    # The vectors are compact and lie in few files, but each costs a search.
    found = found.repartition(max(1, -(-n // SEARCHED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            scored = [own.score(t, c) for t, c in zip(batch["terms"].to_pylist(),
                                                      batch["counts"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([s for s, _ in scored], pa.float64()),
                 pa.array([e for _, e in scored], pa.string())],
                names=["doc_id", "score", "evidence"])

    return found.mapInArrow(run, "doc_id long, score double, evidence string")
