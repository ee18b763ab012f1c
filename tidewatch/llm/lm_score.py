"""Documents scored by masked pseudo-likelihood.

A small network sees the two words on each side of a masked word and predicts it: each side and distance
has its own embedding, their sum goes through tanh, and a two-step softmax gives first the class of the
word, then the word in its class. A document's score is the sum of the log-probabilities of all its words,
each given its neighbours on both sides.

The network's words are the most frequent of all documents, and one for all others. Another word has the
probability of that one times that of its spelling: a model of bytes, each given the two before it in its word,
whose counts are of every word of all documents. So no word is free: one that occurs nowhere costs as much as its
letters are strange.

Training covers every word. Documents are dealt by a hash of id and text into shards of about `shard_words` words,
each in the order of the hash; a shard's words are one row of a written table. In each round every shard starts from
the common weights and learns one of every `stride` of its words, at another offset each round; the mean of the
weights by words seen, taken in the order of the shards in two levels of bounded groups, starts the next
round. So the scores depend on the documents alone and not on files, partitions or tasks (but for the rounding of
sums of counts, which are whole). What is gathered (counts, and weights of every shard) grows with the corpus; what
reaches the driver is the vocabulary, the spelling counts and one set of weights, all of fixed size.

Edge cases: null and empty texts have no words and a score of 0; rows with null or repeated ids keep
their rows, and equal rows are learned as often as they occur; an empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.frames import texts
from tidewatch.llm.token_ids import slices
from tidewatch.plans.durable import written

CLASSES, WIDTH, REACH = 32, 16, 2
#: Words in the vocabulary, the unknown one (0) included: `CLASSES` classes of as many words each.
WORDS = CLASSES * CLASSES
PAD = WORDS
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
SHAPES = {"context": (len(OFFSETS), WORDS + 1, WIDTH), "classes": (WIDTH, CLASSES),
          "class_bias": (CLASSES,), "words": (CLASSES, WIDTH, CLASSES), "word_bias": (CLASSES, CLASSES)}
BATCH = 4096
#: Shards whose weights are averaged in one group.
GROUP = 64
SHARD_WORDS = 1_000_000
#: Bytes of text that are looked at together; a longer text is looked at whole.
_BYTES = 4 << 20
#: Codes of a byte in a word: ASCII as it is, others fold to 30 codes that no word has; its start and its end.
CODES, START, END = 128, 0, 1
_CODE_OF = np.array([b if b < 128 else 2 + b % 30 for b in range(256)], dtype=np.int64)
#: What is added to each count of a byte after two others.
SMOOTH = 0.1

Weights = dict[str, np.ndarray]


def fresh_weights(seed: int = 7) -> Weights:
    random = np.random.default_rng(seed)
    return {name: (np.zeros(shape) if "bias" in name else random.normal(0, 0.1, shape)).astype("f4")
            for name, shape in SHAPES.items()}


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in SHAPES])


def shaped(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = values[at:at + size].reshape(shape).astype("f4")
        at += size
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row at one place. Overwrites `z`."""
    z -= z.max(axis=1, keepdims=True)
    wanted = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return wanted - np.log(z.sum(axis=1))


def hidden(weights: Weights, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros((len(at), WIDTH), dtype=weights["context"].dtype)
    for table, offset in zip(weights["context"], OFFSETS):
        total += table.take(ids[at + offset], axis=0)
    return np.tanh(total, out=total)


def log_probabilities(weights: Weights, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the words at positions `at` of `ids`, which has `REACH` pads on either end of each document."""
    order, cuts = _by_class(ids[at])
    kinds, places = np.divmod(ids[at[order]], CLASSES)
    h = hidden(weights, ids, at[order])
    found = _log_softmax_at(_linear(h, weights["classes"], weights["class_bias"]), kinds)
    for kind, a, b in cuts:
        found[a:b] += _log_softmax_at(_linear(h[a:b], weights["words"][kind], weights["word_bias"][kind]),
                                      places[a:b])
    out = np.empty_like(found)
    out[order] = found
    return out


def _linear(h: np.ndarray, matrix: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = h @ matrix
    z += bias
    return z


def _by_class(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order in which the words of each class are together, and the class, begin and end of each."""
    kinds = (words // CLASSES).astype(np.int16)
    order = np.argsort(kinds, kind="stable")
    cuts = np.searchsorted(kinds[order], np.arange(CLASSES + 1))
    return order, [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


class Learner:
    """Adagrad on the negative log-probability."""

    def __init__(self, weights: Weights, rate: float = 0.1):
        self.weights, self.rate, self.seen = weights, rate, 0
        self.squares = {name: np.full_like(w, 1e-2) for name, w in weights.items()}

    def _step(self, name: str, where, gradient: np.ndarray) -> None:
        squares = self.squares[name]
        squares[where] += gradient ** 2
        self.weights[name][where] -= self.rate * gradient / np.sqrt(squares[where])

    def learn(self, ids: np.ndarray, at: np.ndarray) -> None:
        w, n = self.weights, len(at)
        order, cuts = _by_class(ids[at])
        at = at[order]
        kinds, places = np.divmod(ids[at], CLASSES)
        h = hidden(w, ids, at)
        error = _softmax(_linear(h, w["classes"], w["class_bias"]))
        error[np.arange(n), kinds] -= 1
        back = error @ w["classes"].T
        steps = [("classes", slice(None), h.T @ error / n),
                 ("class_bias", slice(None), error.sum(0) / n)]
        words, biases = np.zeros_like(w["words"]), np.zeros_like(w["word_bias"])
        for kind, a, b in cuts:
            e = _softmax(_linear(h[a:b], w["words"][kind], w["word_bias"][kind]))
            e[np.arange(b - a), places[a:b]] -= 1
            back[a:b] += e @ w["words"][kind].T
            words[kind], biases[kind] = h[a:b].T @ e, e.sum(0)
        steps += [("words", slice(None), words / n), ("word_bias", slice(None), biases / n)]
        back *= (1 - h ** 2) / n
        for side, offset in enumerate(OFFSETS):
            around = ids[at + offset].astype(np.int16)
            order = np.argsort(around, kind="stable")
            around = around[order]
            starts = np.flatnonzero(np.diff(around, prepend=-1))
            steps.append(("context", (side, around[starts]), np.add.reduceat(back[order], starts, axis=0)))
        for step in steps:
            self._step(*step)
        self.seen += n


def laid_out(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One line of ids with pads between documents; where words are; of which document each is."""
    ends = np.concatenate([[0], np.cumsum([len(ids) for ids in documents], dtype=np.int64)])
    owner = np.repeat(np.arange(len(documents)), np.diff(ends))
    at = np.arange(ends[-1]) + REACH * (1 + owner)
    line = np.full(ends[-1] + REACH * len(ends), PAD, dtype=np.int32)
    line[at] = np.concatenate([np.zeros(0, dtype=np.int32), *documents])
    return line, at, owner


@dataclass(frozen=True)
class Words:
    """The words of texts, one after another: which distinct word each is, and where each text's begin."""

    distinct: pa.Array
    which: np.ndarray
    ends: np.ndarray


def words_of(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(texts)
    words = lists.values
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(bool)
    ends = np.concatenate([[0], np.cumsum(filled)])[lists.offsets.to_numpy()]
    coded = words.filter(pa.array(filled)).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(), ends)


def _cells(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words and the end of each: its code and the two before, as one number; and where the
    words begin."""
    data = words.cast(pa.binary())
    ends = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset:data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    codes = np.insert(_CODE_OF[raw], ends[1:] - ends[0], END)
    starts = ends[:-1] - ends[0] + np.arange(len(words))
    before = np.concatenate([[START, START], codes])
    one, two = before[1:-1].copy(), before[:-2].copy()
    one[starts] = two[starts] = START
    second = starts[np.diff(ends) > 0] + 1
    two[second] = START
    return (two * CODES + one) * CODES + codes, starts


def spelling(counts: np.ndarray) -> np.ndarray:
    """The log-probability of each byte after two others, out of the counts of all three."""
    table = counts.reshape(-1, CODES).astype(float) + SMOOTH
    return np.log(table / table.sum(axis=1, keepdims=True)).astype("f4").ravel()


@dataclass(frozen=True)
class Vocabulary:
    """The network's words, the most frequent first, and the spelling of all others."""

    words: list[str]
    spelling: np.ndarray

    def numbered(self, words: Words) -> np.ndarray:
        """The network's number of each word, 0 for others."""
        place = pc.index_in(words.distinct, value_set=pa.array(self.words, words.distinct.type))
        return (place.fill_null(-1).to_numpy(zero_copy_only=False) + 1).astype(np.int32)[words.which]

    def spelled(self, words: Words, ids: np.ndarray) -> np.ndarray:
        """The log-probability of the spelling of each word, 0 for the network's."""
        if not len(words.distinct):
            return np.zeros(0)
        cells, starts = _cells(words.distinct)
        cost = np.add.reduceat(self.spelling[cells].astype(float), starts)
        return np.where(ids == 0, cost[words.which], 0.0)


def vocabulary_of(docs: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary of all documents, and the number of their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CODES ** 3)
        for part in (p for batch in batches for p in slices(batch, 2 * _BYTES)):
            words = words_of(part["text"])
            if not len(words.distinct):
                continue
            often = np.bincount(words.which, minlength=len(words.distinct))
            own, starts = _cells(words.distinct)
            sizes = np.diff(np.append(starts, len(own)))
            cells += np.bincount(own, weights=np.repeat(often, sizes), minlength=CODES ** 3)
            yield pa.RecordBatch.from_arrays(
                [words.distinct, pa.nulls(len(often), pa.int32()), pa.array(often, pa.int64())],
                names=["word", "cell", "n"])
        found = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(found), pa.string()), pa.array(found, pa.int32()),
             pa.array(cells[found].astype(np.int64))], names=["word", "cell", "n"])

    counts = written(docs.select("text").mapInArrow(run, "word string, cell int, n long")
                     .groupBy("word", "cell").agg(F.sum("n").alias("n")), "lm-counts")
    known = counts.filter(F.col("word").isNotNull())
    top = known.orderBy(F.desc("n"), "word").limit(WORDS - 1).collect()  # the vocabulary's size
    total = known.agg(F.sum("n")).first()[0] or 0
    cells = np.zeros(CODES ** 3)
    for row in counts.filter(F.col("cell").isNotNull()).collect():  # as many as there are cells, at most
        cells[row["cell"]] = row["n"]
    return Vocabulary([row["word"] for row in top], spelling(cells)), total


def sharded(docs: DataFrame, vocabulary: Vocabulary, total: int, shard_words: int) -> DataFrame:
    """`shard, ids`: the numbers of each shard's words with pads between documents, as a written table."""
    shards = max(1, -(-total // shard_words))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in slices(whole, _BYTES)):
            words = words_of(batch["text"])
            lists = pa.ListArray.from_arrays(pa.array(words.ends, pa.int32()),
                                             pa.array(sent.value.numbered(words)))
            yield pa.RecordBatch.from_arrays([batch["hash"], lists], names=["hash", "ids"])

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists = rows["ids"].combine_chunks()
        order = np.lexsort((rows["size"].to_numpy(), rows["hash"].to_numpy()))
        line, _, _ = laid_out([lists[int(i)].values.to_numpy() for i in order])
        return pa.table({"shard": rows["shard"].slice(0, 1), "ids": pa.array([line.tobytes()], pa.binary())})

    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("hash"))
    numbered = hashed.mapInArrow(number, "hash long, ids array<int>").select(
        F.pmod("hash", F.lit(shards)).alias("shard"), "hash", F.size("ids").alias("size"), "ids")
    return written(numbered.filter("size > 0").groupBy("shard").applyInArrow(gather, "shard long, ids binary"),
                   "lm-shards")


def _mean(table: pa.Table, keys: list[str]) -> pa.Table:
    table = table.sort_by("first")  # sums in one order always
    seen = table["seen"].to_numpy().astype(float)
    total = sum(np.frombuffer(v, "f4") * s for v, s in zip(table["weights"].to_pylist(), seen))
    kept = {k: pa.array([table[k][0].as_py()], table.schema.field(k).type) for k in [*keys, "first"]}
    return pa.table(kept | {"seen": pa.array([int(seen.sum())], pa.int64()), "weights": pa.array(
        [(total / max(1.0, seen.sum())).astype("f4").tobytes()], pa.binary())})


def trained(shards: DataFrame, rounds: int = 2, stride: int = 2) -> Weights:
    """Weights after `rounds` over `shards(shard, ids)`. With as many rounds as `stride`, every word is a target
    once."""
    spark, weights = shards.sparkSession, fresh_weights()
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(flat(weights))

        def run(batches: Iterator[pa.RecordBatch], turn=turn, start=start):
            for batch in batches:
                for shard, ids in zip(batch["shard"].to_pylist(), batch["ids"].to_pylist()):
                    learner = Learner(shaped(start.value))
                    _train(learner, np.frombuffer(ids, dtype=np.int32), turn, stride)
                    pieces = np.array_split(flat(learner.weights), 16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(16), pa.int32()), pa.array([shard // GROUP] * 16, pa.int64()),
                         pa.array([shard] * 16, pa.int64()), pa.array([learner.seen] * 16, pa.int64()),
                         pa.array([p.tobytes() for p in pieces], pa.binary())],
                        names=["piece", "grp", "first", "seen", "weights"])

        schema = "piece int, grp long, first long, seen long, weights binary"
        means = shards.mapInArrow(run, schema).groupBy("piece", "grp").applyInArrow(
            lambda t: _mean(t, ["piece", "grp"]).select(["piece", "grp", "first", "seen", "weights"]), schema)
        means = means.groupBy("piece").applyInArrow(
            lambda t: _mean(t, ["piece"]).select(["piece", "seen", "weights"]), "piece int, seen long, weights binary")
        rows = sorted((r["piece"], r["weights"]) for r in written(means, "lm-weights").collect())
        if rows:
            weights = shaped(np.concatenate([np.frombuffer(w, "f4") for _, w in rows]))
    return weights


def _train(learner: Learner, ids: np.ndarray, turn: int, stride: int) -> None:
    at = np.flatnonzero(ids != PAD)[turn % stride::stride]
    at = np.random.default_rng(turn).permutation(at)
    for part in range(0, len(at), BATCH):
        learner.learn(ids, at[part:part + BATCH])


def lm_scores(df: DataFrame, rounds: int = 2, stride: int = 2, shard_words: int = SHARD_WORDS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_words, n_unknown, log_prob, mean_log_prob` of every row; the mean is null without
    words."""
    docs = texts(df, id_col, text_col)
    vocabulary, total = vocabulary_of(docs)
    weights = trained(sharded(docs, vocabulary, total, shard_words), rounds, stride)
    model = df.sparkSession.sparkContext.broadcast((weights, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = model.value
        for batch in (p for whole in batches for p in slices(whole, _BYTES)):
            words = words_of(batch["text"])
            ids = known.numbered(words)
            cost = known.spelled(words, ids) + _in_context(own, ids, words.ends)
            sizes = np.diff(words.ends)
            unknown = np.diff(np.concatenate([[0], np.cumsum(ids == 0)])[words.ends])
            totals = _sums(cost, words.ends)
            means = np.divide(totals, sizes, out=np.zeros(len(sizes)), where=sizes > 0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(unknown, pa.int64()),
                 pa.array(totals, pa.float64()), pa.array(means, pa.float64(), mask=sizes == 0)],
                names=["doc_id", "n_words", "n_unknown", "log_prob", "mean_log_prob"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_unknown long, log_prob double, "
                                "mean_log_prob double")


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the values of each text, added from its first on, so that a text's sum is its own affair."""
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    return np.bincount(owner, weights=values, minlength=len(ends) - 1)


def _in_context(weights: Weights, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The log-probability of each of the network's numbers given those around it in its text."""
    line, at, _ = laid_out(np.split(ids, ends[1:-1]) if len(ends) > 1 else [])
    found = [log_probabilities(weights, line, at[i:i + BATCH]).astype(float) for i in range(0, len(at), BATCH)]
    return np.concatenate([np.zeros(0), *found])
