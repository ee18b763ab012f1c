"""Quality rules: a decision list learned from labelled statistics.

Sequential covering learns one conjunction of thresholds after the other. A rule grows on one part of
the labelled rows, condition by condition, by information gain; it is then pruned on the other part,
condition by condition from the end, and kept if it is precise enough there. Rows that it covers go, and
the next rule is learned on the rest. The list becomes one ordered Spark expression: the first rule
that holds rejects a row, and rows that no rule covers are kept.

Edge cases: null and empty texts have no words and fail the base rules; rows with null or repeated ids
keep their rows; labels that are null, or whose document is missing, are not learned from; without
any label nothing is learned and the base rules decide alone.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.frames import fresh, smallest_hashes

WORDS = re.compile(r"[^ \t-\r]+").findall
SYMBOLS = "#*$%&|<>"
#: How many labelled documents at most are learned from: those with the smallest hash of their id.
SAMPLE = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars",
          "n_upper_words", "n_marks", "n_digits", "n_distinct_words", "n_lines")


def counts(text: str) -> tuple[int, ...]:
    """`COUNTS` of one text. Words lie between ASCII white space."""
    words = WORDS(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated, end = 0, 0
    if len(times) < len(windows):
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    seen, dup_lines = set(), 0
    lines = text.split("\n")
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup_lines += line in seen
            seen.add(line)
    return (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup_lines, repeated, len(text),
            sum(map(str.isupper, words)), text.count("!") + text.count("?"),
            sum(map(text.count, "0123456789")), len(set(words)), len(lines))


def with_counts(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """`df` with a struct of `COUNTS` in the new column `name`."""
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])
    from pyspark.sql.types import LongType, StructField, StructType
    schema = StructType([*df.schema, StructField(name, StructType(
        [StructField(c, LongType()) for c in COUNTS]))])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t.as_py() or "") for t in batch.column(at)]
            stats = pa.StructArray.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(COUNTS))],
                fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, stats],
                                             names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def features(stats: Column) -> dict[str, Column]:
    """What thresholds are learned on: sizes, and shares of words or characters."""
    def share(part: str, whole: str) -> Column:
        return F.try_divide(stats[part].cast("double"), stats[whole].cast("double"))

    shares = {
        "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
        "repeats": share("n_repeat_words", "n_words"), "upper": share("n_upper_words", "n_words"),
        "marks": share("n_marks", "n_words"), "digits": share("n_digits", "n_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"), "distinct": share("n_distinct_words", "n_words")}
    return {"words": stats["n_words"].cast("double")} | {
        k: F.coalesce(v, F.lit(0.0)) for k, v in shares.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        values = x[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, x: dict[str, Column]) -> Column:
        value = x[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for condition in rule:
        hit &= condition.holds(x)
    return hit


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, longest: int) -> Rule:
    """Add the condition with the highest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < longest and (~bad[inside]).any():
        p, n = bad[inside].sum(), inside.sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            own, mine = values[inside], bad[inside]
            order = np.argsort(own, kind="stable")
            sorted_values, below = own[order], np.cumsum(mine[order])
            ends = np.flatnonzero(np.diff(sorted_values) > 0)
            if len(ends) > cuts:
                ends = ends[np.linspace(0, len(ends) - 1, cuts).astype(int)]
            if not len(ends):
                continue
            middle = (sorted_values[ends] + sorted_values[ends + 1]) / 2
            for above, hits, size in ((False, below[ends], ends + 1),
                                      (True, p - below[ends], n - ends - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    worth = np.where(hits > 0, hits * (np.log2(hits / size) - np.log2(p / n)), 0)
                k = int(np.argmax(worth))
                if worth[k] > gain:
                    best, gain = Condition(name, above, float(middle[k])), float(worth[k])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of the rule with the best margin of bad over good rows on unseen rows."""
    def worth(r: Rule) -> float:
        hit = covers(r, x, len(bad))
        return (bad[hit].sum() + 1) / (hit.sum() + 2)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5,
          rules: int = 16, cuts: int = 256, longest: int = 4) -> list[Rule]:
    """Rules that reject. Each covers at least `least` bad rows and is `precision` precise, both on the
    rows it was pruned on and on all that are left. The list has `rules` rules at most, a rule `longest`
    conditions, and a condition's threshold is one of `cuts` quantiles of the rows the rule covers so far."""
    found: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    part = np.arange(len(bad)) % 3 == 2
    while len(found) < rules:
        grow, prune = left & ~part, left & part
        if bad[grow].sum() < least or not prune.any():
            break
        rule = _grown({k: v[grow] for k, v in x.items()}, bad[grow], cuts, longest)
        if not rule:
            break
        rule = _pruned(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        hit = covers(rule, x, len(bad))
        trial, whole = hit & prune, hit & left
        if (bad[whole].sum() < least or bad[whole].mean() < precision
                or not trial.any() or bad[trial].mean() < precision):
            break
        found.append(rule)
        left &= ~hit
    return found


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The number of the first rule that holds, from 1, else 0: an ordered conditional expression."""
    x, chain = features(stats), None
    for number, rule in enumerate(rules, 1):
        hit = rule[0].column(x)
        for condition in rule[1:]:
            hit = hit & condition.column(x)
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    return F.lit(0) if chain is None else chain.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE, **settings) -> list[Rule]:
    """Rules learned from at most `sample` labelled documents that pass the base rules. An id is one document:
    of several labels that of the bad one counts, of several texts the smallest."""
    labelled = (labels.select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).alias("_bad"))
                .dropna().groupBy("_id").agg(F.max("_bad").alias("_bad")))
    chosen = smallest_hashes(labelled, "_id", sample)
    # The sample's size bounds what is broadcast and collected.
    mine = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(chosen), "_id")
            .groupBy("_id", "_bad").agg(F.min("_text").alias("_text")))
    stats = with_counts(mine, "_text", "_stats")
    stats = stats.filter(~base_failed(F.col("_stats")))
    rows = stats.select("_id", "_bad", *[v.alias(k) for k, v in features(F.col("_stats")).items()])
    table = rows.toPandas().sort_values("_id", kind="stable")
    x = {k: table[k].to_numpy(float) for k in features(F.col("_stats"))}
    return learn(x, table["_bad"].to_numpy(bool), **settings)


def judged(docs: DataFrame, rules: list[Rule], name: str, text_col: str = "text") -> DataFrame:
    """`docs` with `name.stats`, `name.base_failed`, `name.rule` (0: none) and `name.kept`."""
    raw = fresh(docs, "_stats")
    df = with_counts(docs, text_col, raw)
    failed, rule = base_failed(F.col(raw)), verdict(rules, F.col(raw))
    return df.withColumn(name, F.struct(
        F.col(raw).alias("stats"), failed.alias("base_failed"), rule.alias("rule"),
        (~failed & (rule == 0)).alias("kept"))).drop(raw)


def described(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in rule)
            for rule in rules]
