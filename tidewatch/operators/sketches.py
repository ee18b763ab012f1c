"""Summaries of each minute that merge into any longer window, and the top of an unbounded set of labels.

The rollups count exactly and read events again for every window. Here a minute is one row: events, a KLL sketch of
a number, and a HyperLogLog sketch of the authors, each of bounded size. Any tumbling or sliding window of
whole minutes is a merge of such rows: one scan of events serves all windows, and a summary that is stored serves
later ones.

Errors: a quantile's rank is off by less than `rank_error(k)` of the events with a chance of 99 %; the relative
standard error of a number of authors is `1.04 / sqrt(2 ** lg_k)`.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.rollups import QUANTILES, clamped, quantile_name
from tidewatch.plans.durable import written

KLL_K, HLL_LG_K = 2000, 12
#: Labels that the summary of frequent ones holds.
TRACKED = 10_000


def rank_error(k: int = KLL_K) -> float:
    """As published for the sketch, as a share of the events."""
    return 2.296 / k ** 0.9021


def minute_summaries(df: DataFrame, ts: str, value: Column, author: Column, k: int = KLL_K,
                     lg_k: int = HLL_LG_K) -> DataFrame:
    """`minute, events, largest, numbers, authors` of every minute that has events. A null number or author
    is in no sketch; rows without a time are in no minute."""
    rows = df.filter(F.col(ts).isNotNull()).select(
        F.date_trunc("minute", ts).alias("minute"), clamped(value).cast("long").alias("v"),
        author.cast("string").alias("a"))
    return rows.groupBy("minute").agg(
        F.count(F.lit(1)).alias("events"), F.max("v").alias("largest"),
        F.kll_sketch_agg_bigint("v", k).alias("numbers"), F.hll_sketch_agg("a", F.lit(lg_k)).alias("authors"))


def merged(summaries: DataFrame, length: str, step: str | None = None, quantiles=QUANTILES) -> DataFrame:
    """`window_start, events, authors`, a column for each quantile, and `max`, out of `minute_summaries`. With
    `step`, windows overlap. `length` and `step` are whole minutes. `authors` is rounded."""
    window = F.window("minute", length, step) if step else F.window("minute", length)
    rows = summaries.groupBy(window.alias("_w")).agg(
        F.sum("events").alias("events"), F.max("largest").alias("max"),
        F.kll_merge_agg_bigint("numbers").alias("numbers"), F.hll_union_agg("authors").alias("_authors"))
    some = F.kll_sketch_get_n_bigint("numbers") > 0
    points = [F.when(some, F.kll_sketch_get_quantile_bigint("numbers", F.lit(q))).alias(quantile_name(q))
              for q in quantiles]
    return rows.select(F.col("_w.start").alias("window_start"), "events",
                       F.hll_sketch_estimate("_authors").alias("authors"), *points, "max")


def top_labels(df: DataFrame, labels: Column, name: str, top: int, tracked: int = TRACKED) -> DataFrame:
    """The `top` most frequent labels of an array column and their exact `hits`; equal ones by label.

    A summary of frequent labels, merged over the tasks, names the candidates, and these alone are counted, so no
    more than `tracked` labels are shuffled. It names every label that has more than `7 / tracked` of all hits.
    Where the last of the top has no more than that, and other labels occur, all labels are counted instead.
    """
    each = df.select(F.explode(labels).alias(name)).filter(F.col(name).isNotNull())
    seen = each.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(`{name}`, {tracked})").alias("s"))
    n, found = seen.select("n", F.expr(f"approx_top_k_estimate(s, {tracked})").alias("found")).first()
    order = [F.desc("hits"), F.col(name)]
    if not n:
        return each.groupBy(name).agg(F.count(F.lit(1)).alias("hits"))
    candidates = df.sparkSession.createDataFrame([(row["item"],) for row in found], f"{name} string")
    counted = written(each.join(F.broadcast(candidates), name).groupBy(name)  # `tracked` rows at most
                      .agg(F.count(F.lit(1)).alias("hits")), "label-counts")
    total = counted.agg(F.sum("hits")).first()[0]
    last = counted.orderBy(*order).offset(top - 1).limit(1).collect()
    if total != n and not (last and last[0]["hits"] > 7 * n / tracked):
        counted = each.groupBy(name).agg(F.count(F.lit(1)).alias("hits"))
    return counted.orderBy(*order).limit(top)
