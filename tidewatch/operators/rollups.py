"""Counters, rates, percentiles, histograms and skew reports.

Every rollup counts before it shuffles, so what is shuffled is as wide as its answer.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.times import floor_div
from tidewatch.plans.ordered import MAX_ROWS, row_numbers

# The reporting interval, dashboard windows and the histogram bounds.
REPORT_SECONDS = 5
RATE_SECONDS = 30
QUANTILES = (0.5, 0.95, 0.99, 0.999)
LATENCY_MIN = 1
LATENCY_MAX = 60_000_000
SAMPLE_EVERY = 16
PROCESSING_BOUNDS = (100, 2, 14)
BATCH_BOUNDS = (1000, 2, 14)
FLAG_WRITE_BOUNDS = (1000, 2, 10)


def totals(received: DataFrame, failed: Column) -> DataFrame:
    """Received, processed, dropped and errors. Spark pulls its input, so nothing is dropped."""
    errors = F.count_if(failed)
    return received.agg(F.count(F.lit(1)).alias("received"),
                        (F.count(F.lit(1)) - errors).alias("processed"),
                        F.lit(0).cast("long").alias("dropped"), errors.alias("errors"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def per_second(count: Column, seconds: Column) -> Column:
    return count / F.when(seconds > 0, seconds).otherwise(F.lit(1.0))


def summary(counts: DataFrame, flushed: Column, failed: Column, seconds: Column) -> DataFrame:
    """Shares and rates of one run over the `totals` row."""
    return counts.select(
        "received", "processed", "dropped", "errors",
        per_second(F.col("received"), seconds).alias("received_per_sec"),
        per_second(F.col("processed"), seconds).alias("processed_per_sec"),
        percent(F.col("dropped"), F.col("received")).alias("drop_pct"),
        flushed.alias("flushed_rows"), failed.alias("failed_rows"),
        per_second(flushed, seconds).alias("flushed_per_sec"),
        percent(failed, flushed + failed).alias("fail_pct"))


def tumbling(events: DataFrame, seconds: int = REPORT_SECONDS) -> DataFrame:
    """Per interval with events: its count, whole events per second, and the total so far.

    The running total is taken within each day and lifted by the days before it, so the only
    window over everything holds one row per day.
    """
    length = F.window("received_at", f"{seconds} seconds")
    spans = (events.groupBy(length.alias("_w")).agg(F.count(F.lit(1)).alias("events"))
             .select(F.col("_w.start").alias("window_start"), "events")
             .withColumn("_day", F.to_date("window_start")))
    days = spans.groupBy("_day").agg(F.sum("events").alias("_events"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("_day", F.coalesce(F.sum("_events").over(earlier), F.lit(0))
                         .alias("_before"))
    upto = (Window.partitionBy("_day").orderBy("window_start")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (spans.withColumn("_upto", F.sum("events").over(upto)).join(before, "_day")
            .select("window_start", "events",
                    F.call_function("div", F.col("events"), F.lit(seconds)).alias("per_sec"),
                    (F.col("_before") + F.col("_upto")).alias("total")))


def sliding(events: DataFrame, seconds: int = RATE_SECONDS,
            step: int = REPORT_SECONDS) -> DataFrame:
    """Events per second over the last `seconds`, every `step`.

    Events are counted per step first; only those counts are copied into each window.
    """
    steps = (events.groupBy(F.window("received_at", f"{step} seconds").alias("_w"))
             .agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("at"), "n"))
    return (steps.groupBy(F.window("at", f"{seconds} seconds", f"{step} seconds").alias("_w"))
            .agg(F.sum("n").alias("events"))
            .select(F.col("_w.start").alias("window_start"), "events",
                    (F.col("events") / seconds).alias("per_sec")))


def clamped(value: Column, low: int = LATENCY_MIN, high: int = LATENCY_MAX) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def percentiles(df: DataFrame, value: Column, quantiles=QUANTILES) -> DataFrame:
    """Count, discrete percentiles and maximum of whole microseconds, exactly.

    Values are counted, and the counts summed in cells of 4096 values. The cell that holds a rank
    is found among the cells (at most 14,649), the value among the 4096 counts of that cell.
    """
    counts = (df.select(clamped(value).cast("long").alias("v")).filter("v IS NOT NULL")
              .groupBy("v").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("cell", floor_div(F.col("v"), 4096)))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("cell_n"), F.max("v").alias("cell_max"))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding,
                                                    Window.unboundedFollowing)
    ranks = F.array(*[F.struct(F.lit(i).alias("q"), _rank(q).alias("rank"))
                      for i, q in enumerate(quantiles)])
    wanted = (cells.withColumn("cell_upto", F.sum("cell_n").over(upto))
              .withColumn("total", F.sum("cell_n").over(everything))
              .withColumn("top", F.max("cell_max").over(everything))
              .select("*", F.inline(ranks))
              .filter("rank <= cell_upto AND rank > cell_upto - cell_n")
              .selectExpr("cell", "q", "rank - (cell_upto - cell_n) AS rank", "total", "top"))
    within = (Window.partitionBy("cell", "q").orderBy("v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (counts.join(F.broadcast(wanted), "cell")
            .withColumn("upto", F.sum("n").over(within))
            .filter("rank <= upto")
            .agg(F.coalesce(F.max("total"), F.lit(0)).alias("count"),
                 *[F.min(F.when(F.col("q") == i, F.col("v"))).alias(quantile_name(q))
                   for i, q in enumerate(quantiles)],
                 F.max("top").alias("max")))


def _rank(q: float) -> Column:
    """The 1-based rank of a discrete percentile."""
    return F.greatest(F.ceil(F.col("total") * F.lit(q)), F.lit(1))


def quantile_name(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def binned_percentiles(df: DataFrame, value: Column, quantiles=QUANTILES) -> DataFrame:
    """Percentiles to three significant digits, from mergeable bins.

    Values below 2048 have bins of one; each doubling above doubles the bin. The answer is the
    highest value of the bin. There are fewer than 18,000 bins up to the clamp.
    """
    shift = F.greatest(F.length(F.bin("v")) - 11, F.lit(0))
    high = F.expr("shiftleft(shiftright(v, s) + 1L, s) - 1L")
    bins = (df.select(clamped(value).cast("long").alias("v")).filter("v IS NOT NULL")
            .withColumn("s", shift).select(high.alias("v"))
            .groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("v").rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing)
    ranked = (bins.withColumn("upto", F.sum("n").over(upto))
              .withColumn("total", F.sum("n").over(everything)))
    return ranked.agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("count"),
        *[F.min(F.when(F.col("upto") >= F.floor(F.col("total") * F.lit(q) + 0.5), F.col("v")))
          .alias(quantile_name(q)) for q in quantiles],
        F.max("v").alias("max"))


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int = SAMPLE_EVERY,
              max_rows: int = MAX_ROWS) -> DataFrame:
    """Each `n`th row of every key, in order."""
    return (row_numbers(df, keys, order, "_n", max_rows)
            .filter(F.col("_n") % n == 0).drop("_n"))


def exponential_bounds(start: float, factor: float, count: int) -> list[float]:
    return [start * factor ** i for i in range(count)]


def histogram(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative counts per upper bound (inclusive), and over all values."""
    return histograms(df, {"": (value, bounds)}).drop("series")


def histograms(df: DataFrame, series: dict[str, tuple[Column, list[float]]]) -> DataFrame:
    """The histogram of each named series, out of one scan."""
    values = df.select(*[value.alias(f"v{n}") for n, (value, _) in enumerate(series.values())])
    counts, rows = [], []
    for n, (name, (_, bounds)) in enumerate(series.items()):
        v = F.col(f"v{n}")
        counts += [F.count_if(v <= b).alias(f"v{n}_{i}") for i, b in enumerate(bounds)]
        counts.append(F.count(v).alias(f"v{n}_{len(bounds)}"))
        rows += [F.struct(F.lit(name).alias("series"), F.lit(le).alias("le"),
                          F.col(f"v{n}_{i}").alias("count"))
                 for i, le in enumerate([*[f"{b:.15g}" for b in bounds], "+Inf"])]
    return values.agg(*counts).select(F.inline(F.array(*rows)))


def windowed_quantiles(df: DataFrame, ts: str, value: Column, bounds: list[float],
                       quantiles=(0.5, 0.99), length: str = "1 minute") -> DataFrame:
    """Quantiles per window, interpolated inside the histogram bucket that holds the rank.

    A rank beyond the last bound reports the last bound; the first bucket starts at zero.
    """
    counted = (df.select(F.window(ts, length).alias("_w"), value.alias("v"))
               .groupBy("_w").agg(F.count("v").alias("events"), F.array(
                   *[F.count_if(F.col("v") <= b) for b in bounds]).alias("upto")))
    edges = F.array(F.lit(0.0), *[F.lit(float(b)) for b in bounds])

    def quantile(q: float) -> Column:
        rank = F.col("events") * F.lit(q)
        place = F.array_position(F.transform("upto", lambda n: n >= rank), F.lit(True)).cast("int")
        below = F.when(place > 1, F.get("upto", place - 2)).otherwise(F.lit(0))
        inside = F.get("upto", place - 1) - below
        low, high = F.get(edges, place - 1), F.get(edges, place)
        return F.when(place == 0, F.lit(float(bounds[-1]))).otherwise(
            low + (high - low) * (rank - below) / F.when(inside > 0, inside).otherwise(F.lit(1)))

    return counted.select(F.col("_w.start").alias("window_start"), "events",
                          *[quantile(q).alias(quantile_name(q)) for q in quantiles])


def label_counts(df: DataFrame, labels: Column, name: str) -> DataFrame:
    """How often each label occurs in an array column, in lower case."""
    return (df.select(F.explode(labels).alias("_v"))
            .groupBy(F.lower("_v").alias(name)).agg(F.count(F.lit(1)).alias("hits")))


def flags_by_rule(flags: DataFrame) -> DataFrame:
    return flags.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("flags"))


def trips_by_window(hits: DataFrame) -> DataFrame:
    """Rate hits and authors per window label, for hits of one or several windows."""
    return (hits.groupBy(F.element_at("evidence", "window").alias("window"), "did")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("window").agg(F.sum("n").alias("trips"),
                                   F.count(F.lit(1)).alias("authors")))


def key_skew(df: DataFrame, keys: dict[str, list[Column]], buckets: int = 64) -> DataFrame:
    """How evenly rows spread over each named key and over hashed buckets of it, out of one scan. An
    empty input has no report."""
    each = [F.struct(F.lit(name).alias("key"),
                     F.concat_ws("|", *[c.cast("string") for c in columns]).alias("_value"))
            for name, columns in keys.items()]
    sizes = (df.select(F.inline(F.array(*each))).groupBy("key", "_value")
             .agg(F.count(F.lit(1)).alias("n")))
    hashed = F.conv(F.left(F.md5("_value"), F.lit(8)), 16, 10).cast("long") % buckets
    return (sizes.groupBy("key", hashed.alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"), F.max("n").alias("top"))
            .groupBy("key")
            .agg(F.sum("k").alias("keys"), F.sum("rows").alias("rows"),
                 F.max("top").alias("largest_key"), F.count(F.lit(1)).alias("buckets_hit"),
                 F.max("rows").alias("largest_bucket"))
            .select("key", "keys", "rows", "largest_key",
                    (F.col("largest_key") * F.col("keys") / F.col("rows")).alias("largest_to_mean"),
                    "buckets_hit", "largest_bucket"))
