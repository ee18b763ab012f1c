"""Summaries that merge, against exact answers."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.rows import START
from tidewatch.operators import sketches
from tidewatch.operators.rollups import QUANTILES, quantile_name


def readings(spark, n, minutes, seed=1):
    draw = random.Random(seed)
    rows = [(START + timedelta(seconds=draw.randrange(60 * minutes)), round(draw.lognormvariate(6, 2)),
             f"a{draw.randrange(n // 4)}") for _ in range(n)]
    return rows, spark.createDataFrame(rows, "ts timestamp, v long, a string")


def summaries(df):
    return sketches.minute_summaries(df, "ts", F.col("v"), F.col("a"))


def in_window(rows, start, minutes):
    return [r for r in rows if start <= r[0] < start + timedelta(minutes=minutes)]


@pytest.mark.parametrize("length, step", [("10 minutes", None), ("1 hour", None), ("20 minutes", "5 minutes")])
def test_windows_of_any_length_from_minutes(spark, length, step):
    rows, df = readings(spark, 30_000, 60)
    minutes = int(length.split()[0]) * (60 if "hour" in length else 1)
    found = sketches.merged(summaries(df), length, step).collect()
    assert sum(r.events for r in found) == len(rows) * (4 if step else 1)
    for r in found:
        own = in_window(rows, r.window_start, minutes)
        values = sorted(max(1, min(v, 60_000_000)) for _, v, _ in own)
        assert r.events == len(own) and r["max"] == values[-1]
        for q in QUANTILES:
            point = r[quantile_name(q)]
            below, upto = sum(v < point for v in values), sum(v <= point for v in values)
            slack = sketches.rank_error() * len(values) + 1
            assert below - slack <= q * len(values) <= upto + slack
        exact = len({a for *_, a in own})
        assert abs(r.authors - exact) <= 5 * 1.04 / 64 * exact + 1


def test_a_minute_is_one_row_of_bounded_size(spark):
    _, df = readings(spark, 40_000, 2)
    rows = summaries(df).select("events", F.octet_length("numbers").alias("n"),
                                F.octet_length("authors").alias("a")).collect()
    assert len(rows) == 2 and all(r.n < 80_000 and r.a < 5000 for r in rows)


def test_nulls(spark):
    df = spark.createDataFrame([(START, None, None), (START, 5, "x"), (None, 7, "y")],
                               "ts timestamp, v long, a string")
    (row,) = sketches.merged(summaries(df), "1 minute").collect()
    assert (row.events, row.authors, row.p50, row["max"]) == (2, 1, 5, 5)
    (row,) = sketches.merged(summaries(df.filter("v IS NULL")), "1 minute").collect()
    assert (row.events, row.authors, row.p50, row["max"]) == (1, 0, None, None)
    assert sketches.merged(summaries(df.limit(0)), "1 minute").count() == 0


def labelled(spark, counts):
    rows = [([w] * min(n - i, 50),) for w, n in counts.items() for i in range(0, n, 50)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "labels array<string>").repartition(6)


@pytest.mark.parametrize("tracked", [64, 10_000])
def test_top_labels_are_exact(spark, tracked):
    """Skewed labels, of which the small summary misses many, and flat ones, where it cannot tell."""
    skewed = {f"w{i}": max(1, 3000 // (i + 1)) for i in range(600)}
    flat = {f"w{i}": 5 for i in range(300)}
    for counts in (skewed, flat):
        found = sketches.top_labels(labelled(spark, counts), F.col("labels"), "label", 7, tracked)
        expected = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:7]
        assert [tuple(r) for r in found.collect()] == expected


def test_top_labels_edge_cases(spark):
    df = spark.createDataFrame([(["a", None, "b", "a"],), (None,), ([],)], "labels array<string>")
    found = sketches.top_labels(df, F.col("labels"), "label", 5).collect()
    assert [tuple(r) for r in found] == [("a", 2), ("b", 1)]
    assert sketches.top_labels(df.limit(0), F.col("labels"), "label", 5).count() == 0
