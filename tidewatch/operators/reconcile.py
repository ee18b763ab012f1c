"""Did every event land in every view?"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def reconcile(source: DataFrame, targets: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per target table: keys landed, missing from the table, and not in the source.

    `targets` maps a name to its rows and primary key. Both sides are counted per key instead of
    joined, so copies of a key collapse before the shuffle.
    """
    return reduce(DataFrame.unionByName,
                  [_reconcile(source, name, rows, key) for name, (rows, key) in targets.items()])


def _reconcile(source, name, rows, key):
    both = (source.select(*key, F.lit(1).alias("_sent"), F.lit(0).alias("_found"))
            .unionByName(rows.select(*key, F.lit(0).alias("_sent"), F.lit(1).alias("_found"))))
    keys = both.groupBy(*key).agg(F.max("_sent").alias("sent"), F.max("_found").alias("found"))
    return (keys.agg(F.count_if(F.expr("sent = 1 AND found = 1")).alias("landed"),
                     F.count_if(F.expr("sent = 1 AND found = 0")).alias("missing"),
                     F.count_if(F.expr("sent = 0 AND found = 1")).alias("unexpected"))
            .select(F.lit(name).alias("target"), "landed", "missing", "unexpected"))
