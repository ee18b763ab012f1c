"""What a detector is."""

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F


class Detector(Protocol):
    """A rule over events: zero or more hits per event.

    `hits` returns the event columns with `rule_id, severity, reason, evidence`, one row per hit.
    """

    def hits(self, events: DataFrame) -> DataFrame: ...


class RowDetector(Detector, Protocol):
    """A detector that needs nothing but the event itself. Such detectors share one pass.

    `matched` says whether the event is hit; `hit` is the struct of the hit columns then.
    """

    def matched(self) -> Column: ...

    def hit(self) -> Column: ...


EVENT = ["id", "did", "kind", "text", "received_at"]
EVENT_AND_HIT = [*EVENT, "rule_id", "severity", "reason", "evidence"]


def hit_struct(rule_id: str, severity: str, reason: Column, evidence: dict[str, Column]) -> Column:
    pairs = [part for key, value in evidence.items() for part in (F.lit(key), value)]
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"),
                    reason.alias("reason"), F.create_map(*pairs).alias("evidence"))


def row_hits(events: DataFrame, detectors: list[RowDetector]) -> DataFrame:
    """The hits of several row detectors in one pass; most events stop at the filter."""
    matched = [d.matched() for d in detectors]
    hits = F.array(*[F.when(m, d.hit()) for m, d in zip(matched, detectors)])
    return (events.filter(reduce(Column.__or__, matched))
            .select(*EVENT, F.explode(F.array_compact(hits)).alias("_hit"))
            .select(*EVENT, "_hit.*"))
