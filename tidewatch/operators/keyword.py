"""Spam keywords and regexes."""

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch import schemas
from tidewatch.functions.text import check_patterns, may_contain
from tidewatch.operators.detector import hit_struct, row_hits
from tidewatch.rules import SpamRule


def is_post_with_text() -> Column:
    return (F.col("kind") == schemas.POST) & (F.coalesce("text", F.lit("")) != "")


class SpamDetector:
    """Posts whose text holds a keyword or matches a regex. A bad regex fails here."""

    def __init__(self, rule: SpamRule):
        self.rule = rule
        self.patterns = rule.patterns()
        check_patterns(SparkSession.active(), [pattern for _, pattern in self.patterns])

    @cached_property
    def _occurrences(self) -> list[Column]:
        """Per pattern whether it occurs. A plain search goes before a keyword's pattern."""
        text = F.col("text")
        return [text.rlike(pattern) if keyword is None
                else may_contain(text, keyword) & text.rlike(pattern)
                for keyword, pattern in self.patterns]

    def matched(self) -> Column:
        return is_post_with_text() & reduce(Column.__or__, self._occurrences, F.lit(False))

    def matches(self) -> Column:
        """The first match of every pattern that occurs, in pattern order, in its own case."""
        return F.array_compact(F.array(
            *[F.when(occurs, F.regexp_extract("text", pattern, 0))
              for occurs, (_, pattern) in zip(self._occurrences, self.patterns)],
            F.lit(None).cast("string")))

    def hit(self) -> Column:
        return hit_struct(schemas.SPAM_RULE, self.rule.severity, F.lit(schemas.SPAM_REASON),
                          {"matches": F.array_join(self.matches(), "|")})

    def hits(self, events: DataFrame) -> DataFrame:
        return row_hits(events, [self])
