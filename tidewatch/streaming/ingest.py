"""Continuous ingest: write the views, then detect and write the flags, batch by batch."""

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.detector import row_hits
from tidewatch.operators.rate import RateDetector
from tidewatch.plans.layout import flagged
from tidewatch.sinks.tables import Sink
from tidewatch.streaming.live import closing_time
from tidewatch.streaming.rate import live_rate_hits

_STORES = "spark.sql.streaming.stateStore"
#: The rate rule keeps the events of a delay and of two windows, with their texts: on the executors' disks, not in their
#: heaps, where two versions would lie at once.
STATE = {f"{_STORES}.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         f"{_STORES}.rocksdb.boundedMemoryUsage": "true",
         f"{_STORES}.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB; one that goes on from a checkpoint keeps it as it did
    before."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    try:
        for name, value in STATE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class IngestStep:
    """What happens to one micro-batch.

    Events come first: if they cannot be written, nothing is detected. Then each detector's flags
    are written. One that fails does not stop the others, but fails the batch in the end, which
    Spark then repeats; a repeated batch replaces its own rows. A sink that can `open` a batch shows its events
    and flags together.
    """

    def __init__(self, sink: Sink, chain: list):
        if any(isinstance(d, RateDetector) for d in chain):
            raise ValueError("the rate rule has to remember earlier batches: see start_ingest")
        self.sink = sink
        self.chain = chain

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            sink = self.sink
            if hasattr(sink, "open"):
                sink = sink.open(batch.sparkSession, batch_id)
            sink.write_events(batch, batch_id)
            errors = self._flag(sink, batch, batch_id)
            if hasattr(sink, "commit"):
                sink.commit()
            if errors:
                raise ExceptionGroup(f"flags of batch {batch_id}", errors)
        finally:
            batch.unpersist()

    def _flag(self, sink, batch, batch_id) -> list[Exception]:
        errors = []
        for place, detector in enumerate(self.chain):
            try:
                hits = (row_hits(batch, [detector]) if hasattr(detector, "matched")
                        else detector.hits(batch))
                sink.write_flagged(flagged(hits), batch_id, part=str(place))
            except Exception as error:
                failed = RuntimeError(f"detector {place}: {error}")
                failed.__cause__ = error
                errors.append(failed)
        return errors


@dataclass(frozen=True)
class Ingest:
    """The running queries: views and flags of single events, and one for each rate rule."""

    queries: list[StreamingQuery]

    def awaitTermination(self) -> None:
        for query in self.queries:
            query.awaitTermination()

    def processAllAvailable(self) -> None:
        for query in self.queries:
            query.processAllAvailable()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def start_ingest(events: DataFrame, sink: Sink, chain: list, checkpoint: str,
                 delay: str = "10 minutes", **trigger) -> Ingest:
    """Run `events` through an `IngestStep`, and through a query with state for each `RateDetector`, whose
    flags come once `delay` (the allowed disorder) has passed.

    `trigger` is Spark's own: `processingTime="50 milliseconds"` flushes on an interval,
    `availableNow=True` stops at the end of the input. Rows per batch are the source's options,
    such as `maxFilesPerTrigger` or `maxOffsetsPerTrigger`.
    """
    def start(rows, step, name):
        return (rows.writeStream.outputMode("append").foreachBatch(step)
                .option("checkpointLocation", f"{checkpoint}/{name}").trigger(**trigger).start())

    def own(name):
        return sink.for_stream(f"{checkpoint}/{name}") if hasattr(sink, "for_stream") else sink

    rates = [d for d in chain if isinstance(d, RateDetector)]
    rest = [d for d in chain if d not in rates]
    given = F.coalesce(F.col("received_at") < closing_time(), F.lit(True))
    queries = [start(events.filter(given), IngestStep(own("events"), rest), "events")]
    for place, detector in enumerate(rates):
        def write(batch, batch_id, place=place):
            own(f"rate-{place}").write_flagged(flagged(batch), batch_id, part=f"rate-{place}")

        with state_on_disk(events.sparkSession):
            queries.append(start(live_rate_hits(events, detector.rule, delay), write, f"rate-{place}"))
    return Ingest(queries)
