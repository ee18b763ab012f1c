"""File tables of the two event views and the flags, a count-only sink, and their protocol."""

import hashlib
import time
import uuid
from collections import Counter
from copy import copy
from dataclasses import replace
from datetime import datetime, timedelta
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from tidewatch import schemas
from tidewatch.operators import reads
from tidewatch.plans import layout
from tidewatch.plans.durable import CODEC, folders, removed, shuffles_removed, staged, whole_files
from tidewatch.plans.latest import latest_by_key, repeats
from tidewatch.sinks.commits import CommitLog, Conflict, Record, Written, meeting

FULL = "full"
AUTHORS_ONLY = "did_only"

SET, ORDER = "set_id", "_order"
#: Hours that the commit of a set lists at most.
MOST_HOURS = 10_000
#: Sets that one column tells apart where they are compared.
BITS = 32
#: Rows that are shuffled at once where a set is written in slices and a column of the key parts them.
SLICE_ROWS = 6_000_000
#: Records in one file at most.
FILE_RECORDS = 2_000_000

#: Columns of an event that are part of both primary keys.
EVERY_KEY = ["received_at", "id"]

BY_DID_TABLE = "events_by_did"
BY_MINUTE_TABLE = "events_by_minute"
FLAGGED_TABLE = "flagged_events"
_DATED = "bucket_date"
#: Columns of each table, its key, its folders, its layout.
TABLES = {
    BY_DID_TABLE: (schemas.BY_DID, schemas.BY_DID_KEY, [], layout.lay_by_did),
    BY_MINUTE_TABLE: ([*schemas.BY_MINUTE, _DATED], [*schemas.BY_MINUTE_KEY, _DATED],
                      ["kind", _DATED], layout.lay_by_minute),
    FLAGGED_TABLE: ([*schemas.FLAGGED.fieldNames(), _DATED], [*schemas.FLAGGED_KEY, _DATED],
                    [_DATED], layout.lay_flagged),
}


class Sink(Protocol):
    """Takes events first, then flags. A repeated `batch` replaces what it wrote before; without a
    number each write adds to what is there."""

    def write_events(self, events: DataFrame, batch: int | None = None) -> None: ...

    def write_flagged(self, rows: DataFrame, batch: int | None = None,
                      part: str = "all") -> None: ...


def write_mode(name: str) -> str:
    """`did_only`, or `full` for anything else."""
    return AUTHORS_ONLY if name == AUTHORS_ONLY else FULL


class TableSink:
    """Parquet tables under one folder, made of sets of rows that a commit log names.

    Each write makes sets of its own, never writes over another one's, and becomes visible by one commit:
    both views together, and with `open` the flags of the batch as well. Of equal keys the row that was
    committed last is read. The commit notes the times and rules in a set, and only sets that may share a
    key are searched for equal ones.

    Numbers of batches belong to a stream (see `for_stream`), whose repeated batch replaces its own.

    Equal keys within a batch become one row. Whether there are any is found from the key columns
    alone, so that rows without repeats are not shuffled for it. Say `unique` when the source never
    repeats a key, also not across batches; then neither writes nor reads look for repeats. The input
    is evaluated once: it is staged as a table, which both views are laid out from.
    """

    def __init__(self, folder: str, mode: str = FULL, unique: bool = False):
        self.folder = folder.rstrip("/")
        self.mode = write_mode(mode)
        self.unique = unique
        self.stream = ""

    def for_stream(self, name: str) -> "TableSink":
        """This sink for one stream. `name` is one that only this stream has, such as its checkpoint
        folder."""
        own = copy(self)
        own.stream = hashlib.sha1(name.encode()).hexdigest()
        return own

    def open(self, spark: SparkSession, batch: int | None = None) -> "OpenBatch":
        """Views and flags that are committed together, in place of all that the batch wrote before."""
        return OpenBatch(self, spark, batch, whole=True)

    def write_events(self, events: DataFrame, batch: int | None = None) -> None:
        one = OpenBatch(self, events.sparkSession, batch, whole=False)
        one.write_events(events)
        one.commit()

    def write_flagged(self, rows: DataFrame, batch: int | None = None, part: str = "all") -> None:
        one = OpenBatch(self, rows.sparkSession, batch, whole=False)
        one.write_flagged(rows, part=part)
        one.commit()

    def events_by_did(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, BY_DID_TABLE)

    def events_by_minute(self, spark: SparkSession) -> DataFrame:
        rows = self._table(spark, BY_MINUTE_TABLE)
        # An empty kind is the name of no folder, and comes back as null.
        return rows.withColumn("kind", F.coalesce("kind", F.lit("")))

    def flagged_events(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, FLAGGED_TABLE)

    def recent_flagged(self, spark: SparkSession, as_of: datetime, since: timedelta = reads.LOOKBACK,
                       limit: int = reads.FLAG_LIMIT) -> DataFrame:
        """`reads.recent_flagged` of this store, of the newest hours alone that fill the limit. Commits say how
        many rows an hour has; a set that may share keys with others counts with them as one."""
        sets = [s for s in self._log(spark).live() if s.table == FLAGGED_TABLE and s.rows]
        first, last = reads.hours_back(as_of, since)
        if all(s.hours is not None for s in sets):
            mixed, rows = meeting(sets), Counter()
            for one in sets:
                if one not in mixed:
                    rows.update(dict(one.hours))
            for hour in {h for s in mixed for h, _ in s.hours}:
                rows[hour] += max(dict(s.hours).get(hour, 0) for s in mixed)
            found = 0
            for hour in sorted((h for h in rows if first <= h <= last), reverse=True):
                found += rows[hour]
                if found >= (limit if limit > 0 else reads.FLAG_LIMIT):
                    first = hour
                    break
            sets = [s for s in sets if any(first <= h <= last for h, _ in s.hours)]
        flags = self._read(spark, FLAGGED_TABLE, sets)
        start = F.timestamp_seconds(F.lit(first * 3600))
        newest = (F.col("bucket_hour") >= start) & (F.col(_DATED) >= F.to_date(start))
        return reads.recent_flagged(flags.filter(newest), as_of, since, limit)

    def compact(self, spark: SparkSession, keep: timedelta = timedelta(days=1)) -> None:
        """Make one set of each table, table by table. Others may write and read meanwhile: the merged rows keep
        their place in the order of arrival, and a table's commit fails if something that was merged has been replaced.

        Sets and records that are no longer needed go once they are older than `keep`, which has to exceed
        the time that a read or a write takes.
        """
        log = self._log(spark)
        seen = log.live()
        made = False
        # The views come last and the widest at the end: what was merged before has gone by then.
        for table in reversed(TABLES):
            sets = [s for s in seen if s.table == table and s.rows]
            if len(sets) > 1:
                one = self._merged(spark, table, sets)
                hours = _hours(self._sets(spark, table, [one])) if table == FLAGGED_TABLE else None
                self._replace(spark, sets, replace(one, order=max(s.order for s in sets), hours=hours))
                self._drop_sets(spark, keep)
                made = True
        if made:
            log.add(lambda live, number: Record([s for s in live if s.rows], snapshot=True))
            self.vacuum(spark, keep)

    def _replace(self, spark: SparkSession, sets: list[Written], made: Written) -> None:
        names = {s.name for s in sets}

        def record(live: list[Written], number: int) -> Record:
            if not names <= {s.name for s in live}:
                raise Conflict("a set that was merged has been replaced")
            return Record([made], replaces=sorted(names))

        try:
            self._log(spark).add(record)
        except Conflict:
            self._remove(spark, made.table, made.name)
            raise

    def compare(self, spark: SparkSession) -> None:
        """Note in the log which sets share no key, found from the key columns alone. Reads then shuffle the rows
        of those sets only that do share some. Pairs of sets are noted: this is for stores of few sets, as after
        a compaction."""
        log, apart = self._log(spark), []
        live = log.live()
        for table, (_, key, *_) in TABLES.items():
            mixed = [] if self.unique else meeting([s for s in live if s.table == table])
            shared = self._sharing(spark, table, key, mixed) if mixed else set()
            apart += [[a.name, b.name] for i, a in enumerate(mixed) for j, b in enumerate(mixed[:i])
                      if a.may_meet(b) and (j, i) not in shared]
        if apart:
            log.add(lambda live, number: Record(apart=apart))

    def vacuum(self, spark: SparkSession, keep: timedelta) -> None:
        """Remove sets that are not live and older than `keep`, and records before the last snapshot but
        one."""
        log = self._log(spark)
        self._drop_sets(spark, keep)
        log.drop_before((log.snapshots() or [0])[-2:][0])

    def _drop_sets(self, spark: SparkSession, keep: timedelta) -> None:
        oldest = _now() - keep // timedelta(milliseconds=1)
        before = {table: folders(spark, self._location(spark, table)) for table in TABLES}
        live = {s.name for s in self._log(spark).live()}
        for table, names in before.items():
            for name in (n.removeprefix(f"{SET}=") for n in names if n.startswith(f"{SET}=")):
                if name not in live and int(name.split("-")[0]) <= oldest:
                    self._remove(spark, table, name)

    def write_set(self, df: DataFrame, table: str, part: str, to: Written | None = None) -> Written:
        """Write rows that are laid out as a set, which no reader knows of yet. With `to`, add them to that one."""
        one = to or Written(table, f"{_now():013d}-{uuid.uuid4().hex}", part, 0)
        at, seen = F.unix_micros("received_at"), Observation()
        rule = F.col("rule_id") if "rule_id" in df.columns else F.lit(None).cast("string")
        with shuffles_removed(df.sparkSession):
            self._store(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(at).alias("timed"),
                                   F.min(at).alias("low"), F.max(at).alias("high"),
                                   F.min(rule).alias("first"), F.max(rule).alias("last")), one)
        found = seen.get
        rows = found.get("rows", 0)
        timed = rows and found["timed"] == rows
        new = replace(one, rows=rows, low=found["low"] if timed else None,
                      high=found["high"] if timed else None, first=found.get("first"),
                      last=found.get("last"))
        return to.joined(new) if to else new

    # Where sets lie. A store of another kind differs in these alone.

    def _log(self, spark: SparkSession) -> CommitLog:
        return CommitLog(spark, f"{self.folder}/_commits")

    def _location(self, spark: SparkSession, table: str) -> str:
        return f"{self.folder}/{table}"

    def _laid(self, df: DataFrame, table: str, rows: int, once: bool = True) -> DataFrame:
        """Rows as a set holds them. Unless they are `once`, one row of each key is left, that of the latest `ORDER`
        where they have one."""
        return TABLES[table][3](df, rows, None if once else lambda ranged: _last(ranged, table))

    def _store(self, df: DataFrame, one: Written) -> None:
        (df.write.mode("append").partitionBy(*TABLES[one.table][2]).option("maxRecordsPerFile", FILE_RECORDS)
         .option("compression", CODEC)
         .parquet(f"{self.folder}/{one.table}/{SET}={one.name}"))

    def _remove(self, spark: SparkSession, table: str, name: str) -> None:
        removed(spark, f"{self.folder}/{table}/{SET}={name}")

    def _sets(self, spark: SparkSession, table: str, sets: list[Written]) -> DataFrame:
        """The rows of sets, with their names."""
        types = {f.name: f.dataType for f in [*schemas.EVENT, *schemas.FLAGGED]}
        types |= {"bucket_minute": T.TimestampType(), _DATED: T.DateType(), SET: T.StringType()}
        schema = T.StructType([T.StructField(c, types[c]) for c in [*TABLES[table][0], SET]])
        if not sets:
            return spark.createDataFrame([], schema)
        top = f"{self.folder}/{table}"
        return (spark.read.schema(schema).option("basePath", top)
                .parquet(*[f"{top}/{SET}={s.name}" for s in sets]))

    def _merged(self, spark: SparkSession, table: str, sets: list[Written]) -> Written:
        """The rows of `_read`, written as one set."""
        once = self.unique or not meeting(sets)
        rows = self._sets(spark, table, sets) if once else self._arrived(spark, table, sets)
        return self._write_slices(rows, table, sum(s.rows for s in sets), once)

    def _write_slices(self, rows: DataFrame, table: str, n: int, once: bool) -> Written:
        """Write `n` rows as a set. They are shuffled slice by slice, so that the shuffle files of one slice alone lie
        beside what is written."""
        slices, made = _slices(rows, table, n), []
        for some in slices:
            laid = self._laid(rows.filter(some), table, -(-n // len(slices)), once)
            made = [self.write_set(laid.select(*TABLES[table][0]), table, "all", *made)]
        return made[0]

    def _table(self, spark: SparkSession, table: str) -> DataFrame:
        live = self._log(spark).live()
        return self._read(spark, table, [s for s in live if s.table == table and s.rows])

    def _arrived(self, spark: SparkSession, table: str, sets: list[Written]) -> DataFrame:
        """The rows of sets, with the numbers of their commits."""
        orders = spark.createDataFrame([(s.name, s.order) for s in sets], f"{SET} string, {ORDER} long")
        # A row for each set, as the log lists them to the driver. A shuffle would put a whole set into one task.
        return (self._sets(spark, table, sets).join(F.broadcast(orders), SET)
                .select(*TABLES[table][0], ORDER))

    def _sharing(self, spark: SparkSession, table: str, key: list[str], sets: list[Written]) -> set[tuple[int, int]]:
        """Pairs of positions in `sets`, the smaller first, of those that have some key in common."""
        places = spark.createDataFrame([(s.name, i) for i, s in enumerate(sets)], f"{SET} string, _at int")
        rows = self._sets(spark, table, sets).select(*key, SET).join(F.broadcast(places), SET)
        # A bit for each set that has the key.
        bits = [F.bit_or(F.when(F.floor(F.col("_at") / BITS) == c, F.expr(f"shiftleft(1L, _at % {BITS})")).otherwise(0))
                .alias(f"_bits{c}") for c in range(-(-len(sets) // BITS))]
        found = rows.groupBy(*key).agg(*bits).select([f"_bits{c}" for c in range(len(bits))])
        held = F.array_compact(F.array(*[F.when(F.getbit(f"_bits{i // BITS}", F.lit(i % BITS)) == 1, F.lit(i))
                                         for i in range(len(sets))]))
        pairs = (found.select(held.alias("held")).filter(F.size("held") > 1).distinct()
                 .select("held", F.explode("held").alias("one"))
                 .select("one", F.explode("held").alias("other")).filter("one < other").distinct())
        with shuffles_removed(spark):
            return {(r["one"], r["other"]) for r in pairs.collect()}

    def _read(self, spark: SparkSession, table: str, sets: list[Written]) -> DataFrame:
        """Rows of the sets; of equal keys the one that was committed last."""
        columns, key = TABLES[table][:2]
        mixed = [] if self.unique else meeting(sets)
        alone = [s for s in sets if s not in mixed]
        rows = self._sets(spark, table, alone).select(*columns)
        if not mixed:
            return rows
        latest = latest_by_key(self._arrived(spark, table, mixed), key, [ORDER]).select(*columns)
        return rows.unionByName(latest) if alone else latest


def fan_out(events: DataFrame, targets: list[tuple[TableSink, Column | None]]) -> None:
    """`write_events` to several sinks, each with all events or with those that a condition keeps. The events are
    evaluated and staged once. Rows that the first sink has laid out by author are not shuffled again for the others:
    they are copied file by file, so the files keep their order and their ranges. That takes sinks of files, of which
    the first has all events.
    """
    spark = events.sparkSession
    with staged(events, "events") as (rows, n):
        once = all(sink.unique for sink, _ in targets) or not repeats(rows, EVERY_KEY)
        first = None
        for sink, kept in targets:
            one = OpenBatch(sink, spark, None, whole=False)
            some = rows if kept is None else rows.filter(kept)
            # The first sink left one of equal keys: a condition might drop that row and keep another.
            alike = first and (once or kept is None and sink.unique == first[0].unique)
            laid = first if alike and type(sink) is type(first[0]) is TableSink else None
            one.write_staged(some, n if kept is None else some.count(), sink.unique or once, laid, kept)
            one.commit()
            if first is None and kept is None:
                first = sink, one.sets[0]


class OpenBatch:
    """What one batch has written and not yet committed. It is a sink itself; `batch` is its own."""

    def __init__(self, sink: TableSink, spark: SparkSession, batch: int | None, whole: bool):
        self.sink, self.spark, self.whole = sink, spark, whole
        self.owner = None if batch is None else f"{sink.stream}/{batch}"
        self.sets: list[Written] = []

    def write_events(self, events: DataFrame, batch: int | None = None) -> None:
        with staged(events, "events") as (rows, n):
            self.write_staged(rows, n, self.sink.unique or not repeats(rows, EVERY_KEY))

    def write_staged(self, rows: DataFrame, n: int, once: bool, laid: tuple[TableSink, Written] | None = None,
                     kept: Column | None = None) -> None:
        """Write `n` events that lie in files. Their author view is that of `laid`, as far as `kept`, where one is
        given. Both author views then lie on disk, so the minute view is shuffled slice by slice."""
        if laid and n:
            with whole_files(self.spark):
                view = laid[0]._sets(self.spark, BY_DID_TABLE, [laid[1]]).select(*schemas.BY_DID)
                view = view if kept is None else view.filter(kept)
                self.sets.append(self.sink.write_set(view, BY_DID_TABLE, "all"))
        else:
            self._write(layout.by_did(rows), BY_DID_TABLE, n, once, "all")
        if self.sink.mode == FULL:
            view = layout.by_minute(rows)
            if laid and n:
                self.sets.append(self.sink._write_slices(layout.dated(view), BY_MINUTE_TABLE, n, once))
            else:
                self._write(view, BY_MINUTE_TABLE, n, once, "all")

    def write_flagged(self, rows: DataFrame, batch: int | None = None, part: str = "all") -> None:
        with staged(rows, "flags") as (found, n):
            once = self.sink.unique or not repeats(found, schemas.FLAGGED_KEY)
            self._write(found, FLAGGED_TABLE, n, once, part)
            if n:
                self.sets[-1] = replace(self.sets[-1], hours=_hours(found))

    def commit(self) -> None:
        """Make it visible. The order among commits is that in which they are made."""
        def record(live: list[Written], number: int) -> Record:
            return Record([replace(s, owner=self.owner, order=number) for s in self.sets],
                          batch=self.owner if self.whole else None)

        self.sink._log(self.spark).add(record)

    def _write(self, view, table, n, once, part) -> None:
        if not n:  # a set without rows still takes the place of what its batch wrote before
            self.sets.append(Written(table, f"{_now():013d}-{uuid.uuid4().hex}", part, 0))
            return
        self.sets.append(self.sink.write_set(self.sink._laid(view, table, n, once), table, part))


def _last(rows: DataFrame, table: str) -> DataFrame:
    return latest_by_key(rows, TABLES[table][1], [c for c in rows.columns if c == ORDER])


def _slices(rows: DataFrame, table: str, n: int) -> list[Column]:
    """Conditions that part `n` rows into ranges of `SLICE_ROWS` or so, by a column of the key that files are narrow in,
    so that a slice opens little more than its own files."""
    lead, count = "did" if table == BY_DID_TABLE else _DATED, -(-n // SLICE_ROWS)
    if count < 2:
        return [F.lit(True)]
    # Spark's own ranges: equal values lie in one.
    least = (rows.select(lead).repartitionByRange(count, lead)
             .groupBy(F.spark_partition_id().alias("slice")).agg(F.min(lead).alias("least")))
    with shuffles_removed(rows.sparkSession):
        bounds = sorted(r["least"] for r in least.collect() if r["least"] is not None)[1:]
    at = F.col(lead)
    if not bounds:
        return [F.lit(True)]
    return [at.isNull() | (at < bounds[0]),
            *[(at >= low) & (at < high) for low, high in zip(bounds, bounds[1:])], at >= bounds[-1]]


def _hours(flags: DataFrame) -> list[list[int]] | None:
    """The hours of the flags and how many different keys each has; None where they are too many to list."""
    hour = F.floor(F.unix_seconds("bucket_hour") / 3600).alias("hour")
    keys = flags.select(hour, *schemas.FLAGGED_KEY).distinct().groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    with shuffles_removed(flags.sparkSession):
        rows = keys.limit(MOST_HOURS + 1).collect()
    if len(rows) > MOST_HOURS or any(r["hour"] is None for r in rows):
        return None
    return sorted([r["hour"], r["n"]] for r in rows)


def _now() -> int:
    return time.time_ns() // 1_000_000


class CountSink:
    """Runs the plans and keeps only the number of rows."""

    def __init__(self):
        self.events = 0
        self.flags = 0

    def write_events(self, events: DataFrame, batch: int | None = None) -> None:
        self.events += _counted(events)

    def write_flagged(self, rows: DataFrame, batch: int | None = None, part: str = "all") -> None:
        self.flags += _counted(rows)


def _counted(df: DataFrame) -> int:
    seen = Observation()
    with shuffles_removed(df.sparkSession):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get["rows"]
