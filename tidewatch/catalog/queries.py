"""The registered queries: `name -> (spark, folder) -> DataFrame`."""

from datetime import timedelta
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch import schemas
from tidewatch.catalog import settings
from tidewatch.functions.links import host
from tidewatch.functions.text import severity
from tidewatch.functions.times import MINUTE
from tidewatch.operators import reads, rollups, signals, sketches
from tidewatch.operators.blocklist import LinkDetector, LinkTableDetector, normalised
from tidewatch.operators.composite import detectors, flag
from tidewatch.operators.keyword import SpamDetector, is_post_with_text
from tidewatch.operators.keyword_table import KeywordTableDetector
from tidewatch.operators.rate import RateDetector
from tidewatch.operators.reconcile import reconcile
from tidewatch.operators.repetition import near_repeated_posts
from tidewatch.plans.durable import scratch_path, written
from tidewatch.plans.latest import latest_by_key
from tidewatch.plans.ordered import row_numbers
from tidewatch.rules import SpamRule
from tidewatch.sinks.catalog import CatalogSink
from tidewatch.sinks.tables import AUTHORS_ONLY, FULL, CountSink, TableSink, fan_out
from tidewatch.sources.events import parsed, read_events
from tidewatch.sources.tables import COLUMNS, as_events, did, light_events, table, table_events
from tidewatch.streaming.ingest import start_ingest
from tidewatch.streaming.live import (Closable, live_sliding, live_tumbling, start_append,
                                      without_replays)
from tidewatch.streaming.rate import live_rate_hits

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# How results are written out: timestamps without zone, lists and maps as text.

def plain(df: DataFrame) -> DataFrame:
    return df.select(*[_plain(field) for field in df.schema])


def _plain(field) -> Column:
    kind, column = field.dataType.typeName(), F.col(field.name)
    if kind == "timestamp":
        column = column.cast("timestamp_ntz")
    elif kind == "array":
        column = F.array_join(column, "|")
    elif kind == "map":
        column = F.array_join(F.transform(F.array_sort(F.map_entries(column)),
                                          lambda e: F.concat(e.key, F.lit("="), e.value)), ";")
    return column.alias(field.name)


def light(spark: SparkSession, folder: str) -> DataFrame:
    """Events without text, for jobs that do not look at it."""
    return (light_events(table(spark, folder, "events"))
            .select("id", "did", "kind", F.lit("").alias("text"), "received_at"))


def latency(folder_events: DataFrame) -> Column:
    """Milliseconds in `value` as whole microseconds."""
    return F.round(folder_events["value"] * 1000).cast("long")


# Sources and sinks

@query
def events_scan(spark, folder):
    path = scratch_path(spark, "json-events")
    (table_events(spark, folder).write
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path, compression="gzip"))
    return plain(read_events(spark, path, "json"))


def _stored(spark, folder, name, mode=FULL) -> TableSink:
    sink = TableSink(scratch_path(spark, name), mode)
    sink.write_events(table_events(spark, folder))
    return sink


@query
def view_events_by_did(spark, folder):
    return plain(_stored(spark, folder, "by-did", AUTHORS_ONLY).events_by_did(spark))


@query
def view_events_by_minute(spark, folder):
    return plain(_stored(spark, folder, "by-minute").events_by_minute(spark).drop("bucket_date"))


def _stored_flags(spark, folder) -> DataFrame:
    sink = TableSink(scratch_path(spark, "flagged"))
    sink.write_flagged(flag(table_events(spark, folder), detectors(settings.RULES)))
    return sink.flagged_events(spark)


@query
def view_flagged_events(spark, folder):
    return plain(_stored_flags(spark, folder).drop("bucket_date"))


def _counts(tables: dict[str, DataFrame], first: str) -> DataFrame:
    result = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias(first), "rows")
        result = one if result is None else result.unionByName(one)
    return result


@query
def fanout_row_counts(spark, folder):
    full = TableSink(scratch_path(spark, "fanout-full"))
    authors = TableSink(scratch_path(spark, "fanout-authors"), AUTHORS_ONLY)
    fan_out(table_events(spark, folder), [(full, None), (authors, None)])
    return (_counts({"full events_by_did": full.events_by_did(spark),
                     "full events_by_minute": full.events_by_minute(spark),
                     "did_only events_by_did": authors.events_by_did(spark)}, "target"))


def _with_replay(events: DataFrame) -> DataFrame:
    """Every event twice: as sent, and once more with its text marked."""
    text = F.when(F.col("arrival") == 2, F.concat("text", F.lit(" (again)"))).otherwise(F.col("text"))
    return events.withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("text", text)


@query
def upsert_latest_by_key(spark, folder):
    sent = _with_replay(table_events(spark, folder))
    kept = latest_by_key(sent, schemas.BY_DID_KEY, ["arrival"])
    return plain(kept.select("did", "received_at", "id", "kind", "text", "arrival"))


@query
def two_writes_upsert(spark, folder):
    """Events in two writes without numbers, and a third that sends some again: nothing replaces more
    than its own keys."""
    events = table_events(spark, folder)
    sink = TableSink(scratch_path(spark, "two-writes"), AUTHORS_ONLY)
    late = F.col("kind") == schemas.POST
    sink.write_events(events.filter(~late))
    sink.write_events(events.filter(late))
    sink.write_events(events.filter(F.col("kind") == schemas.FOLLOW)
                      .withColumn("text", F.lit("again")))
    sink.compare(spark)
    return plain(sink.events_by_did(spark).select("did", "received_at", "id", "kind", "text"))


@query
def compacted_views(spark, folder):
    """The rows of both views and of the flags after several batches were merged."""
    events = table_events(spark, folder)
    sink = TableSink(scratch_path(spark, "compacted"))
    sink.write_events(events)
    sink.write_events(events.filter(F.col("kind") == schemas.FOLLOW).withColumn("text", F.lit("again")))
    for detector in detectors(settings.RULES)[:2]:
        sink.write_flagged(flag(events, [detector]))
    sink.compact(spark, timedelta(0))

    def rows(target, view, rule=F.lit("")):
        return view.select(F.lit(target).alias("target"), "did", "received_at", "id", "kind",
                           rule.alias("rule_id"), F.length("text").alias("text_length"))

    return plain(rows("events_by_did", sink.events_by_did(spark))
                 .unionByName(rows("events_by_minute", sink.events_by_minute(spark)))
                 .unionByName(rows("flagged_events", sink.flagged_events(spark), F.col("rule_id"))))


def _catalog_store(spark, folder, name) -> CatalogSink:
    """The author view in a database of its own, after two writes of which the second sends some again."""
    path = scratch_path(spark, name)
    database = "tidewatch_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    sink, events = CatalogSink(spark, database, AUTHORS_ONLY), table_events(spark, folder)
    sink.write_events(events)
    sink.write_events(events.filter(F.col("kind") == schemas.FOLLOW).withColumn("text", F.lit("again")))
    return sink


@query
def catalog_events_by_did(spark, folder):
    rows = _catalog_store(spark, folder, "catalog").events_by_did(spark)
    return plain(rows.select("did", "received_at", "id", "kind", "text"))


@query
def catalog_recent_by_author(spark, folder):
    sink = _catalog_store(spark, folder, "catalog-recent")
    rows = reads.recent_events(sink.events_by_did(spark), settings.AUTHOR, settings.AUTHOR_LIMIT)
    return plain(rows.select("did", "received_at", "id", "kind", "text"))


@query
def sink_counts(spark, folder):
    sink, events = CountSink(), table_events(spark, folder)
    sink.write_events(events)
    sink.write_flagged(flag(events, detectors(settings.RULES)))
    return spark.createDataFrame([(sink.events, sink.flags)], "events bigint, flags bigint")


def _partly_stored(spark, folder) -> DataFrame:
    """Reconciliation after a run in which only posts reached the minute view."""
    authors = TableSink(scratch_path(spark, "reconcile-authors"), AUTHORS_ONLY)
    posts = TableSink(scratch_path(spark, "reconcile-posts"))
    fan_out(table_events(spark, folder), [(authors, None), (posts, F.col("kind") == schemas.POST)])
    sent = light(spark, folder).withColumn("bucket_minute", F.date_trunc("minute", "received_at"))
    return reconcile(sent, {
        "events_by_did": (authors.events_by_did(spark), schemas.BY_DID_KEY),
        "events_by_minute": (posts.events_by_minute(spark), schemas.BY_MINUTE_KEY)})


@query
def reconcile_views(spark, folder):
    return _partly_stored(spark, folder)


# Projections and filters

@query
def severity_normalize(spark, folder):
    kind = F.col("event_type")
    given = (F.when(kind == "click", "low").when(kind == "view", "MEDIUM")
             .when(kind == "purchase", "medium").when(kind == "signup", "high").otherwise(""))
    return (table(spark, folder, "events")
            .select("event_id", given.alias("given"), severity(given).alias("severity")))


def _entries(spark, folder) -> DataFrame:
    """One blocklist entry per page, in several spellings."""
    name = F.regexp_extract("url", "//([^/]*)", 1)
    spelled = (F.when(F.col("url").startswith("https"), F.concat(F.lit(" *."), F.upper(name)))
               .otherwise(F.concat(F.lit("."), name, F.lit("\t"))))
    return table(spark, folder, "pages").select(spelled.alias("entry"))


@query
def blocklist_normalize(spark, folder):
    return normalised(_entries(spark, folder))


@query
def link_hosts(spark, folder):
    name = F.regexp_extract("url", "//([^/]*)", 1)
    spellings = F.array(
        F.col("url"), F.concat(F.lit("HTTPS://me:pw@"), F.upper(name), F.lit(":8443/x?q=%zz")),
        F.concat(F.lit("//"), name), F.concat("url", F.lit("%zz")),
        F.concat(F.lit("mailto:"), name), F.replace("url", F.lit("://"), F.lit(":/")),
        F.concat(F.lit("http://[2001:DB8::1]:80/"), name),
        F.concat(F.lit("http://a b."), name), F.concat(F.lit("http://"), name, F.lit(":port/")),
        F.concat(F.lit("http://x_y."), name, F.lit("#top%20"), F.lit("?q=a|b")))
    links = table(spark, folder, "pages").select("page_id", F.explode(spellings).alias("link"))
    return links.select("page_id", "link", host(F.col("link")).alias("host"))


@query
def display_events(spark, folder):
    return reads.display_events(table_events(spark, folder))


@query
def posts_with_text(spark, folder):
    return table_events(spark, folder).filter(is_post_with_text()).select("id", "did", "text")


@query
def kind_minute_window(spark, folder):
    view = _stored(spark, folder, "minute-window").events_by_minute(spark)
    rows = reads.kind_window(view, schemas.POST, settings.WINDOW_FIRST, settings.WINDOW_LAST)
    return plain(rows.select("kind", "bucket_minute", "received_at", "id", "did", "text"))


# Detection

def _matches(spark, folder, rule: SpamRule) -> DataFrame:
    detector = SpamDetector(rule)
    return (table_events(spark, folder).filter(detector.matched())
            .select("id", F.array_join(detector.matches(), "|").alias("matches")))


@query
def detect_keyword(spark, folder):
    return _matches(spark, folder, SpamRule(settings.RULES.spam_keywords))


@query
def detect_regex(spark, folder):
    return _matches(spark, folder, SpamRule((), settings.RULES.spam_regexes))


@query
def detect_spam(spark, folder):
    return plain(SpamDetector(settings.RULES.spam()).hits(table_events(spark, folder))
                 .drop("text"))


@query
def detect_spam_table(spark, folder):
    """The spam rule with its keywords as a table."""
    rule = settings.RULES
    keywords = spark.createDataFrame(list(enumerate(rule.spam_keywords)), "place long, keyword string")
    detector = KeywordTableDetector(keywords, rule.spam_severity, rule.spam_regexes)
    return plain(detector.hits(table_events(spark, folder)).drop("text"))


@query
def detect_keyword_table(spark, folder):
    """A keyword for each benchmark item, the first 24 characters of its text with A to Z for a to z."""
    start = F.translate(F.left("text", F.lit(24)), ascii_lowercase, ascii_uppercase)
    keywords = table(spark, folder, "benchmark").select(F.col("item_id").alias("place"), start.alias("keyword"))
    hits = KeywordTableDetector(keywords).hits(table_events(spark, folder))
    return hits.select("id", F.element_at("evidence", "matches").alias("matches"))


@query
def detect_blocklist(spark, folder):
    return plain(LinkDetector(settings.RULES.links()).hits(table_events(spark, folder))
                 .drop("text"))


@query
def detect_blocklist_table(spark, folder):
    detector = LinkTableDetector(_entries(spark, folder), "high")
    return plain(detector.hits(table_events(spark, folder)).drop("text"))


@query
def detect_rate_spike(spark, folder):
    return plain(RateDetector(settings.RULES.rate()).hits(light(spark, folder)).drop("text"))


@query
def flagged_all_rules(spark, folder):
    return plain(flag(table_events(spark, folder), detectors(settings.RULES)))


@query
def detect_excessive_caps(spark, folder):
    return signals.excessive_caps(table_events(spark, folder))


@query
def detect_mention_storm(spark, folder):
    """The given texts mention nobody, so each post mentions the hosts it links to."""
    named = F.transform("links", lambda link: F.concat(F.lit(" @"), host(link)))
    events = table_events(spark, folder).withColumn("text", F.concat("text", F.array_join(named, "")))
    return plain(signals.mention_storms(events, *settings.STORM))


@query
def detect_repetition_exact(spark, folder):
    return signals.repeated_posts(table_events(spark, folder))


@query
def detect_repetition_near(spark, folder):
    return near_repeated_posts(table_events(spark, folder))


# Reads

@query
def recent_events_by_author(spark, folder):
    view = _stored(spark, folder, "recent", AUTHORS_ONLY).events_by_did(spark)
    return plain(reads.recent_events(view, settings.AUTHOR, settings.AUTHOR_LIMIT))


@query
def recent_events_all_authors(spark, folder):
    rows = reads.recent_events_per_author(light(spark, folder), settings.PER_AUTHOR_LIMIT)
    return plain(rows.select("did", "received_at", "id", "kind"))


@query
def recent_flagged(spark, folder):
    rows = reads.recent_flagged(_stored_flags(spark, folder), settings.AS_OF, settings.SINCE,
                                settings.FLAG_LIMIT)
    return plain(rows.drop("bucket_date"))


@query
def recent_flagged_newest_hours(spark, folder):
    """A look far back with a small limit, which opens the newest hours alone."""
    sink = TableSink(scratch_path(spark, "flagged-hours"))
    for detector in detectors(settings.RULES):
        sink.write_flagged(flag(table_events(spark, folder), [detector]))
    rows = sink.recent_flagged(spark, settings.AS_OF, 10 * settings.SINCE, settings.FEW_FLAGS)
    return plain(rows.drop("bucket_date"))


@query
def display_flagged(spark, folder):
    return reads.display_flagged(flag(table_events(spark, folder), detectors(settings.RULES)))


@query
def author_sequence(spark, folder):
    rows = row_numbers(light(spark, folder), ["did"], ["received_at", "id"], "seq")
    return plain(rows.select("did", "received_at", "id", "seq"))


# Rollups

def _raw_lines(spark, folder) -> DataFrame:
    """Events as JSON text; those of kind profile arrive cut short."""
    line = F.to_json(F.struct("id", "did", "kind", "received_at"))
    cut = F.when(F.col("kind") == schemas.PROFILE, F.left(line, F.length(line) - 9))
    return light(spark, folder).select(F.coalesce(cut, line).alias("value"))


@query
def run_totals(spark, folder):
    return rollups.totals(parsed(_raw_lines(spark, folder)), F.col("_corrupt_record").isNotNull())


@query
def run_summary(spark, folder):
    counts = rollups.totals(parsed(_raw_lines(spark, folder)),
                            F.col("_corrupt_record").isNotNull())
    landed = _partly_stored(spark, folder)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = table(spark, folder, "events").agg(((F.max(at) - F.min(at)) / 1000000).alias("seconds"))
    # One subquery, which both uses share.
    sums = landed.agg(F.struct(F.sum("landed").alias("landed"),
                               F.sum("missing").alias("missing")).alias("sums")).scalar()
    report = rollups.summary(counts, sums["landed"], sums["missing"], span.scalar())
    return report.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c)
                           for c, t in report.dtypes])


@query
def throughput_tumbling(spark, folder):
    return plain(rollups.tumbling(light(spark, folder)))


@query
def throughput_sliding(spark, folder):
    rates = rollups.sliding(light(spark, folder))
    return plain(rates.withColumn("per_sec", F.round("per_sec", 9)))


@query
def lag_percentiles(spark, folder):
    events = table(spark, folder, "events")
    return rollups.percentiles(events, latency(events))


@query
def binned_percentiles(spark, folder):
    events = table(spark, folder, "events")
    return rollups.binned_percentiles(events, latency(events))


@query
def sampled_percentiles(spark, folder):
    done = table(spark, folder, "events").filter("event_type <> 'error'")
    done = done.select("user_id", "ts", "event_id", latency(done).alias("us"))
    return rollups.percentiles(rollups.every_nth(done, ["user_id"], ["ts", "event_id"]),
                               F.col("us"))


@query
def histogram_exponential(spark, folder):
    events = table(spark, folder, "events")
    return rollups.histograms(events, {
        name: (latency(events), rollups.exponential_bounds(*bounds))
        for name, bounds in (("processing", rollups.PROCESSING_BOUNDS),
                             ("batch", rollups.BATCH_BOUNDS),
                             ("flag_write", rollups.FLAG_WRITE_BOUNDS))})


@query
def windowed_quantiles(spark, folder):
    events = table(spark, folder, "events")
    bounds = rollups.exponential_bounds(*rollups.PROCESSING_BOUNDS)
    rows = rollups.windowed_quantiles(events, "ts", latency(events), bounds)
    return plain(rows.withColumns({c: F.round(c, 6) for c in ("p50", "p99")}))


@query
def hits_by_keyword(spark, folder):
    detector = SpamDetector(settings.RULES.spam())
    posts = table_events(spark, folder).filter(detector.matched())
    return rollups.label_counts(posts, detector.matches(), "keyword")


@query
def hits_by_domain(spark, folder):
    detector = LinkDetector(settings.RULES.links())
    linked = table_events(spark, folder).filter(detector.matched())
    return rollups.label_counts(linked, detector.domains(), "domain")


@query
def rate_trips_by_window(spark, folder):
    hits = None
    for rule in settings.TRIPS:
        one = RateDetector(rule).hits(light(spark, folder))
        hits = one if hits is None else hits.unionByName(one)
    return rollups.trips_by_window(hits)


def _minutes(spark, folder) -> DataFrame:
    events = table(spark, folder, "events")
    return written(sketches.minute_summaries(events, "ts", latency(events), did(F.col("user_id"))), "minutes")


@query
def merged_percentiles(spark, folder):
    """For each day and quantile, out of sketches of minutes: whether the rank of what they say, counted
    exactly, is within the stated error of the quantile."""
    events = table(spark, folder, "events")
    said = sketches.merged(_minutes(spark, folder), "1 day")
    points = F.explode(F.array(*[F.struct(F.lit(rollups.quantile_name(q)).alias("quantile"), F.lit(q).alias("q"),
                                          F.col(rollups.quantile_name(q)).alias("point"))
                                 for q in rollups.QUANTILES])).alias("p")
    said = written(said.select("window_start", "events", "max", points).select("window_start", "events", "max", "p.*"),
                   "said")
    rows = events.select(F.date_trunc("day", "ts").alias("window_start"),
                         rollups.clamped(latency(events)).alias("v"))
    ranks = (rows.join(said, "window_start").groupBy("window_start", "quantile", "q", "events", "max")
             .agg(F.count_if(F.col("v") < F.col("point")).alias("below"),
                  F.count_if(F.col("v") <= F.col("point")).alias("upto"), F.count("v").alias("n")))
    error = F.lit(sketches.rank_error()) * F.col("n") + 1
    rank = F.col("q") * F.col("n")
    return plain(ranks.select("window_start", "quantile", "events", "max",
                              ((F.col("below") - error <= rank) & (rank <= F.col("upto") + error)).alias("within")))


@query
def merged_authors(spark, folder):
    """Authors of each day and of each 3 days every day, out of sketches of minutes: whether they are within five
    standard errors of the exact number."""
    minutes, out = _minutes(spark, folder), None
    rows = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    for length, step in (("1 day", None), ("3 days", "1 day")):
        said = sketches.merged(minutes, length, step).select("window_start", "events", F.col("authors").alias("said"))
        window = F.window("ts", length, step) if step else F.window("ts", length)
        exact = (rows.groupBy(window["start"].alias("window_start"), "user_id").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("window_start").agg(F.count(F.lit(1)).alias("authors")))
        off = F.abs(F.col("said") - F.col("authors")) <= F.col("authors") * 5 * 1.04 / 64 + 1
        one = said.join(exact, "window_start").select(F.lit(length).alias("length"), "window_start", "events",
                                                      "authors", off.alias("within"))
        out = one if out is None else out.unionByName(one)
    return plain(out)


@query
def top_words(spark, folder):
    """The hundred most frequent words of posts: labels without bound."""
    words = F.filter(F.split(F.lower("text"), "[^0-9a-z]+"), lambda w: w != "")
    posts = table_events(spark, folder).filter(is_post_with_text())
    return sketches.top_labels(posts, words, "word", 100)


@query
def flags_by_rule(spark, folder):
    return rollups.flags_by_rule(flag(table_events(spark, folder), detectors(settings.RULES)))


@query
def partition_skew(spark, folder):
    minute = F.date_trunc("minute", "received_at")
    report = rollups.key_skew(light(spark, folder), {
        "did": [F.col("did")], "kind, bucket_minute": [F.col("kind"), minute],
        "bucket_hour": [F.date_trunc("hour", "received_at")]})
    return report.withColumn("largest_to_mean", F.round("largest_to_mean", 9))


# Streams

class _Arrivals:
    """The events, written in turns to a folder that a stream reads. Order between turns is loose: the turn of
    a row goes by its time and up to `JITTER` more, so each also holds rows older than the newest one before."""

    def __init__(self, spark, folder, name, loose=True):
        self.path = scratch_path(spark, name)
        events = table(spark, folder, "events")
        jitter = F.pmod(F.xxhash64("event_id"), F.lit(settings.JITTER)) if loose else F.lit(0)
        at = F.unix_micros(F.col("ts").cast("timestamp")) + jitter
        low, high = (events.agg(f(at).alias("at")).scalar() for f in (F.min, F.max))
        turn = F.call_function("div", (at - low) * settings.TURNS, high - low + 1)
        self.dealt = written(events.withColumn("turn", turn), f"{name}-dealt")
        self.rows = events.columns
        events.limit(0).write.parquet(self.path)
        self.stream = spark.readStream.schema(COLUMNS["events"]).parquet(self.path)

    def run(self, *starts) -> None:
        """Each turn is a micro-batch of its own of each query, which goes on from its checkpoint."""
        for turn in range(settings.TURNS):
            (self.dealt.filter(F.col("turn") == turn).select(*self.rows)
             .write.mode("append").parquet(self.path))
            for start in starts:
                start().awaitTermination()


def _run_closed(arrivals: _Arrivals, stream: Closable, start) -> None:
    """Read all turns, close the stream, and let its query take the end."""
    arrivals.run(start)
    stream.close()
    start().awaitTermination()


@query
def stream_ingest(spark, folder):
    path = scratch_path(spark, "ingest")
    sink, arrivals = TableSink(f"{path}/store"), _Arrivals(spark, folder, "ingest-files")
    stream = Closable(as_events(arrivals.stream, table(spark, folder, "documents"),
                                table(spark, folder, "pages")), f"{path}/end")
    _run_closed(arrivals, stream, lambda: start_ingest(
        stream.rows, sink, detectors(settings.RULES), f"{path}/checkpoint", settings.DELAY,
        availableNow=True))
    flags = sink.flagged_events(spark)
    tables = {"events_by_did": sink.events_by_did(spark),
              "events_by_minute": sink.events_by_minute(spark)}
    tables |= {rule: flags.filter(F.col("rule_id") == rule)
               for rule in (schemas.SPAM_RULE, schemas.LINK_RULE, schemas.RATE_RULE)}
    return _counts(tables, "target")


@query
def compacted_stream(spark, folder):
    """The author view after a stream and a job that write in turns, with a compaction after each batch. In
    the middle the job sends all follows once more: those that the stream has sent before are read as the job
    has them, the others as the stream has them that sends them after it."""
    path = scratch_path(spark, "compacted-stream")
    sink, arrivals = TableSink(f"{path}/store", AUTHORS_ONLY), _Arrivals(spark, folder, "compacted-files", loose=False)
    none = F.array().cast(schemas.STRINGS)
    events = light_events(arrivals.stream).select(
        "id", "did", "kind", F.lit("").alias("text"), none.alias("langs"), none.alias("links"),
        "created_at", "received_at")
    turns = iter(range(settings.TURNS))

    def job():
        if next(turns) == settings.TURNS // 2:
            sink.write_events(_follows_again(spark, folder).select(*events.columns))
        sink.compact(spark, timedelta(0))
        return _Done()

    arrivals.run(lambda: start_ingest(events, sink, [], f"{path}/checkpoint", availableNow=True), job)
    return plain(sink.events_by_did(spark).select("did", "received_at", "id", "kind", "text"))


def _follows_again(spark, folder) -> DataFrame:
    none = F.array().cast(schemas.STRINGS)
    return (light_events(table(spark, folder, "events")).filter(F.col("kind") == schemas.FOLLOW)
            .withColumns({"text": F.lit("again"), "langs": none, "links": none}))


class _Done:
    def awaitTermination(self):
        pass


def _emitted(spark, folder, name, make) -> DataFrame:
    """What the stream `make(events)` has written by its end."""
    path, arrivals = scratch_path(spark, name), _Arrivals(spark, folder, f"{name}-files")
    events = light_events(arrivals.stream).select("id", "did", "kind", F.lit("").alias("text"),
                                                  "received_at")
    stream = Closable(events, f"{path}/end")
    rows = make(stream.rows)
    _run_closed(arrivals, stream, lambda: start_append(rows, f"{path}/rows", f"{path}/checkpoint",
                                                       availableNow=True))
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


@query
def stream_rate_spike(spark, folder):
    return plain(_emitted(spark, folder, "rate", lambda events: live_rate_hits(
        events, settings.RULES.rate(), settings.DELAY)).drop("text"))


@query
def stream_throughput(spark, folder):
    return plain(_emitted(spark, folder, "throughput",
                          lambda events: live_tumbling(events, settings.DELAY)))


@query
def stream_sliding_rate(spark, folder):
    rates = _emitted(spark, folder, "sliding", lambda events: live_sliding(events, settings.DELAY))
    return plain(rates.withColumn("per_sec", F.round("per_sec", 9)))


@query
def stream_without_replays(spark, folder):
    """Every event arrives twice and is kept once."""
    path, arrivals = scratch_path(spark, "replays"), _Arrivals(spark, folder, "replay-files")
    sent = light_events(arrivals.stream)
    both = sent.unionByName(sent).select(*schemas.BY_DID_KEY)
    kept = without_replays(both, schemas.BY_DID_KEY, settings.DELAY)
    arrivals.run(lambda: start_append(kept, f"{path}/rows", f"{path}/checkpoint", availableNow=True))
    return plain(spark.read.schema(kept.schema).parquet(f"{path}/rows"))
