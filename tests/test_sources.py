"""Events out of tables with gaps, unknown types and several files."""

import os
from datetime import datetime

import pytest

from tests.compare import TABLES, database, difference
from tidewatch import schemas
from tidewatch.catalog import settings
from tidewatch.catalog.oracle import ORACLE
from tidewatch.catalog.queries import QUERIES
from tidewatch.sources.tables import COLUMNS, as_events, light_events

FOLDER = "/root/testdata/sf0.001"


def rows_of(spark, table, *rows):
    return spark.createDataFrame(list(rows), COLUMNS[table].replace("timestamp_ntz", "timestamp"))


def test_no_event_is_lost(spark):
    at = datetime(2024, 1, 1)
    events = rows_of(spark, "events", (0, at, 1, "click", 1.0), (-1, at, 1, "view", 1.0),
                     (5, at, 2, "poll", 1.0), (6, at, 2, None, 1.0), (7, at, 3, "signup", 1.0))
    documents = rows_of(spark, "documents", (10, "far", "en"), (1, "near", None), (4, None, "de"))
    pages = rows_of(spark, "pages", (1, "http://a/"), (9, None))
    got = {r.id: r for r in as_events(events, documents, pages).collect()}
    assert len(got) == 5
    assert {i: r.kind for i, r in got.items()} == {
        "evt-0": schemas.POST, "evt--1": schemas.POST, "evt-5": "poll", "evt-6": "",
        "evt-7": schemas.FOLLOW}
    assert got["evt-0"].text == "" and got["evt-0"].links == [] and got["evt-0"].langs == []
    assert len(got["evt--1"].links) == 2 and got["evt--1"].text == ""
    empty = as_events(events, documents.filter("false"), pages.filter("false"))
    assert empty.count() == 5 == light_events(events).count()


def test_no_shuffle_after_the_texts_are_joined(spark):
    tables = [spark.range(1000).selectExpr(*(f"cast(id as {c.split()[1]}) as {c.split()[0]}" if "timestamp" not in c
                                             else "timestamp_seconds(id) as ts" for c in COLUMNS[t].split(", ")))
              for t in ("events", "documents", "pages")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = as_events(*tables)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 2 and "doc_id" in joins[0] and "page_id" in joins[1]    # the outermost comes first


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """The smallest tables, with events as a folder of parts in the order of time."""
    folder = tmp_path_factory.mktemp("split")
    for name in TABLES:
        if name != "events":
            os.symlink(f"{FOLDER}/{name}.parquet", folder / f"{name}.parquet")
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    part = events.orderBy("ts", "event_id").collect()
    size = -(-len(part) // 4)
    for k in range(0, len(part), size):
        (spark.createDataFrame(part[k:k + size], events.schema).coalesce(1)
         .write.mode("append").parquet(str(folder / "events.parquet")))
    return str(folder)


@pytest.mark.parametrize("turns", [1, 6])
@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("stream_")])
def test_streams_over_a_folder_of_files(spark, split, monkeypatch, name, turns):
    """In one micro-batch or several, the rows are the same."""
    monkeypatch.setattr(settings, "TURNS", turns)
    assert difference(QUERIES[name](spark, split), database(FOLDER), ORACLE[name]) is None
