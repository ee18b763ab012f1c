"""Decontamination, substring dedup and WARC against brute force and SQL."""

import gzip
import hashlib
import random
import re

import pytest

from tests.compare import database, difference
from tests.llm.corpora import FOLDER, clashing, documents, prose
from tidewatch.llm import decontaminate as D, substrings as S, warc as W
from tidewatch.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name, folder):
    assert difference(QUERIES[name](spark, folder), database(folder), ORACLE[name]) is None


def slow_hits(docs, items, least=0.8):
    def shingles(text, width):
        words = re.findall(r"\w+", (text or "").lower())
        return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}

    out = set()
    for item, text in items:
        width = min(5, len(re.findall(r"\w+", (text or "").lower())))
        wanted = shingles(text, width) if width else set()
        for doc, body in docs:
            shared = len(wanted & shingles(body, width)) if width else 0
            if wanted and shared >= least * len(wanted) - 1e-9:
                out.add((doc, item, len(wanted), shared))
    return out


def contaminated_case():
    chance = random.Random(9)
    items = [(i, prose(100 + i, 5 + 6 * i)) for i in range(12)]
    items += [(20, "Two Words"), (21, ""), (22, None), (23, items[3][1]), (24, "five words are just enough")]
    docs = []
    for i in range(60):
        words = prose(i, 150).split()
        item = items[i % 12][1].split()
        for _ in range(chance.randrange(0, 4)):
            item[chance.randrange(len(item))] = "other"
        at = chance.randrange(150)
        docs.append((i, " ".join(words[:at] + item + words[at:]).upper()))
    docs += [(100, "say two, words!"), (101, ""), (102, None), (103, "Five words are just enough."),
             (104, (prose(3, 5000) + " " + items[7][1] + " ") * 3)]
    return docs, items


@pytest.mark.parametrize("local", [D.LOCAL_SHINGLES, 0])
def test_containment_equals_brute_force(spark, local):
    docs, items = contaminated_case()
    frame = clashing(documents(spark, [], docs))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS key")
    found = D.contaminated(frame, bench, local=local).collect()
    assert {tuple(r)[:4] for r in found} == slow_hits(docs, items) and len(found) > 40
    assert {r.doc_id for r in D.clean(frame, bench).collect()} == (
        {d for d, _ in docs} - {r.doc_id for r in found})
    assert D.contaminated(documents(spark, []), bench, local=local).count() == 0
    assert D.contaminated(frame, bench.filter("false"), local=local).count() == 0


def test_sketch_is_never_missed():
    for n in range(1, 400):
        assert n - D.lacking(n, 0.8) >= 0.8 * n - 1e-9
        assert D.lacking(n, 0.8) <= D.lacking(D.size_class(n), 0.8)


def test_contaminated_rows_with_repeated_ids(spark):
    item = prose(1, 30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = documents(spark, [item], [(0, item), (None, item), (3, "clean")])
    assert sorted((r.doc_id is None, r.doc_id) for r in D.contaminated(df, bench).collect()) == [
        (False, 0), (True, None)]
    assert [r.doc_id for r in D.clean(df, bench).collect()] == [3]


def slow_removal(docs, length=13):
    first, out = {}, {}
    key = lambda d: float("inf") if d is None else d
    words = [(key(d), (t or "").encode().split()) for d, t in docs]
    for doc, w in words:
        for i in range(len(w) - length + 1):
            window = tuple(w[i:i + length])
            first[window] = min(doc, first.get(window, doc))
    for n, (doc, w) in enumerate(words):
        gone = {i + j for i in range(len(w) - length + 1) if first[tuple(w[i:i + length])] < doc
                for j in range(length)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[n] = (docs[n][0], len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=repr)


def repeating_case():
    chance = random.Random(4)
    shared = [prose(900 + i, n) for i, n in enumerate((12, 13, 14, 27, 60, 200))]
    docs = []
    for i in range(80):
        parts = [prose(i, chance.randrange(0, 30))]
        for _ in range(chance.randrange(0, 4)):
            words = chance.choice(shared).split()
            cut = chance.randrange(0, len(words) // 2)
            parts += [" ".join(words[cut:]), prose(i + 500, chance.randrange(0, 9))]
        docs.append((i * 3, " ".join(parts)))
    docs += [(7, docs[0][1]), (500, docs[0][1]), (500, docs[0][1]), (None, docs[5][1]), (None, docs[5][1]),
             (600, ""), (601, None), (602, "same " * 40), (-5, docs[9][1]), (700, "é " * 30 + docs[3][1])]
    return docs


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_removal_equals_brute_force(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(S.Repeats.__init__, "__defaults__", ("doc_id", "text", block_bytes))
    docs = repeating_case()
    df = clashing(documents(spark, [], docs)).repartition(5)
    found = sorted(map(tuple, S.repeat_digests(df).collect()), key=repr)
    assert found == slow_removal(docs)
    kept = {(r.doc_id, hashlib.sha256(r.kept.encode()).hexdigest()) for r in S.without_repeats(df).collect()}
    assert kept == {(r[0], r[3]) for r in found}


@pytest.mark.parametrize("start", [1, 4, 13])
def test_levels_do_not_change_the_result(spark, start):
    docs = repeating_case()[:40]
    found = S.repeat_digests(documents(spark, [], docs), start=start).collect()
    assert sorted(map(tuple, found), key=repr) == slow_removal(docs)
    assert S.levels(7, 13) == [7, 13] and S.levels(3, 20) == [3, 6, 12, 20]


def test_doubling_until_none_survives(spark):
    long, short = prose(1, 130), prose(2, 20)
    df = documents(spark, [long + " " + prose(8, 40), prose(9, 30) + " " + long, short, short + " x",
                           prose(5, 50), ""])
    found = {r.doc_id: r.longest for r in S.longest_repeats(df).collect()}
    assert found == {0: 104, 1: 104, 2: 13, 3: 13}
    assert S.repeat_digests(documents(spark, [])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark, tmp_path):
    big, other = "é<p>" * 400, "WARC/1.0\r\n\r\n" * 200
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "u", "small"), (5, "u", "small"),
            (6, "", None), (7, "x\r\ny", other), (8, "u", ""), (None, "u", other), (3, "again", big)]
    path = str(tmp_path / "warc")
    W.write_warc(pages(spark, rows).selectExpr("*", "'x' AS digest", "1 AS target"), path)
    found = sorted(map(tuple, W.inventory(spark, path).collect()), key=repr)
    expected = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        target = max(same) if len(raw) >= 1000 and same and max(same) != page else None
        expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(),
                         "revisit" if target else "response", target))
    assert found == sorted(expected, key=repr)
    payloads = W.read_warc(spark, path).filter("record_type = 'response'").collect()
    assert sorted(r.payload.decode() for r in payloads) == sorted(
        h or "" for (p, _, h), e in zip(rows, expected) if e[3] == "response")
    W.write_warc(pages(spark, []), str(tmp_path / "none"))
    assert W.inventory(spark, str(tmp_path / "none")).count() == 0


def test_predicates_are_pushed_and_contents_skipped(spark, tmp_path):
    W.write_warc(pages(spark, [(i, f"http://h{i % 3}/{i}", "b" * (990 + i)) for i in range(40)]),
                 str(tmp_path / "w"))
    df = W.read_warc(spark, str(tmp_path / "w"), payload=False)
    some = df.filter("target_uri LIKE 'http://h1/%' AND content_length > 1060 AND record_type = 'response'")
    http = len("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    assert some.count() == len([i for i in range(40) if i % 3 == 1 and 990 + i + http > 1060]) > 0
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert {r.payload for r in df.collect()} == {None}
    reader = W.WarcReader({"path": str(tmp_path / "w")})
    from pyspark.sql.datasource import EqualTo
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload",), b"")])) == [
        EqualTo(("payload",), b"")]

    class Watched:
        def __init__(self, raw):
            self.raw, self.got = raw, 0

        def readline(self):
            return self.raw.readline()

        def seek(self, *a):
            self.raw.seek(*a)

        def read(self, n):
            self.got += n
            return self.raw.read(n)

    for f in (tmp_path / "w").glob("part-*"):
        stream = Watched(f.open("rb"))
        assert list(reader.records(stream)) == [] and stream.got == 0


def test_compressed_archives(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    rows = W.read_warc(spark, str(tmp_path)).collect()
    assert [(r.record_type, r.payload) for r in rows] == [("resource", b"abc")] * 2


def warc_record(kind, content, length=None, extra=b""):
    length = len(content) if length is None else length
    return (b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nContent-Length: " + str(length).encode() + b"\r\n" + extra
            + b"\r\n" + content + b"\r\n\r\n")


@pytest.mark.parametrize("payload", [True, False])
@pytest.mark.parametrize("broken, fault", [
    (warc_record(b"response", b"short", 5000), "ends before 5000"),
    (b"lost bytes\r\nmore of them\r\n" + warc_record(b"resource", b"abc"), "no record begins"),
    (warc_record(b"response", b"x", "12x"), "length is '12x'")])
def test_damaged_records(spark, tmp_path, payload, broken, fault):
    good = warc_record(b"resource", b"fine")
    (tmp_path / "a.warc").write_bytes(good + broken)
    (tmp_path / "b.warc").write_bytes(good)
    rows = W.read_warc(spark, str(tmp_path), payload, damaged="keep").collect()
    assert [fault in r.fault for r in rows if r.fault][0]
    assert sum(r.record_type == "resource" and not r.fault for r in rows) == (3 if b"lost" in broken else 2)
    with pytest.raises(Exception, match=fault.split()[0]):
        W.read_warc(spark, str(tmp_path), payload).collect()
    kept = W.read_warc(spark, str(tmp_path), payload, damaged="keep").filter("record_type = 'resource'")
    assert all(r.record_type == "resource" for r in kept.collect())


def test_headers_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(warc_record(b"resource", b"abc", extra=b"X-Name: caf\xe9\r\n"))
    (row,) = W.read_warc(spark, str(tmp_path)).collect()
    assert row.payload == b"abc" and row.headers["x-name"] == "caf\ufffd" and row.fault is None
