"""The scan of texts for the terms of all items against plain counting and SQL."""

import math
import re
from collections import Counter

import pytest

from tidewatch.llm import term_scan
from tidewatch.llm.queries import ORACLE, QUERIES
from tests.compare import database, difference
from tests.llm.corpora import FOLDER, clashing, documents, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_all = sum(n > 0 for *_, n in counted), sum(n for *_, n in counted)
    holds = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in wanted.items():
        found = []
        for doc_id, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // n_all if n_all else 0
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holds[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, doc_id) in
                enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, **options):
    df = documents(spark, [], docs)
    found = term_scan.ranked(df, spark.createDataFrame(items, ITEMS), **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, options.get("top", 10))


def test_query_equals_sql(spark):
    assert difference(QUERIES["op13_term_scan"](spark, FOLDER), database(FOLDER),
                      ORACLE["op13_term_scan"]) is None


def test_equals_brute_force(spark):
    docs = [(i, prose(i, 5 + 13 * i % 90, 60)) for i in range(60)]
    docs += [(100 + i, docs[3][1]) for i in range(20)]  # copies tie
    items = [(i, prose(1000 + i, 12, 80)) for i in range(8)] + [(20, "w1 w1 w1 w2")]
    check(spark, docs, items)
    check(spark, docs, items, top=3)


def test_blocks_of_items_give_the_same(spark):
    docs = [(i, prose(i, 40, 50)) for i in range(30)]
    items = [(i, prose(500 + i, 8, 60)) for i in range(12)]
    check(spark, docs, items, block_bytes=300)


def test_whole_terms_and_letters_beyond_ascii(spark):
    docs = [(1, "in Inn inning-in"), (2, "É é ÉÉ É"), (3, "a_b a b\x00c  z"), (4, "ALPHA1 alpha 1"),
            (5, "naïve NAÏVE naÏve"), (6, "in\nin\tin,in")]
    items = [(1, "in"), (2, "é"), (3, "É"), (4, "a b c"), (5, "alpha1"), (6, "naÏve NAÏVE"), (7, " z z")]
    check(spark, docs, items)


def test_edge_rows(spark):
    docs = [(None, "w1 w2"), (1, "w1 w2"), (1, "w1 w2"), (2, None), (3, ""), (4, "- , ."), (5, "w3 " * 20_000)]
    items = [(1, "w1"), (None, "w2 w3"), (None, "w3"), (3, None), (4, ""), (5, "nowhere")]
    check(spark, docs, items)
    df = clashing(documents(spark, [], docs))
    wide = spark.createDataFrame(items, ITEMS).selectExpr("*", "'x' AS term", "1 AS item", "2 AS times")
    assert sorted(map(tuple, term_scan.ranked(df, wide).collect()), key=repr) == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "w1")]), ([(1, "w1")], []), ([(1, "")], [(1, "w1")])])
def test_empty_tables(spark, docs, items):
    found = term_scan.ranked(documents(spark, [], docs), spark.createDataFrame(items, ITEMS))
    assert found.collect() == []


def test_best_keeps_ties_by_id_over_many_slices():
    import numpy as np
    best, seen = term_scan.Best(3, 4), []
    random = np.random.default_rng(2)
    for turn in range(50):
        scores = random.integers(0, 6, size=(7, 3))
        ids = random.permutation(1000)[:7] + 1000 * (turn % 3)
        seen += [(i, -int(s), int(d)) for row, d in zip(scores, ids) for i, s in enumerate(row) if s]
        best.add(scores, ids, np.zeros(7, dtype=np.int64))
        if turn % 5 == 0:
            best.settle()
    item, score, ids, _ = best.settle()
    expected = [x for i in range(3) for x in sorted(s for s in seen if s[0] == i)[:4]]
    assert list(zip(item.tolist(), (-score).tolist(), ids.tolist())) == expected
