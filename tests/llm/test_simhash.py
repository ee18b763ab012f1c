"""Fingerprints and components against brute force."""

import random

import pytest
import xxhash

from tests.llm.corpora import FOLDER, clashing, documents, prose
from tidewatch.llm import simhash as S
from tidewatch.llm.components import components
from tidewatch.llm.frames import table
from tidewatch.llm.queries import QUERIES


def slow_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace(
        "\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
        if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints):
    """`(id, print)` pairs to the smallest id of each component, by all pairs."""
    roots = list(range(len(prints)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                roots[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: least[root(i)] for i, (doc, _) in enumerate(prints)}


@pytest.mark.parametrize("text", ["", None, "one", "One Two", "a b c\x1cd É é", prose(1, 900),
                                  "a a a a a a", " \t\n", "x" * 5000])
def test_fingerprint(text):
    assert S.fingerprint(text or "") % (1 << 64) == slow_fingerprint(text)


def test_query_equals_brute_force(spark):
    rows = QUERIES["op10_simhash"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    assert len(rows) == len(texts)
    assert all(int(r.fingerprint, 16) == slow_fingerprint(texts[r.doc_id]) for r in rows)
    expected = slow_components([(r.doc_id, int(r.fingerprint, 16)) for r in rows])
    assert {r.doc_id: r.component_id for r in rows} == expected


def test_links_lose_no_chain(spark):
    chance, prints = random.Random(5), []
    for _ in range(60):
        value = chance.getrandbits(64)
        for _ in range(chance.randrange(1, 9)):
            prints.append(value)
            for _ in range(chance.choice([0, 1, 2, 2, 3])):
                value ^= 1 << chance.randrange(64)
    prints += [0, 1, (1 << 64) - 1, (1 << 63) - 1, 1 << 63, 3 << 62]
    signed = [p - (1 << 64) * (p >> 63) for p in dict.fromkeys(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    reached = {r.node: r.root for r in components(S.links(df)).collect()}
    expected = slow_components([(i, p % (1 << 64)) for i, p in enumerate(signed)])
    groups = {}
    for i, p in enumerate(signed):
        groups.setdefault(expected[i], set()).add(reached.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({g.pop() for g in groups.values()}) == len(set(expected.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)],
                                  "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert {roots[i] for i in range(301)} == {0} and roots[501] == 500 and len(roots) == 303


def test_edge_cases(spark):
    copy = prose(3, 60)
    df = clashing(documents(spark, ["", None, copy, copy, "solo text here"],
                            [(None, copy), (9, "solo text here"), (9, "solo text here")]))
    rows = S.simhash_components(df).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows)
    assert found == [(False, 0, 0), (False, 1, 0), (False, 2, 2), (False, 3, 2), (False, 4, 4),
                     (False, 9, 4), (False, 9, 4), (True, 0, 2)]
    assert sorted(r.doc_id for r in S.keep_first(df).collect()) == [0, 2, 4]
    assert S.simhash_components(documents(spark, [])).count() == 0


def test_a_repeated_id_keeps_one_row(spark):
    df = documents(spark, ["a b c d"], [(0, "a b c d")])
    assert S.keep_first(df).count() == 1


def test_rows_that_share_an_id_and_not_the_text_are_documents_of_their_own(spark):
    one, other = prose(1, 60), prose(2, 60)
    df = clashing(documents(spark, [one, other], [(0, other), (0, one), (5, one), (None, other), (None, prose(3, 60)),
                                                  (7, prose(4, 60)), (7, prose(4, 60))]))
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    # Two groups of the first texts, of which `other` has the ids 1, 0 and null; a null id alone; and 7.
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text[:9]) for r in kept.collect()) == sorted(
        [(False, 0, one[:9]), (False, 0, other[:9]), (True, 0, prose(3, 60)[:9]), (False, 7, prose(4, 60)[:9])])
