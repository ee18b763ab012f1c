"""Keywords as a table against one expression for each."""

import random

import pytest
from pyspark.sql import functions as F

from tests.rows import event, events
from tidewatch.functions.text import literal_pattern
from tidewatch.operators import keyword_table
from tidewatch.operators.keyword import SpamDetector
from tidewatch.operators.keyword_table import KeywordTableDetector, pattern_of
from tidewatch.rules import SpamRule
from tidewatch.schemas import FOLLOW

ODD = ["[SPAM]", "free", "FREE money", "massK", "ſpecial ", "straße", "İstanbul", "Σσς", "ab", "x", "a.b",
       "\\E", "tab\there", "new\nline", "\U0001f600 ok", "café noir", "  two", "$9.99", "'quoted'", "zé", "é"]


def keywords(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "place long, keyword string")


def rows_of(found):
    return sorted((r.id, r.did, r.text, r.severity, r.reason, r.evidence["matches"]) for r in found.collect())


def check(spark, words, texts, regexes=()):
    data = events(spark, *[event(f"e{i}", text=t) for i, t in enumerate(texts)],
                  event("f", kind=FOLLOW, text=texts[0]), event("copy", "did:b", text=texts[0]))
    rule = SpamRule(tuple(words), tuple(regexes), "high")
    got = rows_of(KeywordTableDetector(keywords(spark, words), "high", tuple(regexes)).hits(data))
    assert got == rows_of(SpamDetector(rule).hits(data))
    return got


def test_patterns_equal_those_of_the_expressions(spark):
    found = keywords(spark, ODD).select("keyword", pattern_of("keyword").alias("p")).collect()
    plain = lambda p: p.replace("\\u212A", "\u212a").replace("\\u017F", "\u017f")
    assert {r.keyword: r.p for r in found} == {w: plain(literal_pattern(w)) for w in ODD}


def test_equals_one_expression_each(spark):
    draw = random.Random(5)
    pieces = [*ODD, "plain", "words", " ", "\n", "K", "K", "s", "ſ", "STRASSE", "ẞ", "i̇stanbul", "σ"]
    texts = ["FREE free [spam] Free MONEY"]
    for _ in range(150):
        part = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 12)))
        texts.append(part.swapcase() if draw.random() < 0.4 else part)
    assert len(check(spark, ODD, texts, [r"(?i)m[a-z]ney", r"\d\.\d"])) > 100


def test_order_repeats_and_empty_keywords(spark):
    got = check(spark, ["zebra", "", "apple", "Zebra", "nowhere"], ["Apple zEBRA apple", "none", "zebra"])
    assert [m for *_, m in got] == ["zEBRA|Apple|zEBRA", "zEBRA|Apple|zEBRA", "zebra|zebra"]


def test_fifty_thousand_keywords(spark):
    """Equal to a search for each, by a plan of constant size."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(4, 9)))
    words = sorted({f"{word()} {word()}" for _ in range(50_000)})
    texts = [" ".join(word() for _ in range(20)) for _ in range(300)]
    texts += [f"{word()} {draw.choice(words).upper()} {word()}" for _ in range(60)]
    data = events(spark, *[event(f"e{i}", text=t) for i, t in enumerate(texts)])
    found = KeywordTableDetector(keywords(spark, words)).hits(data)
    expected = {f"e{i}": [w for w in words if w in t.lower()] for i, t in enumerate(texts)}
    assert {r.id: r.evidence["matches"].lower().split("|") for r in found.collect()} == {
        i: w for i, w in expected.items() if w}
    assert len(found._jdf.queryExecution().analyzed().toString()) < 20_000


def test_too_many_keywords_without_a_trigram(spark, monkeypatch):
    monkeypatch.setattr(keyword_table, "MOST_PLAIN", 3)
    check(spark, ["ab", "cd", "é", "abc"], ["xabcdx É"])
    with pytest.raises(ValueError):
        KeywordTableDetector(keywords(spark, ["a", "b", "c", "d"])).hits(events(spark, event(text="a")))


def test_empty(spark):
    none = keywords(spark, ["free"])
    assert KeywordTableDetector(none).hits(events(spark, event()).limit(0)).count() == 0
    assert KeywordTableDetector(none.limit(0)).hits(events(spark, event(text="free"))).count() == 0
    with pytest.raises(ValueError):
        KeywordTableDetector(none, regexes=("(",))


def test_texts_are_folded_without_a_lookup_of_each_character(spark):
    rows = spark.createDataFrame([("\u212aelvin MA\u017fS",)], "t string").select(
        keyword_table.folded(F.col("t")).alias("f"))
    assert rows.first().f == "kelvin mass"
    assert "translate" not in rows._jdf.queryExecution().toString()
