"""Licence notices against a plain search."""

import re

from tidewatch.llm import license_scan
from tidewatch.llm.license_scan import ANCHORS, BASE, NAMED, SLACK, TEMPLATES, Template, words_of
from tidewatch.llm.queries import QUERIES
from tests.llm.corpora import FOLDER, clashing, documents, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def notices(found, index, slack=SLACK):
    """Every place is tried: anchors that stand there, then the phrases."""
    out = []
    for template, places in index.templates:
        size = len(template.words)
        for b in range(-size, len(found)):
            agree = sum(any(0 <= b + p < len(found) and found[b + p] == w for p in at)
                        for w, at in places.items())
            least = len(places) - 1 if len(places) > 2 else len(places)
            window = found[max(b - slack, 0):max(b + size + slack, 0)]
            line = f" {' '.join(window)} "
            if agree >= least and all(f" {p} " in line for p in template.phrases):
                out.append((template.label, b, len(set(template.words) & set(window)) / len(set(template.words))))
    return out


def brute(rows, templates=TEMPLATES):
    counts = {}
    for _, text in rows:
        for w in set(words(text)):
            counts[w] = counts.get(w, 0) + 1
    vocabulary = {w for t in templates for w in t.words}
    index = license_scan.built(templates, len(rows), {w: c for w, c in counts.items() if w in vocabulary})
    out = []
    for doc_id, text in rows:
        found = words(text)
        base = [(i, label) for phrase, label in BASE.items() for i in range(len(found))
                if found[i:i + len(phrase.split())] == phrase.split()]
        marks = notices(found, index)
        out.append((doc_id, len(found), len(base), min(base)[0] if base else None,
                    max(base)[0] if base else None, ",".join(sorted({x for _, x in base})),
                    ",".join(sorted({x for _, x in base} | {x for x, *_ in marks})),
                    max([s for *_, s in marks] + [NAMED if base else 0.0])))
    return sorted(out, key=repr)


def check(spark, rows, templates=TEMPLATES, change=lambda df: df):
    df = change(documents(spark, [], rows))
    found = license_scan.report(license_scan.scan_licenses(df, templates))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, templates)


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = QUERIES["op12_license_scan"](spark, FOLDER)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                             "labels", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_plan_is_native(spark):
    plan = QUERIES["op12_license_scan"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_every_template_is_found_in_its_own_words(spark):
    rows = [(i, f"{prose(i, 20)} -- {t.text}. {prose(i + 50, 9)}") for i, t in enumerate(TEMPLATES)]
    check(spark, rows)
    found = license_scan.report(license_scan.scan_licenses(documents(spark, [], rows))).collect()
    for row in found:
        assert TEMPLATES[row["doc_id"]].label in row["labels"].split(",") and row["score"] == 1.0


def test_near_misses(spark):
    rows = [(1, "MIT-License"), (2, "mit licence"), (3, "the MIT\n License, the mit license"),
            (4, "general public licenses"), (5, "GNU General\tPublic License"),
            (6, "licensed under the gnu lesser general public license, version 3"),
            (7, "license under cc by 4.0"), (8, "licensed under cc 4.0 by"), (9, "cc by-nc 4.0"),
            (10, "Released unter the MIT License"), (11, "Released, as said, under the MIT License"),
            (12, "released under the mit license " * 40), (13, "É MIT LICENSE É")]
    check(spark, rows)


def test_an_anchor_that_differs_is_forgiven_a_key_phrase_is_not(spark):
    notice = Template("own", "quartz velvet copper may be used under the heron terms", ("heron terms",))
    rows = [(1, notice.text), (2, notice.text.replace("velvet", "linen")),
            (3, notice.text.replace("heron", "egret")), (4, notice.text.replace("copper", "a copper")),
            (5, "copper velvet quartz heron terms")]
    check(spark, rows, (notice,))
    found = license_scan.scan_licenses(documents(spark, [], rows), (notice,)).collect()
    assert sorted(r["doc_id"] for r in found if r["notices"])[:2] == [1, 2]


def test_edge_rows(spark):
    rows = [(None, "mit license"), (1, None), (1, ""), (2, "mit license"), (2, "mit license"), (3, "license"),
            (4, " - ;"), (5, f"{'license ' * 20_000} released under the mit license")]
    check(spark, rows)
    check(spark, rows, change=clashing)
    check(spark, [(1, "x")], ())


def test_empty_table(spark):
    df = documents(spark, [])
    assert license_scan.report(license_scan.scan_licenses(df)).count() == 0


def test_rarest_words_are_anchors():
    counts = {w: 5 for w in words_of(TEMPLATES[0].text)} | {"mit": 1, "released": 2}
    ((_, places),) = license_scan.built(TEMPLATES[:1], 10, counts).templates
    assert list(places) == ["mit", "released", "license"] and len(places) == ANCHORS
