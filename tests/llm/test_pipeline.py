"""The pipeline's rows against the plain versions of its stages, one after the other."""

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.corpora import FOLDER, clashing, documents
from tests.llm.test_repeats import slow_hits
from tests.llm.test_secret_scan import all_spans
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_tokens import WORD, crc, direct
from tidewatch.llm.frames import table
from tidewatch.llm.queries import QUERIES


def masked(text):
    out, at = "", 0
    for start, _, _, end in all_spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_run_equals_plain_stages(spark):
    kept = {r.doc_id for r in QUERIES["op4_quality_rules"](spark, FOLDER).collect() if r.kept}
    texts = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").collect()
             if r.doc_id in kept}
    groups = slow_components([(d, slow_fingerprint(t)) for d, t in texts.items()])
    texts = {d: t for d, t in texts.items() if groups[d] == d}
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    found = {d for d, *_ in slow_hits(list(texts.items()), items)}
    texts = {d: masked(t) for d, t in texts.items() if d not in found}
    ids = {d: [*x, 2] for d, x in zip(texts, direct(WORD, list(texts.values())))}
    ends = dict.fromkeys(ids, 0)
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == ends[r.doc_id] and r.doc_tokens == len(own)
        assert r.ids_crc32 == crc(own[r.start:r.start + r.length])
        ends[r.doc_id] += r.length
    assert ends == {d: len(x) for d, x in ids.items()}
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))


def test_filtering_stages_return_the_columns_of_documents(spark):
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.filter("false"), FOLDER).count() == 0


def test_stages_keep_columns_with_clashing_names(spark):
    names = ("_before", "_found", "_spans", "_keep", "_text", "_base", "_runs", "_own", "_fp", "_stats", "_judged")
    docs = clashing(table(spark, FOLDER, "documents").limit(40))
    docs = docs.withColumns({n: F.lit(f"own {n}") for n in names}).drop("n_chars")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, FOLDER)
        assert rows.columns == docs.columns
        assert {tuple(r[n] for n in names) for r in rows.collect()} <= {tuple(f"own {n}" for n in names)}
    assert corpus_pipeline.sequence_packing(spark, docs, FOLDER).count() > 40


def test_masked_documents_have_their_new_length(spark):
    docs = documents(spark, ["a token=abcdefgh b", "clean", None, "[SECRET]"])
    rows = corpus_pipeline.secret_scans(spark, docs, FOLDER).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {
        0: ("a [SECRET] b", 12), 1: ("clean", 5), 2: (None, 0), 3: ("[SECRET]", 8)}
