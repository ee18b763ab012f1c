"""The registered queries of this folder: `name -> (spark, folder) -> DataFrame`."""

from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, license_scan, lm_score, packing, quality_rules, secret_scan, simhash, substrings, term_scan, token_files, toxicity, warc, whiten
from tidewatch.llm.frames import table
from tidewatch.plans.durable import scratch_path

QUERIES = {}
ORACLE = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_secret_scan(spark, folder):
    found = secret_scan.scan_secrets(table(spark, folder, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in secret_scan.BASE],
                        F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("all")).alias("spans"))


@query
def op2_lm_score(spark, folder):
    return lm_score.lm_scores(table(spark, folder, "documents"))


@query
def op3_token_files(spark, folder):
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), path, "byte_bpe_50k.json", end=0)
    return token_files.digests(spark, path)


@query
def op4_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, folder, "labels"))
    found = quality_rules.judged(docs, rules, "_found")
    stats = [F.col(f"_found.stats.{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *stats, "_found.base_failed", "_found.kept",
                        F.col("_found.rule").alias("rule"))


@query
def op5_warc(spark, folder):
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), path)
    return warc.inventory(spark, path)


ORACLE["op5_warc"] = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html,
                     octet_length(encode(coalesce(html, ''))) AS n FROM pages),
large AS (SELECT html, max(page_id) AS largest FROM page WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(page.html) AS payload_digest,
       CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM page LEFT JOIN large USING (html)"""


@query
def op6_toxicity(spark, folder):
    def held_out():
        return F.crc32(F.col("doc_id").cast("string")) % 3 == 1

    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"),
                              learn_from=~held_out())
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "evidence")


@query
def op7_decontaminate(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"),
                                      table(spark, folder, "benchmark"))


ORACLE["op7_decontaminate"] = """
WITH item AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w
              FROM benchmark),
item_shingle AS (
  SELECT DISTINCT item_id,
         unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM item),
size AS (SELECT item_id, count(*) AS n_shingles FROM item_shingle GROUP BY item_id),
doc AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w
        FROM documents),
doc_shingle AS (
  SELECT DISTINCT doc_id,
         unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM doc),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared
        FROM doc_shingle JOIN item_shingle USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_shingles AS INTEGER) AS n_shingles,
       CAST(n_shared AS INTEGER) AS n_shared, n_shared / n_shingles AS containment
FROM hit JOIN size USING (item_id) WHERE n_shared >= ceil(round(n_shingles * 0.8, 9))"""


@query
def op8_substring_dedup(spark, folder):
    return substrings.repeat_digests(table(spark, folder, "documents"), length=13, start=7)


ORACLE["op8_substring_dedup"] = """
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc)),
first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT doc_id, list(DISTINCT p) AS g
         FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p
               FROM win JOIN first USING (s) WHERE least < doc_id) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string([w[p] FOR p IN range(1, len(w) + 1)
              IF NOT list_contains(coalesce(g, []), p)], ' '), '')) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id)"""


@query
def op9_packing(spark, folder):
    path = scratch_path(spark, "sequences")
    packing.write_sequences(table(spark, folder, "documents"), path, "word_bpe_49k.json", end=2,
                            longest=4096)
    return packing.packed(spark, path)


@query
def op10_simhash(spark, folder):
    linked = simhash.simhash_components(table(spark, folder, "documents"), shingle=3, max_bits=2)
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         "component_id")


@query
def op11_whitening(spark, folder):
    return whiten.whitened(table(spark, folder, "embeddings"), components=4, scale=256)


@query
def op12_license_scan(spark, folder):
    return license_scan.report(license_scan.scan_licenses(table(spark, folder, "documents")))


@query
def op13_term_scan(spark, folder):
    return term_scan.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op13_term_scan"] = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs,
                 CAST(sum(len(terms)) AS BIGINT) AS n_all FROM doc),
item AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
tf AS (SELECT doc_id, 25 + (75 * len(terms) * n_docs) // n_all AS m, term, count(*) AS tf
       FROM (SELECT doc_id, terms, unnest(terms) AS term FROM doc), total
       WHERE term IN (SELECT term FROM item) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
scored AS (SELECT item_id, doc_id,
                  CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM tf JOIN weight USING (term) JOIN item USING (term) GROUP BY ALL),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id
                                              ORDER BY score DESC, doc_id) AS rank, doc_id, score
           FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10"""
