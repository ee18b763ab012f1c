"""The corpus pipeline: stages over `documents`, each written and read again as the next one's input.

Edge cases: null and empty texts fail the base quality rules and go in the first stage, so none reaches the
others; taken alone, the other stages keep them, as one SimHash group. Rows that share an id but not the text are
documents of their own; of rows that share both, one stays. Other columns are carried along, whatever their names.
An empty table gives no sequences.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from tidewatch.llm.frames import fresh, table
from tidewatch.plans.durable import scratch_path, written


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go. The list is learned from the
    labels of the documents that came in."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "_judged")
    judged = quality_rules.judged(docs, rules, name)
    return judged.filter(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays, that with the smallest id."""
    return simhash.keep_first(docs, shingle=3, max_bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in its text are masked, and `n_chars`, if there is such a column,
    follows where there were any."""
    found = fresh(docs, "_found")
    masked = secret_scan.redacted(docs, found_col=found)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        follows = F.when(F.col(found), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        columns[docs.columns.index("n_chars")] = follows.alias("n_chars")
    return masked.select(*columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of power-of-two length."""
    path = scratch_path(spark, "pipeline-sequences")
    packing.write_sequences(docs, path, "word_bpe_49k.json", end=2, longest=4096)
    return packing.packed(spark, path)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sequence_packing", sequence_packing),
]

#: Learned rules, fingerprints and token ids are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
