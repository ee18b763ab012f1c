"""Small frames for the tests of the corpus operators."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"


def documents(spark, texts, extra=()):
    """Documents numbered from 0; `extra` are (id, text) rows."""
    rows = [(i, t) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)


def clashing(df):
    """The same rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F
    names = ("n_words", "block", "bucket", "tokens", "start", "_spans", "_stats", "fp", "score", "part",
             "component_id", "digest", "target", "row", "hash", "label", "length")
    return df.withColumns({n: F.lit(f"x{n}") for n in names})


def prose(seed: int, n: int, size: int = 400) -> str:
    chance = random.Random(seed)
    return " ".join(f"w{chance.randrange(size)}" for _ in range(n))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
