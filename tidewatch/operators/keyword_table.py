"""Keyword lists of any length, with the hits of `SpamDetector`.

One expression for each keyword does not plan beyond some thousands. Here the keywords are a table, and an
index says where to look: each keyword is listed under one trigram of its own, the one that the fewest texts hold. A
text meets the keywords listed under its trigrams by an equi-join, and each meeting is verified by the very
pattern that `SpamDetector` uses. A keyword with a trigram that no text holds is dropped, since no text can hold it.

Trigrams are of ASCII characters after case folding, so a match of the pattern always shares them. Keywords
without one (shorter, or of other letters) stay expressions in a literal array; there may be `MOST_PLAIN`.

Texts that are sent many times are looked at once, by digest. Trigrams are cut by one pass of a pattern
with a look-ahead, which is linear in the text.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schemas
from tidewatch.functions.text import check_patterns, java_pattern
from tidewatch.operators.detector import EVENT, EVENT_AND_HIT, hit_struct
from tidewatch.operators.keyword import is_post_with_text
from tidewatch.plans.durable import written

#: Keywords without a trigram, at most.
MOST_PLAIN = 1000
_TRIGRAM = "(?s)(?=([\\x00-\\x7F]{3}))"
#: Places of regexes come after those of keywords.
_AFTER = 1 << 40


def folded(text: Column) -> Column:
    """Lower case, and the two letters beyond ASCII that fold to an ASCII letter as that letter."""
    # Two searches of bytes: `translate` looks up each character of each text.
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("k")), F.lit("\u017f"), F.lit("s")))


def trigrams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(_TRIGRAM), F.lit(1)))


def pattern_of(keyword: Column) -> Column:
    """`functions.text.literal_pattern` of a column."""
    low, up = F.lower, F.upper

    def one(letter: Column) -> Column:
        folds = F.when(low(letter) == "k", "\u212a").when(low(letter) == "s", "\u017f").otherwise("")
        return (F.when(letter.rlike("^[A-Za-z]$"), F.concat(F.lit("["), low(letter), up(letter), folds, F.lit("]")))
                .when(letter.rlike("^[\\s0-9]$"), letter)
                .when(letter.rlike("^[\\x00-\\x7F]$"), F.concat(F.lit("\\"), letter))
                .otherwise(F.concat(F.lit("(?iu:"), letter, F.lit(")"))))

    return F.array_join(F.transform(F.regexp_extract_all(keyword, F.lit("(?s)."), F.lit(0)), one), "")


class KeywordTableDetector:
    """Posts whose text holds a keyword of `keywords(place, keyword)` or matches one of `regexes`. Matches
    are listed by the keywords' places, then in the order of the regexes. Empty keywords are skipped."""

    def __init__(self, keywords: DataFrame, severity: str = "low", regexes: tuple[str, ...] = ()):
        self.keywords = (keywords.filter(F.coalesce("keyword", F.lit("")) != "")
                         .select(F.col("place").cast("long").alias("place"), "keyword"))
        self.severity = severity
        self.regexes = [java_pattern(r) for r in regexes if r]
        check_patterns(keywords.sparkSession, self.regexes)

    def hits(self, events: DataFrame) -> DataFrame:
        digest = F.sha2("text", 256).alias("digest")
        posts = events.filter(is_post_with_text()).select(*EVENT, digest)
        texts = written(posts.groupBy("digest").agg(F.any_value("text").alias("text")), "distinct-texts")
        found = (self._of_index(texts).unionByName(self._of_literals(texts))
                 .groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("place", "match"))).alias("found"))
                 .select("digest", F.array_join("found.match", "|").alias("matches")))
        hit = hit_struct(schemas.SPAM_RULE, self.severity, F.lit(schemas.SPAM_REASON),
                         {"matches": F.col("matches")})
        return (posts.join(written(found, "keyword-texts"), "digest").select(*EVENT, hit.alias("_hit"))
                .select(*EVENT, "_hit.*").select(*EVENT_AND_HIT))

    def index(self, grams: DataFrame) -> DataFrame:
        """`gram, place, keyword, pattern`: each keyword under its rarest trigram among `grams(gram)`, where every
        one of its trigrams is found."""
        each = written(self.keywords.select("place", "keyword", F.explode(trigrams(F.col("keyword"))).alias("gram")),
                       "keyword-trigrams")
        known = (grams.join(written(each.select("gram").distinct(), "known-trigrams"), "gram")
                 .groupBy("gram").agg(F.count(F.lit(1)).alias("texts")))
        rated = each.join(written(known, "trigram-counts"), "gram", "left")
        chosen = (rated.groupBy("place", "keyword")
                  .agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rarest"))
                  .filter("rarest.texts > 0"))
        return written(chosen.select("rarest.gram", "place", "keyword",
                                     pattern_of(F.col("keyword")).alias("pattern")), "keyword-index")

    def _of_index(self, texts: DataFrame) -> DataFrame:
        grams = written(texts.select("digest", F.explode(trigrams(F.col("text"))).alias("gram")), "text-trigrams")
        met = grams.join(self.index(grams.select("gram")), "gram").drop("gram")
        # A text is folded once, not for each keyword that it meets.
        both = texts.withColumn("_folded", folded(F.col("text"))).join(met, "digest")
        held = F.col("_folded").contains(folded(F.col("keyword"))) | ~F.col("keyword").rlike("^[\\x00-\\x7F]*$")
        # The plain search goes first: a pattern out of a column is compiled row by row.
        return (both.filter(held).filter(F.expr("rlike(text, pattern)"))
                .select("digest", "place", F.expr("regexp_extract(text, pattern, 0)").alias("match")))

    def _of_literals(self, texts: DataFrame) -> DataFrame:
        rows = (self.keywords.filter(F.size(trigrams(F.col("keyword"))) == 0)
                .select("place", pattern_of(F.col("keyword")).alias("pattern")).limit(MOST_PLAIN + 1).collect())
        if len(rows) > MOST_PLAIN:
            raise ValueError(f"more than {MOST_PLAIN} keywords without three ASCII characters in a row")
        plain = [(r["place"], r["pattern"]) for r in rows]
        plain += [(_AFTER + i, pattern) for i, pattern in enumerate(self.regexes)]
        matches = [F.when(F.col("text").rlike(p), F.struct(
            F.lit(place).cast("long").alias("place"), F.regexp_extract("text", p, 0).alias("match")))
            for place, p in plain]
        none = F.array().cast("array<struct<place:bigint,match:string>>")
        found = F.array_compact(F.array(*matches)) if matches else none
        return texts.select("digest", F.explode(found).alias("m")).select("digest", "m.place", "m.match")
