"""Quality rules, toxicity and language-model scores."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F
from tests.llm.corpora import FOLDER, clashing, documents, prose
from tidewatch.llm import lm_score as L, quality_rules as Q, toxicity as T
from tidewatch.llm.frames import smallest_hashes, table
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("text", ["", " \n\t", "a", "a b c a b c", "x x x x x", "l1\nl1\n \n \nl2\nl1",
                                  "é\x1cü # | <b>", "a b\x0bc\x0cd\re", prose(4, 300, 5)])
def test_counts(text):
    assert Q.counts(text)[:5] == slow_counts(text)


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = QUERIES["op4_quality_rules"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        if r.doc_id % 9 == 0:
            assert tuple(r)[1:6] == slow_counts(texts[r.doc_id] or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_learned_rules_find_planted_thresholds():
    chance = np.random.default_rng(3)
    x = {"a": chance.random(3000), "b": chance.random(3000), "c": chance.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5) | (x["c"] > 0.95)
    rules = Q.learn(x, bad)
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= Q.covers(rule, x, 3000)
    assert (hit == bad).mean() > 0.98 and not (hit & ~bad).mean() > 0.01
    assert Q.learn(x, np.zeros(3000, dtype=bool)) == []


def test_quality_edge_cases(spark):
    docs = clashing(documents(spark, ["", None, prose(1, 80)], [(None, prose(2, 80)), (2, "x")]))
    labels = spark.createDataFrame([(0, None), (99, 0), (None, 1)], "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    assert rules == []
    rows = Q.judged(docs, rules, "_out").collect()
    assert len(rows) == 5 and sum(r["_out"].kept for r in rows) == 2
    assert Q.judged(documents(spark, []), rules, "_out").count() == 0


def test_a_repeated_id_is_learned_from_once(spark):
    docs = documents(spark, [], [(1, prose(i, 80)) for i in range(50)] + [(i, prose(i, 80)) for i in range(2, 30)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 0)] * 20, "doc_id long, quality int")
    seen = []
    learn = Q.learn
    try:
        Q.learn = lambda x, bad: seen.append(bad) or []
        Q.fit(docs, labels)
        Q.fit(docs, labels, sample=4)
    finally:
        Q.learn = learn
    assert len(seen[0]) == 29 and seen[0].sum() == 15 and len(seen[1]) <= 4


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_smallest_hashes_equal_a_full_sort(spark, n):
    df = spark.range(3000)
    assert smallest_hashes(df, "id", n).collect() == df.orderBy(F.xxhash64("id"), "id").limit(n).collect()


def test_block_max_search_is_exact():
    chance = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        terms = np.sort(chance.choice(40, chance.integers(1, 8), replace=False))
        w = chance.random(len(terms))
        vectors.append((terms, w / np.sqrt((w ** 2).sum())))
    index = T.Index(vectors, 40)
    dense = np.zeros((700, 40))
    for i, (terms, w) in enumerate(vectors):
        dense[i, terms] = w
    for i in range(0, 700, 7):
        cosines = dense @ dense[i]
        cosines[i] = 0
        best = np.sort(cosines[cosines > 0])[::-1][:T.NEAREST]
        assert np.allclose([s for s, _ in index.nearest(*vectors[i], T.NEAREST, without=i)], best)


def test_isotonic_rises():
    begins, values = T.isotonic(np.array([.1, .2, .2, .3, .9]), np.array([0., 1, 0, 0, 1]), np.ones(5))
    assert begins == sorted(begins) and values == sorted(values) and 0 < values[0] < values[-1] < 1


def test_toxicity_query_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    rows = QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    count = Counter()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id in labels:
            count[labels[r.doc_id], r.predicted] += 1
    assert count[1, 1] / (count[1, 0] + count[1, 1]) > 0.6
    assert count[0, 1] / (count[0, 0] + count[0, 1]) < 0.02


def test_toxicity_edge_cases(spark):
    from pyspark.sql import functions as F
    docs = clashing(documents(spark, ["", None, "vile vile"] + ["vile stuff"] * 30 + ["fine day"] * 30,
                              [(None, "vile"), (2, "vile vile")]))
    labels = spark.createDataFrame([(i, int(i < 33)) for i in range(3, 63)] + [(None, 1), (500, 1)],
                                   "doc_id long, toxic int")
    rows = T.toxicity(docs, labels, F.lit(True)).collect()
    assert len(rows) == 65
    assert min(r.score for r in rows if r.doc_id is None) > 0.7 > max(
        r.score for r in rows if r.doc_id in (0, 1))
    none = labels.filter("false")
    assert {r.score for r in T.toxicity(docs, none, F.lit(True)).collect()} == {0.0}
    assert T.toxicity(documents(spark, []), labels, F.lit(True)).count() == 0


def test_gradient_of_the_network():
    chance = np.random.default_rng(2)
    ids, at, _ = L.laid_out([chance.integers(0, L.WORDS, 9).astype("i4")])
    weights = {n: w.astype("f8") for n, w in L.fresh_weights().items()}
    learner = L.Learner({n: w.copy() for n, w in weights.items()})
    seen = {}
    learner._step = lambda name, where, g: seen.setdefault(name, []).append((where, g))
    learner.learn(ids, at)

    def loss(w):
        return -L.log_probabilities(w, ids, at).astype(float).mean()

    for name in L.SHAPES:
        gradient = np.zeros(L.SHAPES[name])
        for where, g in seen[name]:
            gradient[where] += g
        spot = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        up, down = ({n: w.copy() for n, w in weights.items()} for _ in range(2))
        up[name][spot] += 1e-2
        down[name][spot] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(gradient[spot], rel=0.05, abs=1e-5)


def test_log_probabilities_sum_to_one():
    ids = np.full(2 * L.REACH + 1, L.PAD, dtype="i4")
    total = 0.0
    for word in range(L.WORDS):
        ids[L.REACH] = word
        total += float(np.exp(L.log_probabilities(L.fresh_weights(), ids, np.array([L.REACH])))[0])
    assert total == pytest.approx(1, abs=1e-3)


def test_scores_prefer_word_order_that_was_learned(spark):
    chance = random.Random(1)
    nexts = {w: chance.sample(range(40), 2) for w in range(40)}
    texts = []
    for _ in range(400):
        w, out = chance.randrange(40), []
        for _ in range(120):
            out.append(f"t{w}")
            w = chance.choice(nexts[w])
        texts.append(" ".join(out))
    shuffled = [" ".join(chance.sample(t.split(), 120)) for t in texts[:20]]
    docs = clashing(documents(spark, texts + shuffled, [(None, ""), (1000, None), (1001, "unseen words")]))
    rows = {r.doc_id: r for r in L.lm_scores(docs.coalesce(2), rounds=12, stride=1).collect()}
    assert len(rows) == 423 and rows[1000].log_prob == 0 and rows[1000].mean_log_prob is None
    assert rows[None].n_words == 0 and rows[1001].n_words == 2
    ordered = np.mean([rows[i].mean_log_prob for i in range(20)])
    mixed = np.mean([rows[400 + i].mean_log_prob for i in range(20)])
    assert ordered > mixed + 0.3 and ordered > -np.log(40)
    assert L.lm_scores(documents(spark, [])).count() == 0


def test_lm_query(spark):
    rows = QUERIES["op2_lm_score"](spark, FOLDER).collect()
    sizes = {r.doc_id: len((r.text or "").encode().split())
             for r in table(spark, FOLDER, "documents").collect()}
    assert {r.doc_id: r.n_words for r in rows} == sizes
    assert all(r.log_prob <= 0 for r in rows)


def slow_spelling(texts):
    """Log-probabilities of words by their bytes, each after the two before it."""
    code = lambda b: b if b < 128 else 2 + b % 30
    line = lambda w: [L.START, L.START, *map(code, w), L.END]
    three, two = Counter(), Counter()
    for text in texts:
        for word in (text or "").encode().split():
            codes = line(word)
            three.update(zip(codes, codes[1:], codes[2:]))
            two.update(zip(codes, codes[1:-1]))
    return lambda w: sum(np.log((three[t] + L.SMOOTH) / (two[t[:2]] + L.SMOOTH * L.CODES))
                         for t in zip(line(w), line(w)[1:], line(w)[2:]))


def slow_scores(texts, weights, vocabulary):
    """Word by word: the whole softmax over classes and over the class's words, then the spelling."""
    number, spell = {w.encode(): i for i, w in enumerate(vocabulary.words, 1)}, slow_spelling(texts)
    w = {n: v.astype(float) for n, v in weights.items()}
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    out = []
    for text in texts:
        words = (text or "").encode().split()
        ids = [L.PAD] * L.REACH + [number.get(x, 0) for x in words] + [L.PAD] * L.REACH
        total = 0.0
        for i, word in enumerate(words, L.REACH):
            h = np.tanh(sum(w["context"][k][ids[i + o]] for k, o in enumerate(L.OFFSETS)))
            kind, place = divmod(ids[i], L.CLASSES)
            total += np.log(softmax(h @ w["classes"] + w["class_bias"])[kind])
            total += np.log(softmax(h @ w["words"][kind] + w["word_bias"][kind])[place])
            total += 0 if ids[i] else spell(word)
        out.append(total)
    return out


def test_scores_equal_brute_force(spark):
    texts = [prose(i, 30, 3000) for i in range(25)] + ["", None, " \n\t ", "é漢字 x\x0by", "one", "w1 " * 300]
    docs = L.texts(documents(spark, texts))
    vocabulary, total = L.vocabulary_of(docs)
    assert total == sum(len((t or "").split()) for t in texts)
    weights = L.trained(L.sharded(docs, vocabulary, total, 200))
    rows = {r.doc_id: r for r in L.lm_scores(documents(spark, texts), shard_words=200).collect()}
    for i, expected in enumerate(slow_scores(texts, weights, vocabulary)):
        assert rows[i].log_prob == pytest.approx(expected, rel=1e-4, abs=1e-6)


def test_scores_do_not_depend_on_partitions(spark):
    docs = documents(spark, [prose(i, 60, 500) for i in range(60)], [(3, prose(3, 60, 500)), (None, "a b c")])
    found = [sorted(map(repr, L.lm_scores(docs.repartition(n), shard_words=500).collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_every_word_is_a_target_once(monkeypatch):
    ids, _, _ = L.laid_out([np.arange(7, dtype="i4"), np.arange(4, dtype="i4")])
    seen = []

    class Watch:
        def learn(self, ids, at):
            seen.extend(at.tolist())

    for turn in range(2):
        L._train(Watch(), ids, turn, 2)
    assert sorted(seen) == np.flatnonzero(ids != L.PAD).tolist()


def test_salad_and_random_strings_rank_below_prose(spark):
    """The texts of the table, each with its words shuffled, with letters for words, and words that occur
    nowhere: none of these is in the table that is learned from more than once."""
    chance = random.Random(4)
    prose_rows = [r.text for r in table(spark, SF, "documents").filter("lang = 'en'").collect()
                  if r.text and 100 < len(r.text.split()) < 1000][:120]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    noise = [" ".join("".join(chance.choice(letters) for _ in range(chance.randrange(2, 12))) for _ in range(100))
             for _ in range(20)]
    unseen = [" ".join(f"zq{chance.randrange(10 ** 6)}xj" for _ in range(100)) for _ in range(20)]
    rows = {r.doc_id: r.mean_log_prob for r in L.lm_scores(documents(
        spark, prose_rows + noise + unseen), rounds=4, stride=2).collect()}
    n = len(prose_rows)
    usual = sorted(rows[i] for i in range(n))
    for strange in (range(n, n + 20), range(n + 20, n + 40)):
        assert max(rows[i] for i in strange) < usual[n // 20]
