from math import lgamma

import numpy as np
import pytest

from cuesheet.operators import topics

SCHEMA = "doc_id string, pos bigint, line string"
WORDS = [["river", "water", "boat", "fish", "swim"], ["engine", "wheel", "road", "driver", "fuel"], ["bread", "butter", "oven", "flour", "sugar"]]


def some_documents(n=20, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n):
        for pos in range(int(rng.integers(1, 40))):
            theme = WORDS[rng.integers(3)]
            words = [theme[rng.integers(5)] for _ in range(int(rng.integers(0, 8)))]
            rows.append((f"d{d}", pos, " ".join(["the", *words])))
    return rows


def plain(lines, hashes, s):
    """One document's model with loops over its lines."""
    bags = {}
    for line in lines:
        words = tuple(sorted(w for w in line.split() if w != "the"))
        bags[words] = bags.get(words, 0) + 1
    terms = sorted({w for b in bags for w in b})
    if not terms:
        return np.full(s.topics, 1 / s.topics)
    weights = topics.first_weights(np.array([hashes[t] for t in terms]), s)

    def expect(counts, beta):
        mixture = np.ones(s.topics)
        share = np.exp(topics.digamma(mixture) - topics.digamma(mixture.sum(keepdims=True)))
        for _ in range(topics.LINE_STEPS):
            fresh = share * (beta.T @ (counts / (beta @ share + 1e-100))) + s.alpha
            share = np.exp(topics.digamma(fresh) - topics.digamma(fresh.sum(keepdims=True)))
            moved = np.abs(fresh - mixture).mean()
            mixture = fresh
            if moved < topics.LINE_TOLERANCE:
                break
        return mixture, share * beta * (counts / (beta @ share + 1e-100))[:, None]

    for last in [False] * s.rounds + [True]:
        beta = np.exp(topics.digamma(weights) - topics.digamma(weights.sum(0)))
        found, total = np.full_like(weights, s.eta), np.zeros(s.topics)
        for bag, copies in bags.items():
            used = sorted(set(bag))
            at = [terms.index(w) for w in used]
            if not used:
                total += copies / s.topics
                continue
            mixture, counts = expect(np.array([float(bag.count(w)) for w in used]), beta[at])
            found[at] += counts * copies
            total += mixture / mixture.sum() * copies
        weights = found
        if last:
            return total / sum(bags.values())


def result(df):
    return {r["doc_id"]: np.array(r["topic_distribution"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return some_documents() + [("empty", 0, ""), ("empty", 1, None), ("stop", 0, "the the")]


@pytest.fixture(scope="module")
def hashes(spark):
    words = [w for theme in WORDS for w in theme]
    return {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w)").collect()}


def by_document(rows):
    found = {}
    for d, _, line in rows:
        found.setdefault(d, []).append(line or "")
    return found


def test_digamma():
    x = np.array([0.01, 0.2, 1.0, 3.7, 8.0, 50.0, 1e6])
    step = x * 1e-5
    slope = [(lgamma(a + h) - lgamma(a - h)) / (2 * h) for a, h in zip(x, step, strict=True)]
    assert np.allclose(topics.digamma(x), slope, rtol=1e-6, atol=1e-6)
    assert abs(topics.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-12


def test_each_document_gets_its_own_model(spark, rows, hashes):
    s = topics.Settings(topics=3)
    got = result(topics.document_topics(spark.createDataFrame(rows, SCHEMA).repartition(3), s))
    want = {d: plain(lines, hashes, s) for d, lines in by_document(rows).items()}
    assert got.keys() == want.keys()
    for d in want:
        assert np.allclose(got[d], want[d], atol=1e-9), d
        assert abs(got[d].sum() - 1) < 1e-9
    assert np.allclose(got["empty"], 1 / 3) and np.allclose(got["stop"], 1 / 3)


def test_large_documents_are_tables_with_the_same_result(spark, rows):
    table, s = spark.createDataFrame(rows, SCHEMA), topics.Settings(topics=3, rounds=3)
    whole = result(topics.document_topics(table, s))
    for bound, salt in ((40, 10**6), (0, 5)):
        apart = result(topics.document_topics(table, s, entries_per_task=bound, rows_per_salt=salt))
        assert apart.keys() == whole.keys()
        assert all(np.allclose(apart[d], whole[d], atol=1e-9) for d in whole)


def test_batches_do_not_matter(spark, rows, monkeypatch):
    s = topics.Settings(topics=4, rounds=2)
    table = spark.createDataFrame(rows, SCHEMA)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(
        *(dict(sorted(result(topics.document_topics(t, s)).items())).values() for t in (table, table.repartition(7))), strict=True))


def test_corpus_topics_equal_one_model_of_all_lines(spark, rows, hashes):
    s = topics.Settings(topics=3)
    got = result(topics.corpus_topics(spark.createDataFrame(rows, SCHEMA), s, rows_per_salt=7))
    everything = plain([line or "" for _, _, line in rows], hashes, s)
    n = {d: len(lines) for d, lines in by_document(rows).items()}
    assert got.keys() == n.keys()
    assert np.allclose(sum(got[d] * n[d] for d in n) / sum(n.values()), everything, atol=1e-9)
    assert all(abs(v.sum() - 1) < 1e-9 for v in got.values())


def test_corpus_topics_tell_themes_apart_as_spark_does(spark):
    from itertools import permutations

    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(f"d{d}", pos, " ".join(WORDS[d % 3][rng.integers(5)] for _ in range(8))) for d in range(60) for pos in range(8)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = result(topics.corpus_topics(table, topics.Settings(topics=3, rounds=15)))
    words = table.select("doc_id", F.split("line", " ").alias("words"))
    counted = CountVectorizer(inputCol="words", outputCol="features").fit(words).transform(words)
    lda = LDA(k=3, seed=1, maxIter=50, optimizer="online", subsamplingRate=1.0).fit(counted).transform(counted)
    means = lda.select("doc_id", vector_to_array("topicDistribution").alias("t")).groupBy("doc_id").agg(*[F.avg(F.col("t")[i]) for i in range(3)])
    theirs = {r[0]: np.array(r[1:]) for r in means.collect()}
    assert min(max(np.abs(got[d][list(p)] - theirs[d]).max() for d in got) for p in permutations(range(3))) < 0.05


def test_no_rows(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert topics.document_topics(table).count() == 0 and topics.corpus_topics(table).count() == 0


def test_rounds_send_the_terms_of_blocks_and_not_their_entries(spark):
    """What joins the topics in every round has a row per block and term; all entries stay in their block."""
    words = [["a", "a", "b"], ["b", "c"], ["a"], [], ["c", "c", "d"]] * 8
    rows = [(i % 2, f"l{i}", w, 1 + i % 3) for i, w in enumerate(words)]
    blocks = topics.blocks_of(spark.createDataFrame(rows, "doc_id bigint, line string, words array<string>, copies bigint").repartition(3), 40).collect()
    assert len(blocks) == 2 and sum(len(b["terms"]) for b in blocks) <= 2 * 8 < sum(len(b["slots"]) for b in blocks)
    found = {}
    for b in blocks:
        at = 0
        for doc, line, copies, size in zip(b["docs"], b["lines"], b["copies"], b["sizes"], strict=True):
            entries = {b["terms"][s]: n for s, n in zip(b["slots"][at:at + size], b["counts"][at:at + size], strict=True)}
            assert {t["doc_id"] for t in entries} == {doc} and len(entries) == size
            found[line] = (doc, sorted(t["term"] for t, n in entries.items() for _ in range(n)), copies)
            at += size
    assert found == {line: (doc, w, copies) for doc, line, w, copies in rows if w}


def test_lines_are_solved_alike_however_many_at_a_time(monkeypatch):
    """All lines of a batch were solved in one go, over arrays far beyond a processor's cache."""
    s, rng = topics.Settings(), np.random.default_rng(3)
    line_of = np.sort(rng.integers(0, 60, 400))
    line_of = line_of[line_of != 7]  # a line without terms
    counts, weights = rng.integers(1, 4, len(line_of)).astype(float), rng.random((len(line_of), s.topics)) + 0.01
    whole = topics.line_mixtures(counts, line_of, weights, 60, s)
    for at_once in (1, 10, 100):
        monkeypatch.setattr(topics, "ENTRIES_IN_CACHE", at_once)
        assert all(np.array_equal(a, b) for a, b in zip(whole, topics.line_mixtures(counts, line_of, weights, 60, s), strict=True))
    for line in (0, 31, 59):
        mine = line_of == line
        mixture = np.ones(s.topics)
        for _ in range(topics.LINE_STEPS):
            share = np.exp(topics.digamma(mixture) - topics.digamma(mixture.sum(keepdims=True)))
            part = share * weights[mine]
            part *= (counts[mine] / part.sum(1))[:, None]
            before, mixture = mixture, part.sum(0) + s.alpha
            if np.abs(mixture - before).mean() < topics.LINE_TOLERANCE:
                break
        assert np.allclose(whole[0][line], mixture, rtol=1e-9)
    assert np.ptp(whole[0][7]) == 0 and not len(topics.line_mixtures(counts[:0], line_of[:0], weights[:0], 3, s)[1])


def test_exponential_of_digamma():
    x = np.geomspace(0.01, 1e12, 2000)
    assert np.allclose(topics.exp_digamma(x), np.exp(topics.digamma(x)), rtol=1e-11, atol=0)
