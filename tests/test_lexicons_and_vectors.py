import random

import numpy as np
import pytest

from cuesheet.operators import clustering, lexicon, lines, ordering, semantic, topics


def make_lines(spark, rows):
    return lines.lines(spark.createDataFrame(rows, "doc_id string, pos bigint, text string"))


@pytest.fixture
def emotions(spark):
    rows = [("kill", "anger", 1), ("kill", "fear", 1), ("friend", "joy", 1), ("friend", "anger", 0)]
    return spark.createDataFrame(rows, "word string, emotion string, value int")


def test_emotions_count_distinct_words(spark, emotions, by_id):
    table = make_lines(spark, [("a", 0, "Kill kill friend"), ("b", 0, "nothing here")])
    got = by_id(lexicon.emotion_distribution(table, emotions))
    assert got["a"] == pytest.approx({"anger": 1 / 3, "fear": 1 / 3, "joy": 1 / 3})
    assert got["b"] == {"anger": 0.0, "fear": 0.0, "joy": 0.0}
    assert by_id(lexicon.lexicon_coverage(table, emotions)) == {"a": 2, "b": 0}


def test_lexicon_pivot_fills_zero(emotions, by_id):
    wide = lexicon.pivot_lexicon(emotions)
    assert wide.columns == ["word", "anger", "fear", "joy"]
    assert by_id(wide) == {"kill": (1, 1, 0), "friend": (0, 0, 1)}


def test_sentiment_is_mean_of_line_means(spark):
    polarity = spark.createDataFrame([("good", 1.0), ("bad", -0.5)], "word string, polarity double")
    table = make_lines(spark, [("a", 0, "good good bad"), ("a", 1, "plain"), ("a", 2, "Bad!")])
    row = lexicon.sentiment(table, polarity).first()
    scores = [0.5, 0.0, -0.5]
    assert (row.avg_sentiment, row.sentiment_std) == (pytest.approx(np.mean(scores)), pytest.approx(np.std(scores)))


def test_grammar_leaves_out_absent_classes(spark, by_id):
    tags = spark.createDataFrame([("dog", "NOUN", "NN"), ("ran", "VERB", "VBD"), ("will", "AUX", "MD"), ("it", "PRON", "PRP")],
                                 "word string, pos string, tag string")
    got = by_id(lexicon.grammar(make_lines(spark, [("a", 0, "The dog ran. It will"), ("b", 0, "so")]), tags))
    pos, pronouns, tense = got["a"]
    assert pos == pytest.approx({"noun": 1 / 6, "verb": 1 / 6}) and pronouns == pytest.approx(1 / 6)
    assert tense == pytest.approx({"past": 0.5, "future": 0.5})
    assert got["b"] == ({}, 0.0, {"past": 0.0, "present": 0.0, "future": 0.0})


def vectors(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, pos bigint, vector array<double>")


def test_small_vector_features(spark, by_id):
    table = vectors(spark, [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("a", 3, [1.0, 0.0]), ("b", 1, [3.0, 4.0]), ("b", 2, None)])
    assert by_id(semantic.pairwise_similarity(table)) == pytest.approx({"a": 1 / 3, "b": 0.0})
    assert by_id(semantic.coherence(table)) == pytest.approx({"a": 0.0, "b": 0.0})
    assert by_id(semantic.semantic_variance(table)) == pytest.approx({"a": 2 / 9, "b": 0.0})


def test_vector_features_equal_all_pairs(spark, by_id):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 6))
    m[7] = 0.0  # a zero vector counts as a line
    table = vectors(spark, [("a", i * 3000, [float(x) for x in row]) for i, row in enumerate(m)]).repartition(4)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    sim = u @ u.T
    assert by_id(semantic.pairwise_similarity(table))["a"] == pytest.approx(sim[np.triu_indices(40, 1)].mean())
    assert by_id(semantic.coherence(table))["a"] == pytest.approx(np.diag(sim, 1).mean())
    assert by_id(semantic.semantic_variance(table))["a"] == pytest.approx(m.var(axis=0).mean())


def test_coherence_keeps_no_copy_of_the_vectors(spark, by_id, monkeypatch):
    monkeypatch.setattr(ordering, "materialise", None)  # would be called
    table = vectors(spark, [("a", p, [1.0, float(p > 65_535)]) for p in (0, 65_535, 65_536, 200_000)])
    assert by_id(semantic.coherence(table))["a"] == pytest.approx((1 + 0.5 ** 0.5 + 1) / 3)


@pytest.mark.parametrize("rows_per_salt", [1_000_000, 6])
def test_grouped_kmeans_equals_plain_lloyd(spark, rows_per_salt):
    rng = random.Random(2)
    points = {d: [[rng.choice([0.0, 1.0, 5.0]), rng.random()] for _ in range(n)] for d, n in (("a", 40), ("b", 9), ("c", 2))}
    points["a"][3] = points["a"][0]
    table = vectors(spark, [(d, i, v) for d, vs in points.items() for i, v in enumerate(vs)])
    got = {(r.doc_id, r.pos): r.cluster for r in clustering.grouped_kmeans(table, 3, 4, False, rows_per_salt).collect()}
    for d, vs in points.items():
        m = np.array(vs)
        seeds = []
        for v in vs:
            if v not in seeds:
                seeds.append(v)
        centers = {i + 1: np.array(s) for i, s in enumerate(seeds[:3])}
        for step in range(5):
            labels = [min(centers, key=lambda c: (round(float(((v - centers[c]) ** 2).sum()), 9), c)) for v in m]
            centers = {c: m[[x == c for x in labels]].mean(axis=0) for c in set(labels)}
        assert [got[d, i] for i in range(len(vs))] == labels
    features = {r.doc_id: r for r in clustering.cluster_features(clustering.grouped_kmeans(table, 3), 3).collect()}
    assert (features["c"].num_clusters, features["c"].dominant_cluster_ratio) == (2, 1.0)


def test_corpus_kmeans_is_repeatable(spark):
    table = vectors(spark, [("a", i, [float(i % 5), float(i // 5)]) for i in range(50)])
    one, two = (sorted(map(tuple, clustering.corpus_kmeans(table).collect())) for _ in range(2))
    assert one == two and len(one) == 50 and {r[2] for r in one} <= set(range(5))


def test_topic_mixtures_sum_to_one(spark):
    words = ["ship sea sail", "sea storm ship", "cake sugar flour", "flour oven cake", "the of"]
    table = make_lines(spark, [(f"d{i % 3}", i, w) for i, w in enumerate(words * 4)])
    got = topics.topic_distribution(table, 5, max_iter=3).collect()
    assert len(got) == 3
    for r in got:
        assert len(r.topic_distribution) == 5 and sum(r.topic_distribution) == pytest.approx(1.0)
