import math
import random
from collections import Counter

import pytest

from cuesheet.operators import clustering, lines, skew, tfidf


def weights_of(texts, stop=()):
    """Independent all-lines computation in plain Python."""
    words = [[w for w in t.lower().split() if len(w) > 1 and w not in stop] for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    out = []
    for ws in words:
        raw = {w: c * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, c in Counter(ws).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append({w: v / norm for w, v in raw.items()})
    return out


def make_lines(spark, docs):
    rows = [(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)]
    return lines.lines(spark.createDataFrame(rows, "doc_id string, pos bigint, text string").repartition(3))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    common = [f"c{i}x" for i in range(6)]
    rare = [f"rare{i}" for i in range(40)]
    hot = []
    for _ in range(120):  # short lines of few words: copies, near copies, one dominant word, permutations
        ws = rng.choices(common, k=rng.randint(1, 5)) + rng.choices(rare, k=rng.randint(0, 2))
        hot.append(" ".join(ws))
    hot += ["na " * 30 + "hey"] * 3 + ["na " * 31 + "you", "na na", "na"] + ["a", "b", "?"] + ["same words here"] * 10
    long = [" ".join(rng.choices(common + rare, k=60)) for _ in range(30)]
    long += [long[0] + " extra", long[0] + " c0x", long[1].replace("rare1", "rare2")]
    base = " ".join(rng.choices(common, k=50))
    template = [f"{base} only{i}" for i in range(25)] + [f"{base} pair{i} more{i} more{i}" for i in range(10)]
    template += [base, base, *(f"c0x only{i}b" for i in range(9)), "c0x c1x"]
    return {"template": template, "hot": hot, "long": long, "one": ["single line"], "empty": ["a", "b"], "two": ["x y", "same same"]}


@pytest.mark.parametrize("threshold", [0.95, 0.7, 0.3])
def test_repetition_equals_all_pairs(spark, corpus, by_id, threshold):
    got = by_id(tfidf.repetition_rate(make_lines(spark, corpus), threshold))
    for doc, texts in corpus.items():
        vs, n = weights_of(texts), len(texts)
        hits = sum(sum(w * vs[j].get(t, 0.0) for t, w in vs[i].items()) > threshold for i in range(n) for j in range(i + 1, n))
        assert got[doc] == pytest.approx(hits / (n * (n - 1) / 2) if n > 1 else 0.0), doc


def test_weights_with_and_without_salting(spark, corpus):
    table = make_lines(spark, corpus)
    want = {(d, i, t): w for d, texts in corpus.items() for i, v in enumerate(weights_of(texts)) for t, w in v.items()}
    got = {(r.doc_id, r.pos, r.term): r.weight for r in tfidf.line_tfidf(table).collect()}
    assert got == pytest.approx(want)
    each = tfidf.line_term_counts(table).selectExpr("*", "1L as copies")
    salted = {(r.doc_id, r.pos, r.term): r.w for r in tfidf.weighted_terms(each, rows_per_salt=5).collect()}
    assert salted == pytest.approx(want)


def test_keywords_sum_weights_and_break_ties_by_name(spark, corpus, by_id):
    got = by_id(tfidf.keyword_lists(make_lines(spark, corpus), 10, ["c0x"]))
    for doc, texts in corpus.items():
        total = Counter()
        for v in weights_of(texts, {"c0x"} ):
            for t, w in v.items():
                total[t] += w
        want = [t for t, _ in sorted(total.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]]
        assert got[doc] == want, doc
    assert got["empty"] == []


def test_a_filled_in_template_is_one_group(spark, corpus):
    profiles = tfidf.line_profiles(make_lines(spark, {"t": corpus["template"]}))
    groups = tfidf.line_groups(tfidf.weighted_terms(profiles)).collect()
    assert sorted(g.copies for g in groups) == [1, 2, 9, 10, 25]


def test_threshold_must_be_inside_the_unit_interval(spark):
    with pytest.raises(ValueError):
        tfidf.near_duplicate_pairs(spark.createDataFrame([], "doc_id string, pos bigint, copies bigint, vec array<struct<df:bigint,term:string,w:double>>, lost double"), 1.0)


def lloyd(vectors, k, rounds, distance):
    distinct = []
    for v in vectors:
        if v not in distinct:
            distinct.append(v)
    centers = dict(enumerate(distinct[:k]))
    labels = [min(centers, key=lambda c: (round(distance(v, centers[c]), 9), c)) for v in vectors]
    for _ in range(rounds):
        centers = {}
        for c in set(labels):
            members = [v for v, x in zip(vectors, labels) if x == c]
            centers[c] = {t: sum(m.get(t, 0.0) for m in members) / len(members) for m_ in members for t in m_}
        labels = [min(centers, key=lambda c: (round(distance(v, centers[c]), 9), c)) for v in vectors]
    return labels


def sparse_distance(a, b):
    return sum((a.get(t, 0.0) - b.get(t, 0.0)) ** 2 for t in {*a, *b}) / 2


@pytest.mark.parametrize(("rows_per_salt", "entries_per_task"), [(1_000_000, 10**6), (1_000_000, 0), (7, 0), (7, 200)])
def test_line_clusters_equal_plain_lloyd(spark, corpus, rows_per_salt, entries_per_task):
    """Whole in a task, in rounds over a table, and some documents each way."""
    docs = {"hot": corpus["hot"][:60] + ["?", "q"], "long": corpus["long"], "short": ["aa bb", "cc"]}
    table = make_lines(spark, docs)
    labels = clustering.line_clusters(table, 4, rounds=3, until_stable=False, rows_per_salt=rows_per_salt, entries_per_task=entries_per_task)
    sizes = {}
    for r in labels.groupBy("doc_id", "cluster").sum("copies").collect():
        sizes.setdefault(r[0], []).append(r[2])
    assert "short" not in sizes
    for doc in ("hot", "long"):
        want = Counter(lloyd(weights_of(docs[doc]), 4, 3, sparse_distance))
        assert sorted(sizes[doc]) == sorted(want.values()), doc
    got = {r.doc_id: r for r in clustering.line_cluster_features(table, 4, 3).collect()}
    assert (got["short"].num_clusters, got["short"].dominant_cluster_ratio) == (2, 1.0)


def test_every_hot_key_is_salted(spark):
    counts = spark.range(1000).selectExpr("id as k", "(id + 1) * 100 as n")
    hot = skew.hot_keys(counts, ["k"], "n", rows_per_salt=10)
    assert hot.count() == 1000 and hot.agg({"_salts": "max"}).first()[0] == 10_000
    assert skew.hot_keys(counts, ["k"], "n", rows_per_salt=500_000) is None


def test_proportional_lines_are_one_group(spark):
    table = make_lines(spark, {"d": [" ".join(["ha"] * (i + 1)) for i in range(400)] + ["ho ho hi", "hi ho ho ho ho hi", "ho hi"]})
    groups = tfidf.line_groups(tfidf.weighted_lines(tfidf.line_profiles(table))).collect()
    assert sorted((r.pos, r.copies) for r in groups) == [(0, 400), (400, 2), (402, 1)]
    rate = tfidf.repetition_rate(table).first().repetition_rate
    assert rate == pytest.approx((400 * 399 / 2 + 1) / (403 * 402 / 2))


def test_frequencies_with_common_factors(spark):
    from pyspark.sql import functions as F
    rows = [([6, 9, 12],), ([4, 8],), ([5],), ([7, 1],), ([35, 21],), ([2**31, 2**30],)]
    got = spark.createDataFrame(rows, "f array<bigint>").select(tfidf._common_factor(F.col("f"))).collect()
    assert [r[0] for r in got] == [3, 4, 5, 1, 7, 2**30]


def test_hot_keys_are_split_without_a_change(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    table = make_lines(spark, {"d": [" ".join(words[j] for j in range(7) if (i >> j) & 1 or j == i % 7) for i in range(128)], "e": ["alpha beta"]})
    groups = tfidf.line_groups(tfidf.weighted_lines(tfidf.line_profiles(table)))
    for threshold in (0.6, 0.8, 0.95):
        once, split = ({(r.doc_id, r.a, r.b) for r in tfidf.near_duplicate_pairs(groups, threshold, n).collect()} for n in (10**6, 5))
        vectors = {r.pos: {t["term"]: t["w"] for t in r.vec} for r in groups.where("doc_id = 'd'").collect()}
        every = {("d", a, b) for a in vectors for b in vectors if a < b and sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items()) > threshold}
        assert once == split == every
