import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import decontamination as D

DOCS = "doc_id bigint, text string, item_id string, share int"
ITEMS = "item_id bigint, text string, doc_id string"
WORDS = [a + b + c for a in ("ba", "ko", "ri", "te", "mu", "sa") for b in ("lin", "dor", "ve", "nak") for c in ("", "s", "ing", "er", "ly")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence_equals_the_plain_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 80)), rng.integers(0, 6, rng.integers(0, 90))
        assert D.common_subsequence(a, b) == plain_lcs(a.tolist(), b.tolist())


def leak(r, text, changed):
    words = text.split()
    for i in r.sample(range(len(words)), int(changed * len(words))):
        words[i] = r.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def planted():
    """Items of 15 to 200 words in documents at any place, whole and with a fifth of the words replaced."""
    r = random.Random(4)
    items = [(i, prose(r, r.choice([15, 25, 40, 60, 200]))) for i in range(40)]
    docs, truth = [], set()
    for d in range(300):
        text = prose(r, r.choice([5, 60, 300, 1500]))
        if d % 3 == 0:
            i, item = r.choice(items)
            words = text.split()
            at = r.randrange(len(words) + 1)
            text = " ".join(words[:at]) + "\n" + leak(r, item, 0.2 if d % 2 else 0.0).upper() + ", " + " ".join(words[at:])
            truth.add((d, i))
        docs.append((d, text, "x", 1))
    return items, docs, truth


def test_planted_items_are_found_and_nothing_else(spark, planted):
    items, docs, truth = planted
    got = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, "") for i in items], ITEMS)).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(found & truth) >= 0.97 * len(truth)
    assert len({d for d, _ in found} - {d for d, _ in truth}) == 0


def test_retrieval_finds_what_brute_force_finds(spark, planted):
    """Recall of the cosine search against a comparison of every passage with every item."""
    items, docs, truth = planted
    index = D.build_index(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, "") for i in items], ITEMS))
    words, cuts = D.words_of(pa.array([d[1] for d in docs]))
    near = {(t, index.piece_item[p]) for t, _, p, _ in index.candidates(words, cuts)}
    true = set()
    for t, i in truth:
        region = words[cuts[t]:cuts[t + 1]]
        if D.common_subsequence(index.items[i], region) >= D.LEAST_SHARE * len(index.items[i]):
            true.add((t, i))
    assert len(near & true) >= 0.97 * len(true)


def test_axes_span_what_a_full_decomposition_spans(spark):
    rng = np.random.default_rng(2)
    hidden = rng.normal(size=(6, 50))
    rows = []
    for _ in range(300):
        v = np.abs(rng.normal(size=6) @ hidden).astype(np.float32)
        rows.append((np.arange(50, dtype=np.int32).tobytes(), v.tobytes()))
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in rows], "term binary, weight binary")
    axes = D.latent_axes(df, [], 1.0, k=8)
    matrix = np.stack([np.frombuffer(b, np.float32) for _, b in rows])
    _, values, vt = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(axes.T @ axes, np.eye(8), atol=1e-3) and not axes[50:].any()
    kept = np.linalg.norm(matrix @ axes[:50]) ** 2
    assert kept >= 0.99 * (values[:8] ** 2).sum()


def test_empty_null_long_and_repeated(spark):
    r = random.Random(1)
    item = prose(r, 30)
    docs = [(1, None, "", 0), (2, "", "", 0), (3, prose(r, 150_000) + " " + item + " " + prose(r, 20), "", 0), (4, item, "", 0), (4, item, "", 0), (None, item, "", 0)]
    items = [(7, item, ""), (7, item, ""), (8, None, ""), (9, " !? ", ""), (None, item, "")]
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = D.contaminated(frame, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["share"]) for r in got), key=str) == sorted([(3, 7, 1.0), (4, 7, 1.0), (4, 7, 1.0), (None, 7, 1.0)], key=str)
    kept = D.without_contaminated(frame, bench)
    assert kept.columns == frame.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 2]
    assert D.contaminated(frame, bench.limit(0)).count() == 0 and D.without_contaminated(frame, bench.where(F.lit(False))).count() == 6
    assert D.contaminated(frame.limit(0), bench).count() == 0


def test_axes_do_not_depend_on_which_documents_lie_where(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "concat('w', id % 97, ' v', id % 89, ' u', id % 13, ' common words here') as text")
    items = spark.createDataFrame([(1, "w5 v7 u3 common words"), (2, "some other item of eight words in all")], "item_id bigint, text string")
    first, second = (D.build_index(docs, items) for docs in (rows.repartition(2), rows.orderBy("text").coalesce(1)))
    assert np.allclose(first.axes, second.axes, atol=1e-5) and np.allclose(first.idf, second.idf)


def plain_rows(texts, idf):
    """TF-IDF rows of length one of all passages, dense."""
    words, cuts = D.words_of(pa.array(texts, pa.string()))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for s in range(a, b, D.BLOCK):
            row = np.bincount(D.terms(words[s:min(s + D.BLOCK * D.BLOCKS, b)]), minlength=1 << D.TERM_BITS) * idf.astype(float)
            out.append(row / np.linalg.norm(row))
    return np.array(out)


def test_products_are_those_of_all_passages(spark, monkeypatch):
    r = random.Random(8)
    texts = [prose(r, n) for n in (1, 15, 16, 17, 33, 400, 90)] + [None, "", "same " * 70, prose(r, 200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    basis = np.random.default_rng(1).normal(size=(1 << D.TERM_BITS, 5)).astype(np.float32)
    table = D.term_table(docs.repartition(3))
    counts, total, n_passages = D.document_frequencies(table)
    idf = D.inverse_frequencies(counts, total)
    rows = plain_rows(texts, idf)
    assert total == len(texts) and n_passages == len(rows) and counts.max() <= 8
    want = rows.T @ (rows @ basis)
    for at_once in (1, 3, 8, D.BLOCKS_AT_ONCE):
        monkeypatch.setattr(D, "BLOCKS_AT_ONCE", at_once)
        got = D.passage_products(table, idf, basis)
        assert np.allclose(got, want, atol=1e-3)
    assert np.array_equal(got, D.passage_products(table.coalesce(1), idf, basis))  # to the last bit


def test_axes_are_fitted_on_the_passages_of_all_documents(spark):
    """The axes came from the items alone, so they held nothing of what the documents are about."""
    r = random.Random(5)
    docs = [(i, prose(r, r.choice([5, 60, 300])), "", 0) for i in range(120)]
    items = [(i, prose(r, 30), "") for i in range(3)]
    index = D.build_index(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    axes = index.axes[:-1] / index.idf[:-1, None]
    rows = plain_rows([d[1] for d in docs], index.idf[:-1])
    kept, best = np.linalg.norm(rows @ axes) ** 2, (np.linalg.svd(rows[:, rows.any(0)], compute_uv=False)[:D.DIMENSIONS] ** 2).sum()
    assert kept >= 0.95 * best
