"""Documents gathered in a task and documents kept as tables give the same, and a gathered one is shuffled once."""

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import clustering, collections, tfidf, topics
from test_term_weights import corpus, make_lines, weights_of  # noqa: F401

MIXED = 300  # of the fixture's documents some fit into so many entries


def rounded(rows):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=str)


def test_bound_parts_the_documents(spark, corpus):  # noqa: F811
    fitting, large = collections.split_by_size(make_lines(spark, corpus), MIXED)
    assert fitting.select("doc_id").distinct().count() > 1 and large.select("doc_id").distinct().count() > 1
    assert collections.split_by_size(make_lines(spark, corpus))[1] is None
    assert collections.split_by_size(make_lines(spark, corpus), products_per_task=20)[1] is not None


@pytest.mark.parametrize("bound", [MIXED, 0])
def test_whole_documents_equal_tables(spark, corpus, bound):  # noqa: F811
    table = make_lines(spark, corpus)
    for run in (lambda n: tfidf.line_tfidf(table, entries_per_task=n).select("doc_id", "pos", "term", "weight"),
                lambda n: tfidf.keyword_lists(table, 5, ["c0x"], entries_per_task=n),
                lambda n: tfidf.repetition_rate(table, 0.7, entries_per_task=n),
                lambda n: clustering.line_clusters(table, 4, 3, False, entries_per_task=n).groupBy("doc_id", "cluster").agg(F.sum("copies"))):
        assert rounded(run(collections.ENTRIES_PER_TASK).collect()) == rounded(run(bound).collect())


def test_salted_table_weights(spark, corpus):  # noqa: F811
    each = tfidf.line_term_counts(make_lines(spark, corpus)).selectExpr("*", "1L as copies")
    want = {(d, i, t): w for d, texts in corpus.items() for i, v in enumerate(weights_of(texts)) for t, w in v.items()}
    assert {(r.doc_id, r.pos, r.term): r.w for r in tfidf.weighted_terms(each).collect()} == pytest.approx(want)


def test_repetition_in_blocks_and_beyond_the_bound_of_products(spark, corpus, by_id, monkeypatch):  # noqa: F811
    table = make_lines(spark, corpus)
    want = by_id(tfidf.repetition_rate(table, 0.6))
    kept = tfidf.collection(table).kept()
    for got in (tfidf.repetition_rate(table, 0.6, kept, products_per_task=1000), tfidf.repetition_rate(table, 0.6, kept)):
        assert by_id(got) == pytest.approx(want)
    batch = kept.whole.toArrow().combine_chunks().to_batches()[0]
    found = []
    for at_once in (tfidf.PRODUCTS_AT_ONCE, 500, 1):
        monkeypatch.setattr(tfidf, "PRODUCTS_AT_ONCE", at_once)
        found.append(tfidf._alike_in_batch(collections._flat(batch, None), 0.6).tolist())
    assert found[0] == found[1] == found[2] and sum(found[0]) > 0


@pytest.mark.parametrize("run", [tfidf.tfidf_keywords, tfidf.repetition_rate, tfidf.line_tfidf, clustering.line_clusters, topics.document_topics])
def test_lines_of_fitting_documents_are_shuffled_once(spark, corpus, run):  # noqa: F811
    plan = run(make_lines(spark, corpus).repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_kept_lines_are_held_by_columns(spark):
    """The same terms in many lines are stored once per file, not once per line as in a checkpoint."""
    table = spark.range(3000).selectExpr("id % 30 AS doc_id", "id AS pos", "concat('some words that come again and again ', id % 7) AS line")
    kept = tfidf.collection(table, merge=False).kept().whole
    files = kept.inputFiles()
    assert files and all(f.endswith(".parquet") for f in files)
    assert sum(r["length"] for r in spark.read.format("binaryFile").load(files).select("length").collect()) < 100_000  # 3,000 lines of eight terms
    assert kept.selectExpr("sum(size(lines))").first()[0] == 3000
