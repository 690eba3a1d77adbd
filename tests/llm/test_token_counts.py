import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuesheet.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = token_counts.PieceCounter(open(MODEL, "rb").read())
SCHEMA = "doc_id bigint, text string, digest string, n_tokens string"
TEXTS = [None, "", " ", "  ", "a", " a ", "two  spaces", "line\nbreak\ttab", "<s> </s> <unk>", "ﬁ é é नमस्ते 漢字 🙂", "▁ mark▁", "word " * 20_000]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab<s>\n\té漢🙂 "), st.characters(blacklist_categories=("Cs",)))), max_size=6))
def test_words_add_up_to_what_the_library_returns(texts):
    assert COUNTER(texts) == [len(LIBRARY.encode(t)) for t in texts]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def test_counts_equal_the_library(spark, tmp_path):
    rows = token_counts.token_counts(table(spark, TEXTS), MODEL, str(tmp_path / "c"), limit=30).collect()
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        n = len(LIBRARY.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 30)
    assert len(rows) == len(TEXTS)


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path):
    cache = str(tmp_path / "c")
    token_counts.token_counts(table(spark, ["a b", "a b", "c", None, ""]), MODEL, cache).collect()
    assert spark.read.parquet(cache).count() == 3
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("bigint")).write.partitionBy("tokenizer").parquet(cache + "2")
    got = token_counts.token_counts(table(spark, ["a b", "new one"]), MODEL, cache + "2").collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {0: 77, 1: len(LIBRARY.encode("new one"))}  # the first from the cache
    assert spark.read.parquet(cache + "2").count() == 4


def test_another_tokenizer_does_not_meet_old_counts(spark, tmp_path):
    cache = str(tmp_path / "c")
    token_counts.token_counts(table(spark, ["a b"]), MODEL, cache).collect()
    assert token_counts.read_cache(spark, cache, "other version").count() == 0


def test_no_rows_and_repeated_rows(spark, tmp_path):
    assert token_counts.token_counts(table(spark, []), MODEL, str(tmp_path / "a")).count() == 0
    twice = table(spark, ["x y"]).union(table(spark, ["x y"]))
    assert [r["n_tokens"] for r in token_counts.token_counts(twice, MODEL, str(tmp_path / "b")).collect()] == [len(LIBRARY.encode("x y"))] * 2


def test_every_document_of_the_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = token_counts.token_counts(docs, MODEL, str(tmp_path / "c")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {k: len(LIBRARY.encode(t)) for k, t in texts.items()}
