import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cuesheet.llm import byte_bpe

VOCABULARY = byte_bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
ODD = [None, "", " ", "   ", "a", "a  b", "don't we'll", "line\r\n\r\nbreak \t tab", "<|endoftext|> <x>", "ﬁ é é नमस्ते 漢字漢字 🙂🙂👩‍👩‍👧", "\x1c\x1d\x85  x",
       "=" * 700, "aaab" * 300, "՘࢏\U00011de0", "ab" * 1000, "你好" * 400, "x" * 50_000, "1234567890" * 90, "word " * 3_000]


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, codes array<int>")


def check(rows, texts):
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        want = LIBRARY.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids"] == want, texts[r["doc_id"]]


def test_ids_equal_the_library(spark):
    rng = random.Random(5)
    alphabets = ["abcdefghij ", "ab", "eé漢🙂́ \n", "the and ing ", "0123 .,;=-'s", "".join(chr(rng.randrange(32, 0x3000)) for _ in range(300))]
    texts = ODD + ["".join(rng.choice(a) for _ in range(rng.randrange(1, 120))) for a in alphabets for _ in range(40)]
    check(byte_bpe.encode(table(spark, texts), VOCABULARY).collect(), texts)


@pytest.mark.parametrize("window", [8, 20])
def test_windows_join_to_the_whole_word(spark, window):
    rng = random.Random(window)
    texts = ODD + ["".join(rng.choice(a) for _ in range(rng.randrange(window, 300))) for a in ("abcdefghijklmnopqrstuvwxyz", "ab", "aaaab", "eé漢") for _ in range(40)]
    check(byte_bpe.encode(table(spark, texts), VOCABULARY, window).collect(), texts)


def test_plain_merges_equal_the_library():
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 60)))
        assert byte_bpe.merge(word.encode(), VOCABULARY.ranks) == LIBRARY.encode_ordinary(word)


def test_a_task_that_forgets_its_words_goes_on(spark):
    texts = [f"w{i} x{i} same words" for i in range(1_500)]
    check(byte_bpe.encode(table(spark, texts).coalesce(1), VOCABULARY, remembered=100).collect(), texts)


def test_a_vocabulary_with_a_piece_that_merges_cannot_reach(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"xyz": 256, b" q": 257}
    vocabulary = byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    assert vocabulary.pairs == {257: (32, 113)}
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["xyz xyz axyz q", "xyz", "xyz" * 200]
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(table(spark, texts), vocabulary, window=30).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_ranks_that_are_no_order_of_merges_and_missing_bytes_are_refused():
    with pytest.raises(ValueError, match="higher rank"):
        byte_bpe.Vocabulary({bytes([i]): i for i in range(256)} | {b"xyz": 256, b"xy": 257}, public_tokenizers.PATTERN).pairs
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.Vocabulary({b"a": 0}, public_tokenizers.PATTERN).pairs


def test_decoding_gives_the_bytes_back(spark):
    texts = [t or "" for t in ODD]
    rows = byte_bpe.encode(table(spark, texts), VOCABULARY).select("doc_id", byte_bpe.decode(F.col("ids"), VOCABULARY).alias("b")).collect()
    assert {r["doc_id"]: bytes(r["b"]) for r in rows} == {i: t.encode() for i, t in enumerate(texts)}


def test_every_document_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = byte_bpe.round_trip(docs, VOCABULARY).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r["doc_id"]])
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), texts[r["doc_id"]].encode())]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), *digests]


def test_no_rows_repeated_rows_and_no_id(spark):
    assert byte_bpe.round_trip(table(spark, []), VOCABULARY).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id bigint, text string")
    assert sorted(r["n_tokens"] for r in byte_bpe.round_trip(twice, VOCABULARY).collect()) == [0, 2, 2]
