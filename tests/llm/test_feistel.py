import zlib

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import feistel


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 97, 1000, 1025])
def test_permutation_and_inverse(spark, n):
    df = spark.range(n).select("id", feistel.permuted(F.col("id"), n, "k").alias("p"))
    rows = df.withColumn("back", feistel.permuted(F.col("p"), n, "k", inverse=True)).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)


def test_order_changes_with_the_key_only(spark):
    def places(key, parts):
        df = spark.range(500).withColumnRenamed("id", "doc_id").repartition(parts)
        return {r["doc_id"]: (r["shard"], r["slot"]) for r in feistel.shard_rows(df, [F.col("doc_id")], 8, key).collect()}

    assert places("a", 3) == places("a", 7) != places("b", 3)


def test_slots_have_no_gaps_and_name_their_row(spark):
    docs = spark.range(101).select(F.col("id").alias("doc_id"))
    placed = feistel.shard_rows(docs, [F.col("doc_id")], 8, "x")
    rows = placed.withColumn("found", feistel.row_at(F.col("shard"), F.col("slot"), 101, 8, "x")).collect()
    assert all(r["found"] == r["row_number"] for r in rows)
    for shard in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (12, 13)


SCHEMA = "doc_id bigint, text string, shard string, slot string, row_number int"


def test_nulls_empty_repeated_rows_and_clashing_columns(spark):
    rows = [(None, None, "a", "b", 1), (1, "", "a", "b", 1), (1, "", "a", "b", 1), (2, "é" * 100_000, "a", "b", 1), (None, "x", None, None, None)]
    got = feistel.shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and {(r["shard"], r["slot"]) for r in got} == {(i, 0) for i in range(5)}
    long = next(r for r in got if r["doc_id"] == 2)
    assert long["size"] == 200_001 and long["text_crc32"] == zlib.crc32(("é" * 100_000).encode())
    assert sorted(r["size"] for r in got) == [1, 1, 1, 2, 200_001]
    assert all(r["grown_shard"] is None and r["law"] == "rows" for r in got)


def test_a_hot_id_is_numbered_across_partitions(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).cast("bigint").alias("doc_id"), F.lit("same").alias("text"))
    numbered, n = feistel.row_numbers(docs, [F.col("doc_id")])
    assert n == 3000 and sorted(r["row_number"] for r in numbered.collect()) == list(range(3000))


def test_no_rows(spark):
    assert feistel.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
