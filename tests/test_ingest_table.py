"""The streamed query reads a table that is one file and a table that is a folder of parts."""

import pytest

import __spark_entry__ as app


@pytest.mark.parametrize("parts", [0, 3])
def test_incremental_features_of_a_file_or_a_folder(spark, tmp_path, parts):
    rows = spark.createDataFrame([(i, "One line here.\nTwo" if i % 2 else "word") for i in range(20)], "doc_id bigint, text string")
    target = tmp_path / "documents.parquet"
    if parts:
        rows.repartition(parts).write.parquet(str(target))
    else:
        rows.toPandas().to_parquet(target)
    found = {r.doc_id: (r.line_count, r.word_count) for r in app.queries()["incremental_features"](spark, str(tmp_path)).collect()}
    assert found == {i: (2, 5) if i % 2 else (1, 1) for i in range(20)}
