import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import fold_statistics as stats
from cuesheet.plans import training

SCHEMA = "fold int, x double, y double, c string, words array<string>, m map<string,double>"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = []
    for _ in range(300):
        fold = rng.randrange(4)
        made.append((fold, rng.choice([None, float("nan"), float(rng.randrange(12)), rng.random()]), None if fold else float(fold),
                     rng.choice(["a", "b", "b", "c", None]) if fold else "only0",
                     rng.choice([None, [], [rng.choice("pqrstu") for _ in range(4)], [f"own{fold}", None]]), {f"k{fold}": 1.0, "k": 2.0}))
    return made


def parts_of(rows):
    return {str(i): [r for r in rows if r[0] != i] for i in range(4)} | {"all": rows}


def test_no_statistic_sees_its_own_fold(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = stats.learn(table, F.col("fold"), 4, stats.leave_one_out(4), ["x", "y"], ["c"])
    for name, mine in parts_of(rows).items():
        xs = [r[1] for r in mine if r[1] is not None and r[1] == r[1]]
        medians, modes = found.fillings(name, ["x", "y"], ["c"])
        assert medians["x"] == pytest.approx(median(xs))
        assert medians["y"] == (None if name == "0" else 0.0)  # only fold 0 has it
        counts = Counter(r[3] for r in mine if r[3] is not None)
        assert modes["c"] == min(counts, key=lambda v: (-counts[v], v)) and found.cardinalities[name]["c"] == len(counts)
        assert {r["c"]: r["code"] for r in found.codes(name, "c").collect()} == {v: i for i, v in enumerate(sorted(counts))}


def test_vocabularies_and_keys_of_parts(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    words = stats.part_vocabularies(table, F.col("fold"), 4, stats.leave_one_out(4), "words", 5)
    keys = stats.part_keys(table, F.col("fold"), 4, stats.leave_one_out(4), "m", 10)
    for name, mine in parts_of(rows).items():
        counts = Counter(w for r in mine for w in r[4] or [] if w is not None)
        assert words[name] == sorted(counts, key=lambda w: (-counts[w], w))[:5]
        assert keys[name] == sorted({k for r in mine for k in r[5]})
    with pytest.raises(ValueError):
        stats.part_keys(table, F.col("fold"), 4, stats.leave_one_out(4), "m", 2)


def test_parts_without_several_cells(spark):
    table = spark.createDataFrame([(c, float(v)) for c in range(4) for v in range(c, c + 3)], "cell int, x double")
    found = stats.learn(table, F.col("cell"), 4, {"a": [0, 1], "b": [3], "none": [0, 1, 2, 3]}, ["x"], [])
    assert found.medians == {"a": {"x": 3.5}, "b": {"x": 2.0}}
    assert stats.learn(table.limit(0), F.col("cell"), 4, stats.leave_one_out(4), ["x"], ["cell"]).medians == {}


def test_a_word_of_one_fold_is_no_column_when_that_fold_is_held_out(spark):
    rows = spark.range(60).select(F.col("id").alias("key"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 5).cast("double").alias("rating"),
                                  F.array(F.concat(F.lit("w"), (F.col("id") % 3).cast("string")), F.lit("all")).alias("tfidf_keywords"))
    widenings = training.fold_widenings(rows, 3, 10)
    assert {n: sorted(w.vocabulary) for n, w in widenings.items()} == {
        "0": ["all", "w1", "w2"], "1": ["all", "w0", "w2"], "2": ["all", "w0", "w1"], "all": ["all", "w0", "w1", "w2"]}
