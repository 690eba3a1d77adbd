import random
import statistics

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import encoding, folds, ordering, skew, timing


@pytest.fixture(scope="module")
def stream(spark):
    """One key holds most rows; many times are equal."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 50}", rng.randint(0, 300), i) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "k string, at bigint, id bigint").repartition(5).cache()


def by_key(rows):
    out = {}
    for k, at, i in sorted(rows):
        out.setdefault(k, []).append((at, i))
    return out


@pytest.mark.parametrize("chunk", [None, "at"])
def test_previous_row_crosses_chunks(stream, chunk):
    rows, df = stream
    cut = F.floor(F.col("at") / 10) if chunk else None
    got = {r.id: r.before for r in ordering.with_previous(df, ["k"], ["at", "id"], "at", "before", cut).collect()}
    for seq in by_key(rows).values():
        for n, (_, i) in enumerate(seq):
            assert got[i] == (seq[n - 1][0] if n else None)


def test_positions_and_running_totals(stream):
    rows, df = stream
    order = [F.col("at"), F.col("id")]
    pos = {r.id: r.pos for r in ordering.with_position(df, ["k"], order).collect()}
    total = {r.id: r.t for r in ordering.with_running_total(df, ["k"], order, F.col("at"), "t").collect()}
    for seq in by_key(rows).values():
        run = 0
        for n, (at, i) in enumerate(seq):
            run += at
            assert (pos[i], total[i]) == (n, run)
    everything = ordering.with_position(df, [], [F.col("id").desc()]).orderBy("pos").collect()
    assert [r.id for r in everything] == sorted((r[2] for r in rows), reverse=True)


def test_gaps_from_events(stream):
    rows, df = stream
    cues = timing.event_cues(df, "k", F.col("at"), "id")
    got = {r.id: (r.start_ms, r.gap_seconds) for r in timing.line_gaps(cues).collect()}
    for seq in by_key(rows).values():
        for n, (at, i) in enumerate(seq):
            assert got[i] == (at - seq[0][0], None if n == 0 else (at - seq[n - 1][0]) / 1000)


@pytest.mark.parametrize("max_rows, rows_per_salt", [(1000, 10), (0, 10), (0, 10**9)])
def test_lookup_paths_agree(stream, max_rows, rows_per_salt):
    rows, df = stream
    table = df.groupBy("k").agg(F.count("*").alias("n")).where("k != 'k0'")
    got = {r.id: r.n for r in skew.lookup(df, table, ["k"], ["id"], "left", max_rows, rows_per_salt).collect()}
    sizes = {k: len(v) for k, v in by_key(rows).items() if k != "k0"}
    assert got == {i: sizes.get(k) for k, _, i in rows}


@pytest.mark.parametrize("values", [[1.0, 3.0, None, 10.0], [2.0] * 50 + [7.0], [4.0, 1.0], [None, None], [float("nan"), 5.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int")
    known = [v for v in values if v is not None and v == v]
    got = ordering.exact_medians(df, ["v", "i"])
    assert got == {"v": statistics.median(known) if known else None, "i": statistics.median(range(len(values)))}
    filled = [r.v for r in encoding.impute_median(df, ["v"]).orderBy("i").collect()]
    if known:
        assert filled == [v if v is not None and v == v else got["v"] for v in values]


def test_group_folds_never_split_a_group(stream):
    rows, df = stream
    got = folds.with_group_fold(df, "k", 4, spread=["id"]).groupBy("k").agg(F.countDistinct("fold").alias("n"), F.min("fold").alias("f"))
    assert {r.n for r in got.collect()} == {1}
    sizes = sorted(((len(v), k) for k, v in by_key(rows).items()), key=lambda x: (-x[0], x[1]))
    snake = {k: (n % 4 if n // 4 % 2 == 0 else 3 - n % 4) for n, (_, k) in enumerate(sizes)}
    assert {r.k: r.f for r in got.collect()} == snake


def test_hash_folds_depend_on_the_seed(spark):
    df = spark.range(500)
    a, b, c = ([r.fold for r in folds.with_hash_fold(df, ["id"], 5, s).orderBy("id").collect()] for s in (42, 42, 7))
    assert a == b != c and set(a) == {0, 1, 2, 3, 4}
