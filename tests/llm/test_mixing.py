import random
from math import log

import duckdb
import pytest

from cuesheet.llm import mixing as M

SCHEMA = "doc_id bigint, text string, source string, weight string, block int"


def skewed(n=4000, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = "big" if r.random() < 0.6 else r.choice(["a", "b", "c", None, ""])
        rows.append((i, r.choice([None, "", " \n", "w " * r.randrange(1, 60), "é\tx y"]) if r.random() < 0.3 else "word " * r.randrange(1, 90), source, "x", 1))
    rows.append((n, "", "empty", "x", 1))
    return rows


@pytest.mark.parametrize("target", [M.Target(), M.Target(entropy=0.999, budget=1.7), M.Target(entropy=0.3), M.Target(entropy=1.0, budget=0.4)])
def test_plan_equals_sql(spark, monkeypatch, target):
    monkeypatch.setattr(M, "BLOCK_DOCUMENTS", 50)
    rows = skewed()
    got = M.mixed_plan(spark.createDataFrame(rows, SCHEMA), target).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    cursor = con.execute(M.plan_sql(target=target))
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    key = lambda r: r["doc_id"]
    assert sorted((r.asDict() for r in got), key=key) == sorted(want, key=key)


def plan_rows(spark, target, rows):
    return M.mixed_plan(spark.createDataFrame(rows, SCHEMA), target).collect()


def test_entropy_and_budget_are_met(spark):
    rows = [(i, "word " * 10, "big" if i % 10 < 7 else f"s{i % 10}", "", 0) for i in range(5000)]
    got = plan_rows(spark, M.Target(entropy=0.9), rows)
    shares, total = {}, 0
    for r in got:
        shares[r["source"]] = shares.get(r["source"], 0) + r["copies"] * r["tokens"]
        total += r["copies"] * r["tokens"]
    entropy = -sum(s / total * log(s / total) for s in shares.values())
    assert entropy / log(4) == pytest.approx(0.9, abs=0.005) and abs(total - 50_000) <= 4 * 5  # half a document per source
    for source in shares:
        copies = {r["copies"] for r in got if r["source"] == source}
        assert max(copies) - min(copies) <= 1


def test_repetition_limit(spark):
    rows = [(i, "word " * 10, "big" if i % 10 else "small", "", 0) for i in range(2000)]
    got = plan_rows(spark, M.Target(entropy=None, repetitions=2.0), rows)
    small = [r["copies"] for r in got if r["source"] == "small"]
    assert max(small) == 2 and sum(small) / len(small) == pytest.approx(2.0, abs=0.05)
    with pytest.raises(ValueError):
        plan_rows(spark, M.Target(entropy=None), rows)


def test_mixed_rows(spark):
    rows = [(i, "word " * 10, "big" if i % 10 < 7 else f"s{i % 10}", "w", i) for i in range(1000)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = {r["doc_id"]: r["copies"] for r in M.mixed_plan(docs, M.Target(entropy=1.0)).collect()}
    out = M.mixed(docs, M.Target(entropy=1.0))
    assert out.columns == docs.columns
    seen = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert seen == {k: v for k, v in copies.items() if v}


def test_repeated_rows_one_source_and_no_rows(spark):
    same = [(1, "a b", "s", "", 0)] * 30
    assert sorted(r["copies"] for r in plan_rows(spark, M.Target(), same)) == [1] * 30
    half = plan_rows(spark, M.Target(budget=0.5), same)
    assert sum(r["copies"] for r in half) == 15  # of equal rows each is counted by itself
    assert plan_rows(spark, M.Target(), [(None, None, None, None, None)])[0]["copies"] == 1
    assert spark.createDataFrame([], SCHEMA).transform(M.mixed_plan).count() == 0
    assert M.mixed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_are_taken_whole_but_one(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DOCUMENTS", 20)
    got = plan_rows(spark, M.Target(entropy=1.0, budget=0.5), [(i, "w", "ab"[i % 5 == 0], "", 0) for i in range(1000)])
    mixed_blocks = {}
    for r in got:
        mixed_blocks.setdefault((r["source"], r["block"]), set()).add(r["copies"])
    for source in "ab":
        assert sum(len(v) > 1 for (s, _), v in mixed_blocks.items() if s == source) <= 1


def test_equal_sources_stay_as_they_are(spark):
    rows = [(i, "word " * (i // 3 + 1), f"s{i % 3}", "", 0) for i in range(27)]
    assert {r["copies"] for r in plan_rows(spark, M.Target(), rows)} == {1}
    whole = [(i, "word " * (i + 1), "ab"[i % 2], "", 0) for i in range(40)]
    assert {r["copies"] for r in plan_rows(spark, M.Target(entropy=0.5), whole)} == {1}  # the exponent is 1


def test_budget_is_met_within_half_a_document_and_a_long_one_does_not_end_it(spark):
    rows = [(i, "word " * (900 if i == 7 else 10), "big", "", 0) for i in range(200)] + [(1000 + i, "word " * 10, "small", "", 0) for i in range(20)]
    got = plan_rows(spark, M.Target(entropy=1.0, budget=0.2), rows)
    taken = {s: sum(r["copies"] * r["tokens"] for r in got if r["source"] == s) for s in ("big", "small")}
    assert all(abs(t - (1990 + 900 + 200) * 0.2 / 2) <= 5 for t in taken.values())


def test_columns_of_any_name_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, "x", 3), (2, "c", "t", 8, "y", 4)],
                                 "doc_id bigint, text string, source string, copies int, _copy string, _copies int")
    assert sorted(map(tuple, M.mixed(docs).collect())) == sorted(map(tuple, docs.collect()))
