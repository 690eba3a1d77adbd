import random
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from cuesheet.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
DOCS = "doc_id bigint, text string, source string, row string, part string, fails string"
LABELS = "doc_id bigint, quality int, toxic int"


def plain(docs, labels):
    """Every order applied to every document, one by one."""
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    failing = []
    for d, t, s in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
             "D": any(c in t for c in "#$%&*|"), "E": d is not None and t in first and d > first[t]}
        failing.append((s or "", d, {k for k, v in f.items() if v}))
    rows = {}
    for part in {p for p, *_ in failing}:
        mine = [(d, f) for p, d, f in failing if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for i, k in enumerate(order):
                gone = [(d, f) for d, f in left if k in f]
                left = [(d, f) for d, f in left if k not in f]
                rows[part, order, i + 1] = [len(left), len(gone), sum(k in f for _, f in mine) - len(gone), sum(f == {k} for _, f in mine),
                                            sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    added = {}
    for (part, order, step), row in rows.items():
        added[part, order[step - 1]] = added.get((part, order[step - 1]), 0) + row[1]
    return {k: (*row, added[k[0], k[1][k[2] - 1]]) for k, row in rows.items()}


def result(df):
    assert df.columns == COLUMNS
    rows = df.collect()
    got = {tuple(r[:3]): tuple(r[3:]) for r in rows}
    assert len(got) == len(rows)
    return got


def tables(spark, docs, labels):
    return spark.createDataFrame([(*d, "r", "p", "f") for d in docs], DOCS), spark.createDataFrame(labels, LABELS)


def some_docs(rng, n):
    words = ["low", "Cap", "CAPS", "a#b", "5%", *[f"w{i}" for i in range(300)]]
    docs = []
    for i in range(n):
        many = rng.choice([3, 250, 400])
        text = " ".join(rng.choice(words[:rng.choice([2, 5, 305])]) if rng.random() < 0.7 else words[rng.randrange(5, 305)] for _ in range(many))
        docs.append((i, text, rng.choice(["a", "a", "b", None, ""])))
    return docs + [(n + i, rng.choice(docs)[1], rng.choice(["a", "c"])) for i in range(n // 3)]


def test_equals_all_orders_applied_one_by_one(spark):
    rng = random.Random(2)
    docs = some_docs(rng, 120) + [(None, None, None), (None, "x", "a"), (500, "", "b"), (500, "", "b"), (501, None, "c"), (-1, "x", "a"), (502, "x" * 100_000, "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 510, 2)] + [(4, 1, 1), (None, 1, 1)]
    assert result(filter_audit.audit_documents(*tables(spark, docs, labels))) == plain(docs, labels)


def test_hot_text_is_salted(spark, monkeypatch):
    monkeypatch.setattr(filter_audit.skew.salted_lookup, "__defaults__", ("inner", 10))
    docs = [(i, "the same text", "hot") for i in range(200)] + [(i, f"t{i}", "s") for i in range(200, 260)]
    assert result(filter_audit.audit_documents(*tables(spark, docs, [(3, 1, 1)]))) == plain(docs, [(3, 1, 1)])


def test_no_rows_and_no_failures(spark):
    assert filter_audit.audit_documents(*tables(spark, [], [])).count() == 0
    docs = [(1, " ".join(f"w{i}" for i in range(300)), "only")]
    assert result(filter_audit.audit_documents(*tables(spark, docs, []))) == plain(docs, [])


def test_filters_of_ones_own(spark):
    df = spark.createDataFrame([(1, "ab", "p"), (2, "b", "p"), (3, "c", "q")], "doc_id bigint, text string, source string")
    rows, failing = filter_audit.failing_relations(df, F.col("source"), {"a": F.col("text").contains("a"), "b": F.col("text").contains("b")}, copies=None)
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"]) for r in filter_audit.audit(rows, failing, {}).collect()}
    assert got == {("p", "ab", 1): (1, 1, 0), ("p", "ab", 2): (0, 1, 1), ("p", "ba", 1): (0, 2, 0), ("p", "ba", 2): (0, 0, 1),
                   ("q", "ab", 1): (1, 0, 0), ("q", "ab", 2): (1, 0, 0), ("q", "ba", 1): (1, 0, 0), ("q", "ba", 2): (1, 0, 0)}


def test_equals_the_statement_on_a_table(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = {r[:3]: r[3:] for r in db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({filter_audit.audit_sql()})").fetchall()}
    assert result(filter_audit.audit_documents(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))) == want
